"""A join on a key that a few values may dominate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot from one thousandth of the rows on, so there are at most a thousand hot keys.
SHARE = 1000


def attach(rows: DataFrame, values: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """``rows`` with the columns of ``values`` (one row a key); ``weight`` is how many of the ``total`` rows hold the key.

    Rows of hot keys stay where they are and meet a broadcast of at most SHARE
    values; the others are joined by a shuffle in which no key is large. Rows
    whose key is null or not in ``values`` get nulls.
    """
    hot = values.where(F.col(weight) * SHARE >= total).drop(weight)
    warm = rows.join(F.broadcast(hot), key)
    cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(values.drop(weight), key, "left")
    return warm.unionByName(cold)
