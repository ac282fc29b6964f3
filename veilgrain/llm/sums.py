"""Sums of fixed-size arrays from many tasks."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tasks that share the first level of a sum.
FAN = 256


def in_two_levels(parts: DataFrame, key: str, fold: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """``fold`` over the rows of each key, first for every FAN-th task together and then over what that gives."""
    slot = F.pmod(F.spark_partition_id(), F.lit(FAN)).alias("slot")
    first = parts.select("*", slot).groupBy(key, "slot").applyInArrow(fold, schema)
    return first.groupBy(key).applyInArrow(fold, schema)
