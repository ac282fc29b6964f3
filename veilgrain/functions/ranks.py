"""Exact ranks, prefix counts and quantiles without putting a whole group into one task."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilgrain.session import written


def _beside(rows: DataFrame, groups: DataFrame, by: list[str]) -> DataFrame:
    """``rows`` with the other columns of ``groups``; null groups are groups."""
    other = groups.withColumnsRenamed({c: f"_of_{c}" for c in by})
    return rows.join(other, reduce(and_, (F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in by)))


def ranged(df: DataFrame, by: list[str], order: list[str], label: str = "sorted") -> DataFrame:
    """``df`` sorted over the cluster into ranges, named by ``_range``, in which running sums are cheap.

    Spark samples (by, order), so ranges hold about as many rows each however the
    values or groups are spread; a large group lies in many ranges. The rows are
    written, so that every later pass sees the same ranges.
    """
    return written(df.repartitionByRange(*by, *order).withColumn("_range", F.spark_partition_id()), label)


def running(placed: DataFrame, by: list[str], order: list[str], values: dict[str, str], how=F.sum, backward: bool = False) -> DataFrame:
    """``ranged`` rows with ``how`` (sum, max, ...) of columns over their group up to each row, as {new name: column}.

    What the ranges before (behind, if ``backward``) add comes from one row per
    group and range. Rows equal in ``order`` must be one row.
    """
    turn = F.desc if backward else F.asc
    parts = placed.groupBy(*by, "_range").agg(*(how(c).alias(f"_part_{out}") for out, c in values.items()))
    ahead = Window.partitionBy(*by).orderBy(turn("_range")).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*by, "_range", *(how(f"_part_{out}").over(ahead).alias(f"_ahead_{out}") for out in values))
    inside = Window.partitionBy("_range", *by).orderBy(*map(turn, order)).rowsBetween(Window.unboundedPreceding, 0)
    rows = placed.select("*", *(how(c).over(inside).alias(f"_own_{out}") for out, c in values.items()))
    joined = _beside(rows, parts, [*by, "_range"])
    fold = (lambda a, b: a + F.coalesce(b, F.lit(0))) if how is F.sum else F.greatest
    return joined.select(*placed.columns, *(fold(F.col(f"_own_{out}"), F.col(f"_ahead_{out}")).alias(out) for out in values))


def value_ranks(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Distinct values of each group with the ranks they take: ``before < rank <= upto``.

    Values are counted map-side first; ranks are running sums of the counts over
    sampled ranges. Null values have no rank; null groups are groups.
    """
    if not by:
        return value_ranks(df.withColumn("_all", F.col(value).isNotNull()), ["_all"], value).drop("_all")
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    ranked = running(ranged(counts, by, [value], "ranks"), by, [value], {"upto": "n"})
    totals = ranked.groupBy(*by).agg(F.max("upto").alias("total"))
    return _beside(ranked, totals, by).select(*by, value, "n", "total", (F.col("upto") - F.col("n")).alias("before"), "upto")


def at_rank(value: str, rank: Column) -> Column:
    """Aggregate: the value that takes 1-based ``rank``, over ``value_ranks`` rows."""
    return F.max(F.when((F.col("before") < rank) & (rank <= F.col("upto")), F.col(value)))


def linear_quantile(value: str, p: float) -> Column:
    """Aggregate: quantile with linear interpolation between ranks."""
    place = (F.col("total") - 1) * p
    low = F.floor(place)
    a, b = at_rank(value, low + 1), at_rank(value, F.least(low + 2, F.col("total")))
    return a + (b - a) * (F.max(place) - F.floor(F.max(place)))


def nearest_rank(value: str, p: float) -> Column:
    """Aggregate: the value at rank ceil(p * n)."""
    return at_rank(value, F.ceil(F.col("total") * p))
