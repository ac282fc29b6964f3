"""Lines that a site repeats on many of its pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilgrain.session import written

RATIO, LEAST_PAGES = 0.05, 3


def _name(line: Column) -> Column:
    """128 bits for a line."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(17), line).alias("b"))


def drop_boilerplate(docs: DataFrame, host: str = "source", id_col: str = "doc_id", text_col: str = "text", ratio: float = RATIO, least_pages: int = LEAST_PAGES, counted: DataFrame | None = None) -> DataFrame:
    """All columns of ``docs``, the text without its boilerplate, and ``n_lines`` and ``n_dropped``.

    Pages are rows, grouped by host. A line (between newlines, exactly as written) is boilerplate
    of a host if it is on ``least_pages`` pages or more and on more than ``ratio`` of
    the host's pages; several times on a page count once. All its occurrences go, and
    the other lines keep their order. Empty lines stay. Hosts that are null are
    one host; a null text stays null, has no lines and counts as a page; repeated rows are pages of their own.
    With ``counted``, only its rows are pages and lines are counted over them: ``docs`` without its copies, for one. It is read once.
    A host's boilerplate has at most (mean lines of a page) / ratio lines, which bounds the array that is joined.
    The arrays are written first, so that texts are shuffled by host only where the arrays are too many to broadcast.
    ``docs`` must not have columns named n_lines, n_dropped, or beginning with ``_line``.
    """
    lines = F.split(F.col(text_col), "\n", -1)
    names = F.array_distinct(F.transform(F.filter(lines, lambda x: x != ""), _name))
    # a null name stands for the page itself
    page = F.array(F.lit(None).cast("struct<a:long,b:long>"))
    each = (docs if counted is None else counted).select(F.col(host).alias("_line_host"), F.explode(F.concat(page, F.coalesce(names, F.slice(page, 1, 0)))).alias("name"))
    seen = each.groupBy("_line_host", "name").agg(F.count("*").alias("on")).where(F.col("name").isNull() | (F.col("on") >= least_pages))
    seen = written(seen, "lines")
    pages = seen.where("name is null").select(F.col("_line_host").alias("h"), F.col("on").alias("pages"))
    often = seen.where("name is not null").join(pages, F.col("_line_host").eqNullSafe(F.col("h")))
    often = often.where(F.col("on") > ratio * F.col("pages"))
    bad = written(often.groupBy("_line_host").agg(F.collect_set("name").alias("_line_bad")), "boilerplate")
    joined = docs.join(bad, F.col(host).eqNullSafe(F.col("_line_host")), "left").drop("_line_host")
    listed = joined.withColumn("_line_all", lines)
    kept = F.filter("_line_all", lambda x: ~F.coalesce(F.array_contains("_line_bad", _name(x)), F.lit(False)))
    out = listed.withColumn("_line_kept", F.when(F.col("_line_bad").isNull(), F.col("_line_all")).otherwise(kept))
    count = F.when(F.col("_line_all").isNull(), 0).otherwise(F.size("_line_all")).cast("long")
    left = F.when(F.col("_line_all").isNull(), 0).otherwise(F.size("_line_kept")).cast("long")
    out = out.withColumns({"n_lines": count, "n_dropped": count - left, text_col: F.array_join("_line_kept", "\n")})
    return out.drop("_line_all", "_line_kept", "_line_bad")
