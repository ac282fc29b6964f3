"""Audits of dataset splits and distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilgrain.functions import ranks as R
from veilgrain.session import written


def split_overlap(df: DataFrame, key: Column, split: str = "split") -> DataFrame:
    """Keys that occur in more than one split, with every pair of splits.

    Copies are reduced to one row per (key, split) first, map-side, so a text
    copied very often costs no more than a rare one; the set per key then holds
    split names only.
    """
    seen = df.select(key.alias("key"), F.col(split).alias("s")).groupBy("key", "s").agg(F.count("*").alias("n"))
    groups = seen.groupBy("key").agg(F.sort_array(F.collect_set("s")).alias("splits"), F.sum("n").alias("rows"))
    return groups.filter(F.size("splits") > 1)


def split_pairs(overlap: DataFrame) -> DataFrame:
    """Shared keys per pair of splits."""
    pair = overlap.select(F.explode("splits").alias("a"), "splits").select("a", F.explode("splits").alias("b"))
    return pair.filter("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))


def content_key(text: str) -> Column:
    return F.sha2(F.col(text), 256)


def template_overlap(df: DataFrame, template: str, split: str = "split") -> DataFrame:
    """The same on the template family."""
    return split_overlap(df, F.col(template), split)


def assign_splits(df: DataFrame, group: str, weights=(("train", 0.7), ("val", 0.15), ("test", 0.15)), salt: str = "") -> DataFrame:
    """A split per row by a hash of its group, so a family never straddles splits.

    A narrow projection: nothing is shuffled and the result never changes.
    """
    total = sum(w for _, w in weights)
    bucket = F.conv(F.substring(F.md5(F.concat(F.lit(salt), F.col(group).cast("string"))), 1, 8), 16, 10).cast("long")
    place = bucket / F.lit(2.0**32)
    chain, edge = None, 0.0
    for name, w in weights[:-1]:
        edge += w / total
        chain = F.when(place < edge, name) if chain is None else chain.when(place < edge, name)
    return df.withColumn("split", chain.otherwise(weights[-1][0]))


def distribution_stats(df: DataFrame, by: list[str]) -> DataFrame:
    """Objects, density, areas, small share and aspect, per ``by``."""
    area = F.col("w") * F.col("h")
    rows = df.withColumn("_area", area).withColumn("_aspect", F.col("w") / F.greatest(F.lit(1), F.col("h")))
    per_image = rows.groupBy(*by, "image_id").agg(
        F.count("*").alias("_n"), F.sum("_area").alias("_a"), F.sum("_aspect").alias("_r"),
        F.count_if(F.col("_area") < 32 * 32).alias("_small"),
    )
    n = F.sum("_n")
    basic = per_image.groupBy(*by).agg(
        F.count("*").alias("images"), n.alias("objects"), F.round(n / F.count("*"), 2).alias("density"),
        F.round(F.sum("_a") / n, 1).alias("mean_area"), F.round(F.sum("_small") / n * 100, 2).alias("small_pct"),
        F.round(F.sum("_r") / n, 2).alias("mean_aspect"),
    )
    median = R.value_ranks(rows.select(*by, "_area"), by, "_area").groupBy(*by).agg(
        F.round(R.linear_quantile("_area", 0.5), 1).alias("median_area")
    )
    return basic.join(median, by)


def class_distribution(df: DataFrame, by: list[str]) -> DataFrame:
    """Count and share of each class within ``by``."""
    counts = df.groupBy(*by, "cls").agg(F.count("*").alias("n"))
    totals = counts.groupBy(*by).agg(F.sum("n").alias("_t"))
    return counts.join(totals, by).withColumn("pct", F.round(F.col("n") / F.col("_t") * 100, 2)).drop("_t")


def domain_gap(stats: DataFrame, split: str, a: str, b: str) -> DataFrame:
    """Difference (a minus b) of the distribution figures of two splits."""

    def of(which, name):
        return F.max(F.when(F.col(split) == which, F.col(name)))

    names = ("density", "small_pct", "mean_aspect", "mean_area", "median_area")
    return stats.agg(*[F.round(of(a, n) - of(b, n), 2).alias(f"{n}_gap") for n in names])


def benchmark_leakage(docs: DataFrame, bench: DataFrame, doc_id: str, item_id: str, text: str = "text", n: int = 8) -> DataFrame:
    """Share of an evaluation text's word n-grams found in each document.

    Grams are hashed and distinct per text. The evaluation side is reduced to
    its distinct grams first and the documents are cut down to those by a semi
    join, so common grams of ordinary text never reach the pair join.
    """

    items, found = _grams(bench, item_id, text, n), _grams(docs, doc_id, text, n)
    totals = items.groupBy(item_id).agg(F.count("*").alias("grams"))
    known = items.select("_g").distinct()
    hits = found.join(known, "_g", "left_semi")
    shared = hits.join(items, "_g").groupBy(doc_id, item_id).agg(F.count("*").alias("shared"))
    return shared.join(totals, item_id).select(
        doc_id, item_id, "shared", "grams", F.round(F.col("shared") / F.col("grams"), 6).alias("containment")
    )


def _grams(df: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """(key, _g): the distinct hashed n-grams of words of each text."""
    words = df.select(F.col(key), F.filter(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+"), lambda w: w != "").alias("_w"))
    starts = F.sequence(F.lit(1), F.size("_w") - n + 1)
    hashed = F.array_distinct(F.transform(starts, lambda i: F.xxhash64(F.array_join(F.slice("_w", i, n), " "))))
    return words.filter(F.size("_w") >= n).select(key, F.explode(hashed).alias("_g"))


def benchmark_containment(docs: DataFrame, bench: DataFrame, doc_id: str, item_id: str, least: float = 0.5, text: str = "text", n: int = 8) -> DataFrame:
    """Documents that hold at least the share ``least`` of an item's word n-grams, as in benchmark_leakage.

    Whoever shares k of an item's g grams shares one of any g - k + 1 of them. Pairs
    therefore meet on the g - k + 1 grams that the fewest documents hold; a gram that
    is everywhere brings nobody together. What a pair shares is counted afterwards, on
    (document, gram), where no key is large. Ids must be unique and not null.
    """
    items = written(_grams(bench, item_id, text, n), "item-grams")
    hits = written(_grams(docs, doc_id, text, n).join(items.select("_g").distinct(), "_g", "left_semi"), "gram-hits")
    spread = hits.groupBy("_g").agg(F.count("*").alias("_n"))
    totals = items.groupBy(item_id).agg(F.count("*").alias("grams"))
    rarity = Window.partitionBy(item_id).orderBy("_n", "_g")
    ranked = items.join(spread, "_g", "left").withColumn("_n", F.coalesce("_n", F.lit(0))).join(totals, item_id)
    need = F.greatest(F.lit(1), F.ceil(F.col("grams") * least - 1e-9))
    rare = ranked.withColumn("_rank", F.row_number().over(rarity)).filter((F.col("_rank") <= F.col("grams") - need + 1) & (F.col("_n") > 0))
    pairs = hits.join(rare.select("_g", item_id), "_g").select(doc_id, item_id).distinct()
    shared = pairs.join(items, item_id).join(hits, [doc_id, "_g"]).groupBy(doc_id, item_id).agg(F.count("*").alias("shared"))
    found = shared.join(totals, item_id).filter(F.col("shared") >= need)
    return found.select(doc_id, item_id, "shared", "grams", F.round(F.col("shared") / F.col("grams"), 6).alias("containment"))
