"""Language of texts and pages: text likelihoods, markup, address and host, fused by Bayes' rule.

Text: hashed byte trigrams, naive Bayes, with counts from every labelled document of
the learning fold; the sum is limited to the weight of EVIDENCE trigrams, since neighbouring ones are not
independent. Declared markup language and address suffix (top-level domain): how often each value goes with each
language, counted over all pages by the text's own best guess, smoothed. Host: its share of each language, smoothed towards
its domain's, that towards its suffix's, and that towards the share of all pages.
All these counts are grouped aggregates.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilgrain.llm.arrays import lower_ascii, mix, pieces
from veilgrain.llm.sums import in_two_levels
from veilgrain.llm.quality import fold
from veilgrain.session import written

BUCKETS = 1 << 15
EVIDENCE = 60
HOST_WEIGHT, SMOOTH = 10.0, 1.0

_CUT = re.compile(r"(?is)<(script|style|head)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>")
_DECLARED = re.compile(r"""(?is)<html\b[^>]*?\blang\s*=\s*["']?([A-Za-z]{2,3})""")


def trigrams(data: np.ndarray) -> np.ndarray:
    """Class of the three bytes from each position on, A-Z lower-cased."""
    b = lower_ascii(data).astype(np.uint64)
    code = np.zeros(len(b), np.uint64)
    code[: len(b) - 2] = b[: len(b) - 2] | (b[1 : len(b) - 1] << np.uint64(8)) | (b[2:] << np.uint64(16))
    return (mix(code) >> np.uint64(49)).astype(np.int64)


def _inside(offsets: np.ndarray, size: int) -> np.ndarray:
    """Positions whose three bytes lie within one row."""
    ok = np.ones(size, bool)
    for back in (1, 2):
        edge = offsets[1:] - back
        ok[edge[edge >= 0]] = False
    return np.flatnonzero(ok)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        lang = np.array(batch.column(0).to_pylist(), object)
        for first, last, data, offsets in pieces(batch.column(1)):
            if len(data) < 3:
                continue
            at = _inside(offsets, len(data))
            code = trigrams(data)[at]
            row = np.searchsorted(offsets, at, side="right") - 1
            names, which = np.unique(lang[first:last].astype(str), return_inverse=True)
            found = np.bincount(which[row] * BUCKETS + code, minlength=len(names) * BUCKETS).reshape(-1, BUCKETS)
            for name, counts in zip(names, found, strict=True):
                total[name] = total.get(name, 0) + counts
    names = sorted(total)
    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([total[n].astype(np.int64).tobytes() for n in names], pa.binary())], ["lang", "counts"])


def _add(table: pa.Table) -> pa.Table:
    parts = [np.frombuffer(x, np.int64) for x in table["counts"].to_pylist()]
    return pa.table([table["lang"][:1], pa.array([np.sum(parts, axis=0).tobytes()], pa.binary())], names=["lang", "counts"])


def text_model(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """(languages, log probabilities); one row of fixed size for each language."""
    rows = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    parts = rows.where("lang is not null and text is not null").mapInArrow(_count, "lang string, counts binary")
    found = sorted(in_two_levels(parts, "lang", _add, "lang string, counts binary").collect())
    counts = np.array([np.frombuffer(r.counts, np.int64) for r in found], np.float64).reshape(-1, BUCKETS) + 0.5
    return [r.lang for r in found], np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)


def visible(html: str) -> str:
    """Text of a page without tags, scripts, styles and head."""
    return _CUT.sub(" ", html)


def _likelihood(table: np.ndarray, markup: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, declared = batch.column(batch.num_columns - 1), [None] * batch.num_rows
            if markup:
                html = [x or "" for x in column.to_pylist()]
                declared = [m[1].lower() if (m := _DECLARED.search(x)) else None for x in html]
                column = pa.array([visible(x) for x in html], pa.large_string())
            out = np.zeros((batch.num_rows, len(table)))
            for first, last, data, offsets in pieces(column):
                if len(data) < 3:
                    continue
                at = _inside(offsets, len(data))
                code = trigrams(data)[at]
                row = np.searchsorted(offsets, at, side="right") - 1
                count = np.bincount(row, minlength=last - first)
                weight = np.minimum(count, EVIDENCE) / np.maximum(count, 1)
                for k, odds in enumerate(table):
                    out[first:last, k] = np.bincount(row, odds[code], minlength=last - first) * weight
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(declared, pa.string()), pa.array(out.tolist(), pa.list_(pa.float64()))],
                [*batch.schema.names[:-1], "declared", "text_log"],
            )

    return run


def _table(counts: DataFrame, key: str, langs: list[str], name: str) -> DataFrame:
    """(key, array of counts by language)."""
    sums = [F.sum(F.when(F.col("guess") == lang, F.col("n")).otherwise(0)).cast("double") for lang in langs]
    return counts.groupBy(key).agg(F.array(*sums).alias(name))


def _share(own: Column, above: Column) -> Column:
    """Counts smoothed towards the share of the level above."""
    total = F.aggregate(own, F.lit(0.0), lambda a, x: a + x)
    return F.zip_with(own, above, lambda n, p: (n + HOST_WEIGHT * p) / (total + HOST_WEIGHT))


def identify(rows: DataFrame, model: tuple[list[str], np.ndarray], keys: list[str], markup: bool = True) -> DataFrame:
    """``keys`` and (lang, probability, text_lang, declared, prior_lang) for each row of (keys, host, domain, suffix, text).

    With ``markup`` the text is HTML. Null or empty evidence of any kind leaves the others to decide; with none at all, and
    for ties, the more frequent language wins, then the first by name. Repeated rows count each. A model without languages
    gives nulls. Null keys pass through.
    """
    langs, table = model
    shape = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in (*keys, "host", "domain", "suffix"))
    seen = rows.select(*keys, "host", "domain", "suffix", "text").mapInArrow(_likelihood(table, markup), shape + ", declared string, text_log array<double>")
    names = F.array(*[F.lit(x) for x in langs]) if langs else F.lit(None).cast("array<string>")

    def best(scores: Column) -> Column:
        return F.element_at(names, F.array_position(scores, F.array_max(scores)).cast("int"))

    if not langs:
        none = F.lit(None).cast("string")
        return seen.select(*keys, none.alias("lang"), F.lit(None).cast("double").alias("probability"), none.alias("text_lang"), "declared", none.alias("prior_lang"))
    seen = written(seen.withColumn("guess", best(F.col("text_log"))), "likelihoods")
    counts = written(seen.groupBy("host", "domain", "suffix", "declared", "guess").agg(F.count("*").alias("n")), "counts")
    every = _table(counts.withColumn("one", F.lit(1)), "one", langs, "all").drop("one")
    totals = every.first()
    shares = (np.array(totals[0]) if totals else np.zeros(len(langs))) + SMOOTH
    shares = F.array(*[F.lit(float(x)) for x in shares / shares.sum()])
    of_suffix = _table(counts.where("suffix is not null"), "suffix", langs, "s_n").withColumn("s_p", _share(F.col("s_n"), shares))
    of_domain = _table(counts.where("domain is not null"), "domain", langs, "d_n")
    of_host = _table(counts.where("host is not null"), "host", langs, "h_n")
    of_declared = _table(counts.where("declared is not null"), "declared", langs, "m_n")
    whole = _table(counts.where("declared is not null").withColumn("one", F.lit(1)), "one", langs, "n").drop("one").first()
    marked = whole[0] if whole else [0.0] * len(langs)
    full = seen.join(of_suffix, "suffix", "left").join(of_domain, "domain", "left").join(of_host, "host", "left").join(of_declared, "declared", "left")
    flat = F.array(*[F.lit(0.0)] * len(langs))
    suffix = F.coalesce("s_p", shares)
    domain = _share(F.coalesce("d_n", flat), suffix)
    prior = _share(F.coalesce("h_n", flat), domain)
    # P(declared | language), one more count for each language and for an unseen value
    given = [(F.coalesce(F.element_at("m_n", k + 1), F.lit(0.0)) + SMOOTH) / (marked[k] + SMOOTH * (len(langs) + 1)) for k in range(len(langs))]
    markup_log = F.when(F.col("declared").isNull(), flat).otherwise(F.array(*[F.log(x) for x in given]))
    full = full.withColumns({"prior": prior, "markup_log": markup_log})
    joint = F.zip_with(F.zip_with("text_log", "markup_log", lambda a, b: a + b), "prior", lambda a, p: a + F.log(p))
    full = full.withColumn("joint", joint)
    top = F.array_max("joint")
    mass = F.aggregate(F.transform("joint", lambda x: F.exp(x - F.array_max("joint"))), F.lit(0.0), lambda a, x: a + x)
    return full.select(*keys, F.element_at(names, F.array_position("joint", top).cast("int")).alias("lang"), (1 / mass).alias("probability"), F.col("guess").alias("text_lang"), "declared", best(F.col("prior")).alias("prior_lang"))


def page_rows(pages: DataFrame) -> DataFrame:
    """(page_id, host, domain, suffix, text) of raw pages; an address without host gives nulls."""
    host = F.nullif(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1)), F.lit(""))
    domain = F.nullif(F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1), F.lit(""))
    suffix = F.nullif(F.regexp_extract(host, r"\.([^.]+)$", 1), F.lit(""))
    return pages.select(F.col("page_id").cast("long"), host.alias("host"), domain.alias("domain"), suffix.alias("suffix"), F.col("html").cast("string").alias("text"))


def document_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, host, domain, suffix, text) of documents: the source stands for the host, there is no address or markup."""
    none = F.lit(None).cast("string")
    return docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string").alias("host"), none.alias("domain"), none.alias("suffix"), F.col("text").cast("string").alias("text"))


def learning_rows(docs: DataFrame) -> DataFrame:
    """Labelled documents of the folds that are not held out."""
    return docs.where(fold(F.col("doc_id")) != 1)
