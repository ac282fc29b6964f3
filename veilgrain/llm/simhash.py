"""SimHash near duplicates: a byte-position inverted index with count filtering.

1. A text's fingerprint holds, bit by bit, what more than half of its shingle
   hashes say. Texts with one fingerprint are one entry from here on.
2. Fingerprints that differ in at most two bits differ in at most two of their
   eight bytes, so at least six of the eight (position, byte) entries of the index
   name both. Counting shared entries pair by pair would pass over every pair of
   a frequent byte; the lists kept are therefore those of six positions at once
   (28 ways to choose them). Being together in one of them is the same as a tally
   of six or more, and the tally is six plus the free bytes that agree.
3. Two bytes are free in a list, so it has at most 65,536 members whatever the
   data. Partners are verified by looking up the values within two bits: pairs of
   tally six differ by one bit in each free byte, pairs of tally seven by one or
   two bits in one byte; the latter lie in seven lists and are taken in one.
4. A range of lists returns a star for each connected set, never its pairs;
   components of the stars are the components of all links.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilgrain.llm.graphs import components
from veilgrain.llm.hot import attach
from veilgrain.session import written

SEED = 42
#: Index entries in one task, 16 bytes each.
RANGE_ROWS = 1 << 19
#: Shingles hashed at a time.
STEP = 1 << 14
FREE = list(itertools.combinations(range(8), 2))


def fingerprint(text: str | None, n: int = 3) -> int:
    """The unsigned 64-bit fingerprint of a text; 0 without words."""
    found = (text or "").encode().lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    ends = list(itertools.accumulate(len(w) + 1 for w in found))
    starts = [0, *ends[:-1]]
    stops = [e - 1 for e in ends[n - 1 :]] or [len(joined)]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(stops), STEP):
        hashes = [xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[at : at + STEP], stops[at : at + STEP], strict=False)]
        octets = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(stops), bitorder="little").view("<u8")[0])


def _fingerprints(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), n) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return run


def _masks(which: int) -> np.ndarray:
    """The differences that the lists of this choice verify, the first free byte in bits 0 to 7, the second in 8 to 15.

    A difference in one byte belongs to one choice: that byte and its cyclic follower.
    """
    low, high = FREE[which]
    one = [1 << i for i in range(8)]
    single = one + [a | b for a, b in itertools.combinations(one, 2)]
    out = [a << 8 | b for a in one for b in one]
    if high == low + 1:
        out += single
    if (high + 1) % 8 == low:
        out += [a << 8 for a in single]
    return np.array(out, np.uint64)


def _partners(prints: np.ndarray, which: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (a, b) in ``prints`` (distinct, one choice of free bytes) that share a list and differ in at most two bits."""
    order = [*FREE[which], *(p for p in range(8) if p not in FREE[which])]
    codes = np.ascontiguousarray(prints.astype("<u8").view(np.uint8).reshape(-1, 8)[:, order]).view("<u8").ravel()
    at = np.argsort(codes)
    codes = codes[at]
    # a list is a run of equal upper six bytes; only lists of two or more matter
    same = (codes[1:] >> np.uint64(16)) == (codes[:-1] >> np.uint64(16))
    met = np.r_[same, False] | np.r_[False, same]
    codes, at = codes[met], at[met]
    if not len(codes):
        return at, at
    left, right = [], []
    for mask in _masks(which):
        other = codes ^ mask
        upward = np.flatnonzero(other > codes)
        place = np.minimum(np.searchsorted(codes, other[upward]), len(codes) - 1)
        hit = codes[place] == other[upward]
        left.append(at[upward[hit]])
        right.append(at[place[hit]])
    return np.concatenate(left), np.concatenate(right)


def _stars(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of the connected set of each of n vertices."""
    root = np.arange(n)
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        open_ = low != high
        a, b = a[open_], b[open_]
        np.minimum.at(root, high[open_], low[open_])
        while not np.array_equal(root, root[root]):
            root = root[root]
    return root


def _search(table: pa.Table) -> pa.Table:
    """Stars of the links in one range of the index."""
    which, prints = table["which"].to_numpy(), table["fp"].to_numpy().view(np.uint64)
    names, index = np.unique(prints, return_inverse=True)
    a, b = [], []
    for c in np.unique(which):
        own = np.unique(index[which == c])
        left, right = _partners(names[own], int(c))
        a.append(own[left])
        b.append(own[right])
    root = _stars(len(names), np.concatenate(a), np.concatenate(b))
    moved = np.flatnonzero(root != np.arange(len(names)))
    names = names.view(np.int64)
    return pa.table({"a": pa.array(names[moved]), "b": pa.array(names[root[moved]])})


def links(prints: DataFrame, rows: int) -> DataFrame:
    """(a, b): links that connect all the ``rows`` distinct values of ``fp`` which links of at most two bits connect."""
    masks = [sum(0xFF << 8 * p for p in range(8) if p not in free) for free in FREE]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    entries = prints.select("fp", F.posexplode(F.array(*(F.col("fp").bitwiseAND(m) for m in signed))).alias("which", "list"))
    ranges = max(1, math.ceil(len(FREE) * rows / RANGE_ROWS))
    entries = entries.select("fp", "which", F.pmod(F.xxhash64("which", "list"), F.lit(ranges)).alias("range"))
    return entries.groupBy("range").applyInArrow(_search, "a long, b long")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) for each row of ``docs``.

    A-Z are lower-cased; words are runs free of ASCII white space; shingles are n
    words joined by spaces, repeats included, or all the words where there are fewer.
    A shingle's hash is XXH64 with seed 42; a bit of ``fp`` (64 bits as a signed long)
    is 1 where more than half of the hashes have it. Null, empty and blank texts have
    the fingerprint 0, which links like any other. ``component_id`` is the least id
    reachable by links of at most two bits. Rows with a null id take part; a
    component of null ids only is named null. Repeated rows give repeated results,
    and other columns of ``docs`` are not looked at.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = written(rows.mapInArrow(_fingerprints(n), "doc_id long, fp long"), "fingerprints")
    prints = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n_rows")), "prints")
    size = prints.agg(F.count("*").alias("n"), F.sum("n_rows").alias("rows")).first()
    groups = components(written(links(prints.select("fp"), size.n), "links"), "a", "b").withColumnRenamed("vertex", "fp")
    named = prints.join(groups, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    named = written(named, "named")
    names = named.groupBy("component").agg(F.min("least").alias("component_id"))
    values = written(named.join(names, "component").select("fp", "component_id", "n_rows"), "values")
    return attach(rows, values, "fp", "n_rows", size.rows or 0).select("doc_id", "fp", "component_id")
