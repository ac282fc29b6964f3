"""Merkle fingerprints of texts, and how alike two are.

The leaves of a tree are runs of a few words; the branches above follow boundaries
of growing strength. Inside a paragraph the strength of a boundary comes from the
word before it (where a few words repeat, from the count of repeats too), the end of a
paragraph (line) is at least PARAGRAPH strong and a blank line, the end of a
section, at least SECTION. A branch hashes its children
in order, so equal roots mean equal texts and differing branches lead to an edit.
A fingerprint holds the root, the level of the finest branches that number at most
``width``, and these with the strength of the boundary after each; the coarser
levels follow from them, so trees cut at different levels compare.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilgrain.llm.arrays import BYTE_VALUES, mix, pieces, span_hash, sums, words
from veilgrain.session import written

WIDTH = 64
PARAGRAPH, SECTION, TOP = 3, 5, 15
RANGE_BYTES = 16 << 20
GROUP_BYTES = 1 << 20


def _strength(hashes: np.ndarray) -> np.ndarray:
    """Number of trailing zero bits, at most TOP."""
    low = hashes & (~hashes + np.uint64(1))
    return np.minimum(np.log2(np.maximum(low, np.uint64(1)).astype(np.float64)).astype(np.int64), TOP)


def _repeats(hashes: np.ndarray, periods: int = 8) -> np.ndarray:
    """How long the words before each have repeated with a period of at most ``periods`` words; 0 below 8."""
    out = np.zeros(len(hashes), np.int64)
    at = np.arange(len(hashes))
    for p in range(1, periods + 1):
        last = at.copy()
        last[p:][hashes[p:] == hashes[:-p]] = 0
        out = np.maximum(out, at - np.maximum.accumulate(last))
    return np.where(out < 8, 0, out)


def _join(values: np.ndarray, strong: np.ndarray, rows: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Branches of a level from those below: children up to a boundary of that strength, or the end of the row."""
    last = strong >= level
    last[:-1] |= rows[1:] != rows[:-1]
    last[-1:] = True
    stop = np.flatnonzero(last) + 1
    start = np.r_[0, stop[:-1]]
    return (span_hash(sums(values), start, stop) >> np.uint64(32)), strong[stop - 1], rows[stop - 1]


def trees(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """(root, level, branches, strengths) of each row of a piece."""
    n = len(offsets) - 1
    running = sums(BYTE_VALUES[data])
    starts, ends, rows = words(data, offsets)
    whole = span_hash(running, offsets[:-1], offsets[1:])
    names = span_hash(running, starts, ends)
    strong = _strength(mix(names + _repeats(names).astype(np.uint64)))
    following = np.r_[starts[1:], len(data)]
    following = np.minimum(following, offsets[1:][rows])
    lines = np.r_[0, np.cumsum(data == 10)]
    breaks = lines[following] - lines[ends]
    strong = np.where(breaks > 1, np.maximum(strong, SECTION), np.where(breaks == 1, np.maximum(strong, PARAGRAPH), strong))
    first = np.ones(len(starts), bool)
    first[1:] = rows[1:] != rows[:-1]
    begin = np.where(first, offsets[:-1][rows], starts)
    values = span_hash(running, begin, following) >> np.uint64(32)
    level = np.zeros(n, np.int64)
    out: list = [None] * n
    for step in range(1, TOP + 2):
        values, strong, rows = _join(values, strong, rows, step)
        count = np.bincount(rows, minlength=n)
        done = (count <= width) | (step > TOP)
        cuts = np.searchsorted(rows, np.arange(n + 1))
        for row in np.flatnonzero(done):
            if out[row] is None:
                level[row] = step
                out[row] = (int(whole[row]), step, values[cuts[row] : cuts[row + 1]], strong[cuts[row] : cuts[row + 1]])
        keep = ~done[rows]
        values, strong, rows = values[keep], strong[keep], rows[keep]
        if not len(rows):
            break
    return out


def text_of(tree: tuple) -> str:
    root, level, values, strong = tree
    return f"{root:016x}{level:02x}:{values.astype('>u4').tobytes().hex()}:{''.join(f'{x:x}' for x in strong.tolist())}"


def tree_of(text: str) -> tuple:
    """The tree that a fingerprint holds."""
    head, values, strong = text.split(":")
    numbers = np.frombuffer(bytes.fromhex(values), ">u4").astype(np.uint64)
    return int(head[:16], 16), int(head[16:], 16), numbers, np.array([int(x, 16) for x in strong], np.int64)


def _at(tree: tuple, level: int) -> list[int]:
    _, own, values, strong = tree
    rows = np.zeros(len(values), np.int64)
    while own < level:
        own += 1
        values, strong, rows = _join(values, strong, rows, own)
    return values.tolist()


def likeness(a: tuple, b: tuple) -> float:
    """Common branches over those of the larger tree, at the coarser level of the two; 1 for equal roots."""
    if a[0] == b[0]:
        return 1.0
    level = max(a[1], b[1])
    x, y = _at(a, level), _at(b, level)
    if not x or not y:
        return 0.0
    return (Counter(x) & Counter(y)).total() / max(len(x), len(y))


def edits(a: tuple, b: tuple) -> list[int]:
    """Indices of the branches of ``a``, at the common level, that ``b`` does not have: where an edit lies."""
    level = max(a[1], b[1])
    have = Counter(_at(b, level))
    out = []
    for i, x in enumerate(_at(a, level)):
        if have[x]:
            have[x] -= 1
        else:
            out.append(i)
    return out


def _trees(texts: list[str]) -> list[tuple]:
    found = []
    for _, _, data, offsets in pieces(pa.array(texts, pa.large_string())):
        found += trees(data, offsets)
    return found


COLUMNS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
RESULT = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
OUT = pa.schema([*RESULT, ("part", pa.int32()), ("edge", pa.string()), ("text", pa.string())])


def _compare(rows: list[tuple]) -> list[tuple]:
    """Results for (doc_id, text, tree, next text, next tree)."""
    edited = []
    for _, text, _, following, _ in rows:
        cut = len(text) // 3
        edited.append(text[: len(text) - cut] + following[:cut])
    out = []
    for (doc_id, text, tree, _, after), new, changed in zip(rows, edited, _trees(edited), strict=True):
        digest = hashlib.sha256(new.encode()).hexdigest()
        out.append((doc_id, len(text), digest, text_of(tree), text_of(changed), likeness(tree, changed), likeness(tree, after)))
    return out


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of one sorted range, all but its last row, and the two rows at its edges."""
    part = TaskContext.get().partitionId()
    held: list[tuple] = []
    opened = False

    def close(group):
        grown = [(doc_id, text, tree) for (doc_id, text), tree in zip(group, _trees([t for _, t in group]), strict=True)]
        chain = held + grown
        held[:] = chain[-1:]
        pairs = [(*a, *b[1:]) for a, b in zip(chain, chain[1:], strict=False)]
        return [(*x, part, None, None) for x in _compare(pairs)]

    group, size = [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
            group.append((doc_id.as_py(), text.as_py()))
            size += len(group[-1][1])
            if not opened:
                opened = True
                yield _batch([(group[0][0], *[None] * 6, part, "first", group[0][1])], OUT)
            if size > GROUP_BYTES:
                rows = close(group)
                group, size = [], 0
                if rows:
                    yield _batch(rows, OUT)
    if group:
        rows = close(group)
        if rows:
            yield _batch(rows, OUT)
    if held:
        yield _batch([(held[0][0], *[None] * 6, part, "last", held[0][1])], OUT)


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for doc_id, text, following in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            a, b = _trees([text, following])
            yield _batch(_compare([(doc_id, text, a, following, b)]), pa.schema(RESULT))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for each row.

    The edited text has its last third (code points, rounded down) replaced by the
    first as many, or all, of the next text in descending order of id; after the last
    comes the first again. Equal ids are ordered by a hash of their text, null ids come
    last. A null text is empty; the empty text is like itself only.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text).withColumn("tie", F.xxhash64("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    order = [F.desc_nulls_last("doc_id"), F.col("tie")]
    ranges = rows.repartitionByRange(max(1, math.ceil(total / RANGE_BYTES)), *order).sortWithinPartitions(*order)
    done = written(ranges.select("doc_id", "text").mapInArrow(_walk, COLUMNS + ", part int, edge string, text string"), "ranges", compression="zstd")
    ends = done.where("edge is not null")
    parts = sorted(r.part for r in ends.where("edge = 'first'").select("part").collect())
    turn = docs.sparkSession.createDataFrame(list(zip(parts, parts[1:] + parts[:1], strict=True)), "part int, after int")
    first = ends.where("edge = 'first'").select(F.col("part").alias("after"), F.col("text").alias("following"))
    last = ends.where("edge = 'last'").select("part", "doc_id", "text")
    joints = last.join(turn, "part").join(first, "after").select("doc_id", "text", "following").mapInArrow(_edges, COLUMNS)
    return done.where("edge is null").drop("part", "edge", "text").unionByName(joints)
