"""Packing of documents into sequences of several permitted lengths.

Texts longer than the largest capacity are cut into pieces of it; what is left over is
a piece too. Pieces are dealt by hash into groups of bounded size. In a group they go, longest first,
into the open bin with the least room that holds them. Where none does, a bin is
opened; which size is opened decides the cost, so the group is packed for every mix of
opening rules (for short and for long pieces) and the mix of least total cost is kept.
At the end every bin shrinks to the smallest permitted length that holds its contents.
The cost of a bin is its length plus a fixed overhead.
"""

from __future__ import annotations

import itertools
import math
import re
from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilgrain.session import written

CAPACITIES = (512, 1024, 2048, 4096)
OVERHEAD = 16
GROUP_ROWS = 20_000
BATCH_CHARS = 1 << 21


def best_fit(sizes: Sequence[int], opening: Sequence[int], capacities: Sequence[int] = CAPACITIES, overhead: int = OVERHEAD) -> tuple[list[int], list[int], int]:
    """(bin of each piece, final length of each bin, cost); sizes descend.

    ``opening[k]`` is the length opened for a piece whose smallest fitting length is capacities[k].
    """
    rooms: list[tuple[int, int]] = []
    used: list[int] = []
    where = []
    for size in sizes:
        at = bisect_left(rooms, (size, -1))
        if at < len(rooms):
            room, number = rooms.pop(at)
        else:
            room, number = opening[bisect_left(capacities, size)], len(used)
            used.append(0)
        used[number] += size
        where.append(number)
        if room > size:
            insort(rooms, (room - size, number))
    final = [capacities[bisect_left(capacities, x)] for x in used]
    return where, final, sum(final) + overhead * len(final)


def openings(capacities: Sequence[int]) -> Iterator[tuple[int, ...]]:
    """Every choice of one length at least as large for each smallest fitting length, not falling as pieces grow."""
    for choice in itertools.combinations_with_replacement(capacities, len(capacities)):
        if all(a >= b for a, b in zip(choice, capacities, strict=True)):
            yield choice


def pack(sizes: Sequence[int], capacities: Sequence[int] = CAPACITIES, overhead: int = OVERHEAD) -> tuple[list[int], list[int], int]:
    """The packing of least cost over all openings; the first of equals."""
    return min((best_fit(sizes, o, capacities, overhead) for o in openings(capacities)), key=lambda x: x[2])


OUT_SQL = "bin string, capacity int, used int, slot int, offset int, doc_id long, text_key long, first_word int, n_words int"


def _group(capacities: Sequence[int], overhead: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("n_words", "descending"), ("doc_id", "ascending"), ("text_key", "ascending"), ("first_word", "ascending")])
        group = table["part"][0].as_py()
        sizes = table["n_words"].to_pylist()
        where, final, _ = pack(sizes, capacities, overhead)
        used, slots = [0] * len(final), [0] * len(final)
        offset, slot = [], []
        for number, size in zip(where, sizes, strict=True):
            offset.append(used[number])
            slot.append(slots[number])
            used[number] += size
            slots[number] += 1
        columns = {
            "bin": pa.array([f"{group}-{b}" for b in where], pa.string()),
            "capacity": pa.array([final[b] for b in where], pa.int32()),
            "used": pa.array([used[b] for b in where], pa.int32()),
            "slot": pa.array(slot, pa.int32()),
            "offset": pa.array(offset, pa.int32()),
        }
        for name, kind in (("doc_id", pa.int64()), ("text_key", pa.int64()), ("first_word", pa.int32()), ("n_words", pa.int32())):
            columns[name] = table[name].cast(kind)
        return pa.table(columns)

    return run


def pack_documents(docs: DataFrame, capacities: Sequence[int] = CAPACITIES, overhead: int = OVERHEAD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: its bin, the bin's length and contents, its place in the bin, and its words in the document.

    Lengths count words, runs free of ASCII white space. ``used`` never exceeds ``capacity``, one of ``capacities``; pieces of a bin
    have successive slots and offsets. A null or blank text has no pieces. Repeated rows are
    packed each. Ties are packed in order of id and text hash. Every group holds about GROUP_ROWS pieces.
    """
    capacities = tuple(sorted(capacities))
    largest = capacities[-1]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).alias("words")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), words).where("words > 0")
    rows = written(rows, "lengths")
    starts = F.sequence(F.lit(0), F.col("words") - 1, F.lit(largest))
    cut = rows.withColumn("first_word", F.explode(starts)).withColumn("n_words", F.least(F.lit(largest), F.col("words") - F.col("first_word")))
    pieces = rows.agg(F.sum(F.ceil(F.col("words") / largest))).first()[0] or 0
    groups = max(1, math.ceil(pieces / GROUP_ROWS))
    salt = F.monotonically_increasing_id()
    part = F.pmod(F.xxhash64("doc_id", "first_word", "text_key", salt), F.lit(groups)).cast("int")
    return cut.withColumn("part", part).groupBy("part").applyInArrow(_group(capacities, overhead), OUT_SQL)


_WORD = re.compile(r"[^\x20\x09-\x0D]+")
PART_SQL = "bin string, capacity int, used int, slot int, doc_id long, text string"


def _cut(spacing: bool):
    """The pieces of each document as texts."""
    schema = pa.schema([("bin", pa.string()), ("capacity", pa.int32()), ("used", pa.int32()), ("slot", pa.int32()), ("doc_id", pa.int64()), ("text", pa.string())])

    def part(text: str, words: list[re.Match], first: int, after: int) -> str:
        if not spacing:
            return " ".join(m[0] for m in words[first:after])
        return text[words[first].start() if first else 0 : words[after].start() if after < len(words) else len(text)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for doc_id, value, pieces in zip(*batch.columns, strict=True):
                text = value.as_py()
                words = list(_WORD.finditer(text))
                for p in pieces.as_py():
                    own = part(text, words, p["first_word"], p["first_word"] + p["n_words"])
                    rows.append((p["bin"], p["capacity"], p["used"], p["slot"], doc_id.as_py(), own))
                    size += len(own)
                if size > BATCH_CHARS:
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t.type) for k, t in enumerate(schema)], schema=schema)
                    rows, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t.type) for k, t in enumerate(schema)], schema=schema)

    return run


def sequences(placed: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", spacing: bool = False) -> DataFrame:
    """(bin, capacity, used, doc_ids, text): the packed sequences, pieces in order and joined by a newline.

    Words of a piece are joined by single spaces; with ``spacing`` a piece is the document's own text up to the
    next piece's first word, white space included, so the pieces of a document put together are the document.
    Texts are shuffled once to their places and once to their bins; a bin is bounded by its length.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("d"), F.xxhash64(text).alias("k"), text.alias("text"))
    places = placed.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("bin", "capacity", "used", "slot", "first_word", "n_words")).alias("pieces"))
    match = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("k"))
    parts = rows.join(places.hint("shuffle_hash"), match).select("doc_id", "text", "pieces").mapInArrow(_cut(spacing), PART_SQL)
    # equal rows bring the same pieces twice; a slot is one place
    bins = parts.groupBy("bin", "capacity", "used").agg(F.sort_array(F.collect_set(F.struct("slot", "doc_id", "text"))).alias("p"))
    return bins.select("bin", "capacity", "used", F.col("p.doc_id").alias("doc_ids"), F.array_join("p.text", "\n").alias("text"))
