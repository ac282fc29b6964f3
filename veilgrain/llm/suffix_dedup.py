"""Removal of byte strings that occur more than once, by blockwise suffix sorting.

1. The window of ``length`` bytes at each position is named after its anchor, the
   leftmost K-byte string of least hash inside it. Equal windows have equal anchors,
   at the same distance. One anchor stands for a run of windows. Anchors that occur
   once in the whole table cannot belong to a repeated string and end here.
2. The other anchors, with the bytes their windows cover, are the suffix buckets: the
   suffixes that can share ``length`` bytes are in one bucket. Equal pieces of text
   are reduced to one before the shuffle and again in the bucket.
3. A task takes one pack of buckets at a time. The suffixes at the positions of a
   difference cover modulo V are ranked by doubling. All window starts are then
   sorted by their first bytes; long ties are resolved by the ranks at the shift
   that puts both suffixes on the cover, in a three-way quicksort over all tied
   groups at once. Memory is that of one pack.
4. Neighbours in this order that agree in ``length`` bytes are repeated.

Buckets beyond TILE_BYTES are dealt as pairs of tiles, so that any two pieces still
meet. Copies of a whole text are one text until the end.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilgrain.llm.arrays import BYTE_VALUES, pieces, span_hash, sums
from veilgrain.llm.ngram_join import packed
from veilgrain.session import written

K = 48
TILE_BYTES = 2 << 20
BUCKET_BYTES = 4 << 20
ANCHOR_BYTES = 20
CHUNK = 8 << 20
#: A perfect difference set: every residue modulo V is a difference of two of its members.
V, COVER = 31, (1, 5, 11, 24, 25, 27)
_ON = np.isin(np.arange(V), COVER)
_SHIFT = np.array([[next(d for d in range(V) if _ON[(a + d) % V] and _ON[(b + d) % V]) for b in range(V)] for a in range(V)])


def anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(anchor hash, first window, last window, joined, hash of the bytes) of runs of windows inside rows.

    Neighbouring runs whose anchors are equal are joined to one: in periodic text
    they would be many, all alike. Only in a joined run can windows repeat each other.
    """
    sizes = np.diff(offsets)
    long = np.flatnonzero(sizes >= length)
    none = np.zeros(0, np.int64)
    if not len(long):
        return np.zeros(0, np.uint64), none, none, none, none
    edge = np.zeros(len(data) + 1, np.int8)
    np.add.at(edge, offsets[:-1][long], 1)
    np.add.at(edge, offsets[1:][long] - length + 1, -1)
    at = np.flatnonzero(np.cumsum(edge[:-1], dtype=np.int8))
    first = np.arange(len(data) - K + 1)
    running = sums(BYTE_VALUES[data])
    hashes = span_hash(running, first, first + K)
    least = (hashes & ~np.uint64(0xFFFFFF)) | first.astype(np.uint64)
    width, size = length - K + 1, 1
    while 2 * size <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < width:
        least = np.minimum(least[: len(least) - (width - size)], least[width - size :])
    spot = (least[at] & np.uint64(0xFFFFFF)).astype(np.int64)
    new = np.ones(len(at), bool)
    new[1:] = (spot[1:] != spot[:-1]) | (at[1:] != at[:-1] + 1)
    begin = np.flatnonzero(new)
    name = hashes[spot[begin]]
    apart = np.ones(len(begin), bool)
    apart[1:] = (name[1:] != name[:-1]) | (at[begin[1:]] != at[begin[1:] - 1] + 1)
    lead = np.flatnonzero(apart)
    begin, joined = begin[lead], np.diff(np.r_[lead, len(apart)]) > 1
    start, stop = at[begin], at[np.r_[begin[1:], len(at)] - 1]
    return name[lead], start, stop, joined, span_hash(running, start, stop + length)


SENT_SQL = "bucket int, hashes binary, nodes binary, runs binary, starts binary, tails binary, looks binary"
SENT = pa.schema([("bucket", pa.int32()), *((x, pa.binary()) for x in ("hashes", "nodes", "runs", "starts", "tails", "looks"))])


def _chunks(batch: pa.RecordBatch, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """(nodes, bytes, offsets, where the first row begins in its text); a very long text comes in parts."""
    nodes = batch.column(0).to_numpy()
    for first, last, data, offsets in pieces(batch.column(1)):
        if len(data) <= 2 * CHUNK:
            yield nodes[first:last], data, offsets, 0
        else:
            for c in range(0, len(data), CHUNK):
                part = data[c : c + CHUNK + length - 1]
                yield nodes[first:last], part, np.array([0, len(part)]), c


def _send(length: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for nodes, data, offsets, base in _chunks(batch, length):
                hashes, start, stop, joined, look = anchors(data, offsets, length)
                if not len(hashes):
                    continue
                row = np.searchsorted(offsets, start, side="right") - 1
                local = (start - offsets[row] + base).astype(np.uint32)
                tails = (stop - start).astype(np.uint32) | (joined.astype(np.uint32) << np.uint32(31))
                look = (look >> np.uint64(32)).astype(np.uint32)
                to = (((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int32)
                order = np.lexsort((row, to))
                hashes, row, local, tails, look, to = (x[order] for x in (hashes, row, local, tails, look, to))
                new = np.ones(len(to), bool)
                new[1:] = (to[1:] != to[:-1]) | (row[1:] != row[:-1])
                run_at = np.flatnonzero(new)
                head = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
                cuts, run_cuts = np.r_[head, len(to)], np.r_[np.searchsorted(run_at, head), len(run_at)]
                lengths = np.diff(np.r_[run_at, len(to)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(to[head]), packed(hashes, cuts), packed(nodes[row[run_at]], run_cuts), packed(lengths, run_cuts)]
                    + [packed(local, cuts), packed(tails, cuts), packed(look, cuts)],
                    schema=SENT,
                )

    return run


def _groups_of(*keys: np.ndarray) -> np.ndarray:
    """True where a sorted sequence of keys begins a new value."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


MET_SQL = "node long, hash long, start long, tail int, joined boolean, tiles int"
MET = pa.schema([("node", pa.int64()), ("hash", pa.int64()), ("start", pa.int64()), ("tail", pa.int32()), ("joined", pa.bool_()), ("tiles", pa.int32())])


def _joined(column: pa.ChunkedArray, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _meet(length: int):
    def run(table: pa.Table) -> pa.Table:
        """Runs of windows whose anchor occurs at two places or more."""
        hashes, look = _joined(table["hashes"], np.uint64), _joined(table["looks"], np.uint32)
        start, tail = _joined(table["starts"], np.uint32), _joined(table["tails"], np.uint32)
        node = np.repeat(_joined(table["nodes"], np.int64), _joined(table["runs"], np.int32))
        order = np.lexsort((start, node, look, hashes))
        hashes, look, start, tail, node = (x[order] for x in (hashes, look, start, tail, node))
        keep = _groups_of(hashes, look, node, start)
        hashes, look, start, tail, node = (x[keep] for x in (hashes, look, start, tail, node))
        at = np.flatnonzero(_groups_of(hashes))
        size = np.diff(np.r_[at, len(hashes)])
        joined, tail = (tail >> np.uint32(31)) > 0, (tail & np.uint32(0x7FFFFFFF)).astype(np.int64)
        covered = np.add.reduceat(np.where(_groups_of(hashes, look), tail + length, 0), at) if len(at) else at
        tiles = np.repeat(-(-covered // TILE_BYTES), size)
        many = np.repeat((size > 1) | (np.add.reduceat(joined, at) > 0 if len(at) else size > 1), size)
        columns = (node, hashes.view(np.int64), start.astype(np.int64), tail.astype(np.int32), joined, tiles.astype(np.int32))
        return pa.table([pa.array(x[many]) for x in columns], schema=MET)

    return run


CUT_SQL = "hash long, i int, j int, joined boolean, bytes binary, nodes binary, starts binary"
CUT = pa.schema([("hash", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("joined", pa.bool_()), ("bytes", pa.binary()), ("nodes", pa.binary()), ("starts", pa.binary())])

CUT_FIELDS = ("hash", "start", "tail", "joined", "tiles")


def _cut(length: int):
    """The bytes under each run of windows; equal ones within a few megabytes travel once."""

    def flush(held: dict) -> pa.RecordBatch:
        rows = []
        for (key, tiles, joined, text), places in held.items():
            own = zlib.crc32(text) % tiles
            nodes, starts = (np.array(x, np.int64).tobytes() for x in zip(*places, strict=True))
            rows += [(key, min(own, other), max(own, other), joined, text, nodes, starts) for other in range(tiles)]
        return pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows, strict=True), CUT, strict=True)], schema=CUT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = {}, 0
        for batch in batches:
            for row in range(batch.num_rows):
                node, text = batch.column(0)[row].as_py(), batch.column(1)[row].as_py()
                text = text.encode() if isinstance(text, str) else text
                found = batch.column(2)[row].values
                for key, start, tail, joined, tiles in zip(*(found.field(x).to_pylist() for x in CUT_FIELDS), strict=True):
                    part = text[start : start + tail + length]
                    held.setdefault((key, tiles, joined, part), []).append((node, start))
                    size += len(part)
                    if size > TILE_BYTES:
                        yield flush(held)
                        held, size = {}, 0
        if held:
            yield flush(held)

    return run


def repeated_windows(text: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Which of the windows of ``length`` bytes at the given positions equal another of them."""
    size = len(text) + 4 * V + 8
    padded = np.zeros(size + length + 512, np.uint64)
    padded[: len(text)] = text
    word = padded[: size + length].copy()
    for k in range(1, 8):
        word = (word << np.uint64(8)) | padded[k : k + size + length]
    first = [8 * k for k in range(-(-V // 8))]

    cover = np.flatnonzero(_ON[np.arange(size) % V])
    order = np.lexsort([word[cover + k] for k in reversed(first)])
    rank = np.zeros(size + length + 512, np.int64)
    rank[cover[order]] = np.cumsum(_groups_of(*(word[cover[order] + k] for k in first)))
    shift = V
    while shift < length:
        key = (rank[cover] << 32) | rank[cover + shift]
        order = np.argsort(key, kind="stable")
        rank[cover[order]] = np.cumsum(_groups_of(key[order]))
        shift *= 2

    seq = at[np.lexsort([word[at + k] for k in reversed(first)])]
    group = np.cumsum(_groups_of(*(word[seq + k] for k in first)))
    tied = np.flatnonzero(np.bincount(group, minlength=group[-1] + 1)[group] > 1)
    group = group[tied]
    while len(tied):
        own = seq[tied]
        new = _groups_of(group)
        pivot = own[np.flatnonzero(new)[np.cumsum(new) - 1]]
        step = _SHIFT[own % V, pivot % V]
        side = np.sign(rank[own + step] - rank[pivot + step])
        order = np.lexsort((side, group))
        seq[tied], side, group = own[order], side[order], group[order]
        group = np.cumsum(_groups_of(group, side))
        open_ = (side != 0) & (np.bincount(group, minlength=group[-1] + 1)[group] > 1)
        tied, group = tied[open_], group[open_]

    near = np.flatnonzero(word[seq[1:]] == word[seq[:-1]])
    for k in [*range(8, length - 7, 8), length - 8]:
        near = near[word[seq[near + 1] + k] == word[seq[near] + k]]
    hit = np.zeros(len(seq), bool)
    hit[near] = hit[near + 1] = True
    out = np.zeros(size + length, bool)
    out[seq[hit]] = True
    return out[at]


def _sort_pack(length: int):
    def run(table: pa.Table) -> pa.Table:
        """(node, start, end) of byte ranges covered by repeated windows."""
        buckets: dict[tuple, dict[bytes, set]] = {}
        inner = set()
        columns = [table[c].to_pylist() for c in ("hash", "i", "j", "joined", "bytes", "nodes", "starts")]
        for key, i, j, joined, part, nodes, starts in zip(*columns, strict=True):
            places = zip(np.frombuffer(nodes, np.int64).tolist(), np.frombuffer(starts, np.int64).tolist(), strict=True)
            buckets.setdefault((key, i, j), {}).setdefault(part, set()).update(places)
            if joined:
                inner.add((key, i, j))
        del columns
        found = [(node, start, start + len(part)) for parts in buckets.values() for part, places in parts.items() if len(places) > 1 for node, start in places]
        joint: list[tuple[bytes, set]] = []
        for key, parts in buckets.items():
            if len(parts) < 2 and key not in inner:
                continue
            if key[1] == key[2] == 0:
                joint += parts.items()
            else:
                found += _sorted(list(parts.items()), length)
        if joint:
            found += _sorted(joint, length)
        node, start, end = _merged(np.array(found, np.int64).reshape(-1, 3).T)
        return pa.table({"node": node, "start": start, "end": end})

    return run


def _merged(ranges: np.ndarray) -> tuple[np.ndarray, ...]:
    """The same bytes of each node as ranges that do not touch."""
    node, start, end = ranges[:, np.lexsort((ranges[1], ranges[0]))]
    fresh = _groups_of(node)
    base = np.cumsum(fresh) * (1 << 40)
    top = np.maximum.accumulate(end + base) - base
    fresh[1:] |= start[1:] > top[:-1]
    at = np.flatnonzero(fresh)
    return node[at], start[at], top[np.r_[at[1:], len(fresh)][: len(at)] - 1]


def _sorted(parts: list[tuple[bytes, set]], length: int) -> Iterator[tuple[int, int, int]]:
    text = np.frombuffer(b"".join(x for x, _ in parts), np.uint8)
    sizes = np.array([len(x) for x, _ in parts])
    begin = np.cumsum(sizes) - sizes
    windows = sizes - length + 1
    owner = np.repeat(np.arange(len(parts)), windows)
    at = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows) + begin[owner]
    hit = np.flatnonzero(repeated_windows(text, at, length))
    if not len(hit):
        return
    new = np.r_[True, (owner[hit[1:]] != owner[hit[:-1]]) | (at[hit[1:]] - at[hit[:-1]] > length)]
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(hit)] - 1
    for a, b in zip(hit[first].tolist(), hit[last].tolist(), strict=True):
        o = owner[a]
        for node, start in parts[o][1]:
            yield node, int(start + at[a] - begin[o]), int(start + at[b] - begin[o] + length)


OUT_SQL = "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary"
OUT = pa.schema(
    [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64())]
    + [("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())]
)


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        size = 0
        for doc_id, text, whole, starts, ends in zip(*(batch.column(k) for k in range(5)), strict=True):
            text = (text.as_py() or "").encode()
            runs: list[dict] = []
            if whole.as_py():
                runs = [{"start": 0, "end": len(text)}]
            elif starts.is_valid:
                for a, b in sorted(zip(starts.as_py(), ends.as_py(), strict=True)):
                    if runs and a <= runs[-1]["end"]:
                        runs[-1]["end"] = max(runs[-1]["end"], b)
                    else:
                        runs.append({"start": a, "end": b})
            kept, at = [], 0
            for r in runs:
                kept.append(text[at : r["start"]])
                at = r["end"]
            kept.append(text[at:])
            rows.append((doc_id.as_py(), len(text), sum(r["end"] - r["start"] for r in runs), runs, b"".join(kept)))
            size += len(text)
            if size > TILE_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows, strict=True), OUT, strict=True)], schema=OUT)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows, strict=True), OUT, strict=True)], schema=OUT)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200) -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans, kept) for each row.

    A byte goes if a string of ``length`` bytes (64 to 32,000) that covers it also starts anywhere
    else, in the same text or another; overlaps count, and all is judged on the input.
    Texts are UTF-8; a null text is empty; a text shorter than ``length`` stays whole.
    ``spans`` are the maximal removed runs in byte offsets, ``kept`` the other bytes.
    Repeated rows count as separate texts; ids may be null or repeated and are passed on.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumns({"node": F.xxhash64("text"), "second": F.xxhash64(F.lit(17), F.col("text")), "size": F.octet_length("text")})
    texts = rows.where(F.col("size") >= length)
    nodes = texts.groupBy("node", "size", "second").agg(F.count("*").alias("copies"), F.min("doc_id").alias("rep"))
    nodes = written(nodes, "nodes")
    total = nodes.agg(F.sum(F.col("size") * F.col("copies"))).first()[0] or 0
    buckets = max(1, math.ceil(total * 2 / (length - K + 2) * ANCHOR_BYTES / BUCKET_BYTES))
    sent = rows.where(F.col("size") >= length).select("node", "text").mapInArrow(_send(length, buckets), SENT_SQL)
    met = written(sent.groupBy("bucket").applyInArrow(_meet(length), MET_SQL), "met")
    packs = max(1, math.ceil(((met.agg(F.sum((F.col("tail") + length) * F.col("tiles"))).first()[0]) or 0) / TILE_BYTES))
    wanted = met.groupBy("node").agg(F.collect_list(F.struct("hash", "start", "tail", "joined", "tiles")).alias("found"))
    wanted = wanted.join(nodes.select("node", "rep"), "node")
    match = F.col("doc_id").eqNullSafe(F.col("rep")) & (F.col("node") == F.col("key"))
    chosen = rows.where(F.col("size") >= length).join(wanted.withColumnRenamed("node", "key").hint("shuffle_hash"), match)
    cut = chosen.select("node", "text", "found").mapInArrow(_cut(length), CUT_SQL)
    pack = F.pmod(F.xxhash64("hash", "i", "j"), F.lit(packs)).cast("int")
    spans = cut.withColumn("pack", pack).groupBy("pack").applyInArrow(_sort_pack(length), "node long, start long, end long")
    spans = spans.groupBy("node").agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends"))
    verdict = nodes.join(spans, "node", "left").select(
        "node", "second", (F.col("copies") > 1).alias("whole"), F.when(F.col("copies") == 1, F.col("starts")).alias("starts"), "ends"
    ).where("whole or starts is not null")
    verdict = written(verdict, "verdict")
    full = rows.join(verdict.hint("shuffle_hash"), ["node", "second"], "left")
    whole = F.coalesce(F.col("whole"), F.lit(False)).alias("whole")
    return full.select("doc_id", "text", whole, "starts", "ends").mapInArrow(_remove, OUT_SQL)
