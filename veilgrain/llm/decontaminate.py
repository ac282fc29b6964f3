"""Passages of a benchmark inside documents, by spaced-seed hashing.

A mask of ones and zeros over a run of words selects those that are hashed and
ignores the others, so a substituted word only spoils the masks that select it
there. Hashes of all test items and of all documents meet in an equi-join; before
the shuffle, document hashes pass a Bloom filter of fixed size over the
test hashes (a false positive only costs a row). Every hit fixes a diagonal (position in the document less
position in the item). Along it the words are compared, substitutions allowed, and
the agreeing words of every stretch that is equal enough count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilgrain.llm.arrays import mix, pieces, word_hashes
from veilgrain.llm.sums import in_two_levels
from veilgrain.session import written

#: One of them fits every stretch of five agreeing words or more of which 70 % agree, whatever the places of the others.
#: That holds for 5 to 13 words, and a longer stretch has a part of 7 to 13 words with the same share.
MASKS = ("11101", "10111", "11011", "100111", "1101001", "1110001")
FILTER_BITS = 1 << 24
LEAST_WORDS = 5


def seeds(hashes: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(seed, first word) for every mask at every place where it fits in a row."""
    rows = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
    at = np.arange(len(hashes))
    room = firsts[1:][rows] - at
    found, place = [], []
    for code, mask in enumerate(MASKS, 1):
        start = at[room >= len(mask)]
        total = np.full(len(start), code, np.uint64)
        for k, on in enumerate(mask):
            if on == "1":
                total = mix(total * np.uint64(0x9E3779B97F4A7C15) + hashes[start + k])
        found.append(total)
        place.append(start)
    return np.concatenate(found), np.concatenate(place)


def _bits(seed: np.ndarray) -> list[np.ndarray]:
    """Four bit numbers of each seed."""
    out = []
    for k in range(4):
        seed = mix(seed + np.uint64(k + 1))
        out.append((seed % np.uint64(FILTER_BITS)).astype(np.int64))
    return out


ITEM_SQL = "item_id long, words binary, seeds array<struct<seed:long,at:int>>, bits binary"


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("seed", pa.int64()), ("at", pa.int32())]))
    for batch in batches:
        for first, last, data, offsets in pieces(batch.column(1)):
            hashes, firsts = word_hashes(data, offsets)
            words, lists, bits = [], [], []
            for a, b in zip(firsts, firsts[1:], strict=False):
                own = hashes[a:b]
                cut = np.array([0, len(own)])
                seed, at = seeds(own, cut)
                words.append(own.tobytes())
                lists.append([{"seed": s, "at": p} for s, p in zip(seed.view(np.int64).tolist(), at.tolist(), strict=True)])
                bits.append(np.unique(np.concatenate(_bits(seed)) if len(seed) else np.zeros(0, np.int64)).astype(np.int32).tobytes())
            columns = [batch.column(0).slice(first, last - first), pa.array(words, pa.binary()), pa.array(lists, kind), pa.array(bits, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["item_id", "words", "seeds", "bits"])


def _filter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The filter over one part of the items."""
    on = np.zeros(FILTER_BITS, bool)
    for batch in batches:
        for blob in batch.column(0).to_pylist():
            on[np.frombuffer(blob, np.int32)] = True
    yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([np.packbits(on).tobytes()], pa.binary())], ["k", "bits"])


def _either(table: pa.Table) -> pa.Table:
    parts = [np.frombuffer(x, np.uint8) for x in table["bits"].to_pylist()]
    return pa.table([table["k"][:1], pa.array([np.bitwise_or.reduce(parts).tobytes()], pa.binary())], names=["k", "bits"])


def _hits(bits):
    """Of each document the seeds that pass the filter, with the hashes of its words where any do."""
    kind = pa.list_(pa.struct([("seed", pa.int64()), ("at", pa.int32())]))
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("words", pa.binary()), ("seeds", kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on = np.unpackbits(np.frombuffer(bits.value, np.uint8)).astype(bool)
        for batch in batches:
            ids, keys, words, lists = [], [], [], []
            for first, _, data, offsets in pieces(batch.column(2), 1 << 20):
                hashes, firsts = word_hashes(data, offsets)
                seed, at = seeds(hashes, firsts)
                mixed = seed
                for k in range(4):
                    if not len(seed):
                        break
                    mixed = mix(mixed + np.uint64(k + 1))
                    pick = on[(mixed % np.uint64(FILTER_BITS)).astype(np.int64)]
                    seed, at, mixed = seed[pick], at[pick], mixed[pick]
                if not len(seed):
                    continue
                row = np.searchsorted(firsts, at, side="right") - 1
                for r in np.unique(row):
                    own = row == r
                    ids.append(batch.column(0)[first + int(r)].as_py())
                    keys.append(batch.column(1)[first + int(r)].as_py())
                    words.append(hashes[firsts[r] : firsts[r + 1]].tobytes())
                    local = (at[own] - firsts[r]).tolist()
                    lists.append([{"seed": s, "at": p} for s, p in zip(seed[own].view(np.int64).tolist(), local, strict=True)])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(words, pa.binary()), pa.array(lists, kind)], schema=schema)

    return run


FOUND_SQL = "doc_id long, text_key long, item_id long, item_key long, start int, end int, item_words int, hit binary"
FOUND = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("item_id", pa.int64()), ("item_key", pa.int64()), ("start", pa.int32()), ("end", pa.int32())] + [("item_words", pa.int32()), ("hit", pa.binary())])


def counted(same: np.ndarray, identity: float) -> np.ndarray:
    """The agreeing words that stand in a stretch with LEAST_WORDS of them or more and at least ``identity`` of its words."""
    agree = np.r_[0, np.cumsum(same)]
    score = agree - identity * np.arange(len(agree))
    top = np.maximum.accumulate(score[::-1])
    # the last end of an equal enough stretch from each start; it holds all shorter ones from there
    end = len(top) - 1 - np.searchsorted(top, score - 1e-9)
    start = np.flatnonzero(agree[end] - agree >= LEAST_WORDS)
    edges = np.zeros(len(agree), np.int64)
    edges[start] += 1
    np.subtract.at(edges, end[start], 1)
    return same & (np.cumsum(edges)[:-1] > 0)


def _verify(identity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, key, item_id, item_key, shift, window, item in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                window, item = np.frombuffer(window, np.uint64), np.frombuffer(item, np.uint64)
                a = max(0, -shift)
                b = a + len(window)
                hit = np.zeros(len(item), bool)
                hit[a:b] = counted(item[a:b] == window, identity)
                on = np.flatnonzero(hit)
                if len(on):
                    rows.append((doc_id, key, item_id, item_key, int(on[0]) + shift, int(on[-1]) + 1 + shift, len(item), np.packbits(hit).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t.type) for k, t in enumerate(FOUND)], schema=FOUND)

    return run


def _cover(table: pa.Table) -> pa.Table:
    """Several diagonals of one document and item, where words were put in or left out, count together."""
    best: dict[tuple, list] = {}
    for row in table.to_pylist():
        own = best.setdefault((row["doc_id"], row["text_key"], row["item_id"], row["item_key"]), [0, row["item_words"], None, None])
        own[0] |= int.from_bytes(row["hit"], "big")
        own[2] = row["start"] if own[2] is None else min(own[2], row["start"])
        own[3] = row["end"] if own[3] is None else max(own[3], row["end"])
    rows = [(*k[:3], a, b, n, x.bit_count()) for k, (x, n, a, b) in best.items()]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32())
    names = ("doc_id", "text_key", "item_id", "start", "end", "item_words", "matched")
    return pa.table([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)


def contaminated(
    docs: DataFrame,
    tests: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    identity: float = 0.7,
    share: float = 0.5,
    words: int = 13,
) -> DataFrame:
    """(doc_id, text_key, item_id, start, end, item_words, matched) for each document and item that overlap.

    Words are runs free of ASCII white space, A-Z lower-cased. A stretch without words put in or left out counts if
    five of its words or more, and at least ``identity`` of them, agree; from an identity of 0.7 up no such stretch is
    missed. All agreeing words of an item's stretches count together; the document is reported with the item if the agreeing words are at
    least ``share`` of the item's, or ``words`` of them. ``start`` and ``end`` are word positions in the document;
    ``text_key`` is xxhash64 of its text, which tells rows of one id apart (equal rows are reported once).
    Items of one id with different texts are different items (equal ones are one).
    Items of fewer than five words, null and empty texts match nothing.
    """
    spark = docs.sparkSession
    items = tests.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text"))
    items = written(items.where("text is not null").mapInArrow(_items, ITEM_SQL), "items")
    merged = in_two_levels(items.select("bits").mapInArrow(_filter, "k int, bits binary"), "k", _either, "k int, bits binary").collect()
    bits = merged[0].bits if merged else bytes(FILTER_BITS // 8)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).cast("string").alias("text"))
    hits = written(rows.mapInArrow(_hits(spark.sparkContext.broadcast(bits)), "doc_id long, text_key long, words binary, seeds array<struct<seed:long,at:int>>"), "hits")
    left = hits.select("doc_id", "text_key", F.inline("seeds"))
    items = items.withColumn("item_key", F.xxhash64("words"))
    size = (F.octet_length("words") / 8).cast("int").alias("n")
    right = items.select("item_id", "item_key", size, F.inline("seeds")).withColumnRenamed("at", "item_at")
    lines = left.join(right, "seed").select("doc_id", "text_key", "item_id", "item_key", "n", (F.col("at") - F.col("item_at")).alias("shift")).distinct()
    document = hits.select(F.col("doc_id").alias("d"), F.col("text_key").alias("t"), F.col("words").alias("document")).dropDuplicates(["d", "t"])
    pairs = lines.join(document, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("t")))
    # of a document only the words beside the item go on
    window = F.substring("document", 8 * F.greatest("shift", F.lit(0)) + 1, 8 * (F.col("n") + F.least("shift", F.lit(0))))
    pairs = pairs.select("doc_id", "text_key", "item_id", "item_key", "shift", window.alias("window"))
    known = items.select(F.col("item_id").alias("i"), F.col("item_key").alias("k"), F.col("words").alias("item")).dropDuplicates(["i", "k"])
    pairs = pairs.join(known, F.col("item_id").eqNullSafe(F.col("i")) & (F.col("item_key") == F.col("k")))
    checked = pairs.select("doc_id", "text_key", "item_id", "item_key", "shift", "window", "item").mapInArrow(_verify(identity), FOUND_SQL)
    columns = "doc_id long, text_key long, item_id long, start int, end int, item_words int, matched int"
    whole = checked.groupBy("doc_id", "text_key").applyInArrow(_cover, columns)
    return whole.where((F.col("matched") >= share * F.col("item_words")) | (F.col("matched") >= words)).where(f"matched >= {LEAST_WORDS}")
