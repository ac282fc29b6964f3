"""Text quality: random-indexing word vectors, pooled per document, and a small neural network.

Words are runs of letters, of digits (by length) or of other signs; they fall into
BUCKETS classes by hash. Every class has a sparse random index vector. A word's vector is
the sum of its neighbours' index vectors over the whole table (left and right ones
rotated differently), scaled, plus its own index vector. A document is the mean of
its words, with the norm of that mean, its length and how often words recur. A network of two layers is fitted with
numpy on a bounded sample of labelled rows, and a temperature on rows it has not seen.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilgrain.llm.arrays import BYTE_VALUES, mix, pieces, span_hash, sums
from veilgrain.llm.sums import in_two_levels
from veilgrain.session import written

BUCKETS, DIMS, NONZERO, BLOCK = 1 << 14, 32, 2, 1 << 10
SAMPLE = 20_000
HIDDEN, EPOCHS, RATE, BATCH = 32, 60, 3e-3, 256
FEATURES = DIMS + 5


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """(positions, signs) of the nonzero entries of each class."""
    seed = mix(np.arange(BUCKETS * NONZERO, dtype=np.uint64) + np.uint64(99991)).reshape(BUCKETS, NONZERO)
    return (seed % np.uint64(DIMS)).astype(np.int64), np.where((seed >> np.uint64(40)) & np.uint64(1), 1, -1).astype(np.int64)


_KIND = np.full(256, 3, np.int8)
_KIND[[32, 9, 10, 11, 12, 13]] = 0
_KIND[48:58] = 2
_KIND[65:91] = _KIND[97:123] = 1
_KIND[128:] = 1


def word_classes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class of each word of a piece and where each row's words begin (one more than rows)."""
    kind = _KIND[data]
    new = np.ones(len(data), bool)
    new[1:] = kind[1:] != kind[:-1]
    inner = offsets[1:-1]
    new[inner[inner < len(data)]] = True
    start = np.flatnonzero(new)
    end = np.r_[start[1:], len(data)]
    keep = kind[start] > 0
    start, end = start[keep], end[keep]
    digits = kind[start] == 2
    name = span_hash(sums(BYTE_VALUES[data]), start, end)
    name[digits] = mix((end - start)[digits].astype(np.uint64) + np.uint64(7))
    return (name % np.uint64(BUCKETS)).astype(np.int64), np.searchsorted(start, offsets)


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of neighbours' index vectors over one part of the table, in blocks of classes."""
    where, sign = index_vectors()
    total = np.zeros(BUCKETS * DIMS, np.int64)
    for batch in batches:
        for _, _, data, offsets in pieces(batch.column(0)):
            word, first = word_classes(data, offsets)
            if len(word) < 2:
                continue
            ends = np.zeros(len(word), bool)
            inner = first[1:]
            ends[inner[inner > 0] - 1] = True
            pair = np.flatnonzero(~ends[:-1])
            left, right = word[pair], word[pair + 1]
            for k in range(NONZERO):
                for me, other, turn in ((left, right, 0), (right, left, DIMS // 2)):
                    at = me * DIMS + (where[other, k] + turn) % DIMS
                    total += np.bincount(at, sign[other, k], minlength=len(total)).astype(np.int64)
    blocks = total.reshape(-1, BLOCK * DIMS)
    yield pa.RecordBatch.from_arrays([pa.array(range(len(blocks)), pa.int32()), pa.array([b.tobytes() for b in blocks], pa.binary())], ["block", "sums"])


def _add(table: pa.Table) -> pa.Table:
    parts = [np.frombuffer(x, np.int64) for x in table["sums"].to_pylist()]
    return pa.table([table["block"][:1], pa.array([np.sum(parts, axis=0).tobytes()], pa.binary())], names=["block", "sums"])


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """The vector of each class, from all texts; its size is fixed, whatever the input."""
    parts = docs.select(F.col(text_col).cast("string")).mapInArrow(_contexts, "block int, sums binary")
    summed = in_two_levels(parts, "block", _add, "block int, sums binary").collect()
    total = np.zeros((BUCKETS // BLOCK, BLOCK * DIMS), np.float64)
    for row in summed:
        total[row.block] = np.frombuffer(row.sums, np.int64)
    total = total.reshape(BUCKETS, DIMS)
    total /= np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1)
    where, sign = index_vectors()
    for k in range(NONZERO):
        np.add.at(total, (np.arange(BUCKETS), where[:, k]), sign[:, k])
    return total.astype(np.float32)


def features(vectors: np.ndarray, column: pa.Array) -> np.ndarray:
    """One row of FEATURES for each text; an empty text has zeros."""
    pooled = np.zeros((len(column), FEATURES), np.float32)
    for first, last, data, offsets in pieces(column, 1 << 19):
        word, cut = word_classes(data, offsets)
        count = np.diff(cut)
        full = np.flatnonzero(count)
        if not len(full):
            continue
        own = pooled[first:last]
        rows = np.repeat(np.arange(len(count)), count)
        n = count[full]
        own[full, :DIMS] = np.add.reduceat(vectors[word], cut[full], axis=0) / n[:, None]
        own[full, DIMS] = np.linalg.norm(own[full, :DIMS], axis=1)
        own[full, DIMS + 1] = np.log1p(n)
        pairs = np.unique(rows * BUCKETS + word)
        own[full, DIMS + 2] = np.bincount(pairs // BUCKETS, minlength=len(count))[full] / n
        own[full, DIMS + 3] = np.diff(offsets)[full] / n / 10
        again = np.zeros(len(word))
        again[1:] = (word[1:] == word[:-1]) & (rows[1:] == rows[:-1])
        own[full, DIMS + 4] = np.bincount(rows, again, minlength=len(count))[full] / n
    return pooled


def _pool(vectors: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = pa.array([x.tobytes() for x in features(vectors, batch.column(1))], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), blobs], ["doc_id", "features"])

    return run


class Network:
    """Two layers, fitted by Adam on the logistic loss; scores are calibrated by one temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, late: np.ndarray):
        self.prior = float((y.sum() + 1) / (len(y) + 2))
        self.weights = None
        early = ~late
        if len(np.unique(y[early])) < 2:
            return
        rng = np.random.default_rng(0)
        self.mean, self.scale = x[early].mean(axis=0), x[early].std(axis=0) + 1e-6
        z = ((x - self.mean) / self.scale).astype(np.float64)
        w = [rng.normal(0, np.sqrt(2 / FEATURES), (FEATURES, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(1 / HIDDEN), HIDDEN), np.zeros(1)]
        first, second = [np.zeros_like(v) for v in w], [np.zeros_like(v) for v in w]
        own, target = z[early], y[early].astype(np.float64)
        step = 0
        for _ in range(EPOCHS):
            for part in np.array_split(rng.permutation(len(own)), max(1, len(own) // BATCH)):
                a, t = own[part], target[part]
                h = np.maximum(a @ w[0] + w[1], 0)
                d = (1 / (1 + np.exp(-np.clip(h @ w[2] + w[3], -30, 30))) - t) / len(part)
                back = np.outer(d, w[2]) * (h > 0)
                step += 1
                for i, g in enumerate((a.T @ back + 1e-4 * w[0], back.sum(axis=0), h.T @ d + 1e-4 * w[2], d.sum(keepdims=True))):
                    first[i] = 0.9 * first[i] + 0.1 * g
                    second[i] = 0.999 * second[i] + 0.001 * g * g
                    w[i] = w[i] - RATE * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
        self.weights = w
        self.temperature = 1.0
        if late.any():
            logits, t = self.logits(x[late]), y[late]
            grid = np.geomspace(0.25, 8, 61)
            loss = [np.logaddexp(0, np.where(t > 0, -logits, logits) / k).mean() for k in grid]
            self.temperature = float(grid[int(np.argmin(loss))])

    def logits(self, x: np.ndarray) -> np.ndarray:
        w = self.weights
        return np.maximum(((x - self.mean) / self.scale) @ w[0] + w[1], 0) @ w[2] + w[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def _score(network: Network):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.float32).reshape(-1, FEATURES)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(network.score(x))], ["doc_id", "score"])

    return run


def fold(id_col) -> F.Column:
    """Remainder by 3 of the CRC of an id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 3


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row; the score is the calibrated probability of label 1.

    Labels are used of rows whose fold is not 1, at most ``sample`` of them by least
    hash of the id; a fifth of these sets the temperature. Word vectors come from all texts. A null text is
    empty and has a score too. Null labels are ignored; a label joins every row of its id. Without labels
    of both values the score is their share.
    """
    _, network, pooled = fit(docs, labels, id_col, text_col, label_col, sample)
    scored = pooled.mapInArrow(_score(network), "doc_id long, score double")
    return scored.select("doc_id", (fold(F.col("doc_id")) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample: int) -> tuple[np.ndarray, Network, DataFrame]:
    """(word vectors, network, features of all rows)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    vectors = word_vectors(rows)
    pooled = written(rows.mapInArrow(_pool(vectors), "doc_id long, features binary"), "pooled")
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    known = known.where("label is not null and doc_id is not null").where(fold(F.col("doc_id")) != 1)
    taken = pooled.join(known, "doc_id").withColumn("at", F.xxhash64("doc_id")).orderBy("at", "features", "label").limit(sample).collect()
    x = np.frombuffer(b"".join(r.features for r in taken), np.float32).reshape(-1, FEATURES)
    y = np.array([r.label for r in taken], np.int64)
    late = np.array([r.at % 5 == 0 for r in taken], bool)
    return vectors, Network(x, y, late), pooled


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is at least ``threshold``; fitted as in score_quality, no shuffle of texts."""
    vectors, network, _ = fit(docs, labels, id_col, text_col, label_col, sample)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(network.score(features(vectors, batch.column(at))) >= threshold))

    return docs.mapInArrow(run, docs.schema)
