"""Box geometry per image. Pairs are found on a spatial grid, never image-wide."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_, or_

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilgrain import constants as K
from veilgrain.functions import boxes as B
from veilgrain.functions import ranks as R
from veilgrain.session import written

CELL = 256
CALM = 128


def split_crowded(
    *tables: DataFrame, known: tuple[str, ...] = (), unique: str | None = None, share: int = 1
) -> tuple[list[DataFrame], list[DataFrame] | None]:
    """(rows of calm images, the other rows or None) of each table.

    In a calm image no table has more than ``CALM`` rows, so its rows may meet each
    other directly: one shuffle by image, without grid cells, and what follows by image
    needs no other. Crowded images, and rows without an image, keep the grid, which
    spreads them; so do images with a null in one of the ``known`` columns, or where
    ``unique`` repeats or is null. The list of those is written once; Spark picks the join by its size.
    Where ``share`` pictures go by one image, it may have as many times the rows.
    """
    lacking = F.count_if(reduce(or_, (F.col(c).isNull() for c in known), F.lit(False)))
    if unique:
        # hashes are shorter to send; one that two ids share only takes an image the other way
        own = F.when(F.col(unique).isNotNull(), F.xxhash64(unique))
        lacking = lacking + F.count("*") - F.count_distinct(own)
    sizes = (F.count("*").alias("n"), lacking.alias("lacking"))
    counts = reduce(DataFrame.unionByName, (t.groupBy("image_id").agg(*sizes) for t in tables))
    crowded = counts.filter((F.col("n") > CALM * share) | (F.col("lacking") > 0) | F.col("image_id").isNull())
    crowded = written(crowded.select(F.col("image_id").alias("_crowded")).distinct(), "crowded")
    if crowded.isEmpty():
        return list(tables), None
    of = F.col("image_id").eqNullSafe(F.col("_crowded"))
    return [t.join(crowded, of, "left_anti") for t in tables], [t.join(crowded, of, "left_semi") for t in tables]


def met_in_image(a: DataFrame, b: DataFrame, condition: Column, how: str = "inner") -> DataFrame:
    """Rows of calm images that meet: ``a_*`` and ``b_*`` columns, ``image_id`` from ``a``."""
    left = a.select("image_id", *[F.col(c).alias(f"a_{c}") for c in a.columns if c != "image_id"])
    right = b.select(F.col("image_id").alias("_image"), *[F.col(c).alias(f"b_{c}") for c in b.columns if c != "image_id"])
    return left.join(right, (F.col("image_id") == F.col("_image")) & condition, how).drop("_image")


def _cells(low: Column, high: Column, cell: int) -> Column:
    return F.explode(F.sequence(F.floor(low / cell), F.floor(high / cell)))


def overlap_pairs(a: DataFrame, b: DataFrame, cell: int = CELL, touching: bool = False) -> DataFrame:
    """Pairs of boxes of one image that overlap, each exactly once.

    Columns of ``a`` come back as ``a_*``, of ``b`` as ``b_*``. The boxes of calm
    images meet directly, those of crowded ones on a grid.
    """
    (a, b), crowded = split_crowded(a, b)
    pairs = met_in_image(a, b, overlapping(touching))
    return pairs if crowded is None else pairs.unionByName(grid_pairs(*crowded, cell, touching))


def overlapping(touching: bool = False) -> Column:
    """Whether ``a_*`` and ``b_*`` overlap; a box with an unknown place overlaps nothing."""
    (ax, ay, aw, ah), (bx, by, bw, bh) = B.box("a_"), B.box("b_")
    spans = ((ax, aw, bx, bw), (ay, ah, by, bh))
    if touching:
        return reduce(and_, ((p <= q + m) & (q <= p + n) & (n >= 0) & (m >= 0) for p, n, q, m in spans))
    return reduce(and_, ((p < q + m) & (q < p + n) & (n > 0) & (m > 0) for p, n, q, m in spans))


def grid_pairs(a: DataFrame, b: DataFrame, cell: int = CELL, touching: bool = False) -> DataFrame:
    """``overlap_pairs`` for images of any size.

    Boxes are put into the grid cells they cover and joined on (image, cell); a pair counts
    only in the cell that holds the corner of its intersection, so no distinct
    is needed, and an image with very many boxes is spread over its cells.
    """

    def gridded(df: DataFrame, p: str) -> DataFrame:
        cols = [F.col(c).alias(f"{p}{c}") for c in df.columns if c != "image_id"]
        placed = df.withColumn("_cx", _cells(F.col("x"), F.col("x") + F.col("w"), cell))
        placed = placed.withColumn("_cy", _cells(F.col("y"), F.col("y") + F.col("h"), cell))
        return placed.select("image_id", "_cx", "_cy", *cols)

    left = F.greatest("a_x", "b_x")
    top = F.greatest("a_y", "b_y")
    right = F.least(F.col("a_x") + F.col("a_w"), F.col("b_x") + F.col("b_w"))
    bottom = F.least(F.col("a_y") + F.col("a_h"), F.col("b_y") + F.col("b_h"))
    meets = (right >= left) & (bottom >= top) if touching else (right > left) & (bottom > top)
    home = (F.floor(left / cell) == F.col("_cx")) & (F.floor(top / cell) == F.col("_cy"))
    pairs = gridded(a, "a_").join(gridded(b, "b_"), ["image_id", "_cx", "_cy"])
    return pairs.filter(meets & home).drop("_cx", "_cy")


def with_iou(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("iou", B.iou(B.box("a_"), B.box("b_")))


def sanitise_boxes(df: DataFrame, vp_w: int = 1920, vp_h: int = 1080) -> DataFrame:
    """Reject malformed boxes, clamp the rest to the viewport, round half up."""
    x, y, w, h = (F.col(c).cast("double") for c in "xywh")
    finite = F.lit(True)
    for v in (x, y, w, h):
        finite = finite & v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    width, height = max(vp_w, 320), max(vp_h, 240)
    sane = (
        finite
        & (w > 0)
        & (h > 0)
        & (w <= max(vp_w * 2, 4000))
        & (h <= max(vp_h * 2, 4000))
        & (x < width + 100)
        & (y < height + 100)
    )
    cx, cy = F.greatest(F.lit(0.0), x), F.greatest(F.lit(0.0), y)
    cw = F.least(w, F.greatest(F.lit(10.0), width - cx))
    ch = F.least(h, F.greatest(F.lit(10.0), height - cy))
    return df.filter(sane).withColumns(
        {"x": B.js_round(cx), "y": B.js_round(cy), "w": B.js_round(cw), "h": B.js_round(ch)}
    )


# --- merging ----------------------------------------------------------------


def _strips(df: DataFrame, keys: list[str], start: str, size: str, out: str, step: int = 16) -> DataFrame:
    """Number the strips of an axis that empty space separates, per ``keys``.

    The occupied steps of an axis are bounded by the viewport, whatever the
    number of boxes; boxes of different strips can never meet, however much
    they grow.
    """
    lo, hi = F.floor(F.col(start) / step), F.floor((F.col(start) + F.col(size)) / step)
    steps = df.select(*keys, F.explode(F.sequence(lo, hi)).alias("_s"))
    taken = steps.groupBy(*keys).agg(F.sort_array(F.collect_set("_s")).alias("_taken"))
    starts = taken.withColumn(
        "_starts", F.filter("_taken", lambda s: ~F.array_contains(F.col("_taken"), s - 1))
    ).drop("_taken")
    number = F.size(F.filter("_starts", lambda s: s <= lo))
    return df.join(starts, keys).withColumn(out, number).drop("_starts")


class _BoxTree:
    """Boxes packed by place into a tree of bounding boxes, from which overlapping ones are taken once."""

    FAN = 16

    def __init__(self, x1, y1, x2, y2):
        n = len(x1)
        slab = max(1, int(np.ceil(np.sqrt(n / self.FAN)))) * self.FAN
        by_x = np.argsort(x1 + x2, kind="stable")
        self.index = by_x[np.lexsort(((y1 + y2)[by_x], np.arange(n) // slab))]
        self.levels = [np.stack([v[self.index] for v in (x1, y1, x2, y2)])]
        self.left = [np.ones(n, np.int64)]
        while self.levels[-1].shape[1] > self.FAN:
            low = self.levels[-1]
            cuts = np.arange(0, low.shape[1], self.FAN)
            least, most = np.minimum.reduceat(low[:2], cuts, axis=1), np.maximum.reduceat(low[2:], cuts, axis=1)
            self.levels.append(np.concatenate([least, most]))
            self.left.append(np.add.reduceat(self.left[-1], cuts))

    def take(self, x1, y1, x2, y2) -> np.ndarray:
        """Positions of the boxes still here that overlap this one; they are gone afterwards."""
        at = np.arange(self.levels[-1].shape[1])
        for level in range(len(self.levels) - 1, -1, -1):
            box = self.levels[level][:, at]
            at = at[(self.left[level][at] > 0) & (x1 < box[2]) & (x2 > box[0]) & (y1 < box[3]) & (y2 > box[1])]
            if level:
                at = (at[:, None] * self.FAN + np.arange(self.FAN)).ravel()
                at = at[at < self.levels[level - 1].shape[1]]
        self.drop(at)
        return self.index[at]

    def drop(self, at: np.ndarray) -> None:
        for left in self.left:
            np.subtract.at(left, at, 1)
            at = at // self.FAN


def _merge_cluster(x1, y1, x2, y2) -> list[tuple]:
    """Grow boxes by union with whatever they overlap, in array order."""
    tree = _BoxTree(x1, y1, x2, y2)
    place = np.empty(len(x1), np.int64)
    place[tree.index] = np.arange(len(x1))
    rows = []
    for i in range(len(x1)):
        if not tree.left[0][place[i]]:
            continue
        tree.drop(place[i : i + 1])
        l, t, r, b, n = x1[i], y1[i], x2[i], y2[i], 1
        while len(hit := tree.take(l, t, r, b)):
            n += len(hit)
            l, t = min(l, x1[hit].min()), min(t, y1[hit].min())
            r, b = max(r, x2[hit].max()), max(b, y2[hit].max())
        rows.append((i, l, t, r - l, b - t, n))
    return rows


def _merge_in_step(owner, x1, y1, x2, y2) -> tuple[np.ndarray, ...]:
    """``_merge_cluster`` for many small clusters at once: all of them grow one box at a time, in step.

    ``owner`` numbers the cluster of each box, ascending. A step looks at each box still
    there once; in it a cluster takes what its box overlaps, or, if that is nothing, hands the box out and
    goes on with its next one.
    """
    at = np.searchsorted(owner, np.arange(owner[-1] + 1))
    lead, n = at, np.ones(len(at), np.int64)
    l, t, r, b = (v[lead].copy() for v in (x1, y1, x2, y2))
    here = np.ones(len(owner), bool)
    here[lead] = False
    here = np.flatnonzero(here)
    growing = np.ones(len(lead), bool)
    out = []
    while growing.any():
        of = owner[here]
        hit = (l[of] < x2[here]) & (r[of] > x1[here]) & (t[of] < y2[here]) & (b[of] > y1[here])
        taken, by = here[hit], of[hit]
        grown = np.bincount(by, minlength=len(lead))
        for edge, of_box, fold in ((l, x1, np.minimum), (t, y1, np.minimum), (r, x2, np.maximum), (b, y2, np.maximum)):
            fold.at(edge, by, of_box[taken])
        n += grown
        here, of = here[~hit], of[~hit]
        done = np.flatnonzero(growing & (grown == 0))
        out.append((lead[done], l[done], t[done], r[done] - l[done], b[done] - t[done], n[done]))
        first = np.searchsorted(of, done)
        more = first < len(of)
        more[more] = of[first[more]] == done[more]
        growing[done[~more]] = False
        done, first = done[more], first[more]
        lead = lead.copy()
        lead[done], n[done] = here[first], 1
        for edge, of_box in ((l, x1), (t, y1), (r, x2), (b, y2)):
            edge[done] = of_box[here[first]]
        here = np.delete(here, first)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


_CLUSTER = ["image_id", "_sx", "_sy"]
_MERGED = ["image_id", "ord", "x", "y", "w", "h", "members"]


def _merge_batches(batches):
    """Merge clusters of a sorted partition; the open last one is carried over."""

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        image, order = pdf["image_id"].to_numpy(), pdf["ord"].to_numpy()
        x1, y1 = pdf["x"].to_numpy(float), pdf["y"].to_numpy(float)
        x2, y2 = x1 + pdf["w"].to_numpy(float), y1 + pdf["h"].to_numpy(float)
        cuts = np.flatnonzero(np.any([pdf[c].to_numpy()[1:] != pdf[c].to_numpy()[:-1] for c in _CLUSTER], axis=0)) + 1
        sizes = np.diff(np.r_[0, cuts, len(pdf)])
        small = np.flatnonzero(np.repeat(sizes <= CALM, sizes))
        out = []
        if len(small):
            owner = np.repeat(np.cumsum(sizes <= CALM) - 1, sizes)[small]
            i, *rest = _merge_in_step(owner, *(v[small] for v in (x1, y1, x2, y2)))
            out.append(pd.DataFrame(dict(zip(_MERGED, (image[small[i]], order[small[i]], *rest), strict=True))))
        for lo, n in zip(np.r_[0, cuts], sizes):
            if n > CALM:
                rows = _merge_cluster(*(v[lo:lo + n] for v in (x1, y1, x2, y2)))
                out.append(pd.DataFrame([(image[lo], order[lo + i], *rest) for i, *rest in rows], columns=_MERGED))
        return pd.concat(out, ignore_index=True)

    carry = None
    for pdf in batches:
        if carry is not None:
            pdf = pd.concat([carry, pdf], ignore_index=True)
        if not len(pdf):
            continue
        last = pdf[_CLUSTER].iloc[-1]
        open_rows = (pdf[_CLUSTER] == last).all(axis=1)
        carry, done = pdf[open_rows], pdf[~open_rows]
        if len(done):
            yield merged(done)
    if carry is not None and len(carry):
        yield merged(carry)


def merge_overlapping(df: DataFrame, order: str) -> DataFrame:
    """Merge overlapping boxes to a fixpoint; a grown box absorbs what it meets.

    The result depends on the order, so a cluster is merged in one place, by an index
    that hands out each box once: a growing box asks it only for what is left.
    A calm image is merged as a whole. The clusters of crowded ones are kept small
    beforehand: equal boxes collapse map-side (one absorbs the other at once), and
    empty strips split an image along x, then along y within each strip. What remains in one task is the distinct boxes of one cluster, some
    hundred bytes each. Boxes without an area take no part.
    """
    kind = dict(df.dtypes)[order]
    image = dict(df.dtypes)["image_id"]
    def distinct(rows: DataFrame) -> DataFrame:
        return rows.groupBy("image_id", "x", "y", "w", "h").agg(F.min(order).alias("ord"))

    def merged(placed: DataFrame) -> DataFrame:
        return placed.sortWithinPartitions(*_CLUSTER, "ord").select(*_CLUSTER, "ord", "x", "y", "w", "h").mapInPandas(
            _merge_batches,
            f"image_id {image}, ord {kind}, x double, y double, w double, h double, members long",
        )

    (calm,), crowded = split_crowded(df.filter((F.col("w") > 0) & (F.col("h") > 0)).select("image_id", "x", "y", "w", "h", order), known=("x", "y"))
    # a calm image is one cluster: boxes that empty space separates do not meet anyhow
    whole = distinct(calm.repartition("image_id")).withColumns({"_sx": F.lit(0), "_sy": F.lit(0)})
    out = merged(whole)
    if crowded is not None:
        boxes = _strips(distinct(crowded[0]), ["image_id"], "x", "w", "_sx")
        boxes = _strips(boxes, ["image_id", "_sx"], "y", "h", "_sy")
        out = out.unionByName(merged(boxes.repartition(*_CLUSTER)))
    return out.withColumnRenamed("ord", order)


# --- relations --------------------------------------------------------------


def _mid(start: str, size: str) -> Column:
    return F.col(start) + F.col(size) / 2


def _directions() -> list[Column]:
    ax, ay, aw, ah = B.box("a_")
    bx, by, bw, bh = B.box("b_")
    above, below = ay + ah <= by + 12, by + bh <= ay + 12
    left, right = ax + aw <= bx + 12, bx + bw <= ax + 12
    return [
        F.when(above, "ABOVE").when(below, "BELOW"),
        F.when(left, "LEFT_OF").when(right, "RIGHT_OF"),
    ]


RELATION_CONFIDENCE = {
    "CONTAINS": 0.96, "OVERLAPS": 0.88, "ALIGNED_WITH": 0.90, "NEAR": 0.85,
    "ABOVE": 0.90, "BELOW": 0.90, "LEFT_OF": 0.88, "RIGHT_OF": 0.88,
}


LINES = ("top", "bottom", "middle", "left", "right", "centre")


def _alignments(p: str) -> list[Column]:
    x, y, w, h = B.box(p)
    return [y, y + h, y + h / 2, x, x + w, x + w / 2]


def near_pairs(boxes: DataFrame, cell: int = 2 * CELL) -> DataFrame:
    """Ordered pairs with close centres that do not overlap.

    The box with the wider reach looks through the cells within its reach; the
    other one sits in the cell of its centre. Each unordered pair is met once.
    """
    reach = F.greatest(F.lit(140.0), 1.5 * F.greatest("w", "h"))
    tagged = boxes.withColumn("r", reach).withColumn("cx", _mid("x", "w")).withColumn("cy", _mid("y", "h"))
    cols = [c for c in tagged.columns if c != "image_id"]
    look = tagged.withColumn("_gx", _cells(F.col("cx") - F.col("r"), F.col("cx") + F.col("r"), cell))
    look = look.withColumn("_gy", _cells(F.col("cy") - F.col("r"), F.col("cy") + F.col("r"), cell))
    look = look.select("image_id", "_gx", "_gy", *[F.col(c).alias(f"a_{c}") for c in cols])
    sit = tagged.select(
        "image_id",
        F.floor(F.col("cx") / cell).alias("_gx"),
        F.floor(F.col("cy") / cell).alias("_gy"),
        *[F.col(c).alias(f"b_{c}") for c in cols],
    )
    distance = F.sqrt(F.pow(F.col("a_cx") - F.col("b_cx"), 2) + F.pow(F.col("a_cy") - F.col("b_cy"), 2))
    leads = (F.col("a_r") > F.col("b_r")) | ((F.col("a_r") == F.col("b_r")) & (F.col("a_id") < F.col("b_id")))
    apart = B.intersection(B.box("a_"), B.box("b_")) == 0
    half = look.join(sit, ["image_id", "_gx", "_gy"]).filter(leads & (distance <= F.col("a_r")) & apart)
    kept = [c for c in boxes.columns if c != "image_id"]

    def order(p: str, q: str) -> Column:
        return F.struct(
            *[F.col(f"{p}{c}").alias(f"a_{c}") for c in kept], *[F.col(f"{q}{c}").alias(f"b_{c}") for c in kept]
        )

    both = F.explode(F.array(order("a_", "b_"), order("b_", "a_")))
    return half.select("image_id", both.alias("_p")).select("image_id", "_p.*")


def aligned_pairs(boxes: DataFrame, slack: int = 8) -> DataFrame:
    """Ordered pairs with an edge or centre line within ``slack`` pixels.

    Each of six lines is joined on (image, line, band); a pair is taken at its
    first agreeing line only.
    """
    cols = [c for c in boxes.columns if c != "image_id"]
    # Bands of four times the slack: most values look into one band, few into two.
    band = 4 * (slack + 1)
    lines = F.posexplode(F.array(*[v.cast("double") for v in _alignments("")]))
    rows = boxes.select("*", lines.alias("_k", "_v"))
    a = rows.withColumn("_b", _cells(F.col("_v") - slack, F.col("_v") + slack, band))
    a = a.select("image_id", "_k", "_b", *[F.col(c).alias(f"a_{c}") for c in cols])
    b = rows.select("image_id", "_k", F.floor(F.col("_v") / band).alias("_b"), *[F.col(c).alias(f"b_{c}") for c in cols])
    agree = [F.abs(p - q) <= slack for p, q in zip(_alignments("a_"), _alignments("b_"))]
    first = None
    for k, ok in enumerate(agree):
        first = F.when(ok, k) if first is None else first.when(ok, k)
    return a.join(b, ["image_id", "_k", "_b"]).filter((F.col("a_id") != F.col("b_id")) & (first == F.col("_k"))).drop("_k", "_b")


def spatial_relations(df: DataFrame, ident: str, directional: str = "near") -> DataFrame:
    """Relations between the boxes of an image, as ordered pairs.

    CONTAINS, OVERLAPS, NEAR and ALIGNED_WITH are complete. Directions (ABOVE,
    LEFT_OF, ...) hold between nearly all pairs of an image; ``near`` states
    them for pairs that touch or are near, ``all`` for every pair, which is
    quadratic in the boxes of an image by definition.
    """
    boxes = df.filter((F.col("w") > 0) & (F.col("h") > 0)).select("image_id", F.col(ident).alias("id"), "x", "y", "w", "h")
    if directional == "all":
        return _relations_met(boxes, directional)
    (calm,), crowded = split_crowded(boxes)
    out = _relations_direct(calm)
    return out if crowded is None else out.unionByName(_relations_met(crowded[0], directional))


def _relation_rows(rows: DataFrame) -> DataFrame:
    confidence = F.create_map(*[F.lit(v) for kv in RELATION_CONFIDENCE.items() for v in kv])
    return rows.select(
        "image_id", F.col("a_id").alias("src"), F.col("b_id").alias("dst"), "relation",
        confidence[F.col("relation")].alias("confidence"),
    )


def _relations_direct(boxes: DataFrame) -> DataFrame:
    """Relations in calm images: each pair is met once and names all that hold. What a box brings is computed before it meets others."""
    x, y, w, h = B.box()
    ends = {"x1": x, "y1": y, "x2": x + w, "y2": y + h, "mx": x + w / 2, "my": y + h / 2, "r": F.greatest(F.lit(140.0), 1.5 * F.greatest(w, h))}
    spans = boxes.repartition("image_id").select("image_id", "id", *(v.cast("double").alias(n) for n, v in ends.items()))
    a, b = ({n: F.col(f"{p}_{n}") for n in ends} for p in "ab")
    pairs = met_in_image(spans, spans, F.col("a_id") != F.col("b_id"))
    across = (a["mx"] - b["mx"]) * (a["mx"] - b["mx"]) + (a["my"] - b["my"]) * (a["my"] - b["my"])
    near = F.sqrt(across) <= F.greatest(a["r"], b["r"])
    touching = (a["x1"] < b["x2"]) & (b["x1"] < a["x2"]) & (a["y1"] < b["y2"]) & (b["y1"] < a["y2"])
    contains = (a["x1"] <= b["x1"]) & (a["y1"] <= b["y1"]) & (a["x2"] >= b["x2"]) & (a["y2"] >= b["y2"])
    local = F.when(touching, F.when(contains, "CONTAINS").otherwise("OVERLAPS")).when(near, "NEAR")
    aligned = F.when(reduce(or_, (F.abs(a[n] - b[n]) <= 8 for n in ("x1", "x2", "mx", "y1", "y2", "my"))), "ALIGNED_WITH")
    vertical = F.when(a["y2"] <= b["y1"] + 12, "ABOVE").when(b["y2"] <= a["y1"] + 12, "BELOW")
    level = F.when(a["x2"] <= b["x1"] + 12, "LEFT_OF").when(b["x2"] <= a["x1"] + 12, "RIGHT_OF")
    rows = pairs.select("image_id", "a_id", "b_id", local.alias("l"), aligned.alias("al"), vertical.alias("v"), level.alias("h"))
    placed = [F.when(F.col("l").isNotNull(), F.col(d)) for d in ("v", "h")]
    return _relation_rows(rows.withColumn("relation", F.explode(F.array("l", "al", *placed))).filter("relation is not null"))


def _relations_met(boxes: DataFrame, directional: str) -> DataFrame:
    """Relations found on grids and bands, for images of any size."""
    ax, ay, aw, ah = B.box("a_")
    bx, by, bw, bh = B.box("b_")
    contains = (ax <= bx) & (ay <= by) & (ax + aw >= bx + bw) & (ay + ah >= by + bh)
    touching = grid_pairs(boxes, boxes).filter("a_id <> b_id").withColumn(
        "relation", F.when(contains, "CONTAINS").otherwise("OVERLAPS")
    )
    near = near_pairs(boxes).withColumn("relation", F.lit("NEAR"))
    aligned = aligned_pairs(boxes).withColumn("relation", F.lit("ALIGNED_WITH"))
    local = touching.unionByName(near)
    directions = F.filter(F.array(*_directions()), lambda r: r.isNotNull())
    if directional == "all":
        a = boxes.select("image_id", *[F.col(c).alias(f"a_{c}") for c in ("id", *"xywh")])
        b = boxes.select("image_id", *[F.col(c).alias(f"b_{c}") for c in ("id", *"xywh")])
        base = a.join(b, "image_id").filter("a_id <> b_id")
        out = local.unionByName(aligned).unionByName(base.withColumn("relation", F.explode(directions)))
    else:
        # Each near or touching pair carries its directions along; no second pass.
        named = F.explode(F.concat(F.array("relation"), directions))
        out = local.withColumn("relation", named).unionByName(aligned)
    return _relation_rows(out)


def direction_counts(df: DataFrame, ident: str, slack: int = 12) -> DataFrame:
    """How many boxes of its image each box is above, below, left of and right of, without forming pairs.

    A box is above another if it ends at most ``slack`` below the other's start, and
    below it if that holds the other way round only (likewise left and right). So
    ``n_above`` counts starts from a point on: every edge and every question is a
    place on one of two axes, all places of an image are sorted over the cluster, and
    running sums count the edges before a question. Two boxes so thin that each
    starts within the slack of the other's end would count both ways; those are
    counted apart, by kinds of thin boxes in bands of the slack, and taken off.
    Boxes without an area are left out; ``ident`` must be unique in an image.
    """
    boxes = df.filter((F.col("w") > 0) & (F.col("h") > 0))
    boxes = boxes.select("image_id", F.col(ident).alias("id"), *(F.col(c).cast("double").alias(c) for c in "xywh"))
    (calm,), crowded = split_crowded(boxes)
    out = _directions_direct(calm, slack)
    if crowded is not None:
        out = out.unionByName(_directions_sorted(crowded[0], slack))
    return out.withColumnRenamed("id", ident)


def _directions_direct(boxes: DataFrame, slack: int) -> DataFrame:
    """Counts in calm images: every box meets the boxes of its image, itself included, which is taken off."""
    x, y, w, h = B.box()
    spans = boxes.select("image_id", "id", x.alias("x1"), (x + w).alias("x2"), y.alias("y1"), (y + h).alias("y2")).repartition("image_id")
    kinds = spans.groupBy("image_id", "id", "x1", "x2", "y1", "y2").agg(F.count("*").alias("n"))
    met = met_in_image(kinds, spans.drop("id"), F.lit(True))

    def counts(axis: str) -> tuple[Column, Column]:
        low, high, start, end = (F.col(c) for c in (f"a_{axis}1", f"a_{axis}2", f"b_{axis}1", f"b_{axis}2"))
        first = F.coalesce(high <= start + slack, F.lit(False))
        # as in the sorted form, a place that is unknown lies before all that are known
        after = low.isNotNull() & ~first & (start.isNull() | (end <= low + slack))
        return first, after

    (above, below), (left, right) = counts("y"), counts("x")
    names = ("n_above", "n_below", "n_left", "n_right")
    a_kind = ["image_id", *(f"a_{c}" for c in kinds.columns if c != "image_id")]
    sums = met.groupBy(*a_kind).agg(*(F.count_if(v).alias(n) for n, v in zip(names, (above, below, left, right), strict=True)))
    thin = {axis: F.coalesce((F.col(f"a_{axis}2") - F.col(f"a_{axis}1") <= slack).cast("long"), F.lit(0)) for axis in "xy"}
    own = (thin["y"], F.lit(0), thin["x"], F.lit(0))
    return sums.groupBy("image_id", F.col("a_id").alias("id")).agg(*(F.sum((F.col(n) - o) * F.col("a_n")).alias(n) for n, o in zip(names, own, strict=True)))


def _directions_sorted(boxes: DataFrame, slack: int) -> DataFrame:
    """Counts from sorted edges and running sums, for images of any size."""
    sides = F.explode(F.array(*(F.struct(F.lit(a).alias("axis"), F.col(p).alias("low"), (F.col(p) + F.col(s)).alias("high")) for a, p, s in (("x", "x", "w"), ("y", "y", "h")))))
    spans = written(boxes.select("image_id", "id", sides.alias("s")).select("image_id", "id", "s.*"), "spans")

    def place(at, kind: str, weight: int) -> Column:
        return F.struct(at.alias("at"), F.lit(kind).alias("kind"), F.lit(weight).alias("edge"))

    # a start before a question at the same place does not count as after it, an end at the place counts as before it
    low, high = F.col("low"), F.col("high")
    places = F.array(
        place(low, "b_start", 1), place(high - slack, "a_starts_before", 0),
        place(high, "c_end", 1), place(low + slack, "d_ends_until", 0),
    )
    rows = spans.select("image_id", "axis", "id", "low", "high", F.explode(places).alias("p")).select("image_id", "axis", "id", "low", "high", "p.*")
    starts = F.col("kind").isin("a_starts_before", "b_start").alias("of_starts")
    group, order = ["image_id", "axis", "of_starts"], ["at", "kind", "id"]
    counted = R.running(R.ranged(rows.select("*", starts), group, order, "places"), group, order, {"until": "edge"})
    sizes = spans.groupBy("image_id", "axis").agg(F.count("*").alias("n"))
    asked = counted.filter("edge = 0").join(sizes, ["image_id", "axis"])
    own = (F.col("high") - F.col("low") <= slack).cast("long")
    after = F.when(F.col("of_starts"), F.col("n") - F.col("until") - own)
    before = F.when(~F.col("of_starts"), F.col("until") - own)
    # thin boxes: kinds of equal (low, high), each met by the kinds of its bands
    thin = spans.filter(high - low < 2 * slack)
    kinds = thin.groupBy("image_id", "axis", "low", "high").agg(F.count("*").alias("n"))
    band = 2 * slack
    a = kinds.select("image_id", "axis", low.alias("a_low"), high.alias("a_high"), F.explode(F.sequence(F.floor((high - slack) / band), F.floor((low + slack) / band))).alias("_b"))
    b = kinds.select("image_id", "axis", low.alias("b_low"), high.alias("b_high"), "n", F.floor(low / band).alias("_b"))
    both = (F.col("b_low") >= F.col("a_high") - slack) & (F.col("b_high") <= F.col("a_low") + slack)
    twice = a.join(b, ["image_id", "axis", "_b"]).filter(both).groupBy("image_id", "axis", F.col("a_low").alias("low"), F.col("a_high").alias("high"))
    twice = twice.agg(F.sum("n").alias("twice")).withColumn("twice", F.col("twice") - (high - low <= slack).cast("long"))
    taken = thin.join(twice, ["image_id", "axis", "low", "high"]).select("image_id", "id", "axis", F.lit(0).cast("long").alias("after"), (-F.col("twice")).alias("before"))
    parts = asked.select("image_id", "id", "axis", F.coalesce(after, F.lit(0)).alias("after"), F.coalesce(before, F.lit(0)).alias("before"))

    def total(axis: str, what: str) -> Column:
        return F.sum(F.when(F.col("axis") == axis, F.col(what)).otherwise(0))

    return parts.unionByName(taken).groupBy("image_id", "id").agg(
        total("y", "after").alias("n_above"), total("y", "before").alias("n_below"),
        total("x", "after").alias("n_left"), total("x", "before").alias("n_right"),
    )


def alignment_runs(df: DataFrame, ident: str, slack: int = 8) -> DataFrame:
    """For each box and each of its six lines the run it lies on: one row, where pairs would be many.

    Lines are top, bottom, middle, left, right and centre. A run is a chain of line
    positions of an image, each within ``slack`` of the next; it is named by its
    first position, and has ``members`` boxes. Two boxes are aligned on a line exactly
    if they share a run and their positions differ by at most ``slack``. Positions
    are made distinct map-side, then sorted over the cluster.
    """
    boxes = df.filter((F.col("w") > 0) & (F.col("h") > 0)).select("image_id", F.col(ident).alias("id"), "x", "y", "w", "h")
    (calm,), crowded = split_crowded(boxes)
    out = _runs_direct(calm, slack)
    if crowded is not None:
        out = out.unionByName(_runs_sorted(crowded[0], slack))
    return out.withColumnRenamed("id", ident).select("image_id", ident, "line", "at", "run", "members")


def _runs_direct(boxes: DataFrame, slack: int) -> DataFrame:
    """Runs in calm images, a line after the other over the boxes of an image, which are shuffled once."""
    rows = boxes.select("image_id", "id", *(v.cast("double").alias(n) for n, v in zip(LINES, _alignments(""), strict=True))).repartition("image_id")
    for line in LINES:
        at = F.col(line)
        order = Window.partitionBy("image_id").orderBy(line)
        rows = rows.withColumn("_gap", at - F.lag(line).over(order))
        start = F.when(F.col("_gap").isNull() | (F.col("_gap") > slack), at)
        rows = rows.withColumn("_run", F.max(start).over(order.rowsBetween(Window.unboundedPreceding, 0)))
        members = F.count(line).over(Window.partitionBy("image_id", "_run"))
        rows = rows.withColumn(f"_{line}", F.struct(F.lit(line).alias("line"), at.alias("at"), F.col("_run").alias("run"), members.alias("members")))
        rows = rows.drop("_gap", "_run", line)
    listed = rows.select("image_id", "id", F.explode(F.array(*(F.col(f"_{line}") for line in LINES))).alias("l"))
    return listed.select("image_id", "id", "l.*").filter("at is not null")


def _runs_sorted(boxes: DataFrame, slack: int) -> DataFrame:
    """Runs from positions sorted over the cluster, for images of any size."""
    lines = F.array(*(F.struct(F.lit(n).alias("line"), v.cast("double").alias("at")) for n, v in zip(LINES, _alignments(""), strict=True)))
    rows = written(boxes.select("image_id", "id", F.explode(lines).alias("l")).select("image_id", "id", "l.*"), "lines")
    group = ["image_id", "line"]
    spots = R.ranged(rows.groupBy(*group, "at").agg(F.count("*").alias("n")), group, ["at"], "line-spots")
    order = Window.partitionBy("_range", *group).orderBy("at")
    # the position before the first of a range is the last of the ranges before it
    ends = spots.groupBy(*group, "_range").agg(F.max("at").alias("_end"))
    ends = ends.withColumn("_ahead", F.max("_end").over(Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))).drop("_end")
    placed = spots.join(ends, [*group, "_range"])
    gap = F.col("at") - F.coalesce(F.lag("at").over(order), F.col("_ahead"))
    fresh = placed.withColumn("_start", F.when(gap.isNull() | (gap > slack), F.col("at"))).drop("_ahead")
    runs = R.running(fresh, group, ["at"], {"run": "_start"}, F.max)
    sizes = runs.groupBy(*group, "run").agg(F.sum("n").alias("members"))
    named = runs.select(*group, "at", "run").join(sizes, [*group, "run"])
    return rows.join(named, [*group, "at"]).select("image_id", "id", "line", "at", "run", "members")


def points_in_boxes(points: DataFrame, boxes: DataFrame, cell: int = CELL) -> DataFrame:
    """Boxes under each point (borders included), met on grid cells."""
    placed = boxes.withColumn("_cx", _cells(F.col("x"), F.col("x") + F.col("w"), cell)).withColumn(
        "_cy", _cells(F.col("y"), F.col("y") + F.col("h"), cell)
    )
    at = points.withColumn("_cx", F.floor(F.col("px") / cell)).withColumn("_cy", F.floor(F.col("py") / cell))
    joined = at.join(placed, ["image_id", "_cx", "_cy"])
    return joined.filter(B.contains_point(B.box(), F.col("px"), F.col("py"))).drop("_cx", "_cy")


def fuse_text_regions(regions: DataFrame, texts: DataFrame) -> DataFrame:
    """Texts that touch a region: joined text, and occupancy, padding and position of the last.

    ``regions`` carry ``region_id``, ``texts`` carry ``text_ord`` and ``text``;
    a region collects only the texts lying on it.
    """
    pairs = overlap_pairs(regions, texts, touching=True)
    rx, ry, rw, rh = B.box("a_")
    tx, ty, tw, th = B.box("b_")
    left, right = F.greatest(F.lit(0), tx - rx), F.greatest(F.lit(0), rx + rw - tx - tw)
    place = F.when(F.abs(left - right) <= 20, "CENTER").when(left < right, "LEFT").otherwise("RIGHT")
    share = B.js_round(F.least(F.lit(1.0), (tw * th) / F.greatest(F.lit(1), rw * rh)) * 100) / 100
    last = F.max_by(
        F.struct(
            share.alias("occupancy"),
            B.js_round(left).alias("pad_left"),
            B.js_round(right).alias("pad_right"),
            B.js_round(F.greatest(F.lit(0), ty - ry)).alias("pad_top"),
            B.js_round(F.greatest(F.lit(0), ry + rh - ty - th)).alias("pad_bottom"),
            place.alias("position"),
        ),
        F.col("b_text_ord"),
    )
    found = pairs.groupBy("image_id", F.col("a_region_id").alias("region_id")).agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct(F.col("b_text_ord").alias("o"), F.col("b_text").alias("t")))),
                lambda s: s["t"],
            ),
            " ",
        ).alias("associated_text"),
        last.alias("_l"),
    )
    return found.select("image_id", "region_id", "associated_text", "_l.*")


# --- suppression ------------------------------------------------------------


def _suppress(keys: list[str], thr: float, cell: int):
    """Keep, from rows sorted by group and rank, each box that no kept one covers; only the kept ones are held."""

    def run(batches):
        group, kept = None, {}
        for pdf in batches:
            named = list(zip(*(pdf[k].tolist() for k in keys), strict=True))
            keep = np.zeros(len(pdf), bool)
            for row, box in enumerate(zip(*(pdf[c].tolist() for c in "xywh"), strict=True)):
                if named[row] != group:
                    group, kept = named[row], {}
                x, y, w, h = box
                spots = [
                    (i, j)
                    for i in range(int(x // cell), int((x + w) // cell) + 1)
                    for j in range(int(y // cell), int((y + h) // cell) + 1)
                ]
                for other in {o for spot in spots for o in kept.get(spot, ())}:
                    a, b, c, d = other
                    wide, high = min(a + c, x + w) - max(a, x), min(b + d, y + h) - max(b, y)
                    common = max(0, wide) * max(0, high)
                    whole = c * d + w * h - common
                    if whole > 0 and common / whole >= thr:
                        break
                else:
                    keep[row] = True
                    for spot in spots:
                        kept.setdefault(spot, []).append(box)
            yield pdf.loc[keep, [*keys, "id"]]

    return run


def nms(df: DataFrame, ident: str, thr: float = K.NMS_IOU, class_aware: bool = True, cell: int = CELL,
        repeat: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Greedy suppression by confidence; the kept rows come back.

    Boxes of a group come sorted, the surest first, and stream past those kept so
    far, which are found by the grid cells they lie in. A task holds kept boxes only:
    boxes that overlap less than ``thr`` (above 0, up to 1), so the picture bounds
    them, not the rows. Equal boxes of crowded images collapse to the surest map-side,
    as they live and fall with it; calm images go whole. Equal confidences go by ``ident``; without a confidence a box comes last.
    ``repeat`` makes the rows that are meant out of those given, image by image, after the shuffle.
    """
    if not 0 < thr <= 1:
        raise ValueError("thr must lie above 0 and not above 1")
    keys = ["image_id", "cls"] if class_aware else ["image_id"]
    (calm,), crowded = split_crowded(df)
    repeat = repeat or (lambda rows: rows)
    out = _nms_whole(calm, ident, keys, thr, cell, repeat)
    return out if crowded is None else out.unionByName(_nms_joined(repeat(crowded[0]), ident, keys, thr, cell))


def _keep_rows(keys: list[str], ident: str, thr: float, cell: int):
    """Whole rows of sorted calm groups whose ``ident`` is kept; the open last group waits for its rest."""

    def kept_of(table: pa.Table) -> pa.Table:
        pdf = table.select([*keys, "_id", *"xywh"]).rename_columns([*keys, "id", *"xywh"])
        frame = pd.DataFrame({c: pdf.column(c).to_pylist() for c in pdf.column_names}, dtype=object)
        found = next(iter(_suppress(keys, thr, cell)(iter([frame]))))
        names = set(found.itertuples(index=False, name=None))
        mask = [row in names and row[-1] is not None for row in frame[[*keys, "id"]].itertuples(index=False, name=None)]
        return table.filter(pa.array(mask, pa.bool_())).drop_columns(["_neg", "_id"])

    def run(batches):
        carry = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if carry is None else pa.concat_tables([carry, table])
            if not table.num_rows:
                continue
            group = list(zip(*(table.column(k).to_pylist() for k in keys), strict=True))
            at = len(group)
            while at and group[at - 1] == group[-1]:
                at -= 1
            carry = table.slice(at)
            if at:
                yield from kept_of(table.slice(0, at)).to_batches()
        if carry is not None and carry.num_rows:
            yield from kept_of(carry).to_batches()

    return run


def _nms_whole(df: DataFrame, ident: str, keys: list[str], thr: float, cell: int, repeat: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Suppression in calm images: whole rows are shuffled once by image, and equal boxes simply fall to the first."""
    placed = repeat(df.dropna(subset=keys).repartition("image_id"))
    rows = placed.withColumns({"_neg": -F.coalesce(F.col("conf").cast("double"), F.lit(float("-inf"))), "_id": F.col(ident)})
    ranked = rows.sortWithinPartitions(*keys, "_neg", "_id")
    return ranked.mapInArrow(_keep_rows(keys, ident, thr, cell), placed.schema)


def _nms_joined(df: DataFrame, ident: str, keys: list[str], thr: float, cell: int) -> DataFrame:
    rank = F.struct((-F.coalesce(F.col("conf").cast("double"), F.lit(float("-inf")))).alias("neg"), F.col(ident).alias("id"))
    # boxes without an area overlap nothing, not even their equals
    flat = F.when((F.col("w") > 0) & (F.col("h") > 0), F.lit(None)).otherwise(F.col(ident)).alias("_flat")
    best = df.groupBy(*keys, "x", "y", "w", "h", flat).agg(F.min(rank).alias("r"))
    ranked = best.select(*keys, "x", "y", "w", "h", "r.neg", "r.id").repartition(*keys).sortWithinPartitions(*keys, "neg", "id")
    types = dict(df.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + f", id {types[ident]}"
    kept = ranked.mapInPandas(_suppress(keys, thr, cell), schema).withColumnRenamed("id", ident)
    return df.join(kept, [*keys, ident], "left_semi")


# --- tiles and crops --------------------------------------------------------


def tile_table(vp_w: int, vp_h: int, share: float = 0.60) -> list[tuple[int, int, int, int, int]]:
    """Two by two tiles: overlapping at 0.60, disjoint at 0.50."""
    tw, th = int(vp_w * share), int(vp_h * share)
    return [
        (0, 0, 0, tw, th),
        (1, vp_w - tw, 0, tw, th),
        (2, 0, vp_h - th, tw, th),
        (3, vp_w - tw, vp_h - th, tw, th),
    ]


def tile_grid(df: DataFrame, vp_w: int = 1920, vp_h: int = 1080, share: float = 0.60) -> DataFrame:
    """Each box in every tile it reaches, in tile coordinates, cut at the tile."""
    tiles = F.array(
        *[
            F.struct(*[F.lit(v).alias(n) for n, v in zip(("tile", "tx", "ty", "tw", "th"), t)])
            for t in tile_table(vp_w, vp_h, share)
        ]
    )
    rows = df.withColumn("_t", F.explode(tiles))
    x, y, w, h = B.box()
    t = F.col("_t")
    l, r = F.greatest(x, t["tx"]), F.least(x + w, t["tx"] + t["tw"])
    u, d = F.greatest(y, t["ty"]), F.least(y + h, t["ty"] + t["th"])
    inside = rows.filter((r > l) & (d > u))
    others = [c for c in df.columns if c not in "xywh"]
    return inside.select(
        *others, t["tile"].alias("tile"), t["tx"].alias("tx"), t["ty"].alias("ty"),
        (l - t["tx"]).alias("x"), (u - t["ty"]).alias("y"), (r - l).alias("w"), (d - u).alias("h"),
    )


def untile(df: DataFrame) -> DataFrame:
    """Tile coordinates back to the viewport; sizes are at least one pixel."""
    return df.withColumns(
        {
            "x": B.js_round(F.col("tx") + F.col("x")),
            "y": B.js_round(F.col("ty") + F.col("y")),
            "w": F.greatest(F.lit(1).cast("long"), B.js_round(F.col("w"))),
            "h": F.greatest(F.lit(1).cast("long"), B.js_round(F.col("h"))),
        }
    ).drop("tx", "ty")


def crop_windows(df: DataFrame, order: str, classes=("card", "navigation"), limit: int = 3, margin: int = 20, vp_w: int = 1920, vp_h: int = 1080) -> DataFrame:
    """The first few container boxes of each image with a margin, clamped.

    Filtering on the rank lets Spark drop the rest before the shuffle.
    """
    wanted = df.filter(F.col("cls").isin(*[K.UI_CLASSES.index(c) for c in classes]))
    rank = F.row_number().over(Window.partitionBy("image_id").orderBy(order))
    top = wanted.withColumn("crop", rank).filter(F.col("crop") <= limit)
    cx = F.greatest(F.lit(0), F.col("x") - margin)
    cy = F.greatest(F.lit(0), F.col("y") - margin)
    return top.select(
        "image_id", "crop", order, cx.alias("x"), cy.alias("y"),
        F.least(vp_w - cx, F.col("w") + 2 * margin).alias("w"),
        F.least(vp_h - cy, F.col("h") + 2 * margin).alias("h"),
    )


# --- region features --------------------------------------------------------


def classify_regions(df: DataFrame) -> DataFrame:
    """Region type and confidence from evidence columns: ordered rules, first match wins."""
    c = {n: F.coalesce(F.col(n), F.lit(d)) for n, d in (
        ("border", 0.0), ("interior", 0.0), ("corner", 0.0), ("fill", 0.0), ("text_pos", "NONE"),
        ("components", 1), ("similarity", 0.0), ("alignment", 0.0))}
    w, h, y = F.col("w"), F.col("h"), F.col("y")
    aspect, edge, contrast, variance, area = (F.col(n) for n in ("aspect", "edge", "contrast", "variance", "area"))
    one = F.lit(1.0)

    def conf(low, high, value):
        return F.least(F.lit(high), F.greatest(F.lit(low), value))

    rules = (
        ("VISUAL_CHECKBOX_RADIO",
         (w <= 36) & (h <= 36) & aspect.between(0.7, 1.45) & ((c["border"] >= 0.40) | (c["corner"] >= 0.40) | (edge >= 0.18)),
         conf(0.75, 0.96, 0.78 + 0.12 * c["border"] + 0.08 * c["corner"])),
        ("VISUAL_ICON",
         (w <= 55) & (h <= 55) & aspect.between(0.65, 1.5) & ((edge >= 0.16) | (c["components"] >= 2)) & (contrast >= 25),
         conf(0.70, 0.94, 0.75 + 0.15 * F.least(one, edge * 3))),
        ("VISUAL_INPUT",
         aspect.between(2.4, 14.0) & h.between(22, 70) & ((c["fill"] >= 0.65) | (c["border"] >= 0.35)) & ((edge < 0.22) | (c["text_pos"] == "LEFT")),
         conf(0.75, 0.95, 0.78 + 0.10 * c["fill"] + F.when(c["text_pos"] == "LEFT", 0.07).otherwise(0.0))),
        ("VISUAL_BUTTON",
         aspect.between(1.2, 6.0) & h.between(20, 80) & ((c["border"] >= 0.35) | (contrast >= 25) | (c["interior"] >= 20)) & ((c["fill"] >= 0.55) | (c["text_pos"] == "CENTER")),
         conf(0.75, 0.96, 0.76 + 0.10 * c["border"] + 0.08 * c["fill"] + F.when(c["text_pos"] == "CENTER", 0.06).otherwise(0.0))),
        ("VISUAL_NAVIGATION",
         ((aspect >= 5.0) | (y <= 80)) & (area >= 35000) & ((c["alignment"] >= 0.4) | (c["similarity"] >= 0.4) | (w >= 400)),
         conf(0.75, 0.93, 0.80 + 0.10 * c["alignment"])),
        ("VISUAL_CARD",
         (w >= 160) & (h >= 90) & (area >= 18000) & aspect.between(0.4, 4.5) & ((c["border"] >= 0.30) | (contrast >= 15) | (area >= 30000)),
         conf(0.75, 0.94, 0.80 + F.when(area > 40000, 0.08).otherwise(0.04))),
        ("VISUAL_IMAGE",
         (area >= 6000) & (variance >= 1500) & (c["fill"] < 0.50) & (edge < 0.25),
         conf(0.70, 0.92, 0.75 + 0.15 * (1 - c["fill"]))),
        ("VISUAL_INTERACTIVE",
         (edge >= 0.12) | (contrast >= 20) | (c["border"] >= 0.25),
         conf(0.65, 0.88, 0.70 + 0.12 * edge)),
    )
    pick = None
    for name, cond, value in rules:
        found = F.struct(F.lit(name).alias("t"), (B.js_round(value * 100) / 100).alias("c"))
        pick = F.when(cond, found) if pick is None else pick.when(cond, found)
    pick = pick.otherwise(F.struct(F.lit("UNKNOWN_VISUAL_REGION").alias("t"), F.lit(0.40).alias("c")))
    return (
        df.withColumn("_p", pick)
        .withColumn("region_type", F.col("_p.t"))
        .withColumn("region_confidence", F.col("_p.c"))
        .drop("_p")
    )


def nearest_distance(points: DataFrame, start: int = 8, growth: int = 4) -> DataFrame:
    """(image_id, x, y, near): distance from each distinct place of an image to the next point there; no row if there is none.

    A nearest-neighbour join by growing rings. A round asks the cells around a place;
    an answer within the size of a cell is final, the other places ask larger cells in
    the next round. Whoever still asks has nobody within a cell of the round before,
    so those who ask are thinly spread and no cell is asked by many, however crowded
    it is. Each round is written to the shared folder.
    """
    spots = points.filter(F.col("x").isNotNull() & F.col("y").isNotNull()).groupBy("image_id", "x", "y").agg(F.count("*").alias("n"))
    spots = written(spots, "spots")
    images = spots.groupBy("image_id").agg(F.count("*").alias("places")).filter("places > 1").select("image_id")
    asking = spots.filter("n = 1").join(images, "image_id").drop("n")
    found = [spots.filter("n > 1").select("image_id", "x", "y", F.lit(0.0).alias("near"))]
    size = start
    while True:
        cell_x, cell_y = F.floor(F.col("x") / size), F.floor(F.col("y") / size)
        around = asking.withColumn("_cx", F.explode(F.sequence(cell_x - 1, cell_x + 1))).withColumn("_cy", F.explode(F.sequence(cell_y - 1, cell_y + 1)))
        others = spots.select("image_id", F.col("x").alias("ox"), F.col("y").alias("oy"), cell_x.alias("_cx"), cell_y.alias("_cy"))
        apart = (F.col("x") != F.col("ox")) | (F.col("y") != F.col("oy"))
        distance = F.sqrt(F.pow(F.col("x") - F.col("ox"), 2) + F.pow(F.col("y") - F.col("oy"), 2))
        answers = around.join(others, ["image_id", "_cx", "_cy"]).filter(apart).groupBy("image_id", "x", "y").agg(F.min(distance).alias("near"))
        step = written(asking.join(answers, ["image_id", "x", "y"], "left"), "rings")
        found.append(step.filter(F.col("near") <= size))
        asking = step.filter(F.col("near").isNull() | (F.col("near") > size)).drop("near")
        if asking.isEmpty():
            return reduce(DataFrame.unionByName, found)
        size *= growth


def aligned_partners(rows: DataFrame, slack: float = 10, most: int = 4) -> DataFrame:
    """(image_id, id, partners): others with x, y or w within ``slack``, counted up to ``most``.

    Per image, axis and value the first ids stand for all (one more than ``most``),
    and the next ``most`` values on either side name enough of the others: witnesses
    that are too few are all there are.
    """
    axes = F.array(*(F.struct(F.lit(c).alias("axis"), F.col(c).cast("double").alias("at")) for c in "xyw"))
    places = rows.select("image_id", "id", F.explode(axes).alias("a")).select("image_id", "id", "a.*").filter("at is not null")
    rank = F.row_number().over(Window.partitionBy("image_id", "axis", "at").orderBy("id"))
    firsts = places.withColumn("_rank", rank).filter(F.col("_rank") <= most + 1)
    spots = firsts.groupBy("image_id", "axis", "at").agg(F.collect_list("id").alias("ids"))
    close = Window.partitionBy("image_id", "axis").orderBy("at").rowsBetween(-most, most)
    spots = spots.withColumn("_near", F.collect_list(F.struct("at", "ids")).over(close))
    named = F.flatten(F.transform(F.filter("_near", lambda s: F.abs(s["at"] - F.col("at")) <= slack), lambda s: s["ids"]))
    spots = spots.select("image_id", "axis", "at", named.alias("witnesses"))
    met = places.join(spots, ["image_id", "axis", "at"]).groupBy("image_id", "id").agg(F.flatten(F.collect_list("witnesses")).alias("w"))
    others = F.size(F.array_remove(F.array_distinct("w"), F.col("id")))
    return met.select("image_id", "id", F.least(others, F.lit(most)).alias("partners"))


def similar_partners(rows: DataFrame, aspect: float = 0.3, fill: float = 0.2, most: int = 4) -> DataFrame:
    """(image_id, id, partners): others with a close aspect and fill, counted up to ``most``; none: no row.

    Cells are a little smaller than the tolerances, so all of one cell are partners.
    Members of a cell with more than ``most`` need no search; the members of other
    cells are few, so each row nearby is met by few.
    """
    sizes = {"aspect": aspect - 0.001, "fill": fill - 0.001}
    cells = {c: F.floor(F.col(c) / size) for c, size in sizes.items()}
    placed = rows.filter(F.col("aspect").isNotNull() & F.col("fill").isNotNull())
    placed = placed.select("image_id", "id", "aspect", "fill", cells["aspect"].alias("_ca"), cells["fill"].alias("_cf"))
    home = ["image_id", "_ca", "_cf"]
    placed = placed.join(placed.groupBy(*home).agg(F.count("*").alias("_n")), home)
    crowded = placed.filter(F.col("_n") > most).select("image_id", "id", F.lit(most).cast("long").alias("partners"))

    def reach(c: str, tolerance: float) -> Column:
        slack = tolerance + 1e-9
        return F.explode(F.sequence(F.floor((F.col(c) - slack) / sizes[c]), F.floor((F.col(c) + slack) / sizes[c])))

    asking = placed.filter(F.col("_n") <= most).select("image_id", "id", "aspect", "fill")
    asking = asking.withColumn("_ca", reach("aspect", aspect)).withColumn("_cf", reach("fill", fill))
    others = placed.select(*home, F.col("id").alias("oid"), F.col("aspect").alias("oa"), F.col("fill").alias("of"))
    close = (F.abs(F.col("aspect") - F.col("oa")) <= aspect) & (F.abs(F.col("fill") - F.col("of")) <= fill)
    met = asking.join(others, home).filter(close & (F.col("id") != F.col("oid")))
    counted = met.groupBy("image_id", "id").agg(F.least(F.count("*"), F.lit(most)).alias("partners"))
    return crowded.unionByName(counted)


def neighbourhood_stats(df: DataFrame, ident: str) -> DataFrame:
    """Isolation, alignment and similarity of each region within its image; ``ident`` is unique there.

    Isolation is the distance to the next region (500 if there is none); the scores
    saturate at four partners. The regions of calm images meet directly, after one shuffle
    by image; in the others nothing compares all regions of an image with each other.
    A feature that is null is close to nothing.
    """
    rows = df.select("image_id", F.col(ident).alias("id"), "x", "y", "w", "aspect", "fill")
    (calm,), crowded = split_crowded(rows, unique="id")
    stats = _neighbours_met(calm)
    if crowded is not None:
        stats = stats.unionByName(_neighbours_searched(crowded[0]))

    def score(n: Column) -> Column:
        return B.js_round(F.coalesce(n, F.lit(0)) / 4 * 100) / 100

    isolation = B.js_round(F.coalesce("near", F.lit(500.0))).alias("isolation")
    return stats.select("image_id", F.col("id").alias(ident), isolation, score(F.col("al")).alias("alignment"), score(F.col("si")).alias("similarity"))


def _neighbours_met(rows: DataFrame, most: int = 4) -> DataFrame:
    """(image_id, id, near, al, si) in calm images; a region also meets itself, so that one alone stays."""
    other = F.col("a_id") != F.col("b_id")
    gap = {c: F.col(f"a_{c}").cast("double") - F.col(f"b_{c}") for c in ("x", "y", "w", "aspect", "fill")}
    aligned = reduce(or_, (F.abs(gap[c]) <= 10 for c in ("x", "y", "w")))
    similar = (F.abs(gap["aspect"]) <= 0.3) & (F.abs(gap["fill"]) <= 0.2)
    # both sides name their image anew, so that Spark sees that they are one shuffle
    left, right = (rows.select(*[F.col(c).alias(f"{p}_{c}") for c in rows.columns]) for p in "ab")
    met = left.join(right, F.col("a_image_id") == F.col("b_image_id"))
    return met.groupBy(F.col("a_image_id").alias("image_id"), F.col("a_id").alias("id")).agg(
        F.min(F.when(other, F.sqrt(F.pow(gap["x"], 2) + F.pow(gap["y"], 2)))).alias("near"),
        F.least(F.count_if(other & aligned), F.lit(most)).alias("al"),
        F.least(F.count_if(other & similar), F.lit(most)).alias("si"),
    )


def _neighbours_searched(rows: DataFrame) -> DataFrame:
    """(image_id, id, near, al, si) in images of any size."""
    rows = written(rows, "regions")
    near = rows.join(nearest_distance(rows), ["image_id", "x", "y"], "left").select("image_id", "id", "near")
    aligned = aligned_partners(rows).withColumnRenamed("partners", "al")
    similar = similar_partners(rows).withColumnRenamed("partners", "si")
    return near.join(aligned, ["image_id", "id"], "left").join(similar, ["image_id", "id"], "left")


def uncertainty(dets: DataFrame) -> DataFrame:
    """State per detection."""
    c = F.col("conf")
    state = F.when(c >= 0.85, "CONFIDENT").when(c >= 0.65, "AMBIGUOUS").otherwise("UNCERTAIN_FALLBACK")
    return dets.withColumn("uncertainty", state)


def uncertainty_ratio(dets: DataFrame) -> DataFrame:
    """Share of detections per image that are not confident."""
    unsure = F.when(F.col("conf") >= 0.85, 0).otherwise(1)
    ratio = B.js_round(F.sum(unsure) / F.count("*") * 100) / 100
    return dets.groupBy("image_id").agg(F.count("*").alias("detections"), ratio.alias("uncertainty_ratio"))


def sequential_above(df: DataFrame, ident: str) -> DataFrame:
    """Edge from each box to the next of its image when that one lies below it."""
    w = Window.partitionBy("image_id").orderBy(ident)
    following = df.select(
        "image_id", F.col(ident).alias("src"), (F.col("y") + F.col("h")).alias("_end"),
        F.lead(F.struct(F.col(ident).alias("id"), "y")).over(w).alias("_n"),
    )
    return following.filter(F.col("_end") <= F.col("_n.y")).select("image_id", "src", F.col("_n.id").alias("dst"))


def scene_lines(df: DataFrame, kind: str, text: str | None = None) -> DataFrame:
    """The description of each region, one row per region."""
    label = F.lit("")
    if text:
        has = F.coalesce(F.col(text), F.lit("")) != ""
        label = F.when(has, F.concat(F.lit(' "'), F.col(text), F.lit('"'))).otherwise("")
    return df.withColumn(
        "line",
        F.concat(F.lit("["), F.col(kind), label, F.format_string(" at (%d,%d) [%dx%d]]", "x", "y", "w", "h")),
    )


def scene_summary(df: DataFrame, ident: str, kind: str, text: str | None = None) -> DataFrame:
    """One line per image; a value of that size is the definition of the result."""
    lines = scene_lines(df, kind, text)
    ordered = F.array_sort(F.collect_list(F.struct(F.col(ident).alias("o"), "line")))
    return lines.groupBy("image_id").agg(
        F.array_join(F.transform(ordered, lambda s: s["line"]), ", ").alias("summary")
    )


# --- target grids -----------------------------------------------------------


def slot_collisions(gt: DataFrame, grid: int = 16, vp_w: int = 1920, vp_h: int = 1080) -> DataFrame:
    """How many objects share (cell, anchor), as a histogram of occupancy."""

    def index(start, size, whole):
        at = ((F.col(start) + F.col(size) / 2.0) / whole * grid).cast("long")
        return F.greatest(F.lit(0), F.least(F.lit(grid - 1), at))

    wide = F.when(F.col("w") / vp_w > F.col("h") / vp_h, 0).otherwise(1)
    slots = gt.groupBy(
        "image_id", index("x", "w", vp_w).alias("gx"), index("y", "h", vp_h).alias("gy"), wide.alias("anchor")
    ).agg(F.count("*").alias("occupancy"))
    return slots.groupBy("occupancy").agg(
        F.count("*").alias("slots"), F.sum("occupancy").alias("objects")
    )


def collision_summary(gt: DataFrame, grid: int = 16, vp_w: int = 1920, vp_h: int = 1080) -> DataFrame:
    """Unique and collided shares over all images."""
    hist = slot_collisions(gt, grid, vp_w, vp_h)
    total = F.sum("objects")
    alone = F.sum(F.when(F.col("occupancy") == 1, F.col("objects")).otherwise(0))
    return hist.agg(
        total.alias("objects"),
        alone.alias("alone"),
        (total - alone).alias("collided"),
        F.round(alone / total * 100, 2).alias("unique_pct"),
        F.round((total - alone) / total * 100, 2).alias("collided_pct"),
    )


def grid_round_trip(gt: DataFrame, ident: str, vp_w: int = 1920, vp_h: int = 1080) -> DataFrame:
    """Encode boxes to the 640 target slots and back: pixel error, and who was overwritten.

    The last writer of a slot (by ``ident``) survives, as a map-side combined ``max``.
    """

    def unit(v, whole):
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), v / whole))

    x, y, w, h = B.box()
    enc = gt.select(
        "image_id", ident, "x", "y", "w", "h",
        unit(x, vp_w).alias("x1"), unit(y, vp_h).alias("y1"),
        unit(x + F.greatest(F.lit(1), w), vp_w).alias("x2"), unit(y + F.greatest(F.lit(1), h), vp_h).alias("y2"),
    )
    ratio = F.abs(F.col("x2") - F.col("x1")) / F.greatest(F.lit(1e-4), F.abs(F.col("y2") - F.col("y1")))

    def at(name, n):
        return F.least(F.lit(n - 1), F.greatest(F.lit(0), (F.col(name) * n).cast("long")))

    fine = F.when(ratio > 1.5, 0).otherwise(256) + at("y1", 16) * 16 + at("x1", 16)
    coarse = F.when(ratio <= 1.5, 512).otherwise(576) + at("y1", 8) * 8 + at("x1", 8)
    slotted = enc.withColumn("slot", F.when(F.col("w") * F.col("h") < 120 * 120, fine).otherwise(coarse))
    back = F.greatest(
        F.abs(F.col("x1") * vp_w - x), F.abs(F.col("y1") * vp_h - y),
        F.abs((F.col("x2") - F.col("x1")) * vp_w - w), F.abs((F.col("y2") - F.col("y1")) * vp_h - h),
    )
    last = slotted.groupBy("image_id", "slot").agg(F.max(ident).alias("_last"))
    return slotted.join(last, ["image_id", "slot"]).select(
        "image_id", ident, "slot", F.round(back, 4).alias("error_px"), (F.col(ident) != F.col("_last")).alias("lost")
    )


def union_area(df: DataFrame, cell: int = 128) -> DataFrame:
    """(image_id, area): what the boxes ``x1, y1, x2, y2`` of an image cover, each point once.

    Boxes of crowded images are cut at the cells of a grid; in a cell or a calm image,
    the edges make slabs, and in a slab the intervals of the boxes that cross it are
    added up where they begin beyond all before them. Equal intervals are one, so a crowded cell holds no more
    than its pixels allow. Calm images are taken many at a time.
    """
    boxes = df.filter((F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1"))).select("image_id", "x1", "y1", "x2", "y2")
    (calm,), crowded = split_crowded(boxes)
    out = _areas_met(calm, {"area": "x1 y1 x2 y2".split()})
    return out if crowded is None else out.unionByName(_grid_area(crowded[0], cell))


def _grid_area(boxes: DataFrame, cell: int = 128) -> DataFrame:
    boxes = boxes.distinct()
    for a, b, c in (("x1", "x2", "_cx"), ("y1", "y2", "_cy")):
        boxes = boxes.withColumn(c, F.explode(F.sequence(F.floor(F.col(a) / cell), F.ceil(F.col(b) / cell) - 1)))
        low = F.col(c) * cell
        boxes = boxes.withColumns({a: F.greatest(F.col(a), low), b: F.least(F.col(b), low + cell)})
    return _slab_area(boxes.distinct(), ["image_id", "_cx", "_cy"])


def _areas(owner, n: int, x1, y1, x2, y2) -> np.ndarray:
    """Area of the union of the boxes of each of n owners, by slabs as in ``_slab_area``."""
    total = np.zeros(n, x1.dtype)
    if not len(owner):
        return total
    by_y = np.argsort(y1, kind="stable")
    owner, x1, y1, x2, y2 = (v[by_y] for v in (owner, x1, y1, x2, y2))
    of, at = np.tile(owner, 2), np.concatenate([x1, x2])
    order = np.lexsort((at, of))
    of, at = of[order], at[order]
    new = np.ones(len(at), bool)
    new[1:] = (of[1:] != of[:-1]) | (at[1:] != at[:-1])
    edge = np.empty(len(at), np.int64)
    edge[order] = np.cumsum(new) - 1
    of, at = of[new], at[new]
    first, until = edge[: len(x1)], edge[len(x1):]
    reach = until - first
    # a row for each slab that a box crosses, by slab and where the box begins there
    slab = np.arange(int(reach.sum())) + np.repeat(first - (np.cumsum(reach) - reach), reach)
    turn = np.argsort(slab, kind="stable")
    slab, box = slab[turn], np.repeat(np.arange(len(x1)), reach)[turn]
    low, high = y1[box], y2[box]
    values, rank = np.unique(high, return_inverse=True)
    most = values[np.maximum.accumulate(slab * len(values) + rank) % len(values)]
    same = slab[1:] == slab[:-1]
    low[1:][same] = np.maximum(low[1:], most[:-1])[same]
    area = (at[slab + 1] - at[slab]) * np.maximum(high - low, 0)
    ends = np.flatnonzero(np.diff(of[slab], prepend=-1))
    total[of[slab][ends]] = np.add.reduceat(area, ends)
    return total


def _image_areas(sets: dict[str, list[str]]):
    """Areas of whole images of a sorted partition; the open last image waits for its rest."""

    def areas_of(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        owner = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, table.num_rows)))
        found = []
        for columns in sets.values():
            here = table[columns[0]].is_valid().to_numpy()
            edges = (table[c].filter(pa.array(here)).to_numpy() for c in columns)
            found.append(pa.array(_areas(owner[here], len(starts), *edges)))
        image = table["image_id"].take(pa.array(starts)).combine_chunks()
        return pa.RecordBatch.from_arrays([image, *found], names=["image_id", *sets])

    def run(batches):
        carry = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = (table if carry is None else pa.concat_tables([carry, table])).combine_chunks()
            if not table.num_rows:
                continue
            image = table["image_id"].combine_chunks()
            starts = np.flatnonzero(np.r_[True, pc.not_equal(image[1:], image[:-1]).to_numpy(zero_copy_only=False)])
            carry = table.slice(starts[-1])
            if len(starts) > 1:
                yield areas_of(table.slice(0, starts[-1]), starts[:-1])
        if carry is not None:
            yield areas_of(carry, np.zeros(1, np.int64))

    return run


def _areas_met(rows: DataFrame, sets: dict[str, list[str]]) -> DataFrame:
    """(image_id, an area for each of ``sets``) of calm images, after one shuffle by image.

    A set names the edges ``x1, y1, x2, y2`` of a box; boxes without an extent cover nothing.
    """
    kinds = {}
    for name, (x1, y1, x2, y2) in sets.items():
        edges = rows.select("image_id", *(F.col(c).alias(e) for c, e in zip((x1, y1, x2, y2), ("x1", "y1", "x2", "y2"))))
        kinds[name] = dict(_slab_area(edges, ["image_id"]).dtypes)["area"]
    if not set(kinds.values()) <= {"bigint", "double"}:
        return _areas_joined(rows, sets, lambda boxes: _slab_area(boxes.distinct(), ["image_id"]))
    held = []
    for name, (x1, y1, x2, y2) in sets.items():
        real = (F.col(x2) > F.col(x1)) & (F.col(y2) > F.col(y1))
        held += [F.when(real, F.col(c).cast(kinds[name])).alias(f"{name}_{e}") for c, e in zip((x1, y1, x2, y2), "ltrb")]
    placed = rows.select("image_id", *held).repartition("image_id").sortWithinPartitions("image_id")
    schema = f"image_id {dict(rows.dtypes)['image_id']}, " + ", ".join(f"{name} {kind}" for name, kind in kinds.items())
    return placed.mapInArrow(_image_areas({name: [f"{name}_{e}" for e in "ltrb"] for name in sets}), schema)


def _slab_area(boxes: DataFrame, home: list[str]) -> DataFrame:
    edges = boxes.select(*home, F.explode(F.array("x1", "x2")).alias("at")).distinct()
    slabs = edges.withColumn("until", F.lead("at").over(Window.partitionBy(*home).orderBy("at"))).filter("until is not null")
    inside = (F.col("x1") <= F.col("at")) & (F.col("x2") >= F.col("until"))
    strips = boxes.join(slabs, home).filter(inside).select(*home, "at", "until", "y1", "y2").distinct()
    order = Window.partitionBy(*home, "at").orderBy("y1", "y2").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.coalesce(F.max("y2").over(order), F.col("y1"))
    covered = strips.select("image_id", ((F.col("until") - F.col("at")) * F.greatest(F.lit(0), F.col("y2") - F.greatest("y1", reach))).alias("area"))
    return covered.groupBy("image_id").agg(F.sum("area").alias("area"))


def _areas_joined(rows: DataFrame, sets: dict[str, list[str]], area: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``_areas_met`` with the areas joined to the images, an image without an id included, which meets nothing."""
    out = rows.select("image_id").distinct()
    for name, (x1, y1, x2, y2) in sets.items():
        edges = rows.select("image_id", *(F.col(c).alias(e) for c, e in zip((x1, y1, x2, y2), ("x1", "y1", "x2", "y2"))))
        edges = edges.filter((F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")))
        out = out.join(area(edges).withColumnRenamed("area", name), "image_id", "left")
    return out.fillna(0, list(sets))


def redaction_coverage(pii: DataFrame, pad: int = 2, vp_w: int = 800, vp_h: int = 450) -> DataFrame:
    """Area truly sensitive against area filled (with padding), per image, each point counted once.

    Boxes are padded, clipped to the viewport, and then united. A box outside of the
    viewport fills nothing; an image where nothing is filled has no precision.
    """
    x, y, w, h = B.box()
    # the passes that follow go over boxes that may come from a costly step
    pii = written(pii.select("image_id", "x", "y", "w", "h"), "sensitive")
    left, top = F.greatest(F.lit(0), x - pad), F.greatest(F.lit(0), y - pad)
    # as published: the padded size is kept where the corner is clipped
    right, bottom = F.least(F.lit(vp_w), left + w + 2 * pad), F.least(F.lit(vp_h), top + h + 2 * pad)
    edges = {"sensitive": (x, y, x + w, y + h), "filled": (left, top, right, bottom)}
    sets = {name: [f"{name}_{e}" for e in ("x1", "y1", "x2", "y2")] for name in edges}
    boxes = pii.select("image_id", *(v.alias(c) for name in edges for v, c in zip(edges[name], sets[name])))
    (calm,), crowded = split_crowded(boxes)
    sums = _areas_met(calm, sets)
    if crowded is not None:
        sums = sums.unionByName(_areas_joined(crowded[0], sets, _grid_area))
    benign = vp_w * vp_h - F.col("sensitive")
    caught = F.least(F.col("sensitive"), F.col("filled"))
    return sums.select(
        "image_id",
        "sensitive",
        "filled",
        F.round(caught / F.nullif(F.col("filled"), F.lit(0)), 6).alias("precision"),
        F.round(caught / F.nullif(F.col("sensitive"), F.lit(0)), 6).alias("recall"),
        F.when(benign > 0, F.round((F.col("filled") - F.col("sensitive")) / benign, 6)).alias("over_redaction"),
    )
