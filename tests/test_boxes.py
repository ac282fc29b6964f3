"""Geometry and matching against plain Python on random scenes."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from veilgrain.functions import ranks
from veilgrain.operators import evaluate, geometry


def iou(a, b):
    w = max(0, min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0]))
    h = max(0, min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1]))
    union = a[2] * a[3] + b[2] * b[3] - w * h
    return w * h / union if union else 0.0


def scene(rng, images, n, tag):
    return [
        (i, f"{tag}{k:03d}", rng.randrange(3), rng.randrange(400), rng.randrange(300), rng.randrange(20, 160), rng.randrange(20, 120), rng.randrange(20) / 20)
        for i in range(images)
        for k in range(n)
    ]


SCHEMA = "image_id long, {}_id string, cls int, x long, y long, w long, h long, conf double"


@pytest.fixture(scope="module")
def frames(spark):
    rng = random.Random(5)
    gt, pred = scene(rng, 12, 15, "g"), scene(rng, 12, 25, "p")
    return gt, pred, spark.createDataFrame(gt, SCHEMA.format("gt")), spark.createDataFrame(pred, SCHEMA.format("pred"))


def greedy_nms(rows, thr, aware):
    kept = []
    for r in sorted(rows, key=lambda r: (-r[7], r[1])):
        if all((aware and k[2] != r[2]) or iou(k[3:7], r[3:7]) < thr for k in kept):
            kept.append(r)
    return {(r[0], r[1]) for r in kept}


@pytest.mark.parametrize("aware", [True, False])
@pytest.mark.parametrize("cell", [256, 20])
def test_nms(frames, aware, cell):
    _, pred, _, df = frames
    want = set()
    for i in range(12):
        want |= greedy_nms([r for r in pred if r[0] == i], 0.4, aware)
    got = geometry.nms(df, "pred_id", 0.4, aware, cell)
    assert {(r.image_id, r.pred_id) for r in got.collect()} == want


def test_greedy_match(frames):
    gt, pred, g, p = frames
    want = set()
    for i in range(12):
        free = {r[1]: True for r in gt if r[0] == i}
        for q in sorted((r for r in pred if r[0] == i), key=lambda r: r[1]):
            best, score = None, 0.0
            for r in sorted((r for r in gt if r[0] == i), key=lambda r: r[1]):
                v = iou(r[3:7], q[3:7])
                if v > score:
                    best, score = r[1], v
            if score >= 0.3 and free[best]:
                free[best] = False
                want.add((i, q[1]))
    got = evaluate.greedy_match(g, p).filter("tp").collect()
    assert {(r.image_id, r.pred_id) for r in got} == want


def test_merge(frames):
    _, pred, _, df = frames
    want = set()
    for i in range(12):
        rows = sorted((r for r in pred if r[0] == i), key=lambda r: r[1])
        used = set()
        for r in rows:
            if r[1] in used:
                continue
            used.add(r[1])
            x1, y1, x2, y2 = r[3], r[4], r[3] + r[5], r[4] + r[6]
            again = True
            while again:
                again = False
                for o in rows:
                    if o[1] not in used and x1 < o[3] + o[5] and x2 > o[3] and y1 < o[4] + o[6] and y2 > o[4]:
                        x1, y1, x2, y2 = min(x1, o[3]), min(y1, o[4]), max(x2, o[3] + o[5]), max(y2, o[4] + o[6])
                        used.add(o[1])
                        again = True
            want.add((i, r[1], x1, y1, x2 - x1, y2 - y1))
    got = geometry.merge_overlapping(df, "pred_id").collect()
    assert {(r.image_id, r.pred_id, r.x, r.y, r.w, r.h) for r in got} == want


def test_merge_across_batches(spark, frames):
    _, _, _, df = frames
    whole = geometry.merge_overlapping(df, "pred_id").collect()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        cut = geometry.merge_overlapping(df, "pred_id").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(map(tuple, whole)) == sorted(map(tuple, cut))


def test_all_relations(frames):
    gt, _, g, _ = frames
    rows = geometry.spatial_relations(g, "gt_id", directional="all").collect()
    got = {(r.image_id, r.src, r.dst, r.relation) for r in rows}
    assert len(got) == len(rows)
    for i in range(12):
        boxes = [r for r in gt if r[0] == i]
        for a in boxes:
            for b in boxes:
                if a[1] != b[1]:
                    assert ((i, a[1], b[1], "ABOVE") in got) == (a[4] + a[6] <= b[4] + 12)


def test_redaction_area(spark):
    rows = [(1, 10, 20, 60, 12), (1, 300, 20, 45, 18), (1, 600, 400, 33, 7), (1, 100, 700, 81, 25)]
    df = spark.createDataFrame(rows, "image_id long, x long, y long, w long, h long")
    out = geometry.redaction_coverage(df).first()
    assert out.sensitive == sum(w * h for _, _, _, w, h in rows)
    # the last box lies below the viewport
    assert out.filled == sum((w + 4) * (h + 4) for _, _, _, w, h in rows[:3])
    assert out.recall == round(out.filled / out.sensitive, 6)


def test_exact_quantiles(spark):
    rng = random.Random(2)
    values = [rng.choice([rng.random(), 0.25]) for _ in range(501)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = ranks.value_ranks(df, [], "v").agg(
        ranks.nearest_rank("v", 0.95).alias("p95"), ranks.linear_quantile("v", 0.5).alias("p50"), F.sum("n").alias("n")
    ).first()
    ordered = sorted(values)
    assert got.n == 501 and got.p50 == pytest.approx(ordered[250]) and got.p95 == ordered[-(-501 * 95 // 100) - 1]


def test_ranks_do_not_care_how_values_crowd(spark):
    rng = random.Random(4)
    values = [0.999 + rng.random() / 1000 for _ in range(990)] + [rng.random() for _ in range(9)] + [1e18]
    rows = [(k % 3 if k % 5 else None, v) for k, v in enumerate(values)] + [(1, None)]
    df = spark.createDataFrame(rows, "g long, v double").repartition(4)
    placed = ranks.ranged(df.filter("v is not null").groupBy("g", "v").agg(F.count("*").alias("n")), ["g"], ["v"])
    sizes = [r.n for r in placed.groupBy("_range").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 1 or max(sizes) < 4 * len(values) / len(sizes)
    got = ranks.value_ranks(df, ["g"], "v").groupBy("g").agg(
        ranks.at_rank("v", F.floor(F.col("total") / 2) + 1).alias("median"), F.max("total").alias("total"), F.max("upto").alias("last")
    )
    for r in got.collect():
        own = sorted(v for g, v in rows if g == r.g and v is not None)
        assert (r.median, r.total, r.last) == (own[len(own) // 2], len(own), len(own))
    ordered = ranks.value_ranks(df, [], "v").collect()
    assert sorted((r.v, r.upto) for r in ordered) == [(v, k + 1) for k, v in enumerate(sorted(values))]


def test_running_backward(spark):
    rng = random.Random(6)
    rows = [(k % 2, float(o), rng.random()) for k in range(2) for o in rng.sample(range(500), 200)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed = ranks.ranged(spark.createDataFrame(rows, "g long, o double, x double"), ["g"], ["o"])
        got = ranks.running(placed, ["g"], ["o"], {"top": "x"}, F.max, backward=True).collect()
        assert len({r._range for r in got}) > 2
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for r in got:
        assert r.top == max(x for g, o, x in rows if g == r.g and o >= r.o)


def test_direction_counts_of_thin_and_crowded_boxes(spark):
    rng = random.Random(8)
    rows = [(1, k, rng.randrange(200), rng.randrange(80) / 2, rng.randrange(1, 30), rng.randrange(1, 30)) for k in range(300)]
    rows += [(2, 1000 + k, 5, 5, 4, 4) for k in range(200)] + [(3, 5000, 1, 1, 1, 1)]
    frame = spark.createDataFrame([(i, k, float(x), float(y), float(w), float(h)) for i, k, x, y, w, h in rows], "image_id long, id long, x double, y double, w double, h double")

    def sign(a, b, p, s):
        return 1 if a[p] + a[s] <= b[p] + 12 else -1 if b[p] + b[s] <= a[p] + 12 else 0

    want = {}
    for a in rows:
        vert = [sign(a, b, 3, 5) for b in rows if b[0] == a[0] and b[1] != a[1]]
        horiz = [sign(a, b, 2, 4) for b in rows if b[0] == a[0] and b[1] != a[1]]
        want[a[1]] = (vert.count(1), vert.count(-1), horiz.count(1), horiz.count(-1))
    got = {r.id: (r.n_above, r.n_below, r.n_left, r.n_right) for r in geometry.direction_counts(frame, "id").collect()}
    assert got == want


def test_alignment_runs_give_back_the_pairs(spark, frames):
    gt, _, g, _ = frames
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        runs = geometry.alignment_runs(g, "gt_id").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(runs) == 6 * len(gt)
    by_run = {}
    for r in runs:
        by_run.setdefault((r.image_id, r.line, r.run), []).append(r)
    assert all(len(v) == v[0].members for v in by_run.values())
    pairs = {(a.image_id, a.gt_id, b.gt_id) for v in by_run.values() for a in v for b in v if a.gt_id != b.gt_id and abs(a.at - b.at) <= 8}
    listed = geometry.spatial_relations(g, "gt_id").filter("relation = 'ALIGNED_WITH'").collect()
    assert pairs == {(r.image_id, r.src, r.dst) for r in listed}


def test_neighbourhood_against_all_pairs(spark):
    rng = random.Random(12)
    rows = []
    for image, n, span in ((1, 40, 3000), (2, 150, 300), (3, 2, 20000), (4, 1, 5), (5, 60, 1)):
        for _ in range(n):
            at = [float(rng.randrange(span)) for _ in range(2)]
            rows.append((image, len(rows), *at, float(rng.randrange(20, 200)), rng.randrange(300) / 100, rng.randrange(100) / 100))
    frame = spark.createDataFrame(rows + [(6, 9999, None, None, None, None, None)], "image_id long, id long, x double, y double, w double, aspect double, fill double")
    got = {r.id: (r.isolation, r.alignment, r.similarity) for r in geometry.neighbourhood_stats(frame, "id").collect()}
    for a in rows:
        others = [b for b in rows if b[0] == a[0] and b[1] != a[1]]
        near = min((((a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2) ** 0.5 for b in others), default=500.0)
        aligned = sum(any(abs(a[k] - b[k]) <= 10 for k in (2, 3, 4)) for b in others)
        similar = sum(abs(a[5] - b[5]) <= 0.3 and abs(a[6] - b[6]) <= 0.2 for b in others)
        assert got[a[1]] == (int(near + 0.5), min(1, aligned / 4), min(1, similar / 4)), a
    assert got[9999] == (500, 0, 0)


def test_a_crowded_image_has_no_pairs(spark):
    crowd = spark.range(50000).selectExpr(
        "1L as image_id", "id", "double(id % 250) as x", "double(id div 250) as y", "double(20 + id % 7) as w", "double(id % 9) / 3 as aspect", "double(id % 5) / 10 as fill"
    )
    got = geometry.neighbourhood_stats(crowd, "id").groupBy("isolation", "alignment", "similarity").count().collect()
    assert [tuple(r) for r in got] == [(1, 1.0, 1.0, 50000)]


def test_one_cluster_of_many_boxes(spark):
    # a staircase that one box climbs step by step, and boxes beside it that stay free until it passes
    stairs = spark.range(60000).selectExpr("1L as image_id", "id", "double(3 * id) as x", "double(3 * id) as y", "4.0D as w", "4.0D as h")
    got = geometry.merge_overlapping(stairs, "id").collect()
    assert [(r.id, r.x, r.w, r.h, r.members) for r in got] == [(0, 0.0, 180001.0, 180001.0, 60000)]


def test_union_area(spark):
    rng = random.Random(9)
    rows = [(i, *(rng.randrange(300) for _ in range(2)), rng.randrange(0, 90), rng.randrange(0, 90)) for i in range(4) for _ in range(12)]
    rows += [(9, 100, 100, 34, 16), (9, 135, 100, 34, 16)]
    frame = spark.createDataFrame(rows, "image_id long, x long, y long, w long, h long")
    spans = frame.selectExpr("image_id", "x as x1", "y as y1", "x + w as x2", "y + h as y2")
    want = {}
    for i, x, y, w, h in rows:
        want.setdefault(i, set()).update((a, b) for a in range(x, x + w) for b in range(y, y + h))
    for cell in (16, 128):
        assert {r.image_id: r.area for r in geometry.union_area(spans, cell).collect()} == {i: len(v) for i, v in want.items()}
    near = geometry.redaction_coverage(frame.filter("image_id = 9")).first()
    assert (near.sensitive, near.filled) == (2 * 34 * 16, 73 * 20)


def test_calm_images_are_merged_and_measured_together(monkeypatch):
    """redaction_coverage took its time building an index for each image; calm ones go many at a time."""
    rng = np.random.default_rng(3)
    image = np.repeat(np.arange(40), rng.integers(1, 30, 40))
    rows = pd.DataFrame({"image_id": image, "_sx": 0, "_sy": 0, "ord": [f"{k:04d}" for k in range(len(image))]})
    for c, most in (("x", 300), ("y", 300), ("w", 90), ("h", 90)):
        rows[c] = rng.integers(1, most, len(image))
    want = []
    for k, part in rows.groupby("image_id"):
        x1, y1 = part["x"].to_numpy(float), part["y"].to_numpy(float)
        merged = geometry._merge_cluster(x1, y1, x1 + part["w"].to_numpy(), y1 + part["h"].to_numpy())
        want += [(k, part["ord"].iloc[i], *rest) for i, *rest in merged]
    monkeypatch.delattr(geometry, "_BoxTree")
    found = pd.concat(geometry._merge_batches(iter([rows[:100], rows[100:]])))
    assert sorted(found.itertuples(index=False, name=None)) == sorted(want)
    corners = [rows[c].to_numpy() for c in "xy"] + [(rows[a] + rows[b]).to_numpy() for a, b in ("xw", "yh")]
    for kind in (np.int64, float):
        area = geometry._areas(image, 40, *(v.astype(kind) for v in corners))
        for k in range(40):
            pixels = {(a, b) for x1, y1, x2, y2 in zip(*(v[image == k].tolist() for v in corners), strict=True) for a in range(x1, x2) for b in range(y1, y2)}
            assert area[k] == len(pixels)


def test_coverage_of_images_that_fill_nothing(spark):
    rows = [(1, 5, 5, 10, 10), (2, 5, 5, 0, 7), (3, 900, 900, 4, 4), (None, 5, 5, 10, 10), (5, None, 5, 10, 10)]
    rows += [(7, 2 * k, 0, 1, 1) for k in range(geometry.CALM + 1)]
    want = {1: (100, 196), 2: (0, 44), 3: (16, 0), None: (0, 0), 5: (0, 196), 7: (129, 259 * 5)}
    for kind in ("long", "double", "decimal(9,2)"):
        frame = spark.createDataFrame(rows, "image_id long, x long, y long, w long, h long").select("image_id", *(F.col(c).cast(kind).alias(c) for c in "xywh"))
        if kind.startswith("decimal"):  # in calm images only
            frame, want = frame.filter("image_id < 7"), {k: v for k, v in want.items() if k and k < 7}
        got = {r.image_id: (r.sensitive, r.filled) for r in geometry.redaction_coverage(frame).collect()}
        assert got == want, kind


def test_nms_edges(spark):
    rows = [(1, k, 0, 5, 5, 10, 10, 0.5) for k in range(4)] + [(1, 9, 0, 5, 5, 0, 4, 0.9), (1, 10, 0, 5, 5, 0, 4, 0.9), (1, 11, 0, 6, 5, 10, 10, None)]
    frame = spark.createDataFrame(rows, "image_id long, id long, cls int, x long, y long, w long, h long, conf double")
    assert sorted(r.id for r in geometry.nms(frame, "id", 0.4).collect()) == [0, 9, 10]
    assert geometry.nms(frame.limit(0), "id").count() == 0
    with pytest.raises(ValueError):
        geometry.nms(frame, "id", 0.0)
