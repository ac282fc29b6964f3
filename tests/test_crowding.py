"""Calm images meet directly, crowded ones on grids and sorted ranges: the same rows, and few shuffles."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from veilgrain.operators import actions, evaluate, geometry
from veilgrain.sources import html

SCHEMA = "image_id long, {}_id string, cls int, x long, y long, w long, h long, conf double"


def boxes(rng, tag):
    rows = []
    for image, n in ((0, 3), (1, 30), (2, 12), (3, 60)):
        for k in range(n):
            rows.append((image, f"{tag}{k:03d}", rng.randrange(3), rng.randrange(400), rng.randrange(300), rng.randrange(5, 160), rng.randrange(5, 120), rng.randrange(20) / 20))
    return rows


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(9)
    gt, pred = boxes(rng, "g"), boxes(rng, "p")
    return spark.createDataFrame(gt, SCHEMA.format("gt")), spark.createDataFrame(pred, SCHEMA.format("pred"))


def bound(g, p):
    regions = p.select(
        "image_id", F.col("pred_id").alias("region_id"), F.col("pred_id").alias("region_ord"),
        F.when(F.col("cls") == 0, "VISUAL_BUTTON").when(F.col("cls") == 1, "VISUAL_INPUT").otherwise("VISUAL_CARD").alias("region_type"),
        F.when(F.col("x") % 3 == 0, F.concat(F.lit("Item "), F.col("cls").cast("string"))).alias("region_text"), "x", "y", "w", "h",
    )
    acts = g.select(
        "image_id", F.concat_ws("/", F.col("image_id").cast("string"), "gt_id").alias("action_id"),
        F.when(F.col("cls") == 0, "CLICK").when(F.col("cls") == 1, "TYPE").otherwise("none such").alias("action"),
        F.concat(F.lit("use item "), (F.col("y") % 3).cast("string")).alias("reasoning"),
        F.when(F.col("w") % 2 == 0, F.col("x") + 3).alias("click_x"), F.when(F.col("w") % 2 == 0, F.col("y") + 3).alias("click_y"),
    )
    return actions.bind_actions(acts, regions)


def coverage(g, p):
    return geometry.redaction_coverage(g.select("image_id", "x", "y", "w", "h"), 2, 500, 400)


OPERATORS = {
    "overlap_pairs": lambda g, p: geometry.overlap_pairs(g, p),
    "touching": lambda g, p: geometry.overlap_pairs(g, p, touching=True),
    "greedy": lambda g, p: evaluate.greedy_match(g, p),
    "greedy_by_confidence": lambda g, p: evaluate.greedy_match(g, p, by_confidence=True, same_class=True),
    "best": lambda g, p: evaluate.best_match(g, p),
    "best_of_class": lambda g, p: evaluate.best_match(g, p, same_class=True),
    "precision": lambda g, p: evaluate.average_precision(g, p, (0.1, 0.5)),
    "causes": lambda g, p: evaluate.failure_taxonomy(g, p),
    "relations": lambda g, p: geometry.spatial_relations(g, "gt_id"),
    "directions": lambda g, p: geometry.direction_counts(g, "gt_id"),
    "runs": lambda g, p: geometry.alignment_runs(g, "gt_id"),
    "merged": lambda g, p: geometry.merge_overlapping(g, "gt_id"),
    "coverage": coverage,
    "nms": lambda g, p: geometry.nms(p, "pred_id"),
    "nms_agnostic": lambda g, p: geometry.nms(p, "pred_id", class_aware=False),
    "bound": bound,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_calm_and_crowded_images_give_the_same_rows(tables, monkeypatch, name):
    found = []
    for calm in (128, 20, 0):
        monkeypatch.setattr(geometry, "CALM", calm)
        df = OPERATORS[name](*tables)
        found.append(sorted(map(repr, (tuple(r) for r in df.select(*sorted(df.columns)).collect()))))
    assert found[0] and found[0] == found[1] == found[2]


#: Shuffles of the plan of each operator; the grid and the sorted ranges took more, of more rows.
SHUFFLES = {"greedy": 2, "best": 2, "relations": 2, "directions": 2, "runs": 1, "merged": 1, "nms": 1, "bound": 2}


@pytest.mark.parametrize("name", SHUFFLES)
def test_calm_images_are_shuffled_once(spark, tables, name):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = OPERATORS[name](*tables)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") <= SHUFFLES[name]


def test_rows_that_come_twice_and_rows_without_image_stay(spark):
    gt = spark.createDataFrame([(1, "a", 0, 0, 0, 10, 10, 0.5)] * 2 + [(None, "b", 0, 0, 0, 10, 10, 0.5)], SCHEMA.format("gt"))
    pred = spark.createDataFrame([(1, "p", 0, 1, 1, 10, 10, 0.5)] * 2 + [(None, "q", 0, 0, 0, 10, 10, 0.5)], SCHEMA.format("pred"))
    assert sorted((r.pred_id, r.gt_id, r.tp) for r in evaluate.greedy_match(gt, pred).collect()) == [("p", "a", True), ("q", None, False)]
    assert sorted((r.gt_id, r.pred_id) for r in evaluate.best_match(gt, pred).collect()) == [("a", "p"), ("b", None)]
    assert geometry.nms(pred.filter("image_id is not null"), "pred_id").count() == 2


def test_boxes_of_unknown_place_do_not_hide_others_from_merging(spark, monkeypatch):
    rows = [(1, f"b{k:02d}", 0, None if k % 7 == 0 else k * 15, k * 4, 30, 20, 0.5) for k in range(40)]
    df = spark.createDataFrame(rows, SCHEMA.format("gt"))
    found = []
    for calm in (128, 0):
        monkeypatch.setattr(geometry, "CALM", calm)
        found.append(sorted(map(repr, geometry.merge_overlapping(df, "gt_id").collect())))
    assert found[0] == found[1] and len(found[0]) < 15


def test_pages_are_handed_back_in_pieces():
    page = "<body>" + "<p>x</p>" * 100 + "</body>"
    batch = pd.DataFrame({"page_id": range(200), "html": [page] * 200})
    sizes = [len(piece) for piece in html._parse(iter([batch]))]
    assert sum(sizes) == 20_000 and max(sizes) <= 4096


def test_runs_meet_the_truth_of_their_image(tables, monkeypatch):
    """compare_detectors filled the disk: truth and detections were shuffled once for each configuration they are in."""
    gt, pred = tables
    runs = evaluate.detector_configs(pred, "pred_id", 500, 400)
    assert runs.columns == ["pred_id", "cls", "conf", "x", "y", "w", "h", "run"]
    of_image = runs.withColumn("image_id", F.expr("run div 3"))
    shown = ["image_id", "run", "pred_id", "cls", "conf", "iou", "gt_id", "tp"]
    apart = [tuple(r) for k in range(3) for r in evaluate.greedy_match(gt, of_image.filter(f"run % 3 = {k}")).withColumn("run", F.col("image_id") * 3 + k).select(shown).collect()]
    for calm in (geometry.CALM, 5):
        monkeypatch.setattr(geometry, "CALM", calm)
        assert sorted(map(str, apart)) == sorted(str(tuple(r)) for r in evaluate.greedy_match(gt, of_image, run="run").select(shown).collect())
        rated = {(r.config, r.cls): (r.gt, r.tp) for r in evaluate.compare_detectors(gt, runs).collect()}
        hit = {(r[1] % 3, r[6]) + r[:1] for r in apart if r[7]}
        assert [rated[c, None] for c in evaluate.CONFIGS] == [(gt.count(), sum(x[0] == k for x in hit)) for k in range(3)]
