"""Security verdicts fail closed: with any one input unknown, what passed no longer passes."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from veilgrain.operators import actions, detect, leaks
from veilgrain.streaming import streams

NOW = datetime(2024, 1, 1, 12)


def without(frame, column):
    return frame.withColumn(column, F.lit(None).cast(frame.schema[column].dataType))


def test_grounding(spark):
    row = ("r", "VISUAL_BUTTON", "CLICK", NOW, NOW + timedelta(seconds=2), 15, 15, 10, 10, 20, 20, 12, 11, 20, 20)
    names = "region_id region_type action bound_ts now_ts bound_x bound_y rx ry rw rh lx ly lw lh".split()
    frame = spark.createDataFrame([row], names)

    def verdict(f):
        return actions.verify_grounding(f).first().verdict

    assert verdict(frame) == "OK"
    for column in names:
        # an absent action is a click, and a point that was never given lies outside of nothing
        assert (verdict(without(frame, column)) == "OK") == (column == "action"), column
    assert verdict(without(without(frame, "bound_x"), "bound_y")) == "OK"


def test_navigation(spark):
    names = "use_id task_id tab_id anchor_tab_id anchor_origin current_origin decision confirm_ts use_ts".split()
    row = (1, 7, 1, 1, "https://a.example", "https://a.example", "CONFIRM", NOW, NOW + timedelta(seconds=30))
    uses = spark.createDataFrame([row], names)
    moves = spark.createDataFrame([(7, NOW - timedelta(seconds=5))], "task_id long, nav_ts timestamp")

    def verdicts(u, m):
        return [r.verdict for r in actions.navigation_binding(u, m).collect()]

    assert verdicts(uses, moves) == ["OK"]
    for column in names:
        assert verdicts(without(uses, column), moves) not in (["OK"], []), column
    assert verdicts(uses, without(moves, "nav_ts")) == ["NAVIGATED"]
    assert verdicts(without(uses.withColumn("decision", F.lit("ALLOW")), "confirm_ts"), moves) == ["OK"]


def test_attestations(spark):
    image = "data:image/png;base64,AA"
    images = spark.createDataFrame([("k", "t", "c", image, "VERIFIED_SAFE")], "key string, task_id string, capture_id string, image string, state string")
    held = spark.createDataFrame([("k", "t", "c", "SANITIZED")], "key string, task_id string, capture_id string, status string")
    held = held.withColumn("digest", F.sha2(F.lit(image), 256))

    def verdict(i, a):
        (row,) = leaks.check_attestations(i, a, ["key"]).collect()
        assert (row.image is None) == (row.verdict != "OK")
        return row.verdict

    assert verdict(images, held) == "OK"
    for column in images.columns:
        assert verdict(without(images, column), held) != "OK", column
    for column in held.columns:
        assert verdict(images, without(held, column)) != "OK", column
    assert verdict(without(images, "task_id"), without(held, "task_id")) == "WRONG_TASK"


def test_targets(spark):
    before = spark.createDataFrame([(1, "https://a.example", "CLICK")], "node long, origin string, action string")
    after = spark.createDataFrame(
        [(1, "https://a.example", "go", "text", "x", 5, 5)], "node long, origin string, id_attr string, input_type string, data_action string, w int, h int"
    )

    def verdict(b, a):
        return actions.recheck_targets(b, a, ["node"]).first().verdict

    assert verdict(before, after) == "OK"
    for column in ("origin", "action"):
        assert verdict(without(before, column), after) != "OK", column
    for column in ("origin", "w", "h"):
        assert verdict(before, without(after, column)) != "OK", column
    password = after.withColumn("input_type", F.lit("password"))
    assert verdict(without(before, "action"), password) == "MUTATED"
    assert verdict(before.withColumn("action", F.lit("WAIT")), without(after, "w")) == "OK"


@pytest.mark.parametrize("column", ["w", "h", "text"])
def test_media_of_unknown_size(spark, column):
    schema = "page_id long, node_ord int, tag string, text string, attributes map<string,string>, w int, h int"
    nodes = spark.createDataFrame([(1, 0, "img", "", {}, 100, 100), (1, 1, "svg", "", {}, 100, 100)], schema)
    assert detect.unverified_media(nodes).count() == 2
    assert detect.unverified_media(without(nodes, column)).count() == 2


def test_staleness(spark):
    frame = spark.createDataFrame([(NOW, NOW + timedelta(seconds=1))], "a timestamp, b timestamp")
    assert frame.select(streams.staleness("a", "b").alias("r")).first().r == "fresh"
    for column in ("a", "b"):
        assert without(frame, column).select(streams.staleness("a", "b").alias("r")).first().r == "stale"
