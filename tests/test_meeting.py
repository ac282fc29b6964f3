"""Searches in which pairs meet on what is rare."""

import random

from pyspark.sql import functions as F

from veilgrain.operators import actions, audits


def test_mentioned(spark):
    rng = random.Random(2)
    words = ["pay", "a", "ab", "now", "paynow", "the big one", "button", "butt", "é", "no"]
    texts = [(i, w) for i in range(2) for w in words]
    reasons = [(i, " ".join(rng.choice(words + ["x", "click"]) for _ in range(rng.randrange(1, 6)))) for i in range(2) for _ in range(30)]
    t = spark.createDataFrame(texts, "image long, _text string")
    r = spark.createDataFrame(sorted(set(reasons)), "image long, _reason string")
    got = {(x.image, x._reason, x._text) for x in actions.mentioned(r, t, ["image"]).collect()}
    assert got == {(i, a, b) for i, a in set(reasons) for j, b in texts if i == j and b in a}


def test_many_texts_and_actions_in_one_image(spark):
    n = 10000
    texts = spark.range(n).select(F.lit(1).alias("image"), F.concat(F.lit("label "), F.sha1(F.col("id").cast("string"))).alias("_text"))
    reasons = spark.range(n).select(F.lit(1).alias("image"), F.concat(F.lit("press label "), F.sha1((F.col("id") + n // 2).cast("string")), F.lit(" now")).alias("_reason"))
    found = actions.mentioned(reasons, texts, ["image"])
    assert found.count() == n // 2


def test_a_gram_that_is_everywhere_brings_no_pairs(spark):
    common = "one two three four five six seven eight"
    rng = random.Random(1)
    own = {k: " ".join(f"w{rng.randrange(10**6)}" for _ in range(30)) for k in range(40)}
    items = spark.createDataFrame([(k, f"{common} {t}") for k, t in own.items()], "item_id long, text string")
    rows = [(k, f"{common} {rng.random()} filler") for k in range(300)] + [(1000 + k, f"{own[k]} and {common}") for k in range(5)]
    rows += [(2000, own[7].rsplit(" ", 12)[0]), (2001, None), (2002, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r.containment for r in audits.benchmark_containment(docs, items, "doc_id", "item_id", 0.3).collect()}
    want = {
        (r.doc_id, r.item_id): r.containment
        for r in audits.benchmark_leakage(docs, items, "doc_id", "item_id").collect()
        if r.containment >= 0.3 - 1e-6
    }
    assert got == want and set(got) == {(1000 + k, k) for k in range(5)} | {(2000, 7)}
    assert audits.benchmark_containment(docs.limit(0), items, "doc_id", "item_id").count() == 0
