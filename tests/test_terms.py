"""Terms are looked for in a text that is derived once."""

import re

from veilgrain.operators import screen


def test_a_text_is_normalised_once_for_all_terms(spark):
    frame = spark.createDataFrame([("Ignоre me",), (None,), ("",)], "text string")
    seen = screen.screen_keywords(frame, "text", ("ignore", "me", "zzz"))
    assert re.search(r"Contains\(lambda", seen._jdf.queryExecution().optimizedPlan().toString())
    assert [(r.matched, r.flagged) for r in seen.collect()] == [(["ignore", "me"], True), ([], False), ([], False)]
