"""Cheap conditions before the patterns change no match."""

import re

import pytest
from pyspark.sql import functions as F

from veilgrain import constants as K
from veilgrain.functions import text as X
from veilgrain.operators import detect, leaks

ODD = ["a.b@c.de", "-x@y.zz", "éa@b.co", "é.a@b.co", "_a@b.co", "a@b@c.de x", "%40a@b.cd!", "x a@b.cd", "a@b.c", "..a@b.cd.ef.", "a\tb+c@d-e.fgh1 q@r.st", "@", "no mark", "a@b .cd", "", "x@y.zz x@y.zz"]


def test_addresses_of_odd_texts(spark):
    frame = spark.createDataFrame(list(enumerate(ODD)), "id int, text string")
    found = frame.select("id", X.all_matches(F.col("text"), K.EMAIL_PATTERN).alias("m"), leaks._candidates(F.col("text")).alias("c"))
    for r in found.collect():
        want = re.findall(K.EMAIL_PATTERN, ODD[r.id], re.ASCII)
        assert r.m == want, ODD[r.id]
        assert [c.value for c in r.c if c.kind == "EMAIL"] == list(dict.fromkeys(w.lower() for w in want)), ODD[r.id]
    assert "Contains(" in found.select("c")._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("text, want", [
    ("NAME: Ann Lee a@b.cd", {"NAME": "Ann Lee", "EMAIL": "a@b.cd"}),
    ("name here, John Smith", {"NAME": "John Smith"}),
    ("12:30 JOHN SMITH (212) 555-0187", {"NAME": "JOHN SMITH", "PHONE": "212) 555-0187"}),
    ("4111 1111-1111 1111", {"CREDIT_CARD": "4111 1111-1111 1111"}),
    ("K1234567 PassWord: x1", {"GOVT_ID": "K1234567", "PASSWORD": "PassWord: x1"}),
    ("nothing", {}),
])
def test_regions_are_read_as_before(spark, text, want):
    row = spark.createDataFrame([(text,)], "text string").select(detect.region_entities(F.col("text")).alias("e")).first()
    assert {e.kind: e.raw_value for e in row.e} == want
