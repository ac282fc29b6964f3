"""Scans, leaks, origins and tokens on small literal frames."""

import base64
import json
from urllib.parse import quote

import pytest
from pyspark.sql import functions as F

from veilgrain.functions import text as X
from veilgrain.operators import detect, leaks, ledger, policy, screen

ENTITIES = [
    ("NAME", "Zoë Aßmann", "TOKENIZE"),
    ("NAME", "Ravi Okonkwo", "TOKENIZE"),
    ("EMAIL", "ravi.o@mail.example", "ABSTRACT"),
    ("PHONE", "(212) 555-0142", "TOKENIZE"),
    ("PASSWORD", "gr8=Pear&9", "REMOVE"),
    ("NAME", "Public Person", "KEEP"),
]


def b64(text, charset="utf-8"):
    return base64.b64encode(text.encode(charset)).decode()


def cases():
    """(name, payload, clean): every raw value in every dress, and look-alikes that are harmless."""
    for kind, value, treatment in ENTITIES:
        clean = treatment == "KEEP"
        yield f"raw {value}", f"so {value}.", clean
        yield f"base64 {value}", b64(f"so {value}."), clean
        yield f"base64 on two lines {value}", b64(f"a longer note that ends with {value}")[:20] + "\n" + b64(f"a longer note that ends with {value}")[20:], clean
        yield f"base64 of many {value}", b64("filler words " * 1200 + value), clean
        yield f"percent {value}", quote(f"<{value}>", safe=""), clean
        yield f"base64 of percent {value}", b64(quote(value, safe="")), clean
        yield f"base64 four times {value}", b64(b64(b64(b64(f"so {value}.")))), clean
        yield f"key {value}", json.dumps([{value: kind}]), clean
        yield f"nested {value}", json.dumps([[[[[{"k": [value]}]]]]], ensure_ascii=False), clean
    yield "latin base64", b64("Zoë Aßmann", "latin-1"), False
    yield "beside a mark", "[REDACTED] and Ravi Okonkwo", False
    yield "escaped", "".join(f"\\u{ord(c):04x}" for c in "Ravi Okonkwo"), False
    yield "escaped for long", "".join(f"\\u{ord(c):04x}" for c in "many words " * 2000 + "Ravi Okonkwo"), False
    yield "long JSON", json.dumps({"a\\": ['say "' + "x\n\\" * 20000 + '"', "Ravi Okonkwo"]}), False
    yield "only marks", "EMAIL#00FF [REDACTED:NAME]", True
    yield "harmless base64", b64("nothing to see here"), True
    yield "harmless percent", "a%20b%3Fc", True
    yield "numbers", json.dumps({"n": [None, 3.5, True]}), True
    yield "broken json", '{"a": ["x"', True


PAYLOADS = list(cases())


@pytest.fixture(scope="module")
def audited(spark):
    ents = spark.createDataFrame([("t", *e) for e in ENTITIES], "task_id string, kind string, raw_value string, treatment string")
    rows = spark.createDataFrame([(n, "t", p) for n, p, _ in PAYLOADS], "name string, task_id string, text string")
    strings = rows.select("name", "task_id", F.explode(leaks.payload_strings(F.col("text"))).alias("text"))
    return strings, leaks.sensitive_targets(ents)


def test_leak_cases(audited):
    strings, targets = audited
    bad = {r.name for r in leaks.find_leaks(leaks.string_variants(strings), targets).collect()}
    assert bad == {n for n, _, clean in PAYLOADS if not clean}


def test_grams_are_sought_or_formed_alike(audited, monkeypatch):
    """gate_payloads took its time cutting every text into letters; a task's few grams are sought instead."""
    strings, targets = audited
    variants = leaks.string_variants(strings)
    columns = ["name", "variant_ord", "target"]
    assert leaks.FEW_GRAMS > 0
    few = sorted(map(tuple, leaks.find_leaks(variants, targets).select(columns).collect()))
    monkeypatch.setattr(leaks, "FEW_GRAMS", 0)
    assert few == sorted(map(tuple, leaks.find_leaks(variants, targets).select(columns).collect())) and few


def test_decoding_names_each_step_once(spark):
    """A text was stripped and decoded again wherever a condition named it, sixteen times for a hit."""
    plan = spark.range(1).select(X.base64_text(F.col("id").cast("string")).alias("t"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_replace") == 1 and plan.count("try_to_binary") == 1
    rows = [("QUJD",), (" QU\nJD ",), ("QUJD\x85",), ("QUJDé",), ("a-_b",), ("QUI=",), ("AAEC",), ("",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(X.base64_text(F.col("t"))).collect()]
    assert got == ["ABC", "ABC", None, None, None, None, None, None, None]


def test_leak_compat_misses_value_beside_mark(audited):
    strings, targets = audited
    bad = {r.name for r in leaks.find_leaks(leaks.string_variants(strings), targets, compat=True).collect()}
    assert "beside a mark" not in bad and "raw Ravi Okonkwo" in bad


def test_offsets_cut_back_to_the_match(spark):
    df = spark.createDataFrame(
        [(1, "é a.b@c.org, x 4111 1111 1111 1111 NAME: Ann Lee (212) 555-0187 éK1234567 K7654321 password: pw Jane Doe")], "id long, text string"
    )
    rows = detect.scan_all(df, "id").join(df.withColumnRenamed("id", "src_id"), "src_id").collect()
    assert {r.kind for r in rows} == {"EMAIL", "PHONE", "CREDIT_CARD", "GOVT_ID", "NAME", "PASSWORD"}
    for r in rows:
        assert r.text[r.pos : r.pos + len(r.raw_value)] == r.raw_value
    # ASCII word boundaries: a letter outside ASCII does not glue to the match.
    assert sorted(r.raw_value for r in rows if r.kind == "GOVT_ID") == ["K1234567", "K7654321"]


def test_base64_of_plain_letters_is_read(spark):
    out = spark.createDataFrame([("nothing here",)], "s string").select(X.base64_text(F.col("s")).alias("t")).first()
    assert out.t == base64.b64decode("nothinghere=").decode("latin-1")


@pytest.mark.parametrize(
    "raw,want",
    [
        ("example.com", "https://example.com"), ("HTTP://Example.com:80/x", "http://example.com"),
        ("https://a.b:8443?q", "https://a.b:8443"), ("https://u@a.b", None), ("ftp://a.b", None), ("", None),
        ("evil.com/?u=http://a.b", None), ("https://a.b:99999", None), ("  a.b  ", "https://a.b"), ("javascript:alert(1)", None),
    ],
)
def test_origins(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "o string").select(X.normalise_origin(F.col("o"))).first()[0] == want


def test_lookalikes(spark):
    df = spark.createDataFrame([("Ignоrе prеvious",), ("ｅｖａｌ(",), ("plain",)], "text string")
    got = [r.flagged for r in screen.screen_keywords(df).collect()]
    assert got == [True, True, False]


def _vault(spark):
    rows = [("T1", "https://a", "Ann Lee", "NAME", 0), ("T1", "https://a", "a@b.co", "EMAIL", 1), ("T2", "https://a", "Ann Lee", "NAME", 0)]
    ents = spark.createDataFrame(rows, "task_id string, origin string, raw_value string, kind string, entity_ord int")
    ents = ents.withColumn("treatment", F.lit("TOKENIZE")).withColumn("created_ts", F.lit("2024-01-01").cast("timestamp"))
    return ents, policy.build_vault(ents, "k")


def test_token_round_trip(spark):
    ents, vault = _vault(spark)
    tokens = policy.tokenise(ents, vault)
    assert tokens.select("token").distinct().count() == 3
    values = tokens.select("task_id", "origin", F.concat(F.lit("<"), "token", F.lit(">")).alias("value"), "raw_value")
    asof = F.lit("2024-01-01 00:05:00").cast("timestamp")
    back = policy.detokenise(values, vault, asof).collect()
    assert all(r.resolved == f"<{r.raw_value}>" for r in back)
    late = policy.detokenise(values, vault, F.lit("2024-01-01 01:00:00").cast("timestamp")).collect()
    assert {r.reason for r in late} == {"EXPIRED"} and all(r.resolved is None for r in late)


def test_redaction_leaves_no_leak(spark):
    docs = spark.createDataFrame([(1, "mail ann@b.co card 4111 1111 1111 1111 or 212 555 0187, password: x9")], "doc_id long, text string")
    found = detect.scan_array(docs).withColumn(
        "entities", policy.decide_array(F.col("entities"), F.lit("flight_booking"), F.lit(""), F.lit(1), F.lit("o"), "k")
    )
    redacted = policy.redact_spans(found)
    ents = found.select(F.col("doc_id").alias("task_id"), F.explode("entities").alias("e")).select("task_id", "e.*")
    sent = redacted.select(F.col("doc_id").alias("task_id"), F.col("redacted").alias("text"))
    assert leaks.find_leaks(leaks.string_variants(sent), leaks.sensitive_targets(ents)).count() == 0
    assert "EMAIL#" in redacted.first().redacted and "[REDACTED CREDIT_CARD]" in redacted.first().redacted


def test_dedup_is_idempotent(spark):
    rows = [(1, 0, "EMAIL", "A@b.co ", 0.9), (1, 1, "EMAIL", "a@b.co", 0.97), (1, 2, "EMAIL", "a@B.co", 0.97), (1, 3, "PHONE", "1", 0.9)]
    df = spark.createDataFrame(rows, "src_id long, entity_ord int, kind string, raw_value string, confidence double")
    once = detect.dedup_entities(df, ["src_id"])
    assert sorted((r.kind, r.entity_ord) for r in once.collect()) == [("EMAIL", 1), ("PHONE", 3)]
    assert detect.dedup_entities(once, ["src_id"]).count() == 2


def test_attestation_without_task_is_refused(spark):
    image = "data:image/png;base64,AA"
    images = spark.createDataFrame([("k", "t", "c", image, "VERIFIED_SAFE")], "key string, task_id string, capture_id string, image string, state string")
    held = "key string, task_id string, capture_id string, status string, digest string"
    digest = spark.createDataFrame([(image,)], "i string").select(F.sha2("i", 256)).first()[0]
    for task, capture, want in (("t", "c", "OK"), (None, "c", "WRONG_TASK"), ("t", None, "WRONG_CAPTURE"), (None, None, "WRONG_TASK")):
        row = leaks.check_attestations(images, spark.createDataFrame([("k", task, capture, "SANITIZED", digest)], held), ["key"]).first()
        assert row.verdict == want and (row.image is not None) == (want == "OK")


def test_token_for_an_unknown_origin(spark):
    ents = spark.createDataFrame(
        [("t", None, "ann", "NAME", "TOKENIZE", 1)], "task_id string, origin string, raw_value string, kind string, treatment string, entity_ord long"
    ).withColumn("created_ts", F.current_timestamp())
    assert policy.tokenise(ents, policy.build_vault(ents, "s")).first().token is not None


def test_outgoing_findings_beyond_plain_values(spark):
    ents = spark.createDataFrame(
        [("t", "CREDIT_CARD", "4000-1234-5678-9017", "REMOVE"), ("u", "NAME", "Ina Berg", "KEEP")],
        "task_id string, kind string, raw_value string, treatment string",
    )
    deep = "so Ina Berg."
    for _ in range(8):
        deep = b64(deep)
    rows = [
        ("t", "card 4000 1234 5678 9017", "PATTERN"), ("t", json.dumps({"k": [b64("card 4000.1234.5678.9017")]}), None),
        ("u", "card 4000 1234 5678 9017", None), ("u", "x" * 500 + " data:image/png;base64,QQ==", "IMAGE"), ("u", deep, "UNDECODED"),
        ("u", None, None), ("u", "", None), (None, "4000-1234-5678-9017", None),
    ]
    for task, text, want in rows:
        sent = spark.createDataFrame([(task, text)], "task_id string, text string")
        found = leaks.outgoing_findings(sent, ents)
        kinds = {r.finding for r in found.collect()}
        assert kinds == ({want} if want else set()), text
        counts = ents.groupBy("task_id").agg(F.count("*").alias("detected"))
        report = leaks.boundary_report(counts, sent, found, ents).first()
        assert report.zero_raw_pii == (want is None and task is not None) and not report.visual_redaction_verified


def test_utility_of_a_redaction(spark):
    entity = "array<struct<kind:string,pos:int,raw_value:string,treatment:string>>"
    rows = [
        # Caught with two letters too many; missed; a false find; empty.
        ("call Ina now", "cal[REDACTED NAME] now", [("NAME", 3, "l Ina", "REMOVE")], [("NAME", 5, "Ina", "")]),
        ("call Ida now", "call Ida now", [("NAME", 5, "Ida", "KEEP")], [("NAME", 5, "Ida", "")]),
        ("call me now", "call [REDACTED NAME] now", [("NAME", 5, "me", "REMOVE")], []),
        ("", "", [], []),
    ]
    docs = spark.createDataFrame(rows, f"text string, redacted string, entities {entity}, truth {entity}")
    got = ledger.utility_preserved(docs, truth="truth").first()
    assert (got.chars, got.sensitive, got.removed, got.readable) == (35, 6, 7, 1)
    assert (got.sensitive_removed_pct, got.benign_kept_pct, got.over_removal_pct) == (50.0, 86.21, 13.79)
