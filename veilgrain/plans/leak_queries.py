"""Leak audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilgrain import constants as K
from veilgrain.functions import text as X
from veilgrain.operators import detect, leaks, policy
from veilgrain.plans import policy_queries as P
from veilgrain.plans import views as V
from veilgrain.plans.entity_sql import entities_sql, region_sql
from veilgrain.plans.source_queries import SQL as SOURCE
from veilgrain.session import written
from veilgrain.sources import html

Q = {}
SQL = {}

# Encodings of one address appended to conversation turns by (conv_id + turn) % 7.
ENCODED = (
    "ann.lee@site.example",
    "ann.lee%40site.example",
    "\\u0061nn.lee@site.example",
    "YW5uLmxlZUBzaXRlLmV4YW1wbGU=",
    "%59W5uLmxlZUBzaXRlLmV4YW1wbGU%3D",
    "V1ZjMWRVeHRlR3hhVlVKNllWaFNiRXh0VmpSWlZ6RjNZa2RWUFE9PQ==",  # base64 three times
    "nothing here.",
)


def _payloads(spark, d):
    """Turns: the text itself in one string, an encoded value alone in another."""
    conv = V.table(spark, d, "conversations")
    code = V._pick(ENCODED, (F.col("conv_id") + F.col("turn")) % len(ENCODED))
    both = F.array(F.concat(F.col("text"), F.lit(" mail "), code), code)
    return conv.select(F.col("conv_id").alias("task_id"), "turn", F.posexplode(both).alias("part", "text"))


_CODE = V._case(ENCODED, f"(conv_id + turn) % {len(ENCODED)}")
_PAYLOADS = f"""SELECT conv_id AS task_id, turn, CAST(part AS INTEGER) AS part, code,
    CASE part WHEN 0 THEN text || ' mail ' || code ELSE code END AS text, text AS body
  FROM (SELECT *, {_CODE} AS code FROM conversations), (SELECT unnest([0, 1]) AS part)"""


def _readings_sql(source: str, keys: str) -> str:
    """Readings of ``source.text``, one decoding step a round, as rows of ``steps``."""
    packed = r"regexp_replace(cur, '\s+', '', 'g')"
    bare = f"rtrim(translate({packed}, '-_', '+/'), '=')"
    b64 = f"""CASE WHEN length({packed}) >= 4 AND regexp_full_match({packed}, '[A-Za-z0-9+/=_-]+')
        THEN TRY(decode(from_base64(rpad({bare}, CAST(ceil(length({bare}) / 4.0) * 4 AS INTEGER), '=')))) END"""
    return f"""SELECT {keys}, 0 AS step, 0 AS variant_ord, text AS cur, true AS fresh FROM {source} UNION ALL
      SELECT {keys}, step + 1, variant_ord + CASE WHEN got IS NULL THEN 0 ELSE 1 END, coalesce(got, cur), got IS NOT NULL
      FROM (SELECT *, nullif(nullif(CASE WHEN step % 3 = 2 AND NOT regexp_matches(raw, '[\x20-\x7E]{{3,}}') THEN NULL ELSE raw END, cur), '') AS got
        FROM (SELECT *, CASE step % 3 WHEN 0 THEN CASE WHEN contains(cur, '%') THEN TRY(url_decode(cur)) END
          WHEN 1 THEN replace(cur, '\\u0061', 'a') ELSE {b64} END AS raw FROM steps WHERE step < 15))"""


_VARIANTS = "SELECT task_id, turn, part, false AS undecoded, CAST(variant_ord AS INTEGER) AS variant_ord, cur AS variant FROM steps WHERE fresh"
VARIANTS = {"payloads": _PAYLOADS, "steps": _readings_sql("payloads", "task_id, turn, part"), "variants": _VARIANTS}

Q["string_variants"] = lambda spark, d: leaks.string_variants(_payloads(spark, d))
SQL["string_variants"] = V.with_views([], "SELECT * FROM variants", VARIANTS)


def _targets_sql(source: str) -> str:
    value = "trim(raw_value)"
    url = f"replace(replace(replace(replace(replace(url_encode({value}), '%21', '!'), '%27', ''''), '%28', '('), '%29', ')'), '%2A', '*')"
    return f"""SELECT DISTINCT task_id, lower(unnest([{value}, to_base64(encode({value})), {url}])) AS target FROM {source}
      WHERE treatment <> 'KEEP' AND length({value}) >= 3"""


Q["sensitive_targets"] = lambda spark, d: leaks.sensitive_targets(P.decided(spark, d))
SQL["sensitive_targets"] = V.with_views(P.BASE, _targets_sql("decided"), P.DECIDED)


def _conversation_entities(spark, d):
    """The encoded address belongs to every third conversation; its own finds to all."""
    conv = V.regions(spark, d)
    found = detect.scan_region_text(conv, ["conv_id", "turn"]).select(
        F.col("conv_id").alias("task_id"), "kind", "raw_value", "treatment"
    )
    owned = V.table(spark, d, "conversations").filter("conv_id % 3 = 0 AND turn = 0").select(
        F.col("conv_id").alias("task_id"),
        F.lit("EMAIL").alias("kind"),
        F.lit("Ann.Lee@site.example").alias("raw_value"),
        F.lit("TOKENIZE").alias("treatment"),
    )
    return found.unionByName(owned)


def find_leaks(spark, d):
    payloads = _payloads(spark, d)
    targets = leaks.sensitive_targets(_conversation_entities(spark, d))
    hits = leaks.find_leaks(leaks.string_variants(payloads), targets)
    return hits.select("task_id", "turn", "part", "variant_ord", "target")


Q["find_leaks"] = find_leaks
CONV_ENTITIES = {
    "found": region_sql("regions", "conv_id, turn"),
    "conv_entities": """SELECT conv_id AS task_id, kind, raw_value, treatment FROM found UNION ALL
      SELECT conv_id, 'EMAIL', 'Ann.Lee@site.example', 'TOKENIZE' FROM conversations WHERE conv_id % 3 = 0 AND turn = 0""",
}
SQL["find_leaks"] = V.with_views(
    ["regions"],
    "SELECT task_id, turn, part, variant_ord, target FROM variants JOIN targets USING (task_id) WHERE contains(lower(variant), target)",
    {**VARIANTS, **CONV_ENTITIES, "targets": _targets_sql("conv_entities")},
)


def pattern_leaks(spark, d):
    docs = V.texts_synth(spark, d)
    known = _conversation_entities(spark, d).unionByName(
        detect.scan_all(V.table(spark, d, "documents"), "doc_id").select("kind", "raw_value", "treatment"), allowMissingColumns=True
    )
    return leaks.pattern_leaks(docs, known, ["doc_id"])


Q["pattern_leaks"] = pattern_leaks
_DIG = "regexp_replace({}, '[^0-9]', '', 'g')"


def _cand_in(source, key, column, kind, pattern, expr):
    return f"SELECT {key}, '{kind}' AS kind, {expr} AS value FROM (SELECT {key}, unnest(regexp_extract_all({column}, '{pattern}')) AS m FROM {source})"


_KINDS = (
    ("EMAIL", K.EMAIL_PATTERN, "lower(m)"),
    ("CREDIT_CARD", K.CARD_PATTERN, _DIG.format("m")),
    ("GOVT_ID", K.PASSPORT_PATTERN, "m"),
    ("PHONE", K.PHONE_PATTERN, _DIG.format("m")),
)
SQL["pattern_leaks"] = V.with_views(
    ["texts_synth", "regions"],
    "SELECT DISTINCT doc_id, kind, value FROM cand WHERE (kind, value) IN (SELECT (kind, value) FROM known) AND NOT (kind = 'CREDIT_CARD' AND length(value) NOT BETWEEN 13 AND 19)",
    {
        **CONV_ENTITIES,
        "docs_found": entities_sql("documents", "doc_id"),
        "owned": "SELECT raw_value, treatment FROM conv_entities UNION ALL SELECT raw_value, treatment FROM docs_found",
        "known": f"""SELECT 'EMAIL' AS kind, lower(raw_value) AS value FROM owned WHERE treatment <> 'KEEP'
          UNION SELECT 'CREDIT_CARD', {_DIG.format('raw_value')} FROM owned UNION SELECT 'GOVT_ID', raw_value FROM owned
          UNION SELECT 'PHONE', {_DIG.format('raw_value')} FROM owned""",
        "cand": " UNION ALL ".join(_cand_in("texts_synth", "doc_id", "text", *k) for k in _KINDS),
    },
)


def embedded_blob_flag(spark, d):
    tail = V._pick(("", '<img src="data:image/png;base64,AA">', " base64,QUJD", " base64,QUJD [REDACTED]"), F.col("page_id") % 4)
    pages = V.table(spark, d, "pages").select("page_id", F.concat("html", tail).alias("text"))
    return leaks.embedded_blob_flag(pages).select("page_id", "embedded_blob")


Q["embedded_blob_flag"] = embedded_blob_flag
SQL["embedded_blob_flag"] = """SELECT page_id, length(text) > 500 AND (contains(text, 'data:image/') OR (contains(text, 'base64,')
    AND NOT contains(text, '[REDACTED]'))) AS embedded_blob FROM (SELECT page_id, html || CASE page_id % 4
    WHEN 1 THEN '<img src="data:image/png;base64,AA">' WHEN 2 THEN ' base64,QUJD' WHEN 3 THEN ' base64,QUJD [REDACTED]' ELSE '' END AS text FROM pages)"""


def check_attestations(spark, d):
    ev = V.table(spark, d, "events")
    e = F.col("event_id")
    image = F.concat(F.lit("data:image/png;base64,"), e.cast("string"))
    images = ev.select(
        e.alias("image_key"),
        F.col("user_id").alias("task_id"),
        e.alias("capture_id"),
        F.when(e % 7 == 0, F.lit(None).cast("string")).otherwise(image).alias("image"),
        F.when(e % 5 == 0, "VISUAL_PRIVACY_UNVERIFIED").otherwise("VERIFIED_SAFE").alias("state"),
    )
    att = ev.filter(e % 11 != 0).select(
        e.alias("image_key"),
        F.when(e % 13 == 0, F.col("user_id") + 1).otherwise(F.col("user_id")).alias("task_id"),
        F.when(e % 17 == 0, e + 1).otherwise(e).alias("capture_id"),
        F.when(e % 19 == 0, "UNVERIFIED").otherwise("SANITIZED").alias("status"),
        F.sha2(F.when(e % 23 == 0, F.lit("x")).otherwise(image), 256).alias("digest"),
    )
    out = leaks.check_attestations(images, att, ["image_key"])
    return out.select("capture_id", "verdict", F.col("image").isNotNull().alias("sent"))


Q["check_attestations"] = check_attestations
SQL["check_attestations"] = """SELECT event_id AS capture_id, verdict, verdict = 'OK' AS sent FROM (SELECT event_id,
    CASE WHEN event_id % 7 = 0 THEN 'NO_IMAGE' WHEN event_id % 5 = 0 THEN 'STATE_UNVERIFIED'
      WHEN event_id % 11 = 0 OR event_id % 19 = 0 THEN 'NOT_SANITIZED' WHEN event_id % 23 = 0 THEN 'DIGEST_MISMATCH'
      WHEN event_id % 13 = 0 THEN 'WRONG_TASK' WHEN event_id % 17 = 0 THEN 'WRONG_CAPTURE' ELSE 'OK' END AS verdict FROM events)"""


_PICTURE = ' <img src="data:image/png;base64,' + "QUJD" * 150 + '">'
_TEL = " tel 212.555.0187"


def _outgoing(spark, d):
    """Redacted documents, and some that are not: as they were, encoded once or thrice, inside JSON,
    with a number written differently or with a picture. Each task has a picture of its own too."""
    docs = policy.redact_spans(P.decided_docs(spark, d))
    i = F.col("doc_id")

    def coded(text):
        return X.base64_of(F.encode(text, "UTF-8"))

    text = (
        F.when(i % 5 == 0, F.col("text"))
        .when(i % 7 == 0, coded(F.col("text")))
        .when(i % 11 == 0, F.to_json(F.struct(i.alias("id"), F.array(F.struct(F.col("text").alias("note"))).alias("parts"))))
        .when(i % 13 == 0, coded(coded(coded(F.col("text")))))
        .when(i % 17 == 0, F.concat("redacted", F.lit(_TEL)))
        .when(i % 19 == 0, F.concat("redacted", F.lit(_PICTURE)))
        .otherwise(F.col("redacted"))
    )
    return docs.select("task_id", text.alias("text"))


def _pictures(spark, d):
    i = F.col("doc_id")
    image = F.concat(F.lit("data:image/png;base64,"), F.sha2(i.cast("string"), 256))
    docs = V.table(spark, d, "documents")
    images = docs.filter(i % 3 != 0).select(
        i.alias("task_id"), i.alias("capture_id"), image.alias("image"),
        F.when(i % 4 == 0, "VISUAL_PRIVACY_UNVERIFIED").otherwise("VERIFIED_SAFE").alias("state"),
    )
    made = F.when(i % 10 == 1, F.concat(image, F.lit("x"))).otherwise(image)
    held = docs.select(
        i.alias("task_id"), F.when(i % 10 != 3, i).alias("capture_id"),
        F.when(i % 10 == 7, "UNKNOWN").otherwise("SANITIZED").alias("status"), F.sha2(made, 256).alias("digest"),
    )
    # The image is looked up by its task; the attestation's own fields are then compared.
    return leaks.check_attestations(
        images.withColumn("image_key", F.col("task_id")), held.withColumn("image_key", F.col("task_id")), ["image_key"]
    )


def _report(spark, d):
    # texts are scanned and redacted once, not for every part of the report
    ents = written(P.decided(spark, d), "decided")
    payloads = written(_outgoing(spark, d), "outgoing", compression="zstd")
    found = leaks.outgoing_findings(payloads, ents)
    return payloads, leaks.boundary_report(
        policy.disclosure_counts(ents), payloads, found, ents, images=_pictures(spark, d)
    )


Q["boundary_report"] = lambda spark, d: _report(spark, d)[1].drop("leaks")


_REPORT = {
    **P.REDACTED,
    "outgoing": f"""SELECT doc_id AS task_id, CASE WHEN doc_id % 5 = 0 THEN text WHEN doc_id % 7 = 0 THEN to_base64(encode(text))
          WHEN doc_id % 11 = 0 THEN CAST(json_object('id', doc_id, 'parts', [json_object('note', text)]) AS VARCHAR)
          WHEN doc_id % 13 = 0 THEN to_base64(encode(to_base64(encode(to_base64(encode(text))))))
          WHEN doc_id % 17 = 0 THEN redacted || '{_TEL}' WHEN doc_id % 19 = 0 THEN redacted || '{_PICTURE}' ELSE redacted END AS text
      FROM texts_synth JOIN redacted USING (doc_id)""",
    "strings": """SELECT task_id, unnest(CASE WHEN text LIKE '{"id":%' AND json_valid(text)
        THEN ['id', 'parts', 'note', json_extract_string(text, '$.parts[0].note')] ELSE [text] END) AS text FROM outgoing""",
    "steps": _readings_sql("strings", "task_id"),
    "readings": "SELECT task_id, cur AS variant FROM steps WHERE fresh",
    "report_targets": _targets_sql("decided"),
    "known": f"""SELECT task_id, 'EMAIL' AS kind, lower(raw_value) AS value FROM decided WHERE treatment <> 'KEEP'
        UNION SELECT task_id, 'CREDIT_CARD', {_DIG.format('raw_value')} FROM decided
        UNION SELECT task_id, 'GOVT_ID', raw_value FROM decided UNION SELECT task_id, 'PHONE', {_DIG.format('raw_value')} FROM decided""",
    "found": " UNION ALL ".join(_cand_in("readings", "task_id", "variant", *k) for k in _KINDS),
    "bad": r"""SELECT DISTINCT task_id FROM readings JOIN report_targets USING (task_id)
          WHERE contains(lower(regexp_replace(variant, '\[REDACTED[^\]]*\]|\b[A-Z_]+#[A-F0-9]+\b|•+', chr(10), 'g')), target)
        UNION SELECT task_id FROM found WHERE value <> '' AND (kind <> 'CREDIT_CARD' OR length(value) BETWEEN 13 AND 19)
          AND (task_id, kind, value) IN (SELECT (task_id, kind, value) FROM known)
        UNION SELECT task_id FROM readings WHERE length(variant) > 500 AND (contains(variant, 'data:image/')
          OR (contains(variant, 'base64,') AND NOT contains(variant, '[REDACTED]')))""",
    "pictures": """SELECT task_id, coalesce(state = 'VERIFIED_SAFE' AND status = 'SANITIZED' AND digest = sha256(image)
          AND capture_id = held_capture, false) AS fine, octet_length(encode(image)) AS bytes
      FROM (SELECT doc_id AS task_id, doc_id AS capture_id, 'data:image/png;base64,' || sha256(CAST(doc_id AS VARCHAR)) AS image,
          CASE WHEN doc_id % 4 = 0 THEN 'VISUAL_PRIVACY_UNVERIFIED' ELSE 'VERIFIED_SAFE' END AS state FROM documents WHERE doc_id % 3 <> 0)
      JOIN (SELECT doc_id AS task_id, CASE WHEN doc_id % 10 <> 3 THEN doc_id END AS held_capture,
          CASE WHEN doc_id % 10 = 7 THEN 'UNKNOWN' ELSE 'SANITIZED' END AS status, sha256('data:image/png;base64,'
          || sha256(CAST(doc_id AS VARCHAR)) || CASE WHEN doc_id % 10 = 1 THEN 'x' ELSE '' END) AS digest FROM documents) USING (task_id)""",
    "report": """SELECT task_id, coalesce(detected, 0) AS detected, coalesce(transmitted, 0) AS transmitted, coalesce(tokenised, 0) AS tokenised,
        coalesce(blocked, 0) AS blocked, coalesce(local_only, 0) AS local_only, coalesce(abstracted, 0) AS abstracted,
        task_id NOT IN (SELECT task_id FROM bad) AS zero_raw_pii, coalesce(fine, false) AS visual_redaction_verified,
        CAST(octet_length(encode(text)) + CASE WHEN fine THEN bytes ELSE 0 END AS BIGINT) AS sanitised_bytes,
        CAST(octet_length(encode(text)) + CASE WHEN fine THEN bytes ELSE 0 END + coalesce(raw_len, 0) AS BIGINT) AS raw_bytes
      FROM outgoing LEFT JOIN pictures USING (task_id) LEFT JOIN (SELECT task_id, count(*) AS detected, count(*) FILTER (treatment = 'KEEP') AS transmitted,
        count(*) FILTER (treatment = 'TOKENIZE') AS tokenised, count(*) FILTER (treatment IN ('REMOVE', 'MASK')) AS blocked,
        count(*) FILTER (treatment = 'LOCAL_ONLY') AS local_only, count(*) FILTER (treatment = 'ABSTRACT') AS abstracted,
        sum(length(raw_value)) AS raw_len FROM decided GROUP BY task_id) USING (task_id)""",
}
SQL["boundary_report"] = V.with_views(P.BASE, "SELECT * FROM report", _REPORT)


def gate_payloads(spark, d):
    payloads, reports = _report(spark, d)
    sent, held = leaks.gate_payloads(payloads, written(reports, "reports"))
    return sent.select("task_id", F.lit("sent").alias("route")).unionByName(
        held.select("task_id", F.lit("quarantine").alias("route"))
    )


Q["gate_payloads"] = gate_payloads
SQL["gate_payloads"] = V.with_views(
    P.BASE, "SELECT task_id, CASE WHEN zero_raw_pii THEN 'sent' ELSE 'quarantine' END AS route FROM report", _REPORT
)


# --- from pages to the gate -------------------------------------------------

#: A form, and a part that is not displayed, at the end of every page.
_FORM = (
    '<form><label for="card">Card of <b>Ann</b></label><input id="card" name="card" value="4111 1111 1111 1111">'
    '<label>Mail <input name="mail" value="ann@site.example"></label><input type="password" value="s3cret-word">'
    '<button>Pay now</button><img src="x.png" alt=""></form><div hidden><p>call (212) 555-0187</p></div>'
)


def page_to_gate(spark, d):
    """Pages to nodes, findings, sanitised texts and payloads; every fourth page is sent as it is.

    One row per page: its displayed elements, inputs and their labels, unread
    pictures, and whether its payload may leave.
    """
    pages = V.table(spark, d, "pages").select("page_id", F.concat("html", F.lit(_FORM)).alias("html"))
    tree = written(html.with_labels(html.visible_nodes(html.page_tree(pages))), "tree")
    found = written(P.entities_of(tree).withColumn("task_id", F.col("page_id")), "node-entities")
    media = detect.unverified_media(tree).groupBy("page_id").agg(F.count("*").alias("unread"))
    clean = policy.sanitise_nodes(tree.select("page_id", "node_ord", "label", F.col("text").alias("raw"), "text"), found)
    said = F.when(F.col("page_id") % 4 == 0, F.col("raw")).otherwise(F.col("text"))
    line = F.struct("node_ord", F.concat_ws(": ", "label", said).alias("line"))
    payloads = clean.groupBy(F.col("page_id").alias("task_id")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), "\n").alias("text")
    )
    payloads = written(payloads, "page-payloads")
    report = leaks.boundary_report(policy.disclosure_counts(found), payloads, leaks.outgoing_findings(payloads, found), found)
    sent, _ = leaks.gate_payloads(payloads, report)
    shape = tree.groupBy("page_id").agg(
        F.count("*").alias("nodes"), F.count_if("is_input").alias("inputs"),
        F.array_join(F.array_sort(F.collect_set("label")), "|").alias("labels"),
    )
    routed = shape.join(media, "page_id", "left").join(sent.select(F.col("task_id").alias("page_id"), F.lit(True).alias("sent")), "page_id", "left")
    return routed.select("page_id", "nodes", "inputs", "labels", F.coalesce("unread", F.lit(0)).alias("unread"), F.coalesce("sent", F.lit(False)).alias("sent"))


Q["page_to_gate"] = page_to_gate
SQL["page_to_gate"] = f"""SELECT page_id, count(*) + 9 AS nodes, 3 AS inputs, 'Card of Ann|Mail' AS labels, 1 AS unread, page_id % 4 <> 0 AS sent
  FROM ({SOURCE["page_elements"]}) GROUP BY page_id"""
