"""Disclosure policy, vault and redaction."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilgrain import constants as K
from veilgrain.operators import detect, policy
from veilgrain.plans import views as V
from veilgrain.plans.entity_sql import entities_sql

Q = {}
SQL = {}
SECRET = "example-key"  # the registered queries only; callers bring their own


def task_anchors(spark, d):
    return policy.classify_intent(V.tasks(spark, d))


def raw_entities(spark, d):
    """Entities of the suffixed documents, each document being one task."""
    return detect.scan_all(V.texts_synth(spark, d), "doc_id").withColumnRenamed("src_id", "task_id")


def decided(spark, d):
    anchors = task_anchors(spark, d)
    ents = policy.apply_treatment(policy.task_necessity(raw_entities(spark, d), anchors))
    return ents.join(anchors.select("task_id", "origin", "created_ts"), "task_id")


def decided_docs(spark, d):
    """The same decisions inside the document row: one join, no explode."""
    docs = detect.scan_array(V.texts_synth(spark, d)).withColumn("task_id", F.col("doc_id"))
    joined = docs.join(task_anchors(spark, d).select("task_id", "goal", "prompt", "origin"), "task_id")
    return joined.withColumn(
        "entities",
        policy.decide_array(
            F.col("entities"), F.col("goal"), F.col("prompt"), F.col("task_id"), F.col("origin"), SECRET
        ),
    )


GOAL_SQL = """CASE WHEN contains(lower(prompt), 'flight') OR contains(lower(prompt), 'book') OR contains(lower(prompt), 'ticket')
    OR contains(lower(prompt), 'airline') THEN 'flight_booking'
  WHEN contains(lower(prompt), 'buy') OR contains(lower(prompt), 'checkout') OR contains(lower(prompt), 'shop') THEN 'ecommerce_checkout'
  ELSE 'generic_web_navigation' END"""
NEED_SQL = """CASE WHEN sensitivity = 'CRITICAL' OR kind = 'PASSWORD' THEN 'NONE'
  WHEN kind IN ('NAME', 'EMAIL') AND goal IN ('flight_booking', 'ecommerce_checkout') THEN 'HIGH'
  WHEN length(raw_value) > 2 AND contains(lower(prompt), lower(raw_value)) THEN 'HIGH'
  WHEN kind = 'PHONE' THEN 'MEDIUM' ELSE 'NONE' END"""
MATRIX_SQL = "CASE sensitivity || '/' || necessity " + " ".join(
    f"WHEN '{s}/{n}' THEN '{t}'" for s, n, t in K.POLICY_MATRIX
) + " END"
TOKEN_SQL = f"""CASE kind WHEN 'NAME' THEN 'PERSON' WHEN 'EMAIL' THEN 'EMAIL' ELSE 'TOKEN' END || '#' ||
  upper(substr(sha256('{SECRET}|' || task_id || '|' || origin || '|' || raw_value), 1, 32))"""
DECIDED = {
    "ents": entities_sql("texts_synth", "doc_id"),
    "needed": f"""SELECT src_id AS task_id, entity_ord, kind, pos, raw_value, masked, confidence, sensitivity, source, origin, created_ts,
        {NEED_SQL} AS necessity FROM ents JOIN (SELECT *, {GOAL_SQL} AS goal FROM tasks) ON task_id = src_id""",
    "decided": f"SELECT *, CASE WHEN confidence < 0.80 THEN 'REMOVE' ELSE {MATRIX_SQL} END AS treatment FROM needed",
}
VAULT = {
    **DECIDED,
    "vault": f"""SELECT {TOKEN_SQL} AS token, raw_value, kind, task_id, origin, created_ts, created_ts + INTERVAL 15 MINUTE AS expires_ts
      FROM (SELECT *, row_number() OVER (PARTITION BY task_id, origin, raw_value ORDER BY created_ts, entity_ord) AS rn
            FROM decided WHERE treatment = 'TOKENIZE') WHERE rn = 1""",
}
BASE = ["texts_synth", "tasks"]


def _ntz(df, *names):
    for name in names:
        df = df.withColumn(name, F.col(name).cast("timestamp_ntz"))
    return df


def classify_intent(spark, d):
    turns = V.table(spark, d, "conversations").filter("role = 'user'")
    kinds = ("", " Book a flight from Oslo to Rome.", " please buy it", " From here TO there by airline")
    text = F.concat("text", V._pick(kinds, F.col("conv_id") % 4))
    out = policy.classify_intent(turns.select("conv_id", "turn", text.alias("prompt")))
    return out.select(
        "conv_id",
        "turn",
        "goal",
        F.col("slots")["origin_city"].alias("origin_city"),
        F.col("slots")["destination_city"].alias("destination_city"),
        F.size("slots").alias("slots"),
        F.size("allowed_classes").alias("allowed"),
        F.size("forbidden_classes").alias("forbidden"),
    )


Q["classify_intent"] = classify_intent
SQL["classify_intent"] = f"""SELECT conv_id, turn, goal, oc AS origin_city, dc AS destination_city,
    CASE goal WHEN 'flight_booking' THEN 2 + CASE WHEN oc IS NULL THEN 0 ELSE 1 END + CASE WHEN dc IS NULL THEN 0 ELSE 1 END
      WHEN 'ecommerce_checkout' THEN 1 ELSE 0 END AS slots,
    CASE goal WHEN 'flight_booking' THEN 4 WHEN 'ecommerce_checkout' THEN 2 ELSE 0 END AS allowed, 7 AS forbidden
  FROM (SELECT *, CASE WHEN goal = 'flight_booking' THEN nullif(regexp_extract(prompt, '(?i)from\\s+([A-Za-z]+)', 1), '') END AS oc,
          CASE WHEN goal = 'flight_booking' THEN nullif(regexp_extract(prompt, '(?i)to\\s+([A-Za-z]+)', 1), '') END AS dc
        FROM (SELECT *, {GOAL_SQL} AS goal FROM (SELECT conv_id, turn, text || CASE conv_id % 4 WHEN 1 THEN ' Book a flight from Oslo to Rome.'
          WHEN 2 THEN ' please buy it' WHEN 3 THEN ' From here TO there by airline' ELSE '' END AS prompt
          FROM conversations WHERE role = 'user')))"""


def task_necessity(spark, d):
    ents = policy.task_necessity(raw_entities(spark, d), task_anchors(spark, d))
    return ents.select("task_id", "entity_ord", "kind", "necessity")


Q["task_necessity"] = task_necessity
SQL["task_necessity"] = V.with_views(BASE, "SELECT task_id, entity_ord, kind, necessity FROM needed", DECIDED)

Q["apply_treatment"] = lambda spark, d: decided(spark, d).select(
    "task_id", "entity_ord", "kind", "sensitivity", "necessity", "treatment"
)
SQL["apply_treatment"] = V.with_views(
    BASE, "SELECT task_id, entity_ord, kind, sensitivity, necessity, treatment FROM decided", DECIDED
)


def fail_closed(spark, d):
    config = policy.PolicyConfig(confidence_threshold=0.95, fail_closed="MASK")
    ents = policy.task_necessity(raw_entities(spark, d), task_anchors(spark, d))
    return policy.apply_treatment(ents, config).select("task_id", "entity_ord", "confidence", "treatment")


Q["fail_closed"] = fail_closed
SQL["fail_closed"] = V.with_views(
    BASE,
    "SELECT task_id, entity_ord, confidence, CASE WHEN confidence < 0.95 THEN 'MASK' ELSE treatment END AS treatment FROM decided",
    DECIDED,
)

Q["build_vault"] = lambda spark, d: _ntz(policy.build_vault(decided(spark, d), SECRET), "created_ts", "expires_ts")
SQL["build_vault"] = V.with_views(BASE, "SELECT * FROM vault", VAULT)


def tokenise(spark, d):
    ents = decided(spark, d)
    return policy.tokenise(ents, policy.build_vault(ents, SECRET)).select(
        "task_id", "entity_ord", "treatment", "token"
    )


Q["tokenise"] = tokenise
SQL["tokenise"] = V.with_views(
    BASE,
    """SELECT d.task_id, entity_ord, treatment, CASE WHEN treatment = 'TOKENIZE' THEN token END AS token
      FROM decided d LEFT JOIN vault v ON d.task_id = v.task_id AND d.origin = v.origin AND d.raw_value = v.raw_value""",
    VAULT,
)


def _typed_values(vault):
    """Values typed by agents: most with their token, some from elsewhere or late."""
    k = F.col("task_id") % 5
    return vault.select(
        F.when(k == 1, F.col("task_id") + 1).otherwise(F.col("task_id")).alias("task_id"),
        F.when(k == 2, F.lit("https://other.example")).otherwise(F.col("origin")).alias("origin"),
        F.when(k == 3, F.lit("typed by hand"))
        .when(k == 4, F.lit("to TOKEN#00FF"))
        .otherwise(F.concat(F.lit("to "), F.col("token"), F.lit(" now")))
        .alias("value"),
    )


def detokenise(spark, d):
    vault = policy.build_vault(decided(spark, d), SECRET)
    asof = F.lit("2024-01-01 00:10:00").cast("timestamp") + F.make_dt_interval(mins=F.lit(10))
    return policy.detokenise(_typed_values(vault), vault, asof)


Q["detokenise"] = detokenise
SQL["detokenise"] = V.with_views(
    BASE,
    """SELECT t.task_id, t.origin, value, reason, CASE reason WHEN 'RESOLVED' THEN replace(value, token, raw_value) WHEN 'NO_TOKEN' THEN value END AS resolved
      FROM (SELECT t.*, v.token, v.raw_value, CASE WHEN tok = '' THEN 'NO_TOKEN' WHEN v.token IS NULL THEN 'UNKNOWN_TOKEN'
          WHEN v.task_id <> t.task_id THEN 'TASK_MISMATCH' WHEN v.origin <> t.origin THEN 'ORIGIN_MISMATCH'
          WHEN v.expires_ts < TIMESTAMP '2024-01-01 00:20:00' THEN 'EXPIRED' ELSE 'RESOLVED' END AS reason
        FROM typed t LEFT JOIN vault v ON v.token = t.tok) t""",
    {
        **VAULT,
        "typed": """SELECT *, regexp_extract(value, '[A-Z]+#[A-F0-9]+') AS tok FROM (SELECT
          CASE WHEN task_id % 5 = 1 THEN task_id + 1 ELSE task_id END AS task_id,
          CASE WHEN task_id % 5 = 2 THEN 'https://other.example' ELSE origin END AS origin,
          CASE task_id % 5 WHEN 3 THEN 'typed by hand' WHEN 4 THEN 'to TOKEN#00FF' ELSE 'to ' || token || ' now' END AS value FROM vault)""",
    },
)


def purge_vault(spark, d):
    vault = policy.build_vault(decided(spark, d), SECRET)
    done = V.table(spark, d, "labels").filter("quality = 1").select(F.col("doc_id").alias("task_id"))
    return policy.purge_vault(vault, done).select("task_id", "token")


Q["purge_vault"] = purge_vault
SQL["purge_vault"] = V.with_views(
    BASE, "SELECT task_id, token FROM vault WHERE task_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)", VAULT
)


def active_tokens(spark, d):
    vault = policy.build_vault(decided(spark, d), SECRET)
    live = policy.active_tokens(vault, F.lit("2024-01-01 00:20:00").cast("timestamp"))
    return live.select("task_id", "token", "raw_value")


Q["active_tokens"] = active_tokens
SQL["active_tokens"] = V.with_views(
    BASE,
    "SELECT task_id, token, repeat('•', length(raw_value)) AS raw_value FROM vault WHERE expires_ts > TIMESTAMP '2024-01-01 00:20:00'",
    VAULT,
)


def node_entities(spark, d):
    return entities_of(V.nodes_synth(spark, d))


def entities_of(nodes):
    """Attribute findings first, then text findings, with their tokens."""
    attrs = detect.scan_attributes(nodes).withColumn("pos", F.lit(0))
    keyed = nodes.withColumn("_src", F.struct("page_id", "node_ord"))
    texts = detect.scan_all(keyed, "_src").select("src_id.*", "*").drop("src_id")
    texts = texts.withColumn("entity_ord", F.col("entity_ord") + 10)
    both = attrs.unionByName(texts)
    return both.withColumn(
        "token",
        F.when(
            F.col("treatment") == "TOKENIZE",
            policy.token_of(F.col("kind"), F.col("raw_value"), F.col("page_id"), F.lit("page"), SECRET),
        ),
    )


def _sanitise(compat):
    def run(spark, d):
        out = policy.sanitise_nodes(V.nodes_synth(spark, d), node_entities(spark, d), compat=compat)
        return out.select("page_id", "node_ord", "text")

    return run


_NODE_TOKEN = "upper(substr(sha256('example-key|' || page_id || '|page|' || {raw}), 1, 32))"
_WHOLE = """CASE WHEN lower(input_type) = 'password' OR contains(name_attr, 'pass') OR contains(id_attr, 'pass') THEN '••••••••'
  WHEN contains(name_attr, 'card') OR contains(id_attr, 'card') OR contains(name_attr, 'cc') THEN '••••-••••-••••-••••' END"""
Q["sanitise_nodes"] = _sanitise(False)
SQL["sanitise_nodes"] = V.with_views(
    ["nodes_synth"],
    f"""SELECT page_id, node_ord, coalesce({_WHOLE}, replace(replace(text,
        coalesce(nullif(mail, ''), '~'), 'EMAIL#' || {_NODE_TOKEN.format(raw='mail')}),
        coalesce(nullif(phone, ''), '~'), 'TOKEN#' || {_NODE_TOKEN.format(raw='phone')})) AS text
      FROM (SELECT *, regexp_extract(text, '{K.EMAIL_PATTERN}') AS mail, regexp_extract(text, '{K.PHONE_PATTERN}') AS phone FROM nodes_synth)""",
)
Q["sanitise_nodes_compat"] = _sanitise(True)
SQL["sanitise_nodes_compat"] = V.with_views(
    ["nodes_synth"],
    f"""SELECT page_id, node_ord, coalesce({_WHOLE}, CASE WHEN mail <> '' THEN 'EMAIL#' || {_NODE_TOKEN.format(raw='mail')}
        WHEN phone <> '' THEN 'TOKEN#' || {_NODE_TOKEN.format(raw='phone')} ELSE text END) AS text
      FROM (SELECT *, regexp_extract(text, '{K.EMAIL_PATTERN}') AS mail, regexp_extract(text, '{K.PHONE_PATTERN}') AS phone FROM nodes_synth)""",
)

Q["redact_spans"] = lambda spark, d: policy.redact_spans(decided_docs(spark, d)).select("doc_id", "redacted")
REDACTED = {
    **DECIDED,
    "spans": f"""SELECT task_id, pos AS s, pos + length(raw_value) AS e,
        CASE sensitivity WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END AS rank,
        CASE WHEN treatment = 'TOKENIZE' THEN {TOKEN_SQL} ELSE '[REDACTED ' || kind || ']' END AS label FROM decided WHERE treatment <> 'KEEP'""",
    "islands": """SELECT task_id, min(s) AS s, max(e) AS e, first(label ORDER BY n) AS label FROM (
        SELECT *, sum(fresh) OVER (PARTITION BY task_id ORDER BY n) AS g FROM (
          SELECT *, CASE WHEN s >= coalesce(max(e) OVER (PARTITION BY task_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) THEN 1 ELSE 0 END AS fresh
          FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY s, e DESC, rank DESC, label) AS n FROM spans))) GROUP BY task_id, g""",
    "redacted": """SELECT doc_id, coalesce(string_agg(substr(text, CAST(p + 1 AS BIGINT), CAST(s - p AS BIGINT)) || label, '' ORDER BY s), '')
          || substr(any_value(text), CAST(coalesce(max(e), 0) + 1 AS BIGINT)) AS redacted
        FROM texts_synth LEFT JOIN (SELECT *, coalesce(lag(e) OVER (PARTITION BY task_id ORDER BY s), 0) AS p FROM islands) ON task_id = doc_id
        GROUP BY doc_id""",
}
SQL["redact_spans"] = V.with_views(BASE, "SELECT * FROM redacted", REDACTED)

Q["disclosure_counts"] = lambda spark, d: policy.disclosure_counts(decided(spark, d))
SQL["disclosure_counts"] = V.with_views(
    BASE,
    """SELECT task_id, count(*) AS detected, count(*) FILTER (treatment = 'KEEP') AS transmitted, count(*) FILTER (treatment = 'TOKENIZE') AS tokenised,
      count(*) FILTER (treatment IN ('REMOVE', 'MASK')) AS blocked, count(*) FILTER (treatment = 'LOCAL_ONLY') AS local_only,
      count(*) FILTER (treatment = 'ABSTRACT') AS abstracted FROM decided GROUP BY task_id""",
    DECIDED,
)
