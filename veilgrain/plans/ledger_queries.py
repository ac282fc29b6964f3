"""Ledgers and privacy metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from veilgrain.operators import ledger as L
from veilgrain.operators import policy
from veilgrain.plans import action_queries as AQ
from veilgrain.plans import policy_queries as P
from veilgrain.plans import views as V
from veilgrain.session import fresh_path, written

Q = {}
SQL = {}


def _entities(spark, d):
    """Decided entities; every ninth names its value as kept, to give the metrics something to find."""
    ents = P.decided(spark, d)
    return ents.withColumn("treatment", F.when(F.col("task_id") % 9 == 0, "KEEP").otherwise(F.col("treatment")))


def _ledger(spark, d):
    return L.privacy_ledger(_entities(spark, d))


def _actions(spark, d):
    judged = AQ.judged(spark, d)
    outcomes = judged.select("action_id", ((F.col("decision") != "BLOCK") | (F.col("action_id") % 50 == 0)).alias("executed"))
    return L.action_ledger(judged, outcomes)


ENTRIES = {**P.DECIDED, "entries": """SELECT *, CASE WHEN task_id % 9 = 0 THEN 'KEEP' ELSE treatment END AS t2, task_id % 9 = 0 OR treatment = 'KEEP' AS crossed,
    sensitivity IN ('CRITICAL', 'HIGH', 'MEDIUM') AS sens FROM decided"""}
Q["privacy_ledger"] = lambda spark, d: _ledger(spark, d).select("day", "task_id", "entity_ord", "kind", "masked", "treatment", "crossed_network")
SQL["privacy_ledger"] = V.with_views(
    P.BASE, "SELECT CAST(created_ts AS DATE) AS day, task_id, entity_ord, kind, masked, t2 AS treatment, crossed AS crossed_network FROM entries", ENTRIES
)
ACTS = {**AQ.judge_sql(False), "acts": "SELECT *, decision <> 'BLOCK' OR action_id % 50 = 0 AS executed FROM judged"}
Q["action_ledger"] = lambda spark, d: _actions(spark, d).select("day", "action_id", "decision", "risk", "untrusted_flag", "semantic_flag", "executed")
SQL["action_ledger"] = V.with_views(
    AQ.ACTION_VIEWS,
    "SELECT CAST(ts AS DATE) AS day, action_id, decision, risk, untrusted AS untrusted_flag, semantic_violation AS semantic_flag, executed FROM acts",
    ACTS,
)
_MDS = "count(*) FILTER (sens) AS sensitive, count(*) FILTER (sens AND necessity = 'NONE' AND crossed) AS exposed"
_SCORE = "round(CASE WHEN sensitive = 0 THEN 1.0 ELSE greatest(0, 1 - exposed / sensitive) END, 4) AS mds"
Q["minimum_disclosure_score"] = lambda spark, d: L.minimum_disclosure_score(_ledger(spark, d), ["kind"])
SQL["minimum_disclosure_score"] = V.with_views(P.BASE, f"SELECT *, {_SCORE} FROM (SELECT kind, {_MDS} FROM entries GROUP BY kind)", ENTRIES)
Q["unsafe_action_rate"] = lambda spark, d: L.unsafe_action_rate(_actions(spark, d), ["action"])
SQL["unsafe_action_rate"] = V.with_views(
    AQ.ACTION_VIEWS,
    """SELECT action, count(*) AS actions, count(*) FILTER ((untrusted OR semantic_violation) AND executed) AS unsafe,
      round(count(*) FILTER ((untrusted OR semantic_violation) AND executed) / count(*) * 100, 2) AS unsafe_pct FROM acts GROUP BY action""",
    ACTS,
)
Q["privacy_utility_efficiency"] = lambda spark, d: L.privacy_utility_efficiency(_ledger(spark, d), _actions(spark, d), ["task_id"])
SQL["privacy_utility_efficiency"] = V.with_views(
    [*P.BASE, *AQ.ACTION_VIEWS],
    """SELECT task_id, round(coalesce(mds, 1.0), 4) AS mds, round(coalesce(rate, 1.0), 4) AS success_rate, round(coalesce(mds, 1.0) * coalesce(rate, 1.0), 4) AS pue
      FROM m FULL JOIN r USING (task_id)""",
    {
        **ENTRIES, **ACTS,
        "m": f"SELECT task_id, {_SCORE} FROM (SELECT task_id, {_MDS} FROM entries GROUP BY task_id)",
        "r": "SELECT task_id, count(*) FILTER (executed) / count(*) AS rate FROM acts GROUP BY task_id",
    },
)


def task_dossier(spark, d):
    reports = policy.disclosure_counts(_entities(spark, d))
    fields = F.json_tuple("record", "kind", "treatment", "action_id", "decision", "detected").alias(
        "kind", "treatment", "action_id", "decision", "detected"
    )
    return L.task_dossier(_ledger(spark, d), _actions(spark, d), reports).select("task_id", "part", "seq", fields)


Q["task_dossier"] = task_dossier
SQL["task_dossier"] = V.with_views(
    [*P.BASE, *AQ.ACTION_VIEWS],
    """SELECT task_id, 'privacy' AS part, CAST(entity_ord AS BIGINT) AS seq, kind, t2 AS treatment, NULL AS action_id, NULL AS decision, NULL AS detected FROM entries
      UNION ALL SELECT task_id, 'action', action_id, NULL, NULL, CAST(action_id AS VARCHAR), decision, NULL FROM acts
      UNION ALL SELECT task_id, 'report', 0, NULL, NULL, NULL, NULL, CAST(count(*) AS VARCHAR) FROM entries GROUP BY task_id""",
    {**ENTRIES, **ACTS},
)


def utility_preserved(spark, d):
    """Some finds are false, some removals too wide, some addresses kept."""
    i = F.col("doc_id")

    def seeded(e):
        wide = (i % 5 == 0) & (e["pos"] >= 2)
        kept = (i % 3 == 0) & (e["kind"] == "EMAIL")
        start = F.when(wide, e["pos"] - 2).otherwise(e["pos"]).cast("int")
        raw = F.substring(F.col("text"), start + 1, e["pos"] - start + F.length(e["raw_value"]))
        return e.withField("treatment", F.when(kept, "KEEP").otherwise(e["treatment"])).withField("pos", start).withField("raw_value", raw)

    docs = P.decided_docs(spark, d).withColumn("truth", F.filter("entities", lambda e: (i % 4 != 0) | (e["kind"] != "PHONE")))
    docs = policy.redact_spans(docs.withColumn("entities", F.transform("entities", seeded)))
    return L.utility_preserved(docs, truth="truth").drop("readable")


Q["utility_preserved"] = utility_preserved
SQL["utility_preserved"] = V.with_views(
    P.BASE,
    """SELECT CAST(c AS BIGINT) AS chars, CAST(t AS BIGINT) AS sensitive, CAST(r AS BIGINT) AS removed, round(both_ / t * 100, 2) AS sensitive_removed_pct,
      round((c - r - t + both_) / (c - t) * 100, 2) AS benign_kept_pct, round((r - both_) / (c - t) * 100, 2) AS over_removal_pct
    FROM (SELECT sum(length(text)) AS c FROM texts_synth), (SELECT count(*) FILTER (t) AS t, count(*) FILTER (r) AS r, count(*) FILTER (t AND r) AS both_ FROM chars_)""",
    {
        **P.DECIDED,
        "chars_": """SELECT task_id, at_, bool_or(t) AS t, bool_or(r) AS r FROM (
          SELECT task_id, task_id % 4 <> 0 OR kind <> 'PHONE' AS t, false AS r, unnest(range(pos, pos + length(raw_value))) AS at_ FROM decided
          UNION ALL SELECT task_id, false, treatment <> 'KEEP' AND NOT (task_id % 3 = 0 AND kind = 'EMAIL'),
            unnest(range(CASE WHEN task_id % 5 = 0 AND pos >= 2 THEN pos - 2 ELSE pos END, pos + length(raw_value))) FROM decided) GROUP BY ALL""",
    },
)


def ledger_append(spark, d):
    """Both ledgers in three batches: one comes twice, one is cut off half-way and comes again."""
    found = []
    for name, rows in (("privacy", _ledger(spark, d)), ("action", _actions(spark, d))):
        path = fresh_path(spark, f"{name}-ledger")
        # the batches are parts of one table, which is derived once
        rows = written(rows, f"{name}-rows")
        for k in (0, 1, 1):
            L.append_ledger(rows.filter(F.col("task_id") % 3 == k), path, str(k))
        last = rows.filter(F.col("task_id") % 3 == 2)
        last.filter(F.col("task_id") % 2 == 0).write.partitionBy("day").parquet(f"{path}/data/batch=2")
        before = L.read_ledger(spark, path, rows.schema).groupBy("day", F.lit(f"{name}, two batches").alias("part")).agg(F.count("*").alias("n"))
        found.append(written(before, "seen"))
        L.append_ledger(last, path, "2")
        found.append(L.read_ledger(spark, path, rows.schema).groupBy("day", F.lit(f"{name}, whole").alias("part")).agg(F.count("*").alias("n")))
    return reduce(lambda a, b: a.unionByName(b), found)


Q["ledger_append"] = ledger_append
SQL["ledger_append"] = V.with_views(
    [*P.BASE, *AQ.ACTION_VIEWS],
    """SELECT * FROM (SELECT CAST(created_ts AS DATE) AS day, 'privacy, two batches' AS part, count(*) AS n FROM entries WHERE task_id % 3 < 2 GROUP BY ALL
      UNION ALL SELECT CAST(created_ts AS DATE), 'privacy, whole', count(*) FROM entries GROUP BY ALL
      UNION ALL SELECT CAST(ts AS DATE), 'action, two batches', count(*) FROM acts WHERE task_id % 3 < 2 GROUP BY ALL
      UNION ALL SELECT CAST(ts AS DATE), 'action, whole', count(*) FROM acts GROUP BY ALL)""",
    {**ENTRIES, **ACTS},
)
