"""Streaming forms, drained and compared with their batch results."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilgrain.functions import text as X
from veilgrain.operators import actions as A
from veilgrain.plans import action_queries as AQ
from veilgrain.plans import views as V
from veilgrain.session import fresh_path
from veilgrain.sources.tables import stream_table
from veilgrain.streaming import late as L
from veilgrain.streaming import streams as S

Q = {}
SQL = {}


def _events(spark, d):
    return stream_table(spark, d, "events")


def replay_filter(spark, d):
    e = F.col("event_id")
    copies = F.when(e % 10 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    uses = _events(spark, d).select(e.alias("token_id"), "ts", F.explode(copies).alias("k"))
    return S.drain(S.replay_filter(uses, "token_id", "ts").select("token_id"), "replay")


Q["replay_filter"] = replay_filter
SQL["replay_filter"] = "SELECT event_id AS token_id FROM events"


def response_join(spark, d):
    requests, _ = AQ.capture_frames(_events(spark, d))
    _, responses = AQ.capture_frames(_events(spark, d))
    return S.drain(S.response_join(requests, responses).select(F.col("q_nonce").alias("nonce")), "responses")


Q["response_join"] = response_join
SQL["response_join"] = f"SELECT event_id AS nonce FROM ({AQ.RESPONSES_SQL}) WHERE verdict = 'OK'"


def exfil_chain_stream(spark, d):
    acts = V.actions(spark, d, _events(spark, d))
    rules = V.anchors(spark, d).select("task_id", X.normalise_text(F.col("origin")).alias("_o"))
    nav, live = X.normalise_text(F.col("value")), X.normalise_text(F.col("live_origin"))
    tagged = acts.withColumn("_n", nav).withColumn("_l", live).join(rules, "task_id").select(
        "task_id", "action_id", "ts",
        A.carries_input(F.col("action"), F.col("value")).alias("is_input"),
        ((F.col("action") == "NAVIGATE") & ~F.contains("_n", "_o") & ~F.contains("_n", "_l")).alias("away"),
    )
    return S.drain(S.exfil_chain_stream(tagged, idle_days=365), "chains").select("action_id", "exfil_chain")


Q["exfil_chain_stream"] = exfil_chain_stream
SQL["exfil_chain_stream"] = AQ.EXFIL_SQL


def vault_ttl_stream(spark, d):
    sightings = _events(spark, d).select(
        F.col("user_id").alias("task_id"), F.lit("https://a.example").alias("origin"), F.col("event_type").alias("raw_value"), "ts"
    )
    return S.drain(S.vault_ttl_stream(sightings, ttl_minutes=60 * 24 * 3), "vault")


Q["vault_ttl_stream"] = vault_ttl_stream
SQL["vault_ttl_stream"] = """WITH RECURSIVE s AS (SELECT user_id AS task_id, event_type AS raw_value, epoch_us(ts) AS us FROM events),
  made AS (SELECT task_id, raw_value, min(us) AS us FROM s GROUP BY task_id, raw_value
    UNION ALL SELECT m.task_id, m.raw_value, min(s.us) AS us FROM made m JOIN s ON s.task_id = m.task_id AND s.raw_value = m.raw_value
      AND s.us >= m.us + 259200000000 GROUP BY m.task_id, m.raw_value)
  SELECT task_id, 'https://a.example' AS origin, raw_value, us AS created_us FROM made"""


def stale_filter(spark, d):
    e = F.col("event_id")
    stream = _events(spark, d).select(
        "event_id", F.col("ts").alias("captured_ts"), F.timestamp_add("SECOND", e % 17 - 2, F.col("ts")).alias("received_ts")
    )
    path = fresh_path(spark, "stale")
    S.stale_filter(stream, "captured_ts", "received_ts", path)
    fresh = spark.read.parquet(f"{path}/fresh").select("event_id", "route")
    gone = spark.read.parquet(f"{path}/discarded").select("event_id", "route")
    return fresh.unionByName(gone).groupBy("route").agg(F.count("*").alias("n"), F.sum("event_id").alias("id_sum"))


Q["stale_filter"] = stale_filter
SQL["stale_filter"] = """SELECT CASE WHEN event_id % 17 - 2 < 0 THEN 'future' WHEN event_id % 17 - 2 > 10 THEN 'stale' ELSE 'fresh' END AS route, count(*) AS n,
  CAST(sum(event_id) AS BIGINT) AS id_sum FROM events GROUP BY 1"""


def ledger_stream(spark, d):
    e = F.col("event_id")
    rows = _events(spark, d).select(
        "ts", (e % 5 == 3).alias("untrusted_flag"), (e % 7 != 0).alias("executed"), (e % 3 != 0).alias("sensitive"), (e % 12 == 1).alias("exposed")
    )
    out = S.drain_updates(S.ledger_stream(rows), ["window_start"], "ledger")
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


Q["ledger_stream"] = ledger_stream
SQL["ledger_stream"] = """SELECT window_start, actions, unsafe, round(unsafe / actions * 100, 2) AS unsafe_pct, round(CASE WHEN sens = 0 THEN 1.0 ELSE 1 - exposed / sens END, 4) AS mds FROM (
  SELECT date_trunc('hour', ts) AS window_start, count(*) AS actions, count(*) FILTER (event_id % 5 = 3 AND event_id % 7 <> 0) AS unsafe,
    count(*) FILTER (event_id % 3 <> 0) AS sens, count(*) FILTER (event_id % 12 = 1) AS exposed FROM events GROUP BY 1)"""


# --- late rows --------------------------------------------------------------

#: The events arrive in six files of five days; every tenth one six days late.
ARRIVAL_SQL = """CAST(least(5, greatest(0, (epoch_us(ts) // 1000000 + CASE WHEN event_id % 10 = 0 THEN 518400 ELSE 0 END - 1704067200) // 432000)) AS BIGINT)"""


def _arriving(spark, d, shuffled: bool):
    """The events as a stream of six files, one a micro-batch: by arrival, or dealt by id."""
    events = V.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")).select("event_id", "ts")
    arrival = F.unix_seconds("ts") + F.when(F.col("event_id") % 10 == 0, 518400).otherwise(0)
    place = F.col("event_id") % 6 if shuffled else F.least(F.lit(5), F.greatest(F.lit(0), F.floor((arrival - 1704067200) / 432000)))
    path = fresh_path(spark, "arrivals")
    for k in range(6):
        events.filter(place == k).coalesce(1).write.parquet(f"{path}/file={k}")
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/file=*")


def _late_windows(spark, d, shuffled: bool):
    """Events per hour: those a windowed aggregate counted, and those beside it."""
    stream = _arriving(spark, d, shuffled)
    path = fresh_path(spark, "late")
    L.split_late(stream, "ts", 3_600_000, path)
    e = F.col("event_id")
    ledger = L.on_time(spark, path, stream.schema).select(
        "ts", (e % 5 == 3).alias("untrusted_flag"), (e % 7 != 0).alias("executed"), (e % 3 != 0).alias("sensitive"), (e % 12 == 1).alias("exposed")
    )
    counted = S.drain_updates(S.ledger_stream(ledger), ["window_start"], "ledger").select("window_start", F.col("actions").alias("on_time"))
    beside = L.late_rows(spark, path, stream.schema).groupBy(F.date_trunc("hour", "ts").alias("window_start")).agg(F.count("*").alias("late"))
    both = counted.join(beside, "window_start", "full_outer").fillna(0, ["on_time", "late"])
    return both.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


def _late_sql(place: str) -> str:
    return f"""SELECT date_trunc('hour', ts) AS window_start, count(*) FILTER (NOT behind) AS on_time, count(*) FILTER (behind) AS late FROM (
      SELECT ts, coalesce(ts <= date_trunc('milliseconds', seen) - INTERVAL 1 HOUR, false) AS behind FROM (SELECT ts, {place} AS k FROM events) e
        JOIN (SELECT k, max(last) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM (
          SELECT b.k, max(ts) AS last FROM (SELECT unnest(range(6)) AS k) b LEFT JOIN (SELECT ts, {place} AS k FROM events) e ON e.k = b.k GROUP BY b.k)) m USING (k)) GROUP BY 1"""


Q["late_rows"] = lambda spark, d: _late_windows(spark, d, False)
SQL["late_rows"] = _late_sql(ARRIVAL_SQL)
Q["late_rows_shuffled"] = lambda spark, d: _late_windows(spark, d, True)
SQL["late_rows_shuffled"] = _late_sql("event_id % 6")
