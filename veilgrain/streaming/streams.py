"""Streaming forms; each equals its batch operator once the stream is drained."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from veilgrain import constants as K
from veilgrain.session import fresh_path

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """State on local disk with checkpoints in the shared folder, not on the heap."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def drain(stream: DataFrame, label: str, output_mode: str = "append") -> DataFrame:
    """Run ``stream`` over everything available and return what it wrote.

    Output and checkpoint live in the shared folder, so the run can be resumed
    after a lost driver or executor and the file sink stays exactly-once.
    """
    spark = stream.sparkSession
    path = fresh_path(spark, label)
    query = (
        stream.writeStream.format("parquet")
        .outputMode(output_mode)
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True)
        .start(f"{path}/out")
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


def drain_updates(stream: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Run an aggregation in update mode and return the latest row per key.

    Each micro-batch overwrites its own folder, so a repeated batch changes
    nothing.
    """
    spark = stream.sparkSession
    path = fresh_path(spark, label)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={number}")

    query = (
        stream.writeStream.outputMode("update")
        .option("checkpointLocation", f"{path}/checkpoint")
        .foreachBatch(keep)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    rows = spark.read.parquet(f"{path}/out")
    rest = [c for c in stream.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max(F.struct("batch", *rest)).alias("_l"))
    return last.select(*keys, *[F.col(f"_l.{c}").alias(c) for c in rest])


def replay_filter(uses: DataFrame, ident: str, ts: str, delay: str = "1 minute") -> DataFrame:
    """Drop re-used token or nonce ids; ids are remembered for ``delay`` of event time."""
    return uses.withWatermark(ts, delay).dropDuplicatesWithinWatermark([ident])


def response_join(requests: DataFrame, responses: DataFrame, max_age: str = "5 seconds", delay: str = "1 minute",
                  unanswered: bool = False) -> DataFrame:
    """Responses matched to the request of their nonce within ``max_age``.

    Both sides carry watermarks and the range condition bounds the state. With
    ``unanswered`` requests that nobody answered come out as well (task NULL).
    """
    asked = requests.withWatermark("asked_ts", delay).select(
        F.col("nonce").alias("q_nonce"), F.col("task_id").alias("q_task_id"), F.col("origin").alias("q_origin"), "asked_ts"
    )
    got = replay_filter(responses, "nonce", "received_ts", delay)
    within = F.expr(
        f"q_nonce = nonce AND received_ts >= asked_ts AND received_ts <= asked_ts + interval {max_age}"
    )
    agree = (F.col("task_id") == F.col("q_task_id")) & (F.col("origin") == F.col("q_origin"))
    joined = asked.join(got, within & agree, "left_outer" if unanswered else "inner")
    return joined.select("q_nonce", "asked_ts", "received_ts", "task_id")


class _ChainProcessor(StatefulProcessor):
    """Remembers the first input of a task; forgets a task that stays idle."""

    def __init__(self, idle_ms: int) -> None:
        self.idle_ms = idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.first = handle.getValueState("first", "at bigint, id bigint, last bigint")

    def handleInputRows(self, key, rows, timerValues):
        state = self.first.get() if self.first.exists() else None
        first = (state[0], state[1]) if state and state[0] is not None else None
        last = state[2] if state else 0
        timer = last // 1000 + self.idle_ms if state else None
        # sixteen bytes a departure of this micro-batch
        undecided = []
        for pdf in rows:
            inputs = pdf[pdf["is_input"]]
            if len(inputs):
                top = inputs.sort_values(["at", "action_id"]).iloc[0]
                seen = (int(top["at"]), int(top["action_id"]))
                first = seen if first is None else min(first, seen)
            last = max(last, int(pdf["at"].max()))
            # Only departures can be chains; they wait until the batch's first input is known.
            away = pdf["away"].to_numpy(bool)
            undecided.append(pdf.loc[away, ["action_id", "at"]].to_numpy(np.int64))
            calm = pdf.loc[~away, ["task_id", "action_id"]]
            if len(calm):
                yield calm.assign(exfil_chain=False)
        rest = np.concatenate(undecided)
        if len(rest):
            if first is None:
                hit = np.zeros(len(rest), dtype=bool)
            else:
                hit = (rest[:, 1] > first[0]) | ((rest[:, 1] == first[0]) & (rest[:, 0] > first[1]))
            yield pd.DataFrame({"task_id": key[0], "action_id": rest[:, 0], "exfil_chain": hit})
        self.first.update((first[0] if first else None, first[1] if first else None, last))
        # one timer a task: the earlier one goes before the new one comes
        if timer != last // 1000 + self.idle_ms:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(last // 1000 + self.idle_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self.first.exists() and self.first.get()[2] // 1000 + self.idle_ms <= expiredTimerInfo.getExpiryTimeInMs():
            self.first.clear()
        return iter(())

    def close(self) -> None:
        pass


def exfil_chain_stream(actions: DataFrame, idle_days: int = 30, delay: str = "1 hour") -> DataFrame:
    """Chain test with per-task state and an event-time timer for idle tasks.

    Expects ``task_id, action_id, ts, is_input, away`` (see ``chain_columns``).
    An input that arrives late changes later verdicts only.
    """
    use_rocksdb(actions.sparkSession)
    out = T.StructType(
        [
            T.StructField("task_id", T.LongType()),
            T.StructField("action_id", T.LongType()),
            T.StructField("exfil_chain", T.BooleanType()),
        ]
    )
    rows = actions.withWatermark("ts", delay).select(
        "task_id", "action_id", "ts", F.unix_micros("ts").alias("at"), "is_input", "away"
    )
    return rows.groupBy("task_id").transformWithStateInPandas(
        statefulProcessor=_ChainProcessor(idle_days * 86_400_000), outputStructType=out, outputMode="Append", timeMode="EventTime"
    )


class _VaultProcessor(StatefulProcessor):
    """First sight of a value makes an entry; the next one after expiry makes another."""

    def __init__(self, ttl_us: int) -> None:
        self.ttl_us = ttl_us

    def init(self, handle) -> None:
        self.handle = handle
        self.expires = handle.getValueState("expires", "at bigint")

    def handleInputRows(self, key, rows, timerValues):
        # Eight bytes a sighting: only the times of the micro-batch are held.
        times = np.sort(np.concatenate([pdf["at"].to_numpy(np.int64) for pdf in rows]))
        # every call to the state is a round trip, and every frame a batch of its own: no more than needed of either
        held = self.expires.get()
        expires = int(held[0]) if held else -(2**62)
        timer = expires // 1000
        made, i = [], int(np.searchsorted(times, expires))
        while i < len(times):
            made.append(int(times[i]))
            expires = int(times[i]) + self.ttl_us
            i = int(np.searchsorted(times, expires))
        if made:
            self.expires.update((expires,))
            if timer > -(2**52):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(expires // 1000)
            task, origin, value = key
            yield pd.DataFrame({"task_id": task, "origin": origin, "raw_value": value, "created_us": np.array(made, dtype=np.int64)})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        held = self.expires.get()
        if held and held[0] // 1000 <= expiredTimerInfo.getExpiryTimeInMs():
            self.expires.clear()
        return iter(())

    def close(self) -> None:
        pass


def vault_ttl_stream(sightings: DataFrame, ttl_minutes: int = K.VAULT_TTL_MINUTES, delay: str = "1 hour") -> DataFrame:
    """Vault entries from a stream of ``task_id, origin, raw_value, ts``; entries live ``ttl_minutes``."""
    use_rocksdb(sightings.sparkSession)
    out = T.StructType(
        [
            T.StructField("task_id", T.LongType()),
            T.StructField("origin", T.StringType()),
            T.StructField("raw_value", T.StringType()),
            T.StructField("created_us", T.LongType()),
        ]
    )
    rows = sightings.withWatermark("ts", delay).select(
        "task_id", "origin", "raw_value", "ts", F.unix_micros("ts").alias("at")
    )
    return rows.groupBy("task_id", "origin", "raw_value").transformWithStateInPandas(
        statefulProcessor=_VaultProcessor(ttl_minutes * 60_000_000), outputStructType=out, outputMode="Append", timeMode="EventTime"
    )


def staleness(captured: str, received: str, max_age_ms: int = K.GROUNDING_MAX_AGE_MS):
    """``fresh``, ``stale`` or ``future`` by event time against ingest time; without both times ``stale``."""
    age = F.unix_millis(received) - F.unix_millis(captured)
    return F.when(age < 0, "future").when(age <= max_age_ms, "fresh").otherwise("stale")


def stale_filter(stream: DataFrame, captured: str, received: str, path: str, max_age_ms: int = K.GROUNDING_MAX_AGE_MS) -> None:
    """Fresh captures to ``path/fresh``; discarded ones to ``path/discarded`` with their reason.

    Each micro-batch is scanned once per sink and overwrites its own folders.
    """
    tagged = stream.withColumn("route", staleness(captured, received, max_age_ms))

    def split(batch: DataFrame, number: int) -> None:
        batch.filter("route = 'fresh'").write.mode("overwrite").parquet(f"{path}/fresh/batch={number}")
        batch.filter("route <> 'fresh'").write.mode("overwrite").parquet(f"{path}/discarded/batch={number}")

    query = (
        tagged.writeStream.option("checkpointLocation", f"{path}/checkpoint").foreachBatch(split).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def ledger_stream(ledger: DataFrame, ts: str = "ts", every: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Unsafe-action and disclosure figures per tumbling window.

    Expects ``untrusted_flag, executed, sensitive, exposed`` booleans.
    """
    unsafe = F.col("untrusted_flag") & F.col("executed")
    sums = ledger.withWatermark(ts, delay).groupBy(F.window(ts, every).alias("w")).agg(
        F.count("*").alias("actions"), F.count_if(unsafe).alias("unsafe"),
        F.count_if("sensitive").alias("sensitive"), F.count_if("exposed").alias("exposed"),
    )
    mds = F.when(F.col("sensitive") == 0, 1.0).otherwise(1 - F.col("exposed") / F.col("sensitive"))
    return sums.select(
        F.col("w.start").alias("window_start"), "actions", "unsafe",
        F.round(F.col("unsafe") / F.col("actions") * 100, 2).alias("unsafe_pct"), F.round(mds, 4).alias("mds"),
    )
