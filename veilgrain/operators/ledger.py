"""Append-only ledgers and the privacy metrics computed from them."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SENSITIVE = ("CRITICAL", "HIGH", "MEDIUM")


def privacy_ledger(entities: DataFrame, ts: str = "created_ts") -> DataFrame:
    """One row per decided entity; raw values never enter, only whether they crossed."""
    visual = F.col("visual_only") if "visual_only" in entities.columns else F.lit(False)
    token = F.col("token") if "token" in entities.columns else F.lit(None).cast("string")
    return entities.select(
        F.to_date(ts).alias("day"), F.col(ts).alias("ts"), "task_id", "entity_ord", "kind", "masked", "confidence",
        "sensitivity", "necessity", "treatment", (F.col("treatment") == "KEEP").alias("crossed_network"),
        token.alias("token"), F.coalesce(visual, F.lit(False)).alias("visual_only"),
    )


def action_ledger(judged: DataFrame, outcomes: DataFrame | None = None) -> DataFrame:
    """One row per judged action with its outcome, where one is known."""
    rows = judged.select(
        F.to_date("ts").alias("day"), "ts", "task_id", "action_id", "action", "node_id", "risk", "decision", "reason",
        F.col("untrusted").alias("untrusted_flag"), F.col("semantic_violation").alias("semantic_flag"),
    )
    if outcomes is None:
        return rows.withColumn("executed", F.lit(None).cast("boolean"))
    return rows.join(outcomes.select("action_id", "executed"), "action_id", "left")


COMMIT = T.StructType([T.StructField("n_rows", T.LongType()), T.StructField("batch", T.StringType())])


def committed(spark: SparkSession, path: str) -> DataFrame:
    """(n_rows, batch) of every whole batch of a ledger."""
    try:
        return spark.read.schema(COMMIT).parquet(f"{path}/commits")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], COMMIT)


def append_ledger(rows: DataFrame, path: str, batch: str) -> bool:
    """Append ``rows`` as the batch of that name, once; False if it is there already.

    Rows go into a folder of the batch, by day, and count only when the batch is
    named among the commits, which is the last thing written. A batch that was cut off
    leaves no trace for readers and is written over when it comes again; one that is
    whole is not touched, so a replay adds nothing.
    """
    spark = rows.sparkSession
    if not committed(spark, path).filter(F.col("batch") == batch).isEmpty():
        return False
    folder = f"{path}/data/batch={batch}"
    rows.write.mode("overwrite").partitionBy("day").parquet(folder)
    n = spark.read.schema(rows.schema).parquet(folder).agg(F.count("*").alias("n_rows"))
    n.write.mode("overwrite").parquet(f"{path}/commits/batch={batch}")
    return True


def read_ledger(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows of all whole batches; a filter on ``day`` or ``batch`` reads no other folders."""
    done = committed(spark, path).select("batch")
    whole = T.StructType([*(f for f in schema.fields if f.name != "batch"), T.StructField("batch", T.StringType())])
    return spark.read.schema(whole).parquet(f"{path}/data").join(done, "batch", "left_semi")


def minimum_disclosure_score(ledger: DataFrame, by: list[str] | None = None) -> DataFrame:
    """1 - unnecessary values exposed / sensitive values detected; 1 when none."""
    sensitive = F.col("sensitivity").isin(*SENSITIVE)
    exposed = sensitive & (F.col("necessity") == "NONE") & F.col("crossed_network")
    counts = ledger.groupBy(*(by or [])).agg(
        F.count_if(sensitive).alias("sensitive"), F.count_if(exposed).alias("exposed")
    )
    score = F.when(F.col("sensitive") == 0, 1.0).otherwise(
        F.greatest(F.lit(0.0), 1 - F.col("exposed") / F.col("sensitive"))
    )
    return counts.withColumn("mds", F.round(score, 4))


def action_rates(actions: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Success rate and share of unsafe actions that were carried out."""
    done = F.coalesce("executed", F.lit(False))
    unsafe = (F.col("untrusted_flag") | F.col("semantic_flag")) & done
    n = F.count("*")
    return actions.groupBy(*(by or [])).agg(
        n.alias("actions"),
        F.count_if(done).alias("executed"),
        F.count_if(unsafe).alias("unsafe"),
        F.when(n > 0, F.count_if(done) / n).otherwise(1.0).alias("success_rate"),
        F.when(n > 0, F.round(F.count_if(unsafe) / n * 100, 2)).otherwise(0.0).alias("unsafe_pct"),
    )


def unsafe_action_rate(actions: DataFrame, by: list[str] | None = None) -> DataFrame:
    return action_rates(actions, by).drop("executed", "success_rate")


def privacy_utility_efficiency(ledger: DataFrame, actions: DataFrame, by: list[str]) -> DataFrame:
    """Disclosure score times success rate; a missing side counts as 1."""
    mds = minimum_disclosure_score(ledger, by).select(*by, "mds")
    rate = action_rates(actions, by).select(*by, "success_rate")
    joined = mds.join(rate, by, "full_outer")
    m, r = F.coalesce("mds", F.lit(1.0)), F.coalesce("success_rate", F.lit(1.0))
    return joined.select(*by, F.round(m, 4).alias("mds"), F.round(r, 4).alias("success_rate"), F.round(m * r, 4).alias("pue"))


def task_dossier(entries: DataFrame, actions: DataFrame, reports: DataFrame) -> DataFrame:
    """Everything known about each task as rows ``task_id, part, seq, record``.

    Rows, not arrays: a task with very many entries stays spread out. ``seq``
    orders a part, ``record`` is its JSON.
    """

    def part(df, name, seq):
        rest = [c for c in df.columns if c != "task_id"]
        return df.select(
            "task_id", F.lit(name).alias("part"), seq.cast("long").alias("seq"), F.to_json(F.struct(*rest)).alias("record")
        )

    return (
        part(entries, "privacy", F.col("entity_ord"))
        .unionByName(part(actions, "action", F.col("action_id")))
        .unionByName(part(reports, "report", F.lit(0)))
    )


def utility_preserved(
    docs: DataFrame, text: str = "text", redacted: str = "redacted", entities: str = "entities", truth: str | None = None
) -> DataFrame:
    """Characters: sensitive ones removed, benign ones kept or lost, and values still to be read.

    ``entities`` is the decided array of each row; what it does not KEEP is removed.
    ``truth`` holds what is sensitive indeed, as an array with ``pos`` and
    ``raw_value``, and is the decided array unless named. Overlapping spans count
    once. ``readable`` counts true values the redacted text still contains.
    """
    def spans(values):
        return F.transform(values, lambda e: F.struct(e["pos"].alias("s"), (e["pos"] + F.length(e["raw_value"])).alias("e")))

    def covered(listed):
        start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("n"))
        return F.aggregate(
            F.array_sort(listed), start,
            lambda acc, s: F.struct(
                F.greatest(acc["at"], s["e"]).alias("at"),
                (acc["n"] + F.greatest(F.lit(0), s["e"] - F.greatest(acc["at"], s["s"]))).alias("n"),
            ),
            lambda acc: acc["n"],
        )

    known = F.col(truth or entities)
    gone = spans(F.filter(F.col(entities), lambda e: e["treatment"] != "KEEP"))
    seen = F.filter(known, lambda e: (F.length(e["raw_value"]) > 2) & F.contains(F.col(redacted), e["raw_value"]))
    counted = docs.select(
        F.length(text).alias("chars"), covered(spans(known)).alias("sensitive"), covered(gone).alias("removed"),
        covered(F.concat(spans(known), gone)).alias("either"), F.size(seen).alias("readable"),
    )
    sums = counted.agg(*[F.sum(c).alias(c) for c in counted.columns])
    benign, over = F.col("chars") - F.col("sensitive"), F.col("either") - F.col("sensitive")
    caught = F.col("removed") + F.col("sensitive") - F.col("either")
    return sums.select(
        "chars", "sensitive", "removed",
        F.when(F.col("sensitive") > 0, F.round(caught / F.col("sensitive") * 100, 2)).otherwise(100.0).alias("sensitive_removed_pct"),
        F.when(benign > 0, F.round((benign - over) / benign * 100, 2)).otherwise(100.0).alias("benign_kept_pct"),
        F.when(benign > 0, F.round(over / benign * 100, 2)).otherwise(0.0).alias("over_removal_pct"),
        "readable",
    )
