"""Rows behind the watermark: kept beside the others and counted, instead of lost."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def split_late(stream: DataFrame, ts: str, delay_ms: int, path: str) -> None:
    """Drain ``stream`` into ``path``, each micro-batch split into rows on time and late rows.

    A row is late if its time is not after the latest time of all micro-batches
    before its own, less ``delay_ms`` (to the millisecond), which is when stateful
    operators with that watermark drop it. A row without a time is late. One small
    row per batch remembers the latest time, so a restarted stream goes on, and a
    batch that is run again overwrites what it wrote.
    """
    spark = stream.sparkSession
    marks = T.StructType([T.StructField("last", T.TimestampType()), T.StructField("batch", T.LongType())])

    def split(batch: DataFrame, number: int) -> None:
        cut = None
        if number:
            seen = spark.read.schema(marks).parquet(f"{path}/marks").filter(F.col("batch") < number)
            cut = seen.agg(F.unix_millis(F.max("last"))).first()[0]
        behind = F.col(ts).isNull()
        if cut is not None:
            behind = behind | (F.col(ts) <= F.timestamp_millis(F.lit(cut - delay_ms)))
        folder = f"{path}/rows/batch={number}"
        batch.withColumn("late", behind).write.mode("overwrite").partitionBy("late").parquet(folder)
        rows = spark.read.schema(batch.schema).parquet(folder)
        rows.agg(F.max(ts).cast("timestamp").alias("last")).write.mode("overwrite").parquet(f"{path}/marks/batch={number}")

    query = stream.writeStream.option("checkpointLocation", f"{path}/checkpoint").foreachBatch(split).trigger(availableNow=True).start()
    query.awaitTermination()


def on_time(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 1) -> DataFrame:
    """The rows on time as a stream in the order of their batches; none of them is late for its own watermark."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(f"{path}/rows/batch=*/late=false")


def late_rows(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The side output, with the batch in which each row came."""
    whole = T.StructType([*schema.fields, T.StructField("late", T.BooleanType()), T.StructField("batch", T.LongType())])
    return spark.read.schema(whole).parquet(f"{path}/rows").filter("late").drop("late")
