"""Table sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilgrain import constants as K
from veilgrain.functions.boxes import js_round

SAMPLE_SCHEMA = T.StructType(
    [
        T.StructField("sample_id", T.StringType()),
        T.StructField(
            "viewport",
            T.StructType(
                [T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType())]
            ),
        ),
        T.StructField(
            "annotations",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("id", T.StringType()),
                        T.StructField("category", T.StringType()),
                        T.StructField("bbox", T.ArrayType(T.DoubleType())),
                    ]
                )
            ),
        ),
    ]
)
SAMPLE_FILE_SCHEMA = T.StructType([T.StructField("samples", T.ArrayType(SAMPLE_SCHEMA))])
PROMPT_SCHEMA = T.StructType(
    [
        T.StructField("id", T.IntegerType()),
        T.StructField("prompt", T.StringType()),
        T.StructField("vector", T.StringType()),
        T.StructField("is_attack", T.BooleanType()),
    ]
)


def read_table(
    spark: SparkSession, folder: str, name: str, fmt: str = "parquet", schema: T.StructType | None = None
) -> DataFrame:
    """One table of a folder: parquet, ORC, or JSON documents with a stated schema."""
    path = f"{folder}/{name}.{fmt}"
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "json":
        if schema is None:
            raise ValueError("JSON sources need a schema; inference would read the data twice")
        return reader.json(path, multiLine=True)
    return reader.format(fmt).load(path)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Spread a small scan over the cores before heavy per-row work.

    A file of one row group is read by one task however many cores there are.
    Scans that already have a split per core, as all large ones do, are left
    alone, so nothing is shuffled at scale.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores * 4, key) if df.rdd.getNumPartitions() < cores else df


def flatten_samples(samples: DataFrame) -> DataFrame:
    """Nested samples to one row per annotated box."""
    if "samples" in samples.columns:
        samples = samples.select(F.explode("samples").alias("s")).select("s.*")
    rows = samples.select(
        F.col("sample_id").alias("image_id"),
        F.col("viewport.width").alias("vp_w"),
        F.col("viewport.height").alias("vp_h"),
        F.posexplode("annotations").alias("gt_ord", "a"),
    )
    return rows.select(
        "image_id",
        "vp_w",
        "vp_h",
        "gt_ord",
        F.col("a.id").alias("gt_id"),
        F.col("a.category").alias("cls"),
        *[F.col("a.bbox")[i].alias(c) for i, c in enumerate("xywh")],
    )


def decode_slots(
    slots: DataFrame,
    vp_w: int = 1920,
    vp_h: int = 1080,
    min_conf: float = 0.30,
    min_size: int = 15,
    class_rounding: str = "round",
) -> DataFrame:
    """Raw detector slots ``v = [x1, y1, x2, y2, logit, class]`` to boxes.

    ``class_rounding`` is ``round`` (half up) or ``truncate``; both are in use.
    A slot without a logit has no confidence and is dropped.
    """
    unit = [
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.get("v", i).cast("double"))) for i in range(4)
    ]
    x1, y1, x2, y2 = unit
    raw_cls = F.get("v", 5).cast("double")
    whole = js_round(raw_cls) if class_rounding == "round" else raw_cls.cast("long")
    left = x1 if class_rounding == "round" else F.least(x1, x2)
    top = y1 if class_rounding == "round" else F.least(y1, y2)
    conf = 1.0 / (1.0 + F.exp(-F.get("v", 4).cast("double")))
    return slots.select(
        "image_id",
        "slot",
        (F.abs(whole) % len(K.UI_CLASSES)).cast("int").alias("cls"),
        conf.alias("conf"),
        js_round(left * vp_w).alias("x"),
        js_round(top * vp_h).alias("y"),
        F.greatest(F.lit(min_size).cast("long"), js_round(F.abs(x2 - x1) * vp_w)).alias("w"),
        F.greatest(F.lit(min_size).cast("long"), js_round(F.abs(y2 - y1) * vp_h)).alias("h"),
    ).filter(F.col("conf") >= min_conf)


def content_manifest(df: DataFrame, keys: list[str]) -> DataFrame:
    """One SHA-256 per member, over every non-key column in name order."""
    rest = sorted(c for c in df.columns if c not in keys)
    parts = []
    for name in rest:
        text = F.col(name).cast("string")
        # Length-prefix each field so that neighbouring fields cannot run together.
        parts.append(
            F.when(text.isNull(), F.lit("-")).otherwise(
                F.concat(F.length(text).cast("string"), F.lit(":"), text)
            )
        )
    digest = F.sha2(F.concat_ws("|", F.lit(",".join(rest)), *parts), 256)
    return df.select(*keys, digest.alias("digest"))


def file_manifest(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 of every file below ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("digest"))


def manifest_diff(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """ADDED / REMOVED / CHANGED / SAME per member of two manifests."""
    old = before.select(*keys, F.col("digest").alias("old_digest"))
    new = after.select(*keys, F.col("digest").alias("new_digest"))
    status = (
        F.when(F.col("old_digest").isNull(), "ADDED")
        .when(F.col("new_digest").isNull(), "REMOVED")
        .when(F.col("old_digest") != F.col("new_digest"), "CHANGED")
        .otherwise("SAME")
    )
    return old.join(new, keys, "full_outer").withColumn("status", status)


def sample_manifest_join(samples: DataFrame, manifest: DataFrame, keys: list[str]) -> DataFrame:
    """Attach manifest columns; samples without an entry stay.

    No broadcast is forced: the planner broadcasts the manifest only while its
    measured size is below ``spark.sql.autoBroadcastJoinThreshold``.
    """
    return samples.join(manifest, keys, "left")


def write_report(
    df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None
) -> None:
    """Machine-readable results, optionally partitioned."""
    writer = df.write.mode("errorifexists").format(fmt)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def stream_table(
    spark: SparkSession, folder: str, name: str, max_files_per_trigger: int | None = None
) -> DataFrame:
    """A parquet table as a stream; NTZ timestamps become timestamps for watermarks."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    # The file source wants a folder or a glob; the glob covers a single file too.
    stream = reader.parquet(f"{folder}/{name}.[p]arquet")
    for field in stream.schema.fields:
        if isinstance(field.dataType, T.TimestampNTZType):
            stream = stream.withColumn(field.name, F.col(field.name).cast("timestamp"))
    return stream
