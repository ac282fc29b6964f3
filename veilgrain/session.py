"""Session settings the operators assume, and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_own_dirs: dict[str, str] = {}


def build_session(app: str = "veilgrain", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and skew handling on and UTC time."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can see: ``spark.checkpoint.dir`` when it is set.

    Only a local session may leave it unset; one is made then. On a cluster a folder
    of one machine would lose data, so its absence is an error there.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        if "path" not in _own_dirs:
            _own_dirs["path"] = tempfile.mkdtemp(prefix="veilgrain-")
        named = _own_dirs["path"]
    return named.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new sub-folder name of the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def written(df, label: str, compression: str = "snappy"):
    """Materialise ``df`` as a table in the shared folder and read it back.

    Used where a result feeds several consumers or a loop: it cuts the lineage
    and survives the loss of executors.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)
