"""Connected components as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilgrain.session import written


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(vertex, component) for every end of an edge; the component is its least vertex.

    Every round takes the least label among neighbours and then the label of that
    label, so long chains shrink fast. Aggregates combine before the shuffle, and
    each round is written to the shared folder.
    """
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    both = written(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    labels = written(both.groupBy("u").agg(F.least("u", F.min("v")).alias("c")).select(F.col("u").alias("vertex"), "c"), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("vertex", "v"), "v").groupBy("u").agg(F.min("c").alias("m"))
        step = labels.join(near.withColumnRenamed("u", "vertex"), "vertex").select("vertex", "c", F.least("c", "m").alias("d"))
        jump = labels.select(F.col("vertex").alias("d"), F.col("c").alias("e"))
        step = step.join(jump, "d").select("vertex", F.col("e").alias("c"), (F.col("e") != F.col("c")).alias("moved"))
        step = written(step, "labels")
        if step.where("moved").isEmpty():
            return step.select("vertex", F.col("c").alias("component"))
        labels = step.select("vertex", "c")
