"""Connected components of an edge table, by smallest labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.sources.scratch import written


def components(edges: DataFrame) -> DataFrame:
    """node and component (its smallest node) of every node in ``edges`` (a, b: long)."""
    both = written(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        lowered = written(
            labels.join(near, "node").select("node", F.least("component", "near").alias("next"), (F.col("near") < F.col("component")).alias("moved")), "labels"
        )
        jump = lowered.select(F.col("node").alias("next"), F.col("next").alias("further"))
        moved = lowered.where("moved").limit(1).count()
        if not moved:
            return lowered.select("node", F.col("next").alias("component"))
        labels = written(lowered.join(jump, "next", "left").select("node", F.least("next", F.coalesce("further", "next")).alias("component")), "labels")
