"""Connected components by spreading the least node; every round is written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.shared import materialise, release

#: Steps along edges in a round, and rounds after which labels also jump to their labels' labels.
STEPS, PLAIN_ROUNDS = 3, 2


def _state(labels: DataFrame) -> tuple:
    row = labels.agg(F.count("*").alias("n"), F.sum(F.xxhash64("node", "component").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def components(edges: DataFrame) -> DataFrame:
    """edges: (a, b). Returns (node, component) for every node that has an edge to another; component is its least node.

    A step hands each node's label to its neighbours and keeps the least, by partial aggregation; hubs are not gathered,
    and a hub's part of the join can be split. Where components are long, labels jump, and the number of rounds grows
    with the logarithm of the longest path.
    """
    spark = edges.sparkSession
    one = edges.where("a != b").select("a", "b")
    both, _ = materialise(one.union(one.select("b", "a")).toDF("u", "v").distinct(), "edges")
    labels = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("component"))
    before, rounds = None, 0
    while True:
        for _ in range(STEPS):
            handed = both.join(labels.withColumnRenamed("node", "v"), "v").select(F.col("u").alias("node"), "component")
            labels = handed.union(labels).groupBy("node").agg(F.min("component").alias("component"))
        if rounds >= PLAIN_ROUNDS:
            further = labels.select(F.col("node").alias("component"), F.col("component").alias("further"))
            labels = labels.join(further, "component").select("node", F.least("component", "further").alias("component"))
        labels, _ = materialise(labels, "labels")
        release(spark)
        rounds += 1
        after = _state(labels)
        if after == before:
            return labels
        before = after
