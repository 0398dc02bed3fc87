"""Connected components of an edge table, as joins and grouped minima.

Each round gives every node that has a smaller neighbour that neighbour as its parent, follows
parents to their roots by pointer jumping (a chain of n nodes takes log2(n) jumps), and contracts
the edges to the roots.  At least half of the nodes that still have an edge lose it in a round.
Every step is a table in the shared folder, deleted when the next one stands.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwatch.session import remove_path, shared_path


class Steps:
    """Writes the steps of an iteration; ``keep`` names the tables that a step still needs."""

    def __init__(self, spark, name: str):
        self.spark, self.base = spark, shared_path(spark, name, fresh=True)
        self.made, self.paths = 0, {}

    def write(self, df: DataFrame) -> DataFrame:
        path = f"{self.base}/{self.made:04d}"
        self.made += 1
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path)
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        for t in tables:
            if t is not None and id(t) in self.paths:
                remove_path(self.spark, self.paths.pop(id(t))[1])


def mapped(df: DataFrame, column: str, parent: DataFrame) -> DataFrame:
    """``df`` with ``column`` replaced by its parent, where it has one."""
    to = parent.select(F.col("node").alias("_node"), F.col("label").alias("_label"))
    return (df.join(to, F.col(column) == F.col("_node"), "left")
            .withColumn(column, F.coalesce("_label", column)).drop("_node", "_label"))


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (u, v) that isn't its component's smallest; the label is that node."""
    spark = edges.sparkSession
    steps = Steps(spark, "components")

    def tidy(e: DataFrame) -> DataFrame:
        return (e.filter(F.col("u") != F.col("v"))
                .select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())

    left, labels = steps.write(tidy(edges)), None
    while True:
        # Edges hold u < v, so a node's smallest smaller neighbour is a minimum over the edges it ends.
        parent = steps.write(left.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("label")))
        if parent.isEmpty():
            break
        while True:
            jumped = steps.write(mapped(parent.withColumn("was", F.col("label")), "label", parent))
            moved = not jumped.filter(F.col("was") != F.col("label")).isEmpty()
            old, parent = parent, jumped.drop("was")
            steps.paths[id(parent)] = (parent, steps.paths.pop(id(jumped))[1])
            steps.drop(old)
            if not moved:
                break
        rest = steps.write(tidy(mapped(mapped(left, "u", parent), "v", parent)))
        named = steps.write(parent if labels is None else mapped(labels, "label", parent).unionByName(parent))
        steps.drop(left, labels, parent)
        left, labels = rest, named
    return labels if labels is not None else parent
