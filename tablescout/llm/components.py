"""Connected components of edge tables. Every step is written to the shared folder, which cuts its lineage and its plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescout.workspace import materialize_told


def roots(parents: DataFrame) -> DataFrame:
    """(node, component) for a table (a, b) with one row for each a, b < a: where following b from a ends.

    Pointers are doubled, so the number of steps is the logarithm of the longest path.
    """
    now = parents.select("a", "b")
    while True:
        onward = now.select(F.col("a").alias("b"), F.col("b").alias("next"))
        now, told = materialize_told(now.join(onward, "b", "left").select(
            "a", F.coalesce("next", "b").alias("b"), F.col("next").isNotNull().alias("moved")), "roots", F.count_if("moved").alias("moved"))
        now = now.drop("moved")
        if not told["moved"]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))


def stars(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of `edges` (a, b) but the smallest of each component, which stands for it. Rows with a = b say nothing.

    Alternating large-star and small-star steps, each a group and a join on nodes, so a node with very many edges is split like
    any skewed key. Their number grows with the logarithm of the longest path. No edges give no rows.
    """
    state = F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("digest")

    # A row (a, b) has a > b.
    now, seen = materialize_told(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct(), "edges", *state)
    while seen["n"]:
        # Large star: larger neighbours of a node go to the least of its neighbours and itself.
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: a node and its smaller neighbours go to the least of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(least, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        )
        before = seen
        now, seen = materialize_told(small, "edges", *state)
        if seen == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component"))


def components(edges: DataFrame) -> DataFrame:
    """`stars`, and the smallest nodes with themselves."""
    found = stars(edges)
    return found.unionByName(found.select(F.col("component").alias("node"), "component").distinct())


def relabelled(df: DataFrame, column: str, labels: list[DataFrame]) -> DataFrame:
    """`df` with a column of nodes replaced by their components, by one table (node, component) after the other. Nodes that a table lacks stay."""
    for table in labels:
        found = table.select(F.col("node").alias("__node"), F.col("component").alias("__component"))
        df = df.join(found, F.col(column) == F.col("__node"), "left").withColumn(
            column, F.coalesce("__component", column)).drop("__node", "__component")
    return df
