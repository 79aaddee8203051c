"""Connected components of a graph that lies in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import durable


def _stars(edges: DataFrame, smaller_only: bool) -> DataFrame:
    """Ties each node's neighbours to the least of them: the larger ones, or all the smaller ones."""
    if smaller_only:
        around = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    else:
        around = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
    least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    tied = around.join(least, "u")
    if smaller_only:
        new = tied.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    else:
        new = tied.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    return new.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of edges (a, b); root is the least node of the component.

    Alternates large-star and small-star rounds until nothing changes. Nodes without edges
    don't appear. Hot nodes are reduced by partial minima and joined with skew handling; no
    component is gathered in one place.
    """
    edges = durable(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    mark = None
    while True:
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h")).first()
        if now == mark or not now["n"]:
            break
        mark = now
        edges = durable(_stars(_stars(edges, False), True))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b")).distinct()
