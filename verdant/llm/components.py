"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from verdant.llm.common import staged

MAX_ROUNDS = 60


def _summary(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"),
                    F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for every node that ``edges`` (u, v) touches; component: its least node.

    Alternating stars: the large star hangs each node's larger neighbours on its least neighbour,
    the small star its smaller ones; both are one aggregation and one join on the node, and the
    edge list never grows. A node with very many neighbours is the repeated side of a join against
    a written table of one row per node, which adaptive execution splits. Every round is written to the shared folder.
    The rounds grow with the logarithm of the longest path. Edges with a null end are left out;
    a loop makes its node a component of its own.
    """
    both = edges.select("u", "v").where("u is not null and v is not null")
    edges = staged(both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
    nodes = edges
    seen = _summary(edges)
    for _ in range(MAX_ROUNDS):
        if not seen[0]:
            break
        # large star: u -> every neighbour; larger neighbours go to the least of u and its neighbours
        around = edges.where("u <> v")
        around = around.union(around.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = staged(around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), name)
        large = staged(around.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), name)
        # small star: each node's smaller neighbours and the node itself go to the least of them
        least = staged(large.groupBy("u").agg(F.min("v").alias("m")), name)
        small = large.join(least, "u")
        small = (small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(least.select("u", F.col("m").alias("v")))).distinct()
        edges = staged(small, name)
        now = _summary(edges)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    roots = nodes.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    found = edges.groupBy(F.col("u").alias("child")).agg(F.min("v").alias("root"))
    return (roots.join(found, F.col("node") == F.col("child"), "left")
            .select("node", F.coalesce("root", "node").alias("component")))
