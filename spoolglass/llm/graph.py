"""Connected components by alternating stars, with no hub gathered into a task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoolglass.llm.common import cut_lineage

#: Edges for each task of a step.
TASK_EDGES = 1 << 16


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root: each node of an edge with the smallest node it can reach.

    Large-star and small-star steps alternate until the edges stay the same;
    the number of rounds grows with the logarithm of the longest chain.  Each
    step is a minimum by key (combined before the shuffle, then materialised)
    and a join of two plain exchanges, so that a hub's edges can be split.  A
    step has as many tasks as its edges need, since each task of each step costs
    files and time of its own.  Edges with a null end are left out, loops
    and repeated edges don't matter, and no edges give an empty result.
    """
    cores = edges.sparkSession.sparkContext.defaultParallelism
    edges = (
        edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
        .filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("a") > F.col("b")))
        .distinct()
    )
    edges, seen = cut_lineage(edges), None
    while True:
        state = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        n = max(cores, -(-state["n"] // TASK_EDGES))
        edges = edges.coalesce(n)
        if state == seen or state["n"] == 0:
            break
        seen = state
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = cut_lineage(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")).coalesce(n))
        large = both.join(least.hint("shuffle_merge"), "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = cut_lineage(large.coalesce(n).distinct().coalesce(n))
        least = cut_lineage(large.groupBy("a").agg(F.min("b").alias("m")).coalesce(n))
        small = (
            large.join(least.hint("shuffle_merge"), "a")
            .select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
            .select("e.a", "e.b")
            .filter(F.col("a") > F.col("b"))
        )
        edges = cut_lineage(small.coalesce(n).distinct().coalesce(n))
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct().coalesce(n))
