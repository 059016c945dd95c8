"""Connected components of a large edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.operators.durable import measured


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """node, component (its smallest node) for every node of ``edges`` (a, b; of one comparable type).

    Alternates large-star and small-star steps: the number of rounds grows with the logarithm of the longest path,
    each step aggregates by node with map-side combining, and no component is gathered anywhere. Self loops and null
    ends are ignored; an empty edge list gives an empty result. Not being done after ``max_rounds`` is an error.
    """
    mark = F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))  # with the number of rows: equal edge lists have equal marks
    cur, state = measured(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges", mark=mark)
    for _ in range(max_rounds):
        both = cur.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.*")
        # large star: every larger neighbour of u is tied to the smallest node around u
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        # small star: u and its smaller neighbours are tied to the smallest of them
        low2 = large.groupBy("a").agg(F.min("b").alias("m"))
        nxt = large.join(low2, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        before = state
        cur, state = measured(nxt, "edges", mark=mark)
        if state == before:
            break
    else:
        raise RuntimeError(f"components have not converged in {max_rounds} rounds")
    nodes = cur.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component")
    roots = cur.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return nodes.union(roots)
