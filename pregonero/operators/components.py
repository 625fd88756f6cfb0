"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import written


def connected(edges: DataFrame, below: str | None = None) -> DataFrame:
    """(a, b) -> (node, root): every node of an edge but the roots, with the smallest node of its component.

    Rounds of large-star (each neighbour above a node points to the smallest neighbour) and small-star (each neighbour
    below it does) until nothing changes; the number of rounds grows with the logarithm of a component's size. A node with
    many neighbours is folded per task before the shuffle.
    """
    now = written(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges", below
    )
    mark = None
    while True:
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = written(
            both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "edges", below
        )
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        now = written(small.unionAll(low.select("u", F.col("m").alias("v"))).distinct(), "edges", below)
        new = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if mark == new:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = new
