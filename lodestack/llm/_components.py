"""Connected components by alternating large-star and small-star steps.

Each step joins edges with the least neighbour of a vertex; the number of edges never grows,
and rounds are few (logarithmic in practice).  Nothing is collected but an edge count and a
checksum, by which the end is noticed.  Edges of a vertex that has very many never meet in
one task: the few such vertices are broadcast (see ``hot_join``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import drop, hot_join, staged

MAX_ROUNDS = 100


def components(edges: DataFrame) -> DataFrame:
    """(vertex, root) for every vertex of ``edges`` (a, b); root is the least of its component."""
    e = staged(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    seen = None
    for _ in range(MAX_ROUNDS):
        sign = tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if sign == seen or not sign[0]:
            break
        seen, before = sign, e
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("m", "u").alias("m"), "n")
        large = hot_join(both.where("v > u"), least, ["u"], "n", 2 * sign[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = hot_join(large, low, ["u"], "n", 2 * sign[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        e = staged(small.where("u <> v").distinct())
        drop(before)
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("vertex"), F.col("v").alias("root")).union(e.select(F.col("v").alias("vertex"), F.col("v").alias("root")).distinct())
