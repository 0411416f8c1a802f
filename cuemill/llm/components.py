"""Connected components of a graph given by its edges, as a few rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from . import common as C


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every end of an edge ``a, b`` (longs): the least node of its component.

    Alternating large-star and small-star steps hang every node on the least
    one near it until only stars are left; each step takes a minimum by node
    (summed up before the shuffle) and joins it back. It ends when a round
    changes nothing. Loops and repeated edges do no harm; no edges, no rows.
    """
    now = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now, before = C.materialize(now, "edges", tidy=True), None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v")))
        last, now = now, C.materialize(small.filter("u <> v").distinct(), "edges", tidy=True)
        C.discard(last)
    pairs = now.groupBy("u").agg(F.min("v").alias("v"))
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).union(pairs.select("v", "v").distinct())
