"""Connected components of a table of links, with nothing collected to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import cut, drop

MOST_ROUNDS = 60


def _state(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40))).alias("h")).first()
    return r["n"], r["h"] or 0


def components(links: DataFrame) -> DataFrame:
    """links: u and v, two nodes each.  Gives node and root, the least node of its component, for every node but the roots.

    Rounds of two steps hang each node's neighbours below the least of them, first the greater ones and then the lesser, until all
    hang below one root; their number grows with the logarithm of the longest chain.  The least neighbour is a pre-aggregated
    minimum that is joined back, so a node with very many links is split like any other hot key.  Every round is a written table."""
    edges = cut(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "links")
    before = None
    for _ in range(MOST_ROUNDS):
        now = _state(edges)
        if now == before:
            break
        before = now
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
        large = both.join(least, F.col("u") == F.col("c")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = cut(large, "large-star")
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), "m")
        small = large.join(low, F.col("u") == F.col("c")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = cut(small.union(low.select("c", "m")).distinct(), "small-star")
        drop(edges)
        drop(large)
        edges = after
    else:
        raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
    return edges.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
