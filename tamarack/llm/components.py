"""Connected components of links that no single machine holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.llm.common import passing, written


def components(links: DataFrame) -> DataFrame:
    """v, root: for each end of links (a, b: long), the representative of its component.

    Each round, a vertex joins whichever of itself and its neighbours has the least hash of (round, vertex); links between
    the joined vertices go on to the next round. A hash, drawn anew each round, makes the number of vertices fall by a
    constant factor even along chains. The joins are then followed back. Every round is a written table.
    """
    with passing() as own:
        return _components(links, own)


def _components(links: DataFrame, own: passing) -> DataFrame:
    rounds = []
    left = written(links.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a <> b").distinct(), "links")
    while not left.isEmpty():
        rank = lambda v, n=len(rounds): F.struct(F.xxhash64(F.lit(n), v).alias("h"), v.alias("v"))
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min(rank(F.col("b"))).alias("m"))
        joined = written(least.select(F.col("a").alias("v"), F.least("m", rank(F.col("a")))["v"].alias("to")), "joined")
        rounds.append(joined)
        ends = lambda name, joined=joined: joined.select(F.col("v").alias(name), F.col("to").alias(f"to_{name}"))
        moved = left.join(ends("a"), "a").join(ends("b"), "b").select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b"))
        left = written(moved.filter("a <> b").distinct(), "links")
    if not rounds:
        own.keep(left)
        return left.select(F.col("a").alias("v"), F.col("b").alias("root"))
    found = rounds[-1].select("v", F.col("to").alias("root"))
    last = rounds[-1]
    for joined in reversed(rounds[:-1]):
        later = found.select(F.col("v").alias("to"), "root")
        last = found = written(joined.join(later, "to", "left").select("v", F.coalesce("root", "to").alias("root")), "roots")
    own.keep(last)
    return found
