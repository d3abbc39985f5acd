"""Connected components of pairs, by hash-partitioned joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def components(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) of every id in pairs of ids linked; a component is its smallest id.

    Alternates the large-star and small-star steps: each id hands its larger (then all its smaller) neighbours to its
    smallest one, until every id hangs on its component's smallest; rounds grow with the logarithm of the longest
    chain. A step is one aggregation with partial sums and one join, so a much linked id gathers nothing in one place.
    Pairs with a null or of an id with itself are ignored.
    """
    edges = checkpointed(pairs.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())

    def large(e: DataFrame) -> DataFrame:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        return both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()

    def small(e: DataFrame) -> DataFrame:
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        rest = e.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return rest.unionByName(least.select("u", F.col("m").alias("v"))).distinct()

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before, after = None, state(edges)
    while after != before:
        edges = checkpointed(small(large(edges)))
        before, after = after, state(edges)
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
