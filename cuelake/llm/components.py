"""Connected components of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelake.llm.common import written


def _again(df: DataFrame, key: str, other: DataFrame) -> DataFrame:
    """Join on a key that neither side is dealt by yet, so that adaptive execution may split a hot node's rows."""
    left, right = df.withColumn("_k", F.col(key).bitwiseXOR(F.lit(1))), other.withColumn("_k", F.col(key).bitwiseXOR(F.lit(1))).drop(key)
    return left.join(right, "_k").drop("_k")


def connected(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """id, component: for every id that a link names, the smallest id that it reaches.

    Each round hangs every node's larger neighbours to its smallest one, then its smaller ones and itself; the links stay as
    many at most, and the depth falls by a constant factor. A round is written to the shared folder; the driver sees a count
    and a checksum only. Null ids and links from an id to itself are passed over. No links give no rows.
    """
    edges = written(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v").distinct(), "links")
    mark = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    while mark[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _again(both, "u", both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _again(large, "u", low).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").union(low.select("u", F.col("m").alias("v")))
        edges = written(small.distinct(), "links")
        last, mark = mark, edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if last == mark:
            break
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
