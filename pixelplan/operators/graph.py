"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import kept

#: Parts that lookups of one node are dealt to.
SALT = 16


def connected(links: DataFrame, most: int = 60) -> DataFrame:
    """node and root (the smallest node it is connected with) of all nodes of links (a, b).

    Rounds of two steps until nothing changes: larger neighbours of a node are linked to the smallest node around it, then
    smaller ones are. Every round's links are as many as before at most, and are joined by their larger node, of which each
    round leaves fewer links; raises after `most` rounds, which number about the logarithm of the longest path.
    """
    now = kept(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    single = now.where("a = b").select(F.col("a").alias("node"), F.col("a").alias("root"))
    now, before = now.where("a > b"), None
    for _ in range(most):
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
        if state == before:
            both = now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")))
            return both.unionByName(single).groupBy("node").agg(F.min("root").alias("root"))
        before = state
        low = now.groupBy(F.col("a").alias("b")).agg(F.min("b").alias("low"))
        # Very many nodes may hang on one: it is looked up with a salt.
        dealt = low.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        up = now.withColumn("_salt", F.pmod(F.hash("a"), F.lit(SALT))).join(dealt, ["b", "_salt"], "left").select("a", F.coalesce("low", "b").alias("b")).distinct()
        least = up.groupBy("a").agg(F.min("b").alias("low"))
        down = up.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b")))).alias("x"))
        now = kept(down.select("x.a", "x.b").where("a <> b").distinct())
    raise RuntimeError(f"components did not settle in {most} rounds")
