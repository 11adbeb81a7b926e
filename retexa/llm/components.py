"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retexa.session import discard, store, store_with


def components(edges: DataFrame, rounds: int = 60) -> tuple[DataFrame, str]:
    """edges (a, b) -> stored table (id, root), root the least id of the component.

    Every step is one aggregation and one join on the node, and its result is a
    written table, so lineage never grows. Logarithmically many steps suffice.
    """
    spark = edges.sparkSession
    sign = F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).alias("sign")
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    star, path, before = store_with(pairs, "edges", sign)
    for _ in range(rounds if before["n"] else 0):
        both = star.unionByName(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e"))
        after, new, now = store_with(small.select("e.u", F.col("e.m").alias("v")).where("u <> v").distinct(), "edges", sign)
        discard(spark, path)
        star, path = after, new
        if now == before:
            break
        before = now
    else:
        if before["n"]:
            raise RuntimeError("components did not settle")
    roots = star.select("v").distinct().select(F.col("v").alias("id"), F.col("v").alias("root"))
    found, out = store(star.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(roots), "components")
    discard(spark, path)
    return found, out
