"""Words before and after a document or a window of one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from retexa.functions import text as X
from retexa.plans.ranking import accumulated


def neighbours(docs: DataFrame, n: int, group: str | None = None, field: str = "token") -> DataFrame:
    """(id, left, right): the nearest n words of the documents before and after, in
    the order of id, across as many documents as it takes; within ``group`` if given.

    Sizes are accumulated in id order, so each document finds its reach by
    position. Without a group the order is cut into ranges, whose sizes, a number
    each, give every range its offset.
    """
    keys = [group] if group else []
    rows = docs.select("id", *keys, F.transform("words", lambda w: w[field]).alias("t")).withColumn("n", F.size("t"))
    if keys:
        rows = rows.withColumn("stop", F.sum("n").over(W.partitionBy(*keys).orderBy("id").rowsBetween(W.unboundedPreceding, 0)))
    else:
        rows, _ = accumulated(rows, "n", "id", name="stop")
    rows = rows.withColumn("start", F.col("stop") - F.col("n"))
    spots = rows.select(*keys, "id", F.col("start").alias("lo"), F.col("stop").alias("hi"))
    cells = rows.select(*keys, "start", F.posexplode("t").alias("i", "w")).select(*keys, (F.col("start") + F.col("i")).alias("p"), "w")
    step = F.lit(max(n, 1))
    cells = cells.withColumn("b", F.floor(F.col("p") / step))

    def side(lo: Column, hi: Column, name: str) -> DataFrame:
        # positions lo .. hi - 1 lie in at most two buckets of n positions
        want = spots.withColumn("from", lo).withColumn("to", hi).where("from < to")
        want = want.withColumn("b", F.explode(F.sequence(F.floor(F.col("from") / step), F.floor((F.col("to") - 1) / step))))
        hit = want.join(cells, [*keys, "b"]).where((F.col("p") >= F.col("from")) & (F.col("p") < F.col("to")))
        return hit.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "w"))), lambda x: x["w"]), " ").alias(name))

    left = side(F.greatest(F.col("lo") - n, F.lit(0)), F.col("lo"), "left")
    right = side(F.col("hi"), F.col("hi") + n, "right")
    return docs.select("id").join(left, "id", "left").join(right, "id", "left").select("id", F.coalesce("left", F.lit("")).alias("left"), F.coalesce("right", F.lit("")).alias("right"))


def in_parent(words: Column, start: Column, stop: Column, n: int, field: str = "token") -> tuple[Column, Column]:
    """Left and right text of the window [start, stop) of a parent document, n words each."""
    t = F.transform(words, lambda w: w[field])
    left = F.array_join(F.slice(t, F.greatest(start - n, F.lit(0)) + 1, F.least(start, F.lit(n))), " ")
    right = F.array_join(F.slice(t, stop + 1, F.lit(n)), " ")
    return left, right


def of_windows(docs: DataFrame, n: int, window: int = 20, overlap: int = 5, field: str = "lemma") -> DataFrame:
    """(id, shingle, left, right) of every window of the documents (id, words), n words each.

    The texts are made before windows become rows, which would each carry the whole
    document, and word by word, because a slice within a lambda copies it too.
    """
    rows = docs.select("id", F.transform("words", lambda w: w[field]).alias("t")).withColumn("n", F.size("t"))
    size, none = F.col("n"), F.array().cast("array<string>")
    part = lambda lo, hi: F.array_join(F.when(lo < hi, F.transform(F.sequence(lo + 1, hi), lambda i: F.element_at(F.col("t"), i))).otherwise(none), " ")
    both = lambda s: F.struct(part(F.greatest(s - n, F.lit(0)), s).alias("left"), part(F.least(s + window, size), F.least(s + window + n, size)).alias("right"))
    rows = rows.where("n > 0").select("id", F.posexplode(F.transform(X.window_starts(size, window, overlap), both)).alias("shingle", "s"))
    return rows.select("id", "shingle", "s.left", "s.right")
