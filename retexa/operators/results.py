"""Assembling matches from similarity rows (doc1, doc2, sim)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from retexa.functions import text as X
from retexa.operators import align


def drop_sims(sims: DataFrame, at_least: float) -> DataFrame:
    """Rows with sim >= at_least; 0 keeps all."""
    return sims.where(F.col("sim") >= at_least) if at_least else sims


def listed(sims: DataFrame, whitelist: DataFrame | None = None, blacklist: DataFrame | None = None, axis: str = "doc1") -> DataFrame:
    """Rows whose document is on the whitelist, or else not on the blacklist; lists are tables (id)."""
    if whitelist is not None:
        return sims.join(whitelist.select(F.col("id").alias(axis)).distinct(), axis, "left_semi")
    if blacklist is not None:
        return sims.join(blacklist.select(F.col("id").alias(axis)).distinct(), axis, "left_anti")
    return sims


def band(sims: DataFrame, above: float = 0.0, up_to: float | None = None) -> DataFrame:
    """above < sim <= up_to."""
    sims = sims.where(F.col("sim") > above)
    return sims if up_to is None else sims.where(F.col("sim") <= up_to)


def top_matches(
    sims: DataFrame, n: int | None = None, above: float = 0.0, up_to: float | None = None, drop: Column | None = None, sample: bool = False, seed: int = 0,
    whitelist1: DataFrame | None = None, blacklist1: DataFrame | None = None, whitelist2: DataFrame | None = None, blacklist2: DataFrame | None = None,
) -> DataFrame:
    """The n best rows, or n at random; rows for which ``drop`` holds don't count."""
    rows = listed(listed(sims, whitelist1, blacklist1, "doc1"), whitelist2, blacklist2, "doc2")
    rows = band(rows, above, up_to)
    rows = rows.where(~F.coalesce(drop, F.lit(False))) if drop is not None else rows
    rows = rows.orderBy(F.xxhash64(F.lit(seed), "doc1", "doc2") if sample else F.desc("sim"), "doc1", "doc2")
    return rows.limit(n) if n is not None else rows


def keep_top_k(sims: DataFrame, k: int) -> DataFrame:
    return top_matches(sims, k, above=float("-inf"))


def ranking(sims: DataFrame, k: int) -> DataFrame:
    """(doc1, rank, doc2, sim): the k best of every query, ties by doc2."""
    place = F.row_number().over(W.partitionBy("doc1").orderBy(F.desc("sim"), "doc2"))
    return sims.withColumn("rank", place).where(F.col("rank") <= k).select("doc1", "rank", "doc2", "sim")


def heatmap(sims: DataFrame, n_points: int, sample: bool = False, seed: int = 0) -> DataFrame:
    """At most n_points cells: the best ones, or a random sample."""
    return top_matches(sims, n_points, above=float("-inf"), sample=sample, seed=seed)


def lower_triangle(sims: DataFrame) -> DataFrame:
    """One orientation of a self-join: doc1 >= doc2."""
    return sims.where("doc1 >= doc2")


def transposed(sims: DataFrame) -> DataFrame:
    return sims.select(F.col("doc2").alias("doc1"), F.col("doc1").alias("doc2"), "sim")


def report(matches: DataFrame, docs1: DataFrame, docs2: DataFrame) -> DataFrame:
    """(similarity, doc1id, doc1text, doc2id, doc2text) of matches and tables (id, words)."""
    side = lambda df, c: df.select(F.col("id").alias(c), X.joined(F.col("words")).alias(f"{c}text"))
    rows = matches.join(side(docs1, "doc1"), "doc1").join(side(docs2, "doc2"), "doc2")
    return rows.select(F.col("sim").alias("similarity"), F.col("doc1").alias("doc1id"), "doc1text", F.col("doc2").alias("doc2id"), "doc2text")


def report_with_context(matches: DataFrame, docs1: DataFrame, docs2: DataFrame, context1: DataFrame, context2: DataFrame) -> DataFrame:
    """The report with left and right contexts, tables (id, left, right)."""
    rows = report(matches, docs1, docs2)
    for c, context in (("doc1", context1), ("doc2", context2)):
        rows = rows.join(context.select(F.col("id").alias(f"{c}id"), F.col("left").alias(f"{c}left"), F.col("right").alias(f"{c}right")), f"{c}id", "left")
    cols = [f"{c}{x}" for c in ("doc1", "doc2") for x in ("id", "left", "text", "right")]
    return rows.select("similarity", *cols)


def aligned(matches: DataFrame, docs1: DataFrame, docs2: DataFrame, field: str = "lemma", **kw) -> DataFrame:
    """Alignments of the matches on one field, on the token where the field is null."""
    take = lambda df, doc, t: df.select(F.col("id").alias(doc), F.transform("words", lambda w: F.coalesce(w[field], w["token"])).alias(t))
    return align.local_alignment(matches.join(take(docs1, "doc1", "t1"), "doc1").join(take(docs2, "doc2", "t2"), "doc2"), **kw)


def matching_words(matches: DataFrame, docs1: DataFrame, docs2: DataFrame, sep: str = "--") -> DataFrame:
    """Positions of the words that both documents' features share; tables (id, words, features)."""

    def side(df: DataFrame, doc: str, k: int) -> DataFrame:
        parts = F.array_distinct(F.flatten(F.transform("features", lambda f: F.split(f, sep))))
        return df.select(F.col("id").alias(doc), F.transform("words", lambda w: F.coalesce(w["lemma"], w["token"])).alias(f"l{k}"), parts.alias(f"p{k}"))

    rows = matches.join(side(docs1, "doc1", 1), "doc1").join(side(docs2, "doc2", 2), "doc2").withColumn("shared", F.array_intersect("p1", "p2"))
    at = lambda c: F.filter(F.when(F.size(c) > 0, F.sequence(F.lit(0), F.size(c) - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.array_contains("shared", F.element_at(c, i + 1)))
    return rows.select("doc1", "doc2", F.array_sort("shared").alias("shared"), at("l1").alias("at1"), at("l2").alias("at2"))


def in_canonical_order(docs: DataFrame, books: Sequence[str]) -> DataFrame:
    """By book as listed, then chapter and verse; unlisted books last."""
    dim = docs.sparkSession.createDataFrame([(b, i) for i, b in enumerate(books)], "book string, _ord int")
    rows = docs.join(F.broadcast(dim), "book", "left").orderBy(F.coalesce("_ord", F.lit(len(books))), F.col("chapter").cast("int"), F.col("verse").cast("int"))
    return rows.drop("_ord")
