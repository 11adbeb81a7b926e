"""Retrieval figures of a ranking (doc1, rank, doc2, sim) against gold references
(ref_id, source array, target array)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

CUTOFFS = (1, 5, 10, 20)


def links(refs: DataFrame) -> DataFrame:
    """(ref_id, doc1, doc2), every source with every target."""
    return refs.select("ref_id", F.explode("source").alias("doc1"), "target").select("ref_id", "doc1", F.explode("target").alias("doc2"))


def matches(ranking: DataFrame, refs: DataFrame, at: int) -> DataFrame:
    """(ref_id, doc1, doc2, rank) of the links found within the cutoff."""
    return links(refs).join(ranking.where(F.col("rank") <= at).select("doc1", "doc2", "rank"), ["doc1", "doc2"]).select("ref_id", "doc1", "doc2", "rank")


def _cutoffs(ranking: DataFrame, at: Sequence[int]) -> DataFrame:
    return F.broadcast(ranking.sparkSession.createDataFrame([(int(a),) for a in at], "at int"))


def stats(ranking: DataFrame, refs: DataFrame, queries: DataFrame, at: Sequence[int] = CUTOFFS, strict: bool = False, count_doc0: bool = True) -> DataFrame:
    """(at, tpos, fneg, fpos, tneg) for each cutoff; queries is a table (doc1).

    Lenient: a reference counts once, found if any of its links is. Strict: every
    link counts. False positives are queries with something retrieved but no
    correct match; true negatives are queries of no reference with nothing
    retrieved. count_doc0=False ignores a retrieved document 0.
    """
    cuts = _cutoffs(ranking, at)
    found = matches(ranking, refs, max(at)).select("ref_id", "doc1", "doc2", "rank")
    per = found.crossJoin(cuts).where("rank <= at")
    sizes = refs.select("ref_id", (F.size("source") * F.size("target")).alias("n_links"))
    hit = per.groupBy("at", "ref_id").agg(F.count("*").alias("hits"))
    rows = sizes.crossJoin(cuts).join(hit, ["at", "ref_id"], "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    tpos = F.sum("hits") if strict else F.sum((F.col("hits") > 0).cast("int"))
    fneg = F.sum(F.col("n_links") - F.col("hits")) if strict else F.sum((F.col("hits") == 0).cast("int"))
    base = rows.groupBy("at").agg(tpos.alias("tpos"), fneg.alias("fneg"))

    got = ranking if count_doc0 else ranking.where("doc2 <> 0")
    retrieved = got.crossJoin(cuts).where("rank <= at").select("at", "doc1").distinct()
    checked = per.select("at", "doc1").distinct()
    fpos = retrieved.join(checked, ["at", "doc1"], "left_anti").groupBy("at").agg(F.count("*").alias("fpos"))
    outside = queries.select("doc1").distinct().join(refs.select(F.explode("source").alias("doc1")).distinct(), "doc1", "left_anti")
    silent = outside.crossJoin(cuts).join(retrieved, ["at", "doc1"], "left_anti").groupBy("at").agg(F.count("*").alias("tneg"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    out = cuts.join(base, "at", "left").join(fpos, "at", "left").join(silent, "at", "left")
    return out.select("at", *(zero(c) for c in ("tpos", "fneg", "fpos", "tneg")))


def f_score(p: Column, r: Column, beta: float = 1.0) -> Column:
    """Null where it is undefined."""
    return F.try_divide((1 + beta**2) * p * r, beta**2 * p + r)


def figures(counts: DataFrame) -> DataFrame:
    """Precision, recall and F scores beside the counts."""
    p, r = F.try_divide("tpos", F.col("tpos") + F.col("fpos")), F.try_divide("tpos", F.col("tpos") + F.col("fneg"))
    return counts.withColumns({"p": p, "r": r}).withColumns({"f1": f_score(F.col("p"), F.col("r")), "f2": f_score(F.col("p"), F.col("r"), 2), "fp5": f_score(F.col("p"), F.col("r"), 0.5)})


def metrics(ranking: DataFrame, refs: DataFrame, queries: DataFrame, at: Sequence[int] = CUTOFFS, strict: bool = False) -> DataFrame:
    """(metric, at, value), one row a figure."""
    wide = figures(stats(ranking, refs, queries, at, strict))
    names = ("p", "r", "f1", "f2", "fp5")
    rows = F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in names))).alias("x")
    return wide.select("at", rows).select("x.metric", "at", "x.value")


def thresholded(sims: DataFrame, refs: DataFrame, queries: DataFrame, thresholds: Sequence[float], at: int = 20, strict: bool = False) -> DataFrame:
    """(threshold, nnz, counts and figures) of one ranking cut at every threshold."""
    place = F.row_number().over(W.partitionBy("doc1").orderBy(F.desc("sim"), "doc2"))
    ranked = sims.withColumn("rank", place).where(F.col("rank") <= at)
    spark = sims.sparkSession
    cuts = F.broadcast(spark.createDataFrame([(float(t),) for t in sorted(thresholds)], "threshold double"))
    kept = ranked.crossJoin(cuts).where("sim >= threshold")
    found = links(refs).join(kept, ["doc1", "doc2"]).select("threshold", "ref_id", "doc1")
    sizes = refs.select("ref_id", (F.size("source") * F.size("target")).alias("n_links"))
    hits = found.groupBy("threshold", "ref_id").agg(F.count("*").alias("hits"))
    rows = sizes.crossJoin(cuts).join(hits, ["threshold", "ref_id"], "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    tpos = F.sum("hits") if strict else F.sum((F.col("hits") > 0).cast("int"))
    fneg = F.sum(F.col("n_links") - F.col("hits")) if strict else F.sum((F.col("hits") == 0).cast("int"))
    base = rows.groupBy("threshold").agg(tpos.alias("tpos"), fneg.alias("fneg"))
    retrieved = kept.select("threshold", "doc1").distinct()
    fpos = retrieved.join(found.select("threshold", "doc1").distinct(), ["threshold", "doc1"], "left_anti").groupBy("threshold").agg(F.count("*").alias("fpos"))
    outside = queries.select("doc1").distinct().join(refs.select(F.explode("source").alias("doc1")).distinct(), "doc1", "left_anti")
    tneg = outside.crossJoin(cuts).join(retrieved, ["threshold", "doc1"], "left_anti").groupBy("threshold").agg(F.count("*").alias("tneg"))
    nnz = sims.crossJoin(cuts).where("sim >= threshold").groupBy("threshold").agg(F.count("*").alias("nnz"))
    out = cuts
    for part in (base, fpos, tneg, nnz):
        out = out.join(part, "threshold", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return figures(out.select("threshold", *(zero(c) for c in ("nnz", "tpos", "fneg", "fpos", "tneg"))))


def best_cells(sims: DataFrame, n_queries: int, k: int, factor: int = 5) -> DataFrame:
    """At most n_queries * k * factor best cells, the input of approximate metrics."""
    return sims.orderBy(F.desc("sim"), "doc1", "doc2").limit(n_queries * k * factor)
