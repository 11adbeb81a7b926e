"""Thresholded set-similarity joins.

Inputs are (id, features): a query side and an index side, or one table joined
with itself. Results are (doc1, doc2, sim), doc1 from the query side.

The prefix plan orders features from rare to frequent; if two sets must share at
least a of n features, they share one among the first n - a + 1. Only prefixes are
joined; for containment, where an index set needn't hold any share of its own
features, the queries' prefixes meet all features of the index. Sizes and positions
drop collisions that can't belong to a result. The collisions of a pair are counted,
and with what lies behind the prefix they bound its overlap, so that full sets only
meet for pairs that may pass, and these are verified exactly. A join of a table with
itself finds each unordered pair once where the measure is symmetric. Features
travel as 64-bit hashes. Without a useful prefix (threshold 0, or by choice) shared
features are counted by an equi-join. A small query side is sent to every executor
instead, whatever the threshold, and the index counts what it shares with it in place.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retexa.operators import packed

MEASURES = ("jaccard", "containment", "containment_min", "cosine")
#: Share of a query that its prefix is longer by for containment, so that counts can rule pairs out.
LONGER = 0.1


def similarity(measure: str, o: Column, n1: Column, n2: Column) -> Column:
    """From the overlap and the sizes of both sets. Containment is of the first set;
    containment_min divides by the larger one."""
    table = {
        "jaccard": lambda: o / (n1 + n2 - o),
        "containment": lambda: o / F.greatest(n1, F.lit(1)),
        "containment_min": lambda: o / F.greatest(n1, n2),
        "cosine": lambda: o / (F.sqrt(n1) * F.sqrt(n2)),
    }
    if measure not in table:
        raise ValueError(f"unknown measure {measure!r}; known: {', '.join(MEASURES)}")
    return table[measure]()


def required(measure: str, n: Column, t: float) -> Column:
    """Least overlap of a set of size n with anything it reaches t with."""
    share = t * t if measure == "cosine" else t
    return F.greatest(F.lit(1), F.ceil(n * share - 1e-9))


def needed(measure: str, n1: Column, n2: Column, t: float) -> Column:
    """Least overlap of two sets that reach t."""
    table = {
        "jaccard": lambda: (n1 + n2) * (t / (1 + t)),
        "containment": lambda: n1 * t,
        "containment_min": lambda: F.greatest(n1, n2) * t,
        "cosine": lambda: F.sqrt(n1) * F.sqrt(n2) * t,
    }
    return table[measure]() - 1e-9


def hashed(docs: DataFrame) -> DataFrame:
    """(id, grams array<bigint>, n), without empty sets."""
    grams = F.array_distinct(F.transform("features", lambda f: F.xxhash64(f)))
    return docs.select("id", grams.alias("grams")).where(F.size("grams") > 0).select("id", "grams", F.size("grams").alias("n"))


def naive(queries: DataFrame, index: DataFrame, measure: str, threshold: float) -> DataFrame:
    """Every pair that shares a feature, counted."""
    a = queries.select(F.col("id").alias("doc1"), F.col("n").alias("n1"), F.explode("grams").alias("g"))
    b = index.select(F.col("id").alias("doc2"), F.col("n").alias("n2"), F.explode("grams").alias("g"))
    o = a.join(b, "g").groupBy("doc1", "doc2").agg(F.count("*").alias("o"), F.first("n1").alias("n1"), F.first("n2").alias("n2"))
    return o.select("doc1", "doc2", similarity(measure, F.col("o"), F.col("n1"), F.col("n2")).alias("sim")).where(F.col("sim") >= threshold)


def _prefix(docs: DataFrame, df: DataFrame, length: Column) -> DataFrame:
    """(id, n, rest, last, k, g): the first ``length`` features of each set from rare to
    frequent, with their places k from 1, the number behind them and the last one's key."""
    rows = docs.select("id", "n", F.explode("grams").alias("g")).join(df, "g").groupBy("id", "n")
    rows = rows.agg(F.array_sort(F.collect_list(F.struct("df", "g"))).alias("s")).withColumn("p", F.least(length, F.col("n")).cast("int"))
    last = F.element_at("s", F.col("p"))
    rows = rows.select("id", "n", (F.col("n") - F.col("p")).alias("rest"), last["df"].alias("ldf"), last["g"].alias("lg"), F.posexplode(F.slice("s", F.lit(1), F.col("p"))).alias("k", "f"))
    # a feature that one set holds meets nothing
    return rows.where("f.df > 1").select("id", "n", "rest", "ldf", "lg", (F.col("k") + 1).alias("k"), "f.g")


def prefixed(queries: DataFrame, index: DataFrame, measure: str, threshold: float, same: bool = False) -> DataFrame:
    """The prefix plan. The rank of features counts both sides; with ``same`` they are one
    table, and the diagonal is in the result."""
    both = queries.select(F.explode("grams").alias("g"))
    both = both if same else both.unionByName(index.select(F.explode("grams").alias("g")))
    df = both.groupBy("g").agg(F.count("*").alias("df"))
    one_way = measure == "containment"
    least = F.col("n") - required(measure, F.col("n"), threshold) + 1
    a = _prefix(queries, df, least + F.floor(F.col("n") * LONGER) if one_way else least)
    b = index.select("id", "n", F.explode("grams").alias("g")) if one_way else (a if same else _prefix(index, df, least))
    names = lambda t, i: t.select(*(F.col(c).alias(f"{c}{i}") if c != "g" else F.col(c) for c in t.columns))
    n1, n2 = F.col("n1"), F.col("n2")
    need = needed(measure, n1, n2, threshold)
    able = F.least(n1, n2) >= need
    if not one_way:
        able = able & (F.least("k1", "k2") + F.least(n1 - F.col("k1"), n2 - F.col("k2")) >= need)
    if same and not one_way:
        able = able & ((n1 < n2) | ((n1 == n2) & (F.col("id1") < F.col("id2"))))
    elif same:
        able = able & (F.col("id1") != F.col("id2"))
    kept = ["n1", "n2", "rest1"] + ([] if one_way else ["rest2", "ldf1", "lg1", "ldf2", "lg2"])
    met = names(a, 1).join(names(b, 2), "g").where(able).groupBy("id1", "id2").agg(F.count("*").alias("c"), *(F.first(x).alias(x) for x in kept))
    # what either set holds behind the prefix that ends first, the other may share
    first = F.lit(True) if one_way else (F.col("ldf1") < F.col("ldf2")) | ((F.col("ldf1") == F.col("ldf2")) & (F.col("lg1") <= F.col("lg2")))
    cand = met.where(F.col("c") + (F.col("rest1") if one_way else F.when(first, F.col("rest1")).otherwise(F.col("rest2"))) >= need).select("id1", "id2")
    left = queries.select(F.col("id").alias("id1"), F.col("grams").alias("g1"), F.col("n").alias("n1"))
    right = index.select(F.col("id").alias("id2"), F.col("grams").alias("g2"), F.col("n").alias("n2"))
    sim = similarity(measure, F.size(F.array_intersect("g1", "g2")), n1, n2)
    found = cand.join(left, "id1").join(right, "id2").select(F.col("id1").alias("doc1"), F.col("id2").alias("doc2"), sim.alias("sim")).where(F.col("sim") >= threshold)
    if not same:
        return found
    if not one_way:
        way = F.explode(F.array(F.struct("doc1", "doc2"), F.struct(F.col("doc2").alias("doc1"), F.col("doc1").alias("doc2")))).alias("p")
        found = found.select(way, "sim").select("p.doc1", "p.doc2", "sim")
    return found.unionByName(queries.select(F.col("id").alias("doc1"), F.col("id").alias("doc2"), F.lit(1.0).alias("sim")))


def few(queries: DataFrame, index: DataFrame, measure: str, threshold: float) -> DataFrame:
    """Every pair of a small query side, (id, features) both."""
    share = threshold * threshold if measure == "cosine" else threshold
    least = {"jaccard": lambda g: g["n1"] + g["n2"] - g["x"], "containment": lambda g: g["n1"], "containment_min": lambda g: np.maximum(g["n1"], g["n2"]), "cosine": lambda g: g["n1"] * g["n2"] / g["x"]}[measure]
    met = packed.few_join(packed.Postings(_ones(packed.counted(queries)).toArrow()), _ones(packed.counted(index)), keep=lambda g: g["x"] >= least(g) * share * (1 - 1e-9))
    return met.select("doc1", "doc2", similarity(measure, F.col("x").cast("bigint"), F.col("n1"), F.col("n2")).alias("sim")).where(F.col("sim") >= threshold)


def _ones(rows: DataFrame) -> DataFrame:
    return rows.withColumn("w", F.transform("w", lambda _: F.lit(1.0)))


def set_join(queries: DataFrame, index: DataFrame | None = None, measure: str = "containment", threshold: float = 0.5, drop_self: bool | None = None, plan: str = "auto") -> DataFrame:
    """(doc1, doc2, sim) for all pairs with sim >= threshold and a shared feature.

    Without an index the table is joined with itself and the diagonal dropped,
    unless drop_self says otherwise. plan: prefix, naive, few, or auto, which takes few
    if the queries are, else prefixes where they are short (threshold of at least 0.5).
    """
    if measure not in MEASURES:
        raise ValueError(f"unknown measure {measure!r}; known: {', '.join(MEASURES)}")
    if not 0 <= threshold <= 1:
        raise ValueError("threshold must lie in [0, 1]")
    same = index is None
    if plan == "few" or (plan == "auto" and not same and packed.small(queries)):
        out = few(queries, queries if same else index, measure, threshold)
        return out.where("doc1 <> doc2") if (same if drop_self is None else drop_self) else out
    a = hashed(queries)
    b = a if same else hashed(index)
    use_prefix = plan == "prefix" or (plan == "auto" and threshold >= 0.5)
    out = prefixed(a, b, measure, threshold, same) if use_prefix and threshold > 0 else naive(a, b, measure, threshold)
    return out.where("doc1 <> doc2") if (same if drop_self is None else drop_self) else out


def weighted_join(queries: DataFrame, index: DataFrame | None = None, measure: str = "weighted_jaccard", threshold: float = 0.0, drop_self: bool | None = None) -> DataFrame:
    """Bags instead of sets: shared counts over the larger counts, or over the second bag's size."""
    if measure not in ("weighted_jaccard", "weighted_containment"):
        raise ValueError(f"unknown measure {measure!r}")
    same = index is None
    if not same and packed.small(queries):
        part = (lambda g: g["t1"] + g["t2"] - g["x"]) if measure == "weighted_jaccard" else (lambda g: g["t2"])
        met = packed.few_join(packed.Postings(packed.counted(queries).toArrow()), packed.counted(index), "least", lambda g: g["x"] >= part(g) * threshold * (1 - 1e-9))
        m = met.select("doc1", "doc2", *(F.col(c).cast("bigint").alias(n) for c, n in (("x", "m"), ("t1", "t1"), ("t2", "t2"))))
        return _weighted(m, measure, threshold, bool(drop_self))

    def side(docs: DataFrame, doc: str, c: str, t: str) -> DataFrame:
        rows = docs.select("id", F.size("features").alias("t"), F.explode("features").alias("f")).groupBy("id", "t", "f").agg(F.count("*").alias("c"))
        return rows.select(F.col("id").alias(doc), F.col("t").alias(t), "f", F.col("c").alias(c))

    joined = side(queries, "doc1", "c1", "t1").join(side(queries if same else index, "doc2", "c2", "t2"), "f")
    m = joined.groupBy("doc1", "doc2").agg(F.sum(F.least("c1", "c2")).alias("m"), F.first("t1").alias("t1"), F.first("t2").alias("t2"))
    return _weighted(m, measure, threshold, same if drop_self is None else drop_self)


def _weighted(m: DataFrame, measure: str, threshold: float, drop_self: bool) -> DataFrame:
    sim = F.col("m") / (F.col("t1") + F.col("t2") - F.col("m")) if measure == "weighted_jaccard" else F.col("m") / F.col("t2")
    out = m.select("doc1", "doc2", sim.alias("sim")).where(F.col("sim") >= threshold)
    return out.where("doc1 <> doc2") if drop_self else out


def pair_measures(a: Column, b: Column) -> dict[str, Column]:
    """The set measures of two array columns, element-wise; null where undefined."""
    x, y = F.array_distinct(a), F.array_distinct(b)
    o, n1, n2 = F.size(F.array_intersect(x, y)), F.size(x), F.size(y)
    return {
        "jaccard": F.try_divide(o, n1 + n2 - o),
        "containment": o / F.greatest(n1, F.lit(1)),
        "containment_min": F.try_divide(o, F.greatest(n1, n2)),
        "cosine": F.try_divide(o, F.sqrt(n1) * F.sqrt(n2)),
    }
