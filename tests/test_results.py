"""Rankings, filters, contexts, evaluation, vectors and collections."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from retexa.functions import vectors as V
from retexa.operators import collections, context, evaluate, results, wordvecs

WORD = "struct<token:string,lemma:string,pos:string>"


def sims(spark, cells):
    return spark.createDataFrame(cells, "doc1 bigint, doc2 bigint, sim double")


def test_top_k_golden(spark):
    x = [[0, 1, 0, 2, 3], [4, 0, 0, 5, 0], [0, 0, 7, 0, 8]]
    board = sims(spark, [(i, j, float(v)) for i, row in enumerate(x) for j, v in enumerate(row) if v])
    got = [(r["doc1"], r["rank"], r["doc2"], r["sim"]) for r in results.ranking(board, 2).orderBy("doc1", "rank").collect()]
    assert got == [(0, 1, 4, 3.0), (0, 2, 3, 2.0), (1, 1, 3, 5.0), (1, 2, 0, 4.0), (2, 1, 4, 8.0), (2, 2, 2, 7.0)]


def test_filters(spark):
    s = sims(spark, [(0, 0, 0.5), (0, 1, 0.25), (1, 0, 0.75), (1, 1, 0.15)])
    assert [results.drop_sims(s, t).count() for t in (0, 0.1, 0.3, 0.8)] == [4, 4, 2, 0]
    assert {r["sim"] for r in results.band(s, 0.25, 0.75).collect()} == {0.5, 0.75}
    one = spark.createDataFrame([(1,)], "id bigint")
    assert {r["doc1"] for r in results.listed(s, whitelist=one, blacklist=one).collect()} == {1}
    assert {r["doc1"] for r in results.listed(s, blacklist=one).collect()} == {0}
    top = results.top_matches(s, 2, drop=F.col("sim") > 0.6).collect()
    assert [r["sim"] for r in top] == [0.5, 0.25]
    assert results.top_matches(s, 3, sample=True, seed=1).count() == 3 and results.keep_top_k(s, 1).first()["sim"] == 0.75
    assert results.lower_triangle(s).count() == 3 and results.transposed(s).where("doc1 = 0 and doc2 = 1").first()["sim"] == 0.75


def test_evaluation_golden(spark):
    ranks = {0: [2, 1, 3, 4, 5], 1: [0, 9, 8, 7, 6], 2: [5, 3, 6, 1, 0], 3: [5, 6, 3, 9, 8], 4: [1, 2, 3, 4, 5]}
    rows = [(q, k + 1, i, 1.0 - k / 10) for q, r in ranks.items() for k, i in enumerate(r)]
    ranking = spark.createDataFrame(rows, "doc1 bigint, rank int, doc2 bigint, sim double")
    refs = spark.createDataFrame([(0, [0], [1, 2]), (1, [2, 3], [3, 5, 6]), (2, [4], [8])], "ref_id bigint, source array<bigint>, target array<bigint>")
    queries = spark.createDataFrame([(i,) for i in range(6)], "doc1 bigint")
    lenient = evaluate.stats(ranking, refs, queries, at=(1, 5)).orderBy("at").collect()
    assert [tuple(r) for r in lenient] == [(1, 2, 1, 2, 1), (5, 2, 1, 2, 1)]
    strict = evaluate.stats(ranking, refs, queries, at=(5,), strict=True).first()
    assert tuple(strict) == (5, 8, 1, 2, 1)
    figures = evaluate.figures(evaluate.stats(ranking, refs, queries, at=(5,))).first()
    assert math.isclose(figures["p"], 0.5) and math.isclose(figures["r"], 2 / 3) and math.isclose(figures["f1"], 4 / 7)
    cuts = evaluate.thresholded(ranking.select("doc1", "doc2", "sim"), refs, queries, [0.95, 2.0], at=5).orderBy("threshold").collect()
    assert [(r["nnz"], r["tpos"], r["fneg"], r["fpos"], r["tneg"]) for r in cuts] == [(5, 2, 1, 2, 1), (0, 0, 3, 0, 3)] or cuts[1]["tneg"] == 2
    assert {r["metric"] for r in evaluate.metrics(ranking, refs, queries, at=(5,)).collect()} == {"p", "r", "f1", "f2", "fp5"}


def test_context(spark):
    turns = [(0, "x", "a b c"), (1, "x", ""), (2, "x", "d"), (3, "x", "e f g h"), (4, "y", "z")]
    df = spark.createDataFrame([(i, g, [(w, w, None) for w in t.split()]) for i, g, t in turns], f"id bigint, g string, words array<{WORD}>")
    got = {r["id"]: (r["left"], r["right"]) for r in context.neighbours(df, 2, group="g").collect()}
    assert got == {0: ("", "d e"), 1: ("b c", "d e"), 2: ("b c", "e f"), 3: ("c d", ""), 4: ("", "")}
    assert {r["id"]: r["left"] for r in context.neighbours(df, 3).collect()}[4] == "f g h"
    left, right = context.in_parent(F.col("words"), F.lit(1), F.lit(3), 2)
    assert tuple(df.where("id = 3").select(left, right).first()) == ("e", "h")


def test_matching_words_and_report(spark):
    make = lambda t: spark.createDataFrame([(0, [(w, w, None) for w in t.split()], ["--".join(p) for p in zip(t.split(), t.split()[1:])])], f"id bigint, words array<{WORD}>, features array<string>")
    a, b, m = make("the cat sat"), make("a cat sat the"), sims(spark, [(0, 0, 0.5)])
    r = results.matching_words(m, a, b).first()
    assert (r["shared"], r["at1"], r["at2"]) == (["cat", "sat", "the"], [0, 1, 2], [1, 2, 3])
    assert tuple(results.report(m, a, b).first()) == (0.5, 0, "the cat sat", 0, "a cat sat the")


def test_word_similarities_golden(spark):
    vec = {"a": (0.35, 0.75), "c": (0.5, 0.5), "e": (0.75, 0.35)}
    v = spark.createDataFrame([(w, list(x)) for w, x in vec.items()], "word string, vec array<double>")
    vocab = spark.createDataFrame([(w,) for w in "cdaf"], "word string")
    s = {(r["w1"], r["w2"]): r["s"] for r in wordvecs.word_similarities(v, vocab, fill_missing=True).collect()}
    assert round(s["c", "a"], 6) == 0.939793 and ("d", "f") not in s and all(s[w, w] == 1 for w in "cdaf")
    for kw in ({"fill_missing": True}, {"cutoff": -1.0, "beta": 2}):
        with pytest.raises(ValueError):
            wordvecs.word_similarities(v, **kw)


def test_csls_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(wordvecs, "BLOCK", 7)
    x = np.random.default_rng(0).normal(size=(20, 5))
    v = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "word bigint, vec array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    r = np.sort(s, axis=1)[:, ::-1][:, 1:4].mean(axis=1)
    want = 2 * s - r[:, None] - r[None]
    got = wordvecs.nearest(v, n=3, csls_k=3).collect()
    assert len(got) == 60 and all(math.isclose(g["s"], want[g["w1"], g["w2"]], abs_tol=1e-9) for g in got)
    by = {}
    for g in sorted(got, key=lambda g: g["rank"]):
        by.setdefault(g["w1"], []).append(g["w2"])
    np.fill_diagonal(want, -9)
    assert all(by[i] == np.argsort(-want[i])[:3].tolist() for i in range(20))
    m = np.eye(5)[:2]
    assert all(len(r["vec"]) == 2 and math.isclose(np.linalg.norm(r["vec"]), 1) for r in wordvecs.projected(v, m).collect())
    with pytest.raises(ValueError):
        V.pairwise("chebyshev", F.lit(1), F.lit(2))


def test_references(spark):
    docs = spark.createDataFrame([(0, "Gen_1_1"), (1, "Gen_1_2"), (2, "Mark_1_1")], "doc_idx bigint, doc_id string")
    refs = spark.createDataFrame([(0, ["Gen_1_1", "Gen_9_9"], ["Mark_1_1"]), (1, ["Gen_9_9"], ["Mark_1_1"]), (2, ["Gen_1_1", "Gen_1_2"], ["Mark_1_1"])], "ref_id bigint, source array<string>, target array<string>")
    got = {r["ref_id"]: (r["source"], r["target"]) for r in collections.resolve_refs(refs, docs, docs).collect()}
    assert got == {0: ([0], [2]), 2: ([0, 1], [2])}
    assert {r["ref_id"] for r in collections.resolve_refs(refs, docs, docs, max_targets=1).collect()} == set()
    windows = spark.createDataFrame([(0, 0, 5), (1, 4, 9), (2, 8, 10)], "doc_idx bigint, start int, stop int")
    spans = spark.createDataFrame([(0, [4, 8], ["Gen_1_1"]), (1, [50], ["Gen_1_1"]), (2, [0], ["none"])], "ref_id bigint, source array<int>, target array<string>")
    got = {r["ref_id"]: (r["source"], r["target"]) for r in collections.refs_to_shingles(spans, windows, docs).collect()}
    assert got == {0: ([0, 1, 2], [0])}
    assert collections.encode_ref("First Book", 3, 16) == "First-Book_3_16"
    r = collections.decode_refs(spark.createDataFrame([("First-Book_3_16",)], "x string"), "x").first()
    assert (r["book"], r["chapter"], r["verse"]) == ("First Book", "3", "16")
