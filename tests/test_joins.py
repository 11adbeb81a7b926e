"""Similarity joins against all pairs."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from retexa.operators import features, setjoin, vsm


def bags(seed, n, vocab=12, most=9):
    r = random.Random(seed)
    return [[f"w{int(r.random() ** 2 * vocab)}" for _ in range(r.randint(0, most))] for _ in range(n)]


def frame(spark, docs):
    return spark.createDataFrame(list(enumerate(docs)), "id bigint, features array<string>")


MEASURES = {
    "jaccard": lambda a, b: len(a & b) / len(a | b),
    "containment": lambda a, b: len(a & b) / max(len(a), 1),
    "containment_min": lambda a, b: len(a & b) / max(len(a), len(b)),
    "cosine": lambda a, b: len(a & b) / (math.sqrt(len(a)) * math.sqrt(len(b))),
}


def rows(df):
    return {(r["doc1"], r["doc2"]): r["sim"] for r in df.collect()}


@pytest.mark.parametrize("measure", MEASURES)
@pytest.mark.parametrize("threshold", [0.0, 0.2, 0.5, 0.8, 1.0])
def test_both_plans_find_every_pair(spark, measure, threshold):
    q, x = bags(1, 25), bags(2, 30)
    want = {(i, j): s for i, a in enumerate(q) for j, b in enumerate(x) if set(a) & set(b) and (s := MEASURES[measure](set(a), set(b))) >= threshold}
    for plan in ("naive", "prefix"):
        got = rows(setjoin.set_join(frame(spark, q), frame(spark, x), measure, threshold, plan=plan))
        assert got.keys() == want.keys() and all(math.isclose(got[k], want[k]) for k in want), plan


def test_self_join_drops_the_diagonal(spark):
    d = frame(spark, bags(3, 20))
    with_diagonal = rows(setjoin.set_join(d, measure="jaccard", threshold=0.5, drop_self=False))
    assert rows(setjoin.set_join(d, measure="jaccard", threshold=0.5)) == {k: v for k, v in with_diagonal.items() if k[0] != k[1]}
    assert all((j, i) in with_diagonal for i, j in with_diagonal)


def test_weighted_measures(spark):
    d = [list("aab"), list("abc")]
    got = rows(setjoin.weighted_join(frame(spark, d)))
    assert math.isclose(got[0, 1], 2 / 4)
    assert math.isclose(rows(setjoin.weighted_join(frame(spark, d), measure="weighted_containment"))[0, 1], 2 / 3)


def test_arguments(spark):
    d = frame(spark, [["a"]])
    for kw in ({"measure": "dice"}, {"threshold": 1.5}):
        with pytest.raises(ValueError):
            setjoin.set_join(d, **kw)
    assert rows(setjoin.set_join(frame(spark, []), d)) == {}


def test_tfidf_golden(spark):
    d = frame(spark, [list("aba"), list("bc"), list("acd")])
    once = rows(vsm.tfidf_join(d, threshold=0.0))
    twice = rows(vsm.tfidf_join(d, threshold=0.0, double_count_self=True))
    assert [round(once[k], 6) for k in ((0, 1), (0, 2), (1, 2))] == [0.316228, 0.463185, 0.366180]
    assert [round(twice[k], 6) for k in ((0, 1), (0, 2), (1, 2))] == [0.316228, 0.452301, 0.357575]


def test_soft_cosine(spark):
    docs = [d or ["w0"] for d in bags(4, 8)]
    d = frame(spark, docs)
    w = vsm.bag_of_words(d)
    vocab = sorted({f for x in docs for f in x})
    identity = spark.createDataFrame([(v, v, 1.0) for v in vocab], "w1 string, w2 string, s double")
    soft, plain = rows(vsm.soft_cosine_join(w, w, identity)), rows(vsm.dot_join(w, w, 0.0))
    assert soft.keys() == plain.keys() and all(math.isclose(soft[k], plain[k]) for k in soft)
    s = {(a, b): 1.0 if a == b else 0.3 if abs(int(a[1:]) - int(b[1:])) == 1 else 0.0 for a in vocab for b in vocab}
    edges = spark.createDataFrame([(a, b, x) for (a, b), x in s.items() if x], "w1 string, w2 string, s double")
    got = rows(vsm.soft_cosine_join(w, w, edges))

    def form(x, y):
        return sum(x[a] * y[b] * s[a, b] for a in x for b in y)

    counts = [Counter(x) for x in docs]
    for (i, j), v in got.items():
        assert math.isclose(v, form(counts[i], counts[j]) / math.sqrt(form(counts[i], counts[i]) * form(counts[j], counts[j])))


def test_soft_cosine_by_joins_and_small_tiles(spark, monkeypatch):
    docs = [d or ["w0"] for d in bags(6, 30)]
    w = vsm.bag_of_words(frame(spark, docs))
    vocab = sorted({f for x in docs for f in x})
    edges = spark.createDataFrame([(a, b, 1.0 if a == b else 0.4) for a in vocab for b in vocab if abs(int(a[1:]) - int(b[1:])) <= 1], "w1 string, w2 string, s double")
    want = rows(vsm.soft_cosine_join(w, w, edges, 0.2))
    monkeypatch.setattr(vsm, "TILE", (3, 4))
    assert rows(vsm.soft_cosine_join(w, w, edges, 0.2)).keys() == want.keys()
    monkeypatch.setattr(vsm, "BROADCAST_EDGES", 0)
    got = rows(vsm.soft_cosine_join(w, w, edges, 0.2))
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k]) for k in got)


def test_dot_join_prunes_nothing(spark):
    docs = [d for d in bags(7, 40) if d]
    d = frame(spark, docs)
    w = vsm.tfidf(d, vsm.idf(d)).selectExpr("id", "feature", "w * (1 + id % 3) w")  # norms of 1 to 3
    every = rows(vsm.dot_join(w, w, 0.0))
    for t in (0.2, 0.7, 2.5):
        got = rows(vsm.dot_join(w, w, t))
        assert got.keys() == {k for k, v in every.items() if v >= t} and all(math.isclose(got[k], every[k]) for k in got)


def test_nearest_keeps_ties_of_a_tile(spark, monkeypatch):
    from retexa.operators import wordvecs

    vecs = spark.createDataFrame([(f"w{i:02}", [1.0, float(i // 5)]) for i in range(20)], "word string, vec array<double>")
    want = {(r["w1"], r["rank"]): r["w2"] for r in wordvecs.nearest(vecs, n=3).collect()}
    assert want["w00", 1] == "w01" and want["w00", 3] == "w03" and want["w04", 1] == "w00"
    monkeypatch.setattr(wordvecs, "BLOCK", 4)
    assert {(r["w1"], r["rank"]): r["w2"] for r in wordvecs.nearest(vecs, n=3).collect()} == want


def test_statistics_and_selection(spark):
    docs = [["a", "b", "a"], ["b", "c"], ["a", "c", "d"]]
    d = frame(spark, docs).withColumnRenamed("id", "doc_idx")
    stats = features.statistics(d)
    got = {r["feature"]: (r["freq"], r["df"], round(r["idf"], 6)) for r in stats.collect()}
    assert got == {"a": (3, 2, 1.386294), "b": (2, 2, 1.386294), "c": (2, 2, 1.386294), "d": (1, 1, 2.079442)}
    names = lambda c: sorted(r["feature"] for r in c.select(stats).collect())
    assert names(features.DF.between(2, 9)) == ["a", "b", "c"]
    assert names((features.DF >= 2) & (features.FREQ < 3)) == ["b", "c"]
    assert names(features.FREQ >= 0.5) == ["a", "c"]  # ranks d 0, b 1/3, c 2/3, a 1
    with pytest.raises(TypeError):
        2 <= features.DF <= 3  # noqa: B015
    kept = features.keep_features(d, (features.DF >= 2).select(stats)).orderBy("doc_idx").collect()
    assert [r["features"] for r in kept] == [["a", "b", "a"], ["b", "c"], ["a", "c"]]
    assert [r["feature"] for r in features.vocabulary(stats).collect()] == ["a", "b", "c", "d"]


def test_normalised_rank_ties(spark):
    rows_ = [(f, v, i) for i, (f, v) in enumerate(zip("abcde", [5, 1, 3, 1, 9]))]
    stats = spark.createDataFrame(rows_, "feature string, freq bigint, first_seen bigint")
    got = {r["feature"]: r["freq_rank"] for r in features.normalised_rank(stats, "freq").collect()}
    assert [got[f] for f in "abcde"] == [0.75, 0, 0.5, 0.25, 1]


def test_latent_dimensions(spark):
    import numpy as np

    docs = [d for d in bags(5, 15, 10, 20) if d]
    got = vsm.lsi_vectors(frame(spark, docs), 2, rounds=8).toPandas().sort_values("id")
    vocab = sorted({f for x in docs for f in x})
    a = np.array([[x.count(v) for v in vocab] for x in docs], float)
    u, s, _ = np.linalg.svd(a, full_matrices=False)
    assert np.allclose(np.abs(np.vstack(got["vec"])), np.abs(u[:, :2] * s[:2]), atol=1e-3)


def test_document_vectors(spark):
    import numpy as np

    docs = [["a", "b"], ["a", "a", "z"], ["b"]]
    vec = {"a": [1.0, 0.0], "b": [0.0, 2.0]}
    v = spark.createDataFrame(list(vec.items()), "word string, vec array<double>")
    got = {r["id"]: r["vec"] for r in vsm.mean_vectors(frame(spark, docs), v).collect()}
    assert got == {0: [0.5, 1.0], 1: [2 / 3, 0.0], 2: [0.0, 2.0]}
    freqs = spark.createDataFrame([("a", 3), ("b", 2), ("z", 1)], "feature string, freq bigint")
    sif = {r["id"]: np.array(r["vec"]) for r in vsm.sif_vectors(frame(spark, docs), v, freqs, npc=1).collect()}
    raw = np.array([sum((1e-3 / (1e-3 + {"a": 3, "b": 2, "z": 1}[w] / 6)) * np.array(vec.get(w, [0, 0])) for w in d) / len(d) for d in docs])
    pc = np.linalg.svd(raw)[2][0]
    assert np.allclose(np.vstack([sif[i] for i in range(3)]), raw - np.outer(raw @ pc, pc))
    with pytest.raises(Exception, match="no vector for"):
        vsm.mean_vectors(frame(spark, docs), v, strict=True).collect()


def test_reuse_search(spark):
    from retexa.operators import align
    from retexa.plans import reuse

    make = lambda texts: spark.createDataFrame(list(enumerate(texts)), "id bigint, text string").select("id", reuse.X.words(F.col("text")).alias("words"))
    a, b = make(["the cat sat on the mat", "other words here"]), make(["a cat sat on a mat", "nothing alike"])
    assert rows(reuse.search(a, b, reuse.Options(threshold=0.5)))[0, 0] == 4 / 5
    got, times = reuse.search(a, b, reuse.Options(method="vsm-based", threshold=0.2), timed=True)
    assert set(rows(got)) == {(0, 0)} and set(times) == {"preprocess", "similarity"}
    got = rows(reuse.search(a, b, reuse.Options(method="alignment-based", threshold=0.3, scorer=align.ConstantScorer(), normalize=True, all_pairs=True)))
    assert math.isclose(got[0, 0], 8 / 12, abs_tol=0.2) and (1, 1) not in got
    with pytest.raises(ValueError):
        reuse.search(a, b, reuse.Options(method="magic"))
    vecs = spark.createDataFrame([("cat", [1.0, 0.0]), ("alike", [0.9, 0.1])], "word string, vec array<double>")
    soft = rows(reuse.search(a, b, reuse.Options(method="vsm-based", soft=True, vectors=vecs)))
    assert soft[0, 1] > 0
