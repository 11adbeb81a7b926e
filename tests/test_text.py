"""Words, filters, n-grams and windows."""

import itertools
import string

import pytest
from pyspark.sql import functions as F

from retexa.functions import text as X


def column(spark, values, expr, kind="array<string>"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[1] for r in df.select("i", expr(F.col("x")).alias("y")).orderBy("i").collect()]


def test_punctuation_is_ascii_without_backslash(spark):
    got = column(spark, list(string.punctuation) + ["a", "--", "a-"], lambda c: c.rlike(X.PUNCTUATION), "string")
    assert [c for c, hit in zip(list(string.punctuation) + ["a", "--", "a-"], got) if not hit] == ["\\", "a", "a-"]


def naive_grams(f, lo, hi, skip):
    out = []
    for n in range(lo, hi + 1):
        span = n + (skip if n > 1 else 0)
        for i in range(len(f) - span + 1):
            if span == n:
                out.append("--".join(f[i : i + n]))
            else:
                out += ["--".join((f[i], *rest)) for rest in itertools.combinations(f[i + 1 : i + span], n - 1)]
    return out


@pytest.mark.parametrize("lo,hi,skip", [(1, 1, 0), (1, 3, 0), (2, 2, 1), (3, 3, 1), (1, 3, 2)])
def test_ngrams_match_brute_force(spark, lo, hi, skip):
    docs = [[], ["a"], list("ab"), list("abc"), list("abcde"), list("aaaa"), ["ein", "zwei", "drei", "vier", "fünf", "sechs"]]
    assert column(spark, docs, lambda c: X.ngrams(c, lo, hi, skip)) == [naive_grams(f, lo, hi, skip) for f in docs]


def test_ngram_arguments():
    with pytest.raises(ValueError):
        X.ngrams(F.col("x"), 2, 1)


def test_preprocessing_order(spark):
    words = [("The", "the", "D"), ("Dog", "$unk$", "N"), (",", ",", "P"), ("RAN", "run", "V"), ("x9", "x9", None)]
    df = spark.createDataFrame([(words,)], f"w array<{X.WORD}>")
    run = lambda **kw: df.select(X.Preprocess(**kw).features(F.col("w"))).first()[0]
    assert run() == ["the", "$unk$", "run", "x9"]
    assert run(replace_unk=True, drop_unk=True) == ["the", "dog", "run", "x9"]
    assert run(drop_unk=True) == ["the", "run", "x9"]
    assert run(stopwords=["the"], lower=False, field="token") == ["Dog", "RAN", "x9"]
    assert run(rules={"token": X.TokenRule("[A-Z]", keep=True)}) == ["the", "$unk$", "run"]
    assert run(rules={"token": X.TokenRule("[A-Z]")}, drop_punctuation=False) == [",", "x9"]


@pytest.mark.parametrize("n,window,overlap,want", [(47, 20, 5, [(0, 20), (15, 35), (30, 47), (45, 47)]), (40, 20, 10, [(0, 20), (10, 30), (20, 40), (30, 40)]), (0, 20, 5, []), (3, 20, 5, [(0, 3)])])
def test_shingles(spark, n, window, overlap, want):
    df = spark.createDataFrame([([("t%d" % i, "t", None) for i in range(n)],)], f"w array<{X.WORD}>")
    got = df.select(X.shingles(F.col("w"), window, overlap)).first()[0]
    assert [(s["start"], s["stop"]) for s in got] == want
    assert [[w["token"] for w in s["words"]] for s in got] == [["t%d" % i for i in range(a, b)] for a, b in want]
    with pytest.raises(ValueError):
        X.shingles(F.col("w"), 5, 5)


def test_marks_and_features(spark):
    assert column(spark, ["éàü", "ñ", None, "abc"], X.strip_marks, "string") == ["eau", "n", None, "abc"]
    assert column(spark, ["שָׁלוֹם", "كِتَاب"], X.strip_marks, "string") == ["שלום", "كتاب"]  # points of other scripts
    assert column(spark, [["a", "b", "a"], ["a"]], lambda c: X.doc_features(c, distinct=True, least=2)) == [["a", "b"], []]
    assert column(spark, [["a", "b"], ["a"]], lambda c: X.doc_features(c, density=0.5, n_words=F.lit(4))) == [["a", "b"], []]
