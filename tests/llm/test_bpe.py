"""Operator 4 and 7 against the public tokenizer library."""

import random

import pytest
import tiktoken
from tests.llm.helpers import AWKWARD, docs
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from retexa.llm import bpe, token_counts


@pytest.fixture(scope="module")
def oracle():
    v = bpe.vocabulary(bpe.VOCABULARY)
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=v.ranks, special_tokens={}).encode_ordinary


def encode(texts):
    flat, count = bpe.Encoder(bpe.VOCABULARY).encode(texts)
    out, at = [], 0
    for n in count:
        out.append(flat[at : at + n].tolist())
        at += n
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=5))
def test_any_text(texts):
    v = bpe.vocabulary(bpe.VOCABULARY)
    own = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=v.ranks, special_tokens={})
    got = encode(texts)
    assert got == [own.encode_ordinary(t) for t in texts]
    flat, count = bpe.Encoder(bpe.VOCABULARY).encode(texts)
    assert bpe.decode_flat(v, flat, count).to_pylist() == texts


def test_long_pieces_and_every_width(oracle):
    r = random.Random(0)
    texts = ["".join(r.choice("abcdeé") for _ in range(n)) for n in (1, 2, 3, 4, 5, 8, 12, 13, 24, 33, 65, 129, 256, 257, 258, 5000)]
    texts += ["a" * 10000, "!" * 3000, " " * 999 + "x", "the" * 800]
    assert encode(texts) == [oracle(t) for t in texts]


def test_forgetting_changes_nothing(monkeypatch, oracle):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    coder = bpe.Encoder(bpe.VOCABULARY)
    for text in ("one two three four five", "one six seven", "two eight"):
        assert coder.encode([text])[0].tolist() == oracle(text)


def test_encode_and_decode_frames(spark, oracle):
    df = docs(spark, AWKWARD, extra=True)
    rows = {r["doc_id"]: r for r in bpe.encode(df, check=True).collect()}
    assert len(rows) == len(AWKWARD)
    for i, text in enumerate(AWKWARD):
        if text is None:
            assert rows[i]["tokens"] is None and rows[i]["n_tokens"] is None and rows[i]["round_trip"] is None
        else:
            assert rows[i]["tokens"] == oracle(text) and rows[i]["n_tokens"] == len(rows[i]["tokens"]) and rows[i]["round_trip"]
    assert rows[3]["rank"] == "own"
    back = {r["doc_id"]: r["decoded"] for r in bpe.decode(bpe.encode(df)).collect()}
    assert back == dict(enumerate(AWKWARD))
    assert bpe.encode(df.limit(0)).count() == 0


def test_decoding_what_is_no_text(spark):
    v = bpe.vocabulary(bpe.VOCABULARY)
    lone = int(v.byte[0xC3])
    df = spark.createDataFrame([(1, [lone]), (2, [10**9, -5]), (3, None), (4, [])], "doc_id bigint, tokens array<int>")
    assert {r["doc_id"]: r["decoded"] for r in bpe.decode(df).collect()} == {1: "�", 2: "��", 3: None, 4: ""}


def test_counts_through_the_cache(spark, oracle, tmp_path):
    cache = str(tmp_path / "cache")
    texts = [*AWKWARD, "line\r\nend ", "line\nend"]
    df = docs(spark, texts, extra=True)
    df = df.unionByName(df.where("doc_id = 6")).unionByName(df.where("doc_id = 6").withColumn("doc_id", F.lit(None).cast("bigint")))
    got = token_counts.count_tokens(df, cache).collect()
    assert len(got) == len(texts) + 2 and not any(r["cached"] for r in got)
    import re

    for r in got:
        text = "the same text here" if r["doc_id"] is None else texts[r["doc_id"]]
        plain = None if text is None else re.sub(r"\A[ \t\n\x0b\f\r]+|[ \t\n\x0b\f\r]+\Z", "", text.replace("\r\n", "\n"))
        assert r["n_tokens"] == (None if text is None else len(oracle(plain)))
    stored = spark.read.parquet(cache)
    assert stored.count() == stored.select("digest").distinct().count() == len({r["digest"] for r in got} - {None})
    more = docs(spark, ["the same text here", "quite new"])
    again = {r["doc_id"]: r for r in token_counts.count_tokens(more, cache).collect()}
    assert again[0]["cached"] and not again[1]["cached"] and again[1]["n_tokens"] == len(oracle("quite new"))
    assert spark.read.parquet(cache).count() == stored.count() + 1
    assert token_counts.count_tokens(more.limit(0), cache).count() == 0
    # a doc_id with two texts, in a cache that holds one of them
    both = docs(spark, ["quite new", "newer still", "newer still"], ids=[1, 1, 1])
    got = sorted((r["n_tokens"], r["cached"]) for r in token_counts.count_tokens(both, cache).collect())
    assert got == sorted([(len(oracle("quite new")), True)] + [(len(oracle("newer still")), False)] * 2)


def test_misses_beyond_broadcast(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(token_counts, "BROADCAST_DIGESTS", 0)
    df = docs(spark, ["one two", "three", "one two"])
    assert {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(df, str(tmp_path / "c")).collect()} == {0: 2, 1: 1, 2: 2}
