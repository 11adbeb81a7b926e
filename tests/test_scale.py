"""Plans whose cost or result went wrong on large tables or odd rows."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from retexa import catalog, catalog_io  # noqa: F401 (adds its queries)
from retexa.operators import align, context, features, packed, setjoin, transport, vsm, wordvecs


def saved(spark, path, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def by_sql(name, path, *tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet/*.parquet'")
    return sorted(con.execute(catalog.ORACLES[name]).fetchall())


def by_query(spark, name, path):
    return sorted(tuple(r) for r in catalog.QUERIES[name](spark, path).collect())


def test_dense_features_of_blank_texts_are_as_in_sql(spark, tmp_path):
    texts = ["longer words really here", "a b c longer", "", "  \n ", None, "a b"]
    path = saved(spark, tmp_path, documents=(list(enumerate(texts)), "doc_id bigint, text string"))
    want = by_sql("dense_features", path, "documents")
    assert [r[0] for r in want] == [0, 2, 3]
    assert by_query(spark, "dense_features", path) == want


def test_window_contexts_of_a_long_document(spark, tmp_path):
    texts = [" ".join(f"w{i}" for i in range(n)) for n in (0, 1, 20, 21, 47, 20_000)]
    path = saved(spark, tmp_path, documents=(list(enumerate(texts)), "doc_id bigint, text string"))
    assert by_query(spark, "shingle_context", path) == by_sql("shingle_context", path, "documents")
    # no row on the way holds a document beside a window of it
    plan = context.of_windows(catalog.coll(spark, path, "documents"), 8)._jdf.queryExecution().optimizedPlan().toString()
    assert [x for x in plan.splitlines() if "Generate" in x and "words" in x] == []


def texts(n, seed=3):
    r = random.Random(seed)
    return [" ".join(f"w{int(r.random() ** 3 * 60)}" for _ in range(r.randint(0, 40))) for _ in range(n)]


def collection(spark, tmp_path):
    items, docs = texts(12, 1), texts(90, 2)
    for k, item in enumerate(items[:6]):
        docs[7 * k] = f"{item} {docs[7 * k]}"
    return saved(spark, tmp_path, benchmark=(list(enumerate(items)), "item_id bigint, text string"), documents=(list(enumerate(docs)), "doc_id bigint, text string"))


SMALL_SIDE = ("containment_join", "shared_word_join", "weighted_jaccard", "weighted_containment", "tfidf_cosine", "bow_cosine", "search_vsm_based", "search_set_based", "timed_search", "matching_words", "eval_stats", "eval_stats_strict", "eval_metrics", "eval_thresholds", "feature_selection")


@pytest.mark.parametrize("name", SMALL_SIDE)
def test_small_query_sides_meet_documents_in_place(spark, tmp_path, monkeypatch, name):
    monkeypatch.setattr(packed, "BROADCAST_FEATURES", 9)  # most weights are joined
    monkeypatch.setattr(packed, "CELLS", 50)
    path = collection(spark, tmp_path)
    assert by_query(spark, name, path) == by_sql(name, path, "benchmark", "documents")


@pytest.mark.parametrize("name", ["tfidf_cosine", "weighted_jaccard", "bow_cosine", "containment_join", "feature_selection"])
def test_what_is_not_small_is_joined(spark, tmp_path, monkeypatch, name):
    monkeypatch.setattr(packed, "BROADCAST_ROWS", 3)
    monkeypatch.setattr(features, "BROADCAST_KEPT", 3)
    path = collection(spark, tmp_path)
    assert by_query(spark, name, path) == by_sql(name, path, "benchmark", "documents")


def test_rows_of_one_id_are_one_document(spark):
    q = spark.createDataFrame([(1, ["a", "b", "c"])], "id bigint, features array<string>")
    d = spark.createDataFrame([(5, ["a", "x"]), (5, ["b", "b"]), (6, ["c"])], q.schema)
    got = {(r["doc2"], round(r["sim"], 6)) for r in setjoin.weighted_join(q, d, "weighted_containment", 0.1).collect()}
    assert got == {(5, 0.5), (6, 1.0)}
    assert {r["doc2"] for r in setjoin.set_join(q, d, "containment", 0.5).collect()} == {5}


def shuffled(spark, df):
    """Rows that pass an exchange."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_postings_do_not_travel(spark, tmp_path):
    path = collection(spark, tmp_path)
    for name in ("containment_join", "weighted_jaccard", "bow_cosine"):
        assert shuffled(spark, catalog.QUERIES[name](spark, path).where("sim > 2")) <= 2  # the documents' own spread


def vector_tables(spark, tmp_path):
    docs = [*texts(30, 4), "none known"]
    r = random.Random(5)
    vecs = [(i, [r.gauss(0, 1) for _ in range(5)], 0) for i in range(25)]
    return saved(spark, tmp_path, documents=(list(enumerate(docs)), "doc_id bigint, text string"), embeddings=(vecs, "vec_id bigint, embedding array<float>, label int"))


@pytest.mark.parametrize("block", [64 << 20, 200])
def test_word_vectors_are_summed_in_place_and_by_blocks(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(packed, "VECTOR_BYTES", block)
    monkeypatch.setattr(packed, "BROADCAST_FEATURES", 9)
    path = vector_tables(spark, tmp_path)
    assert by_query(spark, "tfidf_embedding_cells", path) == by_sql("tfidf_embedding_cells", path, "documents", "embeddings")
    docs, vecs = catalog.bags(spark, path, "documents"), catalog.word_table(spark, path)
    want = {r["id"]: r["vec"] for r in vsm.mean_vectors(docs, vecs).collect()}
    got = {r["id"]: [x / r["t"] for x in r["vec"]] for r in packed.summed(packed.counted(docs), vecs.select(F.xxhash64("word").alias("f"), "vec")).collect()}
    assert got.keys() == want.keys() and all(abs(a - b) < 1e-9 for k in want for a, b in zip(want[k], got[k]))


@pytest.mark.parametrize("name", ["subtract_columns", "csls_crosslingual", "nearest_neighbours", "nearest_by_distance", "csls"])
def test_tiles_of_vectors_keep_pairs_out_of_shuffles(spark, tmp_path, monkeypatch, name):
    for c in ("BLOCK", "PART", "FULL"):
        monkeypatch.setattr(wordvecs, c, 9)
    path = vector_tables(spark, tmp_path)
    out = catalog.QUERIES[name](spark, path)
    assert sorted(tuple(r) for r in out.collect()) == by_sql(name, path, "embeddings")
    if name in ("subtract_columns", "csls_crosslingual"):
        # both sides meet in one cogroup, and nothing is shuffled after it
        assert out._jdf.queryExecution().optimizedPlan().toString().count("Join") == 0


@pytest.mark.parametrize("gap, terminal", [(-1.0, 0.0), (-2.0, -1.0)])
def test_alignment_by_rows_is_that_by_diagonals(gap, terminal):
    r = np.random.default_rng(7)
    for flip in (False, True):
        scores = np.where(r.random((40, 6, 15)) < 0.3, 2.0, -1.0)
        n1, n2 = r.integers(1, 7, 40), r.integers(1, 16, 40)
        for k in range(40):
            scores[k, n1[k] :], scores[k, :, n2[k] :] = -1e30, -1e30
        a, b = align.fill_rows(scores, n1, n2, gap, terminal, flip), align.fill(scores, n1, n2, gap, gap, terminal, flip)
        assert (a.score == b.score).all()
        assert [align.trace(a, k, flip) for k in range(40)] == [align.trace(b, k, flip) for k in range(40)]


def test_pairs_of_words_need_not_carry_vectors(spark, monkeypatch):
    docs = spark.createDataFrame([(0, ["a", "b", "c", "z"]), (1, ["b", "d"])], "id bigint, features array<string>")
    vecs = spark.createDataFrame([(w, [float(i), 1.0]) for i, w in enumerate("abcd")], "word string, vec array<double>")
    pairs = spark.createDataFrame([(0, 0), (0, 1), (1, 0)], "doc1 bigint, doc2 bigint")
    found = []
    for most in (transport.BROADCAST_BYTES, 0):
        monkeypatch.setattr(transport, "BROADCAST_BYTES", most)
        found.append([sorted(map(tuple, f(pairs, docs, docs, vecs).collect())) for f in (transport.assignment_join, transport.word_movers_distance)])
    assert found[0] == found[1]
