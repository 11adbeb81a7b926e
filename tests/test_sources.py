"""Readers, writers, the stream and the driver's contract."""

import ast
import gzip
import re
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from retexa import catalog
from retexa.functions import text as X
from retexa.sources import readers, sinks
from retexa.streaming import incoming

ROOT = Path(__file__).resolve().parent.parent


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def tokens(row):
    return [w["token"] for w in row["words"]]


def test_token_files(spark, tmp_path):
    f = write(tmp_path / "a.b.tsv", "\n\nThe\tthe\tD\ncat\tcat\tN\n\nIt\tit\tP\n\n\nran\trun\tV\n")
    got = readers.read_sentences(spark, f).orderBy("sentence").collect()
    assert [(r["doc_id"], r["sentence"], tokens(r)) for r in got] == [("a.b", 0, ["The", "cat"]), ("a.b", 1, ["It"]), ("a.b", 2, ["ran"])]
    assert got[0]["words"][0]["lemma"] == "the" and got[0]["words"][0]["pos"] == "D"
    assert [tokens(r) for r in readers.read_document(spark, f).collect()] == [["The", "cat", "It", "ran"]]
    h = write(tmp_path / "h.tsv", "lemma\ttoken\nthe\tThe\ncat\tCat\n")
    assert tokens(readers.read_tokens(spark, h, header=True).first()) == ["The", "Cat"]
    skip = readers.read_tokens(spark, write(tmp_path / "s.tsv", "a\tX\tb\n"), fields=("token", "_", "lemma")).first()
    assert skip["words"][0]["lemma"] == "b" and set(skip["words"][0].asDict()) == {"token", "lemma", "pos"}
    with pytest.raises(Exception, match="expected 3 fields"):
        readers.read_tokens(spark, write(tmp_path / "bad.tsv", "a\tb\n")).collect()
    with pytest.raises(ValueError):
        readers.read_tokens(spark, f, fields=("lemma",))


def test_files_of_many_splits(spark, tmp_path):
    """Sentences and line numbers where splits begin anywhere, blank runs and a header included."""
    import random

    r = random.Random(0)
    lines = [r.choice(["", "", f"t{i}\tl{i}"]) if r.random() < 0.4 else f"t{i}\tl{i}" for i in range(4000)]
    f, g = write(tmp_path / "one.tsv", "\n".join(lines)), write(tmp_path / "two.tsv", "token\tlemma\n" + "\n".join(lines) + "\n")
    want = [s.split() for s in re.split(r"\n\n+", "\n".join(x.split("\t")[0] for x in lines).strip("\n"))]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "777")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        for path, kw in ((f, {"fields": ("token", "lemma")}), (g, {"header": True})):
            got = {x["sentence"]: tokens(x) for x in readers.read_tokens(spark, path, **kw).collect()}
            assert got == dict(enumerate(want))
        assert tokens(readers.read_document(spark, f, fields=("token", "lemma")).first()) == [w for s in want for w in s]
        plain = {x["line_no"]: tokens(x)[0] for x in readers.read_plain(spark, f).collect()}
        assert plain == dict(enumerate(w for s in want for w in s))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_plain_files(spark, tmp_path):
    f = write(tmp_path / "p.txt", "one two\n\n  three  \n")
    assert [(r["line_no"], tokens(r)) for r in readers.read_plain(spark, f).orderBy("line_no").collect()] == [(0, ["one", "two"]), (1, ["three"])]
    assert tokens(readers.read_whole(spark, f).first()) == ["one", "two", "three"]


def test_verses_books_and_refs(spark, tmp_path):
    f = write(tmp_path / "v.tsv", "Gen\t1\t1\tIn the\tA B\t_ _\tin the\nGen\t1\t2\tAnd so\tA B\t_ _\tand\nMark\t10\t1\tx\tX\t_\tx\nMark\t9\t1\ty\tX\t_\ty\n")
    v = readers.read_verses(spark, f)
    assert {(r["doc_id"], *tokens(r)) for r in v.collect()} == {("Gen_1_1", "In", "the"), ("Mark_10_1", "x"), ("Mark_9_1", "y")}
    assert readers.read_verses(spark, f, max_verses=1).count() == 1
    only = spark.createDataFrame([("Mark", "9", "1")], "book string, chapter string, verse string")
    assert readers.read_verses(spark, f, verse_ids=only).count() == 1
    from retexa.operators import collections, results

    assert [r["doc_id"] for r in results.in_canonical_order(v, ["Mark"]).collect()] == ["Mark_9_1", "Mark_10_1", "Gen_1_1"]
    assert [x.count() for x in collections.split_books(v, ["Gen"], [])] == [1, 0, 2]
    assert [tuple(r) for r in readers.read_books(spark, write(tmp_path / "b", "Gen\n\nMark\n")).orderBy("ord").collect()] == [("Gen", 0), ("Mark", 1)]
    j = write(tmp_path / "r.json", '[{"source": ["a"], "target": ["b", "c"], "ref_type": "x"}, {"source": ["a"], "target": ["b"], "ref_type": "y"}]')
    assert readers.read_refs(spark, j).count() == 2 and readers.read_refs(spark, j, max_targets=1).count() == 1


def test_vectors_stopwords_and_freqs(spark, tmp_path):
    text = "2 3\na 1 2 3\nb 4 5 6\n"
    f = write(tmp_path / "v.txt", text)
    with gzip.open(tmp_path / "v.txt.gz", "wt") as g:
        g.write(text)
    for p in (f, f + ".gz"):
        assert {r["word"]: r["vec"] for r in readers.read_vectors(spark, p).collect()} == {"a": [1, 2, 3], "b": [4, 5, 6]}
    vocab = spark.createDataFrame([("b",)], "word string")
    vectors = readers.read_vectors(spark, f, vocab=vocab)
    sinks.write_vectors(vectors, str(tmp_path / "out"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "out")).collect()] == ["b\t4 5 6"] or vectors.count() == 1
    assert {r[0] for r in readers.read_stopwords(spark, write(tmp_path / "s", "# no\n?no\nthe\nthé\n\n"), strip_marks=True).collect()} == {"the"}
    freqs = write(tmp_path / "f", "7 the\n3 of\n")
    assert [tuple(r) for r in readers.read_freqs(spark, freqs, top_k=1).collect()] == [("the", 7)] and readers.read_freqs(spark, freqs).count() == 2


def test_sinks(spark, tmp_path):
    report = spark.createDataFrame([(0.25, 1, "a", 2, "b"), (0.5, 3, "c", 4, "d")], "similarity double, doc1id bigint, doc1text string, doc2id bigint, doc2text string")
    sinks.write_matches(report, str(tmp_path / "m"))
    assert spark.read.csv(str(tmp_path / "m"), header=True).count() == 2
    assert "0.2500" in sinks.printed(report).first()[0] or "0.5000" in sinks.printed(report).first()[0]
    sinks.write_figures(report.select("similarity"), str(tmp_path / "j"), run="x")
    assert {r["run"] for r in spark.read.json(str(tmp_path / "j")).collect()} == {"x"}
    words = spark.createDataFrame([(["a", "b", "c"] * 5,)], "features array<string>")
    assert sinks.train_vectors(words, dim=4, min_count=1).count() == 3


def test_stream_against_an_index(spark, tmp_path):
    spark.createDataFrame([(1, "the cat sat"), (2, "unseen")], "item_id bigint, text string").write.parquet(str(tmp_path / "in"))
    index = spark.createDataFrame([(7, ["the", "cat", "ran"])], "id bigint, features array<string>")
    stream = spark.readStream.schema("item_id bigint, text string").parquet(str(tmp_path / "in"))
    run = incoming.containment_stream(stream, index, str(tmp_path / "out"), "item_id", 0.5).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination()
    assert [(r["doc1"], r["doc2"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [(1, 7)]


def test_contract():
    q, o = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(o) <= set(q) and set(catalog.QUERIES) <= set(q) and len(catalog.QUERIES) > 50


def test_rest_imports_without_the_corpus_operators(tmp_path):
    import shutil

    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", ".*cache"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'top_k_per_query' in q and not any(n.startswith('op1_') or n == 'pipeline' for n in q), q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(copy)})
    for path in (ROOT / "retexa").rglob("*.py"):
        if "llm" in path.parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            name = getattr(node, "module", None) or ",".join(a.name for a in getattr(node, "names", []) if isinstance(node, ast.Import))
            assert "retexa.llm" not in (name or ""), path


def test_prefix_plan_shape(spark):
    docs = spark.createDataFrame([(0, ["a", "b"])], "id bigint, features array<string>")
    from retexa.operators import setjoin

    plan = setjoin.set_join(docs, measure="jaccard", threshold=0.8)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "PythonUDF" not in plan
    assert X.TOKEN == catalog.WORD and docs.select(F.size("features")).first()[0] == 2
