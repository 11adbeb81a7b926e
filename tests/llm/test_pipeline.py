"""The pipeline's stages against their operators, and the driver's contract."""

import random

import pytest

import __spark_entry__
import corpus_pipeline
from retexa.llm import bpe, mixing
from tests.llm.helpers import AWKWARD, docs, labels
from tests.llm.test_filters import sentence


def folder(spark, tmp_path, with_awkward=True):
    r = random.Random(1)
    texts = []
    for i in range(240):
        text = "\n".join(sentence(r) for _ in range(5))
        if i % 5 == 0:
            text = text.replace(" ", " grumpelig ", 2)
        elif i % 5 == 1:
            text = "junk | " * 60
        elif i % 5 == 2 and i > 10:
            text = texts[i - 5]
        texts.append(text)
    rows = [(i, int(i % 5 != 1), int(i % 5 == 0)) for i in range(len(texts))]
    df = docs(spark, texts + (AWKWARD if with_awkward else []))
    df.write.parquet(str(tmp_path / "documents.parquet"))
    labels(spark, rows).write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path), df, texts


def test_stage_names_and_registration():
    names = " ".join(n.lower() for n, _ in corpus_pipeline.STAGES)
    assert len(corpus_pipeline.STAGES) == 5
    assert [names.index(w) for w in ("toxic", "quality", "near-dedup", "mixing", "bpe")] == sorted(names.index(w) for w in ("toxic", "quality", "near-dedup", "mixing", "bpe"))
    assert "pipeline" in __spark_entry__.queries()
    for n in range(1, 11):
        assert sum(q.startswith(f"op{n}_") for q in __spark_entry__.queries()) == 1


def test_run_is_its_stages_and_they_decide(spark, tmp_path):
    d, df, texts = folder(spark, tmp_path)
    now, ids = df, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, d)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == df.columns
        out.write.parquet(str(tmp_path / f"s{k}"))
        now = spark.read.parquet(str(tmp_path / f"s{k}"))
        ids.append({r["doc_id"] for r in now.select("doc_id").collect()})
    assert not ids[0] & set(range(0, 240, 5)) and len(ids[0] & {i for i in range(240) if i % 5}) >= 190  # toxic ones go, clean ones stay
    assert not ids[1] & set(range(1, 240, 5))  # junk goes
    clean = {i for i in range(240) if i % 5 > 1}
    assert len(ids[1] & clean) >= 0.98 * len(clean & ids[0])
    assert len({texts[i] for i in ids[2] if i < 240}) == len([i for i in ids[2] if i < 240])  # one of each group
    assert {texts[i] for i in ids[2] if i < 240} == {texts[i] for i in ids[1] if i < 240}
    assert ids[3] < ids[2] and ids[4] == ids[3]
    final = {r["doc_id"]: r for r in now.collect()}
    assert all(r["round_trip"] in (True, None) for r in final.values())
    whole = {r["doc_id"]: r["tokens"] for r in corpus_pipeline.run(spark, d).collect()}
    assert whole == {i: r["tokens"] for i, r in final.items()}


def test_mixing_stage_matches_the_probabilities(spark, tmp_path):
    d, df, _ = folder(spark, tmp_path, with_awkward=False)
    got = {r["doc_id"] for r in corpus_pipeline.mix_sources(spark, df, d).collect()}
    from hashlib import md5

    c = corpus_pipeline
    cells = mixing.plan(df, c.TARGETS, c.RATE, c.ALPHA).cells.to_pylist()
    p = {(x["_mix_source"], x["_mix_lang"], x["_mix_topic"]): x["_mix_p"] for x in cells}
    want = set()
    for r in mixing._marked(df, None, None).collect():
        u = int(md5(f"{c.SEED}:{r['doc_id']}".encode()).hexdigest()[:13], 16) / 2**52
        if u < p[r["_mix_source"], r["_mix_lang"], r["_mix_topic"]]:
            want.add(r["doc_id"])
    assert got == want


@pytest.mark.parametrize("k", range(5))
def test_every_stage_takes_awkward_and_empty_tables(spark, tmp_path, k):
    d, _, _ = folder(spark, tmp_path)
    stage = corpus_pipeline.STAGES[k][1]
    df = docs(spark, AWKWARD)
    df = df.unionByName(df)
    assert stage(spark, df, d).count() <= df.count()
    assert stage(spark, df.limit(0), d).count() == 0


def test_vocabulary_is_not_in_the_repository():
    assert bpe.VOCABULARY.startswith("/opt/tokenizers/")
