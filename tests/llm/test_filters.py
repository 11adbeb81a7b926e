"""Operators 1, 3, 6, 9 and 10."""

import datetime as dt
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from tests.llm.helpers import AWKWARD, docs, labels
from pyspark.sql import functions as F

from retexa.llm import licences, mixing, quality, toxicity, url_lists

WORDS = [a + b for a in ("ba", "ke", "lo", "mi", "nu", "pra", "sti") for b in ("n", "ral", "ve", "dor", "st")]


def sentence(r, n=12):
    return " ".join(r.choice(WORDS) for _ in range(n)) + "."


# -- 1


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, path string, text string")


def test_licences_and_inheritance(spark):
    r = random.Random(0)
    prose = "\n".join(sentence(r) for _ in range(6))
    header = "# Copyright 2020 Someone\n" + "\n".join("# " + x for x in re.findall(r".{1,70}(?:\s|$)", licences._APACHE)) + "\n" + prose + prose
    rows = [
        (0, "p/LICENSE", licences._MIT), (1, "p/a.py", prose), (2, "p/sub/deep/b.py", prose), (3, "p/sub/LICENSE", licences._GPL), (4, "q/c.py", prose),
        (5, "q/d.py", header), (6, "p/e.py", prose + "\nLicensed under CC BY-NC 4.0.\n" + prose), (7, None, prose), (8, "p/sub/f.py", None), (9, "p/g.py", ""),
        (10, "q/h.py", "This work is licensed under the GNU General Public License, version 3.\n" + prose), (11, "top.txt", prose),
    ]
    got = {x["doc_id"]: x for x in licences.scan(frame(spark, rows)).collect()}
    want = {0: "MIT", 1: "MIT", 2: "GPL-3.0", 3: "GPL-3.0", 4: None, 5: "Apache-2.0", 6: "CC-BY-NC-4.0", 7: None, 8: "GPL-3.0", 9: "MIT", 10: "GPL-3.0", 11: None}
    assert {i: x["licence"] for i, x in got.items()} == want
    assert {i: x["inherited_from"] for i, x in got.items() if x["inherited_from"] is not None} == {1: "p", 2: "p/sub", 8: "p/sub", 9: "p"}
    assert [i for i, x in sorted(got.items()) if x["is_file"]] == [0, 3]


def test_licence_scores_match_brute_force(spark):
    """Every line, run, sentence and window of every text against every template, with exact frequencies."""
    r = random.Random(1)
    templates = [("A", "Released under the MIT License."), ("B", licences._ISC), ("C", "Licensed under CC BY 4.0.")]
    notice = "released under the mit license"
    texts = ["Released under the MIT License.", "some words under the license of others", sentence(r), "license " * 9, "", sentence(r) + "\n" + licences._ISC + "\n" + sentence(r)]
    texts += [sentence(r, 20) + " " + notice + " " + sentence(r, 20), sentence(r) + " Released under the MIT License. " + sentence(r), "Licensed under CC BY 4.0 or something else"]
    split = lambda t: re.findall(r"[a-z0-9]+", t.lower())
    seen = Counter(w for t in texts for w in set(split(t)))
    n = sum(bool(split(t)) for t in texts)
    idf = lambda w: math.log((1 + n) / (1 + seen[w])) + 1
    vec = lambda ws: {w: k * idf(w) for w, k in Counter(ws).items()}
    cos = lambda a, b: sum(x * b.get(w, 0) for w, x in a.items()) / math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))
    own = {w for _, t in templates for w in split(t)}

    def parts(text):
        lines = [x for x in text.split("\n") if split(x)]
        for x in lines:
            ws = split(x)
            yield ws
            yield from filter(None, map(split, re.split(r"(?<=[.!?;])(?=\s|$)", x)))
            for size in licences.WINDOWS:
                if len(ws) > size:
                    yield from (ws[i : i + size] for i in [*range(0, len(ws) - size, size // 3), len(ws) - size])
        dense = [sum(w in own for w in split(x)) >= 0.5 * len(split(x)) for x in lines]
        for i in range(len(lines)):
            for j in range(i + 1, len(lines) + 1):
                if all(dense[i:j]) and (i == 0 or not dense[i - 1]) and (j == len(lines) or not dense[j]):
                    yield split("\n".join(lines[i:j]))

    got = {x["doc_id"]: x for x in licences.scan(frame(spark, [(i, f"d{i}/x", t) for i, t in enumerate(texts)]), templates).collect()}
    for i, t in enumerate(texts):
        scores = [(cos(vec(p), vec(split(x))), name) for p in parts(t) for name, x in templates]
        best = max(scores, default=(0.0, None))
        assert math.isclose(got[i]["score"], best[0] if best[0] >= 0.6 else 0.0, rel_tol=1e-9), i
        assert got[i]["licence"] == (best[1] if best[0] >= 0.6 else None)
    assert got[6]["licence"] == got[7]["licence"] == "A" and got[5]["licence"] == "B"


def test_whole_licence_files_govern_their_directories(spark):
    r = random.Random(4)
    prose = "\n".join(sentence(r) for _ in range(8))
    bodies = {name: t for name, t in licences.TEMPLATES if len(t) > 5000}
    assert len(bodies) >= 13
    rows = [(k, f"{name}/LICENSE", "Copyright 2021 Somebody\n\n" + t) for k, (name, t) in enumerate(bodies.items())]
    rows += [(100 + k, f"{name}/src/deep/x.py", prose) for k, name in enumerate(bodies)] + [(200, "other/x.py", prose)]
    got = {x["doc_id"]: x for x in licences.scan(frame(spark, rows)).collect()}
    for k, name in enumerate(bodies):
        assert (got[k]["licence"], got[k]["is_file"]) == (name, True)
        assert (got[100 + k]["licence"], got[100 + k]["inherited_from"]) == (name, name)
    assert got[200]["licence"] is None


def test_licences_take_awkward_rows(spark):
    df = docs(spark, AWKWARD, extra=True)
    assert licences.scan(df).where("licence is not null").count() == 0
    assert licences.scan(df).count() == len(AWKWARD)
    assert licences.scan(df.limit(0)).count() == 0


def test_licence_directory_ties_and_shuffled_join(spark, monkeypatch):
    monkeypatch.setattr(licences, "BROADCAST_DIRS", 0)
    rows = [(0, "d/A", licences._MIT), (1, "d/B", licences._ISC), (2, "d/x", "nothing"), (0, "d/A", licences._MIT), (3, "//d//e/./x", "nothing")]
    got = [(x["doc_id"], x["licence"]) for x in licences.scan(frame(spark, rows)).collect()]
    assert sorted(got)[:2] == [(0, "MIT")] * 2 and dict(got)[2] in ("ISC", "MIT") and dict(got)[3] == dict(got)[2]


# -- 3


def mixed(spark, n=4000):
    r = random.Random(3)
    rows = [(i, sentence(r, r.randint(3, 30)), r.choice(["en"] * 6 + ["de", "fr"]), r.choice(["a"] * 8 + ["b", "c"]), 0) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").withColumn("t", F.when(F.col("doc_id") % 3 == 0, "x").otherwise("y"))


def test_raking_meets_the_marginals(spark):
    df = mixed(spark)
    targets = {"lang": {"en": 0.5, "de": 0.25, "fr": 0.25}, "source": {"a": 0.4}, "topic": {"x": 0.5, "y": 0.5}}
    cells = mixing.plan(df, targets, 0.2, topic=F.col("t")).cells.to_pandas()
    for dim, want in (("lang", {"en": 0.5, "de": 0.25, "fr": 0.25}), ("topic", {"x": 0.5, "y": 0.5})):
        got = cells.groupby(f"_mix_{dim}").raked.sum()
        assert all(math.isclose(got[k], v, rel_tol=1e-9) for k, v in want.items())
    assert math.isclose(cells.groupby("_mix_source").raked.sum()["a"], 0.4, rel_tol=1e-9)
    assert math.isclose((cells._mix_p * cells.tokens).sum(), 0.2 * cells.tokens.sum(), rel_tol=1e-9)
    drawn = mixing.mix(df, targets, 0.2, topic=F.col("t")).toPandas()
    share = drawn.groupby("lang")._mix_tokens.sum() / drawn._mix_tokens.sum()
    assert abs(share["en"] - 0.5) < 0.07 and abs(share["de"] - 0.25) < 0.07


def test_unlisted_categories_keep_their_raw_share():
    tokens = np.array([10.0, 20.0, 30.0, 40.0])
    got = mixing.margin([None, "it", "de", "en"], tokens, {"en": 0.75, "de": 0.25}, 0.5)
    assert np.allclose(got, [0.1, 0.2, 0.175, 0.525])
    assert np.allclose(mixing.margin(["de", "en"], tokens[2:], {"en": 0.75, "de": 0.25}, 0.5), [0.25, 0.75])


def test_raking_says_when_targets_cannot_be_met():
    with pytest.warns(UserWarning, match="off its target"):  # two cells, of which each would have to hold two shares
        mixing.rake(np.array([1.0, 1.0]), [np.array([0, 1]), np.array([0, 1])], [np.array([0.5, 0.5]), np.array([0.9, 0.1])], rounds=20)


def test_calibration_matches_bisection():
    r = np.random.default_rng(0)
    for _ in range(50):
        t, w = r.integers(0, 100, 8).astype(float), r.random(8) * r.integers(0, 2, 8)
        p = mixing.calibrate(t, w, 0.5)
        reach = t[(t > 0) & (w > 0)].sum()
        assert math.isclose((p * t).sum(), min(0.5 * t.sum(), reach), rel_tol=1e-9, abs_tol=1e-9) and (p <= 1).all()


def test_mixing_takes_awkward_rows(spark):
    df = docs(spark, AWKWARD, extra=True).withColumn("source", F.when(F.col("doc_id") > 4, F.col("source")))
    df = df.unionByName(df).unionByName(df.withColumn("doc_id", F.lit(None).cast("bigint")))
    got = mixing.mix(df, {"source": {None: 0.9, "s1": 0.1}}, 0.8)
    assert got.columns[: len(df.columns) - 1] == [c for c in df.columns if c != "_mix_p"] and got.count() > 0
    pairs = got.where("doc_id is not null").groupBy("doc_id").count().collect()
    assert all(r["count"] == 2 for r in pairs)  # repeated rows share their fate
    assert mixing.mix(df.limit(0), {}, 0.5).count() == 0
    assert mixing.mix(docs(spark, [None, ""]), {}, 0.5).count() == 0


# -- 6


def judged(spark, n=600):
    r = random.Random(6)
    texts = [sentence(r, 40) if i % 4 else (r.choice(WORDS) + " ") * 40 for i in range(n)]
    return texts, labels(spark, [(i, int(i % 4 != 0), 0) for i in range(0, n, 2)])


def test_quality_held_out(spark):
    texts, marks = judged(spark)
    got = {r["doc_id"] for r in quality.resample(docs(spark, texts, extra=True), marks).collect()}
    held = range(1, len(texts), 2)
    good, bad = [i for i in held if i % 4], [i for i in range(0, len(texts), 4)]
    assert sum(i in got for i in good) >= 0.98 * len(good) and sum(i in got for i in bad) <= 0.05 * len(bad)


def test_gumbel_top_k_is_exact(spark):
    texts, marks = judged(spark, 200)
    df = docs(spark, texts)
    models = quality.learn(df, marks)
    _, key, rest = quality.keyed(models, pa.RecordBatch.from_pydict({"doc_id": list(range(200)), "text": texts}), 6)
    k = round((1 / (1 + np.exp(-(rest + models.odds)))).sum())
    want = set(np.argsort(-key)[:k].tolist())
    assert {r["doc_id"] for r in quality.resample(df, marks).collect()} == want
    raw, _ = quality.counts(df, marks.where("quality > 0").select("doc_id"))
    assert raw.sum() == sum(len(t.replace(".", " .").split()) * 2 - 1 for t in texts)


M64 = 2**64 - 1


def _mix(x):
    x = (x + 0x9E3779B97F4A7C15) & M64
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & M64
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & M64
    return x ^ (x >> 31)


def _span(raw):
    total = sum((c + 1) * pow(0x9E3779B97F4A7C15, k, 2**64) for k, c in enumerate(raw))
    return _mix((total + len(raw) * 0xD6E8FEB86659FD93) & M64)


def test_quality_matches_a_plain_reference(spark):
    """Models, weights, noise and the kept rows, from Python numbers and the definitions only."""
    r = random.Random(12)
    texts = [" ".join(r.choice(WORDS) for _ in range(r.randint(3, 25))) if i % 4 else "# $ % " * r.randint(2, 9) + r.choice(WORDS) for i in range(80)] + ["", "Ba ba BA, ba!"]
    marks = [(i, int(i % 4 > 0), 0) for i in range(0, 60)]
    n = quality.BUCKETS

    def grams(text):
        pieces = re.findall(rb"[0-9a-z\x80-\xff]+|[\x21-\x2f\x3a-\x40\x5b-\x60\x7b-\x7e]+", text.lower().encode())
        h = [_span(x) for x in pieces]
        pairs = [1 if x == y else _mix((x * 0x9DDFEA08EB382D69 + y) & M64) for x, y in zip(h, h[1:])]
        return [x % n for x in h + pairs]

    raw, good = Counter(), Counter()
    for i, t in enumerate(texts):
        raw.update(grams(t))
        if (i, 1, 0) in marks:
            good.update(grams(t))
    share = sum(q for _, q, _ in marks) / len(marks)
    whole = [(raw[b] + 0.01) / (sum(raw.values()) + 0.01 * n) for b in range(n)]
    target = [(good[b] + quality.PRIOR * whole[b]) / (sum(good.values()) + quality.PRIOR) for b in range(n)]
    rest = [max(w - share * t, 0.05 * w) for w, t in zip(whole, target)]
    rest = [x / sum(rest) for x in rest] if (total := sum(rest)) else rest
    assert total > 0
    logw = [sum(math.log(target[b] / whole[b]) for b in grams(t)) for t in texts]
    odds = [sum(math.log(target[b] / rest[b]) for b in grams(t)) + math.log(share / (1 - share)) for t in texts]
    k = round(sum(1 / (1 + math.exp(-x)) for x in odds))
    key = []
    for i, t in enumerate(texts):
        seed = i ^ _mix(_span(t.encode()))
        u = ((_mix(seed ^ _mix(6)) >> 11) + 0.5) / 2**53
        key.append(logw[i] - math.log(-math.log(u)))
    want = sorted(range(len(texts)), key=lambda i: -key[i])[:k]
    got = {x["doc_id"]: x for x in quality.resample(docs(spark, texts), labels(spark, marks)).collect()}
    assert set(got) == set(want)
    assert all(math.isclose(got[i]["log_weight"], logw[i], rel_tol=1e-6, abs_tol=1e-6) and math.isclose(got[i]["gumbel_key"], key[i], rel_tol=1e-6, abs_tol=1e-6) for i in want)



def test_threshold_is_the_kth_key(spark):
    r = np.random.default_rng(1)
    keys = np.concatenate([r.normal(size=500) * 100, [3.5] * 20])
    df = spark.createDataFrame([(int(x),) for x in quality._ordered(keys)], "ordered bigint")
    for k in (1, 7, 100, 519, 520):
        assert quality.cut(df, k) == int(quality._ordered(np.sort(keys)[::-1][k - 1 : k])[0])
    assert quality.cut(df, 0) is None and quality.cut(df, 521) is None


def test_quality_takes_awkward_rows(spark):
    texts, marks = judged(spark, 100)
    df = docs(spark, texts + AWKWARD, extra=True)
    df = df.unionByName(df.where("doc_id = 1")).unionByName(df.where("doc_id = 2").withColumn("doc_id", F.lit(None).cast("bigint")))
    out = quality.resample(df, marks)
    assert out.where("doc_id = 1").count() in (0, 2) and out.columns[-2:] == ["log_weight", "gumbel_key"]
    assert quality.resample(df.limit(0), marks).count() == 0
    assert quality.resample(df, marks.limit(0)).count() == df.count()
    assert quality.resample(df, labels(spark, [(None, 1, 0), (1, None, 0), (2, 1, 0)])).count() == df.count()


# -- 9


def toxic(spark, n=600):
    r = random.Random(9)
    insults = ["grumpelig", "grumpeln", "zotterich"]
    texts, rows, where = [], [], {}
    for i in range(n):
        parts = [sentence(r) for _ in range(5)]
        if i % 5 == 0:
            k = r.randrange(5)
            words = parts[k].split()
            words.insert(3, r.choice(insults))
            words.insert(6, r.choice(insults))
            parts[k], where[i] = " ".join(words), k
        texts.append("\n".join(parts))
        if i % 2:
            continue
        rows.append((i, 1, int(i % 5 == 0)))
    return texts, labels(spark, rows), where


def test_toxicity_held_out_and_located(spark):
    texts, marks, where = toxic(spark)
    got = {r["doc_id"]: r for r in toxicity.flag_toxic(docs(spark, texts, extra=True), marks).collect()}
    held = [i for i in range(1, len(texts), 2)]
    assert sum(i in got for i in held if i in where) >= 0.95 * sum(i in where for i in held)
    assert sum(i in got for i in held if i not in where) <= 0.01 * len(held)
    right = [any(x["sentence"] == where[i] for x in r["offending"]) for i, r in got.items() if i in where]
    assert sum(right) >= 0.95 * len(right)
    for i, r in got.items():
        for x in r["offending"]:
            assert texts[i].lower()[x["start"] : x["stop"]] == x["text"]
    kept = {r["doc_id"] for r in toxicity.drop_toxic(docs(spark, texts), marks).collect()}
    assert kept == set(range(len(texts))) - set(got)


def test_toxicity_learns_from_fewer_than_five_documents(spark):
    r = random.Random(19)
    texts = ["\n".join(sentence(r) for _ in range(4)) for _ in range(80)]
    bad = [0, 1, 2, 3, 78, 79]
    for i in bad:
        texts[i] += "\n" + " ".join(["zotterich", "grumpelig", r.choice(WORDS), "quorzig", r.choice(WORDS)]) + "."
    marks = labels(spark, [(i, 1, int(i in bad)) for i in range(70)])  # four toxic, the last two unlabelled
    assert {x["doc_id"] for x in toxicity.flag_toxic(docs(spark, texts), marks).collect()} == set(bad)


def test_noisy_or_is_one_minus_the_product():
    texts = pa.array(["bad one. fine two. bad three.", "fine. fine.", ""])
    h = [int(toxicity.K.row_hash(*toxicity.K.buffers(pa.array([w], pa.large_string())))[0]) for w in ("bad",)]
    b, o = toxicity.K.buffers(pa.array(["bad"], pa.large_string()))
    key = toxicity.K.span_hash(toxicity.K.prefix_sums(b), o[:-1], o[1:])
    model = toxicity.Model(key, np.array([3.0]), -2.0, 0.5)
    p, (row, ordinal, *_, score) = toxicity.score(model, texts)
    s = 1 / (1 + math.exp(-1.0))
    assert h and np.allclose(p, [1 - (1 - s) ** 2, 0, 0]) and row.tolist() == [0, 0] and ordinal.tolist() == [0, 2] and np.allclose(score, s)


def test_scores_are_those_of_the_fitted_model():
    r = random.Random(29)
    texts = [" ".join(sentence(r) for _ in range(4)) + (" zotterich mibann." if i % 4 == 0 else " gentle mibann.") for i in range(60)]
    model = toxicity.fit(pa.array(texts), np.arange(60) % 4 == 0, np.ones(60))
    assert (model.weights < 0).any()
    p, (row, *_, each) = toxicity.score(model, pa.array(texts))
    assert np.bincount(row).tolist() == [5] * 60  # plain sentences too
    own = dict(zip(model.keys.tolist(), model.weights.tolist()))
    b, offs = toxicity.K.buffers(pa.array(texts, pa.large_string()))
    srow, _, _, _, owner, h = toxicity.features(b, offs)
    s = np.full(len(srow), model.bias)
    for o, k in set(zip(owner.tolist(), h.tolist())):
        s[o] += own[k]
    want = 1 - np.array([np.prod(1 - 1 / (1 + np.exp(-s[srow == i]))) for i in range(60)])
    assert np.allclose(each, 1 / (1 + np.exp(-s))) and np.allclose(p, want)


def test_toxicity_takes_awkward_rows(spark):
    texts, marks, _ = toxic(spark, 200)
    df = docs(spark, texts + AWKWARD, extra=True)
    df = df.unionByName(df.where("doc_id = 0")).unionByName(df.where("doc_id = 0").withColumn("doc_id", F.lit(None).cast("bigint")))
    got = [r["doc_id"] for r in toxicity.flag_toxic(df, marks).collect()]
    assert got.count(0) == 2 and got.count(None) == 1 and not any(i is not None and i >= 200 for i in got)
    assert toxicity.drop_toxic(df, marks).columns == df.columns
    for none in (marks.limit(0), marks.where("toxic = 0"), labels(spark, [(None, 1, 1), (0, None, None)])):
        assert toxicity.flag_toxic(df, none).count() == 0 and toxicity.drop_toxic(df, none).count() == df.count()
    assert toxicity.flag_toxic(df.limit(0), marks).count() == 0


# -- 10


def test_urls_that_dodge_the_list(spark):
    at = dt.datetime(2024, 6, 1)
    urls = ["http://bad.org./x", "http://bad.org\\x", "http:\\\\bad.org/x", "http://u:p@BAD.org:80/x", "http://bad.org", "http://bad.org.", "http://notbad.org/x", "http://bad.org.uk/x"]
    captures = spark.createDataFrame([(i, u, at) for i, u in enumerate(urls)], "page_id bigint, url string, fetched_at timestamp")
    entries = spark.createDataFrame([("bad.org", dt.datetime(2024, 1, 1), "block", "spam")], "pattern string, dated timestamp, action string, category string")
    got = {r["page_id"]: (r["host"], r["blocked"]) for r in url_lists.screen(captures, entries).collect()}
    assert [got[i] for i in range(6)] == [("bad.org", True)] * 6 and not got[6][1] and not got[7][1]


def test_url_screen_matches_brute_force(spark):
    r = random.Random(10)
    hosts = ["a.example.com", "example.com", "b.a.example.com", "x.org", "y.x.org", "ample.com"]
    when = lambda: dt.datetime(2024, 1, 1) + dt.timedelta(days=r.randrange(100))
    entries = [(r.choice(hosts) + r.choice(["", "", "/p", "/p/q", "/"]), when(), r.choice(["block", "allow", "remove"]), r.choice("uv")) for _ in range(60)]
    entries += entries[:5]
    urls = [f"{r.choice(['http', 'HTTPS'])}://{r.choice(['', 'u:p@'])}{r.choice(hosts).upper()}{r.choice(['', ':80'])}{r.choice(['', '/', '/p', '/p/q/r?x=/z#y', '/P//q'])}" for _ in range(300)]
    captures = [(i, u, when()) for i, u in enumerate(urls)]
    rank = {"block": 3, "allow": 2, "remove": 1}
    per: dict = {}
    for p, d, a, c in entries:
        per.setdefault(p.rstrip("/"), {}).setdefault(d, []).append((rank[a], c, a))

    def decide(url, at):
        host, path = re.match(r"\w+://(?:[^@/]*@)?([^/:?#]*)(?::\d+)?([^?#]*)", url.lower()).groups()
        segs, best = [s for s in path.split("/") if s], None
        for p, dates in per.items():
            h, *rest = p.split("/")
            live = [d for d in dates if d <= at]
            if live and (host == h or host.endswith("." + h)) and segs[: len(rest)] == rest:
                _, c, a = max(dates[max(live)])
                if a != "remove":
                    best = max(best or (0,), (len(h.split(".")), len(rest) + 1, p, a, c))
        return best[2:] if best else (None, None, None)

    got = url_lists.screen(spark.createDataFrame(captures, "page_id bigint, url string, fetched_at timestamp"), spark.createDataFrame(entries, "pattern string, dated timestamp, action string, category string")).collect()
    assert {x["page_id"]: (x["pattern"], x["action"], x["category"]) for x in got} == {i: decide(u, t) for i, u, t in captures}
    assert all(x["blocked"] == (x["action"] == "block") for x in got)


@pytest.mark.parametrize("limit", [url_lists.BROADCAST_INTERVALS, 0])
def test_url_screen_takes_awkward_rows(spark, monkeypatch, limit):
    monkeypatch.setattr(url_lists, "BROADCAST_INTERVALS", limit)
    t = dt.datetime(2024, 5, 1)
    rows = [(0, None, t, "own"), (1, "", t, "own"), (2, "no url", t, "own"), (3, "http://bad.org/" + "x/" * 5000, t, "own"), (4, "http://bad.org", None, "own"), (5, "http://bad.org", t, "own"), (5, "http://bad.org", t, "own"), (None, "http://bad.org", t, "own")]
    captures = spark.createDataFrame(rows, "page_id bigint, url string, fetched_at timestamp, category string")
    entries = spark.createDataFrame([("bad.org", "2024-01-01", "block", None), (None, "2024-01-01", "block", "x"), ("bad.org", None, "remove", "x"), ("bad.org", "2024-04-01", "nonsense", "x"), ("", "2024-01-01", "block", "x")], "pattern string, dated string, action string, category string")
    got = url_lists.screen(captures, entries).collect()
    assert sorted((x["page_id"] is None, x["page_id"] or 0, x["blocked"]) for x in got) == [(False, 0, False), (False, 1, False), (False, 2, False), (False, 3, True), (False, 4, False), (False, 5, True), (False, 5, True), (True, 0, True)]
    assert not any(x["blocked"] for x in url_lists.screen(captures, entries.limit(0)).collect())
    assert url_lists.screen(captures.limit(0), entries).count() == 0
