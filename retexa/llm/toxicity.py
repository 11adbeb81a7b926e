"""Operator 9, toxicity: multiple-instance learning with noisy-or.

A document is a bag of sentences. A sentence holds binary features (its words
and their leading bytes) and scores p = sigmoid(b + sum of weights); a document
is toxic with P = 1 - prod(1 - p). Only document labels train the weights, yet
the fitted sentence scores say which sentences offend.

Every feature of the sample is in the fit. What keeps a rare one from carrying
noise is a prior on its weight, narrow where the labels say little and wider the
more they do, so no count or size of table decides what can be learnt.

The product runs over the sentences that hold a feature of the sample; in the
fit that is every sentence, so no plain ones are counted there. A sentence of
unknown words only counts as p = 0. Weights of either sign are kept as fitted.

Fitting uses at most ``max_per_class`` labelled documents of either class, taken
in the order of a hash of doc_id while their texts hold at most ``max_bytes`` a
class; a text beyond that is passed over, not cut. The bias stays at BIAS or lower,
as part of the fit: a sentence that holds no evidence is toxic with at most 5 %.
The rest of the work reads every document.

Defined results: null or empty texts hold no sentence, so P = 0 and they are
never flagged; texts are scored whole however long; rows with a null doc_id are
scored like others; repeated rows are scored each, and of the texts of one labelled
doc_id the least is fitted; conflicting labels of one document count as toxic;
without documents labelled toxic and others labelled clean there is no model and
nothing is flagged; an empty table gives an empty result. Other columns are carried
along by ``drop_toxic`` and ignored by ``flag_toxic``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retexa.llm import textkit as K
from retexa.session import discard, store

U = np.uint64
PREFIXES = (4, 5, 6, 7)
#: A document is flagged from this probability on.
THRESHOLD = 0.5
#: Largest bias, and entries of the sample that the fit works on at once.
BIAS, ENTRIES = -3.0, 1 << 19
STOP = np.zeros(256, bool)
STOP[[10, 33, 46, 63]] = True
SENTENCE = "array<struct<sentence:int,start:int,stop:int,score:double,text:string>>"


@dataclass(frozen=True)
class Model:
    """Weights by feature hash, ascending; fixed in size by the sample, not the corpus."""

    keys: np.ndarray
    weights: np.ndarray
    bias: float
    threshold: float

    def lookup(self) -> tuple[np.ndarray, np.ndarray]:
        seen = np.zeros(1 << 20, bool)
        seen[(self.keys >> U(44)).astype(np.int64)] = True
        return seen, self.keys


def features(b: np.ndarray, offs: np.ndarray):
    """Sentences (row, ordinal, first and last byte) and their features (sentence, hash)."""
    starts, ends, row = K.words(b, offs)
    if not len(starts):
        z = np.zeros(0, np.int64)
        return z, z, z, z, z, np.zeros(0, U)
    stops = np.zeros(len(b) + 1, np.int64)
    np.cumsum(STOP[b], out=stops[1:])
    part = stops[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (part[1:] != part[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    owner = np.cumsum(new) - 1
    last = np.append(first[1:], len(starts)) - 1
    srow = row[first]
    ordinal = np.arange(len(first)) - np.searchsorted(srow, srow)
    sums = K.prefix_sums(b)
    size = ends - starts
    hashes, owners = [K.span_hash(sums, starts, ends)], [owner]
    for n in PREFIXES:
        long = size > n
        hashes.append(K.mix(K.span_hash(sums, starts[long], starts[long] + n) ^ U(n)))
        owners.append(owner[long])
    return srow, ordinal, starts[first], ends[last], np.concatenate(owners), np.concatenate(hashes)


def _texts(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for i, j in K.blocks(column):
        yield i, *K.buffers(column.slice(i, j - i))


def _evidence(pos: np.ndarray, neg: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Prior deviation of each feature's weight: grows with how far its share of toxic
    documents lies above that of clean ones, in standard errors, and is never 0."""
    n1, n0 = max(y.sum(), 1), max((~y).sum(), 1)
    p1, p0 = (pos + 0.5) / (n1 + 1), (neg + 0.5) / (n0 + 1)
    return (np.maximum((pos / n1 - neg / n0) / np.sqrt(p1 / n1 + p0 / n0), 0.1) / 3.5) ** 2


def fit(texts: pa.Array, toxic: np.ndarray, weight: np.ndarray, ridge: float = 0.1, epochs: int = 150) -> Model:
    """Noisy-or by full-batch gradient descent over every feature of the sample. A
    weight is its prior deviation times a number under a ridge; no feature is left out."""
    low = K.text_column(texts, lower=True)
    n, y = len(texts), toxic.astype(bool)
    bag, feats, first, keys = [], [], [], np.zeros(0, U)
    for i, b, offs in _texts(low):
        r, _, _, _, o, h = features(b, offs)
        order = np.lexsort((h, o))
        o, h = o[order], h[order]
        new = np.ones(len(o), bool)
        new[1:] = (o[1:] != o[:-1]) | (h[1:] != h[:-1])
        bag.append((r + i).astype(np.int32))
        feats.append(h[new])
        keys = np.union1d(keys, h)
        first.append(np.bincount(o[new], minlength=len(r)))
    if not len(keys):
        return Model(np.zeros(0, U), np.zeros(0), BIAS, THRESHOLD)
    for k, h in enumerate(feats):
        feats[k] = np.searchsorted(keys, h).astype(np.int32)
    bag, size, feature = np.concatenate(bag), np.concatenate(first), np.concatenate(feats)
    del first, feats
    start = np.cumsum(size) - size  # every sentence holds a word, so none is empty
    # stretches of whole sentences, so that memory follows the sample's entries by 4 bytes each
    cuts = np.unique(np.append(np.searchsorted(start, np.arange(0, len(feature), ENTRIES)), len(size)))
    parts = [(slice(i, j), slice(start[i], start[j - 1] + size[j - 1])) for i, j in zip(cuts[:-1], cuts[1:])]
    pos, neg = np.zeros(len(keys)), np.zeros(len(keys))
    tail = np.zeros(0, np.int64)
    for sents, entries in parts:
        pair = np.repeat(bag[sents].astype(np.int64), size[sents]) * len(keys) + feature[entries]
        pair = np.unique(np.concatenate([tail, pair]))
        last = pair // len(keys) == bag[sents.stop - 1]  # the last document may go on in the next stretch
        tail, pair = pair[last], pair[~last]
        for done in (pair, *([tail] if sents.stop == len(size) else [])):
            mine = y[done // len(keys)]
            pos += np.bincount(done[mine] % len(keys), minlength=len(keys))
            neg += np.bincount(done[~mine] % len(keys), minlength=len(keys))
    spread = _evidence(pos, neg, y)
    u, bias = np.ones(len(keys)), -4.0
    m, v = np.zeros(len(keys) + 1), np.zeros(len(keys) + 1)
    for step in range(1, epochs + 1):
        w = spread * u
        s = np.concatenate([np.add.reduceat(w[feature[entries]], start[sents] - entries.start) for sents, entries in parts]) + bias
        big = np.bincount(bag, np.logaddexp(0, s), minlength=n)
        slope = np.where(y, -1 / np.expm1(np.clip(big, 1e-9, 500)), 1.0) * weight
        g = slope[bag] / (1 + np.exp(-s))
        grad = np.zeros(len(keys) + 1)
        for sents, entries in parts:
            grad[:-1] += np.bincount(feature[entries], np.repeat(g[sents], size[sents]), minlength=len(keys))
        grad[:-1] = grad[:-1] * spread + ridge * u
        grad[-1] = g.sum()
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        u, bias = u - move[:-1], min(bias - move[-1], BIAS)
    return Model(keys, spread * u, float(bias), THRESHOLD)


def score(model: Model, texts: pa.Array):
    """Per text: P, and its sentences with a known feature as (row, ordinal, start, stop, score)."""
    low = K.text_column(texts, lower=True)
    seen, keys = model.lookup()
    total = np.zeros(len(texts))
    found = []
    for i, b, offs in _texts(low):
        srow, ordinal, first, last, owner, h = features(b, offs)
        if not len(srow):
            continue
        hit = np.flatnonzero(seen[(h >> U(44)).astype(np.int64)])
        at = np.searchsorted(keys, h[hit])
        ok = (at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] == h[hit])
        cell = np.unique(owner[hit[ok]] * len(keys) + at[ok])
        live, inv = np.unique(cell // len(keys), return_inverse=True)
        s = np.full(len(live), model.bias) + np.bincount(inv, model.weights[cell % len(keys)], minlength=len(live))
        total[i : i + len(offs) - 1] += np.bincount(srow[live], np.logaddexp(0, s), minlength=len(offs) - 1)
        found.append((srow[live] + i, ordinal[live], first[live] - offs[srow[live]], last[live] - offs[srow[live]], 1 / (1 + np.exp(-s))))
    cols = [np.concatenate(x) for x in zip(*found)] if found else [np.zeros(0, np.int64)] * 4 + [np.zeros(0)]
    return -np.expm1(-total), cols


def train(docs: DataFrame, labels: DataFrame, max_per_class: int = 3000, max_bytes: int = 16_000_000) -> Model | None:
    """Fit on a bounded sample: at most max_per_class documents and max_bytes of text of either class."""
    spark = docs.sparkSession
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    side = lambda v: marks.where(F.col("toxic") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_per_class)
    ids = side(1).unionByName(side(0))
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").where("text is not null").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    rows, path = store(rows, "sample")
    size = rows.select("doc_id", "toxic", F.octet_length("text").alias("bytes"), F.xxhash64("doc_id").alias("h")).toArrow().sort_by([("h", "ascending"), ("doc_id", "ascending")])
    size = size.filter(pc.less_equal(size["bytes"], max_bytes))
    ids, toxic, held = (size[c].to_numpy() for c in ("doc_id", "toxic", "bytes"))
    fits = np.zeros(len(ids), bool)
    for side in (0, 1):
        fits[toxic == side] = np.cumsum(held[toxic == side], dtype=np.int64) <= max_bytes
    if len(np.unique(toxic[fits])) < 2:
        discard(spark, path)
        return None
    chosen = spark.createDataFrame(pa.table({"doc_id": ids[fits]}))
    share = {r["toxic"]: r["count"] for r in marks.groupBy("toxic").count().collect()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample = pa.Table.from_batches(list(batches)).sort_by("doc_id")
        y = sample["toxic"].to_numpy() == 1
        weight = np.where(y, share.get(1, 1) / y.sum(), share.get(0, 1) / (~y).sum())
        model = fit(sample["text"].cast(pa.large_string()).combine_chunks(), y, weight / weight.mean())
        yield pa.RecordBatch.from_arrays([pa.array(model.keys.view(np.int64)), pa.array(model.weights), pa.array(np.full(len(model.keys), model.bias))], ["key", "weight", "bias"])

    # the bounded sample is one task's work; the driver gets the model alone
    got = rows.join(F.broadcast(chosen), "doc_id", "left_semi").repartition(1).mapInArrow(run, "key bigint, weight double, bias double").toArrow()
    discard(spark, path)
    if not len(got):
        return None
    keys = got["key"].to_numpy().view(U)
    order = np.argsort(keys)
    return Model(keys[order], got["weight"].to_numpy()[order], got["bias"][0].as_py(), THRESHOLD)


def flag_toxic(docs: DataFrame, labels: DataFrame, max_per_class: int = 3000) -> DataFrame:
    """Toxic documents: doc_id, probability and the offending sentences, each
    with its ordinal, character span in the lower-cased text, score and words.
    Sentences score at least 0.5, or else the best one is given."""
    K.small_batches(docs.sparkSession)
    model = train(docs, labels, max_per_class)
    schema = f"doc_id bigint, probability double, offending {SENTENCE}"
    base = docs.select(F.col("doc_id").cast("bigint"), "text")
    if model is None:
        return base.limit(0).select("doc_id", F.lit(0.0).alias("probability"), F.array().cast(SENTENCE).alias("offending"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, (row, ordinal, start, stop, each) = score(model, batch["text"])
            flagged = np.flatnonzero(p >= model.threshold)
            texts = K.text_column(batch["text"].take(pa.array(flagged)), lower=True)
            where = np.searchsorted(row, flagged), np.searchsorted(row, flagged, "right")
            out = []
            for k, (r, lo, hi) in enumerate(zip(flagged, *where)):
                whole = texts[k].as_py().encode()
                own = lo + np.flatnonzero(each[lo:hi] >= 0.5)
                if not len(own):
                    own = [lo + int(np.argmax(each[lo:hi]))]
                span = lambda x: len(whole[:x].decode(errors="ignore"))
                out.append([{"sentence": int(ordinal[x]), "start": span(start[x]), "stop": span(stop[x]), "score": float(each[x]), "text": whole[start[x] : stop[x]].decode(errors="replace")} for x in own])
            kind = pa.list_(pa.struct([("sentence", pa.int32()), ("start", pa.int32()), ("stop", pa.int32()), ("score", pa.float64()), ("text", pa.string())]))
            yield pa.RecordBatch.from_arrays([batch["doc_id"].take(pa.array(flagged)), pa.array(p[flagged]), pa.array(out, kind)], ["doc_id", "probability", "offending"])

    return base.mapInArrow(run, schema)


def drop_toxic(docs: DataFrame, labels: DataFrame, max_per_class: int = 3000) -> DataFrame:
    """docs without the rows flag_toxic flags, all columns kept, in one pass and no shuffle."""
    K.small_batches(docs.sparkSession)
    model = train(docs, labels, max_per_class)
    if model is None:
        return docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, _ = score(model, batch["text"])
            yield batch.filter(pa.array(p < model.threshold))

    return docs.mapInArrow(run, docs.schema)
