"""Operator 6, quality: data selection by importance resampling.

Two generative models over hashed n-grams (words and punctuation runs of the
lower-cased text, single and in pairs) are estimated: one from target text, one
from all raw text. A document's log weight is log p_target - log p_raw summed
over its n-grams. Gumbel top-k then samples k documents without replacement in
proportion to their weights: the k largest log weight + Gumbel noise.

Target text is a bounded sample: ``max_target`` documents labelled good, in the
order of a hash of doc_id. Raw counts cover every document. With target share s
among the labels, k is the number of documents that a two-component mixture
expects to be good, the sum over all documents of s * w / (s * w + (1 - s)); only
there w weighs the target against the rest of the raw text, the raw model being
s * target + (1 - s) * rest.

Noise is a function of doc_id and text, so the sample is reproducible.

Defined results: null and empty texts have log weight 0; texts are read whole
however long; rows with a null doc_id take part; repeated rows share one key and
are kept or dropped together, as are ties at the k-th key (all kept); with no
document labelled good, or none labelled otherwise, every row is kept; an empty
table stays empty; other columns are carried along, except that log_weight and
gumbel_key are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retexa.llm import textkit as K
from retexa.session import discard, store

U = np.uint64
BUCKETS, PRIOR = 1 << 14, 1000


def ngrams(b: np.ndarray, offs: np.ndarray, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Row and bucket of every single piece and every pair of neighbours; a piece
    followed by itself is one n-gram, whatever the piece."""
    starts, ends, row = K.pieces(b, offs)
    h = K.span_hash(K.prefix_sums(b), starts, ends)
    same = row[1:] == row[:-1]
    pair = np.where(h[1:] == h[:-1], U(1), K.mix(h[:-1] * U(0x9DDFEA08EB382D69) + h[1:]))[same]
    return np.concatenate([row, row[1:][same]]), (np.concatenate([h, pair]) % U(buckets)).astype(np.int64)


def _parts(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    low = K.text_column(column, lower=True)
    for i, j in K.blocks(low):
        yield i, j, *ngrams(*K.buffers(low.slice(i, j - i)))


@dataclass(frozen=True)
class Models:
    """log p_target - log p_raw by bucket; log p_target - log p_rest and the prior log
    odds of the target, for the expected number of good documents."""

    ratio: np.ndarray
    rest: np.ndarray
    odds: float


def counts(docs: DataFrame, target: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Bucket counts over the target rows and over all rows; one row a bucket and
    partition is shuffled, the driver gets BUCKETS sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, good = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            mark = batch["good"].to_numpy(zero_copy_only=False).astype(bool)
            for i, j, row, bucket in _parts(batch["text"]):
                raw += np.bincount(bucket, minlength=BUCKETS)
                good += np.bincount(bucket[mark[i:j][row]], minlength=BUCKETS)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(good[at])], ["bucket", "raw", "good"])

    marked = docs.select("doc_id", "text").join(F.broadcast(target.withColumn("mark", F.lit(True))), "doc_id", "left")
    sums = marked.select("text", F.coalesce("mark", F.lit(False)).alias("good")).mapInArrow(run, "bucket bigint, raw bigint, good bigint")
    got = sums.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).toArrow()
    raw, good = np.zeros(BUCKETS), np.zeros(BUCKETS)
    raw[got["bucket"].to_numpy()], good[got["bucket"].to_numpy()] = got["raw"].to_numpy(), got["good"].to_numpy()
    return raw, good


def mixture(raw: np.ndarray, good: np.ndarray, share: float) -> Models:
    """Split the raw model into target and rest. The target's counts are joined by
    PRIOR n-grams of the raw model, so what few target texts lack is taken to be
    as common there as anywhere."""
    whole = (raw + 0.01) / (raw.sum() + 0.01 * len(raw))
    target = (good + PRIOR * whole) / (good.sum() + PRIOR)
    rest = np.maximum(whole - share * target, 0.05 * whole)
    rest /= rest.sum()
    return Models(np.log(target) - np.log(whole), np.log(target) - np.log(rest), math.log(share / (1 - share)))


def learn(docs: DataFrame, labels: DataFrame, max_target: int = 10000) -> Models | None:
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    n = {r["quality"]: r["count"] for r in marks.groupBy((F.col("quality") > 0).cast("int").alias("quality")).count().collect()}
    if not n.get(1) or not n.get(0):
        return None
    target = marks.where("quality > 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_target).select("doc_id")
    raw, good = counts(docs, target)
    if not good.sum():
        return None
    return mixture(raw, good, n[1] / (n[1] + n[0]))


def weigh(models: Models, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log weight against the raw text, log weight against the rest, and a digest of the text."""
    total, rest, noise = np.zeros(len(texts)), np.zeros(len(texts)), np.zeros(len(texts), np.int64)
    for i, j, row, bucket in _parts(texts):
        total[i:j] = np.bincount(row, models.ratio[bucket], minlength=j - i)
        rest[i:j] = np.bincount(row, models.rest[bucket], minlength=j - i)
    plain = K.text_column(texts)
    for i, j in K.blocks(plain):
        noise[i:j] = K.row_hash(*K.buffers(plain.slice(i, j - i))).view(np.int64)
    return total, rest, noise


def keyed(models: Models, batch: pa.RecordBatch, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log weight, the same plus Gumbel noise, and log weight against the rest."""
    logw, rest, noise = weigh(models, batch["text"])
    ids = batch["doc_id"].fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    u = K.uniform(ids ^ noise, seed)
    return logw, logw - np.log(-np.log(u)), rest


def cut(scores: DataFrame, k: int) -> float | None:
    """The k-th largest key, exactly: its bit pattern is narrowed down by counts
    of ever finer ranges, so no sort and no collected row set grows with the table."""
    if k <= 0:
        return None
    order = F.col("ordered")
    table, low, width = scores, None, 63
    for step in (21, 21, 21, 1):
        width -= step
        part = F.shiftright(order, max(width + 1, 0)) if width >= 0 else order
        rows = table.groupBy(part.alias("p")).count().orderBy(F.desc("p")).toArrow().to_pydict()
        for p, c in zip(rows["p"], rows["count"]):
            if k <= c:
                table, low = table.where(part == p), p
                break
            k -= c
        else:
            return None
    return low


def _ordered(key: np.ndarray) -> np.ndarray:
    """Signed integers in the order of the doubles."""
    bits = key.view(np.int64)
    return np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits)


def _threshold(docs: DataFrame, models: Models, seed: int) -> int | None:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, key, rest = keyed(models, batch, seed)
            good = 1 / (1 + np.exp(-np.clip(rest + models.odds, -700, 700)))
            yield pa.RecordBatch.from_arrays([pa.array(_ordered(key)), pa.array(good)], ["ordered", "good"])

    scores, path = store(docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "ordered bigint, good double"), "quality")
    k = scores.agg(F.sum("good")).first()[0]
    least = cut(scores, round(k or 0))
    discard(docs.sparkSession, path)
    return least


def resample(docs: DataFrame, labels: DataFrame, max_target: int = 10000, seed: int = 6) -> DataFrame:
    """The sampled rows of docs with log_weight and gumbel_key added."""
    K.small_batches(docs.sparkSession)
    models = learn(docs, labels, max_target)
    schema = K.extended(docs.schema, T.StructField("log_weight", T.DoubleType()), T.StructField("gumbel_key", T.DoubleType()))
    kept = [f.name for f in schema.fields[:-2]]
    if models is None:
        return docs.select(*kept, F.lit(0.0).alias("log_weight"), F.lit(0.0).alias("gumbel_key"))
    least = _threshold(docs, models, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            logw, key, _ = keyed(models, batch, seed)
            keep = _ordered(key) >= least if least is not None else np.zeros(len(key), bool)
            cols = [*(batch[c] for c in kept), pa.array(logw), pa.array(key)]
            yield pa.RecordBatch.from_arrays(cols, [*kept, "log_weight", "gumbel_key"]).filter(pa.array(keep))

    return docs.mapInArrow(run, schema)
