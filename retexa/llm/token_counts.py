"""Operator 7, token counts through a digest cache.

Content is normalised (line ends to \n, white space at both ends dropped) and
digested; the cache holds (digest, n_tokens) in one partition per tokenizer
version, whose digest covers the vocabulary file and the pattern. Documents are
joined to the stored counts by digest; of the misses, one document a digest is
encoded, and its count is appended to the cache.

Only digests, hashes and ids are shuffled. The texts to encode are found in a
second scan by their doc_id and a 64-bit hash, so that nothing is normalised or
digested again; that join broadcasts the misses while they are few and beyond
that shuffles.

Defined results: a null text has a null digest and count; an empty or blank text
counts 0 tokens; repeated rows and equal contents are encoded once and each get
their count; texts are encoded whole however long; null ids are kept; a missing or empty cache folder is an empty
cache; duplicate cache rows are harmless; an empty table gives an empty result.
``cached`` tells whether the count was stored before the call. Other columns
aren't carried, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from retexa.llm import bpe
from retexa.llm import textkit as K
from retexa.session import discard, store, store_with

#: Misses sent to every executor at most; beyond it the join shuffles.
BROADCAST_DIGESTS = 1_000_000
STORED = "tokenizer string, digest binary, n_tokens bigint"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), r"\A\s+|\s+\z", "")


def digest(text: Column) -> Column:
    """16 bytes of SHA-256 of the normalised content."""
    return F.unhex(F.substring(F.sha2(normalised(text), 256), 1, 32))


def stored(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """Counts of one tokenizer version, one row a digest."""
    path = spark._jvm.org.apache.hadoop.fs.Path(cache)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        rows = spark.read.schema(STORED).parquet(cache).where(F.col("tokenizer") == version)
    else:
        rows = spark.createDataFrame([], STORED)
    return rows.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe.Encoder(path)
        for batch in batches:
            texts = batch["content"]
            for i, j in K.blocks(K.text_column(texts), bpe.BLOCK):
                count = coder.counts(texts.slice(i, j - i).to_pylist())
                yield pa.RecordBatch.from_arrays([batch["digest"].slice(i, j - i), pa.array(count)], ["digest", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, cache: str, path: str = bpe.VOCABULARY) -> DataFrame:
    """(doc_id, digest, n_tokens, cached) for every row of docs."""
    K.small_batches(docs.sparkSession)
    spark, version = docs.sparkSession, bpe.vocabulary(path).digest
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    mark = F.xxhash64("text")
    keyed, p1 = store(texts.select("doc_id", digest(F.col("text")).alias("digest"), mark.alias("mark")), "digests")
    known = stored(spark, cache, version)
    missing = keyed.where("digest is not null").groupBy("digest").agg(F.min(F.struct("doc_id", "mark")).alias("carrier"))
    missing, p2, size = store_with(missing.join(known, "digest", "left_anti").select("digest", F.col("carrier.doc_id").alias("carrier"), F.col("carrier.mark").alias("wanted")), "misses")
    side = F.broadcast(missing) if size["n"] <= BROADCAST_DIGESTS else missing.hint("shuffle_hash")
    todo = texts.where("text is not null").withColumn("mark", mark)
    todo = todo.join(side, (F.col("mark") == F.col("wanted")) & F.col("doc_id").eqNullSafe(F.col("carrier")))
    fresh = todo.select("digest", normalised(F.col("text")).alias("content")).mapInArrow(_count(path), "digest binary, n_tokens bigint")
    # rows that repeat a carrier are encoded with it
    fresh, p3 = store(fresh.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")), "counts")
    fresh.withColumn("tokenizer", F.lit(version)).write.mode("append").partitionBy("tokenizer").parquet(cache)
    old = known.join(missing.select("digest"), "digest", "left_anti").withColumn("cached", F.lit(True))  # the append may show in it
    joined = keyed.join(old.unionByName(fresh.withColumn("cached", F.lit(False))), "digest", "left")
    out, _ = store(joined.select("doc_id", F.lower(F.hex("digest")).alias("digest"), "n_tokens", F.coalesce("cached", F.lit(False)).alias("cached")), "token_counts")
    discard(spark, p1, p2, p3)
    return out
