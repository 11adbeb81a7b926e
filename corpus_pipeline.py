"""A training-corpus pipeline over the documents table.

STAGES lists (name, function); each function takes (spark, docs, sf_dir), works
on everything its predecessor kept and returns the rows that stay, with the columns
of documents as they were, whatever else they are called; the last adds its own.

Null and empty texts pass toxicity, near-dedup and BPE, and take part in the two
samplings by their doc_id; texts are read whole however long; repeated rows stay or
go together; rows with a null doc_id are in no group of copies and are sampled by
their text; an empty table, or one without labels, passes through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from retexa.llm import bpe, minhash, mixing, quality, textkit, toxicity
from retexa.llm.catalog import ALPHA, RATE, SEED, TARGETS
from retexa.session import discard, store


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the noisy-or model doesn't reject."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by importance resampling."""
    rows, back = textkit.set_aside(docs, lambda c: c in ("log_weight", "gumbel_key"))
    return back(quality.resample(rows, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, and all that are in none."""
    return minhash.keep_first(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn to the target weights of source, language and topic."""
    rows, back = textkit.set_aside(docs, lambda c: c.startswith("_mix_"))
    return back(mixing.mix(rows, TARGETS, RATE, ALPHA, SEED))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their tokens, their number and whether they decode to the text."""
    return bpe.encode(docs, check=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality classifier", keep_quality),
    ("MinHash near-dedup", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", tokenise),
]
#: Sketches, trained models and BPE are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over documents; every stage is written as Parquet and
    reread, and deleted when the next one is written."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (name, stage) in enumerate(STAGES):
        docs, path = store(stage(spark, docs, sf_dir), f"stage{k}")
        if last:
            discard(spark, last)
        last = path
    return docs
