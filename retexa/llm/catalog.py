"""Queries of the corpus operators, one a dealt operator, and SQL where it can say the same."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retexa.llm import bpe, licences, minhash, mixing, neighbours, quality, token_counts, toxicity, url_lists, vector_dedup
from retexa.session import shared_dir

#: Target shares: the four languages, and a topic mix; sources by the square root of their tokens.
TARGETS = {
    "lang": {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1},
    "topic": {"long prose": 0.35, "prose": 0.35, "numeric": 0.15, "licence": 0.05, "table": 0.1},
}
RATE, ALPHA, SEED = 0.6, 0.5, 3
#: A dated list: pattern, date, action, category.
URL_LIST = [
    ("cheap-pills.example.com", "2024-01-10", "block", "spam"),
    ("cheap-pills.example.com", "2024-05-01", "remove", "spam"),
    ("cheap-pills.example.com", "2024-06-15", "block", "scam"),
    ("spam-farm.example.org", "2024-02-01", "block", "spam"),
    ("spam-farm.example.org/en", "2024-04-01", "allow", "appeal"),
    ("spam-farm.example.org/en", "2024-08-01", "remove", "appeal"),
    ("example.net", "2024-03-01", "block", "outage"),
    ("example.net", "2024-03-20", "remove", "outage"),
    ("blog.thernd.example.net", "2024-03-05", "allow", "appeal"),
    ("ththed.example.org", "2024-01-01", "block", "adult"),
    ("example.org/es", "2024-07-01", "block", "legal"),
    ("example.com/fr", "2024-09-01", "block", "legal"),
    ("example.com/fr", "2024-11-01", "remove", "legal"),
    ("m.example.com", "2024-01-01", "allow", "mirror"),
]
#: Pages carry no fetch time; one in 2024 follows from the page's number.
FETCHED = 1704067200, 7919, 366 * 1440


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence of every document. Documents carry no path; one follows from source and number."""
    part = lambda n: F.floor(F.col("doc_id") / n).cast("string")
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", "source", part(4096), part(64), F.concat("doc_id", F.lit(".txt"))).alias("path"), "text")
    return licences.scan(docs)


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector in a group of near-duplicates and the one that stays."""
    return vector_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents drawn, with their topic, words and probability."""
    got = mixing.mix(_table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang"), TARGETS, RATE, ALPHA, SEED)
    return got.select("doc_id", "source", "lang", F.col("_mix_topic").alias("topic"), F.col("_mix_tokens").alias("n_words"), F.round("_mix_p", 6).alias("probability"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, and whether decoding them gives its text."""
    return bpe.encode(_table(spark, sf_dir, "documents").select("doc_id", "text"), check=True).drop("text")


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest other vectors of every vector whose number 100 divides, among all vectors."""
    return neighbours.nearest(_table(spark, sf_dir, "embeddings"), queries=F.col("vec_id") % 100 == 0)


def op6_quality_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that Gumbel top-k keeps, with their log weights."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.resample(docs, _table(spark, sf_dir, "labels")).drop("text")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document, through a cache that holds what an earlier run
    over the labelled documents stored."""
    docs, cache = _table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/token_counts-{uuid.uuid4().hex}"
    ids = _table(spark, sf_dir, "labels").select("doc_id")
    few = ids.count() <= token_counts.BROADCAST_DIGESTS
    token_counts.count_tokens(docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi"), cache)
    return token_counts.count_tokens(docs, cache)


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in a group of near-duplicates and the one that stays."""
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxic documents and their offending sentences."""
    return toxicity.flag_toxic(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every capture with the list entry that decides it."""
    start, step, minutes = FETCHED
    at = F.timestamp_seconds(F.lit(start) + (F.col("page_id") * step) % minutes * 60)
    captures = _table(spark, sf_dir, "pages").select("page_id", "url", at.alias("fetched_at"))
    entries = spark.createDataFrame(URL_LIST, "pattern string, dated string, action string, category string")
    return url_lists.screen(captures, entries)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_license_scan,
        op2_embedding_near_dedup,
        op3_mixing,
        op4_byte_bpe,
        op5_nearest_neighbours,
        op6_quality_resample,
        op7_token_counts,
        op8_minhash_near_dedup,
        op9_toxicity,
        op10_url_filter,
    )
}
ORACLES: dict[str, str] = {
    "op3_mixing": mixing.mix_sql(TARGETS, RATE, ALPHA, SEED),
    "op10_url_filter": url_lists.screen_sql(URL_LIST, "SELECT page_id, url, make_timestamp(({} + (page_id * {}) % {} * 60) * 1000000) AS fetched_at FROM pages".format(*FETCHED)),
}
