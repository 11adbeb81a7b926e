"""Frames and cases that every operator must take."""

from __future__ import annotations

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs(spark, texts, extra=False, ids=None):
    """documents rows; extra adds columns with names that operators use themselves."""
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, "en", f"s{k % 3}", len(t or "")) for k, (i, t) in enumerate(zip(ids, texts))]
    df = spark.createDataFrame(rows, DOCS)
    if extra:
        from pyspark.sql import functions as F

        for name in ("tokens", "n_tokens", "id", "a", "b", "rank", "score", "topic", "label", "path", "digest", "count", "keep", "good", "mark", "_mix_p", "log_weight"):
            df = df.withColumn(name, F.lit("own"))
    return df


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


AWKWARD = [None, "", " \n\t ", "a", "word " * 30000, "x" * 20000, "the same text here", "the same text here", "日本語 テキスト 😀", "a\u0000b", "!!! ... ???"]
