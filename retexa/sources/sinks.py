"""Writers of matches, vectors and experiment figures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_matches(report: DataFrame, path: str) -> None:
    """CSV with a header, best match first."""
    report.orderBy(F.desc("similarity"), "doc1id", "doc2id").write.mode("overwrite").csv(path, header=True)


def write_vectors(vectors: DataFrame, path: str) -> None:
    """word, tab, numbers with six significant digits and single spaces."""
    numbers = F.array_join(F.transform("vec", lambda x: F.format_string("%.6g", x)), " ")
    vectors.select(F.concat_ws("\t", "word", numbers).alias("value")).write.mode("overwrite").text(path)


def write_figures(figures: DataFrame, path: str, **experiment: str) -> None:
    """One JSON line a row, with the experiment's settings beside the figures."""
    figures.withColumns({k: F.lit(v) for k, v in experiment.items()}).write.mode("append").json(path)


def train_vectors(docs: DataFrame, dim: int = 100, min_count: int = 5, window: int = 5, iterations: int = 1, seed: int = 0) -> DataFrame:
    """(word, vec) trained on a table with features."""
    from pyspark.ml.feature import Word2Vec
    from pyspark.ml.functions import vector_to_array

    model = Word2Vec(vectorSize=dim, minCount=min_count, windowSize=window, maxIter=iterations, seed=seed, inputCol="features", outputCol="out").fit(docs)
    return model.getVectors().select("word", vector_to_array("vector").alias("vec"))


def printed(matches: DataFrame) -> DataFrame:
    """(value): one readable line a match of a report."""
    return matches.select(F.format_string("%.4f  [%s] %s  ~  [%s] %s", "similarity", F.col("doc1id").cast("string"), "doc1text", F.col("doc2id").cast("string"), "doc2text").alias("value"))
