"""Collections, their partitions and gold references between them.

A collection is a DataFrame with doc_idx (its order), doc_id and words.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retexa.functions import text as X


def from_text(df: DataFrame, doc_id: str, text: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """(id, words) from a table of plain texts."""
    return df.select(F.col(doc_id).alias("id"), X.words(F.col(text)).alias("words"), *keep)


def get_docs(docs: DataFrame, ids: DataFrame | Sequence, column: str = "id") -> DataFrame:
    """The documents asked for, by a table (id) or a few values."""
    if isinstance(ids, DataFrame):
        return docs.join(ids.select(F.col(ids.columns[0]).alias(column)).distinct(), column, "left_semi")
    return docs.where(F.col(column).isin(list(ids)))


def shingled(docs: DataFrame, window: int = 20, overlap: int = 5, drop_contained_tail: bool = False) -> DataFrame:
    """(parent_id, shingle, start, stop, words, positions) for each window of each document."""
    rows = docs.select(F.col("id").alias("parent_id"), F.posexplode(X.shingles(F.col("words"), window, overlap, drop_contained_tail)).alias("shingle", "s"))
    return rows.select("parent_id", "shingle", "s.start", "s.stop", "s.words", F.sequence(F.col("s.start"), F.col("s.stop") - 1).alias("positions"))


def split_books(docs: DataFrame, old: Sequence[str], new: Sequence[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents of the books of either part, and those of no known book."""
    return docs.where(F.col("book").isin(list(old))), docs.where(F.col("book").isin(list(new))), docs.where(~F.col("book").isin([*old, *new]))


def encode_ref(book: str, chapter: object, verse: object) -> str:
    return f"{book.replace(' ', '-')}_{chapter}_{verse}"


def decode_refs(df: DataFrame, column: str) -> DataFrame:
    """Book, chapter and verse of ids like First-Book_3_16."""
    p = F.split(column, "_")
    return df.withColumns({"book": F.regexp_replace(F.element_at(p, 1), "-", " "), "chapter": F.element_at(p, 2), "verse": F.element_at(p, 3)})


def resolve_refs(refs: DataFrame, docs1: DataFrame, docs2: DataFrame, max_targets: int | None = None) -> DataFrame:
    """References with ids replaced by doc_idx: (ref_id, source, target). Unresolved
    ids drop out, and references with an empty side or too many ids on one."""
    if max_targets is not None:
        refs = refs.where((F.size("source") <= max_targets) & (F.size("target") <= max_targets))

    def side(name: str, docs: DataFrame) -> DataFrame:
        rows = refs.select("ref_id", F.explode(name).alias("doc_id")).join(docs.select("doc_id", "doc_idx"), "doc_id")
        return rows.groupBy("ref_id").agg(F.array_sort(F.collect_set("doc_idx")).alias(name))

    return side("source", docs1).join(side("target", docs2), "ref_id")


def refs_to_shingles(refs: DataFrame, shingles: DataFrame, targets: DataFrame, max_targets: int | None = None) -> DataFrame:
    """References by token position (ref_id, source array<int>, target array<string>)
    to shingles (doc_idx, start, stop): a source is every window that holds one of
    its tokens. References drop out with a missing target, an empty side or too many ids."""
    tokens = refs.select("ref_id", F.explode("source").alias("p"))
    width = shingles.agg(F.max(F.col("stop") - F.col("start")).alias("w"))
    wide = tokens.crossJoin(F.broadcast(width)).withColumn("b", F.explode(F.sequence(F.floor((F.col("p") - F.col("w")) / F.col("w")), F.floor(F.col("p") / F.col("w")))))
    spans = shingles.crossJoin(F.broadcast(width)).select("doc_idx", "start", "stop", F.floor(F.col("start") / F.col("w")).alias("b"))
    source = wide.join(spans, "b").where("p >= start and p < stop").groupBy("ref_id").agg(F.array_sort(F.collect_set("doc_idx")).alias("source"))
    rows = refs.select("ref_id", F.explode("target").alias("doc_id")).join(targets.select("doc_id", "doc_idx"), "doc_id", "left")
    target = rows.groupBy("ref_id").agg(F.array_sort(F.collect_set("doc_idx")).alias("target"), F.max(F.col("doc_idx").isNull()).alias("lost")).where("not lost").drop("lost")
    out = source.join(target, "ref_id").where("size(source) > 0 and size(target) > 0")
    return out.where((F.size("source") <= max_targets) & (F.size("target") <= max_targets)) if max_targets is not None else out
