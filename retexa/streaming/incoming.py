"""An extension: incoming documents checked against a fixed index.

Every stream row is joined with the static postings by feature and aggregated
within the micro-batch, so no state outlives a batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from retexa.functions import text as X
from retexa.operators import setjoin


def containment_stream(stream: DataFrame, index: DataFrame, path: str, doc_id: str, threshold: float = 0.5) -> DataStreamWriter:
    """A writer, to be started, that puts (doc1, doc2, sim) in Parquet under path for each
    stream document (doc_id, text); index is a table (id, features). A batch has its own
    folder, batch=<number>, and overwrites it when it is run again."""
    postings = setjoin.hashed(index).persist()  # every batch joins the same index

    def each(batch: DataFrame, number: int) -> None:
        docs = batch.select(F.col(doc_id).alias("id"), F.transform(X.tokens(F.lower("text")), lambda t: t).alias("features"))
        sims = setjoin.naive(setjoin.hashed(docs), postings, "containment", threshold)
        sims.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(each)
