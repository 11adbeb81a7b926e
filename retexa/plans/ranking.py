"""A total order over a distributed table, without a single-partition window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from retexa.session import store


def accumulated(df: DataFrame, value: str, *order: str, name: str = "total") -> tuple[DataFrame, int]:
    """df with the sum of a column over all rows up to and with each, in the order, and the whole sum. Rows
    are range partitioned and written with their partition's number; the sums of the
    partitions, one number each, give every partition's offset."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts, _ = store(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()), "ranked")
    sizes = sorted((r["_part"], r["x"]) for r in parts.groupBy("_part").agg(F.sum(value).alias("x")).collect())
    offsets, total = [], 0
    for part, size in sizes:
        offsets.append((part, total))
        total += size
    base = F.broadcast(df.sparkSession.createDataFrame(offsets, "_part int, _base bigint"))
    run = F.sum(value).over(W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return parts.join(base, "_part").withColumn(name, F.col("_base") + run).drop("_part", "_base"), total


def ranked(df: DataFrame, *order: str, name: str = "place") -> tuple[DataFrame, int]:
    """df with its 0-based place in the order, and the number of rows."""
    rows, total = accumulated(df.withColumn("_one", F.lit(1)), "_one", *order, name=name)
    return rows.withColumn(name, F.col(name) - 1).drop("_one"), total
