"""Session defaults and the shared folder that cuts lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", memory: str = "8g", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the defaults above; clusters bring their own."""
    b = SparkSession.builder.master(f"local[{cores}]").appName("retexa").config("spark.driver.memory", memory)
    b = b.config("spark.sql.shuffle.partitions", str(partitions))
    for k, v in {**DEFAULTS, **conf}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where that is
    unset and the whole of Spark runs on this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that every executor can reach")
    base = tempfile.mkdtemp(prefix="retexa-")
    spark.conf.set("spark.checkpoint.dir", base)
    return base


def store(df: DataFrame, name: str = "t") -> tuple[DataFrame, str]:
    """Write to the shared folder and read back: lineage ends at files that
    survive any executor. Returns the reread table and its path."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/retexa/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path), path


def store_with(df: DataFrame, name: str = "t", *figures: Column) -> tuple[DataFrame, str, dict]:
    """The same with its number of rows, n, and other aggregates, taken while writing."""
    seen = Observation()
    table, path = store(df.observe(seen, F.count(F.lit(1)).alias("n"), *figures), name)
    return table, path, seen.get


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete stored tables that nothing reads any more."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
