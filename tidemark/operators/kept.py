"""Tables between steps: written ones, which cut a plan and survive lost executors, and a few rows for the driver."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; one of our own where that is unset and the master is local."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir is unset: on a cluster it has to name a shared folder")
        found = _OWN.get(sc.applicationId)
        if not found:
            found = _OWN[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    return found.rstrip("/")


def keep(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table of the shared folder, read back; it goes when the driver's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame) -> DataFrame:
    """``df`` by its rows: for tables of a bounded number of rows a cell type."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)
