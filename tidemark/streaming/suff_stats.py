"""Sufficient statistics over a stream: counts, sums and sums of squares add up, so the table stays current."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream_values(spark: SparkSession, folder: str, schema) -> DataFrame:
    """New Parquet files of a folder as a stream of values (cell_id, gene, value, ts)."""
    return spark.readStream.schema(schema).parquet(folder)


def running_statistics(values: DataFrame, obs: DataFrame) -> DataFrame:
    """Streaming aggregate a cell type and gene; obs is a static table.  Write it in update or complete mode."""
    x = values.where("value > 0").join(obs.select("cell_id", "celltype", "cond"), "cell_id")
    arm = lambda k, c: F.when(F.col("cond") == k, c)
    v = F.col("value")
    return x.groupBy("celltype", "gene").agg(
        *[f.alias(f"{n}_{a}") for k, a in ((0, "ref"), (1, "test")) for n, f in (("c", F.count_if(F.col("cond") == k)), ("s", F.coalesce(F.sum(arm(k, v)), F.lit(0.0))), ("q", F.coalesce(F.sum(arm(k, v * v)), F.lit(0.0))))]
    )


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Tumbling-window counts of event types with a watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def to_the_end(stream: DataFrame, label: str) -> DataFrame:
    """The whole result of a streaming aggregate when all that is there has been read: a written table, not the driver's memory."""
    spark = stream.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir is unset: on a cluster it has to name a shared folder")
        folder = "file://" + tempfile.mkdtemp(prefix="tidemark-stream-")
    path = f"{folder.rstrip('/')}/{label}-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        # each batch holds the whole result so far
        batch.write.mode("overwrite").parquet(f"{path}/result")

    query = stream.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/result")
