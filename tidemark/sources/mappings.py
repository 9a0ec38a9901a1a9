"""The driver's tables as the engine's inputs: obs, expr and var."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Inputs:
    """obs: one row a cell; expr: one row a stored non-zero (counts n, value = log1p n); var: genes in order."""

    obs: DataFrame
    expr: DataFrame
    var: DataFrame


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders_by_part(spark: SparkSession, sf_dir: str) -> Inputs:
    """Orders are cells, part brands and types genes, market segments cell types, nations donors; status F is the reference."""
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey", "c_acctbal")
    obs = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus").join(customer, F.col("o_custkey") == F.col("c_custkey"))
    obs = obs.select(
        F.col("o_orderkey").alias("cell_id"), F.col("c_mktsegment").alias("celltype"), F.col("o_orderstatus").alias("status"),
        F.when(F.col("o_orderstatus") == "F", 0).otherwise(1).alias("cond"), F.col("c_nationkey").alias("donor"), F.col("c_acctbal").alias("balance"),
    )
    gene = F.concat_ws("|", "p_brand", "p_type")
    part = table(spark, sf_dir, "part").select("p_partkey", gene.alias("gene"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity").join(part, F.col("l_partkey") == F.col("p_partkey"))
    expr = lines.groupBy(F.col("l_orderkey").alias("cell_id"), "gene").agg(F.sum("l_quantity").alias("n")).withColumn("value", F.log1p("n"))
    return Inputs(obs, expr, part.select("gene").distinct())


#: The same inputs for the SQL oracle.
ORDERS_BY_PART_SQL = """
obs AS (SELECT o_orderkey AS cell_id, c_mktsegment AS celltype, o_orderstatus AS status,
  CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END AS cond, c_nationkey AS donor, c_acctbal AS balance
  FROM orders JOIN customer ON o_custkey = c_custkey),
expr AS (SELECT l_orderkey AS cell_id, p_brand || '|' || p_type AS gene, sum(l_quantity) AS n, ln(1 + sum(l_quantity)) AS value
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
var AS (SELECT DISTINCT p_brand || '|' || p_type AS gene FROM part)
"""


def documents_by_word(spark: SparkSession, sf_dir: str) -> Inputs:
    """Documents are cells, their words genes, languages cell types, sources donors, labelled quality the condition."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    obs = docs.select(F.col("doc_id").alias("cell_id"), F.col("lang").alias("celltype"), F.col("quality").alias("cond"), F.col("source").alias("donor"))
    words = docs.select(F.col("doc_id").alias("cell_id"), F.explode(F.split(F.lower("text"), "[^\\p{L}]+")).alias("gene")).where("gene <> ''")
    expr = words.groupBy("cell_id", "gene").agg(F.count("*").cast("double").alias("n")).withColumn("value", F.log1p("n"))
    return Inputs(obs, expr, expr.select("gene").distinct())


def users_by_event(spark: SparkSession, sf_dir: str) -> Inputs:
    """Users are cells, event types genes; the hour class is the cell type, the parity of the user the condition."""
    e = table(spark, sf_dir, "events")
    obs = e.select(F.col("user_id").alias("cell_id")).distinct().select("cell_id", F.lit("all").alias("celltype"), (F.col("cell_id") % 2).cast("int").alias("cond"), (F.col("cell_id") % 10).alias("donor"))
    expr = e.groupBy(F.col("user_id").alias("cell_id"), F.col("event_type").alias("gene")).agg(F.count("*").cast("double").alias("n")).withColumn("value", F.log1p("n"))
    return Inputs(obs, expr, e.select(F.col("event_type").alias("gene")).distinct())
