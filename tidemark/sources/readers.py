"""Readers of long tables, delimited results and MatrixMarket folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import RESULT


def read_cells(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """The cell table alone; Parquet reads only the columns asked for."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def read_values(spark: SparkSession, path: str, cells: DataFrame, layer: str = "value") -> DataFrame:
    """One layer of the cells given: a semi-join on their ids, other layers not read."""
    return spark.read.parquet(path).select("cell_id", "gene", F.col(layer).alias("value")).join(cells.select("cell_id"), "cell_id", "left_semi")


def read_delimited(spark: SparkSession, path: str, numbers: list[str], sep: str = ",") -> DataFrame:
    """Header and text columns as they are, so that a gene called NA stays a name; numbers are cast, and what is none is null."""
    df = spark.read.option("header", True).option("sep", sep).option("inferSchema", False).option("nullValue", "\u0000").option("emptyValue", "").csv(path)
    return df.select(*[F.col(f"`{c}`").try_cast("double").alias(c) if c in numbers else F.col(f"`{c}`") for c in df.columns])


def read_result(spark: SparkSession, path: str) -> DataFrame:
    """A written two-part result with its schema."""
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    df = read_delimited(spark, path, [f.name for f in RESULT if f.dataType.typeName() in ("double", "integer", "long")])
    return df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in RESULT if f.name in df.columns])


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a text file, or of a folder's parts, with what puts them in order: file, split, and a number within the read."""
    df = spark.read.text(path)
    return df.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a side file with their 1-based numbers (one line a gene or cell)."""
    ordered = _lines(spark, path).orderBy("file", "block", "line").select("value")
    return ordered.rdd.zipWithIndex().map(lambda x: (x[1] + 1, x[0].value)).toDF("i long, name string")


def read_matrix_market(spark: SparkSession, folder: str, matrix: str = "counts.mtx", genes: str = "genes.txt", cells: str = "cells.txt") -> DataFrame:
    """cell_id, gene, n of a genes x cells coordinate file with its two side files."""
    lines = _lines(spark, f"{folder}/{matrix}").where(~F.col("value").startswith("%") & (F.trim("value") != ""))
    # the size line is the first that is no comment, whatever it looks like
    head = lines.orderBy("file", "block", "line").first()
    parts = F.split(F.trim("value"), "\\s+")
    entries = lines.where(F.col("line") != (head["line"] if head else -1)).select(parts[0].cast("long").alias("i"), parts[1].cast("long").alias("j"), parts[2].cast("double").alias("n"))
    g = _numbered(spark, f"{folder}/{genes}").select("i", F.col("name").alias("gene"))
    c = _numbered(spark, f"{folder}/{cells}").select(F.col("i").alias("j"), F.col("name").alias("cell_id"))
    return entries.join(g, "i").join(c, "j").select("cell_id", "gene", "n")


def inventory(spark: SparkSession, folder: str, endings: tuple[str, ...] = (".csv", ".txt", ".json", ".png", ".parquet")) -> DataFrame:
    """path, size_kb, modified and rows of each result file under a folder.

    rows: lines of a .csv but its header (a folder of parts counts part by part), -1 for an empty one, null for other files; contents are
    read of .csv files only.  Hidden files and those beginning with _ aren't listed.
    """
    wanted = F.lit(False)
    for x in endings:
        wanted = wanted | F.lower("path").endswith(x)
    name = F.col("_metadata.file_path").alias("_p")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select(name, "path", "modificationTime", "length").where(wanted)
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").text(folder).groupBy(name).agg((F.count("*") - 1).alias("rows"))
    empty = F.lower("path").endswith(".csv") & F.col("rows").isNull()
    return files.join(lines, "_p", "left").select("path", F.round(F.col("length") / 1024, 1).alias("size_kb"), F.col("modificationTime").alias("modified"), F.when(empty, F.lit(-1)).otherwise(F.col("rows")).cast("long").alias("rows"))
