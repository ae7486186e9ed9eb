"""Listing by pages that cost the same wherever they are.

A table is written once in key order, cut into blocks of a fixed number of rows, with an index of the first and last key of each.
Blocks that follow each other share a folder, so small blocks do not make many files; within a folder rows lie in order, and Parquet's
statistics skip the others. A page then opens the one or two folders that hold its blocks, found by place or by the last key of the page before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from frota.operators.numbering import dense_ids

FOLDER_ROWS = 100_000


def per_folder(folder_rows: int) -> int:
    """Blocks of ``folder_rows`` rows in one folder: as many as ``FOLDER_ROWS`` rows have, one at least."""
    return max(1, FOLDER_ROWS // folder_rows)


def write_pages(table: DataFrame, key: str, folder: str, folder_rows: int = FOLDER_ROWS) -> None:
    """Write ``table``, whose ``key`` does not repeat, so that ``page_at`` and ``page_after`` can read it."""
    placed = dense_ids(table, [key], "_place")
    placed = placed.withColumn("_block", F.expr(f"_place div {folder_rows}")).withColumn("_folder", F.expr(f"_block div {per_folder(folder_rows)}"))
    placed.repartition("_folder").sortWithinPartitions("_folder", "_place").write.partitionBy("_folder").parquet(f"{folder}/rows")
    index = placed.groupBy("_block").agg(F.min(key).alias("first"), F.max(key).alias("last"), F.max("_place").alias("end"))
    index.write.parquet(f"{folder}/index")


def _rows(spark: SparkSession, folder: str, first: int, last: int, folder_rows: int) -> DataFrame:
    """Blocks ``first`` to ``last``."""
    # a filter on the folder number is a choice of folders, no row is read for it
    rows = spark.read.parquet(f"{folder}/rows")
    return rows.where(F.col("_folder").between(first // per_folder(folder_rows), last // per_folder(folder_rows)) & F.col("_block").between(first, last))


def page_at(spark: SparkSession, folder: str, key: str, offset: int, limit: int, folder_rows: int = FOLDER_ROWS) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` in key order, whole."""
    found = _rows(spark, folder, offset // folder_rows, (offset + limit - 1) // folder_rows, folder_rows)
    return found.where(F.col("_place").between(offset, offset + limit - 1)).orderBy(key).drop("_place", "_block", "_folder")


def page_after(spark: SparkSession, folder: str, key: str, after, limit: int, folder_rows: int = FOLDER_ROWS) -> DataFrame:
    """The ``limit`` rows that follow the key ``after``, whole; from the start if it is null."""
    index = spark.read.parquet(f"{folder}/index")
    follows = index if after is None else index.where(F.col("last") > F.lit(after))
    first = follows.agg(F.min("_block")).first()[0]
    if first is None:
        return spark.read.parquet(f"{folder}/rows").where(F.lit(False)).drop("_place", "_block", "_folder")
    found = _rows(spark, folder, first, first + -(-limit // folder_rows), folder_rows)
    found = found if after is None else found.where(F.col(key) > F.lit(after))
    return found.orderBy(key).limit(limit).drop("_place", "_block", "_folder")
