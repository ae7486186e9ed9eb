"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from frota.session import work_path

#: Words are maximal runs of anything but ASCII white space (blank, tab to carriage return).
WORD = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut after one pass over the plan.

    A task that runs again reads the files, so row places inside them never change.
    """
    path = work_path(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def dropped(*frames: DataFrame) -> None:
    """Delete tables that ``stored`` answered and nothing reads any more. Spark deletes shuffles once it finds that no table refers to
    them, which it is made to look for here."""
    for df in frames:
        spark = df.sparkSession
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def apart(docs: DataFrame, *needed: str) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with all columns but ``needed`` under names that no operator uses, and the name each column had.

    Names are given by place, so clashing and even equal names are carried; ``toDF(*names.values())`` gives them back.
    """
    names = {column if column in needed else f"carried_{i}": column for i, column in enumerate(docs.columns)}
    return docs.toDF(*names), names


def crc_part(doc_id: str | Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as empty text."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % parts


def text_slices(batch: pa.RecordBatch, column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds about ``most`` bytes of text, or one longer row."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    begin, total = 0, 0
    for i, size in enumerate(sizes):
        if i > begin and total + size > most:
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += int(size)
    if begin < len(sizes):
        yield batch.slice(begin)


def over_text(
    df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, column: str = "text"
) -> DataFrame:
    """Apply ``work`` to slices of bounded text size; it answers one batch per slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, column):
                out = work(part)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def byte_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mixed(a: np.ndarray, b: np.ndarray | int = 0) -> np.ndarray:
    """A 64-bit name for each pair of 64-bit names; order matters."""
    with np.errstate(over="ignore"):
        x = a * _M1 + (b if isinstance(b, np.ndarray) else np.uint64(b)) * _M2
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
    return x


def as_long(names: np.ndarray) -> np.ndarray:
    return names.view(np.int64)
