"""Table access: paged listing, inserts, put by key and timestamp, key lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from frota.operators.latest import latest_per_key
from frota.operators.numbering import dense_ids
from frota.sources import schemas


def page(df: DataFrame, key: str, offset: int = 0, limit: int = 10) -> DataFrame:
    """One page in key order; planned as a top-k, so no task sorts the whole table."""
    return df.orderBy(key).offset(offset).limit(limit)


def insert_rows(table: DataFrame, rows: DataFrame, name: str, order: list[str]) -> DataFrame:
    """The new rows as stored: keys after the largest in use, defaults for missing values.

    Append the result to the table; its count is the number of inserted rows.
    """
    key = schemas.KEYS[name]
    last = table.agg(F.coalesce(F.max(key), F.lit(0)).alias("m")).first()["m"]
    numbered = dense_ids(rows, order, key, start=last + 1)
    for column, default in schemas.DEFAULTS.get(name, {}).items():
        given = F.col(column) if column in rows.columns else F.lit(None)
        numbered = numbered.withColumn(column, F.coalesce(given, F.lit(default)))
    missing = {
        f.name: F.lit(None).cast(f.dataType) for f in table.schema.fields if f.name not in numbered.columns
    }
    return numbered.withColumns(missing).select(*table.columns)


def put_by_key(log: DataFrame, key: str, ts: str, write_seq: str) -> DataFrame:
    """One row per (key, timestamp): the last write wins."""
    return latest_per_key(log, [key, ts], [write_seq])


def lookup(keys: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Each asked key with its row and a ``found`` flag."""
    hit = table.withColumn("_hit", F.lit(True))
    return (
        keys.select(key).distinct().join(hit, key, "left").withColumn("found", F.col("_hit").isNotNull()).drop("_hit")
    )
