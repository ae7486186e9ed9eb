"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept; its result is written as Parquet and
read back as the next one's docs. All but the last return the columns of ``documents``; further columns are
carried, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from frota.llm import mixing, packing, quality_rules, simhash, suffix_dedup
from frota.llm.common import apart, read_table, stored


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base check or a learned rule go."""
    docs, names = apart(docs, "doc_id", "text")
    rules = quality_rules.learned(docs, read_table(spark, sf_dir, "labels"))
    judged = quality_rules.judged(quality_rules.with_statistics(docs, name="_stats"), rules, "_stats")
    return judged.where("kept").select(*docs.columns).toDF(*names.values())


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return simhash.representatives(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes covered by a string of 100 bytes that also starts earlier go; ``n_chars`` is counted anew."""
    docs, names = apart(docs, "doc_id", "text", "n_chars")
    kept = suffix_dedup.deduplicated(docs, as_text=True)
    kept = kept.withColumn("text", F.col("kept")).withColumn("n_chars", F.length("text").cast("long"))
    return kept.select(*docs.columns).toDF(*names.values())


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.repeated(docs, mixing.mix(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece with its place in a sequence of at most 1024 tokens."""
    return packing.packed(docs.select("doc_id", "text")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality rules", filter_quality),
    ("SimHash near-dedup", drop_near_duplicates),
    ("suffix-array dedup", cut_repeats),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: SQL can express neither the learned rules nor the token ids; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
