"""Road graph files: header CSV for exchange, Parquet for work."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from frota.operators.graph import tagged_edges
from frota.operators.numbering import dense_ids
from frota.sources import schemas


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """Edges with ``edge_seq``, the place in the file, which ranks parallel edges.

    Files written by :func:`write_graph` carry the number. A foreign file does not, so its rows
    are numbered by file and position: ``monotonically_increasing_id`` follows the order in which
    a scan lays out its splits, hence the sort by file name and block start.
    """
    header = spark.read.option("header", True).csv(path).columns
    if "edge_seq" in header:
        return spark.read.schema(schemas.ARESTAS).option("header", True).csv(path)
    raw = (
        spark.read.schema(schemas.ARESTAS_CSV)
        .option("header", True)
        .csv(path)
        .select(
            "*",
            F.col("_metadata.file_path").alias("_file"),
            F.col("_metadata.file_block_start").alias("_block"),
            F.monotonically_increasing_id().alias("_row"),
        )
    )
    numbered = dense_ids(raw, ["_file", "_block", "_row"], "edge_seq")
    return numbered.select("edge_seq", "from_node", "to_node", "weight")


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    """Nodes with ``node_pos``; a repeated id keeps its first place and its last coordinates."""
    raw = (
        spark.read.schema(schemas.NOS)
        .option("header", True)
        .csv(path)
        .select(
            "*",
            F.col("_metadata.file_path").alias("_file"),
            F.col("_metadata.file_block_start").alias("_block"),
            F.monotonically_increasing_id().alias("_row"),
        )
    )
    return unique_nodes(dense_ids(raw, ["_file", "_block", "_row"], "node_pos"))


def unique_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("node_id").agg(
        F.max_by("lat", "node_pos").alias("lat"),
        F.max_by("lon", "node_pos").alias("lon"),
        F.min("node_pos").alias("node_pos"),
    )


def edges_with_length(edges: DataFrame, length: str = "length") -> DataFrame:
    """Street segments without a length count 1.0."""
    return edges.select(
        "edge_seq", "from_node", "to_node", F.coalesce(F.col(length), F.lit(1.0)).cast("double").alias("weight")
    )


def write_graph(nodes: DataFrame, edges: DataFrame, nodes_path: str, edges_path: str) -> None:
    """Header CSV, sorted so that reading the parts in name order restores the file order."""
    nodes.orderBy("node_pos").select("node_id", "lat", "lon").write.mode("overwrite").option("header", True).csv(
        nodes_path
    )
    edges.orderBy("edge_seq").select("edge_seq", "from_node", "to_node", "weight").write.mode("overwrite").option(
        "header", True
    ).csv(edges_path)


def checked_edges(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable, rejected with a reason): unknown end points, negative, NaN or missing weights."""
    tagged = tagged_edges(edges, nodes)
    columns = ["edge_seq", "from_node", "to_node", "weight"]
    return (
        tagged.where("motivo IS NULL").select(*columns),
        tagged.where("motivo IS NOT NULL").select(*columns, "motivo"),
    )
