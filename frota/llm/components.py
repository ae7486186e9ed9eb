"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from frota.llm.common import stored


def _signature(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long"))).first())


def components(links: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, label) for every node of the links (a, b); the label is the smallest node of its component.

    Each round hooks every neighbour to the smallest one: first the larger neighbours, then the smaller. Minima
    are partially aggregated and joined back, so a node with many links is split like any skewed join. The
    links are stored once a round; rounds grow with the logarithm of the longest chain.
    """
    links = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = stored(links, "links")
    last = _signature(links)
    for _ in range(max_rounds):
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("k")).agg(F.least(F.col("k"), F.min("b")).alias("m"))
        large = (
            both.where("b > a").join(least, F.col("a") == F.col("k")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        )
        large = stored(large, "links")
        least = large.groupBy(F.col("a").alias("k")).agg(F.min("b").alias("m"))
        small = large.join(least, F.col("a") == F.col("k")).select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
        links = stored(small.where("a <> b").distinct(), "links")
        now = _signature(links)
        if now == last:
            break
        last = now
    else:
        raise RuntimeError("components did not settle")
    return links.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(
        links.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    )


def local_labels(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest member of the component of each of ``n`` numbered nodes under links a-b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if np.array_equal(before, label):
            return label
