"""Shortest paths over a road graph cut into regions, for graphs that are too large to hand to every task.

A region is a bounded number of nodes that lie near each other, with the edges that lead to them; the ends of edges that come
from elsewhere are its rim. A round takes, per region, the sources that something new arrived for, relaxes all edges of the region to a
fixpoint with array operations, and sends the distances of nodes that other regions have on their rim, if they got better. So a
round shuffles one row per part and region that changed, and there are about as many rounds as regions on the longest path, not
hops. Sources that lie near each other form a part. What the sources of a part know of a region is one row of arrays, as is what one region
sends another for a part, so a round handles few rows; a row is written anew only when it changed and looked up in the round that wrote it.

Predecessors need no join: the rim has the final distances of all nodes before a region's own. Paths are walked back from the targets, through a
region at a time, so only rows of paths are made.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from frota.operators.numbering import dense_ids
from frota.session import cut_lineage, work_path

REGION_NODES = 4096
#: Sources of one part, and distances of one task (sources by nodes of a region): 8 MB of them.
SOURCES, CELLS = 1024, 1_048_576
#: Rounds after which sources whose targets all have a distance are told how far they still have to look.
BOUND_EVERY = 4
_PACKED = "region bigint, nodes binary, owner binary, tail binary, head binary, weight binary, gate binary, gate_to binary"
#: kind 0: what the sources of a part know of a region, 1: distances sent to a region, 2: distances of asked nodes,
#: 3: how far sources have to look; the binaries are arrays, for kind 0 ``d`` and ``step`` have a row a source and a column a node
_ROUND = "kind int, region bigint, part bigint, source binary, node binary, d binary, step binary"
_WALK = "kind int, region bigint, part bigint, source binary, target binary, node binary, back binary"
_FOUND = "source bigint, node bigint, d double, step int, prev bigint"
_PATHS = "source bigint, target bigint, back int, node bigint"
_KINDS = {"source": np.int64, "target": np.int64, "node": np.int64, "d": np.float64, "step": np.int32, "back": np.int32}


@dataclass
class Regions:
    """``packed`` has one row a region, ``owners`` the region of every node and the part it belongs to as a source."""

    packed: DataFrame
    owners: DataFrame


def regions(light: DataFrame, nodes: DataFrame | None = None, region_nodes: int = REGION_NODES) -> Regions:
    """Cut edges (from_node, to_node, weight), one per pair. With the coordinates of ``nodes`` regions are about square:
    bands of latitude of about equally many nodes, each cut along its longitude, to and fro; else regions follow the node ids."""
    ends = light.selectExpr("inline(array(struct(from_node AS node_id), struct(to_node AS node_id)))").distinct()
    order = ["node_id"]
    if nodes is not None and {"lat", "lon"} <= set(nodes.columns):
        at = nodes.select(F.col("node_id").alias("_id"), "lat", "lon").dropDuplicates(["_id"])
        ends = cut_lineage(ends.join(at, F.col("node_id") == F.col("_id"), "left").drop("_id"))
        bands = max(1, round(math.sqrt(ends.count() / region_nodes)))
        cuts = ends.approxQuantile("lat", [b / bands for b in range(1, bands)], 0.1 / bands) if bands > 1 else []
        band = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < F.col("lat"))) if cuts else F.lit(0)
        ends = ends.withColumn("band", F.when(F.col("lat").isNotNull(), band))
        ends = ends.withColumn("along", F.when(F.col("band") % 2 == 0, F.col("lon")).otherwise(-F.col("lon")))
        order = ["band", "along", "node_id"]
    placed = dense_ids(ends.select(*order), order, "place")
    sources = max(1, min(SOURCES, CELLS // region_nodes))
    owners = cut_lineage(
        placed.select(
            F.col("node_id").alias("node"),
            F.floor(F.col("place") / region_nodes).cast("bigint").alias("region"),
            F.floor(F.col("place") / sources).cast("bigint").alias("part"),
        )
    )
    edges = light.join(owners.selectExpr("node AS from_node", "region AS from_region"), "from_node").join(
        owners.selectExpr("node AS to_node", "region AS to_region"), "to_node"
    )
    edges = cut_lineage(edges.select("from_node", "to_node", "weight", "from_region", "to_region"))
    # a region needs the edges into it, and to know which of its nodes others have on their rim
    sides = edges.selectExpr("to_region AS region", "*").unionByName(
        edges.where("from_region <> to_region").selectExpr("from_region AS region", "*")
    )
    return Regions(cut_lineage(sides.groupBy("region").applyInPandas(_pack, _PACKED)), owners)


def _pack(edges: pd.DataFrame) -> pd.DataFrame:
    region = int(edges["region"].iloc[0])
    into = edges[edges["to_region"] == region].sort_values(["to_node", "from_node"])
    out = edges[(edges["from_region"] == region) & (edges["to_region"] != region)][["from_node", "to_region"]].drop_duplicates()
    nodes, first = np.unique(
        np.concatenate([into["from_node"], into["to_node"], out["from_node"]]).astype(np.int64), return_index=True
    )
    owner = np.concatenate([into["from_region"], into["to_region"], np.full(len(out), region)]).astype(np.int64)[first]
    parts = (
        nodes, owner, np.searchsorted(nodes, into["from_node"]), np.searchsorted(nodes, into["to_node"]), into["weight"].to_numpy(np.float64),
        np.searchsorted(nodes, out["from_node"]), out["to_region"].to_numpy(np.int64),
    )
    return pd.DataFrame([(region, *(p.tobytes() for p in parts))], columns=_names(_PACKED))


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _pack_rows(kind: int, region, part: int, columns: dict[str, np.ndarray]) -> pd.DataFrame:
    """Columns of equal length as one row of arrays a region; ``region`` is one number or one a value."""
    if len(columns["source"]) == 0:
        return pd.DataFrame()
    columns = {name: np.ascontiguousarray(c, _KINDS[name]) for name, c in columns.items()}
    if np.ndim(region) == 0:
        return pd.DataFrame([{"kind": kind, "region": int(region), "part": part} | {n: c.tobytes() for n, c in columns.items()}])
    order = np.argsort(region, kind="stable")
    region = np.asarray(region)[order]
    first = np.flatnonzero(np.diff(region, prepend=region[0] - 1))
    rows = [
        {"kind": kind, "region": int(region[a]), "part": part} | {n: c[order[a:b]].tobytes() for n, c in columns.items()}
        for a, b in zip(first, np.append(first[1:], len(region)), strict=True)
    ]
    return pd.DataFrame(rows)


def _unpack_rows(rows: pd.DataFrame, kind: int, *names: str) -> list[np.ndarray]:
    """The arrays of all rows of one kind, end to end."""
    chosen = rows[rows["kind"] == kind]
    return [np.concatenate([np.zeros(0, _KINDS[n]), *(np.frombuffer(b, _KINDS[n]) for b in chosen[n])]) for n in names]


class Region:
    """One packed region and what the sources of a part know of it, a row a source."""

    def __init__(self, packed: pd.DataFrame, rows: pd.DataFrame):
        row = packed.iloc[0]
        self.region, self.part = int(row["region"]), int(rows["part"].iloc[0])
        kinds = {name: np.float64 if name == "weight" else np.int64 for name in _names(_PACKED)[1:]}
        self.nodes, self.owner, self.tail, self.head, self.weight, self.gate, self.gate_to = (
            np.frombuffer(row[name], kind) for name, kind in kinds.items()
        )
        self.own = self.owner == self.region
        known = rows[rows["kind"] == 0]
        [had] = _unpack_rows(known, 0, "source")
        self.sources = np.unique(np.concatenate([had, *_unpack_rows(rows, 1, "source")]))
        shape = (len(self.sources), len(self.nodes))
        self.dist, self.step = np.full(shape, np.inf), np.zeros(shape, np.int32)
        if len(had):
            at = np.searchsorted(self.sources, had)
            self.dist[at] = np.frombuffer(known["d"].iloc[0], np.float64).reshape(len(had), -1)
            self.step[at] = np.frombuffer(known["step"].iloc[0], np.int32).reshape(len(had), -1)

    def at(self, source: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row and column of (source, node) pairs; every node has to be in the region or on its rim, every source known."""
        return np.searchsorted(self.sources, source), np.searchsorted(self.nodes, node)

    def relaxed(self, source, node, d, step) -> np.ndarray:
        """Take in what was sent and relax to a fixpoint; returns which distances got better.

        ``step`` counts the edges of the path a distance was found on. Only sources that got something better are looked at.
        """
        changed = np.zeros(self.dist.shape, bool)
        row, col = self.at(source, node)
        better = d < self.dist[row, col]
        row, col, d, step = row[better], col[better], d[better], step[better]
        some, row = np.unique(row, return_inverse=True)
        before, hops_to = self.dist[some], self.step[some]
        dist = before.copy()
        dist[row, col], hops_to[row, col] = d, step
        fresh = np.zeros(dist.shape, bool)
        fresh[row, col] = True
        while True:
            used = np.flatnonzero(fresh.any(axis=0)[self.tail])
            if len(used) == 0:
                break
            tail, head = self.tail[used], self.head[used]
            offer = np.where(fresh[:, tail], dist[:, tail] + self.weight[used], np.inf)
            first = np.flatnonzero(np.diff(head, prepend=-1))
            best = np.minimum.reduceat(offer, first, axis=1)
            lengths = np.diff(first, append=len(head))
            hops = np.where(offer == np.repeat(best, lengths, axis=1), hops_to[:, tail], np.iinfo(np.int32).max - 1)
            hops = np.minimum.reduceat(hops, first, axis=1) + 1
            to = head[first]
            better = best < dist[:, to]
            fresh[:] = False
            fresh[:, to] = better
            dist[:, to] = np.where(better, best, dist[:, to])
            hops_to[:, to] = np.where(better, hops, hops_to[:, to])
        changed[some] = dist < before
        self.dist[some], self.step[some] = dist, hops_to
        return changed

    def before(self, row: np.ndarray, col: np.ndarray) -> np.ndarray:
        return last_of(self.dist, self.step, row, col, self.tail, self.head, self.weight)


def last_nodes(dist, step, tail, head, weight):
    """The last node before each node, -1 where there is none. Edges are sorted by head, then tail.

    Among the edges that reach the distance exactly, the end with the smaller (distance, node)
    wins, which is the order a priority queue settles them in. Along zero-weight edges distances
    tie; there the smaller step decides, so no path ever closes a circle.
    """
    prev = np.full(dist.shape, -1)
    if len(weight) == 0:
        return prev
    first = np.flatnonzero(np.diff(head, prepend=-1))
    here, there = dist[:, tail], dist[:, head]
    tight = (here + weight == there) & np.isfinite(there) & ((here < there) | (step[:, tail] < step[:, head]))
    near = np.where(tight, here, np.inf)
    nearest = np.repeat(np.minimum.reduceat(near, first, axis=1), np.diff(first, append=len(head)), axis=1)
    chosen = np.minimum.reduceat(np.where(tight & (near == nearest), tail, dist.shape[1]), first, axis=1)
    prev[:, head[first]] = np.where(chosen < dist.shape[1], chosen, -1)
    return prev


def last_of(dist, step, row, col, tail, head, weight) -> np.ndarray:
    """``last_nodes`` of the asked cells (row, col) only."""
    into = np.searchsorted(head, np.arange(dist.shape[1] + 1))
    order = np.argsort(-np.diff(into)[col], kind="stable")
    row, col = row[order], col[order]
    first, edges = into[col], into[col + 1] - into[col]
    there, steps = dist[row, col], step[row, col]
    near, prev = np.full(len(row), np.inf), np.full(len(row), -1)
    for i in range(edges[0] if len(edges) else 0):
        # those with another edge stand in front
        n = np.searchsorted(-edges, -i)
        end = tail[first[:n] + i]
        here = dist[row[:n], end]
        tight = (here + weight[first[:n] + i] == there[:n]) & np.isfinite(there[:n])
        tight &= (here < there[:n]) | (step[row[:n], end] < steps[:n])
        tight &= here < near[:n]
        near[:n][tight], prev[:n][tight] = here[tight], end[tight]
    out = np.empty_like(prev)
    out[order] = prev
    return out


def _search_region(rows: pd.DataFrame, packed: pd.DataFrame) -> Iterator[pd.DataFrame]:
    here = Region(packed, rows)
    sent = _unpack_rows(rows, 1, "source", "node", "d", "step")
    bound, far = _unpack_rows(rows, 3, "source", "d")
    if len(bound):
        limit = np.full(len(here.sources), np.inf)
        known = np.isin(bound, here.sources)
        limit[np.searchsorted(here.sources, bound[known])] = far[known]
        near = sent[2] < limit[np.searchsorted(here.sources, sent[0])]
        sent = [c[near] for c in sent]
    better = here.relaxed(*sent)
    if not better.any():
        return
    yield _pack_rows(0, here.region, here.part, {"source": here.sources}).assign(d=here.dist.tobytes(), step=here.step.tobytes())
    row, gate = np.nonzero(better[:, here.gate])
    col = here.gate[gate]
    reached = {"source": here.sources[row], "node": here.nodes[col], "d": here.dist[row, col], "step": here.step[row, col]}
    yield _pack_rows(1, here.gate_to[gate], here.part, reached)
    source, node = _unpack_rows(rows, 2, "source", "node")
    known = np.isin(source, here.sources)
    row, col = here.at(source[known], node[known])
    row, col = row[better[row, col]], col[better[row, col]]
    yield _pack_rows(2, here.region, here.part, {"source": here.sources[row], "node": here.nodes[col], "d": here.dist[row, col]})


def _in_regions(rows: DataFrame, packed: DataFrame, work, schema: str) -> DataFrame:
    """``work`` on every region and part that has rows, together with the packed region."""
    # columns of their own, as the two sides of a cogroup may share ancestors
    active = rows.select(F.col("region").alias("_region"), F.col("part").alias("_part")).distinct()
    graphs = packed.join(active, F.col("region") == F.col("_region")).select("_part", *[F.col(c).alias(c) for c in _names(_PACKED)])
    names = _names(schema)

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        made = pd.concat([f for f in work(left, right) if len(f)] or [pd.DataFrame(columns=names)])
        made = made.reindex(columns=names)
        whole = [c.split()[0] for c in schema.split(", ") if c.split()[1] in ("int", "bigint")]
        return made.astype(dict.fromkeys(whole, "Int64"))

    return rows.groupBy("region", "part").cogroup(graphs.groupBy("region", "_part")).applyInPandas(run, schema)


@dataclass
class Known:
    """The end of a search: the round in which each part's row of each region was written last (``last``), below ``folder``."""

    graph: Regions
    folder: str
    last: DataFrame


def _filled(rows: DataFrame, schema: str = _ROUND) -> DataFrame:
    given = set(rows.columns)
    return rows.select(*[F.col(n).cast(t).alias(n) if n in given else F.lit(None).cast(t).alias(n) for n, t in (c.split() for c in schema.split(", "))])


def _packed(rows: DataFrame, kind: int, schema: str = _ROUND) -> DataFrame:
    """Rows with a region and a part as one row of arrays of each; a group is bounded by the sources of a part and the nodes of a region."""
    columns = [c for c in rows.columns if c in _KINDS]

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        made = _pack_rows(kind, group["region"].iloc[0], int(group["part"].iloc[0]), {c: group[c].to_numpy() for c in columns})
        return made.reindex(columns=_names(schema))

    return cut_lineage(rows.groupBy("region", "part").applyInPandas(pack, schema))


def _unpacked(rows: DataFrame, kind: int, schema: str) -> DataFrame:
    """The arrays of rows of one kind, a row a value."""
    names = _names(schema)

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame(dict(zip(names, _unpack_rows(batch.assign(kind=kind), kind, *names), strict=True)))

    return rows.select(*names).mapInPandas(unpack, schema)


def _parts(rows: DataFrame, graph: Regions) -> DataFrame:
    """``rows`` whose source lies on the graph, with its ``part``."""
    return rows.join(graph.owners.select(F.col("node").alias("_s"), "part"), F.col("source") == F.col("_s")).drop("_s")


def search(graph: Regions, sources: DataFrame, pairs: DataFrame | None) -> Known:
    """Distances from ``sources`` (source). With ``pairs`` (source, target) a source whose targets on the graph all have a distance
    sends nothing on from beyond the farthest."""
    spark = sources.sparkSession
    folder = work_path(spark, "regions")
    begun = sources.join(graph.owners, F.col("source") == F.col("node"))
    goals = far = None
    if pairs is not None:
        asked = pairs.select("source", F.col("target").alias("node")).distinct().join(graph.owners.select("node", "region"), "node")
        asked = cut_lineage(_parts(asked, graph).select("region", "part", "source", "node"))
        goals = _packed(asked, 2)
        n_goals = cut_lineage(asked.groupBy("part", F.col("source").alias("_s")).agg(F.count("*").alias("n_goals")))
        begun = begun.join(n_goals.select("_s"), F.col("source") == F.col("_s"), "left_semi")
    sent = _packed(begun.select("region", "part", "source", "node", F.lit(0.0).alias("d"), F.lit(0).alias("step")), 1)
    last = spark.createDataFrame([], "region bigint, part bigint, round int")
    step = 0
    while True:
        active = sent.select(F.col("region").alias("_r"), F.col("part").alias("_p")).distinct()
        here = (F.col("region") == F.col("_r")) & (F.col("part") == F.col("_p"))
        active = cut_lineage(active.join(last, here, "left").select("_r", "_p", F.col("round").alias("_round")))
        written = [r._round for r in active.select("_round").distinct().collect()]
        if not written:
            return Known(graph, folder, last)
        rows = sent.unionByName(_states(spark, folder, [r for r in written if r is not None], active))
        if goals is not None:
            rows = rows.unionByName(goals.join(active, here, "left_semi"))
        if far is not None:
            rows = rows.unionByName(_filled(far.join(active, F.col("part") == F.col("_p")).withColumn("region", F.col("_r"))))
        made = _in_regions(rows, graph.packed, _search_region, _ROUND)
        made.write.partitionBy("kind").parquet(f"{folder}/round={step}")
        fresh = _kind(spark, [f"{folder}/round={step}"], 0).select("region", "part", F.lit(step).alias("round"))
        last = cut_lineage(last.unionByName(fresh).groupBy("region", "part").agg(F.max("round").alias("round")))
        sent = _filled(_kind(spark, [f"{folder}/round={step}"], 1).withColumn("kind", F.lit(1)))
        step += 1
        if goals is not None and step % BOUND_EVERY == 0:
            far = _bounds(_kind(spark, [f"{folder}/round={r}" for r in range(step)], 2), n_goals)


def _bounds(reached: DataFrame, n_goals: DataFrame) -> DataFrame:
    """The farthest target of every source whose targets all have a distance, a row of arrays a part."""
    best = _unpacked(reached, 2, "source bigint, node bigint, d double").groupBy("source", "node").agg(F.min("d").alias("d"))
    far = best.groupBy("source").agg(F.count("*").alias("n"), F.max("d").alias("d"))
    far = far.join(n_goals, F.col("source") == F.col("_s")).where("n = n_goals")
    return _packed(far.select(F.lit(0).cast("bigint").alias("region"), "part", "source", "d"), 3)


def _kind(spark, folders: list[str], kind: int) -> DataFrame:
    """Rows of one kind; a round need not have any."""
    schema = ", ".join(_ROUND.split(", ")[1:])
    rows = spark.read.schema(f"{schema}, round int, kind int").option("basePath", folders[0].rsplit("/", 1)[0]).parquet(*folders)
    return rows.where(F.col("kind") == kind).drop("kind")


def _states(spark, folder: str, rounds: list[int], active: DataFrame) -> DataFrame:
    """What parts know of regions (_r, _p), from the round (_round) that wrote it last; only those rounds are read."""
    if not rounds:
        return spark.createDataFrame([], _ROUND)
    here = (F.col("region") == F.col("_r")) & (F.col("part") == F.col("_p")) & (F.col("round") == F.col("_round"))
    every = _kind(spark, [f"{folder}/round={r}" for r in sorted(rounds)], 0)
    return _filled(every.join(active.where("_round IS NOT NULL"), here, "left_semi").withColumn("kind", F.lit(0)))


def _known(known: Known, wanted: DataFrame | None) -> DataFrame:
    """The rows of a search, of the (region, part) in ``wanted`` only if it is given."""
    spark = known.last.sparkSession
    active = known.last.select(F.col("region").alias("_r"), F.col("part").alias("_p"), F.col("round").alias("_round"))
    if wanted is not None:
        active = active.join(wanted.select("region", "part").distinct(), (F.col("region") == F.col("_r")) & (F.col("part") == F.col("_p")), "left_semi")
    active = cut_lineage(active)
    return _states(spark, known.folder, [r._round for r in active.select("_round").distinct().collect()], active)


def found(known: Known, pairs: DataFrame | None) -> DataFrame:
    """(source, node, d, step, prev) of the asked nodes, or of all that were reached."""
    wanted = pairs is not None
    asked = None
    if wanted:
        asked = pairs.select("source", F.col("target").alias("node")).distinct().join(known.graph.owners.select("node", "region"), "node")
        asked = _packed(_parts(asked, known.graph).select("region", "part", "source", "node"), 2)
    rows = _known(known, asked)
    if wanted:
        # a region that the sources of a part never reached has no row of it
        rows = rows.unionByName(asked)

    def unpack(rows: pd.DataFrame, packed: pd.DataFrame) -> Iterator[pd.DataFrame]:
        here = Region(packed, rows)
        if wanted:
            source, node = _unpack_rows(rows, 2, "source", "node")
            there = np.isin(source, here.sources)
            row, col = here.at(source[there], node[there])
        else:
            row, col = np.nonzero(np.isfinite(here.dist) & here.own)
        reached = np.isfinite(here.dist[row, col])
        row, col = row[reached], col[reached]
        prev = here.before(row, col)
        none = prev < 0
        prev = pd.array(np.where(none, 0, here.nodes[prev]), "Int64").copy()
        prev[none] = pd.NA
        yield pd.DataFrame(
            {"source": here.sources[row], "node": here.nodes[col], "d": here.dist[row, col], "step": here.step[row, col], "prev": prev}
        )

    return _in_regions(rows, known.graph.packed, unpack, _FOUND)


def _walk_region(rows: pd.DataFrame, packed: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Walk the asked paths back until their source or the rim; there the next region takes over (kind 1)."""
    here = Region(packed, rows[rows["kind"] == 0] if (rows["kind"] == 0).any() else rows)
    source, target, node, back = (c.copy() for c in _unpack_rows(rows, 1, "source", "target", "node", "back"))
    row, at = here.at(source, node)
    alive = np.flatnonzero(np.isin(source, here.sources))
    alive = alive[np.isfinite(here.dist[row[alive], at[alive]])]
    steps: list[tuple[np.ndarray, ...]] = []
    while len(alive):
        inside = here.own[at[alive]]
        out, alive = alive[~inside], alive[inside]
        steps.append((out, here.owner[at[out]], here.nodes[at[out]], back[out], np.ones(len(out), bool)))
        steps.append((alive, here.owner[at[alive]], here.nodes[at[alive]], back[alive], np.zeros(len(alive), bool)))
        up = here.before(row[alive], at[alive])
        alive, up = alive[up >= 0], up[up >= 0]
        at[alive] = up
        back[alive] += 1
    if not steps:
        return
    path, region, node, back, out = (np.concatenate(c) for c in zip(*steps, strict=True))
    columns = {"source": source[path], "target": target[path], "node": node, "back": back}
    yield _pack_rows(0, here.region, here.part, {n: c[~out] for n, c in columns.items()})
    yield _pack_rows(1, region[out], here.part, {n: c[out] for n, c in columns.items()})


def walked(known: Known, pairs: DataFrame) -> DataFrame:
    """(source, target, back, node): the nodes of each path, ``back`` counted from the target."""
    spark = pairs.sparkSession
    folder = work_path(spark, "walks")
    asked = pairs.select("source", "target").distinct().join(known.graph.owners.select("node", "region"), F.col("target") == F.col("node"))
    asked = _packed(_parts(asked, known.graph).select("region", "part", "source", "target", "node", F.lit(0).alias("back")), 1, _WALK)
    every = f"{_WALK}, d binary, step binary"
    step = 0
    while step == 0 or not asked.isEmpty():
        rows = _filled(_known(known, asked), every).unionByName(_filled(asked, every))
        made = _in_regions(rows, known.graph.packed, _walk_region, _WALK)
        made.write.partitionBy("kind").parquet(f"{folder}/round={step}")
        rounds = spark.read.schema(", ".join(_WALK.split(", ")[1:]) + ", round int, kind int").option("basePath", folder)
        asked = rounds.parquet(f"{folder}/round={step}").where("kind = 1").select(*_names(_WALK))
        step += 1
    return _unpacked(rounds.parquet(*[f"{folder}/round={r}" for r in range(step)]).where("kind = 0"), 0, _PATHS)
