"""Shortest paths on a directed, weighted multigraph, many sources at once.

Sources are spread over the cluster. An edge table that was counted and found small (a city) is
broadcast, and every task relaxes whole blocks of sources against it with array operations, so the
search is one job without a shuffle. Beyond that size the graph is cut into regions (see ``road_regions``) that
exchange the distances at their rims. Sums always run forward from the source, so both ways give
the distances of a textbook search bit for bit.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from frota.operators import road_regions
from frota.operators.road_regions import REGION_NODES, Regions, last_of
from frota.session import broadcast_limit, cut_lineage, shuffle_width

_EDGE_BYTES = 48
_BLOCK_CELLS = 4_000_000
#: Hops around the sources of a block that a search for given targets looks at first, and how many times more if that is not enough.
_HOPS, _WIDER = 8, 2
#: Sources of a block at most, and nodes of a neighbourhood, whose sources are searched for together.
_BLOCK = 64
#: Parts of a one-way graph at most that have a bit for each other.
_PARTS = 4096
#: Rounds after which a search for given targets looks anew how far it still has to go.
_FAR_EVERY = 4
_PATH = "source bigint, target bigint, pos int, node bigint"
_FOUND = "source bigint, node bigint, d double, step int, prev bigint"


def relax_edges(edges: DataFrame) -> DataFrame:
    """Smallest weight per (from, to): what distances use. Self loops never shorten a path."""
    return (
        edges.where("from_node <> to_node")
        .groupBy("from_node", "to_node")
        .agg(F.min("weight").alias("weight"))
    )


def tagged_edges(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """``edges`` with ``motivo``, the reason why no search may use one (null: it may)."""
    weightless = F.col("weight").isNull() | F.isnan("weight") | (F.col("weight") < 0)
    reason = F.when(weightless, "PESO")
    if nodes is not None:
        ids = nodes.select("node_id", F.lit(True).alias("_known")).distinct()
        edges = edges.join(ids.withColumnsRenamed({"node_id": "from_node", "_known": "_from"}), "from_node", "left").join(
            ids.withColumnsRenamed({"node_id": "to_node", "_known": "_to"}), "to_node", "left"
        )
        reason = reason.when(F.col("_from").isNull() | F.col("_to").isNull(), "NO_DESCONHECIDO")
    return edges.withColumn("motivo", reason).drop("_from", "_to")


def first_edges(edges: DataFrame) -> DataFrame:
    """Weight of the first listed edge per (from, to): what a formatted route shows."""
    return edges.groupBy("from_node", "to_node").agg(F.min_by("weight", "edge_seq").alias("weight"))


@dataclass
class Roads:
    """An edge table made ready for searches: ``light`` holds the smallest weight per pair of nodes,
    ``shared`` the same as broadcast arrays if it was counted and found small, else ``cut`` its regions; ``rejected``
    the edges that no search may use, with the reason."""

    edges: DataFrame
    light: DataFrame
    shared: Broadcast | None
    rejected: DataFrame
    cut: Regions | None = None


def roads(edges: DataFrame, nodes: DataFrame | None = None, share: bool = True, region_nodes: int = REGION_NODES) -> Roads:
    """Edges with a negative, NaN or missing weight are rejected: a search over them would not end or
    would hide good edges. With ``nodes`` (node_id) so are edges with an unknown end. ``share=False``
    cuts the graph into regions whatever its size."""
    tagged = tagged_edges(edges, nodes)
    columns = ["edge_seq", "from_node", "to_node", "weight"]
    edges = cut_lineage(tagged.where("motivo IS NULL").select(*columns))
    rejected = tagged.where("motivo IS NOT NULL").select(*columns, "motivo")
    light = cut_lineage(relax_edges(edges))
    spark = edges.sparkSession
    if not share or light.count() * _EDGE_BYTES > broadcast_limit(spark):
        return Roads(edges, light, None, rejected, road_regions.regions(light, nodes, region_nodes))
    graph = light.toPandas().sort_values(["to_node", "from_node"])
    nodes = np.unique(graph[["from_node", "to_node"]].to_numpy())
    tail = np.searchsorted(nodes, graph["from_node"].to_numpy())
    head = np.searchsorted(nodes, graph["to_node"].to_numpy())
    near_by, reach = neighbourhoods(len(nodes), tail, head), reach_of(len(nodes), tail, head)
    shared = (nodes, tail, head, graph["weight"].to_numpy(), near_by, reach)
    return Roads(edges, light, spark.sparkContext.broadcast(shared), rejected)


def reach_of(n: int, tail: np.ndarray, head: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """(part, bits) for ``may_reach``. Nodes that reach each other form a part; parts are numbered after those they lead to, and if they
    are few, every part has a bit for each part it reaches."""
    part = _mutual(n, tail, head)
    k = int(part.max(initial=-1)) + 1
    if k > _PARTS:
        return part, None
    bits = np.zeros((k, -(-k // 8)), np.uint8)
    bits[np.arange(k), np.arange(k) // 8] = 128 >> (np.arange(k) % 8)
    apart = part[tail] != part[head]
    for a, b in np.unique(np.stack([part[tail[apart]], part[head[apart]]]), axis=1).T:
        bits[a] |= bits[b]
    return part, bits


def may_reach(reach: tuple, source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Whether there may be a path; if parts are few, whether there is one."""
    part, bits = reach
    a, b = part[source], part[target]
    return b <= a if bits is None else bits[a, b // 8] & (128 >> (b % 8)) > 0


def _mutual(n: int, tail: np.ndarray, head: np.ndarray) -> np.ndarray:
    """The strongly connected part of every node, numbered after the parts it leads to (Tarjan, without recursion)."""
    order = np.argsort(tail, kind="stable")
    begin, out = np.searchsorted(tail[order], np.arange(n + 1)).tolist(), head[order].tolist()
    at, low, part, open_, met, parts = begin[:-1], [0] * n, [-1] * n, [], 0, 0
    seen = [0] * n
    for first in range(n):
        if seen[first]:
            continue
        met += 1
        seen[first] = low[first] = met
        walk = [first]
        open_.append(first)
        while walk:
            node = walk[-1]
            if at[node] < begin[node + 1]:
                other = out[at[node]]
                at[node] += 1
                if not seen[other]:
                    met += 1
                    seen[other] = low[other] = met
                    walk.append(other)
                    open_.append(other)
                elif part[other] < 0:
                    low[node] = min(low[node], seen[other])
                continue
            walk.pop()
            if walk:
                low[walk[-1]] = min(low[walk[-1]], low[node])
            if low[node] == seen[node]:
                while part[node] < 0:
                    part[open_.pop()] = parts
                parts += 1
    return np.array(part, np.int64)


def neighbourhoods(n: int, tail: np.ndarray, head: np.ndarray, size: int = _BLOCK) -> np.ndarray:
    """A neighbourhood for each of ``n`` nodes: ``size`` nodes that edges join, grown one beside the other; what a growth leaves
    between others goes to the next."""
    ends, others = np.concatenate([tail, head]), np.concatenate([head, tail])
    order = np.argsort(ends, kind="stable")
    begin, others = np.searchsorted(ends[order], np.arange(n + 1)).tolist(), others[order].tolist()
    place, placed = [-1] * n, 0
    for first in range(n):
        beside = [first]
        while beside:
            seed = beside.pop()
            if place[seed] >= 0:
                continue
            place[seed], grown, at, full = placed, [seed], 0, placed - placed % size + size
            placed += 1
            while at < len(grown):
                node = grown[at]
                at += 1
                for other in others[begin[node] : begin[node + 1]]:
                    if place[other] < 0:
                        if placed < full:
                            place[other] = placed
                            placed += 1
                            grown.append(other)
                        else:
                            beside.append(other)
    return np.array(place, np.int64) // size


def distances(graph: Roads, pairs: DataFrame | None = None, sources: DataFrame | None = None) -> DataFrame:
    """(source, node, d, step, prev): distances from each source.

    ``sources`` (source) asks for everything reachable. ``pairs`` (source, target) asks for these targets
    and only they are returned; a source stops spreading beyond its farthest target once all are reached.
    ``step`` is the round in which ``d`` was found, ``prev`` the last node before ``node`` on the path
    (see ``road_regions.last_of``).
    """
    if graph.shared is not None:
        return _search_blocks(graph.shared, _by_source(pairs, sources), "ends")
    sources = (sources if pairs is None else pairs).select("source").distinct()
    found = road_regions.found(road_regions.search(graph.cut, sources, pairs), pairs)
    # a source that no edge touches reaches itself
    alone = _off_graph(graph, sources)
    if pairs is not None:
        alone = alone.join(pairs.where("source = target").selectExpr("source AS asked").distinct(), F.col("source") == F.col("asked"), "left_semi")
    return found.unionByName(alone.selectExpr("source", "source AS node", "0D AS d", "0 AS step", "CAST(NULL AS BIGINT) AS prev"))


def _off_graph(graph: Roads, sources: DataFrame) -> DataFrame:
    return sources.join(graph.cut.owners, F.col("source") == F.col("node"), "left_anti").select("source")


def _by_source(pairs: DataFrame | None, sources: DataFrame | None) -> DataFrame:
    if pairs is None:
        return sources.selectExpr("source", "CAST(NULL AS ARRAY<BIGINT>) AS targets").distinct()
    # only for a broadcast graph: at most one entry per node of it, and foreign targets
    return pairs.groupBy("source").agg(F.collect_set("target").alias("targets"))


def _search_blocks(shared: Broadcast, wanted: DataFrame, answer: str) -> DataFrame:
    """Every task searches blocks of its sources against the broadcast edges. ``answer`` "ends": the asked
    nodes (all, if none are asked for); "paths": the nodes of each asked path, walked back in the task."""

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        nodes, tail, head, weight, _, reach = shared.value
        for batch in batches:
            on_graph = np.isin(batch["source"].to_numpy(), nodes)
            off = batch[~on_graph]
            alone = off["source"].to_numpy()[[t is None or s in t for s, t in zip(off["source"], off["targets"], strict=True)]]
            if answer == "paths":
                yield pd.DataFrame({"source": alone, "target": alone, "pos": np.zeros(len(alone), np.int32), "node": alone})
            else:
                yield _rows(alone, alone, 0.0, 0, np.full(len(alone), -1))
            batch = batch[on_graph].sort_values(["near_by", "source"])
            for source, targets, near, dist, step, edges in _searched(batch, nodes, tail, head, weight, reach):
                if answer == "paths":
                    yield from _walk_back(source, targets, near, dist, step, edges)
                    continue
                if any(goals is None for goals in targets):
                    row, col = np.nonzero(np.isfinite(dist))
                else:
                    row, goal = _goals(targets)
                    col, known = _placed(near, goal)
                    row, col = row[known], col[known]
                    known = np.isfinite(dist[row, col])
                    row, col = row[known], col[known]
                prev = last_of(dist, step, row, col, *edges)
                prev = np.where(prev < 0, -1, near[prev])
                yield _rows(source[row], near[col], dist[row, col], step[row, col], prev)

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        nodes, _, _, _, near_by, _ = shared.value
        for batch in batches:
            at, known = _placed(nodes, batch["source"].to_numpy(np.int64))
            yield batch.assign(near_by=np.where(known, near_by[at], -1 - batch["source"].to_numpy() % 1024) if len(nodes) else -1)

    # sources that lie beside each other go to one task and are searched for together
    spread = wanted.mapInPandas(placed, "source bigint, targets array<bigint>, near_by bigint")
    spread = spread.repartitionByRange(2 * shuffle_width(wanted.sparkSession), "near_by").sortWithinPartitions("near_by", "source")
    return spread.mapInPandas(search, _FOUND if answer == "ends" else _PATH)


def _placed(nodes: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each of ``node`` stands in the sorted ``nodes``, and whether it does."""
    at = np.minimum(np.searchsorted(nodes, node), max(len(nodes) - 1, 0))
    return at, (nodes[at] == node if len(nodes) else np.zeros(len(node), bool))


def _goals(targets: list) -> tuple[np.ndarray, np.ndarray]:
    """(row, target) of the different targets of every source."""
    row = np.repeat(np.arange(len(targets)), [len(t) for t in targets])
    goal = np.concatenate([np.zeros(0, np.int64), *(np.asarray(t, np.int64) for t in targets)])
    order = np.lexsort((goal, row))
    row, goal = row[order], goal[order]
    one = np.ones(len(row), bool)
    one[1:] = (np.diff(row) != 0) | (np.diff(goal) != 0)
    return row[one], goal[one]


def _searched(batch: pd.DataFrame, nodes, tail, head, weight, reach: tuple | None = None) -> Iterator[tuple]:
    """Blocks of the sources of ``batch`` with (source, targets, nodes, dist, step, edges), over the nodes and edges they had to look at.

    A search for given targets looks at the nodes within some hops of its block. Whatever lies beyond is no nearer than the
    nearest node with an edge that leads out, so a target nearer than that has its distance and its path; sources with others look farther.
    """
    size = max(1, min(_BLOCK, _BLOCK_CELLS // max(len(nodes), 1)))
    sources, targets = batch["source"].to_numpy(np.int64), list(batch["targets"])
    if any(t is None for t in targets):
        for start in range(0, len(sources), size):
            source, asked = sources[start : start + size], targets[start : start + size]
            yield source, asked, nodes, *relax_block(source, asked, nodes, tail, head, weight), (tail, head, weight)
        return
    # no search finds a target that no edge touches
    targets = [t[_placed(nodes, t)[1]] for t in (np.asarray(t, np.int64) for t in targets)]
    if reach is not None:
        # nor one that no street leads to, however far it looks
        targets = [t[may_reach(reach, s, np.searchsorted(nodes, t))] for s, t in zip(np.searchsorted(nodes, sources), targets, strict=True)]
    by_tail = np.argsort(tail, kind="stable")
    begin = np.searchsorted(tail[by_tail], np.arange(len(nodes) + 1))
    seen = np.zeros(len(nodes), bool)
    left, hops = np.flatnonzero([len(t) > 0 for t in targets]), _HOPS
    # neighbours go together, if it is known who they are
    beside = batch["near_by"].to_numpy() if "near_by" in batch else np.zeros(len(batch), np.int64)
    while len(left):
        again = []
        # the farther they look, the more neighbourhoods look together
        cuts = np.flatnonzero(np.diff(beside[left] // (hops // _HOPS))) + 1
        for block in np.split(left, cuts):
            # as many at once as fit the cells, once it is known how many nodes lie around them
            waiting = [block[i : i + _BLOCK] for i in range(0, len(block), _BLOCK)]
            while waiting:
                block = waiting.pop()
                ball = _around(np.searchsorted(nodes, sources[block]), hops, by_tail, begin, head, seen)
                out = _out_edges(ball, by_tail, begin)
                seen[ball] = True
                inside = seen[head[out]]
                seen[ball] = False
                edges = np.sort(out[inside])
                if len(block) > 1 and len(block) * len(ball) > _BLOCK_CELLS:
                    waiting += [block[: len(block) // 2], block[len(block) // 2 :]]
                    continue
                rim = np.unique(np.searchsorted(ball, tail[out[~inside]]))
                local = np.searchsorted(ball, tail[edges]), np.searchsorted(ball, head[edges]), weight[edges]
                asked = [targets[i] for i in block]
                dist, step = relax_block(sources[block], asked, nodes[ball], *local)
                limit = dist[:, rim].min(axis=1, initial=np.inf)
                row, goal = _goals(asked)
                col, held = _placed(nodes[ball], goal)
                far = np.zeros(len(block))
                np.maximum.at(far, row, np.where(held, dist[row, col], np.inf))
                done = np.isinf(limit) | (far < limit)
                again.append(block[~done])
                some = np.flatnonzero(done)
                if len(some):
                    yield sources[block[some]], [asked[i] for i in some], nodes[ball], dist[some], step[some], local
        left, hops = np.sort(np.concatenate(again)), hops * _WIDER


def _out_edges(ball, by_tail, begin) -> np.ndarray:
    """The edges that leave the nodes of ``ball``; ``by_tail`` lists all edges by tail, ``begin`` where each node's begin."""
    counts = begin[ball + 1] - begin[ball]
    ahead = np.repeat(begin[ball] - (np.cumsum(counts) - counts), counts)
    return by_tail[ahead + np.arange(counts.sum())]


def _around(start, hops: int, by_tail, begin, head, seen) -> np.ndarray:
    """The nodes within ``hops`` edges, in order. ``seen`` is scratch, all false before and after."""
    front = np.unique(start)
    parts = [front]
    seen[front] = True
    for _ in range(hops):
        front = np.unique(head[_out_edges(front, by_tail, begin)])
        front = front[~seen[front]]
        if len(front) == 0:
            break
        seen[front] = True
        parts.append(front)
    ball = np.sort(np.concatenate(parts))
    seen[ball] = False
    return ball


def _walk_back(source, targets, nodes, dist, step, edges) -> Iterator[pd.DataFrame]:
    """Path rows of every reached target, one hop of all paths at a time."""
    row, goal = _goals(targets)
    goal, known = _placed(nodes, goal)
    row, goal = row[known], goal[known]
    reached = np.isfinite(dist[row, goal])
    row, goal = row[reached], goal[reached]
    at, back, parts = goal.copy(), 0, []
    alive = np.arange(len(row))
    while len(alive):
        parts.append((alive, at[alive], np.full(len(alive), back)))
        up = last_of(dist, step, row[alive], at[alive], *edges)
        alive, up = alive[up >= 0], up[up >= 0]
        at[alive], back = up, back + 1
    if not parts:
        return
    path, node, back_ = (np.concatenate(c) for c in zip(*parts, strict=True))
    length = np.zeros(len(row), np.int64)
    np.maximum.at(length, path, back_)
    yield pd.DataFrame(
        {"source": source[row[path]], "target": nodes[goal[path]], "pos": (length[path] - back_).astype(np.int32), "node": nodes[node]}
    )


def _rows(source, node, d, step, prev) -> pd.DataFrame:
    rows = pd.DataFrame({"source": source, "node": node, "d": d, "step": step, "prev": pd.array(prev, dtype="Int64")})
    rows.loc[rows["prev"] < 0, "prev"] = pd.NA
    return rows


def relax_block(source, targets, nodes, tail, head, weight):
    """Distances and rounds, one row per source and one column per node.

    Edges are sorted by head. A round looks at the nodes that an edge joins to one that got nearer to a source in the last round, for all
    sources of the block at once; the distances of a node to all sources lie side by side.
    """
    n, width = len(nodes), len(source)
    dist, step = np.full((n, width), np.inf), np.zeros((n, width), np.int32)
    start = np.searchsorted(nodes, source)
    dist[start, np.arange(width)] = 0.0
    into = np.searchsorted(head, np.arange(n + 1))
    degree = np.diff(into)
    by_tail = np.argsort(tail, kind="stable")
    out, begin = head[by_tail], np.searchsorted(tail[by_tail], np.arange(n + 1))
    goals = None
    if all(t is not None for t in targets):
        row, goal = _goals(targets)
        col, known = _placed(nodes, goal)
        # a source with a target that is not among the nodes looks at all of them
        lost = np.bincount(row[~known], minlength=width) > 0
        goals = row[known], col[known], lost
    stamp = np.zeros(n, np.int64)
    front, done, far = np.unique(start), 0, None
    while len(front):
        done += 1
        counts = begin[front + 1] - begin[front]
        reached = out[np.repeat(begin[front] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())]
        # each once
        turn = np.arange(len(reached))
        stamp[reached] = turn
        to = reached[stamp[reached] == turn]
        if len(to) == 0:
            break
        # those with more edges first, so the next edge of each is a leading part
        to = to[np.argsort(-degree[to], kind="stable")]
        edges, first = degree[to], into[to]
        best = dist[tail[first]]
        best += weight[first, None]
        for i in range(1, edges[0]):
            some = first[: np.searchsorted(-edges, -i)] + i
            offer = dist[tail[some]]
            offer += weight[some, None]
            np.minimum(best[: len(some)], offer, out=best[: len(some)])
        better = best < dist[to]
        if far is not None:
            better &= best < far
        place, col = np.nonzero(better)
        at = to[place]
        dist[at, col] = best[place, col]
        step[at, col] = done
        front = to[better.any(axis=1)]
        if goals is not None and done % _FAR_EVERY == 0:
            row, goal, lost = goals
            far = np.zeros(width)
            np.maximum.at(far, row, dist[goal, row])
            # as far as the farthest target itself, from there on nothing matters
            far = np.where(lost, np.inf, np.nextafter(far, np.inf))
    return dist.T, step.T


def paths(graph: Roads, pairs: DataFrame) -> DataFrame:
    """(source, target, pos, node): the nodes of each asked path, pos 0 at the source.

    Unreachable pairs have no rows; source = target has one. Over a broadcast graph the search itself walks
    back from the targets, over regions the walk goes from region to region.
    """
    wanted = cut_lineage(pairs.select("source", "target").distinct())
    if graph.shared is not None:
        return _search_blocks(graph.shared, _by_source(wanted, None), "paths")
    sources = wanted.select("source").distinct()
    walk = road_regions.walked(road_regions.search(graph.cut, sources, wanted), wanted)
    alone = _off_graph(graph, wanted.where("source = target").select("source").distinct())
    return walk.unionByName(alone.selectExpr("source", "source AS target", "0 AS back", "source AS node")).selectExpr(
        "source",
        "target",
        "CAST(max(back) OVER (PARTITION BY source, target) - back AS INT) AS pos",
        "node",
    )


def unreachable(pairs: DataFrame, found: DataFrame) -> DataFrame:
    return pairs.select("source", "target").distinct().join(
        found.selectExpr("source", "node AS target"), ["source", "target"], "left_anti"
    )
