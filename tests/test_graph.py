import heapq
import random

import pytest

from frota.operators import graph, routes
from frota.session import cut_lineage

EDGE = "edge_seq bigint, from_node bigint, to_node bigint, weight double"


def search(edges, source):
    """Textbook priority-queue search, the yardstick."""
    out = {}
    for _, u, v, w in edges:
        out.setdefault(u, []).append((v, w))
    dist, prev, heap = {source: 0.0}, {}, [(0.0, source)]
    while heap:
        d, u = heapq.heappop(heap)
        if d > dist[u]:
            continue
        for v, w in out.get(u, []):
            if d + w < dist.get(v, float("inf")):
                dist[v], prev[v] = d + w, u
                heapq.heappush(heap, (d + w, v))
    return dist, prev


def random_edges(seed, nodes=14, n=60):
    rng = random.Random(seed)
    weights = [1.0, 2.0, 3.0, 0.1, 0.7]
    return [(i, rng.randrange(nodes), rng.randrange(nodes), rng.choice(weights)) for i in range(n)]


@pytest.mark.parametrize("limit, region", [("67108864", 4), ("0", 4), ("0", 100)])
def test_distances_predecessors_and_paths_match_search(spark, limit, region):
    """Fractional and tied weights, parallel edges, self loops; broadcast search, and small regions or one."""
    edges = random_edges(5, nodes=9, n=30)
    spark.conf.set("spark.frota.broadcastLimitBytes", limit)
    try:
        ready = graph.roads(spark.createDataFrame(edges, EDGE), region_nodes=region)
        pairs = spark.createDataFrame([(s, t) for s in range(4) for t in range(9)], "source bigint, target bigint")
        sources = pairs.select("source").distinct()
        found = cut_lineage(graph.distances(ready, sources=sources))
        walked = graph.paths(ready, pairs).collect()
    finally:
        spark.conf.unset("spark.frota.broadcastLimitBytes")
    want = {s: search(edges, s) for s in range(4)}
    assert {(r.source, r.node): r.d for r in found.collect()} == {
        (s, n): d for s, (dist, _) in want.items() for n, d in dist.items()
    }
    assert {(r.source, r.node): r.prev for r in found.where("prev IS NOT NULL").collect()} == {
        (s, n): p for s, (_, prev) in want.items() for n, p in prev.items()
    }
    got = {}
    for r in sorted(walked, key=lambda r: r.pos):
        got.setdefault((r.source, r.target), []).append(r.node)
    for s, (dist, prev) in want.items():
        for t in range(9):
            if t not in dist:
                assert (s, t) not in got
                continue
            path = [t]
            while path[-1] != s:
                path.append(prev[path[-1]])
            assert got[(s, t)] == path[::-1]


@pytest.mark.parametrize("limit", ["67108864", "0"])
def test_bounded_search_is_exact_for_its_targets(spark, limit):
    edges = random_edges(9, nodes=8, n=20)
    asked = [(s, (s * 3 + 1) % 8) for s in range(4)] + [(1, 99), (50, 50), (50, 1)]
    spark.conf.set("spark.frota.broadcastLimitBytes", limit)
    try:
        ready = graph.roads(spark.createDataFrame(edges, EDGE), region_nodes=3)
        found = graph.distances(ready, pairs=spark.createDataFrame(asked, "source bigint, target bigint"))
        got = {(r.source, r.node): r.d for r in found.collect()}
    finally:
        spark.conf.unset("spark.frota.broadcastLimitBytes")
    for s, t in asked:
        assert got.get((s, t)) == search(edges, s)[0].get(t)


@pytest.mark.parametrize("share", [True, False])
def test_zero_weight_edges_never_close_a_circle(spark, share):
    edges = [(0, 1, 2, 1.0), (1, 2, 3, 0.0), (2, 3, 2, 0.0), (3, 3, 4, 0.0), (4, 4, 3, 0.0), (5, 4, 5, 2.0), (6, 2, 2, 0.0)]
    ready = graph.roads(spark.createDataFrame(edges, EDGE), share=share, region_nodes=2)
    pairs = spark.createDataFrame([(1, 5)], "source bigint, target bigint")
    found = cut_lineage(graph.distances(ready, pairs=pairs))
    path = graph.paths(ready, pairs).orderBy("pos").collect()
    assert [r.node for r in path] == [1, 2, 3, 4, 5]


def test_route_shows_first_listed_edge_distance_uses_smallest(spark):
    edges = spark.createDataFrame([(0, 1, 2, 9.0), (1, 1, 2, 4.0), (2, 2, 3, 1.0)], EDGE)
    nodes = spark.createDataFrame([(i, i, float(i), -float(i)) for i in (1, 2, 3)], "node_id bigint, node_pos bigint, lat double, lon double")
    ready = graph.roads(edges)
    pairs = spark.createDataFrame([(1, 3), (2, 2)], "source bigint, target bigint")
    found = cut_lineage(graph.distances(ready, pairs=pairs))
    hops = routes.route_hops(graph.paths(ready, pairs), nodes, edges)
    assert found.where("source = 1 AND node = 3").first().d == 5.0
    [route] = routes.as_routes(hops).collect()
    assert [h["weight"] for h in route.rota] == [9.0, 1.0]
    assert route.rota[0]["from"]["lat"] == 1.0 and route.rota[1]["to"]["lon"] == -3.0


def test_bad_weights_neither_hang_nor_hide_good_edges(spark):
    """A negative circle would never end; the least of a NaN and a number would be NaN."""
    nan = float("nan")
    edges = spark.createDataFrame([(0, 1, 2, 1.0), (1, 2, 1, -3.0), (2, 1, 3, nan), (3, 1, 3, 2.0), (4, 3, 4, None), (5, 3, 77, 1.0)], EDGE)
    nodes = spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "node_id bigint")
    for share in (True, False):
        ready = graph.roads(edges, nodes, share)
        found = graph.distances(ready, sources=spark.createDataFrame([(1,)], "source bigint"))
        assert {r.node: r.d for r in found.collect()} == {1: 0.0, 2: 1.0, 3: 2.0}
        assert {(r.edge_seq, r.motivo) for r in ready.rejected.collect()} == {
            (1, "PESO"), (2, "PESO"), (4, "PESO"), (5, "NO_DESCONHECIDO")
        }


def test_search_returns_only_what_was_asked(spark):
    edges = spark.createDataFrame([(i, i, i + 1, 1.0) for i in range(30)], EDGE)
    pairs = spark.createDataFrame([(0, 20), (5, 5), (3, 1)], "source bigint, target bigint")
    for share in (True, False):
        found = graph.distances(graph.roads(edges, share=share), pairs=pairs)
        assert {(r.source, r.node, r.d) for r in found.collect()} == {(0, 20, 20.0), (5, 5, 0.0)}


def test_regions_exchange_rims_only_and_rounds_follow_regions_not_hops(spark, monkeypatch):
    """A street of 60 crossings in regions of 10: six regions, so a handful of rounds, each over one region."""
    from frota.operators import road_regions

    rounds = []
    plain = road_regions._in_regions
    monkeypatch.setattr(road_regions, "_in_regions", lambda rows, *a: (rounds.append(rows.where("kind = 1").count()), plain(rows, *a))[1])
    edges = spark.createDataFrame([(i, i, i + 1, 1.0) for i in range(59)], EDGE)
    ready = graph.roads(edges, share=False, region_nodes=10)
    pairs = spark.createDataFrame([(0, 59)], "source bigint, target bigint")
    path = graph.paths(ready, pairs).orderBy("pos").collect()
    assert [r.node for r in path] == list(range(60))
    # one distance sent a round, forth and back
    assert len(rounds) <= 13 and max(rounds) == 1


def test_a_round_over_regions_handles_a_row_a_part_not_a_source(spark, monkeypatch):
    """30 sources of one street are one part, so what a region hears for them is one row; a target off the graph does not
    make its source look at the whole street."""
    from frota.operators import road_regions

    rounds = []
    plain = road_regions._in_regions
    monkeypatch.setattr(road_regions, "_in_regions", lambda rows, *a: (rounds.append(rows.where("kind = 1").count()), plain(rows, *a))[1])
    edges = spark.createDataFrame([(i * 2 + j, i + j, i + 1 - j, 1.0) for i in range(199) for j in (0, 1)], EDGE)
    ready = graph.roads(edges, share=False, region_nodes=10)
    pairs = spark.createDataFrame([(s, t) for s in range(30) for t in (s + 1, 9999)], "source bigint, target bigint")
    found = graph.distances(ready, pairs=pairs)
    assert {(r.source, r.node, r.d) for r in found.collect()} == {(s, s + 1, 1.0) for s in range(30)}
    # a region hears from two neighbours at most, and the end of the street is never reached
    assert max(rounds) <= 12 and len(rounds) <= 12


def _arrays(edges):
    import numpy as np

    light = {}
    for _, u, v, w in edges:
        if u != v:
            light[u, v] = min(w, light.get((u, v), w))
    listed = sorted((v, u, w) for (u, v), w in light.items())
    nodes = np.unique([[v, u] for v, u, _ in listed])
    return nodes, np.searchsorted(nodes, [u for _, u, _ in listed]), np.searchsorted(nodes, [v for v, _, _ in listed]), np.array([w for _, _, w in listed])


def test_search_for_near_targets_looks_near_its_sources_only():
    import pandas as pd

    nodes, *edges = _arrays([(0, i + j, i + 1 - j, 1.0 + i % 3) for i in range(5000) for j in (0, 1)])
    batch = pd.DataFrame({"source": [10, 2500, 4000], "targets": [[12, 10], [2501, 99999], [4003]]})
    blocks = list(graph._searched(batch, nodes, *edges))
    assert sum(len(near) for _, _, near, *_ in blocks) < 300
    got = {(s, n): d for source, _, near, dist, _, _ in blocks for i, s in enumerate(source) for n, d in zip(near, dist[i])}
    assert [got[10, 12], got[2500, 2501], got[4000, 4003]] == [5.0, 2.0, 6.0]


@pytest.mark.parametrize("seed", range(6))
def test_search_near_its_sources_agrees_with_the_whole_graph(seed, monkeypatch):
    """Also if balls are of one hop and blocks are split: distances, rounds and predecessors are those of the whole graph."""
    import numpy as np
    import pandas as pd
    from frota.operators.road_regions import last_nodes

    monkeypatch.setattr(graph, "_HOPS", 1)
    monkeypatch.setattr(graph, "_WIDER", 2)
    monkeypatch.setattr(graph, "_BLOCK_CELLS", 300)
    rng = random.Random(seed)
    edges = [(0, i, (i + rng.choice([1, 2, 7])) % 90, rng.choice([0.0, 0.1, 0.7, 1.0, 3.0])) for i in range(90) for _ in range(2)]
    nodes, *edges = _arrays(edges)
    sources = [int(n) for n in nodes[::7]]
    targets = [[(s + k) % 95 for k in rng.sample(range(95), 3)] for s in sources]
    got = {}
    for source, asked, near, dist, step, local in graph._searched(pd.DataFrame({"source": sources, "targets": targets}), nodes, *edges):
        before = last_nodes(dist, step, *local)
        for i, s in enumerate(source):
            for n in asked[i]:
                at = np.searchsorted(near, n)
                if at < len(near) and near[at] == n and np.isfinite(dist[i, at]):
                    got[int(s), int(n)] = (dist[i, at], step[i, at], near[before[i, at]] if before[i, at] >= 0 else None)
    dist, step = graph.relax_block(np.array(sources), [None] * len(sources), nodes, *edges)
    before = last_nodes(dist, step, *edges)
    want = {}
    for i, s in enumerate(sources):
        for n in targets[i]:
            at = np.searchsorted(nodes, n)
            if at < len(nodes) and nodes[at] == n and np.isfinite(dist[i, at]):
                want[s, n] = (dist[i, at], step[i, at], nodes[before[i, at]] if before[i, at] >= 0 else None)
    assert got == want
