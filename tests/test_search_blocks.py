"""What searches in tasks look at: neighbours together, no farther than needed, and only targets that streets lead to."""

import random

import numpy as np
import pandas as pd
import pyarrow as pa

from frota.operators import graph, near_blocks
from frota.operators.dispatch import settle_zone
from frota.operators.road_regions import last_nodes, last_of


def _random_graph(seed):
    rng = random.Random(seed)
    n, m = rng.randrange(2, 25), rng.randrange(1, 60)
    ends = sorted({(rng.randrange(n), rng.randrange(n)) for _ in range(m)})
    return n, np.array([t for _, t in ends]), np.array([h for h, _ in ends]), np.array([rng.choice([0.0, 0.1, 1.0, 3.0]) for _ in ends])


def test_reach_is_that_of_the_graph(monkeypatch):
    for seed in range(60):
        n, tail, head, _ = _random_graph(seed)
        joined = np.eye(n, dtype=bool)
        joined[tail, head] = True
        for k in range(n):
            joined |= joined[:, [k]] & joined[[k], :]
        exact = graph.reach_of(n, tail, head)
        monkeypatch.setattr(graph, "_PARTS", 0)
        rough = graph.reach_of(n, tail, head)
        monkeypatch.undo()
        for a in range(n):
            assert (graph.may_reach(exact, a, np.arange(n)) == joined[a]).all()
            assert graph.may_reach(rough, a, np.flatnonzero(joined[a])).all()


def test_a_target_that_no_street_leads_to_does_not_widen_the_search():
    n = 5000
    tail, head, weight = np.arange(n - 1), np.arange(1, n), np.ones(n - 1)
    batch = pd.DataFrame({"source": [2500], "targets": [[2400, 2503]]})
    blocks = list(graph._searched(batch, np.arange(n), tail, head, weight, graph.reach_of(n, tail, head)))
    assert sum(len(near) for _, _, near, *_ in blocks) < 100
    [(source, asked, near, dist, _, _)] = blocks
    assert list(asked[0]) == [2503] and dist[0, list(near).index(2503)] == 3.0


def test_neighbourhoods_are_small_and_lie_together():
    side = 60
    at = np.arange(side * side)
    right, down = at[at % side < side - 1], at[at < side * (side - 1)]
    tail, head = np.concatenate([right, down]), np.concatenate([right + 1, down + side])
    near_by = graph.neighbourhoods(side * side, tail, head, 64)
    assert np.bincount(near_by).max() <= 64
    extent = [np.ptp(at[near_by == i] // side) + np.ptp(at[near_by == i] % side) for i in range(near_by.max() + 1)]
    assert np.median(extent) <= 30


def test_last_node_of_a_cell_is_that_of_the_whole_search():
    for seed in range(40):
        n, tail, head, weight = _random_graph(seed)
        dist, step = graph.relax_block(np.arange(n), [None] * n, np.arange(n), tail, head, weight)
        row, col = np.divmod(np.random.default_rng(seed).permutation(n * n), n)
        assert (last_of(dist, step, row, col, tail, head, weight) == last_nodes(dist, step, tail, head, weight)[row, col]).all()


def test_near_targets_are_found_without_looking_at_thousands(monkeypatch):
    """Targets in streaks, as along streets: few boxes hold a bound on the 64th nearest."""
    n = np.arange(30_000)
    lat, lon = -23.6 + (n * 71 % 1100) / 1e4 + n / 1e7, -46.7 + (n * 97 % 1100) / 1e4 + n / 1e7
    cells = {"gx": ((lon + 180) / 360 * 2**30).astype(np.int64), "gy": ((lat + 90) / 180 * 2**30).astype(np.int64)}
    packed = near_blocks.pack(pa.table({"_target": n, "_tie": n, "lat": lat, "lon": lon, **cells}))
    looked = []
    chord = near_blocks._chord
    monkeypatch.setattr(near_blocks, "_chord", lambda *a: looked.append(len(a[2])) or chord(*a))
    row, at = near_blocks.candidates(lat[::1000], lon[::1000], packed, 64)
    assert sum(looked) < 3000 * 30
    target = packed[0]["_target"].to_numpy()[at]
    for i, (a, b) in enumerate(zip(lat[::1000], lon[::1000])):
        best = np.argsort(np.sin(np.radians(lat - a) / 2) ** 2 + np.cos(np.radians(a)) * np.cos(np.radians(lat)) * np.sin(np.radians(lon - b) / 2) ** 2)[:64]
        assert set(best) <= set(target[row == i])


def test_a_zone_settles_as_handling_its_orders_one_by_one():
    for seed in range(40):
        rng = random.Random(seed)
        orders = [(o, rng.randrange(4), 0) for o in rng.sample(range(50), 20)]
        rows = [
            (r, place, c, rng.choice([1.0, 2.0, 3.0, float("nan")]), rng.choice([2**62, 2**62, rng.randrange(50)]))
            for r in range(3) for place, c in enumerate(rng.sample(range(12), rng.randrange(1, 12)))
        ]
        rng.shuffle(rows)
        got = settle_zone(
            pd.DataFrame(orders, columns=["id_pedido", "id_restaurante", "zone"]),
            pd.DataFrame(rows, columns=["listed_at", "place", "listed", "road", "held_by"]), 3,
        )
        gone, want = set(), []
        for order, at, _ in sorted(orders):
            left = [x for x in sorted(rows) if x[0] == at and x[2] not in gone and x[4] >= order][:3]
            best = min((x for x in left if x[3] == x[3]), key=lambda x: x[3], default=None)
            gone |= {best[2]} if best else set()
            want.append((order, best[2] if best else None, len(left)))
        assert [(o, None if pd.isna(c) else c, n) for o, c, n in got[["id_pedido", "id_entregador", "vistos"]].itertuples(index=False)] == want
