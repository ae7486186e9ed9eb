"""Boxes over the targets of a nearest search, for targets that were counted and found small enough to hand to every task.

Targets lie along a space-filling curve; 16 of them share a box, 16 boxes share a box above, and so on. Bounds are in half chords
squared, the quantity that the haversine formula takes the root of. What is returned are candidates: all targets that may be among the k
nearest, with room for rounding. Distances and ranks are Spark's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

FAN = 16
_ROOM = 1 + 1e-9
_TINY = 1e-300
_CELLS = 500_000
_BEAM = 4
#: Times ``k`` targets are looked at for a bound on the k-th nearest: those in the first boxes need not be near.
_LOOK = 4


def _spread(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        v = (v | (v << np.uint64(shift))) & np.uint64(mask)
    return v


def pack(targets: pa.Table) -> tuple:
    """(targets in curve order, [boxes of targets, boxes of boxes, ...]) of (_target, _tie, lat, lon, gx, gy)."""
    code = _spread(targets["gx"].to_numpy()) | (_spread(targets["gy"].to_numpy()) << np.uint64(1))
    targets = targets.take(np.argsort(code, kind="stable")).select(["_target", "_tie", "lat", "lon"]).combine_chunks()
    lat, lon = targets["lat"].to_numpy(), targets["lon"].to_numpy()
    box, levels = (lat, lat, lon, lon, np.ones(len(lat), np.int64)), []
    while not levels or len(box[0]) > FAN:
        first = np.arange(0, len(box[0]), FAN)
        folds = (np.minimum, np.maximum, np.minimum, np.maximum, np.add)
        box = tuple(fold.reduceat(side, first) for fold, side in zip(folds, box, strict=True))
        levels.append(box)
    return targets, levels


def _chord(lat, there, d_lat, d_lon):
    return np.sin(np.radians(d_lat) / 2) ** 2 + np.cos(np.radians(lat)) * there * np.sin(np.radians(d_lon) / 2) ** 2


def _least(lat, lon, box, at):
    """No target of a box is nearer; as ``geo.box_lower_bound_km``."""
    lat_lo, lat_hi, lon_lo, lon_hi = (side[at] for side in box[:4])
    to_lo, to_hi = np.abs(lon_lo - lon), np.abs(lon_hi - lon)
    gap = np.minimum(np.minimum(to_lo, 360 - to_lo), np.minimum(to_hi, 360 - to_hi))
    gap = np.where((lon >= lon_lo) & (lon <= lon_hi), 0.0, np.maximum(gap, 0.0))
    there = np.maximum(np.minimum(np.cos(np.radians(lat_lo)), np.cos(np.radians(lat_hi))), 0.0)
    return _chord(lat, there, np.maximum(np.maximum(lat_lo - lat, lat - lat_hi), 0.0), gap)


def _below(row: np.ndarray, box: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    below = (box[:, None] * FAN + np.arange(FAN)).ravel()
    inside = below < n
    return np.repeat(row, FAN)[inside], below[inside]


def _first_k(row, by, n, k):
    """Places of the boxes in order of ``by`` until those of a row hold ``k`` targets, and of ``_BEAM`` at least."""
    order = np.lexsort((by, row))
    row, held = row[order], np.cumsum(n[order]) - n[order]
    start = np.searchsorted(row, row)
    return order[(held - held[start] < k) | (np.arange(len(row)) - start < _BEAM)]


def _kth(row: np.ndarray, by: np.ndarray, rows: int, k: int) -> np.ndarray:
    """The ``k``-th smallest ``by`` of every row, infinite if it has fewer. ``row`` is sorted."""
    first = np.searchsorted(row, np.arange(rows + 1))
    counts = np.diff(first)
    widest = int(counts.max(initial=0))
    if widest < k:
        return np.full(rows, np.inf)
    if rows * widest <= 4 * len(row) + _CELLS:
        beside = np.full((rows, widest), np.inf)
        beside[row, np.arange(len(row)) - first[row]] = by
        return np.partition(beside, k - 1, axis=1)[:, k - 1]
    order = np.lexsort((by, row))
    found = np.full(rows, np.inf)
    enough = counts >= k
    found[enough] = by[order][first[:-1][enough] + k - 1]
    return found


def candidates(lat: np.ndarray, lon: np.ndarray, packed: tuple, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(place of the point, place of the target): all pairs that may be among a point's ``k`` nearest, by point."""
    targets, levels = packed
    t_lat, t_lon = targets["lat"].to_numpy(), targets["lon"].to_numpy()
    n_top, top = len(levels[-1][0]), np.arange(len(lat))

    def descend(choose) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        row, at = np.repeat(top, n_top), np.tile(np.arange(n_top), len(lat))
        for i in range(len(levels) - 1, -1, -1):
            kept = choose(row, _least(lat[row], lon[row], levels[i], at), levels[i][4][at])
            row, at = _below(row[kept], at[kept], len(levels[i - 1][0]) if i else len(t_lat))
        return row, at, _chord(lat[row], np.cos(np.radians(t_lat[at])), t_lat[at] - lat[row], t_lon[at] - lon[row])

    # k targets near the point bound how far the k-th nearest can be
    row, _, chord = descend(lambda row, least, n: _first_k(row, least, n, _LOOK * k if k > 1 else k))
    limit = _kth(row, chord, len(lat), k) * _ROOM + _TINY
    row, at, chord = descend(lambda row, least, n: np.flatnonzero(least <= limit[row]))
    near = chord <= (_kth(row, chord, len(lat), k) * _ROOM + _TINY)[row]
    row, at = row[near], at[near]
    order = np.argsort(row, kind="stable")
    return row[order], at[order]


def near_lists(batch: pa.RecordBatch, packed: tuple, k: int) -> Iterator[pa.RecordBatch]:
    """``batch`` (point, lat, lon) with the candidates of every point as ``near``."""
    targets = packed[0]
    size = max(1, _CELLS // (FAN * min(max(k, FAN), targets.num_rows)))
    for start in range(0, batch.num_rows, size):
        part = batch.slice(start, size)
        lat, lon = part.column("lat").to_numpy(zero_copy_only=False), part.column("lon").to_numpy(zero_copy_only=False)
        sound = np.isfinite(lat) & np.isfinite(lon)
        row, at = candidates(lat[sound], lon[sound], packed, k)
        row = np.flatnonzero(sound)[row]
        if not sound.all():
            # every distance to a point without finite coordinates is NaN, so ties decide
            tied = pc.sort_indices(targets["_tie"], sort_keys=[("", "ascending")], null_placement="at_start").to_numpy()[:k]
            odd = np.flatnonzero(~sound)
            row, at = np.concatenate([row, np.repeat(odd, len(tied))]), np.concatenate([at, np.tile(tied, len(odd))])
            order = np.argsort(row, kind="stable")
            row, at = row[order], at[order]
        ends = np.searchsorted(row, np.arange(part.num_rows + 1)).astype(np.int32)
        chosen = targets.take(pa.array(at)).combine_chunks()
        rows = pa.StructArray.from_arrays([c.combine_chunks() if c.num_chunks != 1 else c.chunk(0) for c in chosen.columns], names=chosen.column_names)
        yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(pa.array(ends), rows)], names=[*part.schema.names, "near"])
