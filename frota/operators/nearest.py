"""k nearest neighbours on the sphere as a level-by-level descent of a cell pyramid.

Cells are quadrants of the latitude / longitude plane. Each pyramid row holds how many targets a
cell has and their bounding box. A query point starts at the few cells that cover all targets and
goes down two levels at a time, keeping only cells that may still hold one of its k nearest: those
whose least possible distance is within the k-th smallest greatest-possible distance. Cells end in
leaves of a bounded number of targets, also inside a crowded cell, so no point is ever paired with
more than a handful of leaves. The result is exact. The pyramid is built once per target table and
serves any number of query tables.

Targets that were counted and found small are handed to every task instead (see ``near_blocks``), which descends boxes over them for
blocks of points; then no candidate is shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F, types as T

from frota.functions.geo import box_lower_bound_km, box_nearest_upper_bound_km, box_upper_bound_km, haversine_km
from frota.operators import near_blocks
from frota.session import broadcast_limit, cut_lineage, shuffle_width

DEPTH = 30
STEP = 2
LEAF_TARGETS = 16
_LEVEL_ROW_BYTES = 96
_PACKED_ROW_BYTES = 64
_BOX = "min(lat_lo) AS lat_lo, max(lat_hi) AS lat_hi, min(lon_lo) AS lon_lo, max(lon_hi) AS lon_hi"
_CELL = "cx, cy, n, lat_lo, lat_hi, lon_lo, lon_hi"
_QUERY = ["q_lat", "q_lon"]


def _start_level(xs: tuple[int, int], ys: tuple[int, int]) -> int:
    """STEP levels below the deepest level at which all targets lie in at most 2 x 2 cells."""
    level = 0
    while level < DEPTH:
        shift = DEPTH - level - 1
        if (xs[1] >> shift) - (xs[0] >> shift) > 1 or (ys[1] >> shift) - (ys[0] >> shift) > 1:
            break
        level += 1
    return min(level + STEP, DEPTH)


def _rolled_up(cells: DataFrame, shift: int) -> DataFrame:
    at = cells.selectExpr(f"shiftright(cx, {shift}) AS cx", f"shiftright(cy, {shift}) AS cy", *_CELL.split(", ")[2:])
    box = [F.expr(part) for part in _BOX.split(", ")]
    return at.groupBy("cx", "cy").agg(F.expr("sum(n) AS n"), *box)


def _pyramid(targets: DataFrame, steps: list[int]) -> DataFrame:
    """The cells of every asked level, each level rolled up from the next finer one."""
    points = targets.selectExpr(
        "gx AS cx", "gy AS cy", "1L AS n", "lat AS lat_lo", "lat AS lat_hi", "lon AS lon_lo", "lon AS lon_hi"
    )
    cells = _rolled_up(points, DEPTH - steps[-1])
    stacked = cells.selectExpr(f"{steps[-1]} AS level", "*")
    for level, finer in zip(steps[-2::-1], steps[:0:-1]):
        cells = _rolled_up(cells, finer - level)
        stacked = stacked.unionByName(cells.selectExpr(f"{level} AS level", "*"))
    return stacked


def _level_sizes(pyramid: DataFrame, top: int) -> dict:
    """Cells and fullest cell per level, at most DEPTH + 1 rows; for the start level, of at most 64
    cells, also the cells."""
    found = pyramid.groupBy("level").agg(
        F.expr("count(*) AS cells"),
        F.expr("max(n) AS largest"),
        F.expr(f"collect_list(struct({_CELL})) FILTER (WHERE level = {top}) AS top_cells"),
    )
    return {r["level"]: r for r in found.collect()}


def _sized(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast only what was counted and found small."""
    return F.broadcast(df) if rows * _LEVEL_ROW_BYTES <= broadcast_limit(df.sparkSession) else df


def _pruned(state: DataFrame, k: int) -> DataFrame:
    """Drop cells that cannot hold one of the k nearest."""
    near = box_lower_bound_km("q_lat", "q_lon")
    if k == 1:
        # any cell bounds the nearest by itself, so nothing is counted in order of distance
        bounds = state.selectExpr("*", f"{near} AS _near", f"{box_nearest_upper_bound_km('q_lat', 'q_lon')} AS _far")
        limited = bounds.selectExpr("*", "min(_far) OVER (PARTITION BY q_lat, q_lon) AS _limit")
        return limited.where("_near <= _limit").drop("_near", "_far", "_limit")
    return (
        state.selectExpr("*", f"{near} AS _near", f"{box_upper_bound_km('q_lat', 'q_lon')} AS _far")
        .selectExpr(
            "*",
            "sum(n) OVER (PARTITION BY q_lat, q_lon ORDER BY _far "
            "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS _seen",
        )
        .selectExpr(
            "*", f"min(CASE WHEN _seen >= {k} THEN _far END) OVER (PARTITION BY q_lat, q_lon) AS _limit"
        )
        .where("_limit IS NULL OR _near <= _limit")
        .drop("_near", "_far", "_seen", "_limit")
    )


@dataclass
class NearestIndex:
    """A materialised pyramid: ``leaves`` holds the targets with their leaf level, ``cells`` the
    cells of every level in ``steps``, ``rows`` how many cells a level has, ``start`` the top cells
    as an array literal. Few targets are held in ``packed`` alone, without cells."""

    target_id: str
    k: int
    n: int
    leaves: DataFrame
    cells: DataFrame | None
    steps: list[int]
    rows: dict[int, int]
    start: str
    packed: Broadcast | None = None


def nearest_index(
    targets: DataFrame, target_id: str, tie: str, k: int, leaf_targets: int = LEAF_TARGETS
) -> NearestIndex:
    """Index ``targets`` (target_id, tie, lat, lon) for up to ``k`` neighbours per query point."""
    side = 1 << DEPTH
    # of targets at one spot only the first k can matter; the limit is applied before the shuffle
    placed = cut_lineage(
        targets.where("lat IS NOT NULL AND lon IS NOT NULL")
        .selectExpr(f"{target_id} AS _target", f"{tie} AS _tie", "lat", "lon")
        .selectExpr("*", "row_number() OVER (PARTITION BY lat, lon ORDER BY _tie) AS _rn")
        .where(F.col("_rn") <= k)
        .selectExpr(
            "_target",
            "_tie",
            "lat",
            "lon",
            f"CAST(least(floor((lon + 180) / 360 * {side}), {side - 1}) AS BIGINT) AS gx",
            f"CAST(least(floor((lat + 90) / 180 * {side}), {side - 1}) AS BIGINT) AS gy",
        )
    )
    extent = placed.selectExpr("count(*) AS n", "min(gx)", "max(gx)", "min(gy)", "max(gy)").first()
    if extent["n"] == 0:
        return NearestIndex(target_id, k, 0, placed, None, [], {}, "")

    spark = targets.sparkSession
    if extent["n"] * _PACKED_ROW_BYTES <= broadcast_limit(spark):
        packed = spark.sparkContext.broadcast(near_blocks.pack(placed.drop("_rn").toArrow()))
        return NearestIndex(target_id, k, extent["n"], placed, None, [], {}, "", packed)

    # the pyramid down to the depth an even spread needs, then deeper only below crowded cells
    top = _start_level(extent[1:3], extent[3:5])
    even = math.ceil(math.log(max(extent["n"] / leaf_targets, 1), 4) / STEP) * STEP - STEP
    bottom = min(DEPTH, top + max(even, 0))
    steps = list(range(top, bottom + 1, STEP))
    pyramid = cut_lineage(_pyramid(placed, steps))
    leaves = placed.selectExpr("*", f"{bottom} AS leaf")
    sizes = _level_sizes(pyramid, top)
    while bottom < DEPTH and sizes[bottom]["largest"] > 4 * leaf_targets:
        crowded = pyramid.where(f"level = {bottom} AND n > {4 * leaf_targets}")
        below = [level for level in range(bottom + STEP, bottom + 3 * STEP + 1, STEP) if level <= DEPTH] or [DEPTH]
        shift = DEPTH - bottom
        marked = leaves.selectExpr("*", f"shiftright(gx, {shift}) AS cx", f"shiftright(gy, {shift}) AS cy").join(
            crowded.selectExpr("cx", "cy", f"{bottom} AS leaf", "true AS _crowded"), ["cx", "cy", "leaf"], "left"
        )
        leaves = cut_lineage(marked.selectExpr(*placed.columns, f"if(_crowded, {below[-1]}, leaf) AS leaf"))
        deeper = cut_lineage(_pyramid(leaves.where(f"leaf = {below[-1]}"), below))
        pyramid, sizes = pyramid.unionByName(deeper), sizes | _level_sizes(deeper, top)
        steps, bottom = steps + below, below[-1]

    # few cells at the start level, so they go into the query as a literal
    start = ", ".join(
        f"struct({c.cx}L AS cx, {c.cy}L AS cy, {c.n}L AS n, {c.lat_lo!r}D AS lat_lo, {c.lat_hi!r}D AS lat_hi, "
        f"{c.lon_lo!r}D AS lon_lo, {c.lon_hi!r}D AS lon_hi)"
        for c in sizes[top]["top_cells"]
    )
    rows = {level: size["cells"] for level, size in sizes.items()}
    return NearestIndex(target_id, k, extent["n"], leaves, pyramid, steps, rows, f"array({start})")


def nearest(points: DataFrame, index: NearestIndex, point_id: str, k: int | None = None) -> DataFrame:
    """(point_id, target_id, dist_km, rank 1..k) for every point (point_id, lat, lon).

    Equal distances go by the index's tie column. Points without coordinates take no part.
    """
    k = index.k if k is None else k
    if k > index.k:
        raise ValueError(f"the index serves up to {index.k} neighbours")
    asked = points.where("lat IS NOT NULL AND lon IS NOT NULL")
    if index.n == 0:
        empty = index.leaves.selectExpr(f"_target AS {index.target_id}", "lat AS dist_km", "1 AS rank")
        return asked.select(point_id).join(empty, F.lit(False)).select(
            point_id, index.target_id, "dist_km", "rank"
        )
    if index.packed is not None:
        return _nearest_in_tasks(asked, index, point_id, k)
    steps = index.steps
    farthest = box_nearest_upper_bound_km if k == 1 else box_upper_bound_km
    near, far = box_lower_bound_km("q_lat", "q_lon", "c."), farthest("q_lat", "q_lon", "c.")
    state = (
        asked.groupBy(F.expr("lat AS q_lat"), F.expr("lon AS q_lon"))
        .agg(F.expr("count(*) AS _copies"))
        # a fixed width: these rows are small now and many soon, so they must not be packed into few tasks
        .repartition(shuffle_width(points.sparkSession))
        .selectExpr("q_lat", "q_lon", f"transform({index.start}, c -> struct(c AS cell, {near} AS near, {far} AS far)) AS top")
        # a cell of k targets bounds the k-th distance; most far cells go before rows are made of them
        .selectExpr("*", f"array_min(transform(filter(top, t -> t.cell.n >= {k}), t -> t.far)) AS reach")
        .selectExpr(
            "q_lat",
            "q_lon",
            f"{steps[0]} AS at",
            "inline(transform(filter(top, t -> reach IS NULL OR t.near <= reach), t -> t.cell))",
        )
    )
    state = _pruned(state, k)
    for above, level in zip(steps, steps[1:]):
        gap = level - above
        children = index.cells.where(f"level = {level}").selectExpr(
            f"{above} AS at", f"shiftright(cx, {gap}) AS cx", f"shiftright(cy, {gap}) AS cy",
            f"struct(level AS at, {_CELL}) AS _child",
        )
        state = state.join(_sized(children, index.rows[level]), ["at", "cx", "cy"], "left").selectExpr(
            "q_lat", "q_lon", f"coalesce(_child, struct(at, {_CELL})) AS _cell"
        )
        state = _pruned(state.select(*_QUERY, "_cell.*"), k)

    in_leaf = index.leaves.selectExpr(
        "_target", "_tie", "lat", "lon", "leaf AS at",
        f"shiftright(gx, {DEPTH} - leaf) AS cx", f"shiftright(gy, {DEPTH} - leaf) AS cy",
    )
    ranked = (
        state.select(*_QUERY, "at", "cx", "cy")
        .join(_sized(in_leaf, index.n), ["at", "cx", "cy"])
        .selectExpr(*_QUERY, "_target", "_tie", f"{haversine_km('q_lat', 'q_lon', 'lat', 'lon')} AS dist_km")
        .selectExpr("*", "row_number() OVER (PARTITION BY q_lat, q_lon ORDER BY dist_km, _tie) AS rank")
        .where(F.col("rank") <= k)
    )
    here = (asked["lat"] == ranked["q_lat"]) & (asked["lon"] == ranked["q_lon"])
    return asked.join(ranked, here).selectExpr(
        point_id, f"_target AS {index.target_id}", "dist_km", "rank"
    )


def _nearest_in_tasks(asked: DataFrame, index: NearestIndex, point_id: str, k: int) -> DataFrame:
    packed = index.packed

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from near_blocks.near_lists(batch, packed.value, k)

    # a fixed width: a small file is one task otherwise
    points = asked.select(F.col(point_id).alias("_point"), F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"))
    spread = points.repartition(shuffle_width(asked.sparkSession))
    target = T.StructType([index.leaves.schema[c] for c in ("_target", "_tie", "lat", "lon")])
    listed = spread.mapInArrow(search, T.StructType([*points.schema.fields, T.StructField("near", T.ArrayType(target))]))
    dist = haversine_km("lat", "lon", "t.lat", "t.lon")
    ranked = listed.selectExpr("_point", f"slice(array_sort(transform(near, t -> struct({dist} AS dist_km, t._tie AS tie, t._target AS target))), 1, {k}) AS best")
    return ranked.selectExpr("_point", "posexplode(best) AS (place, t)").selectExpr(
        f"_point AS {point_id}", f"t.target AS {index.target_id}", "t.dist_km AS dist_km", "place + 1 AS rank"
    )


def node_index(nodes: DataFrame) -> NearestIndex:
    """Road nodes (node_id, node_pos, lat, lon); the node listed first wins ties."""
    return nearest_index(nodes, "node_id", "node_pos", 1)


def nearest_nodes(points: DataFrame, index: NearestIndex, key: str) -> DataFrame:
    """(key, node_id) for a table with latitude and longitude."""
    placed = points.selectExpr(key, "latitude AS lat", "longitude AS lon")
    return nearest(placed, index, key).select(key, "node_id")


def nearest_couriers(restaurants: DataFrame, couriers: DataFrame, k: int = 3) -> DataFrame:
    """(id_restaurante, id_entregador, dist_km, rank): the k nearest of the given couriers."""
    index = nearest_index(
        couriers.selectExpr("id_entregador", "latitude AS lat", "longitude AS lon"),
        "id_entregador",
        "id_entregador",
        k,
    )
    return nearest(
        restaurants.selectExpr("id_restaurante", "latitude AS lat", "longitude AS lon"), index, "id_restaurante"
    )
