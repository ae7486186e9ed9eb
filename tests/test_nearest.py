import random

import pytest
from pyspark.sql import Window, functions as F

from frota.functions.geo import haversine_km
from frota.operators.nearest import nearest, nearest_index, node_index


def cloud(seed, n, crowd):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        pick = rng.random()
        if pick < crowd:
            rows.append((i, -23.55 + rng.random() * 1e-3, -46.65 + rng.random() * 1e-3))
        elif pick < crowd + 0.1:
            rows.append((i, -23.5, -46.6))
        else:
            rows.append((i, -23.6 + rng.random() * 0.2, -46.7 + rng.random() * 0.2))
    return rows


@pytest.mark.parametrize("k", [1, 5])
def test_equals_all_pairs_with_a_crowded_cell_and_equal_spots(spark, k):
    """A third of both sides sits in one small cell, a tenth at one spot; far and polar queries too."""
    targets = spark.createDataFrame(cloud(1, 900, 0.33), "tid bigint, lat double, lon double")
    asked = cloud(2, 200, 0.33) + [(-1, 89.9, 170.0), (-2, -23.55, 179.9), (-3, -90.0, 0.0), (-4, None, 1.0)]
    points = spark.createDataFrame(asked, "pid bigint, lat double, lon double")
    got = nearest(points, nearest_index(targets, "tid", "tid", k, leaf_targets=4), "pid")
    all_pairs = points.selectExpr("pid", "lat AS a", "lon AS b").where("a IS NOT NULL").crossJoin(targets)
    want = (
        all_pairs.selectExpr("pid", "tid", f"{haversine_km('a', 'b', 'lat', 'lon')} AS dist_km")
        .withColumn("rank", F.row_number().over(Window.partitionBy("pid").orderBy("dist_km", "tid")))
        .where(F.col("rank") <= k)
    )
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_dateline(spark):
    targets = spark.createDataFrame([(1, 0.0, 179.9), (2, 0.0, 170.0)], "tid bigint, lat double, lon double")
    points = spark.createDataFrame([(1, 0.0, -179.9)], "pid bigint, lat double, lon double")
    [row] = nearest(points, nearest_index(targets, "tid", "tid", 1), "pid").collect()
    assert row.tid == 1


def test_first_listed_node_wins_and_no_targets_give_no_rows(spark):
    schema = "node_id bigint, node_pos bigint, lat double, lon double"
    nodes = spark.createDataFrame([(7, 1, 1.0, 1.0), (3, 2, 1.0, 1.0)], schema)
    points = spark.createDataFrame([(1, 1.1, 1.0)], "pid bigint, lat double, lon double")
    assert nearest(points, node_index(nodes), "pid").first().node_id == 7
    assert nearest(points, node_index(nodes.where("false")), "pid").count() == 0


@pytest.mark.parametrize("limit", [None, 0])
@pytest.mark.parametrize("k", [1, 4])
def test_points_far_beyond_the_corner_keep_few_cells(spark, k, limit):
    """A grid and points off its corner and its edge, by blocks in the tasks and by cells; ties and odd keys stay."""
    side = 30
    rows = [(i, -i, -23.6 + i // side * 1e-3, -46.7 + i % side * 1e-3) for i in range(side * side)]
    targets = spark.createDataFrame(rows, "tid bigint, tie bigint, lat double, lon double")
    asked = [(None if i % 5 == 0 else i // 2, -23.5 + i * 0.01, -46.6 + i % 3 * 0.2 - 0.1) for i in range(40)] + [(2**60 + 1, -23.5955, -46.6955)]
    points = spark.createDataFrame(asked, "pid bigint, lat double, lon double")
    if limit is not None:
        spark.conf.set("spark.frota.broadcastLimitBytes", str(limit))
    try:
        got = nearest(points, nearest_index(targets, "tid", "tie", k, leaf_targets=4), "pid").collect()
    finally:
        spark.conf.unset("spark.frota.broadcastLimitBytes")
    pairs = points.withColumn("row", F.monotonically_increasing_id()).selectExpr("row", "pid", "lat AS a", "lon AS b").crossJoin(targets)
    want = (
        pairs.selectExpr("row", "pid", "tid", "tie", f"{haversine_km('a', 'b', 'lat', 'lon')} AS dist_km")
        .withColumn("rank", F.row_number().over(Window.partitionBy("row").orderBy("dist_km", "tie")))
        .where(F.col("rank") <= k)
        .select("pid", "tid", "dist_km", "rank")
    )
    order = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(map(tuple, got), key=order) == sorted(map(tuple, want.collect()), key=order)


def test_bounds_off_a_corner_are_the_corner(spark):
    """Before, a box off to a corner counted as near as the larger of its two gaps, so all cells of a town stayed."""
    from frota.functions.geo import box_lower_bound_km, box_nearest_upper_bound_km, box_upper_bound_km

    box = spark.sql("SELECT 0.3D AS lat, 0.3D AS lon, -0.1D AS lat_lo, 0.0D AS lat_hi, -0.1D AS lon_lo, 0.0D AS lon_hi")
    low, high, sure, true = box.selectExpr(
        box_lower_bound_km("lat", "lon"), box_upper_bound_km("lat", "lon"), box_nearest_upper_bound_km("lat", "lon"),
        haversine_km("lat", "lon", "0.0D", "0.0D"),
    ).first()
    assert 0.999 * true < low < true < sure < high < 1.34 * true
