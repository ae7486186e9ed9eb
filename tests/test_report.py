import random
import statistics

import pytest

from frota.operators.report import display, latency_report

LOG = "status string, ritmo_idx int, method string, latency double"


def p95(values):
    values = sorted(values)
    return values[min(len(values) * 95 // 100, len(values) - 1)]


@pytest.mark.parametrize("sort_limit", [200_000, 10])
def test_report_equals_sorted_lists(spark, sort_limit):
    """n = 1, 2, 19, 20, 100, heavy repeats and one cell with most rows; with and without narrowing."""
    rng = random.Random(4)
    cells = {
        (0, "GET"): [rng.random()],
        (0, "POST"): [rng.random(), 9.0],
        (0, "PATCH"): [rng.random() for _ in range(19)],
        (1, "GET"): [rng.random() for _ in range(20)],
        (1, "POST"): [float(i) for i in range(100)],
        (2, "GET"): [rng.choice([0.5, 0.5, 0.5, 0.7]) for _ in range(300)],
        (2, "POST"): [rng.random() for _ in range(3000)],
    }
    rows = [("200" if rng.random() < 0.9 else "error", i, m, v) for (i, m), values in cells.items() for v in values]
    report = latency_report(spark.createDataFrame(rows, LOG), sort_limit=sort_limit).collect()
    assert len(report) == 9
    for r in report:
        values = cells.get((r.ritmo_idx, r.method))
        if values is None:
            assert (r.n, r.min, r.median, r.p95) == (0, None, None, None)
            continue
        assert (r.n, r.min, r.max, r.p95) == (len(values), min(values), max(values), p95(values))
        assert r.median == pytest.approx(statistics.median(values), abs=1e-15)
        assert r["mean"] == pytest.approx(statistics.mean(values))


def test_status_filter_and_display(spark):
    rows = [("200", 0, "GET", 0.123456), ("error", 0, "GET", 5.0)]
    shown = display(latency_report(spark.createDataFrame(rows, LOG), status="200")).where("n > 0").collect()
    assert [(r.n, r.max) for r in shown] == [(1, 0.1235)]


@pytest.mark.parametrize("sort_limit", [200_000, 2])
def test_infinite_nan_and_missing_latencies(spark, sort_limit):
    inf, nan = float("inf"), float("nan")
    cells = {(0, "GET"): [1.0, 2.0, inf], (0, "POST"): [-inf, 1.0, 2.0, inf], (1, "GET"): [1.0, 2.0, 3.0, nan], (1, "POST"): [None, None]}
    rows = [("200", i, m, v) for (i, m), values in cells.items() for v in values]
    got = {(r.ritmo_idx, r.method): r for r in latency_report(spark.createDataFrame(rows, LOG), sort_limit=sort_limit).collect()}
    assert got[0, "GET"].p95 == inf and got[0, "GET"].median == 2.0
    assert got[0, "POST"].p95 == inf and got[0, "POST"].median == 1.5 and got[0, "POST"].min == -inf
    assert got[1, "GET"].p95 != got[1, "GET"].p95 and got[1, "GET"].median == 2.5 and got[1, "GET"].n == 4
    assert (got[1, "POST"].n, got[1, "POST"].p95) == (2, None)
