"""Latency report with exact order statistics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from frota.functions.scalars import rounded
from frota.session import broadcast_limit, cut_lineage

# The load phases in order (volume, requests per second, seconds) and the methods shown.
PHASES = [("OPERACAO_NORMAL", 10, 200), ("PICO", 50, 60), ("EVENTO_ESPECIAL", 200, 30)]
METHODS = ["PATCH", "POST", "GET"]
SORT_LIMIT = 200_000
_SLOTS = 1000
_ROW_BYTES = 128


def exact_ranks(
    df: DataFrame,
    keys: list[str],
    value: str,
    ranks: dict[str, Callable[[Column], Column]],
    sort_limit: int = SORT_LIMIT,
) -> DataFrame:
    """The values at given 0-based places of each group's sorted values, without sorting a group.

    ``ranks`` maps a result name to the place as a function of the group's size. A bracket, an open
    interval (_lo, _hi) with the place _k counted from its start, narrows round by round: a quantile
    sketch of the inside proposes two of its values, one aggregate counts the parts they cut, and
    the part that holds the place goes on. Both cut values leave the interval, so it always shrinks.
    A bracket is sorted once at most ``sort_limit`` values are left. Every step is a partially
    aggregated groupBy: a group with a third of the rows is no hot task.

    Nulls do not count. A null end of an interval is open without limit, so infinities are inside it; NaN
    sorts last, and places beyond the numbers are NaN.
    """
    values = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    base = values.where(~F.isnan("_v"))
    groups = [*keys, "_q"]
    places = F.array(
        *[F.struct(F.lit(q).alias("_q"), place(F.col("_all")).cast("bigint").alias("_k")) for q, place in ranks.items()]
    )
    brackets = cut_lineage(
        values.groupBy(*keys)
        .agg(F.count("*").alias("_all"), F.count_if(~F.isnan("_v")).alias("_inside"))
        .select(*keys, F.explode(places).alias("_p"), "_inside")
        .select(
            *keys,
            "_p.*",
            "_inside",
            F.lit(None).cast("double").alias("_lo"),
            F.lit(None).cast("double").alias("_hi"),
        )
        .withColumn("_found", F.when(F.col("_k") >= F.col("_inside"), F.lit(float("nan"))))
    )

    def inside(part: DataFrame) -> DataFrame:
        part = part.drop("_found")
        # the brackets are counted before they are broadcast; many groups are joined by shuffle
        if part.count() * _ROW_BYTES <= broadcast_limit(df.sparkSession):
            part = F.broadcast(part)
        same = [F.col(f"b.{k}").eqNullSafe(F.col(f"p.{k}")) for k in keys]
        above = F.col("p._lo").isNull() | (F.col("b._v") > F.col("p._lo"))
        within = above & (F.col("p._hi").isNull() | (F.col("b._v") < F.col("p._hi")))
        return base.alias("b").join(part.alias("p"), [*same, within]).select("b._v", "p.*")

    while True:
        pending = brackets.where(F.col("_found").isNull())
        wide = pending.where(F.col("_inside") > sort_limit)
        if wide.isEmpty():
            break
        points = F.array(*[F.lit(i / _SLOTS) for i in range(_SLOTS + 1)])
        state = [*groups, "_k", "_inside", "_lo", "_hi"]
        slot = F.floor(F.col("_k") * _SLOTS / F.col("_inside")).cast("int")
        proposed = cut_lineage(
            inside(wide)
            .groupBy(*state)
            .agg(F.percentile_approx("_v", points, F.lit(10 * _SLOTS)).alias("_s"))
            .select(
                *state,
                F.get("_s", F.greatest(slot - 2, F.lit(0))).alias("_a"),
                F.get("_s", F.least(slot + 3, F.lit(_SLOTS))).alias("_b"),
            )
        )
        v, a, b, k = F.col("_v"), F.col("_a"), F.col("_b"), F.col("_k")
        parts = (
            inside(proposed)
            .groupBy(*state, "_a", "_b")
            .agg(
                F.count_if(v < a).alias("_n1"),
                F.count_if(v == a).alias("_n2"),
                F.count_if((v > a) & (v < b)).alias("_n3"),
                F.count_if((v == b) & (a < b)).alias("_n4"),
            )
        )
        n1, n2 = F.col("_n1"), F.col("_n1") + F.col("_n2")
        n3, n4 = n2 + F.col("_n3"), n2 + F.col("_n3") + F.col("_n4")
        nothing = F.lit(None).cast("double")

        def bracket(start: Column, size: Column, lo: Column, hi: Column, found: Column) -> Column:
            return F.struct(
                (k - start).alias("_k"), size.alias("_inside"), lo.alias("_lo"), hi.alias("_hi"), found.alias("_found")
            )

        zero = F.lit(0).cast("bigint")
        chosen = (
            F.when(k < n1, bracket(zero, n1, F.col("_lo"), a, nothing))
            .when(k < n2, bracket(n1, F.col("_n2"), a, a, a))
            .when(k < n3, bracket(n2, F.col("_n3"), a, b, nothing))
            .when(k < n4, bracket(n3, F.col("_n4"), b, b, b))
            .otherwise(bracket(n4, F.col("_inside") - n4, b, F.col("_hi"), nothing))
        )
        narrowed = parts.select(*groups, chosen.alias("_c")).select(*groups, "_c.*")
        brackets = cut_lineage(
            brackets.where(F.col("_found").isNotNull() | (F.col("_inside") <= sort_limit)).unionByName(narrowed)
        )
    small = inside(pending).groupBy(*groups, "_k").agg(F.array_sort(F.collect_list("_v")).alias("_s"))
    found = brackets.where(F.col("_found").isNotNull()).select(*groups, "_found")
    found = found.unionByName(small.select(*groups, F.get("_s", F.col("_k").cast("int")).alias("_found")))
    return found.groupBy(*keys).agg(*[F.max(F.when(F.col("_q") == q, F.col("_found"))).alias(q) for q in ranks])


def report_grid(spark: SparkSession) -> DataFrame:
    """Every phase x method cell: a fixed table of nine rows."""
    cells = [(i, name, m) for i, (name, _, _) in enumerate(PHASES) for m in METHODS]
    return spark.createDataFrame(cells, "ritmo_idx int, volume string, method string")


def latency_report(requests: DataFrame, status: str | None = None, sort_limit: int = SORT_LIMIT) -> DataFrame:
    """min, mean, median, p95 and max per phase and method; cells without requests show nulls.

    Failed requests count unless a ``status`` is asked for. p95 is the value at place
    min(95 n div 100, n - 1), which for n = 100 is one further than the usual percentile.
    """
    if status is not None:
        requests = requests.where(F.col("status") == status)
    keys = ["ritmo_idx", "method"]
    simple = requests.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.min("latency").alias("min"),
        F.avg("latency").alias("mean"),
        F.max("latency").alias("max"),
    )
    ranks = exact_ranks(
        requests,
        keys,
        "latency",
        {
            "_low": lambda n: F.floor((n - 1) / 2),
            "_high": lambda n: F.floor(n / 2),
            "p95": lambda n: F.least(F.floor(n * 95 / 100), n - 1),
        },
        sort_limit,
    )
    measured = simple.join(ranks, keys, "left").withColumn("median", (F.col("_low") + F.col("_high")) / 2)
    return (
        report_grid(requests.sparkSession)
        .join(measured, keys, "left")
        .select(
            "ritmo_idx",
            "volume",
            "method",
            F.coalesce("n", F.lit(0)).alias("n"),
            "min",
            "mean",
            "median",
            "p95",
            "max",
        )
    )


def display(report: DataFrame) -> DataFrame:
    """The report as shown: four digits."""
    shown = {c: rounded(F.col(c)) for c in ("min", "mean", "median", "p95", "max")}
    return report.withColumns(shown)


def total_requests(requests: DataFrame) -> DataFrame:
    return requests.agg(F.count("*").alias("total"))
