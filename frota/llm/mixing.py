"""Mixing sources to target token weights by entropy balancing.

Document rates r minimise the relative entropy sum(r log r - r + 1) subject to 0 <= r <= cap and one token
constraint per source, sum(size * r) = target. The optimum is an exponentially tilted rate,
r = min(cap, exp(lambda * size / mean size)), with one multiplier per source. The convex dual is solved by
Newton steps, safeguarded by a bracket: each step is one partially aggregated sum over the histogram
(source, size), never over a whole source in one task. Rates are then rounded to whole copies: a document gets
the upper of its two neighbouring counts if a pseudo-random key lies below a threshold of its source, the
threshold is narrowed by histograms until one document decides, and a few single moves take up the rest.

Everything is DataFrame code; the state, one row per source, is a stored table that Spark joins (and
broadcasts only below its own size threshold). Null texts have size 0; a null source is a source of its own,
ordered last. Documents of size 0 get one copy. Rows that agree in id, source and size are treated alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from frota.llm.common import WORD, apart, stored
from frota.operators.numbering import dense_ids

_BINS = 64


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, weights: tuple[int, ...], most: float) -> DataFrame:
    """Adds ``weight`` and ``target`` to (source, source_size).

    The sum of all sizes is shared by weight; no target exceeds ``most`` times its source's size, and what is
    above is shared again. The common share per weight is found from sums alone.
    """
    ordered = dense_ids(sources.withColumn("_null", F.col("source").isNull()), ["_null", "source"], "_place")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("_place") % len(weights) + 1).cast("int"))
    sources = stored(ordered.drop("_null").withColumn("weight", weight), "mix-sources")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    share = 0.0
    while True:
        full = F.col("source_size") * F.lit(most) < F.lit(share) * F.col("weight")
        row = sources.agg(
            F.sum(F.when(full, F.col("source_size") * most).otherwise(0.0)).alias("fixed"),
            F.sum(F.when(~full, F.col("weight")).otherwise(0)).alias("open"),
        ).first()
        if not row.open:
            break
        better = (total - row.fixed) / row.open
        if better <= share * (1 + 1e-15):
            break
        share = better
    return sources.withColumn("target", F.least(F.col("source_size") * most, F.lit(share) * F.col("weight"))).drop("_place")


def _rate(cap: float) -> Column:
    """Bounded exponential tilt of a document; an infinite multiplier means the bound itself."""
    return F.when(F.col("size") == 0, F.lit(1.0)).otherwise(
        F.least(F.lit(cap), F.exp(F.col("lambda") * F.col("size") / F.col("mean_size")))
    )


def solve_multipliers(
    histogram: DataFrame, sources: DataFrame, cap: float, tolerance: float = 1e-9, max_steps: int = 60
) -> DataFrame:
    """Newton on the dual: (source, ..., mean_size, lambda). ``histogram`` has (source, size, n)."""
    state = sources.withColumns(
        {
            "mean_size": F.greatest(F.col("source_size") / F.col("n_docs"), F.lit(1e-9)),
            "lambda": F.when(F.col("target") >= F.col("source_size") * cap, F.lit(float("inf"))).otherwise(F.lit(0.0)),
            "low": F.lit(float("-inf")),
            "high": F.lit(float("inf")),
            "done": (F.col("target") >= F.col("source_size") * cap) | (F.col("source_size") == 0),
        }
    )
    state = stored(state, "mix-dual")
    for _ in range(max_steps):
        if state.where("not done").isEmpty():
            break
        open_ = state.where("not done")
        rate = _rate(cap)
        sums = (
            histogram.join(open_.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
            .withColumn("words", F.col("n") * F.col("size") * rate)
            .groupBy("source")
            .agg(
                F.sum("words").alias("reached"),
                F.sum(F.when(rate < cap, F.col("words") * F.col("size") / F.col("mean_size")).otherwise(0.0)).alias("slope"),
            )
            .withColumnRenamed("source", "_s")
        )
        state = state.join(sums, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
        gap = F.col("reached") - F.col("target")
        state = state.withColumns(
            {
                "low": F.when(gap < 0, F.col("lambda")).otherwise(F.col("low")),
                "high": F.when(gap > 0, F.col("lambda")).otherwise(F.col("high")),
                "close": F.abs(gap) <= F.col("target") * tolerance,
                "step": F.when(F.col("slope") > 0, F.col("lambda") - gap / F.col("slope")),
            }
        )
        inside = (F.col("step") > F.col("low")) & (F.col("step") < F.col("high"))
        # without a usable Newton step: halve the bracket, or widen it while one end is open
        fallback = (
            F.when(F.col("low") == float("-inf"), F.col("high") * 2 - 1)
            .when(F.col("high") == float("inf"), F.col("low") * 2 + 1)
            .otherwise((F.col("low") + F.col("high")) / 2)
        )
        state = state.withColumns(
            {
                "lambda": F.when(F.col("done") | F.col("close"), F.col("lambda"))
                .when(inside & (F.abs(F.col("step") - F.col("lambda")) < 8), F.col("step"))
                .otherwise(fallback),
                "done": F.col("done") | F.coalesce("close", F.lit(False)),
            }
        ).drop("reached", "slope", "close", "step")
        state = stored(state, "mix-dual")
    return state.drop("low", "high", "done")


def _rounded(units: DataFrame, sources: DataFrame, cap: float, passes: int, moves: int) -> DataFrame:
    """Whole copies per unit: floor, or one more where the key lies below the threshold of its source."""
    key = F.pmod(F.xxhash64("doc_id", "source", "size"), F.lit(1 << 40)) / float(1 << 40)
    rate = _rate(cap)
    units = units.join(sources.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).withColumn("rate", rate)
    units = stored(
        units.select(
            "doc_id", "source", "size", "n", "rate",
            F.floor("rate").alias("base"),
            F.when(F.col("rate") > F.floor("rate"), F.col("n") * F.col("size")).otherwise(0).alias("more"),
            (key - (F.col("rate") - F.floor("rate"))).alias("key"),
        ),
        "mix-rates",
    )
    state = sources.join(
        units.groupBy(F.col("source").alias("_s")).agg(F.sum(F.col("n") * F.col("size") * F.col("base")).alias("words")),
        F.col("source").eqNullSafe(F.col("_s")),
    ).drop("_s").withColumns({"low": F.lit(-1.0), "high": F.lit(1.0)})
    state = stored(state, "mix-threshold")
    for _ in range(passes):
        bounds = state.select(F.col("source").alias("_s"), "low", "high")
        place = F.floor((F.col("key") - F.col("low")) / (F.col("high") - F.col("low")) * _BINS)
        bins = (
            units.join(bounds, F.col("source").eqNullSafe(F.col("_s")))
            .withColumn("bin", place)
            .where(F.col("bin").between(0, _BINS - 1))
            .groupBy("source", "bin")
            .agg(F.sum("more").alias("more"))
        )
        upto = Window.partitionBy("source").orderBy("bin")
        crossed = (
            bins.withColumn("after", F.sum("more").over(upto))
            .withColumnRenamed("source", "_s")
            .join(state.select(F.col("source").alias("_t"), "target", "words"), F.col("_s").eqNullSafe(F.col("_t")))
            .where("words + after >= target")
            .groupBy("_s")
            .agg(F.min_by(F.struct("bin", "more", "after"), "bin").alias("at"))
        )
        width = (F.col("high") - F.col("low")) / _BINS
        state = (
            state.join(crossed, F.col("source").eqNullSafe(F.col("_s")), "left")
            .withColumn("new_low", F.when(F.col("at").isNull(), F.col("low")).otherwise(F.col("low") + F.col("at.bin") * width))
            .withColumns(
                {
                    "words": F.when(F.col("at").isNull(), F.col("words")).otherwise(F.col("words") + F.col("at.after") - F.col("at.more")),
                    "high": F.when(F.col("at").isNull(), F.col("high")).otherwise(F.col("new_low") + width),
                    "low": F.col("new_low"),
                }
            )
            .drop("_s", "at", "new_low")
        )
        state = stored(state, "mix-threshold")
    # the last bracket is decided as a whole: with it or without, whichever is nearer
    bounds = state.select(F.col("source").alias("_s"), "low", "high", "target", "words")
    last = (
        units.join(bounds, F.col("source").eqNullSafe(F.col("_s")))
        .where("key >= low and key < high")
        .groupBy("_s")
        .agg(F.sum("more").alias("inside"))
    )
    state = state.join(last, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s").withColumn("inside", F.coalesce("inside", F.lit(0)))
    take = F.abs(F.col("words") + F.col("inside") - F.col("target")) < F.abs(F.col("words") - F.col("target"))
    state = state.withColumns(
        {
            "threshold": F.when(take, F.col("high")).otherwise(F.col("low")),
            "words": F.when(take, F.col("words") + F.col("inside")).otherwise(F.col("words")),
        }
    )
    state = stored(state.drop("inside", "low", "high"), "mix-threshold")
    limits = state.select(F.col("source").alias("_s"), "threshold")
    units = stored(
        units.join(limits, F.col("source").eqNullSafe(F.col("_s")))
        .withColumn("copies", F.col("base") + F.when((F.col("more") > 0) & (F.col("key") < F.col("threshold")), 1).otherwise(0))
        .select("doc_id", "source", "size", "n", "rate", "copies", "key"),
        "mix-copies",
    )
    gaps = state.select(F.col("source").alias("_s"), (F.col("target") - F.col("words")).alias("gap"))
    for _ in range(moves):
        words = F.col("n") * F.col("size")
        can = (words > 0) & (words <= F.abs("gap")) & F.when(F.col("gap") > 0, F.col("copies") < int(cap)).otherwise(F.col("copies") > 0)
        step = (
            units.join(gaps, F.col("source").eqNullSafe(F.col("_s")))
            .where(can)
            .groupBy("_s")
            .agg(F.max(F.struct(words.alias("words"), "key", "doc_id", "size", F.signum("gap").cast("int").alias("way"))).alias("m"))
            .select("_s", "m.*")
        )
        step = stored(step, "mix-moves")
        if step.isEmpty():
            break
        units = _with_moves(units, step)
        gaps = stored(
            gaps.join(step.select(F.col("_s").alias("_t"), "words", "way"), F.col("_s").eqNullSafe(F.col("_t")), "left")
            .withColumn("gap", F.col("gap") - F.coalesce(F.col("words") * F.col("way"), F.lit(0)))
            .select("_s", "gap"),
            "mix-gaps",
        )
    return units


def _with_moves(units: DataFrame, step: DataFrame) -> DataFrame:
    step = step.select(F.col("_s").alias("_ms"), F.col("doc_id").alias("_md"), F.col("size").alias("_mz"), F.col("way"))
    return (
        units.join(
            step,
            F.col("source").eqNullSafe(F.col("_ms")) & F.col("doc_id").eqNullSafe(F.col("_md")) & (F.col("size") == F.col("_mz")),
            "left",
        )
        .withColumn("copies", F.col("copies") + F.coalesce("way", F.lit(0)))
        .drop("_ms", "_md", "_mz", "way")
    )


def mix(
    docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: float = 3.0, passes: int = 5, moves: int = 4,
    text: str = "text",
) -> DataFrame:
    """One row per (doc_id, source, size) with ``n`` rows behind it, its ``rate``, whole ``copies`` and its
    source's ``source_size`` and ``target``."""
    units = stored(
        docs.select("doc_id", "source", word_count(text).alias("size")).groupBy("doc_id", "source", "size").agg(F.count("*").alias("n")),
        "mix-units",
    )
    histogram = stored(units.groupBy("source", "size").agg(F.sum("n").alias("n")), "mix-histogram")
    sources = histogram.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum("n").alias("n_docs"))
    sources = solve_multipliers(histogram, source_targets(sources, weights, cap), cap)
    copies = _rounded(units, sources, cap, passes, moves)
    known = sources.select(F.col("source").alias("_s"), "source_size", "target")
    return copies.join(known, F.col("source").eqNullSafe(F.col("_s"))).drop("_s", "key")


def repeated(docs: DataFrame, mixed: DataFrame, text: str = "text") -> DataFrame:
    """The mix itself: each row of ``docs`` as often as its copies say, columns unchanged, whatever they are called."""
    docs, names = apart(docs, "doc_id", "source", text)
    columns = docs.columns
    counts = mixed.select(F.col("doc_id").alias("_d"), F.col("source").alias("_s"), F.col("size").alias("_z"), F.col("copies").alias("_c")).where("_c > 0")
    return (
        docs.withColumn("_size", word_count(text))
        .join(counts, F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("source").eqNullSafe(F.col("_s")) & (F.col("_size") == F.col("_z")))
        .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_c").cast("int"))))
        .select(*columns)
        .toDF(*names.values())
    )
