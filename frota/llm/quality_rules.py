"""Quality rules as a learned decision list.

Every text is reduced to a few interpretable statistics. Sequential covering learns an ordered list of
threshold conjunctions from labelled statistics: a rule is grown on one part of the rows by adding the
threshold with the best information gain, pruned on the other part, and kept while it is precise enough;
the rows it covers leave and the next rule is sought. The list is emitted as one ordered Spark
conditional expression, so applying it to the corpus is a column expression without Python.

Nulls and empty texts have zero words; they fail the base check. Columns of ``docs`` other than id and
text pass through untouched; statistics are kept in one struct, so their names cannot clash.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from frota.llm.common import WORD, mixed, text_slices

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Further counts for the learned list.
MORE = ("n_chars", "n_upper", "n_digits", "n_punct", "n_bang", "n_bar", "n_ends", "n_lines", "n_distinct", "n_symbol_words")
STATS_TYPE = StructType([StructField(name, LongType()) for name in (*BASE, *MORE)])
#: What rules compare: name, numerator, denominator (None: the count itself).
FEATURES = (
    ("n_words", "n_words", None),
    ("word_length", "word_chars", "n_words"),
    ("symbols_per_word", "n_symbols", "n_words"),
    ("symbol_word_share", "n_symbol_words", "n_words"),
    ("dup_line_share", "n_dup_lines", "n_lines"),
    ("repeat_word_share", "n_repeat_words", "n_words"),
    ("upper_share", "n_upper", "word_chars"),
    ("digit_share", "n_digits", "word_chars"),
    ("punct_share", "n_punct", "word_chars"),
    ("bangs_per_word", "n_bang", "n_words"),
    ("bars_per_word", "n_bar", "n_words"),
    ("sentence_ends_per_word", "n_ends", "n_words"),
    ("distinct_word_share", "n_distinct", "n_words"),
)
_SYMBOLS = "#*$%&|<>"
_WORD = re.compile(WORD)


def repeated_words(ids: np.ndarray, window: int = 5) -> int:
    """Words inside a window of ``window`` words that occurs twice or more, the first one included."""
    n = len(ids) - window + 1
    if n < 2:
        return 0
    # pairs of names are renamed densely, so equal names mean equal windows, without hashing
    name, width = ids[: len(ids) - 1] * (int(ids.max()) + 1) + ids[1:], 2
    while width < window:
        name = np.unique(name, return_inverse=True)[1]
        step = min(width, window - width)
        left, right = name[: len(ids) - width - step + 1], name[step : step + len(ids) - width - step + 1]
        name, width = left * (int(name.max()) + 1) + right, width + step
    _, place, count = np.unique(name, return_inverse=True, return_counts=True)
    again = count[place] > 1
    if not again.any():
        return 0
    steps = np.zeros(len(ids) + 1, np.int64)
    at = np.flatnonzero(again)
    np.add.at(steps, at, 1)
    np.add.at(steps, at + window, -1)
    return int((np.cumsum(steps[:-1]) > 0).sum())


def text_statistics(text: str | None) -> tuple[int, ...]:
    """The counts of one text, in the order of ``BASE`` and ``MORE``."""
    text = text or ""
    words = _WORD.findall(text)
    names: dict[str, int] = {}
    ids = np.fromiter((names.setdefault(w, len(names)) for w in words), np.int64, len(words))
    seen: set[str] = set()
    lines = dup = 0
    for line in text.split("\n"):
        if _WORD.search(line):
            lines += 1
            dup += line in seen
            seen.add(line)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    ascii_counts = np.bincount(codes[codes < 128], minlength=128)
    count = lambda marks: int(sum(ascii_counts[ord(c)] for c in marks))
    upper = int(ascii_counts[65:91].sum())
    for code, n in zip(*np.unique(codes[codes >= 128], return_counts=True), strict=True):
        upper += int(n) if chr(code).isupper() else 0
    return (
        len(words), sum(map(len, words)), count(_SYMBOLS), dup, repeated_words(ids),
        len(codes), upper, int(ascii_counts[48:58].sum()), count("!\"'(),-./:;?[]{}"), count("!"), count("|"),
        count(".!?"), lines, len(names), sum(1 for w in words if w[-1] in _SYMBOLS),
    )


def with_statistics(
    docs: DataFrame, text: str = "text", name: str = "stats", keep: list[str] | None = None
) -> DataFrame:
    """Columns ``keep`` of ``docs`` (default: all) with the counts of its text in the struct ``name``.

    A column that already has that name is replaced.
    """
    docs = docs.drop(name)
    keep = docs.columns if keep is None else keep
    fields = StructType([*(docs.schema[c] for c in keep), StructField(name, STATS_TYPE)])

    def run(batches):
        for batch in batches:
            for part in text_slices(batch, text):
                rows = [text_statistics(t) for t in part.column(text).to_pylist()]
                counts = pa.StructArray.from_arrays(
                    [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=[*BASE, *MORE]
                )
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), counts], names=[*keep, name])

    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(run, fields)


def feature(stats: str, name: str) -> Column:
    """One feature as a column expression; a share of nothing is 0."""
    _, top, bottom = next(f for f in FEATURES if f[0] == name)
    upper = F.col(f"{stats}.{top}").cast("double")
    if bottom is None:
        return upper
    lower = F.col(f"{stats}.{bottom}").cast("double")
    return F.when(lower > 0, upper / lower).otherwise(F.lit(0.0))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, values: pd.DataFrame) -> np.ndarray:
        x = values[self.feature].to_numpy()
        return x >= self.threshold if self.above else x < self.threshold

    def expression(self, stats: str) -> Column:
        x = feature(stats, self.feature)
        return x >= F.lit(self.threshold) if self.above else x < F.lit(self.threshold)


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]
    precision: float
    support: int

    def holds(self, values: pd.DataFrame) -> np.ndarray:
        out = np.ones(len(values), bool)
        for c in self.conditions:
            out &= c.holds(values)
        return out


def _best_condition(values: pd.DataFrame, bad: np.ndarray, taken: np.ndarray) -> tuple[Condition | None, float]:
    """The threshold with the largest gain: bad rows covered x rise of log precision."""
    inside, y = values[taken], bad[taken]
    p0, n0 = int(y.sum()), int((~y).sum())
    if not p0 or not n0:
        return None, 0.0
    before = np.log2(p0 / (p0 + n0))
    best, found = 0.0, None
    for name in values.columns:
        x = inside[name].to_numpy()
        order = np.argsort(x, kind="stable")
        xs, ys = x[order], y[order]
        cut = np.flatnonzero(np.diff(xs) > 0) + 1
        if not len(cut):
            continue
        below = np.cumsum(ys)[cut - 1]
        for above in (False, True):
            p = (p0 - below if above else below).astype(float)
            rows = (len(xs) - cut if above else cut).astype(float)
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(p > 0, p * (np.log2(p / rows) - before), -1.0)
            k = int(gain.argmax())
            if gain[k] > best + 1e-12:
                best = float(gain[k])
                found = Condition(name, above, float((xs[cut[k] - 1] + xs[cut[k]]) / 2))
    return found, best


def learn_rules(
    values: pd.DataFrame, bad: np.ndarray, max_rules: int = 12, max_conditions: int = 4,
    min_precision: float = 0.9, min_support: int = 8,
) -> list[Rule]:
    """Sequential covering over labelled feature rows; each rule predicts "bad".

    Rows alternate between growing and pruning in the given order, so equal input gives equal rules.
    """
    part = np.arange(len(bad)) % 3 == 2
    rest = np.ones(len(bad), bool)
    rules: list[Rule] = []
    while len(rules) < max_rules:
        taken, conditions = rest & ~part, []
        while len(conditions) < max_conditions:
            found, gain = _best_condition(values, bad, taken)
            if found is None or gain <= 0:
                break
            conditions.append(found)
            taken = taken & found.holds(values)
        if not conditions:
            break
        held = values[rest & part]
        held_bad = bad[rest & part]

        def worth(some: list[Condition], held=held, held_bad=held_bad) -> float:
            covered = Rule(tuple(some), 0, 0).holds(held)
            p, n = int((covered & held_bad).sum()), int((covered & ~held_bad).sum())
            return (p - n) / (p + n) if p + n else -1.0

        # drop the last conditions while the rule does no worse on rows it was not grown on
        kept = max(range(1, len(conditions) + 1), key=lambda k: (worth(conditions[:k]), -k))
        rule = Rule(tuple(conditions[:kept]), 0, 0)
        covered = rest & rule.holds(values)
        support, hit = int(covered.sum()), int((covered & bad).sum())
        if support < min_support or (hit + 1) / (support + 2) < min_precision:
            break
        rules.append(Rule(rule.conditions, hit / support, support))
        rest &= ~covered
    return rules


def rule_expression(rules: list[Rule], stats: str = "stats") -> Column:
    """The list as one conditional: number of the first rule that holds, from 1; 0 if none does."""
    out = None
    for number, rule in enumerate(rules, 1):
        test = F.lit(True)
        for c in rule.conditions:
            test = test & c.expression(stats)
        out = F.when(test, F.lit(number)) if out is None else out.when(test, F.lit(number))
    return F.lit(0) if out is None else out.otherwise(F.lit(0))


def base_failed(stats: str = "stats") -> Column:
    """Too short, or more than a fifth of the words in repeated five-word windows."""
    words, repeats = F.col(f"{stats}.n_words"), F.col(f"{stats}.n_repeat_words")
    return (words < 10) | (repeats * 100 > words * 20)


def learned(docs: DataFrame, labels: DataFrame, sample: int = 20_000, text: str = "text", **options) -> list[Rule]:
    """Learn from at most ``sample`` labelled documents, those with the smallest hash of their id.

    ``labels`` has ``doc_id`` and ``quality`` 0 or 1; other values and nulls are not used, nor is a document
    labelled both ways. Rows that fail the base check are left to it.
    """
    marked = (
        labels.where("quality in (0, 1)")
        .groupBy(F.col("doc_id").alias("_id"))
        .agg(F.min("quality").alias("_q"), F.max("quality").alias("_q2"))
        .where("_q = _q2")
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(sample)
    )
    names = [name for name, _, _ in FEATURES]
    chosen = docs.select("doc_id", text).join(F.broadcast(marked), F.col("doc_id") == F.col("_id"))
    rows = (
        with_statistics(chosen, text, "_stats", ["_id", "_q"])
        .where(~base_failed("_stats"))
        .select("_id", "_q", *[feature("_stats", name).alias(name) for name in names])
        .toPandas()
    )
    rows = rows.sort_values(["_id", *names], kind="stable")
    order = np.argsort(mixed(rows["_id"].to_numpy(np.int64).view(np.uint64)), kind="stable")
    rows = rows.iloc[order].reset_index(drop=True)
    return learn_rules(rows[names], rows["_q"].to_numpy() == 0, **options)


def judged(with_stats: DataFrame, rules: list[Rule], stats: str = "stats") -> DataFrame:
    """Adds ``base_failed``, ``rule`` (first that holds, 0: none) and ``kept``."""
    return (
        with_stats.withColumn("base_failed", base_failed(stats))
        .withColumn("rule", rule_expression(rules, stats))
        .withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))
    )
