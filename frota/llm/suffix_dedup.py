"""Removal of repeated byte strings by distributed prefix doubling.

A byte goes if a string of ``threshold`` bytes covers it that also starts earlier in the corpus. Positions get ranks
(64-bit names) of growing lengths: inside a task the name of length 2k at a position is the pair of its name of
length k and the name k further on, up to 64; Spark then sorts names with positions and reranks.

1. Round one sorts a sample that no repeat can slip through: every string of ``threshold`` bytes has one anchor, the
   seed of 32 bytes with the smallest name inside it, which depends on its content only. All starts with the same
   anchor form a run; a run is one row. Runs whose anchor name is unique leave: none of their strings repeats.
2. Runs are reranked by the names at growing offsets that cover their whole extent. Of runs that agree completely all
   but the first are repeats. The first ones leave too, unless other runs share their anchor and differ elsewhere.
3. A string has at least half of what its seed leaves on one side of the seed. So what is left is reranked by the
   pairs (anchor, what follows up to there) and (anchor, what precedes); a side whose pair is unique leaves.
4. For the sides left the ranks of single starts are sorted, as pairs (name of 50 bytes, name of 50 bytes 50 further
   on), which is the threshold: all but the first start of a pair are repeats.

Copies inside one slice of a task are settled there, so a passage with very many copies sends at most one row per
slice to the sort. A null text is empty. Order is by doc_id (nulls last), then by start; where an id is repeated or
null, rows with it are ordered by the hash of their text and then the other columns, and rows that agree in all
columns are one document. Extra columns pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

from frota.llm.common import apart, as_long, byte_texts, mixed, stored, text_slices
from frota.operators.numbering import dense_ids
from frota.session import shuffle_width

SEED = 32
_SLICE = 2 << 20
_PLACE_BITS = np.uint64(24)


def _letters() -> np.ndarray:
    return mixed(mixed(np.arange(256, dtype=np.uint64) + np.uint64(1)), 7)


_LETTERS = _letters()
_STEPS = mixed(np.arange(16, dtype=np.uint64), 3) | np.uint64(1)


def names(data: np.ndarray, lengths: tuple[int, ...]) -> list[np.ndarray]:
    """Names of the given lengths (powers of two) at every position that has that many bytes."""
    name, width, level, out = _LETTERS[data], 1, 0, {}
    while width <= max(lengths):
        if width in lengths:
            out[width] = name
        if len(name) <= width:
            name = name[:0]
        else:
            name = name[:-width] * _STEPS[2 * level] + name[width:] * _STEPS[2 * level + 1]
        width, level = 2 * width, level + 1
    return [out[k] for k in lengths]


def _anchor_of(seed_names: np.ndarray, windows: int) -> np.ndarray:
    """For every position the place of the smallest (leftmost of equal) seed among the next ``windows`` seeds."""
    places = np.arange(len(seed_names), dtype=np.uint64)
    low = mixed(seed_names) >> _PLACE_BITS << _PLACE_BITS | places
    width = 1
    while 2 * width <= windows:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < windows:
        low = np.minimum(low[: -(windows - width)], low[windows - width :])
    return (low & np.uint64((1 << 24) - 1)).astype(np.int64)


def runs(data: np.ndarray, ends: np.ndarray, threshold: int) -> tuple[np.ndarray, ...]:
    """(lo, hi, to_seed, name, context) of all runs in texts laid end to end; ``ends`` are where they end.

    lo and hi are the first and last start of the run, to_seed is how far lo stands before the seed.
    """
    empty = np.zeros(0, np.int64)
    none = empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
    if len(data) < threshold:
        return none
    seed, long_ = names(data, (SEED, 64))
    anchor = _anchor_of(seed, threshold - SEED + 1)
    starts = np.arange(len(anchor))
    inside = np.zeros(len(data) + 1, np.int64)
    begins = np.concatenate([[0], ends[:-1]])
    some = ends - begins >= threshold
    np.add.at(inside, begins[some], 1)
    np.add.at(inside, (ends - threshold + 1)[some], -1)
    starts = starts[np.cumsum(inside[: len(anchor)]) > 0]
    if not len(starts):
        return none
    at = anchor[starts]
    first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)]))
    lo, hi, at = starts[first], starts[np.concatenate([first[1:], [len(starts)]]) - 1], at[first]
    extent = hi - lo + threshold
    shape = ((at - lo) << 16 | (hi - lo)).astype(np.uint64)
    to_seed = at - lo
    context, offset = mixed(long_[lo], shape), 0
    # 64 bytes at offsets that leave no gap, the last one flush with the end
    while (extent - offset > 64).any():
        offset += 64
        context = mixed(context, long_[lo + np.minimum(offset, extent - 64)])
    # 44 bits of the context decide; 10 bits each of what precedes and follows the seed only sort out
    side = (threshold - SEED + 1) // 2
    left, right = seed[np.maximum(at - side, 0)], seed[np.minimum(at + side, len(seed) - 1)]
    own = mixed(context, 5)  # where no string of the run reaches that far
    left = np.where(at - lo >= side, left, own)
    right = np.where(at - hi <= threshold - SEED - side, right, own)
    bits = np.uint64(1023)
    return lo, hi, to_seed, seed[at], context >> np.uint64(20) << np.uint64(20) | (left & bits) << np.uint64(10) | right & bits


def _blocks(keys: list, texts: list[bytes], threshold: int):
    """Texts of a slice laid end to end, and longer ones cut into overlapping blocks: (keys, offsets, data, ends)."""
    short = [i for i, t in enumerate(texts) if threshold <= len(t) <= 4 * _SLICE]
    if short:
        yield (
            np.array([keys[i] for i in short], np.int64), np.zeros(len(short), np.int64),
            np.frombuffer(b"".join(texts[i] for i in short), np.uint8), np.cumsum([len(texts[i]) for i in short]),
        )
    for key, text in zip(keys, texts, strict=True):
        if len(text) > 4 * _SLICE:
            for begin in range(0, len(text) - threshold + 1, _SLICE):
                part = text[begin : begin + _SLICE + threshold - 1]
                yield np.array([key]), np.array([begin]), np.frombuffer(part, np.uint8), np.array([len(part)])


_RUN = "name bigint, context bigint, doc bigint, at bigint, settled boolean"


def _all_runs(docs: DataFrame, threshold: int) -> DataFrame:
    """One row per run; ``at`` is first start << 16 | bytes from it to the seed << 8 | starts - 1. ``settled``: a repeat of a run in the same slice."""

    def work(batches):
        for batch in batches:
            for part in text_slices(batch, "text", _SLICE):
                for keys, offsets, data, ends in _blocks(part.column("doc").to_pylist(), byte_texts(part.column("text")), threshold):
                    lo, hi, to_seed, name, context = runs(data, ends, threshold)
                    if not len(lo):
                        continue
                    which = np.searchsorted(ends, lo, side="right")
                    start = lo - np.concatenate([[0], ends[:-1]])[which] + offsets[which]
                    doc, both = keys[which], mixed(name, context)
                    order = np.lexsort((start, doc, both))
                    again = np.zeros(len(lo), bool)
                    again[order[1:]] = both[order[1:]] == both[order[:-1]]
                    spread = mixed(doc.view(np.uint64), start.view(np.uint64))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(as_long(np.where(again, spread, name))), pa.array(as_long(np.where(again, np.uint64(0), context))),
                            pa.array(doc), pa.array(start << 16 | to_seed << 8 | (hi - lo)), pa.array(again),
                        ],
                        names=["name", "context", "doc", "at", "settled"],
                    )

    return docs.select("doc", "text").mapInArrow(work, _RUN)


def _reranked(batches):
    """Repeats, and first runs whose anchor has other runs too, from runs sorted by (name, context, doc, at).

    Segments may span batches; only the first run of the segment in hand is kept.
    """

    def out(name, context, doc, at, open_):
        columns = [name, context, doc, at, np.full(len(doc), open_)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["name", "context", "doc", "at", "open"])

    last, pending = None, None
    for batch in batches:
        *rows, settled = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
        if settled.any():
            yield out(*(c[settled] for c in rows), False)
            rows = [c[~settled] for c in rows]
        name, context = rows[:2]
        if not len(name):
            continue
        new_name, new_class = np.ones(len(name), bool), np.ones(len(name), bool)
        new_name[1:] = name[1:] != name[:-1]
        new_class[1:] = new_name[1:] | (context[1:] != context[:-1])
        if last is not None:
            new_name[0] = name[0] != last[0]
            new_class[0] = new_name[0] or context[0] != last[1]
        last = name[-1], context[-1]
        yield out(*(c[~new_class] for c in rows), False)
        segment = np.cumsum(new_name)  # 0: goes on from the batch before
        several = np.bincount(segment[new_class & ~new_name], minlength=segment[-1] + 1) > 0
        if pending is not None and several[0]:
            yield out(*pending, True)
            pending = None
        open_ = new_class & several[segment]
        yield out(*(c[open_] for c in rows), True)
        if segment[-1] > 0:
            first = np.flatnonzero(new_name)[-1:]
            pending = None if several[-1] else [c[first] for c in rows]


def _sides(first_runs: DataFrame, threshold: int) -> DataFrame:
    """Round three: (doc, at) of the parts of open runs whose pair with one side occurs in another run too."""
    side = (threshold - SEED + 1) // 2
    keys = {"left": F.shiftrightunsigned("context", 10).bitwiseAND(1023), "right": F.col("context").bitwiseAND(1023)}
    first_runs = first_runs.withColumns(keys)
    for which in keys:
        shared = first_runs.groupBy(F.col("name").alias("_n"), F.col(which).alias("_k")).agg(F.count("*").alias("_c")).where("_c > 1")
        first_runs = (
            first_runs.join(shared, (F.col("name") == F.col("_n")) & (F.col(which) == F.col("_k")), "left")
            .withColumn(f"in_{which}", F.col("_c").isNotNull())
            .drop("_n", "_k", "_c")
        )
    low, to_seed, more = F.shiftright("at", 16), F.shiftright("at", 8).bitwiseAND(255), F.col("at").bitwiseAND(255)
    begin = F.when(F.col("in_left"), low).otherwise(F.greatest(low, low + to_seed - side + 1))
    end = F.when(F.col("in_right"), low + more).otherwise(F.least(low + more, low + to_seed - side))
    return (
        first_runs.where("in_left OR in_right")
        .select("doc", begin.alias("begin"), end.alias("end"))
        .where("end >= begin")
        .select("doc", (F.shiftleft("begin", 16) + F.col("end") - F.col("begin")).alias("at"))
    )


def _spans(at: np.ndarray, threshold: int) -> np.ndarray:
    """Maximal removed spans (begin, end) of repeated starts given as runs."""
    if not len(at):
        return np.zeros((0, 2), np.int64)
    begin = at >> 16
    end = begin + (at & 255) + threshold
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate(end[order])
    first = np.flatnonzero(np.concatenate([[True], begin[1:] > end[:-1]]))
    return np.stack([begin[first], end[np.concatenate([first[1:], [len(begin)]]) - 1]], axis=1)


def cut(text: bytes, spans: np.ndarray) -> bytes:
    """What is left of a text without the spans."""
    at, parts = 0, []
    for begin, end in spans.tolist():
        parts.append(text[at:begin])
        at = end
    parts.append(text[at:])
    return b"".join(parts)


_START = "first bigint, second bigint, doc bigint, start bigint"


def _single_starts(threshold: int):
    """Pairs of names of half the threshold for the single starts of open runs."""
    half = threshold // 2

    def pairs(text: bytes, at: np.ndarray):
        data = np.frombuffer(text, np.uint8)
        begin, many = at >> 16, (at & 255) + 1
        order = np.argsort(begin, kind="stable")
        begin, many = begin[order], many[order]
        for i in range(0, len(at), 2048):
            b, m = begin[i : i + 2048], many[i : i + 2048]
            start = np.repeat(b, m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            low = int(start[0])
            seed = names(data[low : int((b + m).max()) + threshold], (SEED,))[0]
            p, tail = start - low, threshold - SEED
            yield mixed(seed[p], seed[p + half - SEED]), mixed(seed[p + half], mixed(seed[p + half - SEED // 2], seed[p + tail])), start

    def work(batches):
        for batch in batches:
            for part in text_slices(batch, "text", _SLICE):
                docs, parts = part.column("_doc").to_pylist(), part.column("open").to_pylist()
                made = [
                    (first, second, np.full(len(start), doc), start)
                    for doc, text, at in zip(docs, byte_texts(part.column("text")), parts, strict=True)
                    for first, second, start in pairs(text, np.array(at, np.int64))
                ]
                if made:
                    first, second, doc, start = (np.concatenate(c) for c in zip(*made, strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(as_long(first)), pa.array(as_long(second)), pa.array(doc), pa.array(start)],
                        names=["first", "second", "doc", "start"],
                    )

    return work


def _repeated_pairs(batches):
    """All but the first start of each pair, from starts sorted by (first, second, doc, start)."""
    last = None
    for batch in batches:
        first, second, doc, start = (batch.column(i).to_numpy() for i in range(4))
        again = np.zeros(len(first), bool)
        again[1:] = (first[1:] == first[:-1]) & (second[1:] == second[:-1])
        again[0] = last is not None and (first[0], second[0]) == last
        last = first[-1], second[-1]
        yield pa.RecordBatch.from_arrays([pa.array(doc[again]), pa.array(start[again] << 16)], names=["doc", "at"])


def _identified(docs: DataFrame) -> DataFrame:
    """``docs`` with a unique number ``_doc`` in document order; if that is not the id itself, equal rows are one
    and ``_rows`` counts them."""
    odd = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("doc_id IS NULL OR n > 1")
    if odd.isEmpty():
        return docs.withColumn("_doc", F.col("doc_id"))
    each = docs.groupBy(*docs.columns).agg(F.count("*").alias("_rows"))
    each = each.withColumns({"_null": F.col("doc_id").isNull(), "_hash": F.xxhash64("text")})
    others = [c for c in docs.columns if c != "doc_id"]
    return stored(dense_ids(each, ["_null", "doc_id", "_hash", *others], "_doc").drop("_null", "_hash"), "suffix-docs")


def _sorted_map(df: DataFrame, key: str, order: list[str], work, schema: str) -> DataFrame:
    return df.repartition(2 * shuffle_width(df.sparkSession), key).sortWithinPartitions(*order).mapInArrow(work, schema)


def deduplicated(docs: DataFrame, threshold: int = 100, text: str = "text", as_text: bool = False) -> DataFrame:
    """Every row of ``docs`` with ``kept`` (the bytes left), ``spans`` (removed, begin and end), ``n_bytes``,
    ``n_removed`` and ``n_spans`` in place of its text. With ``as_text`` kept is a string; characters of which only
    some bytes are left go. A column of ``docs`` that has one of these five names is replaced, all others are carried,
    whatever they are called."""
    if not 2 * SEED <= threshold <= 128 + SEED:
        raise ValueError("names are laid out for thresholds of 64 to 160 bytes")
    docs, names = apart(docs, "doc_id", text)
    docs = _identified(docs.withColumnRenamed(text, "text"))
    found = stored(
        _sorted_map(
            _all_runs(docs.select(F.col("_doc").alias("doc"), "text"), threshold), "name", ["name", "context", "doc", "at"],
            _reranked, "name bigint, context bigint, doc bigint, at bigint, open boolean",
        ),
        "suffix-runs",
    )
    open_runs = stored(_sides(found.where("open").drop("open"), threshold), "suffix-open")
    # both joins below use the one exchange of the texts, so both must read all its columns
    texts = docs.where("_doc IS NOT NULL").repartition(2 * shuffle_width(docs.sparkSession), "_doc")
    waiting = open_runs.groupBy(F.col("doc").alias("_d")).agg(F.collect_list("at").alias("open"))
    starts = texts.join(waiting.hint("shuffle_hash"), F.col("_doc") == F.col("_d"))
    again = _sorted_map(
        starts.mapInArrow(_single_starts(threshold), _START), "first", ["first", "second", "doc", "start"], _repeated_pairs, "doc bigint, at bigint"
    )
    gone = (
        found.where("NOT open").select("doc", "at").unionByName(again).groupBy(F.col("doc").alias("_d")).agg(F.collect_list("at").alias("_gone"))
    )
    joined = texts.join(gone.hint("shuffle_hash"), F.col("_doc") == F.col("_d"), "left").drop("_d")
    carried = [c for c in docs.columns if c not in ("text", "_doc")]
    schema = StructType(
        [docs.schema[c] for c in carried]
        + [StructField(c, LongType()) for c in ("n_bytes", "n_removed", "n_spans")]
        + [StructField("spans", ArrayType(ArrayType(LongType()))), StructField("kept", StringType() if as_text else BinaryType())]
    )

    def finish(batches):
        for batch in batches:
            for part in text_slices(batch, "text"):
                rows = []
                for body, at in zip(byte_texts(part.column("text")), part.column("_gone").to_pylist(), strict=True):
                    spans = _spans(np.array(at or [], np.int64), threshold)
                    left = cut(body, spans)
                    left = left.decode("utf-8", "ignore") if as_text else left
                    rows.append((len(body), int((spans[:, 1] - spans[:, 0]).sum()), len(spans), spans.tolist(), left))
                kinds = [pa.int64()] * 3 + [pa.list_(pa.list_(pa.int64())), pa.string() if as_text else pa.binary()]
                made = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in carried), *made], names=schema.names
                )

    result = joined.mapInArrow(finish, schema)
    if "_rows" in carried:
        result = result.withColumn("_rows", F.explode(F.sequence(F.lit(1), F.col("_rows").cast("int")))).drop("_rows")
    made = schema.names[-5:]
    return result.select(*(F.col(c).alias(names.get(c, c)) for c in result.columns if c in made or names[c] not in made))
