"""SimHash near-duplicates by covering anchors.

Fingerprints of 64 bits are compared over two blocks of 23 bits with the perfect binary Golay code: every block
lies within 3 bits of exactly one code word, so code-word pairs are anchors that cover all fingerprints. Every
distinct fingerprint has one home, its nearest anchor, and visits every anchor within the covering radius plus the
threshold: the excess over radius 3, summed over the blocks, is at most the threshold. Two fingerprints that differ
in at most that many bits therefore always meet at each other's home, and only home x visitor pairs of one anchor
are compared, on all 64 bits.

Equal fingerprints are one class, so copies are never compared. Where an anchor holds so many fingerprints that
pairs would outnumber the one-bit variants of its members, links come from shared variants instead (two fingerprints
within 2 bits share one), which is exact and linear; anchors with very many homes are also dealt over slices.
Null and word-free texts have fingerprint zero and are linked like any other.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from frota.llm.common import apart, as_long, byte_texts, over_text, stored
from frota.llm.components import components, local_labels
from frota.session import shuffle_width

_BLOCK_BITS, _RADIUS, _BLOCKS = 23, 3, 2
_GENERATOR = 0b101011100011  # of the Golay code
_HOT_HOMES = 20_000
_SHINGLE_BLOCK = 1 << 16


def fingerprint(text: bytes, words_in_shingle: int = 3, seed: int = 42) -> int:
    """Majority of the bits of the shingles' XXH64; words are runs of non-white-space, A-Z lower-cased."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= words_in_shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    starts = [0]
    for w in words:
        starts.append(starts[-1] + len(w) + 1)
    n = len(words) - words_in_shingle + 1
    hashes = np.fromiter(
        (digest(joined[a:b], seed) for a, b in zip(starts, (e - 1 for e in starts[words_in_shingle:]), strict=False)), np.uint64, n
    )
    ones = np.zeros(64, np.int64)
    for i in range(0, n, _SHINGLE_BLOCK):
        part = hashes[i : i + _SHINGLE_BLOCK]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def with_fingerprints(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), words_in_shingle: int = 3) -> DataFrame:
    """Columns ``keep`` and ``fingerprint`` (64 bits as a signed long)."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.array([fingerprint(t, words_in_shingle) for t in byte_texts(batch.column(text))], np.uint64)
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(as_long(found))], names=[*keep, "fingerprint"])

    from pyspark.sql.types import LongType, StructField, StructType

    schema = StructType([*(docs.schema[c] for c in keep), StructField("fingerprint", LongType())])
    return over_text(docs.select(*dict.fromkeys([*keep, text])), work, schema, text)


#: Made once a task; a cache around the function would have executors import this module.
_MADE: dict = {}


def _patterns() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if "patterns" not in _MADE:
        _MADE["patterns"] = _made_patterns()
    return _MADE["patterns"]


def _made_patterns() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Error patterns of up to radius + 2 bits sorted by syndrome, their excess over the radius, and where each
    syndrome begins."""
    bits = np.arange(_BLOCK_BITS)
    found = np.zeros(1, np.int64)
    every = [found]
    for _ in range(_RADIUS + 2):
        found = np.unique((found[:, None] | (1 << bits)[None, :]).ravel())
        every.append(found)
    patterns = np.unique(np.concatenate(every))
    excess = np.maximum(np.bitwise_count(patterns.astype(np.uint64)).astype(np.int64) - _RADIUS, 0)
    syndrome = _syndrome(patterns)
    order = np.lexsort((patterns, excess, syndrome))
    begin = np.searchsorted(syndrome[order], np.arange((1 << 11) + 1))
    return patterns[order], excess[order], begin


def _syndrome(x: np.ndarray) -> np.ndarray:
    """Remainder by the generator polynomial."""
    x = x.astype(np.int64).copy()
    for bit in range(_BLOCK_BITS - 1, 10, -1):
        x ^= np.where(x >> bit & 1, _GENERATOR << (bit - 11), 0)
    return x


def anchors(prints: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, is_home) for all anchors of each fingerprint within the covering radius plus ``threshold``."""
    patterns, excess, begin = _patterns()
    row = np.arange(len(prints))
    anchor, spent = np.zeros(len(prints), np.int64), np.zeros(len(prints), np.int64)
    for block in range(_BLOCKS):
        part = (prints[row] >> np.uint64(block * _BLOCK_BITS) & np.uint64((1 << _BLOCK_BITS) - 1)).astype(np.int64)
        syndrome = _syndrome(part)
        many = begin[syndrome + 1] - begin[syndrome]
        pick = np.repeat(np.arange(len(row)), many)
        at = np.arange(len(pick)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(begin[syndrome], many)
        cost = spent[pick] + excess[at]
        ok = cost <= threshold
        pick, at = pick[ok], at[ok]
        row, spent = row[pick], cost[ok]
        anchor = anchor[pick] << _BLOCK_BITS | (part[pick] ^ patterns[at])
    return row, anchor, spent == 0


def _pairs_of(home: np.ndarray, visit: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of one crowded anchor through shared one-bit variants, reduced to one star per component."""
    nodes = np.unique(np.concatenate([home, visit]))
    flips = np.concatenate([[np.uint64(0)], np.uint64(1) << np.arange(64, dtype=np.uint64)])
    near = np.concatenate([nodes ^ f for f in flips])
    who = np.tile(np.arange(len(nodes)), len(flips))
    order = np.argsort(near, kind="stable")
    near, who = near[order], who[order]
    same = np.flatnonzero(near[1:] == near[:-1])
    label = local_labels(who[same], who[same + 1], len(nodes))
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def _links(batches, threshold: int):
    """Links from rows sorted by (anchor, slice, visitor first or home first); segments may span batches."""

    def compare(anchor, slice_, home, prints):
        change = np.flatnonzero((anchor[1:] != anchor[:-1]) | (slice_[1:] != slice_[:-1])) + 1
        begin = np.concatenate([[0], change])
        end = np.concatenate([change, [len(anchor)]])
        n_home = np.add.reduceat(home.astype(np.int64), begin)
        n_all = end - begin
        pairs = n_home * n_all
        alive = (n_home > 0) & (n_all > 1)
        crowded = alive & (threshold <= 2) & (pairs > 65 * n_all)
        for s in np.flatnonzero(crowded):
            x = prints[begin[s] : end[s]]
            h = home[begin[s] : end[s]]
            yield _pairs_of(x[h], x[~h], threshold)
        # homes are sorted first in their segment: pair k-th home with every row of the segment
        rows = np.flatnonzero(alive & ~crowded)
        for at in np.array_split(rows, max(1, int(pairs[rows].sum()) >> 21)) if len(rows) else []:
            a_n = pairs[at]
            seg = np.repeat(at, a_n)
            k = np.arange(len(seg)) - np.repeat(np.cumsum(a_n) - a_n, a_n)
            a, b = begin[seg] + k // n_all[seg], begin[seg] + k % n_all[seg]
            x, y = prints[a], prints[b]
            near = (np.bitwise_count(x ^ y) <= threshold) & (x != y)
            yield x[near], y[near]

    held = None
    for batch in batches:
        now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
        now = [np.concatenate([h, n]) for h, n in zip(held, now, strict=True)] if held else now
        anchor, slice_ = now[0], now[1]
        last = int(np.flatnonzero((anchor != anchor[-1]) | (slice_ != slice_[-1]))[-1]) + 1 if (anchor[0] != anchor[-1] or slice_[0] != slice_[-1]) else 0
        held = [c[last:] for c in now]
        if last:
            yield from compare(*(c[:last] for c in now[:3]), now[3][:last].view(np.uint64))
    if held and len(held[0]):
        yield from compare(*held[:3], held[3].view(np.uint64))


def near_links(prints: DataFrame, threshold: int = 2) -> DataFrame:
    """Links (a, b) that join exactly the distinct fingerprints connected by steps of at most ``threshold`` bits.

    At a crowded anchor the links form a star per connected group instead of listing all its pairs.
    """
    if threshold > 2:
        raise ValueError("anchors are laid out for thresholds up to 2 bits")

    # a print becomes dozens of visits: spread by count, not by the few bytes they have here
    prints = prints.repartition(2 * shuffle_width(prints.sparkSession), "fingerprint")

    def spread(within: int):
        def run(batches):
            for batch in batches:
                for i in range(0, batch.num_rows, 4096):
                    x = batch.column(0).slice(i, 4096).to_numpy().view(np.uint64)
                    row, anchor, home = anchors(x, within)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(anchor), pa.array(home), pa.array(as_long(x[row]))], names=["anchor", "home", "print"]
                    )

        return prints.mapInArrow(run, "anchor bigint, home boolean, print bigint")

    def meet(batches):
        for a, b in _links(batches, threshold):
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(as_long(a)), pa.array(as_long(b))], names=["a", "b"])

    visits, homes = spread(threshold), spread(0)
    hot = stored(
        homes.groupBy(F.col("anchor").alias("_hot")).agg(F.count("*").alias("_n")).where(F.col("_n") > _HOT_HOMES), "hot-anchors"
    )
    if hot.isEmpty():
        visits = visits.withColumn("slice", F.lit(0))
    else:
        slices = F.ceil(F.coalesce("_n", F.lit(0)) / _HOT_HOMES).cast("int")
        slices = F.greatest(slices, F.lit(1))
        # visitors go to every slice of a hot anchor, each home to one; a home visits the others like anyone else
        visits = (
            visits.join(hot, F.col("anchor") == F.col("_hot"), "left")
            .withColumn("_own", F.pmod(F.xxhash64("print"), slices).cast("int"))
            .withColumn("slice", F.explode(F.sequence(F.lit(0), slices - 1)))
            .withColumn("home", F.col("home") & (F.col("slice") == F.col("_own")))
        )
    dealt = (
        visits.select("anchor", "slice", "home", "print")
        .repartition(4 * shuffle_width(prints.sparkSession), "anchor", "slice")
        .sortWithinPartitions("anchor", "slice", F.col("home").desc())
    )
    return dealt.mapInArrow(meet, "a bigint, b bigint")


def near_groups(prints: DataFrame, threshold: int = 2) -> DataFrame:
    """(fingerprint, label) of distinct fingerprints that have a link; ``label`` is shared by a connected group."""
    labels = components(near_links(prints.select("fingerprint").distinct(), threshold))
    return labels.select(F.col("node").alias("fingerprint"), "label")


def with_components(prints: DataFrame, threshold: int = 2) -> DataFrame:
    """Adds ``label``, shared by a connected group, and ``component_id``, its smallest id (null if it has none), to
    stored (doc_id, fingerprint, ...) rows."""
    classes = stored(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id")), "print-classes")
    groups = near_groups(classes, threshold).withColumnRenamed("fingerprint", "_g")
    labelled = stored(
        classes.join(groups, F.col("fingerprint") == F.col("_g"), "left").drop("_g").withColumn("label", F.coalesce("label", "fingerprint")),
        "print-labels",
    )
    first = labelled.groupBy(F.col("label").alias("_l")).agg(F.min("first_id").alias("component_id"))
    known = labelled.join(first, F.col("label") == F.col("_l")).select(F.col("fingerprint").alias("_f"), "label", "component_id")
    return prints.join(known, F.col("fingerprint") == F.col("_f")).drop("_f")


def representatives(docs: DataFrame, threshold: int = 2, text: str = "text") -> DataFrame:
    """One row of each group of near-duplicates, columns unchanged: the one with the smallest id (nulls last, then by
    the hash of its text); of rows equal in both, any one. Columns may have any names."""
    docs, names = apart(docs, "doc_id", text)
    keyed = docs.withColumn("_hash", F.xxhash64(F.col(text)))
    prints = stored(with_fingerprints(keyed, text, ("doc_id", "_hash")), "prints")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col("_hash").alias("hash"))
    first = with_components(prints, threshold).groupBy("label").agg(F.min(order).alias("m"))
    chosen = first.select(F.col("m.id").alias("_i"), F.col("m.hash").alias("_h"))
    same = lambda: F.col("doc_id").eqNullSafe(F.col("_i")) & (F.col("_hash") == F.col("_h"))
    chosen = stored(
        prints.join(chosen, same()).groupBy("_i", "_h").agg(F.count("*").alias("_n")), "print-chosen"
    )
    kept = keyed.join(chosen, same())
    if not chosen.where("_n > 1").isEmpty():
        kept = kept.where("_n = 1").unionByName(kept.where("_n > 1").dropDuplicates(["_i", "_h"]))
    return kept.select(*docs.columns).toDF(*names.values())
