"""Phrases worth knowing, by stripes: each prefix keys an associative counter of its next words.

Texts are read once into blocks of whole word numbers per language. Level by level (prefixes of 0 to ``longest`` - 1 words)
every block turns its prefixes into stripes: the words that follow a prefix, how often each does, and how often the prefix occurs at
all, followed or not. Stripes of one prefix meet in one task and are merged element by element. A merged stripe gives three things:
the extensions that are frequent (the next level's prefixes), the prefix's total (what the parts of a cut are worth; that of the empty
prefix is the number of words), and the largest count of an extension, which decides whether the prefix itself is contained in an equally
frequent longer phrase; the same maxima over phrases that end alike decide for extensions to the left. One more word to either
side is enough, as counts can only fall with every added word.

A phrase can only be frequent if both phrases that lack its first or last word are, so from pairs on blocks learn which of their phrases
were frequent, and the next level looks at nothing else. What is left of a block shrinks from level to level.

Prefixes are dealt to buckets, one for about ``BUCKET_WORDS`` words of input, and a block's stripes of one bucket travel in one row. A prefix
found more than ``SLICE_WORDS`` times, as the empty one, has its stripes cut by next word into parts of about so many occurrences, which are
dealt and merged apart; so what a task holds is bounded, and rows are never more than stripes. Blocks know the counts of their prefixes, so all of them
cut alike; single words to be cut are told to all tasks, at most ``HOT_WORDS`` (beyond ``HOT_WORDS`` * ``SLICE_WORDS`` words of input the
parts grow instead). Answers name a block's phrases by their numbers there, many in a row. Phrases travel as text, so no two
ever meet by chance.

Defined results: null text is empty, null language is ``und``; an empty table gives no rows. Repeated rows count as often as they occur;
ids play no part. Columns other than the named ones play no part. Counts are 64-bit, scores are computed with 38 digits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from itertools import islice
from zlib import crc32

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window, functions as F

from frota.llm.common import byte_texts, stored, text_slices
from frota.session import shuffle_width

#: Words of one block; a block belongs to one task and one language.
BLOCK_WORDS = 1_000_000
BUCKET_WORDS, SLICE_WORDS, HOT_WORDS = 1_000_000, 500_000, 100_000
#: Piece separators become line feeds, A-Z lower case; blanks and tabs separate words.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else 10 if c in b".,;:!?\n\x0b\x0c\r" else c for c in range(256))

#: Texts and numbers are compressed. Words are joined by blanks, phrases by tabs, which no word holds; vocabularies are sorted. ``names``
#: and ``grams`` are left out as long as the known phrases are the words.
_STATE = "block bigint, lang string, vocabulary binary, words binary, names binary, totals binary, grams binary"
_STATE_TYPES = [pa.int64(), pa.string(), *[pa.binary()] * 5]
#: The stripes of one block in one bucket. ``texts`` has their prefixes, a line feed and all next words; ``numbers`` four 32-bit numbers a
#: stripe (its slice, how often the prefix occurs, the number of its first entry in the block, its length) and then one a next word.
_STRIPES = "bucket bigint, block bigint, lang string, n int, texts binary, numbers binary"
#: Either a merged stripe, or an answer to a block: the numbers of its entries that are frequent, and their counts.
_MERGED = "lang string, prefix string, total bigint, nexts array<string>, counts array<bigint>, block bigint, entries binary, ns binary"
_MERGED_TYPES = [pa.string(), pa.string(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.int64(), pa.binary(), pa.binary()]


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def pieces(text: bytes) -> list[list[bytes]]:
    """The words of each piece of a text."""
    return [words for piece in text.translate(_FOLD).split(b"\n") if (words := piece.split())]


class _Language:
    """The words of one language that a task has read: numbers, with -1 after every piece."""

    def __init__(self):
        self.vocabulary: dict[bytes, int] = {}
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, text: bytes) -> None:
        number = self.vocabulary
        flat: list[int] = []
        for words in pieces(text):
            flat += [number.setdefault(w, len(number)) for w in words]
            flat.append(-1)
        self.parts.append(np.array(flat, np.int32))
        self.size += len(flat)

    def row(self, block: int, lang: str) -> pa.RecordBatch:
        words = np.concatenate(self.parts)
        names = sorted(self.vocabulary)
        number = np.full(len(names) + 1, -1, np.int32)
        number[[self.vocabulary[n] for n in names]] = np.arange(len(names))
        return _batch(
            _STATE, _STATE_TYPES, 1, block=[block], lang=[lang], vocabulary=[_zipped(b" ".join(names))], words=[_zipped(number[words])]
        )


def _batch(schema: str, types: list[pa.DataType], n: int, **columns) -> pa.RecordBatch:
    """A batch of ``n`` rows; columns that are not given are null."""
    arrays = []
    for name, of in zip(_names(schema), types, strict=True):
        values = columns.get(name)
        arrays.append(pa.nulls(n, of) if values is None else values if isinstance(values, pa.Array) else pa.array(values, of))
    return pa.RecordBatch.from_arrays(arrays, names=_names(schema))


def _zipped(data: bytes | np.ndarray) -> bytes:
    """Text, or numbers as they are."""
    return zstandard.ZstdCompressor(level=1).compress(data if isinstance(data, bytes) else np.ascontiguousarray(data).tobytes())


def _unzipped(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _numbers(data: bytes, kind: type = np.int32) -> np.ndarray:
    return np.frombuffer(_unzipped(data), kind)


def _joined(words: pa.Array, by: str) -> bytes:
    whole = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words)
    return pa.compute.binary_join(whole, by)[0].as_py().encode()


def _split(text: bytes, by: str) -> pa.Array:
    return pa.compute.split_pattern(pa.array([text], pa.string()), by).flatten()


def encoded(docs: DataFrame, text: str = "text", lang: str = "lang", block_words: int = BLOCK_WORDS) -> DataFrame:
    """Blocks of word numbers: states that know no phrase but the empty one."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 33
        held: dict[str, _Language] = {}
        for batch in batches:
            for part in text_slices(batch, "text"):
                for of, value in zip(part.column("lang").to_pylist(), byte_texts(part.column("text")), strict=True):
                    held.setdefault(of, _Language()).add(value)
                # the fullest languages leave first
                while held and sum(x.size for x in held.values()) >= block_words:
                    of = max(held, key=lambda x: held[x].size)
                    yield held.pop(of).row(number, of)
                    number += 1
        for of, words in held.items():
            if words.vocabulary:
                yield words.row(number, of)
                number += 1

    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(read, _STATE)


@dataclass
class Cut:
    """How stripes are dealt: the number of buckets, the size of a part, and per language the words that are cut, with their counts."""

    n_buckets: int
    slice_words: int
    hot: dict[str, dict[str, int]] = field(default_factory=dict)


class State:
    """A block that knows its frequent phrases of ``k`` words: word numbers, and which of the phrases (if any) begins at each place."""

    def __init__(self, row: dict, k: int, cut: Cut):
        self.cut = cut
        self.block, self.lang, self.k = row["block"], row["lang"], k
        self.vocabulary, self.words = _split(_unzipped(row["vocabulary"]), " "), _numbers(row["words"])
        if k == 0:
            self.names, self.grams, self.slices = pa.array([""]), np.where(self.words >= 0, 0, -1), np.array([cut.n_buckets])
        elif k == 1:
            self.names, self.grams, self.slices = self.vocabulary, self.words, np.ones(len(self.vocabulary), np.int64)
            hot = cut.hot.get(self.lang, {})
            at = pa.compute.index_in(pa.array(list(hot), pa.string()), self.vocabulary).to_pylist()
            for place, n in zip(at, hot.values(), strict=True):
                if place is not None:
                    self.slices[place] = -(-n // cut.slice_words)
        else:
            self.names, self.grams = _split(_unzipped(row["names"]), "\t"), _numbers(row["grams"])
            self.slices = -(-_numbers(row["totals"], np.int64) // cut.slice_words)

    def extensions(self) -> np.ndarray:
        """Per place prefix * (size of the vocabulary) + next word of the phrase of ``k`` + 1 words there, -1 for none.

        Without its first word the phrase has to be known too.
        """
        k = self.k
        if k == 0:
            return self.words.astype(np.int64)
        out = np.full(len(self.words), -1, np.int64)
        if len(self.words) > k:
            prefix, after, rest = self.grams[:-k], self.words[k:], self.grams[1 : len(self.words) - k + 1]
            keep = (prefix >= 0) & (after >= 0) & (rest >= 0)
            out[:-k] = np.where(keep, prefix.astype(np.int64) * len(self.vocabulary) + after, -1)
        return out

    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(prefix, slice, next word, count) of every entry of the block's stripes, in the order that numbers them."""
        keys = self.extensions()
        keys, counts = np.unique(keys[keys >= 0], return_counts=True)
        prefix, after = np.divmod(keys, len(self.vocabulary))
        slice_ = np.zeros(len(keys), np.int64)
        cut = np.flatnonzero(self.slices[prefix] > 1)
        if len(cut):
            words, place = np.unique(after[cut], return_inverse=True)
            slice_[cut] = _crc(self.vocabulary.take(pa.array(words)))[place] % self.slices[prefix[cut]]
            order = np.lexsort((after, slice_, prefix))
            prefix, after, counts, slice_ = prefix[order], after[order], counts[order], slice_[order]
        return prefix, slice_, after, counts

    def stripes(self) -> pa.RecordBatch:
        """All stripes of the block, one row a bucket."""
        prefix, slice_, after, counts = self.entries()
        here = np.bincount(self.grams[self.grams >= 0], minlength=len(self.names))
        begins = np.flatnonzero((np.diff(prefix, prepend=-1) != 0) | (np.diff(slice_, prepend=-1) != 0))
        sizes = np.diff(np.append(begins, len(prefix)))
        # the first stripe of a prefix has its total; prefixes that nothing follows still count
        first = np.diff(prefix[begins], prepend=-1) != 0
        alone = np.setdiff1d(np.flatnonzero(here), prefix[begins])
        of = np.concatenate([prefix[begins], alone])
        total = np.where(np.concatenate([first, np.ones(len(alone), bool)]), here[of], 0)
        none = np.zeros(len(alone), np.int64)
        which, begins, sizes = (np.concatenate([x, none]) for x in (slice_[begins], begins, sizes))
        bucket = (_crc(self.names)[of] + which) % self.cut.n_buckets
        order = np.argsort(bucket, kind="stable")
        of, which, begins, sizes, total = (x[order] for x in (of, which, begins, sizes, total))
        buckets, at = np.unique(bucket[order], return_index=True)
        at = np.append(at, len(of))
        entry = np.repeat(begins - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        ends = np.concatenate([[0], np.cumsum(sizes)])[at]
        heads = np.stack([which, total, begins, sizes], axis=1).astype(np.int32)
        counts = counts[entry].astype(np.int32)
        prefixes = _joined_by(self.names.take(pa.array(of)), at, "\t")
        nexts = _joined_by(self.vocabulary.take(pa.array(after[entry])), ends, " ")
        texts = pa.compute.binary_join_element_wise(prefixes, nexts, "\n").cast(pa.binary()).to_pylist()
        numbers = [np.concatenate([heads[a:b].ravel(), counts[c:d]]) for a, b, c, d in zip(at, at[1:], ends, ends[1:], strict=False)]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(buckets), pa.array(np.full(len(buckets), self.block)), pa.array([self.lang] * len(buckets), pa.string()),
                pa.array(np.diff(at), pa.int32()), pa.array([_zipped(t) for t in texts], pa.binary()),
                pa.array([_zipped(x) for x in numbers], pa.binary()),
            ],
            names=_names(_STRIPES),
        )

    def followed(self, entries: np.ndarray, totals: np.ndarray) -> dict:
        """The block with its frequent phrases of ``k`` + 1 words, and without the places outside of them (all but one of a run)."""
        prefix, _, after, _ = self.entries()
        prefix, after = prefix[entries], after[entries]
        known = prefix * len(self.vocabulary) + after
        order = np.argsort(known)
        known, prefix, after = known[order], prefix[order], after[order]
        keys = self.extensions()
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        alive = (keys >= 0) & (known[at] == keys)
        covered = np.zeros(len(keys), bool)
        for step in range(self.k + 1):
            covered[step:] |= alive[: len(alive) - step]
        keep = covered | np.concatenate([[False], covered[:-1]])
        words, grams = np.where(covered, self.words, -1)[keep], np.where(alive, at, -1)[keep]
        used = np.unique(words[words >= 0])
        names = pa.compute.binary_join_element_wise(self.names.take(pa.array(prefix)), self.vocabulary.take(pa.array(after)), " ")
        return {
            "block": self.block, "lang": self.lang, "vocabulary": _zipped(_joined(self.vocabulary.take(pa.array(used)), " ")),
            "words": _zipped(np.where(words >= 0, np.searchsorted(used, words), -1).astype(np.int32)), "totals": _zipped(totals[order]),
            "names": _zipped(_joined(names, "\t")), "grams": _zipped(grams.astype(np.int32)),
        }


def _crc(words: pa.Array) -> np.ndarray:
    return np.array([crc32(w.encode()) for w in words.to_pylist()], np.int64)


def _joined_by(words: pa.Array, ends: np.ndarray, by: str) -> pa.Array:
    return pa.compute.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), words), by)


def stripes(states: DataFrame, k: int, cut: Cut) -> DataFrame:
    """The stripes of every block, for prefixes of ``k`` words."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield State(batch.slice(i, 1).to_pylist()[0], k, cut).stripes()

    return states.mapInArrow(read, _STRIPES)


def next_states(states: DataFrame, told: DataFrame, k: int, cut: Cut) -> DataFrame:
    """The blocks that hold a frequent phrase of ``k`` + 1 words; ``told`` has (block, entries, ns)."""

    def follow(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        none = np.zeros(0, np.int64)
        entries = np.concatenate([none, *(np.cumsum(_numbers(x)) for x in answers.column("entries").to_pylist())])
        ns = np.concatenate([none, *(_numbers(x, np.int64) for x in answers.column("ns").to_pylist())])
        made = [State(row, k, cut).followed(entries, ns) for row in blocks.to_pylist() if len(entries)]
        return pa.Table.from_pylist(made, pa.schema(list(zip(_names(_STATE), _STATE_TYPES, strict=True))))

    return states.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(follow, _STATE)


def merged(found: DataFrame, least: int, answered: bool = True) -> DataFrame:
    """One row per prefix (and slice) with its total and its extensions with at least ``least`` occurrences, and the answers to the blocks."""

    def merge(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches(list(islice(_merge(table.combine_chunks(), least), 1 + answered)))

    return found.groupBy("bucket").applyInArrow(merge, _MERGED)


def _merge(table: pa.Table, least: int) -> Iterator[pa.RecordBatch]:
    """The stripes of one bucket: equal prefixes and slices are one group, equal next words of a group one element."""
    columns = {name: table.column(name).combine_chunks() for name in table.column_names}
    n = columns["n"].to_numpy()
    row = np.repeat(np.arange(len(n)), n)
    numbers = [_numbers(x) for x in columns["numbers"].to_pylist()]
    which, total, first, sizes = np.concatenate([x[: 4 * m].reshape(-1, 4) for x, m in zip(numbers, n, strict=True)]).T.astype(np.int64)
    counts = np.concatenate([x[4 * m :] for x, m in zip(numbers, n, strict=True)]).astype(np.int64)
    texts = [_unzipped(x).split(b"\n") for x in columns["texts"].to_pylist()]
    prefixes = _split(b"\t".join(t[0] for t in texts), "\t").dictionary_encode()
    words = _split(b" ".join(t[1] for t in texts if t[1]), " ").dictionary_encode()
    langs = columns["lang"].dictionary_encode()
    name = prefixes.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    lang = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)[row]
    _, at, group = np.unique((name * len(langs.dictionary) + lang) * (which.max(initial=0) + 1) + which, return_index=True, return_inverse=True)

    n_words = max(len(words.dictionary), 1)
    stripe = np.repeat(np.arange(len(row)), sizes)
    # no words at all leave one empty text
    key = group[stripe] * n_words + words.indices.to_numpy(zero_copy_only=False)[: len(stripe)]
    order = np.argsort(key, kind="stable")
    begins = np.flatnonzero(np.diff(key[order], prepend=-1))
    sums = np.add.reduceat(counts[order], begins) if len(begins) else np.zeros(0, np.int64)
    often = np.flatnonzero(sums >= least)
    of, after = np.divmod(key[order[begins[often]]], n_words)
    offsets = pa.array(np.searchsorted(of, np.arange(len(at) + 1)), pa.int32())
    nexts = pa.ListArray.from_arrays(offsets, words.dictionary.take(pa.array(after)))
    totals = np.zeros(len(at), np.int64)
    np.add.at(totals, group, total)
    yield _batch(
        _MERGED, _MERGED_TYPES, len(at), lang=langs.dictionary.take(pa.array(lang[at])), prefix=prefixes.dictionary.take(pa.array(name[at])),
        total=totals, nexts=nexts, counts=pa.ListArray.from_arrays(offsets, pa.array(sums[often])),
    )

    # the entries behind each frequent extension, one after the other, by block
    size = np.diff(np.append(begins, len(order)))[often]
    entry = order[np.repeat(begins[often] - np.cumsum(size) + size, size) + np.arange(size.sum())]
    place = np.arange(len(stripe)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    numbers, ns = (first[stripe[entry]] + place[entry]).astype(np.int32), np.repeat(sums[often], size)
    of = row[stripe[entry]]
    by_row = np.lexsort((numbers, of))
    rows, at = np.unique(of[by_row], return_index=True)
    numbers, ns = np.split(numbers[by_row], at[1:]), np.split(ns[by_row], at[1:])
    yield _batch(
        _MERGED, _MERGED_TYPES, len(rows), block=columns["block"].take(pa.array(rows)),
        entries=[_zipped(np.diff(x, prepend=np.int32(0))) for x in numbers[: len(rows)]], ns=[_zipped(x) for x in ns[: len(rows)]],
    )


def mined(
    docs: DataFrame, least: int = 100, longest: int = 5, most: int = 2000, text: str = "text", lang: str = "lang", block_words: int = BLOCK_WORDS
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): per language the ``most`` phrases of 2 to ``longest`` words with the highest score.

    a counts the phrase, l and r the two parts of its lowest-scoring cut, n all words; phrases found less than ``least`` times, and those
    inside a longer one that is as frequent, are left out.
    """
    states = stored(encoded(docs, text, lang, block_words), "word-blocks")
    # every block but a task's last few is full
    n_buckets = max(shuffle_width(docs.sparkSession), states.count() * block_words // BUCKET_WORDS)
    cut = Cut(n_buckets, SLICE_WORDS)
    first = stored(merged(stripes(states, 0, cut), least, answered=False), "merged-0")
    n_words = first.groupBy("lang").agg(F.sum("total").alias("words"))
    cut = Cut(n_buckets, max(SLICE_WORDS, (n_words.agg(F.sum("words")).first()[0] or 0) // HOT_WORDS))
    words = first.select("lang", F.expr("inline(arrays_zip(nexts, counts)) AS (word, n)"))
    for row in words.where(F.col("n") > cut.slice_words).collect():
        cut.hot.setdefault(row.lang, {})[row.word] = row.n
    levels = []
    for k in range(1, longest):
        found = stored(merged(stripes(states, k, cut), least, k + 1 < longest), f"merged-{k}")
        levels.append(found.where("prefix IS NOT NULL"))
        answers = found.where("block IS NOT NULL").select("block", "entries", "ns")
        if k + 1 == longest or answers.isEmpty():
            break
        states = stored(next_states(states, answers, k, cut), f"states-{k + 1}")
    return _ranked(levels, n_words, most)


def _ranked(levels: list[DataFrame], n_words: DataFrame, most: int) -> DataFrame:
    """Leave out contained phrases, score the others by their worst cut and rank them; all from the merged stripes."""
    every = reduce(DataFrame.unionByName, [m.select("lang", "prefix", "total", "nexts", "counts") for m in levels])
    totals = stored(every.groupBy("lang", "prefix").agg(F.sum("total").alias("total"), F.max(F.array_max("counts")).alias("longer")), "totals")
    phrases = every.select("lang", "prefix", F.expr("inline(arrays_zip(nexts, counts)) AS (next, a)")).select(
        "lang", F.concat_ws(" ", "prefix", "next").alias("phrase"), "a"
    )
    phrases = stored(phrases, "phrases")
    # longer ones: by a word after it, the largest element of its own stripe, and by a word before it
    after = totals.where("longer IS NOT NULL").selectExpr("lang", "prefix AS phrase", "longer")
    before = phrases.selectExpr("lang", "substring(phrase, instr(phrase, ' ') + 1) AS phrase", "a AS longer")
    longer = after.unionByName(before).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = phrases.join(longer, ["lang", "phrase"], "left").where("longer IS NULL OR longer < a").select("lang", "phrase", "a")
    cuts = kept.select("lang", "phrase", "a", F.posexplode(F.split("phrase", " "))).where("pos > 0").selectExpr(
        "lang", "phrase", "a", "pos AS cut", "substring_index(phrase, ' ', pos) AS left",
        "substring_index(phrase, ' ', pos - size(split(phrase, ' '))) AS right",
    )
    parts = cuts.join(totals.selectExpr("lang", "prefix AS left", "total AS l"), ["lang", "left"]).join(
        totals.selectExpr("lang", "prefix AS right", "total AS r"), ["lang", "right"]
    )
    whole = "CAST({} AS DECIMAL(38, 0))"
    scored = parts.join(n_words, "lang").withColumn(
        "score", F.expr(f"{whole.format('1000')} * {whole.format('a')} * {whole.format('words')} div ({whole.format('l')} * {whole.format('r')})")
    )
    worst = scored.groupBy("lang", "phrase", "a", "words").agg(F.expr("min(struct(score, cut, l, r)) AS w"))
    rows = worst.select("lang", "phrase", "a", "w.l", "w.r", F.col("words").alias("n"), "w.score")
    by_score = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return rows.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= most).select(
        "lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )
