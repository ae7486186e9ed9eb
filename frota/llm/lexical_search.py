"""Ranked lexical search by presence masks.

Documents are read once into blocks of postings for the words that items ask for: per word the places of its documents, rising,
and how often each holds it. Word statistics are sums over these blocks. For each item a block's documents are then grouped by
which of the item's terms they hold, a bitmap with one bit a term: every posting list sets its bit, equal bitmaps are one group.
A bitmap's largest possible score adds up the best score of each of its terms within the block. Groups are evaluated
from the highest such maximum down, until it is below the item's k-th best score; scores at the same height are still looked at, as
the document id decides between them. The k best travel along with the task from block to block.

Items are taken in groups of about ``ITEM_BYTES`` of text, one pass over the documents each, so what tasks are given does not grow with the
number of items; a block holds at most ``BLOCK_DOCS`` documents and about ``BLOCK_WORDS`` postings.

Defined results: null and empty texts and items have no terms; documents without any count in no statistic, items without any
return nothing. Repeated words of an item count as often as they occur. Every row is an item or a document of its own, also if ids repeat;
null document ids rank behind others at equal scores. Without documents no rows. Columns other than the named ones play no part.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from frota.llm.common import byte_texts, stored, text_slices

BLOCK_DOCS, BLOCK_WORDS = 8192, 4_000_000
ITEM_BYTES = 8 << 20
#: ASCII letters and digits and all bytes of other characters make words; only A-Z change case.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_INDEX = (
    "block bigint, docs array<bigint>, lengths binary, words binary, ends binary, places binary, counts binary, n_docs bigint, n_words bigint"
)
_INDEX_ARROW = pa.schema(
    [("block", pa.int64()), ("docs", pa.list_(pa.int64()))]
    + [(name, pa.binary()) for name in ("lengths", "words", "ends", "places", "counts")]
    + [("n_docs", pa.int64()), ("n_words", pa.int64())]
)
_RANKED = "item int, item_id bigint, doc_id bigint, score bigint"


def words_of(text: bytes) -> list[bytes]:
    """The terms of a text, repeats included."""
    return text.translate(_FOLD).split()


@dataclass
class Item:
    """The different words of an item by number, and how often it has each."""

    number: int
    item_id: int | None
    words: np.ndarray
    times: np.ndarray


def _items(rows: list) -> tuple[list[Item], dict[bytes, int]]:
    vocabulary: dict[bytes, int] = {}
    items = []
    for number, row in enumerate(rows):
        counts = Counter(words_of((row.text or "").encode()))
        words = np.array([vocabulary.setdefault(w, len(vocabulary)) for w in counts], np.int64)
        items.append(Item(number, row.item_id, words, np.array(list(counts.values()), np.int64)))
    return items, vocabulary


class _Postings:
    """Collects documents until a block is full."""

    def __init__(self):
        self.docs, self.lengths, self.place, self.word, self.count = [], [], [], [], []

    def add(self, doc_id: int | None, n_words: int, found: Counter) -> None:
        self.place.append(np.full(len(found), len(self.docs)))
        self.word.append(np.fromiter(found.keys(), np.int64, len(found)))
        self.count.append(np.fromiter(found.values(), np.int64, len(found)))
        self.docs.append(doc_id)
        self.lengths.append(n_words)

    def row(self, number: int) -> pa.RecordBatch:
        place, word, count = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (self.place, self.word, self.count))
        order = np.argsort(word, kind="stable")
        words, sizes = np.unique(word, return_counts=True)
        lengths = np.array(self.lengths, np.int64)
        values = {
            "block": number, "docs": self.docs, "lengths": lengths.tobytes(), "words": words.astype(np.int32).tobytes(),
            "ends": np.cumsum(sizes).astype(np.int64).tobytes(), "places": place[order].astype(np.uint16).tobytes(),
            "counts": count[order].astype(np.uint32).tobytes(), "n_docs": int((lengths > 0).sum()), "n_words": int(lengths.sum()),
        }
        return pa.RecordBatch.from_pylist([values], schema=_INDEX_ARROW)


def index(docs: DataFrame, vocabulary: dict[bytes, int], id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Blocks of postings of the documents of ``docs`` for the words of ``vocabulary``."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, block, held = TaskContext.get().partitionId() << 33, _Postings(), 0
        for batch in batches:
            for part in text_slices(batch, "text"):
                for doc_id, value in zip(part.column("id").to_pylist(), byte_texts(part.column("text")), strict=True):
                    words = words_of(value)
                    if not words:
                        continue
                    found = Counter(map(vocabulary.get, words))
                    found.pop(None, None)
                    block.add(doc_id, len(words), found)
                    held += len(found)
                    if len(block.docs) == BLOCK_DOCS or held >= BLOCK_WORDS:
                        yield block.row(number)
                        number, block, held = number + 1, _Postings(), 0
        if block.docs:
            yield block.row(number)

    return docs.select(F.col(id_column).cast("bigint").alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(read, _INDEX)


def _document_counts(blocks: DataFrame) -> dict[int, int]:
    """Documents per word of the vocabulary, which is bounded."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words, ends in zip(batch.column("words").to_pylist(), batch.column("ends").to_pylist(), strict=True):
                sizes = np.diff(np.frombuffer(ends, np.int64), prepend=0)
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(words, np.int32)), pa.array(sizes)], names=["word", "n"])

    counts = blocks.select("words", "ends").mapInArrow(count, "word int, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return {r.word: r.n for r in counts.collect()}


def term_weights(items: list[Item], df: dict[int, int], n_docs: int) -> list[np.ndarray]:
    """Per item w times how often it has each word."""
    return [
        np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(int(w), 0) + 1))) for w in item.words], np.int64) * item.times
        for item in items
    ]


def length_terms(lengths: np.ndarray, n_docs: int, n_words: int) -> np.ndarray:
    """m of each document."""
    if int(lengths.max(initial=0)) * n_docs * 25 < 2**63:
        return 75 + 25 * lengths * n_docs // n_words
    return np.array([75 + 25 * int(n) * n_docs // n_words for n in lengths], np.int64)


class Block:
    """One block of postings, with what each posting adds per unit of weight."""

    def __init__(self, row: dict, n_docs: int, n_words: int):
        self.docs = row["docs"]
        m = length_terms(np.frombuffer(row["lengths"], np.int64), n_docs, n_words)
        words, ends = np.frombuffer(row["words"], np.int32), np.frombuffer(row["ends"], np.int64)
        self.places = np.frombuffer(row["places"], np.uint16).astype(np.int64)
        tf = np.frombuffer(row["counts"], np.uint32).astype(np.int64)
        self.parts = 1_000_000_000 * tf // (1000 * tf + 12 * m[self.places])
        begins = np.append(np.zeros(1, np.int64), ends)[:-1]
        best = np.maximum.reduceat(self.parts, begins) if len(words) else []
        self.lists = {int(w): (int(b), int(e), int(x)) for w, b, e, x in zip(words, begins, ends, best, strict=True)}


def masks(lists: list[np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Group the documents by which of the posting lists they are in.

    Returns the documents in any list, the group of each, and per group one truth value a list.
    """
    bits = np.zeros((n, -(-len(lists) // 64)), np.uint64)
    for j, places in enumerate(lists):
        bits[places, j >> 6] |= np.uint64(1 << (j & 63))
    docs = np.flatnonzero(bits.any(axis=1))
    if bits.shape[1] == 1:
        different, group = np.unique(bits[docs, 0], return_inverse=True)
        different = different[:, None]
    else:
        different, group = np.unique(bits[docs], axis=0, return_inverse=True)
    unpacked = np.unpackbits(np.ascontiguousarray(different).view(np.uint8), axis=1, bitorder="little")
    return docs, group.ravel(), unpacked[:, : len(lists)].astype(bool)


class Ranking:
    """The k best (score, document) of an item so far."""

    def __init__(self, k: int):
        self.k, self.rows = k, []

    def floor(self) -> int:
        """Scores below it cannot enter; 1 while there is room, as a score has to be above 0."""
        return self.rows[-1][0] if len(self.rows) == self.k else 1

    def add(self, scores: np.ndarray, docs: list) -> None:
        floor = self.floor()
        new = [(int(s), d) for s, d in zip(scores, docs, strict=True) if s >= floor]
        self.rows = sorted(self.rows + new, key=lambda r: (-r[0], r[1] is None, r[1] or 0))[: self.k]


def rank_block(block: Block, item: Item, weights: np.ndarray, ranking: Ranking) -> None:
    """Evaluate the block's masks for an item, highest possible score first, until none can enter any more."""
    here = [(w, *block.lists[int(t)]) for t, w in zip(item.words, weights, strict=True) if int(t) in block.lists]
    if sum(w * best for w, _, _, best in here) < ranking.floor():
        return
    docs, group, holds = masks([block.places[b:e] for _, b, e, _ in here], len(block.docs))
    most = holds @ np.array([w * best for w, _, _, best in here], np.int64)
    order = np.argsort(-most, kind="stable")
    by_group = np.argsort(group, kind="stable")
    ends = np.cumsum(np.bincount(group, minlength=len(order)))
    at, step = 0, 16
    while at < len(order) and most[order[at]] >= ranking.floor():
        batch = order[at : at + step]
        batch = batch[most[batch] >= ranking.floor()]
        some = np.sort(np.concatenate([docs[by_group[ends[g - 1] if g else 0 : ends[g]]] for g in batch]))
        score = np.zeros(len(some), np.int64)
        for w, b, e, _ in here:
            # places rise within a list
            spot = np.minimum(np.searchsorted(block.places[b:e], some), e - b - 1) + b
            score += np.where(block.places[spot] == some, w * block.parts[spot], 0)
        ranking.add(score, [block.docs[d] for d in some])
        at, step = at + step, step * 2


def search(
    items: DataFrame, docs: DataFrame, k: int = 20, item_column: str = "item_id", id_column: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` documents with the highest score above 0 per row of ``items``."""
    spark = docs.sparkSession
    asked = items.select(F.col(item_column).cast("bigint").alias("item_id"), F.col(text).cast("string").alias("text"))
    asked = stored(asked.withColumn("part", F.monotonically_increasing_id()), "items")
    size = asked.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n_groups = -(-size // ITEM_BYTES)
    group = F.pmod(F.xxhash64("part"), F.lit(max(n_groups, 1)))
    found = None
    for number in range(n_groups):
        rows = asked.where(group == number).orderBy("item_id", "part").collect()
        ranked = _ranked(docs, *_items(rows), k, id_column, text).withColumn("grp", F.lit(number))
        found = ranked if found is None else found.unionByName(ranked)
    if found is None:
        return spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    best = Window.partitionBy("grp", "item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _ranked(docs: DataFrame, items: list[Item], vocabulary: dict[bytes, int], k: int, id_column: str, text: str) -> DataFrame:
    """The ``k`` best of each task's blocks per item."""
    blocks = stored(index(docs, vocabulary, id_column, text), "postings")
    n_docs, n_words = blocks.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_words"), F.lit(0))).first()
    weights = term_weights(items, _document_counts(blocks), n_docs) if n_docs else []

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rankings = [Ranking(k) for _ in items]
        for batch in batches:
            for i in range(batch.num_rows):
                block = Block(batch.slice(i, 1).to_pylist()[0], n_docs, n_words)
                for item, w, ranking in zip(items, weights, rankings, strict=True):
                    if len(item.words):
                        rank_block(block, item, w, ranking)
        rows = [(item.number, item.item_id, d, s) for item, r in zip(items, rankings, strict=True) for s, d in r.rows]
        if rows:
            number, item_id, doc_id, score = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(number, pa.int32()), pa.array(item_id, pa.int64()), pa.array(doc_id, pa.int64()), pa.array(score, pa.int64())],
                names=["item", "item_id", "doc_id", "score"],
            )

    return blocks.mapInArrow(rank, _RANKED)
