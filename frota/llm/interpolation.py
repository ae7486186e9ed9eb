"""Language-model scores by deleted interpolation.

P(w | v) = l2(b) c(v,w) / c(v) + l1(b) c(w) / N + l0(b) / (V + 1): maximum-likelihood estimates of the word pair and
of the word, and a uniform share for each known word and the unknown one. The weights depend on the bucket b of the
context's frequency (powers of two) and come from expectation-maximisation on held-out counts: every training token
is predicted from counts with its own occurrence deleted.

Counting is one exchange. Texts become blocks of about a million tokens (names of the distinct words and an index per
token). A block asks for the totals of its distinct words and pairs: names, sorted and dealt by range to buckets, with
its own counts. A bucket, sized by the number of tokens, adds up and answers in the same order, so answers need no
names. A frequent word is one entry per block, whatever its count. Blocks and answers meet twice: to gather what
expectation-maximisation needs, a histogram on a grid of 1/8 octave whose size depends on the logarithm of the counts
only, and to score. Nothing else reaches the driver.

A null text counts as empty: only its end token is scored. Rows with the same id are separate texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from frota.llm.common import byte_texts, crc_part, mixed, stored, text_slices

BLOCK_TOKENS = 1_000_000
BUCKET_ENTRIES = 1_500_000
_GRID = 8
_END, _START = (np.uint64(xxhash.xxh64_intdigest(mark, 8)) for mark in (b"\n", b" "))


def _packed(values: np.ndarray) -> bytes:
    """Integers as compressed byte planes."""
    return zstandard.compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes(), 1)


def _unpacked(data: bytes, kind) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(planes.reshape(size, -1).T).view(kind).ravel() if len(planes) else np.zeros(0, kind)


_BLOCK = (
    "block bigint, doc_ids binary, no_id binary, training binary, lengths binary, words binary, tokens binary, "
    "n_tokens bigint, n_training bigint"
)


class _Builder:
    """Collects texts until the block is full."""

    def __init__(self) -> None:
        self.index: dict[bytes, int] = {}
        self.docs: list[tuple] = []
        self.tokens: list[np.ndarray] = []
        self.size = 0

    def add(self, doc_id: int | None, training: bool, text: bytes) -> None:
        words, index = text.lower().split(), self.index
        ids = np.fromiter((index.setdefault(w, len(index) + 1) for w in words), np.uint32, len(words))
        self.tokens += [ids, np.zeros(1, np.uint32)]  # 0 is the end
        self.docs.append((doc_id, training, len(words) + 1))
        self.size += len(words) + 1

    def batch(self, block: int) -> pa.RecordBatch:
        ids, training, lengths = zip(*self.docs, strict=True)
        words = np.fromiter((xxhash.xxh64_intdigest(w, 8) for w in self.index), np.uint64, len(self.index))
        lengths, training = np.array(lengths, np.int64), np.array(training, np.uint8)
        row = [
            block, _packed(np.array([i or 0 for i in ids], np.int64)), _packed(np.array([i is None for i in ids], np.uint8)),
            _packed(training), _packed(lengths), _packed(np.concatenate([[_END], words])), _packed(np.concatenate(self.tokens)),
            int(lengths.sum()), int(lengths[training > 0].sum()),
        ]
        kinds = [pa.int64()] + [pa.binary()] * 6 + [pa.int64()] * 2
        names = [part.split()[0] for part in _BLOCK.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=names)


def token_blocks(docs: DataFrame, training: str, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Blocks of whole texts, stored. ``training`` is a boolean column of ``docs``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, builder = TaskContext.get().partitionId() << 32, _Builder()
        for batch in batches:
            for part in text_slices(batch, "text"):
                for doc_id, learns, text in zip(
                    part.column("doc_id").to_pylist(), part.column("_training").to_pylist(), byte_texts(part.column("text")), strict=True
                ):
                    builder.add(doc_id, bool(learns), text)
                    if builder.size >= block_tokens:
                        yield builder.batch(block)
                        block, builder = block + 1, _Builder()
        if builder.docs:
            yield builder.batch(block)

    return stored(docs.select("doc_id", F.col(training).alias("_training"), "text").mapInArrow(work, _BLOCK), "lm-blocks")


class _Block:
    """A block opened: word names, and per token its word, its context and whether it is learned from."""

    def __init__(self, row) -> None:
        self.words, self.tokens = _unpacked(row.words, np.uint64), _unpacked(row.tokens, np.uint32)
        self.lengths = _unpacked(row.lengths, np.int64)
        self.doc_ids, self.no_id = _unpacked(row.doc_ids, np.int64), _unpacked(row.no_id, np.uint8).astype(bool)
        self.training = _unpacked(row.training, np.uint8).astype(bool)
        self.begins = np.cumsum(self.lengths) - self.lengths
        self.learns = np.repeat(self.training, self.lengths)
        # the context of a text's first token is the start, which counts as often as the end (index 0)
        context = np.concatenate([[0], self.tokens[:-1]]).astype(np.uint32)
        context[self.begins] = 0
        self.context = context
        v = self.words[context]
        v[self.begins] = _START
        self.word_order = np.argsort(self.words, kind="stable")
        self.pairs, self.pair = np.unique(mixed(v, self.words[self.tokens]), return_inverse=True)

    def asked(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Sorted names and own training counts, for words and for pairs."""
        word = np.bincount(self.tokens[self.learns], minlength=len(self.words))
        pair = np.bincount(self.pair[self.learns], minlength=len(self.pairs))
        return [(self.words[self.word_order], word[self.word_order]), (self.pairs, pair)]

    def answered(self, replies: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per token: count of its pair, of its context, of its word."""
        replies = replies.sort_values(["kind", "bucket"])
        totals = [
            np.concatenate([np.zeros(0, np.int64), *(_unpacked(c, np.int64) for c in replies.counts[replies.kind == kind])]) for kind in (0, 1)
        ]
        word = np.empty(len(self.words), np.int64)
        word[self.word_order] = totals[0]
        return totals[1][self.pair], word[self.context], word[self.tokens]


def _bucket_of(names: np.ndarray, buckets: int) -> np.ndarray:
    return ((names >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


_ANSWER = "block bigint, bucket bigint, kind int, counts binary, distinct bigint"


def totals(blocks: DataFrame, tokens: int) -> DataFrame:
    """Answers to all blocks, stored: totals over training tokens in the order each block asked."""
    buckets = max(1, -(-tokens // BUCKET_ENTRIES))

    def ask(batches):
        for batch in batches:
            for row in batch.to_pandas().itertuples():
                for kind, (names, counts) in enumerate(_Block(row).asked()):
                    bucket = _bucket_of(names, buckets)
                    cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
                    parts = [
                        (row.block, int(bucket[a]), kind, _packed(np.diff(names[a:b], prepend=np.uint64(0))), _packed(counts[a:b]))
                        for a, b in zip(cuts, [*cuts[1:], len(names)], strict=True)
                    ]
                    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, k) for c, k in zip(zip(*parts, strict=True), kinds, strict=True)],
                        names=["block", "bucket", "kind", "names", "counts"],
                    )

    def answer(rows: pd.DataFrame) -> pd.DataFrame:
        names = [np.cumsum(_unpacked(n, np.uint64), dtype=np.uint64) for n in rows.names]
        counts = np.concatenate([_unpacked(c, np.int64) for c in rows.counts])
        known, place = np.unique(np.concatenate(names), return_inverse=True)
        total = np.zeros(len(known), np.int64)
        np.add.at(total, place, counts)
        ends = np.cumsum([len(n) for n in names])
        sums = np.split(total[place], ends[:-1])
        distinct = [int((total > 0).sum())] + [0] * (len(rows) - 1)
        return pd.DataFrame(
            {"block": rows.block, "bucket": rows.bucket, "kind": rows.kind, "counts": [_packed(s) for s in sums], "distinct": distinct}
        )

    asked = blocks.mapInArrow(ask, "block bigint, bucket bigint, kind int, names binary, counts binary")
    return stored(asked.groupBy("bucket", "kind").applyInPandas(answer, _ANSWER), "lm-totals")


def context_bucket(count: np.ndarray) -> np.ndarray:
    """0 for unseen contexts, else 1 + the whole part of log2."""
    return np.where(count > 0, np.frexp(count.astype(float))[1], 0)


def learn_weights(histogram: pd.DataFrame, steps: int = 100, tolerance: float = 1e-7) -> np.ndarray:
    """Weights (pair, word, uniform) per context bucket by expectation-maximisation.

    ``histogram`` has (bucket, p2, p1, n): estimates relative to the uniform share. A bucket without tokens takes
    the weights of the next lower one.
    """
    out = np.full((65, 3), np.nan)
    for bucket, rows in histogram.groupby("bucket"):
        share = np.stack([rows.p2, rows.p1, np.ones(len(rows))], axis=1)
        n, weights = rows.n.to_numpy(float), np.full(3, 1 / 3)
        for _ in range(steps):
            part = share * weights
            new = (part / part.sum(axis=1, keepdims=True) * n[:, None]).sum(axis=0) / n.sum()
            done = np.abs(new - weights).max() < tolerance
            weights = new
            if done:
                break
        out[int(bucket)] = weights
    last = np.array([0.0, 0.5, 0.5])
    for i in range(len(out)):
        last = out[i] = last if np.isnan(out[i, 0]) else out[i]
    return out


def scored(docs: DataFrame, training: str) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every text of ``docs``.

    ``base_score`` is the add-one unigram score, ``score`` the interpolated model's log10 probability.
    """
    blocks = token_blocks(docs, training)
    sizes = blocks.agg(F.sum("n_tokens"), F.sum("n_training")).first()
    n_all, n_train = (int(x or 0) for x in sizes)
    answers = totals(blocks, n_all)
    vocabulary = int(answers.where("kind = 0").agg(F.sum("distinct")).first()[0] or 0)
    uniform = 1.0 / (vocabulary + 1)
    meeting = lambda work, schema: blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(work, schema)

    def gather(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        block = _Block(next(left.itertuples()))
        pair, context, word = (c[block.learns] - 1 for c in block.answered(right))
        with np.errstate(divide="ignore", invalid="ignore"):
            p2 = np.where(context > 0, pair / np.maximum(context, 1), 0.0) / uniform
            p1 = word / max(n_train - 1, 1) / uniform
            cells = [np.where(p > 0, np.round(np.log2(p) * _GRID), -(1 << 20)).astype(np.int64) for p in (p2, p1)]
        rows = pd.DataFrame({"bucket": context_bucket(context), "c2": cells[0], "c1": cells[1]})
        return rows.groupby(["bucket", "c2", "c1"]).size().rename("n").reset_index()

    grid = meeting(gather, "bucket int, c2 bigint, c1 bigint, n bigint").groupBy("bucket", "c2", "c1").agg(F.sum("n").alias("n")).toPandas()
    grid = grid.sort_values(["bucket", "c2", "c1"])
    for name, cell in (("p2", "c2"), ("p1", "c1")):
        grid[name] = np.where(grid[cell] > -(1 << 20), 2.0 ** (grid[cell] / _GRID), 0.0)
    weights = learn_weights(grid)

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        block = _Block(next(left.itertuples()))
        pair, context, word = block.answered(right)
        w = weights[context_bucket(context)]
        p = w[:, 0] * pair / np.maximum(context, 1) + w[:, 1] * word / max(n_train, 1) + w[:, 2] * uniform
        base = np.log10((word + 1) / (n_train + vocabulary + 1))
        sums = lambda x: np.add.reduceat(x, block.begins)
        return pd.DataFrame(
            {
                "doc_id": pd.arrays.IntegerArray(block.doc_ids.copy(), block.no_id.copy()),
                "held_out": ~block.training, "n_tokens": block.lengths, "n_known": sums((word > 0).astype(np.int64)),
                "train_tokens": n_train, "base_score": sums(base), "score": sums(np.log10(p)),
            }
        )

    return meeting(
        score, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    )


def crc_training(doc_id: str = "doc_id", parts: int = 7, held_out: int = 2):
    return crc_part(doc_id, parts) != held_out
