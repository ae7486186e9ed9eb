"""Best-fit packing planned over the histogram of lengths.

Texts become token pieces of at most ``capacity`` tokens (only longer texts are cut; the first piece takes the
rest). Best-fit decreasing then runs on the driver over counts per length, at most ``capacity`` numbers whatever
the input: open sequences with equal room form one group, and a length fills whole groups at a time. The plan is a
list of slot runs (length, ranks from .. to, first sequence, offset); its size depends on the capacity, not on the
number of texts, so it may be broadcast. Pieces take their slots by joining on length and on their rank within the
length. Ranks come from the rank inside the task that made the piece plus the count of earlier tasks, so no length,
however frequent, is gathered in one task.

A null text counts as empty: it is the single piece of its end token. Rows with the same id are separate texts.
"""

from __future__ import annotations

import re
import struct
import zlib
from bisect import insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from frota.llm.common import over_text, stored

VOCABULARY = "byte_bpe_50k.json"
END_ID = 2
_CACHE_ENTRIES = 1_000_000
_ODD, _LEAD = re.compile(r" \s| \Z"), re.compile(r" (?=\S)")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: printable ones stand for themselves, the
    others follow from 256 on, in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    return {b: chr(b) if b in plain else chr(next(other)) for b in range(256)}


class TokenBytes:
    """Texts to token ids as little-endian 32-bit words.

    The pre-tokenizer always cuts before a blank that anything but white space follows, so a text is encoded
    from one such blank to the next, and frequent pieces are looked up. A piece that is one word goes to the
    merges directly. The table is emptied when it is full. A text that spells a special token is encoded as a whole.
    """

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(vocabulary)
        self._special = [token.content for token in self._tokenizer.get_added_tokens_decoder().values()]
        self._merge = self._tokenizer.model.tokenize
        self._letters = _byte_letters()
        self._known: dict[str, bytes] = {}

    def _encode(self, text: str) -> bytes:
        return np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        word = piece[1:] if piece[:1] == " " else piece
        if word.isalpha() and (piece.isascii() or max(word) < "\u0250"):
            ids = [token.id for token in self._merge(piece.encode().decode("latin-1").translate(self._letters))]
            return struct.pack(f"<{len(ids)}I", *ids)
        if piece[-1:] in ".,;:!?" and piece[-2:-1].isalpha():
            return self._lookup(piece[:-1]) + self._lookup(piece[-1])
        head, line, tail = piece.partition("\n")
        if line and head.strip() and tail and not head[-1].isspace() and not tail[0].isspace():
            return self._lookup(head) + self._lookup(line) + self._lookup(tail)
        return self._encode(piece) if piece else b""

    def _lookup(self, piece: str) -> bytes:
        ids = self._known.get(piece)
        if ids is None:
            ids = self._known[piece] = self._piece(piece)
        return ids

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        # the text around a special token is cut there, so it is not encoded piece by piece
        if any(token in text for token in self._special):
            return self._encode(text)
        if len(self._known) > _CACHE_ENTRIES:
            self._known.clear()
        first, *rest = _LEAD.split(text) if _ODD.search(text) else text.split(" ")
        known, lookup = self._known.get, self._lookup
        return b"".join([lookup(first), *[known(p) or lookup(p) for p in [" " + r for r in rest]]])


def token_pieces(
    docs: DataFrame, capacity: int, vocabulary: str, end_id: int = END_ID, text: str = "text", with_ids: bool = False
) -> DataFrame:
    """One row per piece, stored: id, piece, start, length, crc32 of its ids, and its rank among the pieces of that
    length made by the same task; ``ids`` (little-endian 32-bit words) if asked for."""
    end = np.array([end_id], "<u4").tobytes()
    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, task int, rank bigint"
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank"] + ["ids"] * with_ids
    state: dict = {}

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not state:
            state.update(encode=TokenBytes(vocabulary), task=TaskContext.get().partitionId(), made=[0] * (capacity + 1))
        made, rows = state["made"], []
        for doc_id, body in zip(batch.column("doc_id").to_pylist(), batch.column(text).to_pylist(), strict=True):
            ids = state["encode"](body or "") + end
            total = len(ids) // 4
            first = total if total <= capacity else total % capacity or capacity
            start, length, piece = 0, first, 0
            while start < total:
                part = ids[4 * start : 4 * (start + length)]
                rows.append((doc_id, piece, start, length, zlib.crc32(part), state["task"], made[length]) + ((part,) * with_ids))
                made[length] += 1
                start, length, piece = start + length, capacity, piece + 1
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()] + [pa.binary()] * with_ids
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names
        )

    pieces = over_text(docs.select("doc_id", text), work, schema + ", ids binary" * with_ids, text)
    return stored(pieces, "pack-pieces")


def best_fit_plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Slot runs (length, rank_from, rank_to, first_sequence, offset) of best-fit decreasing over counts.

    Open sequences are kept as runs of consecutive numbers with equal room. Equal lengths fill one sequence as
    far as they fit before the next one is touched, as best fit does.
    """
    plan, rooms, groups, fresh = [], [], {}, 0

    def leave(room: int, first: int, number: int) -> None:
        if room and number:
            if room not in groups:
                groups[room] = []
                insort(rooms, room)
            groups[room].append((first, number))

    def fill(length: int, rank: int, first: int, number: int, room: int, left: int) -> int:
        """Place up to ``left`` pieces in a run of sequences; returns how many were placed."""
        each = room // length
        whole = min(number, left // each)
        for j in range(each):
            if whole:
                plan.append((length, rank + j * whole, rank + (j + 1) * whole, first, capacity - room + j * length))
        leave(room - each * length, first, whole)
        placed, part = whole * each, 0
        if whole < number and left > placed:
            part = left - placed
            for j in range(part):
                plan.append((length, rank + placed + j, rank + placed + j + 1, first + whole, capacity - room + j * length))
            leave(room - part * length, first + whole, 1)
        leave(room, first + whole + (part > 0), number - whole - (part > 0))
        return placed + part

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = next((r for r in rooms if r >= length), None)
            if room is None:
                number = -(-left // (capacity // length))
                rank += fill(length, rank, fresh, number, capacity, left)
                fresh, left = fresh + number, 0
                break
            runs = groups.pop(room)
            rooms.remove(room)
            for first, number in runs:
                done = fill(length, rank, first, number, room, left) if left else 0
                if not done:
                    leave(room, first, number)
                rank, left = rank + done, left - done
    return plan


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to stored pieces."""
    spark = pieces.sparkSession
    by_task = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    by_task = stored(by_task, "pack-counts")
    counts = {int(r.length): int(r.n) for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = spark.createDataFrame(
        best_fit_plan(counts, capacity), "_length bigint, rank_from bigint, rank_to bigint, first_sequence bigint, offset bigint"
    )
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = by_task.select(
        F.col("length").alias("_l"), F.col("task").alias("_t"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_before")
    )
    ranked = (
        pieces.join(before, (F.col("length") == F.col("_l")) & (F.col("task") == F.col("_t")))
        .withColumn("rank", F.col("rank") + F.col("_before"))
        .drop("_l", "_t", "_before")
    )
    return (
        ranked.join(
            F.broadcast(plan),
            (F.col("length") == F.col("_length")) & (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to")),
        )
        .withColumn("sequence_id", F.col("first_sequence") + F.col("rank") - F.col("rank_from"))
        .drop("_length", "rank_from", "rank_to", "first_sequence", "rank", "task")
    )


def packed(docs: DataFrame, capacity: int = 1024, vocabulary: str | None = None, **options) -> DataFrame:
    """Tokenise, cut and pack ``docs`` (doc_id, text)."""
    return pack(token_pieces(docs, capacity, vocabulary or vocabulary_path(), **options), capacity)
