"""Exact top-k inner products by columnar branch and bound.

Vectors become integer vectors and are stored vertically: a block holds up to ``BLOCK_ROWS`` rows as one binary
column per ``DIMS`` dimensions. A query block meets a block of candidates by accumulating inner products one
dimension block at a time, those with the largest mass first. After each, what the rest can still add is at
most |rest of query| * |rest of candidate|; candidates that cannot reach the query's k-th best score any more are
compacted away, first whole rows of the block, later single pairs.

Every query meets every block, as the answer is exact: blocks are dealt to slots of about ``SLOT_ROWS`` rows and queries to
groups of ``QUERY_ROWS``, and each (slot, group) is one task's work. So a task holds a bounded number of rows, candidates
are copied once per group and queries once per slot. A task returns k rows a query. The k-th best score among one
block of candidates (at most ``BLOCK_ROWS`` rows, the only thing sent to all tasks) bounds each query from below at the start.

Defined results: a vector that is null or holds a null or non-finite component takes no part; components that a shorter
vector lacks count as zero; an empty vector scores 0 with all. Rows with the query's own id are not its candidates. Every row with
a query's id is a query of its own, also if the id repeats; repeated candidate rows are returned as often as they occur. Null
ids are never queries and rank behind others at equal scores. Scores are exact at any size and
end at the limits of 64 bits. Other columns, whatever their names, play no part; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from frota.llm.common import stored
from frota.session import shuffle_width

BLOCK_ROWS, SLOT_ROWS, QUERY_ROWS = 4096, 32768, 16384
DIMS = 16
#: Queries searched at once, so that the matrix of partial scores stays at 16 MB.
_QUERIES = 512
_EXACT = 2.0**53
_LIMIT = 2**63 - 1
_BLOCK = "block bigint, n int, ids array<bigint>, kind string, dims array<binary>, mass array<double>, start binary"
_FOUND = "asker bigint, query_id bigint, vec_id bigint, score bigint"


class Block:
    """Rows of integer vectors, vertically: ``part(j)`` has the dimensions of block j as floats."""

    def __init__(self, row: dict):
        self.number, self.n, self.kind, self.dims = row["block"], row["n"], row["kind"], row["dims"]
        self.null = np.array([i is None for i in row["ids"]], bool)
        self.ids = np.array([0 if i is None else i for i in row["ids"]], np.int64)
        self.start = np.frombuffer(row["start"], np.float64) if row["start"] else np.full(self.n, -np.inf)

    def part(self, j: int) -> np.ndarray:
        if j >= len(self.dims):
            return np.zeros((self.n, DIMS))
        return np.frombuffer(self.dims[j], self.kind).reshape(self.n, DIMS).astype(np.float64)

    def loaded(self, order: list[int]) -> Block:
        """With all parts in ``order`` and, per part, the length of what comes after it."""
        self.parts = [self.part(j) for j in order]
        squares = [(p**2).sum(axis=1) for p in self.parts]
        after = np.cumsum([np.zeros(self.n), *squares[:0:-1]], axis=0)[::-1] if squares else []
        self.rest = [np.sqrt(a) for a in after]
        self.reach = np.array([float(np.abs(p).max(initial=0)) for p in self.parts])
        return self


def integer_vectors(column: pa.Array, scale: float = 256.0) -> np.ndarray:
    """floor(scale * x) of a list column, as floats, padded to whole dimension blocks with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = pa.compute.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = np.floor(scale * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    width = -(-int(lengths.max(initial=0)) // DIMS) * DIMS
    out = np.zeros((len(lengths), width))
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def _block_row(number: int, ids: list, vectors: np.ndarray, start: np.ndarray | None = None) -> dict:
    largest = np.abs(vectors).max(initial=0)
    kind = "<i2" if largest < 2**15 else "<i4" if largest < 2**31 else "<f8"
    parts = [vectors[:, j : j + DIMS] for j in range(0, vectors.shape[1], DIMS)]
    return {
        "block": number, "n": len(ids), "ids": ids, "kind": kind,
        "dims": [np.ascontiguousarray(p).astype(kind).tobytes() for p in parts],
        "mass": [float((p**2).sum()) for p in parts],
        "start": None if start is None else start.tobytes(),
    }


_BLOCK_ARROW = pa.schema(
    [("block", pa.int64()), ("n", pa.int32()), ("ids", pa.list_(pa.int64())), ("kind", pa.string()),
     ("dims", pa.list_(pa.binary())), ("mass", pa.list_(pa.float64())), ("start", pa.binary())]
)


def _blocks(rows: DataFrame, scale: float, seed: dict | None = None, k: int = 0) -> DataFrame:
    """Vertical blocks of (id, vector) rows; with ``seed`` each row's k-th best score in that block."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 33
        yardstick = Block(seed) if seed else None
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                vectors, ids = integer_vectors(part.column("vector"), scale), part.column("id").to_pylist()
                row = _block_row(number, ids, vectors)
                if yardstick is not None:
                    row["start"] = _kth_best(Block(row), yardstick, k).tobytes()
                number += 1
                yield pa.RecordBatch.from_pylist([row], schema=_BLOCK_ARROW)

    return rows.mapInArrow(pack, _BLOCK)


def _kth_best(queries: Block, others: Block, k: int) -> np.ndarray:
    """The k-th best score of each query among ``others``: a score its k-th best of all cannot fall below."""
    order = list(range(max(len(queries.dims), len(others.dims))))
    a, b = queries.loaded(order), others.loaded(order)
    if float((a.reach * b.reach).sum()) * DIMS >= _EXACT:
        return np.full(a.n, -np.inf)
    out = np.full(a.n, -np.inf)
    for at in range(0, a.n, _QUERIES):
        rows = slice(at, at + _QUERIES)
        score = sum((p[rows] @ q.T for p, q in zip(a.parts, b.parts, strict=True)), np.zeros((len(a.ids[rows]), b.n)))
        score[(a.ids[rows][:, None] == b.ids) & ~b.null] = -np.inf
        if b.n >= k:
            out[rows] = np.partition(score, b.n - k, axis=1)[:, b.n - k]
    return out


def survivors(queries: Block, rows: slice, floor: np.ndarray, cands: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, candidate, score) of the pairs that may reach ``floor``, one dimension block at a time.

    While many pairs live, queries and candidates without any leave the matrix; once under a sixteenth live, pairs are listed.
    """
    q = np.arange(len(queries.ids))[rows]
    c = np.arange(cands.n)
    score = np.zeros((len(q), len(c)))
    pairs = None
    for j, (a, b) in enumerate(zip(queries.parts, cands.parts, strict=True)):
        # a hair more than the bound, as lengths are rounded
        if pairs is None:
            score += a[q] @ b[c].T
            most = np.outer(queries.rest[j][q], cands.rest[j][c]) * (1 + 1e-9) + 1e-6
            live = score + most >= floor[q - rows.start][:, None]
            if live.sum() * 16 <= live.size:
                at = np.nonzero(live)
                pairs, score = (q[at[0]], c[at[1]]), score[at]
                continue
            keep_q, keep_c = live.any(axis=1), live.any(axis=0)
            if not (keep_q.all() and keep_c.all()):
                q, c, score = q[keep_q], c[keep_c], score[np.ix_(keep_q, keep_c)]
        else:
            score = score + np.einsum("ij,ij->i", a[pairs[0]], b[pairs[1]])
            most = queries.rest[j][pairs[0]] * cands.rest[j][pairs[1]] * (1 + 1e-9) + 1e-6
            live = score + most >= floor[pairs[0] - rows.start]
            pairs, score = (pairs[0][live], pairs[1][live]), score[live]
    if pairs is None:
        pairs, score = (np.repeat(q, len(c)), np.tile(c, len(q))), score.ravel()
    keep = score >= floor[pairs[0] - rows.start]
    return pairs[0][keep], pairs[1][keep], score[keep].astype(np.int64)


def _all_scores(queries: Block, rows: slice, cands: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every pair with whole-number arithmetic of any size, for components too large for floats."""
    whole = np.vectorize(int, otypes=[object])
    q = np.arange(len(queries.ids))[rows]
    score = np.full((len(q), cands.n), 0, object)
    for a, b in zip(queries.parts, cands.parts, strict=True):
        score = score + whole(a[q]).dot(whole(b).T)
    score = np.clip(score, -_LIMIT - 1, _LIMIT).astype(np.int64)
    return np.repeat(q, cands.n), np.tile(np.arange(cands.n), len(q)), score.ravel()


class Best:
    """The k best candidates so far of a run of queries."""

    def __init__(self, n: int, k: int, start: np.ndarray):
        self.k, self.floor = k, start.copy()
        self.row = np.zeros(0, np.int64)
        self.score, self.ids, self.null = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        self.n = n

    def add(self, row: np.ndarray, score: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        row, score = np.concatenate([self.row, row]), np.concatenate([self.score, score])
        ids, null = np.concatenate([self.ids, ids]), np.concatenate([self.null, null])
        # ~score falls as score rises and has no overflow
        order = np.lexsort((ids, null, ~score, row))
        row = row[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        order = order[place < self.k]
        self.row, self.score, self.ids, self.null = row[place < self.k], score[order], ids[order], null[order]
        last = np.flatnonzero(place[place < self.k] == self.k - 1)
        self.floor[self.row[last]] = np.maximum(self.floor[self.row[last]], self.score[last].astype(np.float64))


def _search(queries: list[Block], cands: list[Block], order: list[int], k: int) -> Iterator[pa.Table]:
    cands = [c.loaded(order) for c in cands]
    for block in queries:
        block.loaded(order)
        for at in range(0, block.n, _QUERIES):
            rows = slice(at, min(at + _QUERIES, block.n))
            best = Best(rows.stop - at, k, block.start[rows])
            for other in cands:
                small = float((block.reach * other.reach).sum()) * DIMS < _EXACT
                q, c, score = survivors(block, rows, best.floor, other) if small else _all_scores(block, rows, other)
                fit = other.null[c] | (block.ids[q] != other.ids[c])
                q, c, score = q[fit], c[fit], score[fit]
                best.add(q - at, score, other.ids[c], other.null[c])
            yield pa.table(
                {
                    "asker": (best.row + at) + (block.number << 13),
                    "query_id": block.ids[best.row + at],
                    "vec_id": pa.array(best.ids, mask=best.null),
                    "score": best.score,
                }
            )


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, id_column: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` candidates with the largest inner product of floor(``scale`` * x),
    largest first, ties to the smaller id. ``is_query`` is a condition on the table's columns."""
    spark = vectors.sparkSession
    bad = f"exists(vector, x -> x IS NULL OR isnan(x) OR abs(x) = CAST('Infinity' AS DOUBLE))"
    rows = vectors.select(
        F.col(id_column).cast("bigint").alias("id"),
        F.col(vector).cast("array<double>").alias("vector"),
        (F.coalesce(is_query, F.lit(False)) & F.col(id_column).isNotNull()).alias("asks"),
    ).where(f"vector IS NOT NULL AND NOT {bad}")
    cands = stored(_blocks(rows.select("id", "vector"), scale), "vector-blocks")
    n, n_blocks = cands.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    if n == 0:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    mass = cands.select(F.posexplode("mass")).groupBy("pos").agg(F.sum("col").alias("mass"))
    order = [r.pos for r in mass.orderBy(F.desc("mass"), "pos").collect()]
    seed = cands.orderBy(F.desc("n"), F.xxhash64("block")).limit(1).toArrow().to_pylist()[0]
    asked = rows.where("asks").select("id", "vector")
    n_asked = asked.count()
    asked = asked.repartition(max(1, -(-n_asked // (BLOCK_ROWS // 2))))
    queries = stored(_blocks(asked, scale, seed, k), "query-blocks")
    n_slots = max(-(-n // SLOT_ROWS), min(n_blocks, shuffle_width(spark)))
    n_groups = max(1, -(-n_asked // QUERY_ROWS))
    name = F.xxhash64("block")
    left = cands.withColumn("slot", F.pmod(name, F.lit(n_slots))).withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1))))
    right = queries.withColumn("grp", F.pmod(name, F.lit(n_groups)).cast("int")).withColumn(
        "slot", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_slots - 1).cast("bigint")))
    )

    def meet(ours: pa.Table, asking: pa.Table) -> pa.Table:
        found = list(_search([Block(r) for r in asking.to_pylist()], [Block(r) for r in ours.to_pylist()], order, k))
        if not found:
            return pa.table({c: pa.array([], pa.int64()) for c in ("asker", "query_id", "vec_id", "score")})
        return pa.concat_tables(found)

    found = left.groupBy("slot", "grp").cogroup(right.groupBy("slot", "grp")).applyInArrow(meet, _FOUND)
    best = Window.partitionBy("asker").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
