"""Nearest neighbours against brute force, and the pipeline stage by stage."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from frota.llm import neighbours, suffix_dedup
from frota.llm.common import read_table

SMALL = "/root/testdata/sf0.001"


def brute(rows, k):
    out = {}
    for q, v in rows.items():
        if q % 20 == 0:
            scored = sorted(((-float(np.dot(v, w)), i) for i, w in rows.items() if i != q))[:k]
            out[q] = [(i, -s) for s, i in scored]
    return out


def test_nearest_with_copies_and_unusable_vectors(spark):
    rng = np.random.default_rng(1)
    rows = {i: rng.standard_normal(8).round(3).tolist() for i in range(1500)}
    for i in range(300, 420):
        rows[i] = rows[300]  # a large group of copies
    bad = [(5000, None), (5001, [0.0] * 8), (5002, [1.0] * 7), (5003, [float("nan")] + [1.0] * 7), (5004, [None] + [1.0] * 7), (None, [1.0] * 8), (5020, [float("inf")] + [0.0] * 7)]
    frame = spark.createDataFrame([*rows.items(), *bad], "vec_id bigint, embedding array<double>")
    got = {}
    for r in neighbours.nearest(frame, F.col("id") % 20 == 0, k=10, degree=16, width=64).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = brute(rows, 10)
    assert set(got) == set(want) and all(len(x) == 10 for x in got.values())
    near = sum(s >= want[q][-1][1] - 1e-9 for q, found in got.items() for _, s in found)
    assert near / (10 * len(want)) >= 0.9
    assert [i for i, _ in got[300]] == [i for i, _ in want[300]]
    for q, found in got.items():
        for i, s in found:
            assert abs(s - float(np.dot(rows[q], rows[i]))) < 1e-9


def recall_of(frame, rows, k, **options):
    got = {}
    for r in neighbours.nearest(frame, F.col("id") % 20 == 0, k=k, **options).collect():
        got.setdefault(r.query_id, []).append(r.score)
    want = brute(rows, k)
    assert set(got) == set(want)
    return {q: sum(s >= want[q][-1][1] - 1e-9 for s in found) / k for q, found in got.items()}


@pytest.mark.parametrize("options", [{}, {"top": 128, "degree": 16, "width": 64}])
def test_queries_inside_tight_clusters_get_out(spark, options):
    """Short vectors whose nearest ones by inner product are a cluster of longer ones far from them in the graph; with
    a small ``top`` there are several levels with graphs."""
    rng = np.random.default_rng(6)
    axes = rng.standard_normal((20, 16))
    axes /= np.linalg.norm(axes, axis=1)[:, None]
    rows = {}
    for i in range(4000):
        length = 1.0 + i // 100 % 2
        rows[i] = ((axes[i // 200] + 0.01 * rng.standard_normal(16)) * length).tolist()
    frame = spark.createDataFrame(list(rows.items()), "vec_id bigint, embedding array<double>")
    recall = recall_of(frame, rows, 20, **options)
    assert np.mean(list(recall.values())) >= 0.9
    assert np.mean([x for q, x in recall.items() if q // 100 % 2 == 0]) >= 0.9  # the short ones alone


def test_search_widens_until_the_measured_recall(spark, monkeypatch):
    rng = np.random.default_rng(7)
    rows = {i: rng.standard_normal(12).tolist() for i in range(600)}
    frame = spark.createDataFrame(list(rows.items()), "vec_id bigint, embedding array<double>")
    recall = recall_of(frame, rows, 20, degree=8, width=20, top=64, target=0.99)
    assert np.mean(list(recall.values())) >= 0.95
    monkeypatch.setattr(neighbours, "measured_recall", lambda *_: 0.5)
    with pytest.warns(UserWarning, match="recall 0.500"):
        neighbours.nearest(frame, F.col("id") % 20 == 0, degree=8, width=600, top=64)


def test_nearest_of_few_and_of_none(spark):
    schema = "vec_id bigint, embedding array<float>"
    few = spark.createDataFrame([(20, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [2.0, 0.0])], schema)
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in neighbours.nearest(few, F.col("id") % 20 == 0).orderBy("rank").collect()]
    assert got == [(20, 1, 2, 2.0), (20, 2, 1, 0.5)]
    alone = spark.createDataFrame([(20, [1.0, 0.0])], schema)
    assert neighbours.nearest(alone, F.col("id") % 20 == 0).count() == 0
    assert neighbours.nearest(alone.limit(0), F.col("id") % 20 == 0).count() == 0


def test_pipeline_stages_feed_each_other(spark):
    docs = read_table(spark, SMALL, "documents").withColumn("n_chars", F.col("n_chars").cast("long"))
    odd = spark.createDataFrame([(90001, None, "en", None, 0), (90002, "", None, "x", 0)], docs.schema)
    docs = docs.unionByName(odd)
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:3]:
        after = stage(spark, docs, SMALL)
        assert after.columns == docs.columns
        kept = {r.doc_id for r in after.select("doc_id").collect()}
        assert kept <= {r.doc_id for r in docs.select("doc_id").collect()} and len(kept) <= before, name
        docs = spark.createDataFrame(after.collect(), after.schema)
    mixed = corpus_pipeline.mix_sources(spark, docs, SMALL)
    assert mixed.columns == docs.columns
    mixed = spark.createDataFrame(mixed.collect(), mixed.schema)
    pieces = corpus_pipeline.pack_sequences(spark, mixed, SMALL)
    assert pieces.where("piece = 0").count() == mixed.count()


def test_pipeline_on_an_empty_table(spark):
    docs = read_table(spark, SMALL, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
        assert docs.count() == 0
        docs = spark.createDataFrame([], docs.schema)


#: Names that the operators of the stages use for themselves.
CLASHING = (
    "n_bytes n_removed n_spans spans kept open doc at name context _doc _rows _gone _d _null _hash _i _h _n _size _copy _c _z _s _stats "
    "stats base_failed quality fingerprint label component_id copies size n rate target source_size piece start length sequence_id offset"
).split()


def test_stages_carry_columns_of_any_name(spark):
    docs = read_table(spark, SMALL, "documents").withColumn("n_chars", F.col("n_chars").cast("long"))
    docs = docs.where("doc_id < 150")
    docs = docs.unionByName(docs.where("doc_id < 10"))  # repeated rows
    wide = docs.withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in CLASHING})
    for name, stage in corpus_pipeline.STAGES[:4]:
        plain = stage(spark, docs, SMALL)
        got = stage(spark, wide, SMALL)
        assert got.columns == wide.columns, name
        rows = got.collect()
        assert sorted(map(repr, plain.collect())) == sorted(map(repr, got.select(*docs.columns).collect())), name
        assert all(r[c] == f"{c}{r.doc_id}" for r in rows for c in CLASHING), name
    name, stage = corpus_pipeline.STAGES[4]
    assert sorted(map(tuple, stage(spark, docs, SMALL).select("doc_id", "piece", "start", "length").collect())) == sorted(
        map(tuple, stage(spark, wide, SMALL).select("doc_id", "piece", "start", "length").collect())
    )


def test_repeats_replace_columns_of_their_own_names(spark):
    docs = spark.createDataFrame([(1, "a" * 300, 7, "x"), (2, "b", 8, "y"), (2, "b", 8, "y")], "doc_id bigint, text string, n_bytes int, _rows string")
    got = suffix_dedup.deduplicated(docs)
    assert got.columns == ["doc_id", "_rows", "n_bytes", "n_removed", "n_spans", "spans", "kept"]
    assert sorted((r.doc_id, r._rows, r.n_bytes) for r in got.collect()) == [(1, "x", 300), (2, "y", 1), (2, "y", 1)]
