"""Registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from frota.llm import collocations, exact_topk, html_text, interpolation, lexical_search, mixing, neighbours, packing, preference, quality_rules, simhash, suffix_dedup, toxicity
from frota.llm.common import crc_part, read_table, stored

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    REGISTRY[fn.__name__] = fn
    return fn


@query
def op6_quality_rules(spark, d):
    docs, labels = read_table(spark, d, "documents"), read_table(spark, d, "labels")
    rules = quality_rules.learned(docs, labels)
    stats = quality_rules.with_statistics(docs, keep=["doc_id"])
    return quality_rules.judged(stats, rules).select(
        "doc_id", *[f"stats.{name}" for name in quality_rules.BASE], "base_failed", "kept", "rule"
    )


@query
def op5_mixing(spark, d):
    mix = mixing.mix(read_table(spark, d, "documents"))
    return mix.withColumn("_row", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "rate", "source"
    )


@query
def op10_packing(spark, d):
    return packing.packed(read_table(spark, d, "documents")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


@query
def op7_simhash(spark, d):
    prints = stored(simhash.with_fingerprints(read_table(spark, d, "documents")), "prints")
    return simhash.with_components(prints).select(
        "doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id"
    )


@query
def op2_suffix_dedup(spark, d):
    docs = read_table(spark, d, "documents").select("doc_id", "text")
    return suffix_dedup.deduplicated(docs).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )


@query
def op8_interpolation(spark, d):
    docs = read_table(spark, d, "documents").withColumn("_learns", interpolation.crc_training())
    return interpolation.scored(docs, "_learns")


@query
def op1_toxicity(spark, d):
    docs = read_table(spark, d, "documents")
    learns = read_table(spark, d, "labels").where(crc_part("doc_id", 5) != 0)
    scores = toxicity.scored(docs, toxicity.learned(docs, learns))
    return scores.withColumn("held_out", crc_part("doc_id", 5) == 0)


@query
def op3_html_text(spark, d):
    return html_text.extracted(read_table(spark, d, "pages")).withColumn("n_chars", F.length("text").cast("long"))


@query
def op4_preference(spark, d):
    sides = preference.shortened_pairs(read_table(spark, d, "conversations"))
    return preference.formatted(*sides).withColumnRenamed("pair_id", "conv_id")


ORACLES["op4_preference"] = """
WITH ends AS (
    SELECT conv_id, max(turn) AS last_turn FROM conversations WHERE role = 'assistant' GROUP BY conv_id
), every_ AS (
    SELECT c.conv_id, c.turn, c.role, c.text, e.last_turn, e.last_turn IS NULL OR coalesce(c.turn <= e.last_turn, false) AS paired
    FROM conversations c LEFT JOIN ends e USING (conv_id)
), rows_ AS (
    SELECT * FROM every_ WHERE paired
), chosen AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
           row_number() OVER (PARTITION BY conv_id, turn ORDER BY role, text) AS copy
    FROM rows_
), halves AS (
    SELECT conv_id, turn, coalesce(role, '') AS role,
           coalesce(CASE WHEN turn = last_turn AND role = 'assistant' THEN left(text, length(text) // 2) ELSE text END, '') AS text
    FROM rows_
), rejected AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY role, text) AS copy FROM halves
), firsts AS (
    SELECT conv_id, min((turn, copy)) AS at FROM chosen c FULL JOIN rejected r USING (conv_id, turn, copy)
    WHERE c.text IS NULL OR r.text IS NULL OR (c.role, c.text) <> (r.role, r.text) GROUP BY conv_id
), parts AS (
    SELECT c.*, CASE WHEN f.at IS NULL OR (c.turn, c.copy) < f.at THEN 'prompt' ELSE 'chosen' END AS part
    FROM chosen c LEFT JOIN firsts f USING (conv_id)
    UNION ALL
    SELECT r.*, 'rejected' FROM rejected r JOIN firsts f USING (conv_id) WHERE (r.turn, r.copy) >= f.at
    UNION ALL
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
           row_number() OVER (PARTITION BY conv_id, turn ORDER BY coalesce(role, ''), coalesce(text, '')) AS copy, 'unpaired' FROM every_ WHERE NOT paired
)
SELECT conv_id, part, turn, CAST(copy AS INT) AS copy, role, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS rendered,
       CAST(CASE WHEN part IN ('chosen', 'rejected') AND role = 'assistant' THEN length(role) + 5 ELSE 0 END AS BIGINT) AS learn_from,
       CAST(CASE WHEN part IN ('chosen', 'rejected') AND role = 'assistant' THEN length(role) + 5 + length(text) + 8 ELSE 0 END AS BIGINT) AS learn_to
FROM parts
"""


@query
def op9_neighbours(spark, d):
    return neighbours.nearest(read_table(spark, d, "embeddings"), F.col("id") % 20 == 0)


@query
def op11_exact_topk(spark, d):
    return exact_topk.top_k(read_table(spark, d, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


ORACLES["op11_exact_topk"] = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
    FROM v a JOIN v b ON a.vec_id % 50 = 0 AND b.vec_id <> a.vec_id
), ranked AS (
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


@query
def op13_lexical_search(spark, d):
    return lexical_search.search(read_table(spark, d, "benchmark"), read_table(spark, d, "documents"), k=20)


ORACLES["op13_lexical_search"] = r"""
WITH doc_terms AS (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
), item_terms AS (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), sizes AS (
    SELECT doc_id, count(*) AS n FROM doc_terms GROUP BY doc_id
), totals AS (
    SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS l FROM sizes
), lengths AS (
    SELECT doc_id, 75 + (25 * n * nn) // l AS m FROM sizes, totals
), tfs AS (
    SELECT doc_id, term, count(*) AS tf FROM doc_terms GROUP BY doc_id, term
), weights AS (
    SELECT term, CAST(floor(1000 * ln((2 * nn + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tfs, totals GROUP BY term, nn
), scored AS (
    SELECT i.item_id, t.doc_id, CAST(sum(w.w * ((1000000000 * t.tf) // (1000 * t.tf + 12 * m.m))) AS BIGINT) AS score
    FROM item_terms i JOIN tfs t USING (term) JOIN weights w USING (term) JOIN lengths m ON m.doc_id = t.doc_id
    GROUP BY i.item_id, t.doc_id
), ranked AS (
    SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score
    FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""


@query
def op12_collocations(spark, d):
    return collocations.mined(read_table(spark, d, "documents"))


ORACLES["op12_collocations"] = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents
), worded AS (
    SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), totals AS (
    SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM worded GROUP BY lang
), placed AS (
    SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM worded
), grams AS (
    SELECT lang, w[i:i + k - 1] AS g, count(*) AS a FROM placed, (SELECT unnest(range(1, 6)) AS k) sizes
    WHERE i + k - 1 <= len(w) GROUP BY ALL HAVING count(*) >= 100
), kept AS (
    SELECT lang, g, a FROM grams p WHERE len(g) >= 2 AND NOT EXISTS (
        SELECT 1 FROM grams q WHERE q.lang = p.lang AND len(q.g) > len(p.g) AND q.a >= p.a
        AND ' ' || array_to_string(q.g, ' ') || ' ' LIKE '%' || ' ' || replace(replace(replace(array_to_string(p.g, ' '), '\', '\\'), '%', '\%'), '_', '\_') || ' ' || '%' ESCAPE '\')
), cuts AS (
    SELECT lang, g, a, unnest(range(1, len(g))) AS k FROM kept
), parts AS (
    SELECT c.lang, c.g, c.a, c.k, x.a AS l, y.a AS r, t.n,
           CAST((CAST(1000 AS HUGEINT) * c.a * t.n) // (CAST(x.a AS HUGEINT) * y.a) AS BIGINT) AS score
    FROM cuts c JOIN grams x ON x.lang = c.lang AND x.g = c.g[1:c.k] JOIN grams y ON y.lang = c.lang AND y.g = c.g[c.k + 1:]
    JOIN totals t ON t.lang = c.lang
), worst AS (
    SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY score, k) AS place FROM parts
), ranked AS (
    SELECT *, array_to_string(g, ' ') AS phrase,
           row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(array_to_string(g, ' '))) AS rank FROM worst WHERE place = 1
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
"""
