"""Exact top-k, phrase mining and ranked lexical search against brute force, with edge cases."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from frota.llm import collocations, exact_topk, lexical_search

VECTORS = "vec_id bigint, embedding array<float>, score bigint, id string, vector int"
DOCS = "doc_id bigint, text string, lang string, rank int, block int"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ---- exact top-k


def brute_top(rows, k):
    usable = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in usable:
        if q is not None and q % 50 == 0:
            scored = [(sum(x * y for x, y in zip(a, b)), i) for i, b in usable if i != q]
            scored = [(max(min(s, 2**63 - 1), -(2**63)), i) for s, i in scored]
            scored.sort(key=lambda t: (-t[0], t[1] is None, t[1] or 0))
            out += [(q, r + 1, i, s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out, key=repr)


def run_top(spark, rows, k=5):
    table = spark.createDataFrame([(i, v, 7, "x", 1) for i, v in rows], VECTORS)
    return sorted([tuple(r) for r in exact_topk.top_k(table, F.col("vec_id") % 50 == 0, k).collect()], key=repr)


def test_top_k_matches_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 40))
    rows = [(i, [float(x) for x in (centres[i % 6] + rng.normal(size=40) * 0.3) / 8]) for i in range(900)]
    rows += [(1000 + i, rows[i][1]) for i in range(30)]  # ties
    for name, value in (("BLOCK_ROWS", 64), ("SLOT_ROWS", 256), ("QUERY_ROWS", 8), ("_QUERIES", 5)):
        monkeypatch.setattr(exact_topk, name, value)
    assert run_top(spark, rows) == brute_top(rows, 5)
    assert run_top(spark, rows, 200) == brute_top(rows, 200)


def test_top_k_of_odd_vectors(spark):
    rows = [
        (0, [0.5, -0.25, 0.1]),
        (50, []),
        (100, [0.0, 0.0]),
        (1, [0.5]),
        (2, None),
        (3, [0.1, None]),
        (4, [float("nan"), 1.0]),
        (5, [float("inf")]),
        (None, [0.5, -0.25, 0.1]),
        (6, [1e30, 1.0]),
        (150, [3e38, -3e38]),
        (7, [0.5]),
        (7, [0.5]),
        (200, [0.25] * 70),
    ]
    assert run_top(spark, rows) == brute_top(rows, 5)
    assert run_top(spark, rows[:1]) == []
    assert run_top(spark, rows[3:4]) == []
    assert run_top(spark, []) == []
    assert run_top(spark, [(2, None)]) == []


def test_compaction_drops_pairs_before_the_last_dimension_block():
    rng = np.random.default_rng(5)
    vectors = np.floor(rng.normal(size=(300, 64)) * 256 * np.linspace(2, 0.05, 64))
    block = exact_topk.Block(exact_topk._block_row(0, list(range(300)), vectors)).loaded(list(range(4)))
    score = vectors @ vectors.T
    floor = np.sort(score, axis=1)[:, -3].copy()
    q, c, s = exact_topk.survivors(block, slice(0, 300), floor, block)
    want = np.argwhere(score >= floor[:, None])
    assert sorted(zip(q, c)) == sorted(map(tuple, want)) and np.array_equal(s, score[q, c].astype(np.int64))
    assert np.all(np.diff([r.sum() for r in block.rest]) <= 0) and block.rest[-1].max() == 0


# ---- phrases


def brute_phrases(docs, least, longest=5, most=2000):
    n, counts = Counter(), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    counts[lang, tuple(words[i : i + k])] += 1
    good = {p: c for p, c in counts.items() if len(p[1]) > 1 and c >= least}

    def inside(p, q):
        return any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))

    rows = {}
    for (lang, p), a in good.items():
        if any(la == lang and len(q) > len(p) and c >= a and inside(p, q) for (la, q), c in good.items()):
            continue
        cuts = []
        for k in range(1, len(p)):
            left, right = counts[lang, p[:k]], counts[lang, p[k:]]
            cuts.append((1000 * a * n[lang] // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        rows.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), left, right))
    return sorted(
        (lang, i + 1, p.decode(), -a, left, right, n[lang], -score)
        for lang, found in rows.items()
        for i, (score, a, p, left, right) in enumerate(sorted(found)[:most])
    )


def run_phrases(spark, docs, least, **options):
    table = spark.createDataFrame([(i, t, lang, 1, 2) for i, (t, lang) in enumerate(docs)], DOCS)
    return sorted(tuple(r) for r in collocations.mined(table, least, **options).collect())


def phrase_docs(n, seed):
    rng = random.Random(seed)
    stock = ["new york city hall", "a b a b a", "über die straße", "x_y 100% sure\\", "the the the the the the"]
    docs = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randrange(12)):
            parts.append(rng.choice(stock) if rng.random() < 0.4 else rng.choice(["the", "Cat", "dog", "ÀÉ", "\x00", "q"]))
            parts.append(rng.choice([" ", " ", " ", "\t", ". ", "\n", "\x0b", ", "]))
        docs.append(("".join(parts), rng.choice(["en", "en", "de", None])))
    return docs


@pytest.mark.parametrize("slice_words", [1_000_000, 40])
def test_phrases_match_brute_force(spark, monkeypatch, slice_words):
    docs = phrase_docs(400, 11) + [(None, "en"), ("", None), (" \t\n.", "fr"), ("Cat dog " * 3000, "en")] + [("one line twice over", "xx")] * 7
    monkeypatch.setattr(collocations, "SLICE_WORDS", slice_words)
    assert run_phrases(spark, docs, 5, block_words=700) == brute_phrases(docs, 5)
    assert run_phrases(spark, docs, 5, most=3) == brute_phrases(docs, 5, most=3)


def test_phrases_of_nothing(spark):
    assert run_phrases(spark, [], 1) == []
    assert run_phrases(spark, [(None, None), ("", "en"), ("...", "en"), ("alone", "en")], 1) == []
    assert run_phrases(spark, [("a b", None)], 1) == brute_phrases([("a b", None)], 1)


def test_stripes_merge_to_totals_and_extensions(spark):
    texts = [spark.createDataFrame([(t, "en")], "text string, lang string") for t in ("a b a c a.", "a b", "c")]
    table = texts[0].unionByName(texts[1]).unionByName(texts[2])
    blocks = collocations.stored(collocations.encoded(table), "test-blocks")
    cut = collocations.Cut(3, 2, {"en": {"a": 4}})
    first = collocations.merged(collocations.stripes(blocks, 0, cut), 2, answered=False).collect()
    assert sum(r.total for r in first) == 8
    assert {w: n for r in first for w, n in zip(r.nexts, r.counts)} == {"a": 4, "b": 2, "c": 2}
    merged = collocations.merged(collocations.stripes(blocks, 1, cut), 2).collect()
    assert len([r for r in merged if r.prefix == "a"]) == len({zlib.crc32(w) % 2 for w in (b"b", b"c")})
    totals, extensions = Counter(), Counter()
    for r in merged:
        if r.prefix is not None:
            totals[r.prefix] += r.total
            extensions.update({(r.prefix, w): n for w, n in zip(r.nexts, r.counts)})
    assert totals == {"a": 4, "b": 2, "c": 2} and extensions == {("a", "b"): 2}
    told = [r for r in merged if r.block is not None]
    assert len({r.block for r in told}) == 2 and all(collocations._numbers(r.ns, np.int64).tolist() == [2] for r in told)


# ---- ranked lexical search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute_search(items, docs, k=20):
    texts = [(i, TERM.findall((t or "").translate(LOWER))) for i, t in docs]
    texts = [(i, w, Counter(w)) for i, w in texts if w]
    n_docs, n_words = len(texts), sum(len(w) for _, w, _ in texts)
    df = Counter(t for _, _, c in texts for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, w, c in texts:
            m = 100 - 25 + (25 * len(w) * n_docs) // n_words
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m))
                for t in TERM.findall((text or "").translate(LOWER))
                if t in c
            )
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def run_search(spark, items, docs, k=20):
    asked = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id bigint, text string, doc_id int")
    table = spark.createDataFrame([(i, t, "en", 1, 2) for i, t in docs], DOCS)
    return sorted([tuple(r) for r in lexical_search.search(asked, table, k).collect()], key=repr)


def search_docs(n, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(150)] + ["Straße", "日本", "it's", "A1-b2", "UPPER"]
    weight = [1 / (i + 1) for i in range(len(words))]
    return [(i, " ".join(rng.choices(words, weight, k=rng.randrange(60)))) for i in range(n)]


def test_search_matches_brute_force(spark, monkeypatch):
    docs = search_docs(700, 2) + [(5, "w1 w2"), (5, "w1 w2"), (None, "w140 w141 w3"), (900, None), (901, ""), (902, "w149 " * 5000)]
    items = [(i, t) for i, t in search_docs(20, 9)] + [(90, None), (91, ""), (92, "nowhere"), (93, "w0 w0 w0 W0"), (94, " ".join(f"w{i}" for i in range(150)))]
    want = brute_search(items, docs)
    assert run_search(spark, items, docs) == want
    monkeypatch.setattr(lexical_search, "BLOCK_DOCS", 50)
    monkeypatch.setattr(lexical_search, "ITEM_BYTES", 400)
    assert run_search(spark, items, docs) == want
    assert run_search(spark, items, docs, k=3) == brute_search(items, docs, 3)


def test_search_of_nothing(spark):
    assert run_search(spark, [], [(1, "a")]) == []
    assert run_search(spark, [(1, "a")], []) == []
    assert run_search(spark, [(1, "a")], [(1, None), (2, "-- .")]) == []
    assert run_search(spark, [(1, "--"), (None, "b b")], [(1, "b"), (2, "a")]) == brute_search([(1, "--"), (None, "b b")], [(1, "b"), (2, "a")])


def test_masks_group_documents_by_their_terms():
    lists = [np.array([0, 2, 4]), np.array([2, 4, 5])] + [np.array([1])] * 70
    docs, group, holds = lexical_search.masks(lists, 7)
    assert docs.tolist() == [0, 1, 2, 4, 5]
    for d, g in zip(docs, group, strict=True):
        assert holds[g].tolist() == [d in x for x in lists]
    assert group[2] == group[3] and len(set(group)) == 4
