"""Operators over single texts and documents against brute force, with edge cases."""

import hashlib
import math
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from frota.llm import html_text, interpolation, mixing, packing, preference, quality_rules, queries, simhash, suffix_dedup, toxicity
from frota.llm.common import crc_part, stored

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = " ".join(f"w{i * 7919 % 100003}" for i in range(6000))
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog. " * 5),
    (2, "The quick brown fox jumps over the lazy dog. " * 5),
    (3, None),
    (4, ""),
    (5, " \t\n "),
    (6, "öäü ß — 日本語 😀 <|endoftext|> it's  two blanks\n \n x"),
    (7, LONG),
    (8, LONG + " and a new end that was never seen before anywhere else in here"),
    (9, "one"),
    (9, "one"),
    (9, "another text under the same id"),
    (None, "no id"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", None if i == 4 else f"s{(i or 0) % 3}", len(t or "")) for i, t in TEXTS]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# ---- quality rules


def brute_statistics(text):
    w = words(text)
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {i + j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(5)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return (len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit))


def test_statistics_match_brute_force(spark, docs):
    rows = quality_rules.with_statistics(docs, name="lang").collect()  # a clashing column is replaced
    assert len(rows) == len(TEXTS)
    for row in rows:
        assert tuple(row.lang[n] for n in quality_rules.BASE) == brute_statistics(row.text)
    repeated = "a b c d e f a b c d e x\nq\nq\n#*q"
    assert quality_rules.text_statistics(repeated)[:5] == brute_statistics(repeated)


def test_rules_cover_bad_rows_and_become_one_expression(spark):
    n = 600
    rows = [(i, " ".join(f"word{j}x{i}" + ("" if i % 3 else "###") for j in range(20))) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(n)] + [(1, 0), (None, 1)], "doc_id bigint, quality int")
    rules = quality_rules.learned(docs, labels, sample=300)
    assert rules == quality_rules.learned(docs, labels, sample=300)
    assert rules and all(r.precision > 0.9 for r in rules)
    judged = quality_rules.judged(quality_rules.with_statistics(docs), rules).where("not base_failed")
    assert judged.where((F.col("doc_id") % 3 > 0) & ~F.col("kept")).count() == 0
    assert judged.where((F.col("doc_id") % 3 == 0) & F.col("kept")).count() == 0


def test_rules_without_labels(spark, docs, empty):
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    assert quality_rules.learned(docs, labels) == []
    assert quality_rules.judged(quality_rules.with_statistics(empty), []).count() == 0


# ---- SimHash


def brute_fingerprint(text):
    w = words(lower(text))
    if not w:
        return 0
    hashes = [xxhash.xxh64(" ".join(w[i : i + 3]).encode(), seed=42).intdigest() for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_match_brute_force():
    for _, text in TEXTS:
        assert simhash.fingerprint((text or "").encode()) == brute_fingerprint(text)


def brute_groups(prints, threshold=2):
    parent = {p: p for p in prints}

    def find(p):
        while parent[p] != p:
            p = parent[p]
        return p

    for a in parent:
        for b in parent:
            if a != b and bin(a ^ b).count("1") <= threshold:
                parent[find(a)] = find(b)
    return {p: find(p) for p in parent}


def test_components_of_a_dense_cluster_and_chains(spark):
    rng = np.random.default_rng(3)
    centre = int(rng.integers(1 << 62))
    prints = {0, centre}
    for _ in range(900):  # many within a few bits of one centre: crowded anchors
        p = centre
        for bit in rng.integers(0, 64, rng.integers(1, 5)):
            p ^= 1 << int(bit)
        prints.add(p)
    chain = int(rng.integers(1 << 62))
    for i in range(0, 60, 2):  # steps of two bits each
        chain ^= 3 << i
        prints.add(chain)
    prints |= {int(x) for x in rng.integers(1 << 62, size=300)}
    ids = {p: i for i, p in enumerate(sorted(prints))}
    signed = lambda p: p - (1 << 64) if p >> 63 else p
    rows = [(i, signed(p)) for p, i in ids.items()] + [(5000, signed(centre)), (5000, signed(centre))]
    frame = stored(spark.createDataFrame(rows, "doc_id bigint, fingerprint bigint"), "test-prints")
    got = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.with_components(frame).collect()}
    groups = brute_groups(prints)
    least = {}
    for p, g in groups.items():
        least[g] = min(least.get(g, 1 << 60), ids[p])
    assert got == {**{(ids[p], signed(p)): least[g] for p, g in groups.items()}, (5000, signed(centre)): least[groups[centre]]}


def test_hot_anchors_are_sliced_without_losing_links(spark, monkeypatch):
    monkeypatch.setattr(simhash, "_HOT_HOMES", 20)
    rng = np.random.default_rng(5)
    prints = {int(rng.integers(1 << 50)) << 50 & (1 << 63) - 1 | 7 for _ in range(200)}
    frame = stored(spark.createDataFrame([(i, p) for i, p in enumerate(sorted(prints))], "doc_id bigint, fingerprint bigint"), "test-prints")
    got = simhash.with_components(frame).groupBy("component_id").count().count()
    assert got == len(set(brute_groups(prints).values()))


def test_one_document_of_each_group_stays(spark, docs, empty):
    kept = simhash.representatives(docs)
    assert kept.columns == docs.columns
    groups = {}
    table = brute_groups({brute_fingerprint(t) for _, t in TEXTS})
    for i, t in TEXTS:
        groups.setdefault(table[brute_fingerprint(t)], []).append((i is None, i or 0))
    got = sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect())
    assert got == sorted(min(g) for g in groups.values())
    assert simhash.representatives(empty).count() == 0


# ---- repeated byte strings


def brute_repeats(rows, threshold=100):
    seen, out = set(), []
    for body in rows:
        gone = bytearray(len(body))
        for p in range(len(body) - threshold + 1):
            part = body[p : p + threshold]
            if part in seen:
                gone[p : p + threshold] = b"\1" * threshold
            seen.add(part)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(body), sum(gone), spans, bytes(b for b, g in zip(body, gone) if not g)))
    return out


def check_repeats(spark, texts):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.deduplicated(frame).collect()}
    assert got == dict(enumerate(brute_repeats([(t or "").encode() for t in texts])))


def test_repeats_match_brute_force(spark):
    rng = np.random.default_rng(1)
    letters = np.array(list("abcde fgé"))
    make = lambda n: "".join(rng.choice(letters, n))
    shared = [make(n) for n in (99, 100, 101, 150, 400)]
    texts = [None, "", "x" * 350, "ab" * 200, make(99), shared[4], shared[4]]
    for _ in range(60):
        parts = []
        for _ in range(rng.integers(1, 5)):
            source = shared[rng.integers(len(shared))]
            a, b = sorted(rng.integers(0, len(source) + 1, 2))
            parts += [make(rng.integers(0, 80)), source[a:b] if rng.random() < 0.5 else source]
        texts.append("".join(parts))
    check_repeats(spark, texts)


def test_repeats_in_long_texts_and_many_copies(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "_SLICE", 700)
    rng = np.random.default_rng(2)
    base = "".join(rng.choice(list("abcdefgh "), 6000))
    check_repeats(spark, [base, base[1000:4000], *[base[200:420]] * 40, base[::-1] + base[:500], "k" * 5000])


def test_repeats_with_odd_ids(spark, docs, empty):
    rows = suffix_dedup.deduplicated(docs, as_text=True).collect()
    assert len(rows) == len(TEXTS)
    assert [r.n_removed for r in rows if r.doc_id == 2] == [len(TEXTS[1][1])]
    assert all(r.kept == (dict(TEXTS)[r.doc_id] or "") for r in rows if r.doc_id in (3, 4, 5, 6, 7))
    assert suffix_dedup.deduplicated(empty).count() == 0


# ---- mixing


def brute_targets(sizes, weights=(1, 2, 3), cap=3.0):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = [s for s in order if s not in full]
        left = total - sum(cap * sizes[s] for s in full)
        share = left / max(1, sum(weight[s] for s in rest))
        more = {s for s in rest if share * weight[s] > cap * sizes[s]}
        if not more:
            return {s: cap * sizes[s] if s in full else share * weight[s] for s in order}
        full |= more


def test_mix_reaches_targets(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(600):
        source = None if i % 10 == 0 else "big" if i % 2 else f"s{i % 7}"
        rows.append((i, " ".join(["w"] * int(rng.integers(0, 200))), "en", source, 0))
    rows += [(700, None, "en", "tiny", 0), (701, "a b c", "en", "tiny", 0), (701, "a b c", "en", "tiny", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    mix = mixing.mix(docs).toPandas()
    sizes = Counter()
    for _, t, _, s, _ in rows:
        sizes[s] += len((t or "").split())
    want = brute_targets(sizes)
    for source, group in mix.groupby("source", dropna=False):
        source = source if isinstance(source, str) else None
        assert group.source_size.iloc[0] == sizes[source]
        assert math.isclose(group.target.iloc[0], want[source], rel_tol=1e-9, abs_tol=1e-6)
        taken = (group.copies * group["size"] * group.n).sum()
        assert abs(taken - want[source]) <= max(6, 0.02 * want[source])
        assert group.copies.max() <= 3
    again = mixing.mix(docs.repartition(5)).toPandas()
    key = ["doc_id", "source", "size", "copies"]
    assert mix[key].sort_values(key).reset_index(drop=True).equals(again[key].sort_values(key).reset_index(drop=True))
    assert mixing.repeated(docs, mixing.mix(docs)).count() == (mix.copies * mix.n).sum()


def test_mix_of_nothing(spark, empty):
    assert mixing.mix(empty).count() == 0


# ---- packing


def test_best_fit_plan_places_every_piece_once():
    rng = np.random.default_rng(6)
    counts = {int(k): int(rng.integers(1, 40)) for k in rng.integers(1, 65, 40)}
    slots = Counter()
    filled = Counter()
    for length, a, b, first, offset in packing.best_fit_plan(counts, 64):
        for r in range(a, b):
            slots[length, r] += 1
            for t in range(offset, offset + length):
                filled[first + r - a, t] += 1
    assert set(slots) == {(k, r) for k, n in counts.items() for r in range(n)} and set(slots.values()) == {1}
    assert set(filled.values()) == {1} and max(t for _, t in filled) < 64
    assert all((s, t - 1) in filled for s, t in filled if t)
    rooms = []  # best-fit decreasing piece by piece
    for length in sorted((k for k, n in counts.items() for _ in range(n)), reverse=True):
        fits = [(room, i) for i, room in enumerate(rooms) if room >= length]
        if fits:
            rooms[min(fits)[1]] -= length
        else:
            rooms.append(64 - length)
    assert len({s for s, _ in filled}) == len(rooms)


def test_pieces_round_trip(spark, docs, empty):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.vocabulary_path())
    encode = packing.TokenBytes(packing.vocabulary_path())
    for text in ("a  <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>y.", " <|endoftext|>\n\n<|endoftext| >", LONG + " <|endoftext|>"):
        assert np.frombuffer(encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    assert 50256 in np.frombuffer(encode("a <|endoftext|>"), "<u4")
    rows = packing.packed(docs, capacity=64, with_ids=True).collect()
    encoded = {(i, tuple([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2])) for i, t in TEXTS}
    found, current = [], {}
    for r in sorted(rows, key=lambda r: (str(r.doc_id), r.ids_crc32)):
        ids = np.frombuffer(bytes(r.ids), "<u4")
        assert len(ids) == r.length <= 64 and zlib.crc32(bytes(r.ids)) == r.ids_crc32
        current.setdefault(r.doc_id, []).append((r.piece, r.start, tuple(ids.tolist())))
    for i, pieces in current.items():
        total = sum(len(p[2]) for p in pieces)
        assert total == sum(len(e) for j, e in {(a, b) for a, b in encoded} if j == i) + (2 if i == 9 else 0)
        if i not in (9,):
            whole = tuple(x for p in sorted(pieces) for x in p[2])
            assert (i, whole) in encoded
            found.append(i)
    assert len(found) == len({i for i, _ in TEXTS}) - 1
    ends = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert packing.packed(empty).count() == 0


# ---- language model


def test_scores_and_counts(spark, docs, empty):
    rows = docs.withColumn("_learns", interpolation.crc_training())
    scored = interpolation.scored(rows, "_learns").collect()
    assert len(scored) == len(TEXTS)
    counts = Counter()
    learns = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2
    for i, t in TEXTS:
        if learns(i):
            counts.update([*words(lower(t)), None])
    n, v = sum(counts.values()), len(counts)
    want = Counter()
    for i, t in TEXTS:
        tokens = [*words(lower(t)), None]
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens)
        want[i, not learns(i), len(tokens), sum(counts[w] > 0 for w in tokens), n, round(base, 6)] += 1
    assert want == Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in scored)
    assert all(r.score < 0 for r in scored)
    assert interpolation.scored(empty.withColumn("_learns", F.lit(True)), "_learns").count() == 0


def test_probabilities_sum_to_one(spark):
    rng = np.random.default_rng(8)
    vocabulary = [f"w{i}" for i in range(12)]
    rows = [(i, " ".join(rng.choice(vocabulary, 30)), True) for i in range(40)]
    seen = sorted({w for _, t, _ in rows for w in t.split()})
    # each probe is a context followed by one word; scores of w0 + word minus end terms are not needed:
    # compare the model's own next-word probabilities through single-word texts
    probes = [(1000 + j, w, False) for j, w in enumerate([*seen, "unseen"])] + [(2000, "", False)]
    scored = {r.doc_id: r for r in interpolation.scored(spark.createDataFrame(rows + probes, "doc_id bigint, text string, learns boolean"), "learns").collect()}
    # P(w | start) P(end | w) summed over w and further texts cannot exceed 1
    total = sum(10 ** scored[i].score for i in [*range(1000, 1000 + len(seen) + 1), 2000])
    assert 0 < total <= 1 + 1e-9


def test_weights_by_expectation_maximisation():
    import pandas as pd

    histogram = pd.DataFrame({"bucket": [3, 3], "p2": [10.0, 0.0], "p1": [1.0, 1.0], "n": [900, 100]})
    weights = interpolation.learn_weights(histogram)
    assert np.allclose(weights.sum(axis=1), 1) and weights[3, 0] > 0.8
    assert np.allclose(weights[4], weights[3]) and weights[2, 0] == 0


# ---- toxicity


def test_toxic_words_are_found_on_held_out_texts(spark, empty):
    rng = np.random.default_rng(9)
    plain = [f"{a}{b}" for a in ("ba", "do", "ki", "lu", "me", "no", "ra", "so", "tu", "we") for b in ("ran", "ling", "mo", "pes", "da", "ti")]
    bad = ["vexquz", "grumpfz", "zzyrkh"]
    rows, labels = [], []
    for i in range(900):
        body = list(rng.choice(plain, 60))
        if i % 4 == 0:
            for at in rng.integers(0, 60, 4):
                body[at] = bad[rng.integers(3)]
        rows.append((i, " ".join(body)))
        labels.append((i, int(i % 4 == 0)))
    rows += [(1000, None), (1001, ""), (1002, "Vexquz " * 3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    marked = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    model = toxicity.learned(docs, marked.where(crc_part("doc_id", 5) != 0))
    got = {r.doc_id: r for r in toxicity.scored(docs, model).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got.values())
    held = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i].predicted == (i % 4 == 0) for i in held]) > 0.9
    assert got[1000].predicted == got[1001].predicted == 0 and got[1000].windows == 0
    assert toxicity.scored(empty, model).count() == 0


def test_toxic_phrases_of_ordinary_words():
    rng = np.random.default_rng(3)
    plain = [f"{a}{b}" for a in ("ba", "do", "ki", "lu", "me", "no", "ra", "so", "tu", "we") for b in ("ran", "ling", "mo", "pes", "da", "ti")]
    bad = [[plain[i] for i in at] for at in ((3, 17, 42, 8), (25, 50, 11, 33), (59, 2, 30, 21))]
    texts = {0: [], 1: []}
    for i in range(900):
        body = list(rng.choice(plain, 60))
        for at in rng.integers(0, 56, 3):
            body[at : at + 4] = bad[rng.integers(3)] if i % 4 == 0 else rng.permutation(bad[rng.integers(3)])
        texts[int(i % 4 == 0)].append(" ".join(body).encode())
    model = toxicity.fit(texts[1][:180], texts[0][:540])
    distances = model.distances.open()
    toxic, ordinary = ([model.score(np.array([toxicity.features(*distances(t))]))[0] for t in some] for some in (texts[1][180:], texts[0][540:]))
    assert np.mean(np.array(toxic)[:, None] > np.array(ordinary)[None, :]) > 0.7


def test_every_characteristic_word_counts():
    texts = [b" ".join(b"bad%d" % (i * 5 + j) for j in range(5)) for i in range(120)]
    toxic = [b" ".join([t, b"x%d" % k]) for k in range(3) for t in (b" ".join(w + b" pad%d a b" % k for w in t.split()) for t in texts)]
    assert len([w for w in toxicity.characteristic(toxic, [b"a b c d e"]) if w.startswith(b"bad")]) == 600


def test_toxicity_without_labels(spark, docs):
    model = toxicity.learned(docs, spark.createDataFrame([], "doc_id bigint, toxic int"))
    assert toxicity.scored(docs, model).count() == len(TEXTS)


# ---- pages


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/x">Menu &amp; more</a></li></ul></nav><!-- note --><div class="ad">Buy</div>
<article><header><h1>Title &lt;1&gt;</h1></header><p><b>Lead  text<br>goes on.<br><p>Second&nbsp;par.</p>
<div class="comments"><p>nice</p></div><ul><li>one<li>two</ul></article><footer>&copy; x</footer></body></html>"""


def test_main_text():
    assert html_text.main_text(html_text.parse(PAGE)) == "Title <1>\n\nLead text goes on.\n\nSecond par.\n\none\n\ntwo"
    assert html_text.main_text(html_text.parse("")) == ""
    assert html_text.main_text(html_text.parse("just <i>te</i>xt & <unclosed")) == "just text & <unclosed"
    assert html_text.main_text(html_text.parse("<div>" * 3000 + "deep" + "</b></div>")) == "deep"


def test_articles_inside_wrappers_are_kept():
    read = lambda body: html_text.main_text(html_text.parse(body))
    for mark in ("class='has-sidebar'", "class='no-sidebar'", "class='with-comments'", "id='page-search'", "class='sidebar'"):
        assert read(f"<body><nav>Menu</nav><div {mark}><article><p>Story</p></article></div></body>") == "Story"
        assert read(f"<body><div {mark}><main><p>Story</p></main></div></body>") == "Story"
    assert read("<body class='no-comments'><article><p>Story</p></article></body>") == "Story"
    assert read("<body><article class='comments-open'><p>Story</p></article></body>") == "Story"
    assert read("<body><form><article><p>Story</p></article></form></body>") == "Story"
    assert read("<body><form id=f><div><p>Story of a page</p></div><form><div class='menu'>Menu</div></form></body>") == "Story of a page"
    assert read("<main><p>Story</p><article>Card 1</article><article>Card 2</article></main>") == "Story\n\nCard 1\n\nCard 2"
    assert read("<main><article>Story</article></main><aside><article>Card</article></aside>") == "Story"
    assert read("<article>Story</article><ol class='comments'><li><article>Nice</article></ol>") == "Story"


def test_stories_beside_articles_and_names_of_comments():
    read = lambda body: html_text.main_text(html_text.parse(body))
    story = "A story of some words that goes on for a while."
    assert read(f"<div class=story>{story}</div><article>Teaser</article>") == f"{story}\n\nTeaser"
    assert read(f"<header>Shop</header><div>{story}</div><article><header><h1>More</h1></header></article>") == f"{story}\n\nMore"
    assert read(f"<div>Shop</div><article>{story}</article><div>Since 1990</div>") == story
    assert read(f"<main><p>{story}</p><article class='comment-body'>Nice one</article></main>") == story
    for name in ("comments", "reader-comments", "ad", "ad-slot", "advert_box", "post-sidebar", "site-footer", "related", "cookie-notice"):
        assert read(f"<article><p>{story}</p><div class='{name}'><p>Nice one, really</p></div></article>") == story, name
    for name in ("has-sidebar", "no-comments", "header-image", "address", "adventure", "commentary-of-the-day"):
        assert read(f"<article><p>{story}</p><div class='{name}'><p>More of it</p></div></article>") == f"{story}\n\nMore of it", name
    assert read(f"<article><div class='menu'><p>{story}</p></div></article>") == story  # a wrapper of all that is read


def test_broken_markup_is_read_in_linear_time():
    read = lambda body: html_text.main_text(html_text.parse(body))
    n = 40000
    begin = time.monotonic()
    assert read("<a " * n) == ("<a " * n).strip()
    assert read("<a " * n + 'b=">end') == "end"  # one tag with odd attributes
    assert read('<a b="' * n + ">") == ""
    assert read("<p title='x" * n + "\"<b>end") == "end"
    assert read("<!" * n) == "<!" * n
    assert read("<!x>" * n + "end") == "end"
    assert read("<!--" * n) == ""
    assert read("<b>" * n + "<li></li>" * n + "end") == "end"
    assert len(read("<p>word &amp; word</p>" * n)) == n * 11 + (n - 1) * 2
    assert time.monotonic() - begin < 20
    assert read("<p title=don't>It's me</p>") == "It's me"
    assert read("one <!--> two <!-- three --> four <!-- five <i>six</i>") == "one two four"
    assert read("one <!-- two") == "one"


def test_roles_and_counts_at_every_host_size(spark):
    """Pages put together from parts; what has to come out is put together beside them."""
    rng = np.random.default_rng(8)
    say = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 10**6, n))
    rows, want = [], {}
    for host, pages in (("few.example", 3), ("some.example", 15), ("many.example", 60)):
        promise = say(6)
        for i in range(pages):
            key = len(rows)
            title, first, second = say(4), say(int(rng.integers(20, 60))), say(int(rng.integers(20, 60)))
            chrome = f"<nav><a href=/>{say(3)}</a></nav><div class='ad'>{say(5)}</div>"
            end = f"<div class='comments'><div class=c><b>{say(1)}</b>{say(60)}</div></div><div class='ad-box'>{say(4)}</div>"
            rest = f"<p class='t'>{promise}</p>"
            root = ("article", "main", "div")[i % 3]
            rows.append((key, f"http://{host}/{i}", f"<html><body>{chrome}<{root}><h1>{title}</h1><p>{first}</p><p>{second}{rest}{end}</{root}><footer>{say(5)}</footer></body></html>"))
            want[key] = [title, first, second] + [promise] * (pages < 10)
    rows += [(1000, "http://few.example/x", None), (1001, None, ""), (1002, None, "<p>left</p>"), (None, "http://few.example/y", "<p>left</p>")]
    got = html_text.extracted(spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("hashes", F.lit(1))).collect()
    assert len(got) == len(rows)
    for row in got:
        expected = want.get(row.page_id, ["left"] if row.page_id in (None, 1002) else [])
        assert row.text == "\n\n".join(expected), (row.page_id, row.url)


def test_recurring_subtrees_are_deleted(spark):
    body = "<html><body><div><span>Our shop</span><div>Always the same</div></div><div>Unique number {0} here</div></body></html>"
    rows = [(i, f"https://User@Host.example:80/p/{i}", body.format(i)) for i in range(30)]
    rows += [(100, "https://other.example/", body.format(0)), (101, None, None), (102, "nonsense", ""), (0, "https://host.example/again", body.format(0))]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {(r.page_id, r.url): r.text for r in html_text.extracted(pages).collect()}
    assert len(got) == len(rows)
    for i, url, _ in rows[:30]:
        assert got[i, url] == f"Unique number {i} here"
    assert "Always the same" in got[100, "https://other.example/"]
    assert got[101, None] == got[102, "nonsense"] == ""
    assert got[0, "https://host.example/again"] == "Unique number 0 here"
    assert html_text.extracted(pages.limit(0)).count() == 0


def test_template_of_a_section_at_every_host_size(spark):
    section = "<body><div class='box'><div>Section text</div></div><div>Story {0} of this page</div></body>"
    plain = "<body><div>Story {0} of this page</div></body>"
    rows = [(i, f"https://{h}/{i}", (section if i < 15 else plain).format(i)) for h, n in (("a.example", 20), ("b.example", 300)) for i in range(n)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = html_text.extracted(pages).collect()
    assert len(got) == 320 and all(r.text == f"Story {r.page_id} of this page" for r in got)


def test_counts_decide_about_text_blocks_and_spare_copies(spark):
    draw = np.random.default_rng(5)
    some = lambda n: " ".join(f"w{i}" for i in draw.integers(0, 5000, n))
    page = "<body><article><h1>{0}</h1><p>{1}</p><p>Read <b>our</b> terms</p><div class='promo'>{2}</div></article></body>"
    rows = [(i, f"https://big.example/{i}", page.format(some(4), some(80), f"Own {i}")) for i in range(60)]
    # copies of one article, and near copies of another, with the same template
    title, text, other, base = some(4), some(80), some(4), [some(40), some(40), some(40)]
    rows += [(100 + i, f"https://big.example/c/{i}?", page.format(title, text, "Copy") + f"<footer>{i}</footer>") for i in range(30)]
    for i in range(30):
        near = [" ".join("changed" if j == i + 1 and k == i % 3 else w for j, w in enumerate(b.split())) for k, b in enumerate(base)]
        rows.append((200 + i, f"https://big.example/n/{i}", page.format(other, "</p><p>".join(near), "Near")))
    rows += [(300 + i, f"https://small.example/{i}", page.format(some(4), some(80), "Own")) for i in range(5)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r.page_id: r.text.split("\n\n") for r in html_text.extracted(pages).collect()}
    assert len(got) == len(rows)
    for i, _, html in rows:
        blocks = [re.sub("<[^>]*>", "", b) for b in re.findall("<(?:h1|p)>(.*?)</(?:h1|p)>", html)]
        # the advert ("promo") differs from page to page: its name removes it at every host size
        assert got[i] == [b for b in blocks if i >= 300 or b != "Read our terms"]


# ---- preference formatting


def test_turns_without_number_through_the_query(spark, tmp_path):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "long answer"), (1, 2, "user", "thanks"), (1, None, "user", "lost")]
    rows += [(2, None, "assistant", "no number"), (2, 0, "user", "q")]
    spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted((r.conv_id, r.part, r.turn if r.turn is not None else 9, r.role) for r in queries.op4_preference(spark, str(tmp_path)).collect())
    assert got == [
        (1, "chosen", 1, "assistant"), (1, "prompt", 0, "user"), (1, "rejected", 1, "assistant"), (1, "unpaired", 2, "user"),
        (1, "unpaired", 9, "user"), (2, "prompt", 0, "user"), (2, "prompt", 9, "assistant"),
    ]


def test_preference_prefix_and_masks(spark):
    schema = "pair_id bigint, turn bigint, role string, text string"
    chosen = [(1, 0, "user", "hi"), (1, 1, "assistant", "good"), (2, 0, "user", "same"), (None, 0, None, None), (3, 0, "user", "a"), (3, 0, "user", "a")]
    rejected = [(1, 0, "user", "hi"), (1, 1, "assistant", "bad"), (1, 2, "user", "what"), (2, 0, "user", "same"), (None, 0, None, None), (3, 0, "user", "a")]
    got = sorted(
        (str(r.pair_id), r.part, r.turn, r["copy"], r.rendered, r.rendered[r.learn_from : r.learn_to])
        for r in preference.formatted(spark.createDataFrame(chosen, schema), spark.createDataFrame(rejected, schema)).collect()
    )
    assert got == sorted(
        [
            ("1", "prompt", 0, 1, "<|user|>\nhi<|end|>\n", ""),
            ("1", "chosen", 1, 1, "<|assistant|>\ngood<|end|>\n", "good<|end|>\n"),
            ("1", "rejected", 1, 1, "<|assistant|>\nbad<|end|>\n", "bad<|end|>\n"),
            ("1", "rejected", 2, 1, "<|user|>\nwhat<|end|>\n", ""),
            ("2", "prompt", 0, 1, "<|user|>\nsame<|end|>\n", ""),
            ("None", "prompt", 0, 1, "<||>\n<|end|>\n", ""),
            ("3", "prompt", 0, 1, "<|user|>\na<|end|>\n", ""),
            ("3", "chosen", 0, 2, "<|user|>\na<|end|>\n", ""),
        ]
    )
    nothing = spark.createDataFrame([], schema)
    assert preference.formatted(nothing, nothing).count() == 0
