"""Toxicity by compression distance.

Three zstandard dictionaries are trained: one on windows of ordinary text, one on the characteristic words of toxic
text, one on windows of ``PHRASE_WORDS`` words of all toxic texts of the sample, in which windows weigh by the odds of their word pairs.
The words' dictionary is a lexicon step: only words with at least 3 contexts and 20 times the share of ordinary text enter
it, since trained on everything it finds far fewer toxic texts; the number of its words has no bound but the
sample's. What is left out of it (rarer words, phrases of ordinary words) is seen by the phrases' dictionary only.

Every word of a text is compressed against the ordinary dictionary and against the ordinary one with the toxic words
added, and every ``PHRASE_WORDS`` words against the ordinary dictionary and against the one of toxic phrases alone; the bytes
saved are the window's distance. Windows are too short for zstandard to compress on their own (it would store them as they
are, and never looks for matches in the last bytes), so each stands between two pieces of a carrier, a byte string that
all dictionaries end with and that therefore costs the same in all.
A document is scored by a calibrated logistic
function of how far and how often its windows' distances exceed fixed thresholds.

Dictionaries and calibration are fitted on a bounded sample of labelled rows (``sample_toxic``, ``sample_ordinary``
documents of at most ``sample_chars`` characters), split into a part for dictionaries and a part for calibration.
Scoring covers whole texts. Only the text is an input of the score. Null and empty texts have no windows; they get the
score of a text without any distance.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from frota.llm.common import byte_texts, mixed, over_text

WINDOW_WORDS = 1
PHRASE_WORDS = 4
LEVEL, PHRASE_LEVEL = 12, 3
#: Windows a dictionary is trained on, so that the driver's memory does not depend on the texts' lengths.
MOST_WINDOWS = 1_000_000
#: Distances in bytes that are counted.
THRESHOLDS = (2, 3, 5)
_CARRIER = bytes(128 + (37 * i * i + 11 * i) % 128 for i in range(128))


def windows(text: bytes, size: int = WINDOW_WORDS) -> list[bytes]:
    """Consecutive groups of words, lower-cased (A-Z), led and followed by a blank."""
    words = text.lower().split()
    return [b" " + b" ".join(words[i : i + size]) + b" " for i in range(0, len(words), size)]


def _dictionary(samples: list[bytes], size: int, **options) -> bytes:
    """A trained dictionary; samples themselves where there are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples, **options).as_bytes()
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(samples))[-size:]


@dataclass(frozen=True)
class Distances:
    """Compressors for the dictionaries of ordinary text, toxic words and toxic phrases."""

    ordinary: bytes
    toxic: bytes
    phrases: bytes

    def open(self):
        """A function from text to the distances of its words and of its phrases."""

        def compressor(content: bytes, level: int = LEVEL):
            data = zstandard.ZstdCompressionDict(content + _CARRIER, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            data.precompute_compress(level=level)
            return zstandard.ZstdCompressor(
                level=level, dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False
            ).compress

        plain, both = compressor(self.ordinary), compressor(self.ordinary + self.toxic)
        # phrases hardly repeat, so each is compressed, at a level that costs a third
        plainly, phrase = compressor(self.ordinary, PHRASE_LEVEL), compressor(self.phrases, PHRASE_LEVEL)
        known: dict[bytes, int] = {}

        def distances(text: bytes) -> tuple[np.ndarray, np.ndarray]:
            if len(known) > 500_000:
                known.clear()
            words, phrases = [], []
            for window in windows(text):
                d = known.get(window)
                if d is None:
                    led = _CARRIER + window + _CARRIER[:32]
                    d = known[window] = len(plain(led)) - len(both(led))
                words.append(d)
            for window in windows(text, PHRASE_WORDS) if self.phrases else ():
                led = _CARRIER + window + _CARRIER[:32]
                phrases.append(len(plainly(led)) - len(phrase(led)))
            return np.array(words, np.int64), np.array(phrases, np.int64)

        return distances


def features(words: np.ndarray, phrases: np.ndarray) -> list[float]:
    """Of the words: largest distance, counts over the thresholds, number, share; the same of the phrases with their mean."""
    n, out = len(words), []
    for d in (words, phrases):
        over = [int((d >= t).sum()) for t in THRESHOLDS]
        out += [float(d.max()) if len(d) else 0.0, *np.log1p(over), over[1] / max(1, len(d))]
    return [*out, float(np.log1p(n)), float(phrases.mean()) if len(phrases) else 0.0]


@dataclass(frozen=True)
class Model:
    distances: Distances
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def score(self, rows: np.ndarray) -> np.ndarray:
        x = np.concatenate([np.ones((len(rows), 1)), (rows - self.mean) / self.scale], axis=1)
        return 1 / (1 + np.exp(-x @ self.weights))


def _contexts(texts: list[bytes]) -> tuple[Counter, int]:
    """In how many different windows of four words each word stands, so that copies count once."""
    different = {w for t in texts for w in windows(t, 4)}
    return Counter(word for window in different for word in set(window.split())), len(different)


def _spread(samples: list[bytes]) -> list[bytes]:
    """At most ``MOST_WINDOWS`` of the samples, evenly."""
    return samples[:: -(-len(samples) // MOST_WINDOWS) or 1]


def characteristic(toxic: list[bytes], ordinary: list[bytes], odds: float = 20.0) -> set[bytes]:
    """The words of toxic texts with at least 3 contexts there, if ``odds`` times as frequent as in ordinary ones."""
    (here, n), (there, m) = _contexts(toxic), _contexts(ordinary)
    return {w for w, k in here.items() if k >= 3 and k > odds * n / max(1, m) * there[w]}


def weighted_phrases(toxic: list[bytes], ordinary: list[bytes], most: int = 1000) -> list[bytes]:
    """All windows of the toxic texts, each as often as the best odds of its word pairs (at least 1, at most ``most``).

    Pairs with a single context say nothing about odds and weigh 1.
    """

    def pairs(texts: list[bytes]) -> tuple[Counter, int]:
        different = {w for t in texts for w in windows(t, PHRASE_WORDS)}
        return Counter(pair for window in different for pair in set(pairwise(window.split()))), len(different)

    (here, n), (there, m) = pairs(toxic), pairs(ordinary)
    odds = {p: (k / n) / ((there[p] + 1) / max(1, m)) for p, k in here.items() if k > 1}
    found = _spread([w for text in toxic for w in windows(text, PHRASE_WORDS)])
    weights = [min(most, max([1.0, *(odds.get(p, 1.0) for p in pairwise(w.split()))])) for w in found]
    scale = min(1.0, MOST_WINDOWS / max(1.0, sum(weights)))
    return [w for w, weight in zip(found, weights, strict=True) for _ in range(max(1, int(weight * scale)))]


def fit_dictionaries(toxic: list[bytes], ordinary: list[bytes], phrase_size: int = 1 << 14, ordinary_size: int = 1 << 17) -> Distances:
    words = characteristic(toxic, ordinary)
    marked = [b" " + w + b" " for text in toxic for w in text.lower().split() if w in words]
    toxic_size = max(256, 2 * sum(len(w) + 1 for w in words))
    phrases = weighted_phrases(toxic, ordinary)
    return Distances(
        _dictionary(_spread([w for text in ordinary for w in windows(text, 4)]), ordinary_size),
        _dictionary(marked, toxic_size, d=6, k=24)[-toxic_size:] if marked else b"",
        _dictionary(phrases, phrase_size) if phrases else b"",
    )


def fit(toxic: list[bytes], ordinary: list[bytes], ridge: float = 0.5) -> Model:
    """Dictionaries from two thirds of the texts, logistic calibration on the rest."""
    part = lambda texts, calibrate: [t for i, t in enumerate(texts) if (i % 3 == 2) == calibrate]
    model = fit_dictionaries(part(toxic, False), part(ordinary, False))
    distances = model.open()
    rows, labels = [], []
    for label, texts in ((1.0, part(toxic, True)), (0.0, part(ordinary, True))):
        rows += [features(*distances(t)) for t in texts]
        labels += [label] * len(texts)
    x, y = np.array(rows or [features(np.zeros(0), np.zeros(0))]), np.array(labels or [0.0])
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale > 1e-6, scale, 1.0)
    z = np.concatenate([np.ones((len(x), 1)), (x - mean) / scale], axis=1)
    weights = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ weights))
        hessian = (z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(weights))
        weights -= np.linalg.solve(hessian, z.T @ (p - y) + ridge * weights)
    return Model(model, mean, scale, weights)


def learned(
    docs: DataFrame, labels: DataFrame, sample_toxic: int = 1500, sample_ordinary: int = 3000, sample_chars: int = 100_000
) -> Model:
    """Fit on the labelled documents with the smallest hashes of their ids, so many of each label.

    ``labels`` has ``doc_id`` and ``toxic`` 0 or 1; other values, nulls and documents labelled both ways are not used.
    """
    marked = (
        labels.where("toxic in (0, 1) AND doc_id IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.min("toxic").alias("_t"), F.max("toxic").alias("_t2"))
        .where("_t = _t2")
    )
    chosen = {
        label: marked.where(F.col("_t") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n).select(F.col("doc_id").alias("_id"))
        for label, n in ((1, sample_toxic), (0, sample_ordinary))
    }
    texts = {
        label: docs.where(F.length("text").between(1, sample_chars))
        .join(F.broadcast(ids), F.col("doc_id") == F.col("_id"))
        .select("doc_id", "text")
        .toPandas()
        for label, ids in chosen.items()
    }
    return fit(*(_in_hash_order(texts[label]) for label in (1, 0)))


def _in_hash_order(rows) -> list[bytes]:
    rows = rows.sort_values(["doc_id", "text"])
    order = np.argsort(mixed(rows.doc_id.to_numpy(np.int64).view(np.uint64)), kind="stable")
    return [t.encode() for t in rows.text.iloc[order]]


def scored(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """(doc_id, score, predicted, windows, distance) of every text; windows are single words, distance is the largest of theirs."""
    state: dict = {}

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not state:
            state["distances"] = model.distances.open()
        found = [state["distances"](t) for t in byte_texts(batch.column("text"))]
        score = model.score(np.array([features(*d) for d in found]))
        columns = [
            batch.column("doc_id"), pa.array(score), pa.array((score >= threshold).astype(np.int32)),
            pa.array([len(d) for d, _ in found], pa.int64()), pa.array([int(d.max()) if len(d) else 0 for d, _ in found], pa.int64()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "score", "predicted", "windows", "distance"])

    return over_text(docs.select("doc_id", "text"), work, "doc_id bigint, score double, predicted int, windows bigint, distance bigint")
