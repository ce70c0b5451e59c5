"""Quality classifier: naive Bayes support vectors.

A text is the set of its n-grams, as indicators: words and word pairs (A-Z lower-cased),
word shapes and pairs of shapes, and repeats of a word at a distance of one
to three (an indicator each for at least 1, 2, 4, 8, ... of them).
Each indicator is scaled by its log-count ratio between the classes, a text's vector is
scaled to length one, and a linear hinge loss is fitted by dual coordinate descent. A
sigmoid fitted on rows kept out of that turns margins into scores.

The fit uses a bounded sample of labelled rows (``max_rows``); scoring reads whole texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayledger.llm.common import crc_mod, materialise, order_id

_BITS = 18
_UPPER, _LOWER, _DIGIT, _HIGH = re.compile(rb"[A-Z]+"), re.compile(rb"[a-z]+"), re.compile(rb"[0-9]+"), re.compile(rb"[\x80-\xff]+")
_RUN = re.compile(rb"(.)\1+", re.S)


def shape(word: bytes) -> bytes:
    """A word with runs of capitals, small letters and digits as X, x and 0, and other runs as one character."""
    word = _DIGIT.sub(b"0", _LOWER.sub(b"x", _UPPER.sub(b"X", _HIGH.sub(b"x", word))))
    return _RUN.sub(rb"\1", word)


class _Codes(dict):
    """32 bits of a word's hash and 32 of its shape's; it forgets when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 300_000:
            self.clear()
        h = self[word] = xxhash.xxh32_intdigest(word.lower()) << 32 | xxhash.xxh32_intdigest(shape(word))
        return h


def _odd(k: int) -> np.uint64:
    return np.uint64(xxhash.xxh64_intdigest(b"n-gram %d" % k) | 1)


class NGrams:
    """Indicator ids of texts."""

    def __init__(self):
        self.codes, self.seen = _Codes(), np.zeros(1 << _BITS, np.int32)
        self.odd = [_odd(k) for k in range(12)]

    def __call__(self, text: str | None) -> np.ndarray:
        """The distinct ids of a text's n-grams; none for a text without words."""
        words = text.encode("utf-8", "surrogatepass").split() if text else []
        if not words:
            return np.empty(0, np.int64)
        c = np.fromiter(map(self.codes.__getitem__, words), np.uint64, len(words))
        w, s = c >> np.uint64(32), c & np.uint64(0xFFFFFFFF)
        o, out = self.odd, []
        out.append((w + np.uint64(1)) * o[0])
        out.append((s + np.uint64(1)) * o[1])
        out.append((w[:-1] * o[2] ^ (w[1:] + np.uint64(1)) * o[3]) * o[4])
        out.append((s[:-1] * o[5] ^ (s[1:] + np.uint64(1)) * o[6]) * o[7])
        for d in (1, 2, 3):
            n = int(np.count_nonzero(w[d:] == w[:-d]))
            out.append((np.arange(n.bit_length(), dtype=np.uint64) * np.uint64(4) + np.uint64(d)) * o[8])
        ids = (np.concatenate(out) >> np.uint64(64 - _BITS)).astype(np.int64)
        at = np.arange(len(ids), dtype=np.int32)
        self.seen[ids] = at
        return ids[self.seen[ids] == at]


def _indicators(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    grams = NGrams()
    for pdf in batches:
        yield pd.DataFrame({"label": pdf["label"], "part": pdf["part"], "ids": [grams(t).astype(np.int32).tobytes() for t in pdf["text"]]})


def fit_hinge(rows: list[np.ndarray], labels: np.ndarray, cost: float, rounds: int, seed: int, weights: np.ndarray) -> np.ndarray:
    """Dual coordinate descent for the hinge loss; rows are ids, weights scale each id.

    labels are -1 or 1. Each vector is scaled to length one; the bias is a feature.
    """
    w, bias = np.zeros(len(weights)), 0.0
    values = []
    for ids in rows:
        v = weights[ids]
        values.append(v / max(np.sqrt((v * v).sum()), 1e-9))
    alpha, rng = np.zeros(len(rows)), np.random.default_rng(seed)
    balance = {s: cost * len(labels) / (2 * max(1, (labels == s).sum())) for s in (-1, 1)}
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            ids, v, y = rows[i], values[i], labels[i]
            q = (v * v).sum() + 1.0
            g = y * (v @ w[ids] + bias) - 1.0
            new = min(max(alpha[i] - g / q, 0.0), balance[y])
            step = (new - alpha[i]) * y
            if step:
                w[ids] += step * v
                bias += step
                moved = max(moved, abs(step))
                alpha[i] = new
        if moved < 1e-4:
            break
    return np.append(w * 1.0, bias)


def fit_sigmoid(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """a, b of 1 / (1 + exp(-(a m + b))) by Newton steps with a small ridge."""
    t = np.where(labels > 0, (sum(labels > 0) + 1) / (sum(labels > 0) + 2), 1 / (sum(labels <= 0) + 2))
    x, p = np.column_stack([margins, np.ones(len(margins))]), np.array([1.0, 0.0])
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(x @ p, -30, 30)))
        g = x.T @ (q - t) + 1e-2 * p
        h = (x * (q * (1 - q))[:, None]).T @ x + 1e-2 * np.eye(2)
        step = np.linalg.solve(h, g)
        p = p - step
        if abs(step).max() < 1e-8:
            break
    return max(float(p[0]), 1e-3), float(p[1])


class QualityModel:
    """Weights over n-gram ids and the sigmoid; ``prior`` alone if a class has no row."""

    def __init__(self, scales: np.ndarray, weights: np.ndarray, bias: float, a: float, b: float):
        self.scales, self.weights, self.bias, self.a, self.b = scales, weights, bias, a, b

    def margin(self, ids: np.ndarray) -> float:
        v = self.scales[ids]
        return float(v @ self.weights[ids]) / max(float(np.sqrt((v * v).sum())), 1e-9) + self.bias

    def score(self, ids: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.a * self.margin(ids) + self.b, -30, 30))))


def fit(rows: list[np.ndarray], labels: np.ndarray, held: np.ndarray, smooth: float = 1.0, cost: float = 1.0, rounds: int = 20, seed: int = 11) -> QualityModel:
    """labels are 0 or 1; rows marked held fit the sigmoid only, if both classes have some there."""
    size = 1 << _BITS
    if len(set(labels.tolist())) < 2:
        p = (labels.sum() + 1) / (len(labels) + 2)
        return QualityModel(np.zeros(size), np.zeros(size), 0.0, 1.0, float(np.log(p / (1 - p))))
    own = ~held
    if len(set(labels[own].tolist())) < 2:
        own = np.ones(len(labels), bool)
    counts = {y: smooth + np.bincount(np.concatenate([rows[i] for i in np.nonzero(own & (labels == y))[0]] or [np.empty(0, np.int64)]).astype(np.int64), minlength=size) for y in (0, 1)}
    scales = np.log((counts[1] / counts[1].sum()) / (counts[0] / counts[0].sum()))
    # Ids that no row has are rather like the typical id of such counts: they carry nothing.
    scales[(counts[0] == smooth) & (counts[1] == smooth)] = 0.0
    w = fit_hinge([rows[i] for i in np.nonzero(own)[0]], np.where(labels[own] > 0, 1, -1), cost, rounds, seed, scales)
    model = QualityModel(scales, w[:-1], float(w[-1]), 1.0, 0.0)
    test = held if len(set(labels[held].tolist())) == 2 else np.ones(len(labels), bool)
    model.a, model.b = fit_sigmoid(np.array([model.margin(rows[i]) for i in np.nonzero(test)[0]]), labels[test])
    return model


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", keep_out=(5, 0), max_rows: int = 4000) -> QualityModel:
    """Fits on the max_rows labelled rows (a documented bound) with the smallest hashes of doc_id.

    keep_out = (n, r): rows with crc32(doc_id as text) mod n == r are never learned from.
    Rows without a label or id, and labels without a document, are left out; of documents
    that share an id one is read. A null or empty text is a text without n-grams.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (crc_mod(F.col("doc_id"), keep_out[0]) != keep_out[1]))
    h = F.xxhash64(F.col("doc_id").cast("string"), F.lit("quality sample"))
    known = materialise(known.select("doc_id", F.col(label).cast("int").alias("label"), h.alias("h")).distinct().orderBy("h", "label").limit(max_rows))
    rows = docs.select(docs["doc_id"].alias("id"), docs["text"].alias("text")).join(known, F.col("id") == F.col("doc_id"))
    rows = rows.groupBy("doc_id", "label", "h").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = rows.select("label", F.pmod("h", F.lit(5)).alias("part"), "text")
    found = rows.mapInPandas(_indicators, "label int, part long, ids binary").collect()  # at most max_rows
    found.sort(key=lambda r: (bytes(r.ids), r.label))
    return fit([np.frombuffer(r.ids, np.int32).astype(np.int64) for r in found], np.array([r.label for r in found], int), np.array([r.part == 0 for r in found], bool))


def score_quality(docs: DataFrame, model: QualityModel) -> DataFrame:
    """(doc_id, id, th, score) for each row; a null text or one without words scores as the bare bias."""
    sent = docs.sparkSession.sparkContext.broadcast((model.scales.astype(np.float32), model.weights.astype(np.float32), model.bias, model.a, model.b))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, grams = QualityModel(*sent.value), NGrams()
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "id": pdf["id"], "th": pdf["th"], "score": [m.score(grams(t)) for t in pdf["text"]]})

    rows = docs.select(docs["doc_id"], order_id(docs["doc_id"]).alias("id"), F.xxhash64(docs["text"]).alias("th"), docs["text"].alias("text"))
    return rows.mapInPandas(run, "doc_id long, id long, th long, score double")


def classify_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, keep_out=(5, 0), **options) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted.

    A null text, an empty one and one without words score alike; texts are read whole.
    Rows with a null id count as held out by the crc of an empty text. Repeated rows
    score alike; an empty table gives no rows. Without labels of both classes all texts
    have the same score. Other columns of docs and labels play no part.
    """
    scored = score_quality(docs, train(docs, labels, keep_out=keep_out, **options))
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), keep_out[0]) == keep_out[1]).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """docs without the rows that score below threshold; columns as they are.

    The whole row travels through the scoring task, so no join is needed. Null and empty
    texts stay or go by the score of a text without words; repeated rows fare alike.
    """
    model = train(docs, labels, **options)
    sent = docs.sparkSession.sparkContext.broadcast((model.scales.astype(np.float32), model.weights.astype(np.float32), model.bias, model.a, model.b))
    at = docs.columns.index("text")

    def run(batches: Iterator) -> Iterator:
        m, grams = QualityModel(*sent.value), NGrams()
        for batch in batches:
            import pyarrow as pa

            yield batch.filter(pa.array([m.score(grams(t)) >= threshold for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
