"""Operator 8: quality scores by naive Bayes support vectors.

Features of a text are indicators of hashed n-grams of two kinds: words (one and two), and word shapes (one to three:
case, symbols, digits, whether the word repeats the one before it or any before), the latter with how often they occur, in steps of two.
Class log-count ratios come from all labelled rows that may be learned from; each indicator is scaled by its ratio. A linear hinge-loss
model is then fitted on a bounded sample of them (FIT_TEXTS) by dual coordinate descent, and margins outside the fold become
probabilities by a logistic curve.

Empty and null texts get the score of a text without n-grams. Rows of labels that repeat a doc_id count once, with the
higher label; null labels do not count. Repeated documents get equal scores; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, arrow_limits, byte_table, chunks, crc_mod, mix, saved, tidy

FEATURES = 1 << 16
FIT_TEXTS = 4000
EPOCHS = 20
COST = 1.0
BROADCAST_LABELS = 4_000_000
"""Up to so many labels (16 bytes each) are sent to all tasks; beyond, documents and labels meet in a shuffle join."""

_SHAPES = 24


def features(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Sorted feature numbers of each text."""
    w = Words(data, offsets, byte_table())
    n = len(w.hash)

    def count(table: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(table[data], dtype=np.int32)])
        return total[w.end] - total[w.start]

    def of(chars: bytes) -> np.ndarray:
        t = np.zeros(256, dtype=np.uint8)
        t[np.frombuffer(chars, dtype=np.uint8)] = 1
        return t

    upper, digit, symbol, bang = (count(of(c)) for c in (bytes(range(65, 91)), b"0123456789", b"#*$%&|<>", b"!?"))
    letter = count(of(bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256))))
    kind = np.select([symbol > 0, bang > 0, digit > 0, letter == 0, (upper == letter) & (letter > 1), upper > 0], [1, 2, 3, 4, 5, 6], 0)
    own = w.hash ^ mix(w.doc.astype(np.uint64), 3)
    order = np.argsort(own, kind="stable")
    seen = np.zeros(n, dtype=np.int64)
    seen[order[1:]] = own[order[1:]] == own[order[:-1]]
    seen[1:] += (own[1:] == own[:-1]).astype(np.int64)
    shape = (kind + 7 * seen).astype(np.int64) + 1
    half, found, at = FEATURES // 2, [], []
    for k in (1, 2, 3):
        if n >= k:
            g = np.zeros(n - k + 1, dtype=np.int64)
            for j in range(k):
                g = g * _SHAPES + shape[j : j + len(g)]
            ok = w.doc[: len(g)] == w.doc[k - 1 :]
            both, c = np.unique(w.doc[: len(g)][ok] * _SHAPES**3 + g[ok], return_counts=True)
            doc, gram = both // _SHAPES**3, both % _SHAPES**3
            step = np.minimum(7, np.floor(-np.log2(c / np.maximum(1, w.n_words[doc] - k + 1)))).astype(np.uint64)
            found.append((mix(gram.astype(np.uint64) * np.uint64(8) + step, k) % np.uint64(half)).astype(np.int64))
            at.append(doc)
    for k in (1, 2):
        if n >= k:
            h = w.hash if k == 1 else mix(w.hash[:-1] * np.uint64(3) + w.hash[1:], 9)
            ok = w.doc[: len(h)] == w.doc[k - 1 :]
            found.append(half + 64 + (h[ok] % np.uint64(half - 64)).astype(np.int64))
            at.append(w.doc[: len(h)][ok])
    found.append(half + np.minimum(40, np.floor(2 * np.log2(1 + w.n_words))).astype(np.int64))
    at.append(np.arange(w.n_docs))
    both = np.unique(np.concatenate(at) * FEATURES + np.concatenate(found))
    cut = np.searchsorted(both, np.arange(w.n_docs + 1) * FEATURES)
    return [both[cut[d] : cut[d + 1]] - d * FEATURES for d in range(w.n_docs)]


def _class_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with each class's feature counts, one for a feature and task; feature -1 counts texts."""
    total = np.zeros((2, FEATURES + 1), dtype=np.int64)
    for batch in batches:
        y = batch.column(0).to_numpy(zero_copy_only=False).astype(int)
        for at, _, data, offsets in chunks(batch.column(1)):
            for d, f in enumerate(features(data, offsets)):
                total[y[at + d], f] += 1
                total[y[at + d], FEATURES] += 1
    some = np.flatnonzero(total.sum(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(np.where(some == FEATURES, -1, some)), pa.array(total[1, some]), pa.array(total[0, some])], ["f", "pos", "neg"])


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, n, data, offsets in chunks(batch.column(1)):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), pa.array([f.astype(np.int32).tobytes() for f in features(data, offsets)], pa.binary())], ["y", "f"])


def dual_coordinate_descent(rows: list[np.ndarray], scale: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights (the last one the bias) of a hinge-loss model over scaled indicator rows, each of unit length."""
    w, alpha, rng = np.zeros(FEATURES + 1), np.zeros(len(rows)), np.random.default_rng(11)
    xs = [_unit(f, scale) for f in rows]
    square = np.array([1.0 + (v @ v) for v in xs])
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            f, v = rows[i], xs[i]
            g = y[i] * (w[f] @ v + w[-1]) - 1
            new = min(max(alpha[i] - g / square[i], 0.0), COST * weight[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[f] += step * v
                w[-1] += step
                alpha[i] = new
    return w


def _unit(f: np.ndarray, scale: np.ndarray) -> np.ndarray:
    v = scale[f]
    return v / max(1e-9, float(np.sqrt(v @ v)))


def _margin(f: np.ndarray, scale: np.ndarray, w: np.ndarray) -> float:
    return float(w[f] @ _unit(f, scale) + w[-1])


def _logistic(m: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the curve from margin to probability, by Newton steps."""
    a, b, t = 1.0, 0.0, np.where(y > 0, (np.sum(y > 0) + 1) / (np.sum(y > 0) + 2), 1 / (np.sum(y < 0) + 2))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
        r, v = p - t, p * (1 - p) + 1e-9
        h = np.array([[v @ (m * m) + 1e-6, v @ m], [v @ m, v.sum()]])
        a, b = np.array([a, b]) - np.linalg.solve(h, [r @ m, r.sum()])
    return float(a), float(b)


class Model:
    def __init__(self, scale: np.ndarray, w: np.ndarray, a: float, b: float):
        self.scale, self.w, self.a, self.b = scale.astype(np.float32), w.astype(np.float32), a, b


def fit(labelled: DataFrame) -> Model:
    """labelled: doc_id, text, quality (0 or 1), only rows that may be learned from."""
    labelled = labelled.select("doc_id", F.col("quality").cast("int").alias("y"), "text")
    sums = labelled.select("y", "text").mapInArrow(tidy(_class_counts), "f long, pos long, neg long").groupBy("f").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).toArrow()
    f, pos, neg = (sums[c].to_numpy() for c in ("f", "pos", "neg"))
    n_pos, n_neg = int(pos[f == -1].sum()), int(neg[f == -1].sum())
    if not n_pos or not n_neg:
        return Model(np.zeros(FEATURES), np.zeros(FEATURES + 1), 1.0, 4.0 if n_pos else -4.0 if n_neg else 0.0)
    p, q = np.ones(FEATURES), np.ones(FEATURES)
    p[f[f >= 0]] += pos[f >= 0]
    q[f[f >= 0]] += neg[f >= 0]
    scale = np.log(p / (n_pos + 2)) - np.log(q / (n_neg + 2))
    unit = F.pmod(F.xxhash64("doc_id", "text", F.lit(29)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = labelled.where(unit < min(1.0, 1.3 * FIT_TEXTS / (n_pos + n_neg))).orderBy(unit, "doc_id", F.xxhash64("text"), "y").limit(FIT_TEXTS)
    got = saved(drawn.select("y", "text")).mapInArrow(tidy(_feature_rows), "y int, f binary").toArrow()
    rows = [np.frombuffer(x, dtype=np.int32) for x in got["f"].to_pylist()]
    y = np.where(got["y"].to_numpy() > 0, 1, -1)
    order = sorted(range(len(rows)), key=lambda i: (rows[i].tobytes(), y[i]))
    rows, y = [rows[i] for i in order], y[order]
    weight = np.where(y > 0, 0.5 / max(0.02, np.mean(y > 0)), 0.5 / max(0.02, np.mean(y < 0)))
    fold, margins = mix(np.arange(len(rows), dtype=np.uint64), 4) % np.uint64(3), np.zeros(len(rows))
    for k in range(3):
        inside = np.flatnonzero(fold != k)
        w = dual_coordinate_descent([rows[i] for i in inside], scale, y[inside], weight[inside])
        for i in np.flatnonzero(fold == k):
            margins[i] = _margin(rows[i], scale, w)
    a, b = _logistic(margins, y)
    return Model(scale, dual_coordinate_descent(rows, scale, y, weight), a, b)


def _scorer(model: Model) -> Callable:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n, data, offsets in chunks(batch.column(2)):
                m = np.array([_margin(f, model.scale, model.w) for f in features(data, offsets)])
                s = 1 / (1 + np.exp(-np.clip(model.a * m + model.b, -30, 30)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), batch.column(1).slice(at, n), pa.array(s), pa.array((s >= 0.3).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return score


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, held_out, score, predicted."""
    arrow_limits(docs.sparkSession)
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality")).where(crc_mod(5) != 0)
    known = saved(known)
    if known.count() <= BROADCAST_LABELS:
        known = F.broadcast(known)
    model = fit(docs.select("doc_id", "text").join(known, "doc_id"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce(crc_mod(5) == 0, F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(tidy(_scorer(model)), f"doc_id {kind}, held_out boolean, score double, predicted int")
