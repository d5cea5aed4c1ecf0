"""Operator 2: language identification by nearest centroid.

A text's vector counts its letter bigrams and trigrams (case folded, other characters taken as one space) in DIMS hashed
dimensions, damped by a logarithm, weighted by inverse document frequency, and normalised. Each language has several centroids from
spherical k-means; a text gets the language of the centroid with the highest cosine. A text whose best cosine is under its language's
floor is far from everything known and is rejected; so is one that is null or has no letter (`und`). As short texts have low cosines, the
floor goes by length: it is REJECT_SHARE of the FLOOR_QUANTILE of the language's calibration texts, and of their beginnings, with about as
many distinct n-grams (powers of two). Calibration texts are a third of the sample, kept out of the centroids. A length with fewer than
MIN_HELD of them has the floor of the next shorter one, and a language without any the lowest floor of the others.

All languages are learned. Their centroids are kept in parts of MAX_LANGUAGES languages; with several parts, texts meet one part after another, and what fits
best so far goes with them. Document frequencies are counted over all learnable rows. Centroids and floors are
fitted on a bounded sample (FIT_TEXTS and half as many to calibrate, shared evenly by languages, chosen by a hash of doc_id); each text is
reduced to DIMS counts in its task before it is gathered. Prediction uses the text alone. Repeated rows get equal results; a null doc_id is never
learned from and is not held out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_limits, chunks, crc_mod, mix, saved, tidy

DIMS = 4096
CENTROIDS = 3
FIT_TEXTS = 1200
REJECT_SHARE = 0.5
FLOOR_QUANTILE = 0.01
MIN_HELD = 8
BEGINNINGS = tuple(1 << k for k in range(11))
LENGTHS = DIMS.bit_length()
MAX_LANGUAGES = 1000
"""Languages whose centroids a worker holds at once (48 MB)."""

_fold: list[np.ndarray] = []


def _folding() -> np.ndarray:
    """For each code point under 65,536: its lower-case form if a letter, else a space."""
    if not _fold:
        t = np.full(65536, 32, dtype=np.uint32)
        for c in range(65536):
            if not 0xD800 <= c < 0xE000 and chr(c).isalpha():
                low = chr(c).lower()
                t[c] = ord(low) if len(low) == 1 else c
        _fold.append(t)
    return _fold[0]


def ngram_counts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(counts by text and dimension, whether the text has a letter)."""
    n = len(offsets) - 1
    codes = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32)
    starts = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    table = _folding()
    codes = np.where(codes < 65536, table[np.minimum(codes, 65535)], codes).astype(np.uint64)
    doc = np.repeat(np.arange(n), np.diff(starts))
    letter = codes != 32
    has = np.bincount(doc[letter], minlength=n) > 0
    out = np.zeros(n * DIMS, dtype=np.int64)
    for k in (2, 3):
        if len(codes) >= k:
            g = codes[: len(codes) - k + 1].copy()
            any_letter = letter[: len(g)].copy()
            for j in range(1, k):
                g = g * np.uint64(1114112) + codes[j : j + len(g)]
                any_letter |= letter[j : j + len(g)]
            ok = any_letter & (doc[: len(g)] == doc[k - 1 :])
            out += np.bincount(doc[: len(g)][ok] * DIMS + (mix(g[ok], k) & np.uint64(DIMS - 1)).astype(np.int64), minlength=n * DIMS)
    return out.reshape(n, DIMS), has


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts.astype(np.float32)) * idf
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, n, data, offsets in chunks(batch.column(1)):
            counts, _ = ngram_counts(data, offsets)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), pa.array([r.tobytes() for r in np.minimum(counts, 65535).astype(np.uint16)], pa.binary())], ["lang", "counts"])


def _count_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(dimension, number of texts that have it); the number of texts stands at dimension DIMS."""
    total = np.zeros(DIMS + 1, dtype=np.int64)
    for batch in batches:
        for _, n, data, offsets in chunks(batch.column(0)):
            for a in range(0, n, 256):
                b = min(n, a + 256)
                counts, _ = ngram_counts(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                total[:DIMS] += (counts > 0).sum(axis=0)
                total[DIMS] += b - a
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIMS + 1)), pa.array(total)], ["dim", "n"])


def _length(counts: np.ndarray) -> np.ndarray:
    """Length class of each text: the logarithm to base two of its distinct dimensions."""
    return np.log2(np.maximum(1, (counts > 0).sum(axis=1))).astype(np.int64)


def _centroids(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(12):
        of = (x @ c.T).argmax(axis=1)
        c = np.stack([x[of == j].sum(axis=0) if (of == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


class Model:
    """langs[i] is the language of centroid row i, floors[i] its lowest accepted cosine by length class."""

    def __init__(self, langs: list[str], centroids: np.ndarray, idf: np.ndarray, floors: np.ndarray):
        self.langs, self.centroids, self.idf, self.floors = langs, centroids, idf, floors

    def parts(self) -> list[Model]:
        """Models of MAX_LANGUAGES languages each; a language's centroids follow each other."""
        cuts = [i for i, name in enumerate(self.langs) if i == 0 or name != self.langs[i - 1]][::MAX_LANGUAGES] + [len(self.langs)]
        return [Model(self.langs[a:b], self.centroids[a:b], self.idf, self.floors[a:b]) for a, b in zip(cuts, cuts[1:])]


def _nothing_known() -> Model:
    return Model(["und"], np.zeros((1, DIMS), np.float32), np.ones(DIMS, np.float32), np.zeros((1, LENGTHS)))


def _held_cosines(langs: list[str], centroids: np.ndarray, idf: np.ndarray) -> Callable:
    """lang, length class and best cosine to the own language, of texts and of their beginnings."""
    of: dict[str, list[int]] = {}
    for i, name in enumerate(langs):
        of.setdefault(name, []).append(i)

    def cosines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parts = [x.encode("utf-8", "replace") for x in (*(text[:k] for k in BEGINNINGS if k < len(text)), text)]
                counts, has = ngram_counts(np.frombuffer(b"".join(parts), dtype=np.uint8), np.cumsum([0, *map(len, parts)]))
                if lang in of:
                    best = (vectors(counts, idf) @ centroids[of[lang]].T).max(axis=1)
                    out += [(lang, k, float(c)) for k, c, h in zip(_length(counts).tolist(), best, has, strict=True) if h]
            types = [pa.string(), pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], ["lang", "length", "cosine"])

    return cosines


def _floors(names: list[str], rows: list) -> np.ndarray:
    """Floors by name and length class, from rows of lang, length, n, q."""
    known = {(r.lang, r.length): REJECT_SHARE * r.q for r in rows if r.n >= MIN_HELD}
    own = {}
    for name in {x for x, _ in known}:
        floor, of = 0.0, np.zeros(LENGTHS)
        for k in range(LENGTHS):
            floor = of[k] = known.get((name, k), floor)
        own[name] = of
    lowest = np.min(list(own.values()), axis=0) if own else np.zeros(LENGTHS)
    return np.stack([own.get(name, lowest) for name in names])


def fit(docs: DataFrame) -> Model | None:
    """Model from the labelled rows of docs; None if there are none. docs must hold learnable rows only."""
    arrow_limits(docs.sparkSession)
    known = docs.where("lang is not null and text is not null and doc_id is not null")
    sizes = saved(known.groupBy("lang").agg(F.count("*").alias("n")))
    n_langs = sizes.count()
    if not n_langs:
        return None
    per = max(20, FIT_TEXTS // n_langs)
    part = F.floor((F.row_number().over(Window.orderBy("lang")) - 1) / MAX_LANGUAGES) if n_langs > MAX_LANGUAGES else F.lit(0)
    unit = F.pmod(F.xxhash64("doc_id", "text", F.lit(17)), F.lit(1 << 30)) / F.lit(float(1 << 30))  # of id and text: rows that repeat an id are drawn apart
    drawn = known.join(F.broadcast(sizes.withColumn("part", part)), "lang").where(unit < 3.0 * per / F.col("n"))
    first = F.row_number().over(Window.partitionBy("lang").orderBy(unit, "doc_id", F.xxhash64("text")))
    rows = saved(drawn.select("part", "lang", "text", first.alias("r")).where(2 * F.col("r") <= 3 * per).select("part", "lang", "text", (F.col("r") % 3 == 0).alias("held")))
    frequency = np.zeros(DIMS + 1)
    for r in known.select("text").mapInArrow(tidy(_count_frequencies), "dim long, n long").groupBy("dim").agg(F.sum("n").alias("n")).collect():
        frequency[r.dim] = r.n
    idf = (np.log((1 + frequency[DIMS]) / (1 + frequency[:DIMS])) + 1).astype(np.float32)
    names, cs, low, rng = [], [], [], np.random.default_rng(7)
    for p in range(-(-n_langs // MAX_LANGUAGES)):
        mine = rows.where(F.col("part") == p)
        counted = mine.where("not held").select("lang", "text").mapInArrow(tidy(_count_rows), "lang string, counts binary").toArrow()
        counts = np.frombuffer(b"".join(counted["counts"].to_pylist()), dtype=np.uint16).reshape(-1, DIMS)
        lang = np.array(counted["lang"].to_pylist())
        order = np.array(sorted(range(len(lang)), key=lambda i: (lang[i], counts[i].tobytes())), dtype=int)
        x, lang = vectors(counts[order], idf), lang[order]
        own_names, own = [], [np.zeros((0, DIMS), np.float32)]
        for name in sorted(set(lang)):
            c = _centroids(x[lang == name], CENTROIDS, rng)
            own_names += [str(name)] * len(c)
            own.append(c)
        own = np.concatenate(own).astype(np.float32)
        held = mine.where("held").select("lang", "text").mapInArrow(tidy(_held_cosines(own_names, own, idf)), "lang string, length long, cosine double")
        low += held.groupBy("lang", "length").agg(F.count("*").alias("n"), F.percentile("cosine", F.lit(FLOOR_QUANTILE)).alias("q")).collect()
        names += own_names
        cs.append(own)
    return Model(names, np.concatenate(cs), idf, _floors(names, low)) if names else None


def _predictor(model: Model, begun: bool = False, more: bool = False) -> Callable:
    """Texts (last column) to lang_pred, score and rejected. begun: these stand before the text, from languages met before, the score as it was; more: further languages come, the text stays."""

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_rest = batch.num_columns - 1 - 3 * begun
            for at, n, data, offsets in chunks(batch.column(batch.num_columns - 1)):
                langs, scores, rejected = [], [], []
                before = [batch.column(n_rest + c).slice(at, n).to_pylist() for c in range(3)] if begun else None
                for a in range(0, n, 256):
                    b = min(n, a + 256)
                    counts, has = ngram_counts(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                    cos = vectors(counts, model.idf) @ model.centroids.T
                    best = cos.argmax(axis=1)
                    floor = model.floors[best, _length(counts)]
                    for i in range(b - a):
                        s = float(cos[i, best[i]]) if has[i] else 0.0
                        if before and has[i] and before[1][a + i] >= s:
                            lang, s, out = (c[a + i] for c in before)
                        else:
                            lang, out = model.langs[best[i]] if has[i] else "und", not has[i] or max(0.0, min(1.0, s)) < floor[i]
                        langs.append(lang)
                        scores.append(s if more else min(1.0, max(0.0, s)))
                        rejected.append(out)
                rest = [batch.column(c).slice(at, n) for c in range(n_rest)]
                said = [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())]
                text = [batch.column(batch.num_columns - 1).slice(at, n)] if more else []
                yield pa.RecordBatch.from_arrays([*rest, *said, *text], [*batch.schema.names[:n_rest], "lang_pred", "score", "rejected", *["text"] * more])

    return predict


def _predicted(rows: DataFrame, model: Model) -> DataFrame:
    """rows, whose last column is the text, with lang_pred, score and rejected in its place."""
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema][:-1] + ["lang_pred string, score double, rejected boolean"]
    parts = model.parts()
    for i, part in enumerate(parts[:-1]):
        rows = saved(rows.mapInArrow(tidy(_predictor(part, i > 0, True)), ", ".join([*kinds, "text string"])))
    return rows.mapInArrow(tidy(_predictor(parts[-1], len(parts) > 1)), ", ".join(kinds))


def learnable(docs: DataFrame) -> DataFrame:
    return docs.where(crc_mod(4) != 2)


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """Per row of docs: doc_id, held_out, lang_pred, score, rejected."""
    arrow_limits(docs.sparkSession)
    model = model or fit(learnable(docs)) or _nothing_known()
    rows = docs.select("doc_id", F.coalesce(crc_mod(4) == 2, F.lit(False)).alias("held_out"), "text")
    return _predicted(rows, model)


def drop_unknown(docs: DataFrame) -> DataFrame:
    """Pipeline stage: docs without the texts that language identification rejects; lang becomes the predicted language."""
    arrow_limits(docs.sparkSession)
    model = fit(learnable(docs)) or _nothing_known()
    own = [f"__{i}" for i in range(len(docs.columns))]  # so that no column of docs has the name of one that is added
    kept = docs.select(*[F.col(c).alias(n) for c, n in zip(docs.columns, own, strict=True)], "text")
    out = _predicted(kept, model).where("not rejected")
    return out.select(*[F.col("lang_pred" if c == "lang" else n).alias(c) for c, n in zip(docs.columns, own, strict=True)])
