"""Operator 3: benchmark decontamination as a prefix-filtered set join.

An item-sized window (ten consecutive item words, or all of a shorter item) occurs in a text only if each of its shingles
(three words, or all words of a shorter window) does. Containment must be whole, so one prefix shingle a window is enough: its rarest,
by counts over all documents. The steps:

1. counts of the benchmark's shingles over all documents (tasks test shingles against a bitmap of bounded size);
2. the rarest shingle and its place in the window, for each window;
3. places of prefix shingles in the documents, with up to nine words to each side;
4. join on the shingle; the window must fit the text at that place (positional and length bounds); its words must be equal.

Only the bitmaps (up to MOST_BITS, by the number of shingles) go to all tasks; windows and candidates meet in a shuffle join.

Results: null text has no words; an item without text or words has no window; an item with a null item_id has windows as any other and is no
counted item; repeated rows are handled alike, each with its own result; rows with a null doc_id are told apart by their text. doc_ids are cast to
long. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Words, arrow_limits, byte_table, chunks, row_key, run_hash, saved, tidy

WINDOW = 10
SHINGLE = 3
FILTER_BITS, MOST_BITS = 24, 28
"""The bitmap has 256 bits for each shingle, between these powers of two; the largest has 32 MB. Beyond, more places are looked at, with the same results."""


def _shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of k words, and which of them lie within one text."""
    h = run_hash(w.hash, k)
    return h, w.doc[: len(h)] == w.doc[k - 1 :] if len(h) else np.zeros(0, dtype=bool)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each window's shingles: item_id, win (its words), n (their number), at (shingle's place in it), h."""
    letters = byte_table(alnum=True)
    for batch in batches:
        for first, _, data, offsets in chunks(batch.column(1)):
            w, rows = Words(data, offsets, letters), []
            ids = batch.column(0).to_pylist()
            for d in range(w.n_docs):
                a, b = int(w.word_at[d]), int(w.word_at[d + 1])
                words = [w.text(i).translate(_LOWER) for i in range(a, b)]
                for s in range(max(1, b - a - WINDOW + 1) if b > a else 0):
                    n = min(WINDOW, b - a)
                    h = run_hash(w.hash[a + s : a + s + n], min(SHINGLE, n)).view(np.int64)
                    rows += [(ids[first + d], " ".join(words[s : s + n]), n, at, int(x)) for at, x in enumerate(h)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, _WIN_TYPES, strict=True)], ["item_id", "win", "n", "at", "h"])


_LOWER = {c: c + 32 for c in range(65, 91)}
_WIN_TYPES = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64()]


def _bitmap(hashes: DataFrame) -> np.ndarray:
    """A bitmap with the bits of the column h set, sized by the number of rows; what is collected has at most that size."""
    bits = min(MOST_BITS, max(FILTER_BITS, (256 * hashes.count()).bit_length()))
    bit = F.col("h").bitwiseAND((1 << bits) - 1)
    rows = hashes.groupBy(F.shiftright(bit, 5).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(31).cast("int"))).alias("b")).toArrow()
    out = np.zeros(1 << (bits - 5), dtype=np.uint32)
    out[rows["w"].to_numpy()] = rows["b"].to_numpy().astype(np.uint32)
    return out


def _in(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    low = h & np.uint64(32 * len(bitmap) - 1)
    return (bitmap[(low >> np.uint64(5)).astype(np.int64)] >> (low & np.uint64(31)).astype(np.uint32)) & np.uint32(1) != 0


def _counter(bitmap: np.ndarray, sizes: list[int]) -> Callable:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = byte_table(alnum=True)
        for batch in batches:
            found = []
            for _, _, data, offsets in chunks(batch.column(0)):
                w = Words(data, offsets, letters)
                for k in sizes:
                    h, whole = _shingles(w, k)
                    found.append(h[_in(bitmap, h) & whole])
            if found:
                h, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["h", "c"])

    return count


def _finder(bitmap: np.ndarray, sizes: list[int]) -> Callable:
    """Rows of two kinds: one a text, with n_words; one a candidate place, with h, its place pos, words left of it in ctx."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = byte_table(alnum=True)
        for batch in batches:
            for first, n_rows, data, offsets in chunks(batch.column(2)):
                w, cand = Words(data, offsets, letters), []
                for k in sizes:
                    h, whole = _shingles(w, k)
                    for i in np.flatnonzero(_in(bitmap, h) & whole).tolist():
                        d = w.doc[i]
                        lo, hi = max(int(w.word_at[d]), i - WINDOW + 1), min(int(w.word_at[d + 1]), i + WINDOW)
                        ctx = " ".join([w.text(j) for j in range(lo, hi)]).translate(_LOWER)
                        cand.append((first + int(d), int(h[i].view(np.int64)), i - int(w.word_at[d]), i - lo, hi - i, ctx))
                rows = np.concatenate([np.arange(first, first + n_rows), np.array([c[0] for c in cand], dtype=np.int64)])
                pad = [None] * n_rows
                keys = [batch.column(c).take(pa.array(rows)) for c in (0, 1)]
                cols = [pa.array(pad + [c[j] for c in cand], t) for j, t in ((1, pa.int64()), (2, pa.int64()), (3, pa.int32()), (4, pa.int32()), (5, pa.string()))]
                words = pa.array([*w.n_words.tolist(), *[None] * len(cand)], pa.int64())
                yield pa.RecordBatch.from_arrays([*keys, words, *cols], ["i", "t", "n_words", "h", "pos", "before", "after", "ctx"])

    return find


def occurrences(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows: doc key and n_words for each row of docs; matches: doc key, item_id, start and n of each window's occurrences)."""
    arrow_limits(docs.sparkSession)
    windows = saved(benchmark.select(F.col("item_id").cast("string"), "text").mapInArrow(tidy(_windows), "item_id string, win string, n int, at int, h long"))
    sizes = sorted(r.k for r in windows.select(F.least(F.col("n"), F.lit(SHINGLE)).alias("k")).distinct().collect())
    counts = docs.select("text").mapInArrow(tidy(_counter(_bitmap(windows), sizes)), "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))
    rarity = windows.join(counts, "h", "left").groupBy("item_id", "win", "n").agg(F.min(F.struct(F.coalesce("c", F.lit(0)).alias("c"), "at", "h")).alias("p"))
    prefix = saved(rarity.select("item_id", "win", "n", "p.at", "p.h"))
    keyed = docs.select(F.col("doc_id").cast("long").alias("i"), F.xxhash64("text").alias("t"), "text")
    found = saved(keyed.mapInArrow(tidy(_finder(_bitmap(prefix), sizes)), "i long, t long, n_words long, h long, pos long, before int, after int, ctx string"))
    fits: Column = (F.col("at") <= F.col("before")) & (F.col("n") - F.col("at") <= F.col("after"))
    same = F.array_join(F.slice(F.split("ctx", " "), F.col("before") - F.col("at") + 1, F.col("n")), " ") == F.col("win")
    matches = found.where("h is not null").join(prefix, "h").where(fits & same).select("i", "t", "item_id", (F.col("pos") - F.col("at")).alias("start"), "n").distinct()
    return found.where("n_words is not null").select("i", "t", "n_words"), matches


def decontamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated (and key t, the text's hash)."""
    rows, matches = occurrences(docs, benchmark)
    matches = matches.withColumn("k", F.struct("i", "t"))
    order = Window.partitionBy("k").orderBy("start", "n")
    ends = F.max(F.col("start") + F.col("n")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    spans = matches.select("k", "start", "n").distinct().withColumn("done", F.coalesce(ends, F.lit(0)))
    hits = spans.groupBy("k").agg(F.sum(F.greatest(F.lit(0), F.col("start") + F.col("n") - F.greatest("start", "done"))).alias("n_hit"))
    items = matches.groupBy("k").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    found = hits.join(items, "k")
    out = rows.withColumn("k", F.struct("i", "t")).join(found, "k", "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    ids = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(F.col("i").alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), F.col("t").alias("text_hash"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Pipeline stage: docs without the texts in which a benchmark window occurs."""
    bad = saved(decontamination(docs, benchmark).where("contaminated").select(F.struct(F.col("doc_id").alias("i"), F.col("text_hash").alias("h")).alias("k")).distinct())
    return docs.withColumn("__k", F.struct(F.col("doc_id").cast("long").alias("i"), row_key()["h"].alias("h"))).join(bad.withColumnRenamed("k", "__k"), "__k", "left_anti").drop("__k")
