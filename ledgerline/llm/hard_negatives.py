"""Operator 12: hard negatives of anchor rows, scored exactly by the method of the Four Russians.

A component x becomes the integer floor(256 * x). For each group of eight dimensions an anchor has a table of the sums of all 256 subsets of its
eight integers. A candidate's integers are cut into bit planes (two's complement), eight dimensions to a byte: a byte looks up the
sum of the anchor's integers where its plane has ones, the sums of a plane are added, planes are added with their power of two and the
sign's plane is taken off. That is the full inner product.

Rows meet anchors in blocks: candidates are dealt by place into blocks of about ROWS, anchors into blocks of about ANCHORS, and each pair of
blocks is one group of a co-grouped job, which keeps only the first few rows of each anchor. A first job finds the positives, a second one, knowing
their scores, the negatives. No pair of rows is ever a Spark row, nothing is broadcast or collected, and a task holds one pair of blocks.

Results: rows with a null label, a null vector, or a null or non-finite component take no part; nor do rows with a component of COMPONENT
or more, whose scores might not fit 64 bits. Shorter vectors count as having zeros at their end; an empty one scores 0. Rows with the anchor's vec_id are not
"other rows". Other repeated vec_ids are rows of their own, as anchors too; rows equal in score and vec_id come in any order. A null
vec_id is no anchor and comes last among equals. Anchors without positives, and positives without negatives, give no row; empty tables none.
Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import one_partition_of, saved

ROWS, ANCHORS = 8192, 8192
SLICE, STRIP = 64, 1024
"""Anchors and rows scored at once inside a group: tables and sums then stay in the processor's cache."""
COMPONENT = 2.0**17
N_POSITIVES, N_NEGATIVES = 5, 5
LEAST, MOST = 80, 100
"""A negative's score lies between so many hundredths of the positive's and so many."""
NO_ID = np.iinfo(np.int64).max


def usable(rows: DataFrame, vector: str = "embedding", label: Column | None = None) -> DataFrame:
    """id, label, vec of the rows that take part."""
    kept = rows.select(F.col("vec_id").alias("id"), (F.col("label") if label is None else label).alias("label"), F.col(vector).alias("vec"))
    return kept.where(F.col("label").isNotNull() & F.forall("vec", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < COMPONENT), F.lit(False))))


def integers(vectors: pa.Array) -> np.ndarray:
    """floor(256 * x) of each vector's components, one row each, padded with zeros to a multiple of eight columns."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    n = len(vectors)
    sizes = np.asarray(vectors.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64) if n else np.zeros(0, np.int64)
    flat = np.floor(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * 256).astype(np.int64)
    width = -(-max(8, int(sizes.max(initial=0))) // 8) * 8
    out = np.zeros((n, width), dtype=np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def subset_sums(anchors: np.ndarray, kind: type) -> np.ndarray:
    """[group of eight dimensions, byte, anchor]: the sum of the anchor's integers at the byte's ones."""
    n, width = anchors.shape
    parts = anchors.T.reshape(width // 8, 8, n).astype(kind)
    out = np.zeros((width // 8, 256, n), dtype=kind)
    for i in range(8):
        out[:, 1 << i : 2 << i] = out[:, : 1 << i] + parts[:, i : i + 1]
    return out


def bit_planes(rows: np.ndarray) -> np.ndarray:
    """[plane, group of eight dimensions, row]: bytes of two's complement, the last plane that of the sign."""
    bits = int(max(rows.max(initial=0), -1 - rows.min(initial=0))).bit_length() + 1
    return np.stack([np.packbits((rows >> j & 1).astype(np.uint8), axis=1, bitorder="little").T for j in range(bits)])


def scores(tables: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """[row, anchor]: inner products from the anchors' tables and the rows' bytes."""
    n_planes, n_groups, n = planes.shape
    total = np.zeros((n, tables.shape[2]), dtype=tables.dtype)
    for j in range(n_planes - 1, -1, -1):  # from the sign down, doubling what is there: the sum of 2**j times plane j
        total <<= 1
        for g in range(n_groups):
            part = tables[g].take(planes[j, g], axis=0)
            (np.subtract if j == n_planes - 1 else np.add)(total, part, out=total)
    return total


def _first(score: np.ndarray, ids: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Of the rows `at`, the n with the highest score, ties by id."""
    if len(at) > 4 * n:
        s = score[at]
        at = at[s >= np.partition(s, len(s) - n)[len(s) - n]]
    return at[np.lexsort((ids[at], -score[at]))[:n]]


def _scored(left: pa.Table, right: pa.Table):
    """(anchor's place, strip's first row, scores) of each anchor with each strip of rows."""
    a, b = integers(left["vec"]), integers(right["vec"])
    width = max(a.shape[1], b.shape[1])
    a, b = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))
    bound = width * (int(np.abs(a).max(initial=0)) + 1) << (int(np.abs(b).max(initial=0)).bit_length() + 2)
    kind = np.int32 if bound < 2**31 else np.int64
    for i in range(0, len(a), SLICE):
        tables = subset_sums(a[i : i + SLICE], kind)
        for j in range(0, len(b), STRIP):
            s = scores(tables, bit_planes(b[j : j + STRIP]))
            for k, column in enumerate(np.ascontiguousarray(s.T)):
                yield i + k, j, column


def _ids(table: pa.Table) -> np.ndarray:
    return table["id"].combine_chunks().fill_null(NO_ID).to_numpy()


def _nullable(ids: list[int]) -> pa.Array:
    return pa.array([None if x == NO_ID else x for x in ids], pa.int64())


_POSITIVES = "a long, id long, score long"


def _find_positives(n: int) -> Callable:
    def find(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int]] = []
        if len(left) and len(right):
            a, a_id, a_label, ids, label = left["a"].to_pylist(), _ids(left), left["label"].to_pylist(), _ids(right), right["label"].to_numpy()
            best: dict[int, list[tuple[int, int]]] = {}
            for i, at, score in _scored(left, right):
                own = ids[at : at + len(score)]
                near = np.flatnonzero((label[at : at + len(score)] == a_label[i]) & (own != a_id[i]))
                near = _first(score, own, near, n)
                best[i] = sorted(best.get(i, []) + list(zip((-score[near].astype(np.int64)).tolist(), own[near].tolist(), strict=True)))[:n]
            out = [(a[i], x, -s) for i, rows in best.items() for s, x in rows]
        return pa.table({"a": pa.array([r[0] for r in out], pa.int64()), "id": _nullable([r[1] for r in out]), "score": pa.array([r[2] for r in out], pa.int64())})

    return find


_NEGATIVES = "a long, p int, id long, score long"


def _find_negatives(n: int, least: int, most: int) -> Callable:
    def find(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int, int]] = []
        if len(left) and len(right):
            a, a_label, ids, label, wanted = left["a"].to_pylist(), left["label"].to_pylist(), _ids(right), right["label"].to_numpy(), left["positives"].to_pylist()
            best: dict[tuple[int, int], list[tuple[int, int]]] = {}
            for i, at, score in _scored(left, right):
                limits = [(p["p"], p["score"]) for p in wanted[i] if p["score"] >= 0]  # under zero no score fits
                if not limits:
                    continue
                score, own = score.astype(np.int64), ids[at : at + len(score)]
                other = np.flatnonzero((100 * score >= least * min(s for _, s in limits)) & (label[at : at + len(score)] != a_label[i]))
                for p, s in limits:
                    fit = other[(100 * score[other] >= least * s) & (100 * score[other] <= most * s)]
                    if len(fit):
                        fit = _first(score, own, fit, n)
                        best[i, p] = sorted(best.get((i, p), []) + list(zip((-score[fit]).tolist(), own[fit].tolist(), strict=True)))[:n]
            out = [(a[i], p, x, -s) for (i, p), rows in best.items() for s, x in rows]
        return pa.table({"a": pa.array([r[0] for r in out], pa.int64()), "p": pa.array([r[1] for r in out], pa.int32()), "id": _nullable([r[2] for r in out]), "score": pa.array([r[3] for r in out], pa.int64())})

    return find


def _in_blocks(anchors: DataFrame, rows: DataFrame, n_anchors: int, n_rows: int, job: Callable, schema: str) -> DataFrame:
    """job over every pair of a block of anchors and a block of rows."""
    least = 2 * rows.sparkSession.sparkContext.defaultParallelism
    p_blocks, q_blocks = max(1, min(one_partition_of(n_rows, ROWS, least), -(-n_rows // 256))), one_partition_of(n_anchors, ANCHORS, 1)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    place = F.monotonically_increasing_id()
    left = anchors.withColumn("q", F.pmod(F.col("a"), F.lit(q_blocks)).cast("int")).withColumn("p", every(p_blocks))
    right = rows.withColumn("p", F.pmod(place, F.lit(p_blocks)).cast("int")).withColumn("q", every(q_blocks))
    return left.groupBy("p", "q").cogroup(right.groupBy("p", "q")).applyInArrow(job, schema)


def _ranked(rows: DataFrame, groups: list[str], most: int) -> DataFrame:
    order = Window.partitionBy(*groups).orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def hard_negatives(vectors: DataFrame, anchors: DataFrame, n_positives: int = N_POSITIVES, n_negatives: int = N_NEGATIVES, least: int = LEAST, most: int = MOST) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for vectors and anchors (id, label, vec), both from usable().

    An anchor's positives are the n_positives other rows of its label with the highest score; a positive's negatives are the first n_negatives rows of
    other labels that score between `least` and `most` hundredths of it. Equal scores come by smaller id.
    """
    anchors = saved(anchors.withColumn("a", F.monotonically_increasing_id()))
    n_anchors, n_rows = anchors.count(), vectors.count()
    found = _in_blocks(anchors, vectors, n_anchors, n_rows, _find_positives(n_positives), _POSITIVES)
    positives = _ranked(found, ["a"], n_positives).groupBy("a").agg(F.array_sort(F.collect_list(F.struct(F.col("rank").alias("p"), F.col("score"), "id"))).alias("positives"))
    paired = saved(anchors.join(positives, "a"))
    rows = _in_blocks(paired, vectors, n_anchors, n_rows, _find_negatives(n_negatives, least, most), _NEGATIVES)
    told = paired.select("a", F.col("id").alias("anchor_id"), F.inline("positives")).select("a", "anchor_id", "p", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return _ranked(rows, ["a", "p"], n_negatives).join(told, ["a", "p"]).select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def mined(embeddings: DataFrame, every: int = 100) -> DataFrame:
    """hard_negatives of embeddings (vec_id, embedding, label): anchors are rows whose vec_id is divisible by `every`; a vec_id divisible by 7 moves its label on by one, modulo 10."""
    label = F.when(F.coalesce(F.col("vec_id") % 7 == 0, F.lit(False)), (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = usable(embeddings, label=label)
    return hard_negatives(rows, rows.where(F.col("id") % every == 0))
