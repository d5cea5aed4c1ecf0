"""Operator 11: ranked lexical search over K2-treaps of the term-document grid.

Tasks cut their documents into blocks of about BLOCK_POSTINGS postings. In a block, documents are ordered by length and terms by how many documents
hold them, and each posting is a point (term, document) with its impact, 1000000000 * tf div (1000 * tf + 8 * m). The K2-treap of these points is a
quadtree kept as four child bits a cell, in order of levels; a cell holds the point of the greatest impact in it that no cell above
holds. So every posting is in one cell, and impacts fall from the root to the leaves.

A query's terms are rows of the grid. A state of the search is a range of documents with, for each term, the cell on its row's path that
covers the range, and the points of the row that cells above held. Its bound is the sum over terms of weight times the
greatest of these impacts. States with the highest bounds are split into halves first, all rows descending at once (a number of states and all queries
of a pass in one step of arrays); a state without cells left has exact scores; states whose bound is under the query's
TOP-th score so far are dropped, which loses nothing as a bound is never under a score.

The index is a table, one row a block, and may be kept and searched again; every document is in it. Weights come from document frequencies over all blocks.
Queries go to the blocks in passes of at most PASS_TERMS terms, so what a task holds of them has a fixed size.

Results: a null text has no terms, is in no count and matches nothing. Null doc_ids are documents and come last among equals; repeated doc_ids
are documents of their own. Rows of benchmark with one item_id (null too) are one item with the terms of all. Items without a match give no
row; empty tables none. Other columns are ignored. Terms are told apart by a 64-bit hash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Words, arrow_limits, byte_table, chunks, saved, tidy

TOP = 10
BLOCK_POSTINGS, BLOCK_DOCS = 1 << 19, 1 << 12
STATES = 256
"""States that a query splits at once in one block, best bounds first, until its first documents have scores; then all that still may win."""
QUERIES = 256
"""Queries that descend together in one block."""
PASS_TERMS = 1_000_000
BATCH_BYTES = 16 << 20
"""Blocks that a task reads at once; one larger block comes by itself."""
BLOCK_FILES = {"parquet.block.row.count.limit": "1", "parquet.column.statistics.enabled": "false"}
"""A block is a row group of its own: else a task would hold up to 100 blocks until it writes them, and all at once when it reads them, and no other could
take some. Statistics would keep copies of each block's largest columns, as their least and greatest values, until the file is closed."""
NO_ID = np.iinfo(np.int64).max


# ---- counts and postings ------------------------------------------------------------------------------------------


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with a term, and their terms, of each batch."""
    inside_word = byte_table(alnum=True) != 0
    for batch in batches:
        docs = terms = 0
        for _, _, data, offsets in chunks(batch.column(0)):
            inside = inside_word[data]
            first = inside.copy()
            first[1:] &= ~inside[:-1]
            starts = offsets[:-1][offsets[:-1] < len(data)]
            first[starts] = inside[starts]
            n = np.diff(np.concatenate([[0], np.cumsum(first)])[offsets])
            docs, terms = docs + int((n > 0).sum()), terms + int(n.sum())
        yield pa.RecordBatch.from_arrays([pa.array([docs]), pa.array([terms])], ["docs", "terms"])


def _postings(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term's hash, occurrences) of each distinct term of each text, by text."""
    order = np.lexsort((words.hash, words.doc))
    doc, term = words.doc[order], words.hash[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (term[1:] != term[:-1])
    at = np.flatnonzero(new)
    return doc[at], term[at], np.diff(np.append(at, len(doc)))


# ---- K2-treap -----------------------------------------------------------------------------------------------------


def _spread(x: np.ndarray) -> np.ndarray:
    """Each bit of x at twice its place."""
    x = x.astype(np.uint64)
    for shift, keep in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | (x << np.uint64(shift))) & np.uint64(keep)
    return x


@dataclass
class Treap:
    """Cells in order of levels: child bits, and row, column and value of the point that each holds."""

    levels: int
    mask: np.ndarray
    row: np.ndarray
    col: np.ndarray
    value: np.ndarray

    @staticmethod
    def of(row: np.ndarray, col: np.ndarray, value: np.ndarray) -> Treap:
        """The treap of distinct points (row, col); equal values: the first in the quadtree's order is above."""
        levels = max(int(row.max(initial=0)).bit_length(), int(col.max(initial=0)).bit_length())
        code = (_spread(row) << np.uint64(1)) | _spread(col)
        order = np.argsort(code)
        code, row, col, value = code[order], row[order], col[order], value[order]
        cells: list[tuple[np.ndarray, ...]] = []
        above = np.zeros(0, dtype=np.uint64)
        for level in range(levels + 1):
            if not len(code):
                break
            cell = code >> np.uint64(2 * (levels - level))
            starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
            which = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(cell))))
            top = np.flatnonzero(value == np.maximum.reduceat(value, starts)[which])
            top = top[np.concatenate([[True], which[top][1:] != which[top][:-1]])]
            here = cell[starts]
            if level:
                np.bitwise_or.at(cells[-1][0], np.searchsorted(above, here >> np.uint64(2)), (1 << (here & np.uint64(3)).astype(np.int64)).astype(np.uint8))
            cells.append((np.zeros(len(starts), dtype=np.uint8), row[top], col[top], value[top]))
            above, rest = here, np.ones(len(cell), dtype=bool)
            rest[top] = False
            code, row, col, value = code[rest], row[rest], col[rest], value[rest]
        mask, row, col, value = (np.concatenate([c[i] for c in cells]) if cells else np.zeros(0, np.int64) for i in range(4))
        return Treap(levels, mask.astype(np.uint8), row.astype(np.int32), col.astype(np.int32), value.astype(np.int32))

    def __post_init__(self) -> None:
        self.first = (1 + np.cumsum(_BITS[self.mask]) - _BITS[self.mask]).astype(np.int32)

    def child(self, cell: np.ndarray, quadrant: np.ndarray) -> np.ndarray:
        """The cells' children in a quadrant (2 * row's bit + column's bit), -1 where there is none."""
        before = _BEFORE[self.mask[cell], quadrant]
        return np.where(before < 0, before, self.first[cell] + before)


_BITS = np.array([bin(i).count("1") for i in range(16)], dtype=np.int64)
_BEFORE = np.array([[_BITS[i & ((1 << q) - 1)] if i >> q & 1 else -1 for q in range(4)] for i in range(16)], dtype=np.int32)
"""For child bits and a quadrant, how many children come before; -1: the quadrant has none."""


# ---- search -------------------------------------------------------------------------------------------------------


def _runs(keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)


def _places(keys: np.ndarray) -> np.ndarray:
    """Place of each row within its run of equal keys."""
    starts = _runs(keys)
    return np.arange(len(keys)) - np.repeat(starts, np.diff(np.append(starts, len(keys))))


class Best:
    """The first k documents of each query so far: score, then smaller id."""

    def __init__(self, n_queries: int, k: int):
        self.k, self.least = k, np.ones(n_queries, dtype=np.int64)
        self.query, self.id, self.score = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        fit = score >= self.least[query]
        if not fit.any():
            return
        query, ids, score = (np.concatenate([a, b[fit]]) for a, b in ((self.query, query), (self.id, ids), (self.score, score)))
        order = np.lexsort((ids, -score, query))
        order = order[_places(query[order]) < self.k]
        self.query, self.id, self.score = query[order], ids[order], score[order]
        last = _places(self.query) == self.k - 1
        self.least[self.query[last]] = self.score[last]


class _States:
    """Ranges of documents: query, level, bound; and entries of each: term, cell or -1, the point's document where there is no cell, impact."""

    def __init__(self, query, level, bound, size, term, cell, doc, impact):
        self.query, self.level, self.bound, self.size, self.term, self.cell, self.doc, self.impact = query, level, bound, size, term, cell, doc, impact

    def take(self, at: np.ndarray) -> _States:
        size = self.size[at]
        begin = (np.cumsum(self.size) - self.size)[at]
        e = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        return _States(self.query[at], self.level[at], self.bound[at], size, self.term[e], self.cell[e], self.doc[e], self.impact[e])

    def plus(self, other: _States) -> _States:
        return _States(*[np.concatenate([a, b]) for a, b in zip(vars(self).values(), vars(other).values(), strict=True)])


def _split(treap: Treap, s: _States, row: np.ndarray, weight: np.ndarray) -> tuple[_States, tuple[np.ndarray, ...]]:
    """Both halves of each state: (those with cells left; query, document and score of all documents of the others)."""
    of = np.repeat(np.arange(len(s.size)), s.size)
    bit = (treap.levels - 1 - s.level)[of]
    at = np.flatnonzero(s.cell >= 0)
    cell, term, twice, cell_bit = s.cell[at], s.term[at], 2 * of[at], bit[at]
    wanted = row[term]
    quadrant = (wanted >> cell_bit & 1) * 2
    leaf = cell_bit == 0  # the halves are single documents: their cells' points are the postings themselves
    point = np.flatnonzero(s.cell < 0)
    parts = [(2 * of[point] + (s.doc[point] >> bit[point] & 1), s.term[point], s.cell[point], s.doc[point], s.impact[point])]
    holds = np.flatnonzero(treap.row[cell] == wanted)
    doc = treap.col[cell[holds]]
    parts.append((twice[holds] + (doc >> cell_bit[holds] & 1), term[holds], np.full(len(doc), -1, dtype=np.int32), doc, treap.value[cell[holds]]))
    for half in (0, 1):
        kid = treap.child(cell, quadrant + half)
        there = np.flatnonzero(kid >= 0)
        kid = kid[there]
        parts.append((twice[there] + half, term[there], np.where(leaf[there], np.int32(-1), kid), treap.col[kid], treap.value[kid]))
    key, term, cell, doc, impact = (np.concatenate(c) for c in zip(*parts, strict=True))
    if not len(key):
        none = np.zeros(0, np.int64)
        return _States(*[none] * 8), (none, none, none)
    both = key * len(row) + term
    order = np.argsort(both, kind="stable")
    key, term, cell, doc, impact = key[order], term[order], cell[order], doc[order], impact[order]
    both = _runs(both[order])
    most = np.maximum.reduceat(impact, both) * weight[term[both]]
    starts = _runs(key)
    bound = np.add.reduceat(most, _runs(key[both]))
    open_ = np.maximum.reduceat(cell, starts) >= 0
    size = np.diff(np.append(starts, len(key)))
    parent = key[starts] >> 1
    halves = _States(s.query[parent], s.level[parent] + 1, bound, size, term, cell, doc, impact)
    done = halves.take(np.flatnonzero(~open_))
    pair = (np.repeat(done.query, done.size) << treap.levels) + done.doc
    order = np.argsort(pair, kind="stable")
    at = _runs(pair[order])
    score = np.add.reduceat((done.impact * weight[done.term])[order], at) if len(at) else np.zeros(0, np.int64)
    pair = pair[order][at]
    return halves.take(np.flatnonzero(open_)), (pair >> treap.levels, pair & ((1 << treap.levels) - 1), score)


def search_block(treap: Treap, ids: np.ndarray, query: np.ndarray, row: np.ndarray, weight: np.ndarray, best: Best) -> None:
    """Adds to best what documents of a block score for queries: (query, row, weight) of each term that the block has, by query."""
    if not len(query) or not len(treap.mask):
        return
    starts = _runs(query)
    size = np.diff(np.append(starts, len(query)))
    n = len(query)
    s = _States(query[starts], np.zeros(len(starts), np.int64), np.add.reduceat(weight, starts) * int(treap.value[0]), size, np.arange(n, dtype=np.int32), *np.zeros((2, n), np.int32), np.full(n, treap.value[0]))
    if not treap.levels:  # one point
        best.add(query, ids[treap.col[np.zeros(n, np.int64)]], weight * int(treap.value[0]))
        return
    turn = 0
    while len(s.query):
        order = np.lexsort((-s.bound, s.query))
        order = order[s.bound[order] >= best.least[s.query[order]]]
        place = _places(s.query[order])
        most = STATES if turn <= treap.levels else len(order)
        halves, (q, doc, score) = _split(treap, s.take(order[place < most]), row, weight)
        best.add(q, ids[doc], score)
        turn += 1
        s = s.take(order[place >= most]).plus(halves.take(np.flatnonzero(halves.bound >= best.least[halves.query])))


# ---- index --------------------------------------------------------------------------------------------------------

_BLOCK = "block long, doc_ids array<long>, terms array<long>, dfs array<int>, rows binary, levels int, mask binary, row binary, col binary, impact binary"


def _indexer(total_docs: int, total_terms: int, block_docs: int) -> Callable:
    """Blocks of documents: their ids, their terms in order of hash with df and row, and the treap of their postings."""

    def block(number: int, ids: list, sizes: list, found: list) -> pa.RecordBatch:
        size = np.concatenate(sizes).astype(np.int64)
        doc, term, tf = (np.concatenate([f[i] for f in found]) for i in range(3))
        order = np.argsort(size, kind="stable")
        place = np.empty(len(size), dtype=np.int64)
        place[order] = np.arange(len(size))
        m = 10 + 90 * size * total_docs // max(1, total_terms)
        impact = 1_000_000_000 * tf // (1000 * tf + 8 * m[doc])
        terms, which, df = np.unique(term, return_inverse=True, return_counts=True)
        rows = np.empty(len(terms), dtype=np.int64)
        rows[np.argsort(-df, kind="stable")] = np.arange(len(terms))
        treap = Treap.of(rows[which], place[doc], impact)
        packed = [x.astype(np.int32).tobytes() for x in (rows, treap.row, treap.col, treap.value)]
        one = lambda x, kind: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x if isinstance(x, pa.Array) else pa.array(x, kind))
        ids = pa.concat_arrays(ids).take(pa.array(order))
        cols = [pa.array([(TaskContext.get().partitionId() << 32) + number]), one(ids, None), one(terms.view(np.int64), pa.int64()), one(df.astype(np.int32), pa.int32()), *[pa.array([x], pa.binary()) for x in packed[:1]], pa.array([treap.levels], pa.int32()), *[pa.array([x], pa.binary()) for x in (treap.mask.tobytes(), *packed[1:])]]
        return pa.RecordBatch.from_arrays(cols, ["block", "doc_ids", "terms", "dfs", "rows", "levels", "mask", "row", "col", "impact"])

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, number, ids, sizes, found, n_docs, n_postings = byte_table(alnum=True), 0, [], [], [], 0, 0
        for batch in batches:
            for first, n, data, offsets in chunks(batch.column(1)):
                words = Words(data, offsets, letters)
                doc, term, tf = _postings(words)
                ids.append(batch.column(0).slice(first, n))
                sizes.append(words.n_words)
                found.append((doc + n_docs, term, tf))
                n_docs, n_postings = n_docs + n, n_postings + len(doc)
                if n_docs >= block_docs or n_postings >= BLOCK_POSTINGS:
                    yield block(number, ids, sizes, found)
                    number, ids, sizes, found, n_docs, n_postings = number + 1, [], [], [], 0, 0
        if n_docs:
            yield block(number, ids, sizes, found)

    return index


@dataclass
class Index:
    """blocks: a saved table, one row a block. n_docs counts the documents with a term, n_terms their terms."""

    blocks: DataFrame
    n_docs: int
    n_terms: int


def build_index(docs: DataFrame, block_docs: int = BLOCK_DOCS) -> Index:
    """The index of docs (doc_id, text)."""
    arrow_limits(docs.sparkSession)
    total = docs.select("text").mapInArrow(tidy(_count), "docs long, terms long").agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("n"), F.coalesce(F.sum("terms"), F.lit(0)).alias("l")).first()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return Index(saved(rows.mapInArrow(tidy(_indexer(total.n, total.l, block_docs)), _BLOCK), **BLOCK_FILES), total.n, total.l)


def query_terms(items: DataFrame) -> DataFrame:
    """item_id, term: the distinct terms of each item."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = byte_table(alnum=True)
        for batch in batches:
            for first, _, data, offsets in chunks(batch.column(1)):
                doc, term, _ = _postings(Words(data, offsets, letters))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc + first)), pa.array(term.view(np.int64))], ["item_id", "term"])

    kind = items.schema["item_id"].dataType.simpleString()
    return items.select("item_id", "text").mapInArrow(tidy(find), f"item_id {kind}, term long").distinct()


def _searcher(query: np.ndarray, term: np.ndarray, weight: np.ndarray, n_queries: int, k: int) -> Callable:
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, n32 = Best(n_queries, k), lambda x: np.frombuffer(x.as_py(), dtype=np.int32)
        for batch in batches:
            for i in range(batch.num_rows):
                get = lambda name, i=i, batch=batch: batch.column(batch.schema.get_field_index(name))[i]
                ids = get("doc_ids").values.fill_null(NO_ID).to_numpy()
                terms = get("terms").values.to_numpy().view(np.uint64)
                treap = Treap(get("levels").as_py(), np.frombuffer(get("mask").as_py(), dtype=np.uint8), n32(get("row")), n32(get("col")), n32(get("impact")))
                at = np.minimum(np.searchsorted(terms, term), max(0, len(terms) - 1))
                has = terms[at] == term if len(terms) else np.zeros(len(term), dtype=bool)
                rows = n32(get("rows"))
                for a in range(0, n_queries, QUERIES):
                    own = np.flatnonzero(has & (query >= a) & (query < a + QUERIES))
                    search_block(treap, ids, query[own], rows[at[own]], weight[own], best)
        yield pa.RecordBatch.from_arrays([pa.array(best.query), pa.array([None if x == NO_ID else x for x in best.id.tolist()], pa.int64()), pa.array(best.score)], ["q", "doc_id", "score"])

    return search


def search(index: Index, items: DataFrame, k: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents of index with the highest score above 0 for each of items (item_id, text)."""
    spark = items.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    terms = saved(query_terms(items))
    wanted = terms.select("term").distinct()
    known = index.blocks.select(F.inline(F.arrays_zip(F.col("terms").alias("term"), F.col("dfs").alias("df"))))
    df = known.join(F.broadcast(wanted) if terms.count() <= PASS_TERMS else wanted, "term").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.ln(F.lit(2.0 * index.n_docs + 2) / (2 * F.col("df") + 1))).cast("long")
    weighted = terms.join(df.select("term", weight.alias("weight")), "term").where("weight > 0")
    # items are numbered, and dealt to passes by their terms
    sizes = weighted.groupBy("item_id").agg(F.count("*").alias("n"))
    order = Window.orderBy("item_id")
    numbered = saved(sizes.select("item_id", (F.row_number().over(order) - 1).alias("q"), F.floor((F.sum("n").over(order) - F.col("n")) / PASS_TERMS).alias("pass")))
    entries = saved(weighted.join(numbered, weighted["item_id"].eqNullSafe(numbered["item_id"])).select("pass", "q", "term", "weight"))
    found = None
    for p in [r[0] for r in numbered.select("pass").distinct().collect()]:
        got = entries.where(F.col("pass") == p).select("q", "term", "weight").orderBy("q").toArrow()
        q = got["q"].to_numpy().astype(np.int64)
        low = int(q.min())
        job = _searcher(q - low, got["term"].to_numpy().view(np.uint64), got["weight"].to_numpy().astype(np.int64), int(q.max()) - low + 1, k)
        rows = index.blocks.drop("block", "dfs").mapInArrow(tidy(job), "q long, doc_id long, score long").withColumn("q", F.col("q") + low)
        found = rows if found is None else found.unionByName(rows)
    if found is None:
        found = spark.createDataFrame([], "q long, doc_id long, score long")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))).where(F.col("rank") <= k)
    return ranked.join(numbered.select("q", "item_id"), "q").select("item_id", "rank", "doc_id", "score")
