"""Lexical search against plain Python, on odd rows too, and the treap's invariants."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from ledgerline.llm import lexical as X

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
DOCS = "doc_id long, text string, term long, q int, score string, rank int, block long"
ITEMS = "item_id long, text string, doc_id long, weight int"


def terms(t):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items, k=10):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(terms(t))
    out = []
    for i, ts in wanted.items():
        scored = []
        for d, c in counts:
            m = 10 + 90 * sum(c.values()) * n_docs // n_terms if n_terms else 0
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in ts if c[t])
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(i, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(scored)[:k], 1)]
    return out


def corpus(n, seed=0):
    rng = np.random.default_rng(seed)
    size = rng.integers(0, 60, n)
    return [(i, " ".join(f"{'W' if j % 3 else 'w'}{int(rng.zipf(1.3)) % 4000}" for j in range(size[i]))) for i in range(n)]


ODD = [(9000, None), (9001, ""), (9002, " .,;\n"), (9003, "É é 中文 w1 w2"), (9003, "w1 w1 w2"), (None, "w1 w2 w3"), (9004, "w5 " * 30000), (9005, "x-ray_w7.w8")] + [(8000 + i, "same w1 w9 text") for i in range(40)]


def frames(spark, docs, items, parts):
    d = spark.createDataFrame([(*r, 1, 2, "s", 3, 4) for r in docs], DOCS).repartition(parts) if docs else spark.createDataFrame([], DOCS)
    return d, spark.createDataFrame([(*r, 5, 6) for r in items], ITEMS)


@pytest.mark.parametrize("parts,block", [(1, X.BLOCK_DOCS), (4, 100)])
def test_as_brute_force(spark, monkeypatch, parts, block):
    docs = corpus(600) + ODD
    items = [(i, t) for i, t in corpus(30, 1)] + [(1, "w1 same TEXT"), (50, None), (51, "nothing here"), (None, "w3 é"), (None, "w8"), (52, "same"), (53, "w5 w5 w7")]
    d, q = frames(spark, docs, items, parts)
    monkeypatch.setattr(X, "PASS_TERMS", 100)  # several passes
    index = X.build_index(d, block)
    assert index.n_docs == sum(bool(terms(t)) for _, t in docs) and index.blocks.selectExpr("sum(size(doc_ids)) n").first().n == len(docs)
    key = lambda r: tuple((x is None, x or 0) for x in r)
    got = [tuple(r) for r in X.search(index, q).select("item_id", "rank", "doc_id", "score").collect()]
    assert sorted(got, key=key) == sorted(brute(docs, items), key=key)


def test_empty(spark):
    d, q = frames(spark, [], [(1, "w1")], 1)
    assert X.search(X.build_index(d), q).count() == 0
    d, q = frames(spark, [(1, "w1"), (2, None)], [(1, None)], 1)
    assert X.search(X.build_index(d), q).count() == 0
    one = X.search(X.build_index(d), frames(spark, [], [(1, "w1")], 1)[1]).collect()
    assert [(r.item_id, r.rank, r.doc_id, r.score) for r in one] == brute([(1, "w1"), (2, None)], [(1, "w1")])


@pytest.mark.parametrize("n,rows,cols", [(1, 1, 1), (5, 1, 9), (300, 40, 10), (2000, 3000, 70)])
def test_treap_holds_each_point_once_and_in_heap_order(n, rows, cols):
    rng = np.random.default_rng(n)
    points = {(int(rng.integers(rows)), int(rng.integers(cols))): int(rng.integers(1, 50)) for _ in range(n)}
    r, c = (np.array([p[i] for p in points]) for i in (0, 1))
    t = X.Treap.of(r, c, np.array(list(points.values())))
    assert dict(zip(zip(t.row.tolist(), t.col.tolist()), t.value.tolist())) == points and len(t.row) == len(points)
    seen, todo = 0, [(0, 0, 0, 0)]
    while todo:
        cell, level, y, x = todo.pop()
        seen += 1
        size = t.levels - level
        assert t.row[cell] >> size == y and t.col[cell] >> size == x
        for q in range(4):
            kid = int(t.child(np.array([cell]), np.array([q]))[0])
            if kid >= 0:
                assert t.value[kid] <= t.value[cell]
                todo.append((kid, level + 1, 2 * y + (q >> 1), 2 * x + (q & 1)))
    assert seen == len(points)


def test_blocks_are_written_and_read_one_by_one(spark):
    """Before, a task's blocks were one row group, held whole when written and when read; statistics kept copies of each block's columns until the file was closed."""
    import pyarrow.parquet as pq

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, "2000")
    spark.conf.set(key, "100")
    try:
        index = X.build_index(frames(spark, corpus(600), [(1, "w1")], 1)[0], 100)
    finally:
        spark.conf.set(key, before)
    files = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in index.blocks.inputFiles()]
    groups = [m.row_group(i) for m in files for i in range(m.num_row_groups)]
    assert len(groups) == index.blocks.count() > len(files) and all(g.num_rows == 1 for g in groups)
    assert not any(g.column(i).is_stats_set for g in groups for i in range(g.num_columns))
