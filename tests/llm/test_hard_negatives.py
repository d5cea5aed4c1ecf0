"""Hard negatives against plain Python, on odd rows too."""

import math

import numpy as np
import pytest

from ledgerline.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<float>, label int, id long, vec string, a long, score long, p int"


def brute(rows, every):
    use = []
    for i, v, label in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) or abs(x) >= H.COMPONENT for x in v):
            continue
        use.append((i, [math.floor(256 * float(x)) for x in v], (label + 1) % 10 if i is not None and i % 7 == 0 else label))
    dot = lambda x, y: sum(p * q for p, q in zip(x, y))
    order = lambda s: (-s[0], s[1] is None, s[1] or 0)
    out = []
    for i, v, label in use:
        if i is None or i % every:
            continue
        scored = [(dot(v, w), j, m) for j, w, m in use if j != i]
        for s, j, _ in sorted([x for x in scored if x[2] == label], key=order)[:5]:
            fit = sorted([x for x in scored if x[2] != label and 80 * s <= 100 * x[0] <= 100 * s], key=order)[:5]
            out += [(i, j, r, k, s, t) for r, (t, k, _) in enumerate(fit, 1)]
    return out


def run(spark, rows, every=100, parts=3):
    df = spark.createDataFrame([(*r, 7, "x", 1, 2, 3) for r in rows], SCHEMA).repartition(parts)
    return [tuple(r) for r in H.mined(df, every).collect()]


key = lambda r: tuple((x is None, x or 0) for x in r)


@pytest.mark.parametrize("parts", [1, 5])
def test_as_brute_force(spark, parts):
    rng = np.random.default_rng(3)
    f = lambda n, k: [float(np.float32(x)) for x in rng.normal(0, 0.2, n) * k]
    rows = [(i, f(16, 1), int(rng.integers(0, 4))) for i in range(400)]
    rows += [(400 + i, f(int(rng.integers(0, 30)), 3), i % 4) for i in range(40)]  # of all lengths
    same = f(16, 2)
    rows += [(500 + i, same, i % 4) for i in range(60)]  # many ties
    rows += [(600, None, 1), (700, [1.0, None], 1), (701, [math.nan], 2), (800, [math.inf, 1.0], 2), (900, f(16, 1), None), (1000, [], 1), (1100, [0.0] * 16, 2), (None, f(16, 3), 3), (None, f(16, 3), 2), (1200, [float(2**18)], 1), (1300, [-0.001] * 16, 3), (3, f(16, 2), 1), (1400, [float(2**17 - 1)] * 3, 2)]
    want = brute([(i, v and [x if x is None else float(np.float32(x)) for x in v], c) for i, v, c in rows], 20)
    assert len(want) > 50
    assert sorted(run(spark, rows, 20, parts), key=key) == sorted(want, key=key)


def test_empty(spark):
    assert run(spark, []) == [] and run(spark, [(100, [1.0], 1)]) == []


def test_scores_are_inner_products():
    rng = np.random.default_rng(1)
    for low, high, kind in ((-200, 200, np.int32), (-(2**25), 2**25, np.int64), (0, 2, np.int64), (-1, 1, np.int64)):
        a, b = rng.integers(low, high, (5, 24)), rng.integers(low, high, (70, 24))
        assert (H.scores(H.subset_sums(a, kind), H.bit_planes(b)) == b @ a.T).all()
