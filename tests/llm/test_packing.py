"""Packing against the tokenizers library, the rules of a packing, and plain best-fit decreasing."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from ledgerline.llm import packing
from ledgerline.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, piece int, part long, length string"
WORDS = "the of and a quick brown fox café naïve 12 x".split()


def text(n, seed):
    rng = np.random.default_rng(seed)
    return " ".join(WORDS[i] for i in rng.integers(0, len(WORDS), n))


TEXTS = [None, "", "one", text(5000, 1), text(1023, 2), text(30, 3), "\n\n a  b\t", text(700, 4), text(20000, 5), "<|endoftext|>"] + [text(int(n), 10 + i) for i, n in enumerate(np.random.default_rng(0).integers(1, 1500, 150))]


def frame(spark, texts, parts=3):
    more = [(3, texts[3], 1, 2, "x"), (None, "no id", 0, 0, None)] if texts else []
    return spark.createDataFrame([(i, t, 1, 2, "x") for i, t in enumerate(texts)] + more, SCHEMA).repartition(parts)


@pytest.mark.parametrize("parts", [1, 5])
def test_pieces_and_places(spark, parts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    t.encode_special_tokens = True
    rows = packing.pack(frame(spark, TEXTS, parts), tokenizer_path(), keep_ids=True).collect()
    at = defaultdict(list)
    for r in rows:
        at[r.doc_id].append(r)
    for i, x in enumerate(TEXTS):
        ids = t.encode(x or "", add_special_tokens=False).ids + [2]
        k = -(-len(ids) // 1024)
        first = len(ids) - 1024 * (k - 1)
        want = [(p, 0 if p == 0 else first + 1024 * (p - 1), first if p == 0 else 1024) for p in range(k)]
        got = sorted((r.piece, r.start, r.length) for r in at[i])
        assert got == sorted(want * (2 if i == 3 else 1))
        for r in at[i]:
            own = ids[r.start : r.start + r.length]
            assert r.ids == own and r.ids_crc32 == zlib.crc32(np.array(own, dtype="<u4").tobytes())
    assert len(at[None]) == 1
    whole(rows)
    packed = spark.createDataFrame(rows)
    got = {r.sequence_id: r.ids for r in packing.sequences(packed).collect()}
    for r in rows:
        assert got[r.sequence_id][r.offset : r.offset + r.length] == r.ids
    assert sum(map(len, got.values())) == sum(r.length for r in rows)


def whole(rows, capacity=1024):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        end = 0
        for o, n in sorted(places):
            assert o == end
            end += n
        assert end <= capacity


def best_fit_decreasing(counts, capacity):
    rooms = Counter()
    for s in range(len(counts) - 1, 0, -1):
        for _ in range(int(counts[s])):
            fit = [r for r, n in rooms.items() if n and r >= s]
            r = min(fit) if fit else capacity
            if fit:
                rooms[r] -= 1
            rooms[r - s] += 1
    return sum(rooms.values())


def test_plans_are_whole_and_few():
    for seed in range(12):
        rng = np.random.default_rng(seed)
        capacity = int(rng.choice([16, 64, 200, 1024]))
        counts = np.zeros(capacity + 1, dtype=np.int64)
        kind = seed % 4
        lengths = rng.integers(1, capacity + 1, 2000) if kind == 0 else rng.integers(capacity // 3, capacity // 2, 800) if kind == 1 else np.minimum(capacity, 1 + rng.geometric(8 / capacity, 3000)) if kind == 2 else np.full(777, capacity // 3 + 1)
        np.add.at(counts, lengths, 1)
        planned = packing.plan(counts, capacity, groups=24)
        again = np.zeros_like(counts)
        for s, n in planned:
            assert sum(s) <= capacity and n > 0
            np.add.at(again, list(s), n)
        assert (again == counts).all()
        n = sum(n for _, n in planned)
        assert -(-int((counts * np.arange(capacity + 1)).sum()) // capacity) <= n <= best_fit_decreasing(counts, capacity)
        length, first, sequence, offset = packing.slots(planned)
        assert len(length) == sum(len(s) for s, _ in planned) and (np.diff(length * packing._RANKS + first) > 0).all()


def test_configurations_meet_the_optimum():
    """Sizes whose best packing best fit misses: two of a third and a bit with one of the rest."""
    counts = np.zeros(101, dtype=np.int64)
    counts[[51, 27, 26, 23]] = 600
    counts[26] = 600
    found = packing.configurations(np.array([51, 27, 26, 23]), np.full(4, 600.0), 100)
    assert abs(sum(x for _, x in found) - 600 * 127 / 100) <= 40 and all((c * [51, 27, 26, 23]).sum() <= 100 for c, _ in found)
    held = sum(c * x for c, x in found)
    assert (held >= 600 - 1e-6).all()


def test_empty(spark):
    assert packing.pack(frame(spark, []), tokenizer_path()).count() == 0
    none = spark.createDataFrame([(1, None), (2, None)], "doc_id long, text string")
    assert [(r.length, r.ids_crc32) for r in packing.pack(none, tokenizer_path()).collect()] == [(1, zlib.crc32(b"\2\0\0\0"))] * 2
