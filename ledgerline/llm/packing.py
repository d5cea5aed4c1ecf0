"""Operator 13: token sequences packed by the linear grouping scheme.

Tasks encode texts and cut what is longer than `capacity` into pieces; each piece is counted in its task among those of its length. Lengths
are whole numbers up to the capacity, so all that packing has to know is a histogram of so many counters, whatever the number of documents; the
driver plans on it:

1. Pieces over the capacity / SMALL are large. In falling order they make GROUPS groups of equal cardinality, each rounded up to its largest length.
2. The few sizes are packed by configurations: a linear program over all ways to fill a sequence, by column generation; multiplicities are rounded down.
3. Actual pieces stand in for the rounded ones, in falling order, so that a configuration splits into runs of sequences with equal actual lengths.
   Runs with more room left than a bound are taken apart again; of the bounds ROOM the one with the fewest sequences in the end counts.
4. What is left, large ones of the rounding first, then the small ones, goes by falling length into the sequence with the least room that fits
   it (best fit), or opens a new one. Equal pieces move together, so the work is by lengths and not by pieces.

The plan says of each length which ranks go where. A piece's rank is its place in its task and length plus the counts of the tasks before; no
sort or shuffle of the pieces is needed.

Results: a null text is empty, has only the end id and is packed. Null and repeated doc_ids are documents of their own; doc_ids are cast to long.
An empty table gives no row. Other columns are ignored. Reruns on the same files agree.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_limits, saved, tidy
from .token_files import CACHE_BYTES, SLICE_BYTES, _slices, encoder

CAPACITY = 1024
END_ID = 2
GROUPS = 96
SMALL = 8
"""Pieces over an eighth of the capacity are grouped."""
ROOM = (1024, 64, 32, 16, 8, 4, 2, 1, 0)
"""Room that a configuration's sequences may have left when they go into step 4; fuller ones only are kept, others are taken apart. Each bound is tried."""
MAX_COLUMNS = 4000
"""Columns that the linear program may generate; it may end before its optimum, the plan is then whole all the same."""
BROADCAST_BASES = 1_000_000

_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"


# ---- pieces -------------------------------------------------------------------------------------------------------


def _places(lengths: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Place of each piece among those of its length; `seen` counts the earlier ones and is moved on."""
    order = np.argsort(lengths, kind="stable")
    ordered = lengths[order]
    out = np.empty(len(lengths), dtype=np.int64)
    out[order] = np.arange(len(lengths)) - np.searchsorted(ordered, ordered) + seen[ordered]
    seen += np.bincount(lengths, minlength=len(seen))
    return out


def _cutter(path: str, capacity: int, end_id: int, keep_ids: bool, cache_bytes: int, slice_bytes: int) -> Callable:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen, encode = TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64), encoder(path, cache_bytes).encode
        for batch in batches:
            size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            for a, b in _slices(size, slice_bytes):
                ids, n = encode(batch.column(1).slice(a, b - a))
                ends = np.cumsum(n)
                ids[ends - 1] = end_id
                k = -(-n // capacity)
                doc = np.repeat(np.arange(len(n)), k)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(k) - k, k)
                first = (n - capacity * (k - 1))[doc]
                start = np.where(piece == 0, 0, first + capacity * (piece - 1))
                length = np.where(piece == 0, first, capacity)
                begin = (ends - n)[doc] + start
                raw = memoryview(np.ascontiguousarray(ids, dtype="<u4")).cast("B")
                crc = [zlib.crc32(raw[x:y]) for x, y in zip((4 * begin).tolist(), (4 * (begin + length)).tolist(), strict=True)]
                cols = [batch.column(0).slice(a, b - a).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(np.full(len(doc), part, dtype=np.int32)), pa.array(_places(length, seen))]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"]
                if keep_ids:  # pieces follow each other in the ids
                    cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate([begin, ends[-1:]]).astype(np.int32)), pa.array(ids.astype(np.int32, copy=False))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    return cut


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False, cache_bytes: int = CACHE_BYTES, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """The pieces of docs, saved: doc_id, piece, start, length, ids_crc32, part and nth (place among its task's pieces of this length), and ids if they are kept."""
    arrow_limits(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return saved(rows.mapInArrow(tidy(_cutter(tokenizer, capacity, end_id, keep_ids, cache_bytes, slice_bytes)), _PIECE + (", ids array<int>" if keep_ids else "")))


# ---- plan ---------------------------------------------------------------------------------------------------------


def linear_groups(counts: np.ndarray, least: int, groups: int) -> list[list[tuple[int, int]]]:
    """Groups of (length, how many), of equal cardinality, from the longest down to `least`; as many groups as lengths if those are fewer."""
    lengths = [s for s in range(len(counts) - 1, least - 1, -1) if counts[s]]
    if len(lengths) <= groups:
        return [[(s, int(counts[s]))] for s in lengths]
    per, out, room = -(-sum(int(counts[s]) for s in lengths) // groups), [], 0
    for s in lengths:
        left = int(counts[s])
        while left:
            if not room:
                out.append([])
                room = per
            n = min(left, room)
            out[-1].append((s, n))
            left, room = left - n, room - n
    merged: list[list[tuple[int, int]]] = []
    for g in out:  # groups that round to one size are one size
        if merged and merged[-1][0][0] == g[0][0]:
            merged[-1] += g
        else:
            merged.append(g)
    return merged


def best_configuration(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable way to fill a sequence: (value, how many of each size)."""
    reach = np.arange(capacity + 1) - sizes[:, None]
    reach[reach < 0] = capacity + 1
    value, steps = np.append(np.zeros(capacity + 1), -np.inf), []
    for _ in range(capacity // int(sizes.min())):
        more = value[reach] + worth[:, None]
        pick = more.argmax(axis=0)
        gain = more[pick, np.arange(capacity + 1)]
        better = gain > value[:-1] + 1e-12
        if not better.any():
            break
        steps.append(np.where(better, pick, -1))
        value = np.append(np.where(better, gain, value[:-1]), -np.inf)
    many, room = np.zeros(len(sizes)), capacity
    for pick in reversed(steps):
        if pick[room] >= 0:
            many[pick[room]] += 1
            room -= int(sizes[pick[room]])
    return float(value[capacity]), many


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, float]]:
    """(how many of each size, how often): a basic solution of the fewest sequences, fractions allowed, that hold the demand."""
    basis = np.diag((capacity // sizes).astype(float))
    inverse, x = np.diag(1 / np.diag(basis)), demand / np.diag(basis)
    for turn in range(MAX_COLUMNS):
        value, column = best_configuration(sizes, inverse.sum(axis=0), capacity)
        if value <= 1 + 1e-9:
            break
        move = inverse @ column
        steps = np.where(move > 1e-9, np.maximum(x, 0) / np.where(move > 1e-9, move, 1), np.inf)
        out = int(steps.argmin())
        basis[:, out] = column
        if turn % 64 == 63:
            inverse = np.linalg.inv(basis)
            x = inverse @ demand
        else:
            x -= steps[out] * move
            x[out] = steps[out]
            row = inverse[out] / move[out]
            inverse -= np.outer(move, row)
            inverse[out] = row
    return [(basis[:, i].astype(int), float(x[i])) for i in range(len(sizes)) if x[i] > 0]


def plan(counts: np.ndarray, capacity: int = CAPACITY, groups: int = GROUPS) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in order, number of such sequences) for counts[length] pieces of each length."""
    found: list[tuple[tuple[int, ...], int]] = []
    left = counts.astype(np.int64).copy()
    left[capacity] = 0
    if counts[capacity]:
        found.append(((capacity,), int(counts[capacity])))
    grouped = linear_groups(left, capacity // SMALL + 1, groups)
    if grouped:
        sizes, demand = np.array([g[0][0] for g in grouped]), np.array([float(sum(n for _, n in g)) for g in grouped])
        queues = [list(reversed(g)) for g in grouped]  # the longest last
        for config, often in sorted(configurations(sizes, demand, capacity), key=lambda c: (-c[1], c[0].tolist())):
            times = int(often + 1e-6)
            runs = []  # one a place of the configuration: (length or 0, how many sequences)
            for g in np.repeat(np.arange(len(sizes)), config).tolist():
                run, need = [], times
                while need and queues[g]:
                    s, n = queues[g].pop()
                    take = min(n, need)
                    run.append((s, take))
                    left[s] -= take
                    need -= take
                    if n > take:
                        queues[g].append((s, n - take))
                runs.append([*run, (0, need)] if need else run)
            ends = sorted({int(e) for r in runs for e in np.cumsum([n for _, n in r])}) if times else []
            before = 0
            for end in ends:
                lengths = []
                for r in runs:
                    at = int(np.searchsorted(np.cumsum([n for _, n in r]), before, side="right"))
                    lengths.append(r[at][0])
                found.append((tuple(s for s in lengths if s), end - before))
                before = end
    found = [f for f in found if f[0] and f[1]]
    tries = []
    for most in ROOM:
        kept, again = [], left.copy()
        for lengths, n in found:
            if capacity - sum(lengths) <= most:
                kept.append((lengths, n))
            else:
                np.add.at(again, list(lengths), n)
        tries.append(best_fit(kept, again, capacity))
    return min(tries, key=lambda t: sum(n for _, n in t))


def best_fit(found: list[tuple[tuple[int, ...], int]], left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """`found` with the pieces of `left` put, by falling length, where the least room fits them, or into new sequences."""
    room: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for lengths, n in found:
        room.setdefault(capacity - sum(lengths), []).append((lengths, n))
    for s in range(len(left) - 1, 0, -1):
        many = int(left[s])
        for r in sorted(x for x in room if x >= s):
            put = r // s  # a sequence takes equal pieces until none fits: its room stays the least
            bins, kept = room.pop(r), []
            for lengths, n in bins:
                full = min(n, many // put)
                if full:
                    room.setdefault(r - put * s, []).append((lengths + (s,) * put, full))
                    many -= full * put
                if n > full and 0 < many < put:
                    room.setdefault(r - many * s, []).append((lengths + (s,) * many, 1))
                    full, many = full + 1, 0
                if n > full:
                    kept.append((lengths, n - full))
            if kept:
                room.setdefault(r, []).extend(kept)
            if not many:
                break
        if many:
            put = capacity // s
            if many // put:
                room.setdefault(capacity - put * s, []).append(((s,) * put, many // put))
            if many % put:
                room.setdefault(capacity - many % put * s, []).append(((s,) * (many % put), 1))
    merged: dict[tuple[int, ...], int] = {}
    for bins in room.values():
        for lengths, n in bins:
            merged[lengths] = merged.get(lengths, 0) + n
    return sorted(merged.items(), reverse=True)


def slots(planned: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, ...]:
    """(length, first rank, first sequence, offset) of each place of the plan, by length and first rank: ranks from the first on go there, one a sequence."""
    rows, ranks, sequence = [], {}, 0
    for lengths, n in planned:
        offset = 0
        for s in lengths:
            rows.append((s, ranks.get(s, 0), sequence, offset))
            ranks[s] = ranks.get(s, 0) + n
            offset += s
        sequence += n
    return tuple(np.array(c, dtype=np.int64) for c in zip(*sorted(rows), strict=True)) if rows else (np.zeros(0, np.int64),) * 4


_RANKS = 2**50


def _placer(length: np.ndarray, first: np.ndarray, sequence: np.ndarray, offset: np.ndarray) -> Callable:
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = length * _RANKS + first
        for batch in batches:
            table = pa.Table.from_batches([batch])
            size, rank = table["length"].to_numpy(), table["rank"].to_numpy()
            at = np.searchsorted(keys, size * _RANKS + rank, side="right") - 1
            table = table.drop_columns(["rank"]).append_column("sequence_id", pa.array(sequence[at] + rank - first[at])).append_column("offset", pa.array(offset[at]))
            yield from table.to_batches()

    return place


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, groups: int = GROUPS, keep_ids: bool = False, cache_bytes: int = CACHE_BYTES, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of each piece (and ids, if they are kept): pieces of up to capacity ids in few sequences of that capacity."""
    rows = pieces(docs, tokenizer, capacity, end_id, keep_ids, cache_bytes, slice_bytes)
    per = saved(rows.groupBy("part", "length").agg(F.count("*").alias("n")))
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for r in per.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `capacity` rows
        counts[r.length] = r.n
    bases = per.select("part", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("base"))
    if per.count() <= BROADCAST_BASES:
        bases = F.broadcast(bases)
    ranked = rows.join(bases, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else []), (F.col("base") + F.col("nth")).alias("rank"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, " + "ids array<int>, " * keep_ids + "sequence_id long, offset long"
    return ranked.mapInArrow(tidy(_placer(*slots(plan(counts, capacity, groups)))), schema)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids: the pieces of each sequence one after the other, from pack(keep_ids=True)."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(ordered, lambda x: x["ids"])).alias("ids"))
