"""Operator 7: near duplicates by HyperMinHash.

Each text's set of five-word shingles is hashed once. The top bits of a hash choose one of 128 buckets; a bucket keeps
its smallest hash as a compressed register: count of leading zeros (as an exponent) and 9 mantissa bits. A bucket that no
shingle falls into takes the minimum under a hash function of its own, marked by a flag bit, so that every register is
a fair min-hash whatever the size of the text. Bands of four registers deal texts into groups.

* Texts with equal sets form a class first; only class representatives (smallest doc_id) go on, so a group of exact
  copies, however large, is one row from there.
* In a band group each representative is paired with the group's leader only (a star, never all pairs). Pairs whose sizes or
  collision-corrected estimate are far under the threshold are dropped, the rest are confirmed on full shingle sets, which are built once a text.
* Groups that still hold more than one component are open. Among their members a link needs a shared shingle early in the order
  by rarity: two sets of n and m shingles share 3 (n + m) / 7 at least, and cannot if their first common shingle comes later. Members meet by
  such shingles only, those outside a shingle's largest component with those of other components. This loses no link of a band group, and its
  pairs do not grow with the square of a group, as members of a group that are not linked differ in rare shingles.
* Pairs are confirmed beside one copy of their first text for each of up to SALTS parts of its pairs, in a stream: no group is held in memory.

Results: doc_id is an integer (it is cast to long). Null text, or a text without words: no shingles, linked with nothing, kept. Null doc_id: never
linked, component_id null, kept. Rows that repeat a doc_id with other texts are texts of their own: what one is like is not linked with what another is
like. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, arrow_limits, byte_table, chunks, mix, row_key, run_hash, saved, tidy

SHINGLE = 5
REGISTERS = 128
BAND_ROWS = 4
MANTISSA = 9
THRESHOLD_PERCENT = 75
PRUNE_BELOW = 0.5
"""Estimates have a standard error of 0.04 at 0.75: by the normal law a true link is pruned about once in 10**10. Of the links of sf0.1 none is under 0.6."""
SALTS = 1024
BROADCAST_ROWS = 1_000_000
"""Ids, labels and least neighbours (8 to 40 bytes a row) go to all tasks up to so many rows; beyond, both sides meet in a shuffle join."""

_EMPTY = 0xFFFF


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    w = Words(data, offsets, byte_table())
    runs, out = run_hash(w.hash, k), []
    for d in range(w.n_docs):
        a, b = w.word_at[d], w.word_at[d + 1]
        if b - a >= k:
            out.append(np.unique(runs[a : b - k + 1]))
        else:
            out.append(run_hash(w.hash[a:b], b - a) if b > a else runs[:0])
    return out


def _code(v: np.ndarray) -> np.ndarray:
    """Exponent and mantissa bits of 57-bit values, in their order: 15 bits."""
    bits = np.maximum(v, np.uint64(1)).astype(np.float64).view(np.uint64) >> np.uint64(52 - MANTISSA)
    return (bits - np.uint64(1023 << MANTISSA)).astype(np.uint16)


_LOW = np.uint64((1 << 57) - 1)
_SEEDS = mix(np.arange(REGISTERS, dtype=np.uint64), 77)


def registers(x: np.ndarray) -> np.ndarray:
    """Compressed registers of a sorted, non-empty set of hashes."""
    reg = np.full(REGISTERS, _EMPTY, dtype=np.uint16)
    bucket = (x >> np.uint64(57)).astype(np.int64)
    first = np.flatnonzero(np.diff(bucket, prepend=-1))
    reg[bucket[first]] = _code(x[first] & _LOW)
    empty = np.flatnonzero(reg == _EMPTY)
    if len(empty):
        least = np.full(len(empty), 2**64 - 1, dtype=np.uint64)
        for i in range(0, len(x), 2048):
            np.minimum(least, mix(x[i : i + 2048, None] ^ _SEEDS[None, empty]).min(axis=0), out=least)
        reg[empty] = _code(least >> np.uint64(7)) | np.uint16(0x8000)
    return reg


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard estimates of register rows, less the share of registers expected to collide by chance."""
    ratio = n / np.maximum(m, 1)
    chance = 0.169919487159739 * 2.0**-MANTISSA * 4 * ratio / (1 + ratio) ** 2
    return ((a == b).mean(axis=1) - chance) / (1 - chance)


def signature(x: np.ndarray) -> bytes:
    """Equal for equal sets."""
    return np.array([len(x), mix(x, 1).sum(dtype=np.uint64), mix(x, 2).sum(dtype=np.uint64)], dtype=np.uint64).tobytes()


_SKETCH = "doc_id long, text_hash long, n_shingles long, sig binary, regs binary"


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, n, data, offsets in chunks(batch.column(2)):
            sizes, sigs, regs = [], [], []
            for x in shingle_sets(data, offsets):
                sizes.append(len(x))
                sigs.append(signature(x) if len(x) else None)
                regs.append(registers(x).tobytes() if len(x) else None)
            keys = [batch.column(c).slice(at, n) for c in (0, 1)]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(sizes, pa.int64()), pa.array(sigs, pa.binary()), pa.array(regs, pa.binary())], ["doc_id", "text_hash", "n_shingles", "sig", "regs"])


def sketches(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, text_hash, n_shingles, sig (equal for equal sets; null if empty), regs."""
    arrow_limits(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text").mapInArrow(tidy(_sketch), _SKETCH)


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n_bands = REGISTERS // BAND_ROWS
    seeds = mix(np.arange(n_bands, dtype=np.uint64), 5)
    for batch in batches:
        if batch.num_rows:
            four = np.frombuffer(b"".join(batch.column(2).to_pylist()), dtype=np.uint64).reshape(-1, n_bands)
            band = mix(mix(four) ^ seeds[None, :]).view(np.int64)
            rep, n = (np.repeat(batch.column(c).to_numpy(zero_copy_only=False), n_bands) for c in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(band.ravel()), pa.array(rep), pa.array(n)], ["band", "rep", "n"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, n, data, offsets in chunks(batch.column(1)):
            sets = shingle_sets(data, offsets)
            columns = [pa.array([signature(x) for x in sets], pa.binary()), pa.array([x.tobytes() for x in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), *columns], ["doc", "sig", "set"])


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, token for each shingle of (key, set)."""
    for batch in batches:
        for i in range(batch.num_rows):
            x = np.frombuffer(batch.column(1)[i].as_py(), dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), batch.column(0)[i].as_py(), dtype=np.int64)), pa.array(x)], ["key", "token"])


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, part, b, regs, set) sorted by a, part and b, where null b holds the set of a: the pairs that the estimate keeps and full sets confirm."""
    here, leaders = None, []
    for batch in batches:
        ids, parts, others, regs, sets = (batch.column(c).to_pylist() for c in range(5))
        found = []
        for a, part, b, r, x in zip(ids, parts, others, regs, sets, strict=True):
            if here != (a, part):
                here, leaders = (a, part), []
            r, x = np.frombuffer(r, dtype=np.uint16)[None], np.frombuffer(x, dtype=np.uint64)
            if b is None:
                leaders.append((r, x))
                continue
            for q, y in leaders:
                least, most = sorted((len(x), len(y)))
                if estimate(q, r, np.array([least]), np.array([most]))[0] >= PRUNE_BELOW:
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    if both and 100 * both >= THRESHOLD_PERCENT * (least + most - both):
                        found.append((a, b))
                        break
        yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in found], pa.int64()), pa.array([p[1] for p in found], pa.int64())], ["a", "b"])


def _small(df: DataFrame) -> DataFrame:
    """A saved table, marked for broadcast if it has at most BROADCAST_ROWS rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def components(edges: DataFrame) -> DataFrame:
    """(v, label) for each vertex of the undirected edges (a, b): label is the smallest vertex reachable.

    Large-star and small-star steps in turn until the edges stay as they are; only grouped minima and joins, each
    round written to the shared folder.
    """
    e = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            return e.select(F.col("a").alias("v"), F.col("b").alias("label")).unionByName(e.select(F.col("b").alias("v"), F.col("b").alias("label")).distinct())
        seen = now
        few = F.broadcast if now[0] <= BROADCAST_ROWS else (lambda df: df)
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(few(least), "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(few(low), "a").select(F.inline(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))))
        e = saved(small.where("a <> b").distinct())


def _links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the distinct pairs (a, b) that the estimate keeps and full sets confirm."""
    pairs = pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int").alias("part"))
    firsts = pairs.select("a", "part").distinct().join(sets.withColumnRenamed("rep", "a"), "a").select("a", "part", F.lit(None).cast("long").alias("b"), "regs", "set")
    members = pairs.join(sets.withColumnRenamed("rep", "b"), "b").select("a", "part", "b", "regs", "set")
    rows = firsts.unionByName(members).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    return saved(rows.mapInArrow(tidy(_confirmed), "a long, b long").distinct())


def _open_pairs(members: DataFrame, labels: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of members of open groups, of different components, that share a shingle early enough in the order by rarity."""
    labelled = members.join(_small(labels.withColumnRenamed("v", "rep")), "rep", "left").select("band", "rep", "n", F.coalesce("label", "rep").alias("label"))
    spans = saved(labelled.groupBy("band").agg(F.min("n").alias("least"), F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("band", "least"))
    # per vertex: its component, and the size of the smallest set that it may be paired with
    inside = saved(labelled.join(_small(spans), "band").groupBy("rep").agg(F.first("label").alias("label"), F.min("least").alias("least")))
    # a key for each set, as rows that repeat a doc_id may have several
    own = sets.join(_small(inside), "rep").withColumn("key", F.xxhash64("rep", "sig"))
    tokens = saved(own.select("key", "set").mapInArrow(tidy(_tokens), "key long, token long"))
    common = tokens.groupBy("token").agg(F.count("*").alias("df"))
    order = F.array_sort(F.collect_list(F.struct("df", "token"))).alias("order")
    ranked = tokens.join(common, "token").groupBy("key").agg(order).join(saved(own.select("key", "rep", "label", "least", (F.length("set") / 8).cast("long").alias("n"))), "key")
    at = F.transform("order", lambda x, i: F.struct(x["token"].alias("token"), i.cast("long").alias("at"), x["df"].alias("df")))
    reach = 3 * (F.col("n") + F.greatest("least", F.ceil(F.col("n") * 3 / 4)))
    early = F.filter(at, lambda x: (x["df"] > 1) & (7 * (F.col("n") - x["at"]) >= reach))
    postings = saved(ranked.select("rep", "n", "label", F.inline(early)).select("token", "rep", "n", "label", (F.col("n") - F.col("at")).alias("rest")))
    of_label = postings.groupBy("token", "label").agg(F.count("*").alias("c"))
    mixed = saved(of_label.groupBy("token").agg(F.max(F.struct("c", "label"))["label"].alias("main"), F.count("*").alias("k")).where("k > 1").select("token", "main"))
    live = saved(postings.join(_small(mixed), "token"))
    outside = live.where("label <> main").select("token", F.col("rep").alias("x"), F.col("n").alias("nx"), F.col("label").alias("lx"), F.col("rest").alias("rx"))
    meet = outside.join(live, "token").where("label <> lx and (label = main or rep > x) and 7 * least(rest, rx) >= 3 * (n + nx)")
    return saved(meet.select(F.least("x", "rep").alias("a"), F.greatest("x", "rep").alias("b")).distinct())


def _verdicts(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, text_hash, n_shingles, component_id, and whether it is its component's first text (of the smallest doc_id)."""
    rows = saved(sketches(docs))
    known = rows.where("sig is not null and doc_id is not null")
    classes = saved(known.groupBy("sig").agg(F.min("doc_id").alias("doc"), F.count("*").alias("copies"), F.first("n_shingles").alias("n"), F.first("regs").alias("regs")))
    # a vertex for each class: its smallest doc_id, or a hash where that id stands for several classes
    shared = saved(classes.groupBy("doc").agg(F.min("sig").alias("first"), F.count("*").alias("k")).where("k > 1").select("doc", "first"))
    unique = shared.isEmpty()
    classes = classes.withColumn("rep", F.col("doc")) if unique else saved(classes.join(_small(shared), "doc", "left").withColumn("rep", F.when(F.col("sig") != F.col("first"), F.xxhash64("doc", "sig")).otherwise(F.col("doc"))).drop("first"))
    bands = classes.select("rep", "n", "regs").mapInArrow(tidy(_bands), "band long, rep long, n long")
    groups = saved(bands.groupBy("band").agg(F.min(F.struct("rep", "n")).alias("lead"), F.max("rep").alias("last")).where("lead.rep < last").select("band", F.col("lead.rep").alias("leader"), F.col("lead.n").alias("m")))
    members = saved(bands.join(groups, "band"))
    ids = saved(members.select("rep").distinct())
    ids = ids.withColumnRenamed("rep", "doc") if unique else saved(classes.join(_small(ids), "rep").select("doc").distinct())
    texts = docs.select(F.col("doc_id").cast("long").alias("doc"), "text").join(_small(ids), "doc", "left_semi").where("text is not null")
    sets = texts.mapInArrow(tidy(_sets), "doc long, sig binary, set binary").where("length(set) > 0").dropDuplicates(["doc", "sig"])
    sets = saved(sets.join(classes.select("doc", "rep", "sig", "regs"), ["doc", "sig"]).drop("doc"))
    pairs = members.where("rep <> leader and 4 * least(n, m) >= 3 * greatest(n, m)").select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct()
    labels = saved(components(_links(pairs, sets)))
    more = _links(_open_pairs(members, labels, sets), sets)
    if not more.isEmpty():
        links = more.unionByName(labels.select(F.col("v").alias("a"), F.col("label").alias("b")))
        labels = saved(components(links))
    if unique:
        moved = labels.where("v <> label").select(F.col("v").alias("rep"), F.col("label").alias("component_id"), F.lit(None).cast("binary").alias("main"))
    else:
        # vertices are no doc_ids here: each component's first text names it
        placed = saved(classes.select("rep", "doc", "sig").join(labels.withColumnRenamed("v", "rep"), "rep"))
        firsts = placed.groupBy("label").agg(F.min(F.struct("doc", "sig")).alias("top")).select("label", F.col("top.doc").alias("component_id"), F.col("top.sig").alias("main"))
        moved = placed.join(firsts, "label").where("sig <> main").select("rep", "component_id", "main")
    of_class = classes.select("sig", "rep", "doc", "copies").join(_small(saved(moved)), "rep", "left").where("copies > 1 or component_id is not null")
    of_class = saved(of_class.select("sig", F.coalesce("component_id", "doc").alias("component_id"), "main"))
    out = rows.select("doc_id", "text_hash", "n_shingles", "sig").join(_small(of_class), "sig", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    first = F.coalesce(F.col("doc_id") == component, F.lit(True)) & F.coalesce(F.col("sig") == F.col("main"), F.lit(True))
    return out.select("doc_id", "text_hash", "n_shingles", component.alias("component_id"), first.alias("first"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links), kept: one row per row of docs."""
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    return _verdicts(docs).select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """Pipeline stage: docs without the near copies; of rows that repeat a kept doc_id and text, nulls included, one stays.

    A row goes by its doc_id and its text: another text under the doc_id of a copy stays.
    """
    gone = saved(_verdicts(docs).where("not first").select(F.col("doc_id").alias("__gone"), F.col("text_hash").alias("__hash")).distinct())
    copy = (docs["doc_id"].cast("long") == F.col("__gone")) & (F.xxhash64(docs["text"]) == F.col("__hash"))
    left = docs.join(_small(gone), copy, "left_anti").withColumn("__k", row_key())
    again = saved(left.groupBy("__k").count().where("count > 1").select("__k"))
    if again.isEmpty():
        return left.drop("__k")
    again = _small(again)
    once = left.join(again, left["__k"].eqNullSafe(again["__k"]), "left_semi").dropDuplicates(["__k"])
    return left.join(again, left["__k"].eqNullSafe(again["__k"]), "left_anti").unionByName(once).drop("__k")
