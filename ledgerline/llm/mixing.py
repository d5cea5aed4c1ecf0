"""Operator 5: sources mixed to target weights by weighted fair queueing.

Each source's documents are shuffled by a hash; a document's virtual finish time is its source's cumulative words up to and with it,
divided by the source's target. A source that must give more than it has goes round again, up to MAX_REPEATS times. All copies are ordered by
finish time and cut at the total budget, so each source ends within one document of its share.

Cumulative sums of a hot source are taken in hash buckets (many to a source), then over bucket totals. The cut is found by three
histograms of STEPS bins, each inside the bin of the last in which the budget is met; copies that end by time one always fit. Expressions
only.

Results: null text has size 0; null source is a source, the last one; sources without words have target 0. Rows that repeat a doc_id are
documents of their own. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import one_partition_of, saved

WEIGHTS = (1, 2, 3)
MAX_REPEATS = 3
STEPS = 4096


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """sk, source_size, target for rows (sk, source, source_size), one a source.

    The level at which weight times level, cut at MAX_REPEATS sizes, adds up to all words: sources in the order in which they reach
    their limit, the level if all before one are at it, and the highest that the one itself can bear.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    at = F.pmod(F.row_number().over(order) - 1, F.lit(len(WEIGHTS)))
    weighted = sizes.withColumn("weight", F.get(F.array(*map(F.lit, WEIGHTS)), at).cast("double"))
    limit = F.lit(float(MAX_REPEATS)) * F.col("source_size")
    everything, rest = Window.partitionBy(), Window.orderBy("reach", "sk").rowsBetween(0, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) - (F.sum(limit).over(everything) - F.sum(limit).over(rest))
    levels = weighted.withColumn("reach", limit / F.col("weight")).withColumn("level", left / F.sum("weight").over(rest))
    level = F.max(F.when(F.col("level") <= F.col("reach"), F.col("level"))).over(everything)
    return levels.select("sk", "source_size", F.least(limit, F.coalesce(level, F.lit(0.0)) * F.col("weight")).alias("target"))


def _source_key() -> Column:
    return F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), "source"))


def finish_times(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, u (hash of id and text), size, source_size, target, done (cumulative words of its source, itself included)."""
    rows = saved(docs.select("doc_id", _source_key().alias("sk"), "source", n_words(F.col("text")).alias("size"), F.xxhash64("doc_id", "text").alias("u")))
    sources = targets(rows.groupBy("sk").agg(F.max("source").alias("source"), F.sum("size").alias("source_size")))
    buckets = one_partition_of(rows.count(), 20_000, 256)
    rows = rows.withColumn("b", F.pmod("u", F.lit(buckets)))
    totals = rows.groupBy("sk", "b").agg(F.sum("size").alias("sum"))
    base = totals.withColumn("base", F.sum("sum").over(Window.partitionBy("sk").orderBy("b")) - F.col("sum")).drop("sum")
    inside = F.sum("size").over(Window.partitionBy("sk", "b").orderBy("u", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0))
    timed = rows.withColumn("inside", inside).join(saved(base.join(sources, "sk")), ["sk", "b"])
    return timed.select("doc_id", "u", "sk", "size", "source_size", "target", (F.col("base") + F.col("inside")).alias("done"))


def _times() -> list[Column]:
    return [(F.lit(p) * F.col("source_size") + F.col("done")) / F.col("target") for p in range(MAX_REPEATS)]


def cut_time(timed: DataFrame) -> float:
    """The time before which copies fit the budget: all words."""
    copies = timed.where("size > 0").select("size", F.explode(F.array(*_times())).alias("t"))
    total, taken, top = copies.agg(F.sum("size") / MAX_REPEATS, F.sum(F.when(F.col("t") <= 1, F.col("size"))), F.max("t")).first()
    lo, hi = 1.0, max(2.0, top or 0.0) * (1 + 1e-9)
    left = (total or 0) - (taken or 0)
    for _ in range(3):
        width = (hi - lo) / STEPS
        step = F.floor((F.col("t") - lo) / width)
        for r in copies.where((F.col("t") > 1) & (F.col("t") >= lo) & (F.col("t") < hi)).groupBy(step.alias("step")).agg(F.sum("size").alias("n")).orderBy("step").collect():
            if r.n > left:
                lo, hi = lo + r.step * width, lo + (r.step + 1) * width
                break
            left -= r.n
        else:
            return hi
    return lo


def mixture(docs: DataFrame) -> DataFrame:
    """finish_times with taken (words the mix takes, repeats counted) and copies."""
    timed = saved(finish_times(docs))
    cut = cut_time(timed)
    copies = sum((F.when((t <= 1) | (t < cut), 1).otherwise(0) for t in _times()), F.lit(0))
    return timed.withColumn("copies", F.when(F.col("size") > 0, copies).otherwise(0)).withColumn("taken", F.col("size") * F.col("copies"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """Pipeline stage: the copies that the mix takes, in the order of their finish times.

    Rows that repeat id, text and source share their copies evenly; what is left over goes to one of them.
    """
    plan = mixture(docs).where("copies > 0").groupBy("doc_id", "u", "sk").agg(F.sum("copies").alias("c"), F.count("*").alias("n"), F.min("done").alias("done"), F.first("source_size").alias("source_size"), F.first("target").alias("target"))
    plan = saved(plan.select(F.struct(F.col("doc_id").alias("i"), F.col("u").alias("h"), "sk").alias("__k"), "c", "n", F.array(*_times()).alias("__t")))
    keyed = docs.withColumn("__k", F.struct(F.col("doc_id").alias("i"), F.xxhash64("doc_id", "text").alias("h"), _source_key().alias("sk")))
    times = lambda n: F.explode(F.slice("__t", 1, n.cast("int")))
    every = keyed.join(plan.select("__k", times(F.floor(F.col("c") / F.col("n"))).alias("__t")), "__k")
    over = plan.where("c % n > 0").select("__k", times(F.col("c") % F.col("n")).alias("__t"))
    if not over.isEmpty():
        every = every.unionByName(keyed.join(plan.where("c % n > 0").select("__k"), "__k", "left_semi").dropDuplicates(["__k"]).join(over, "__k"))
    return every.repartitionByRange("__t").sortWithinPartitions("__t").select(*docs.columns)
