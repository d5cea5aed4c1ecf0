"""Merging page facts into one record a document; disagreement stays visible."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions import text as T
from ledgerline.operators.ordered import ordered_fold


def merge_fields(facts: DataFrame, keys: tuple[str, ...] = ("doc", "field")) -> DataFrame:
    """keys, value (null in conflict), conflict, n_values, candidates: one distinct value stands, more or a flagged one conflict.

    Values are compared by what they measure: 3 kW and 3000 W are one value, which shows as the least of its spellings.
    """
    spelled = facts.groupBy(*keys, "value").agg(F.max("flagged").alias("flagged"))
    out = T.with_comparable(spelled).groupBy(*keys).agg(F.sort_array(F.collect_list(F.when(F.col("value").isNotNull(), F.struct("__k", "value")))).alias("all"), F.coalesce(F.max("flagged"), F.lit(False)).alias("flagged"))
    # in order of key and value: the first of each key counts
    firsts = F.transform(F.filter("all", lambda x, i: (i == 0) | (x["__k"] != F.get("all", i - 1)["__k"])), lambda x: x["value"])
    out = out.select(*keys, F.sort_array(firsts).alias("candidates"), "flagged")
    conflict = (F.size("candidates") > 1) | F.col("flagged")
    return out.select(*keys, F.when(~conflict, F.get("candidates", F.lit(0))).alias("value"), conflict.alias("conflict"), F.size("candidates").alias("n_values"), F.array_join("candidates", "|").alias("candidates"))


def merge_alternatives(facts: DataFrame) -> DataFrame:
    """Distinct values by folded text, the first of each in order."""
    first = facts.withColumn("r", F.row_number().over(Window.partitionBy("doc", "field", F.lower("value")).orderBy("pos"))).where("r = 1")
    ordered = F.array_sort(F.collect_list(F.struct("pos", "value")))
    return first.groupBy("doc", "field").agg(F.array_join(F.transform(ordered, lambda x: x["value"]), "|").alias("alternatives"))


def match_items(items: DataFrame, keys: tuple[str, ...] = ("doc",)) -> DataFrame:
    """keys, value, nth, matched: items equal the same number of times in every reporting batch match nth with nth; others are flagged.

    items: keys, batch, value. A (value, batch) pair without items counts as zero.
    """
    counts = items.where(" and ".join(f"{k} is not null" for k in keys)).groupBy(*keys, "value", "batch").agg(F.count("*").alias("n"))
    # a batch counts where it comes first, so that items are grouped once and not joined with their own batches
    first = (F.row_number().over(Window.partitionBy(*keys, "batch").orderBy("value")) == 1) & F.col("batch").isNotNull()
    counts = counts.withColumn("first", first).withColumn("batches", F.count_if("first").over(Window.partitionBy(*keys)))
    per = counts.groupBy(*keys, "value").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.count("*").alias("seen"), F.max("batches").alias("batches"))
    judged = per.withColumn("matched", (F.col("lo") == F.col("hi")) & (F.col("seen") == F.col("batches")))
    return judged.select(*keys, "value", "matched", F.explode(F.sequence(F.lit(1), F.col("hi").cast("int"))).alias("nth"))


def match_charges(items: DataFrame) -> DataFrame:
    """As match_items, within the batches that list the label."""
    return match_items(items, ("doc", "label"))


def merge_lists(items: DataFrame, prefix: str = "G") -> DataFrame:
    """Matched and flagged items with running ids for each document."""
    order = Window.partitionBy("doc").orderBy("value", "nth")
    return match_items(items).withColumn("item_id", F.concat(F.lit(prefix), F.row_number().over(order).cast("string")))


def merge_quotes(facts: DataFrame, batches: DataFrame) -> DataFrame:
    """doc, complete, pages_done, n_failed, n_conflicts; a failed batch or skipped page makes a record incomplete."""
    ledger = batches.groupBy("doc").agg(F.count_if(F.col("status") == "ok").alias("n_ok"), F.count_if(F.col("status") != "ok").alias("n_failed"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("status") == "ok", F.col("pages")))))).alias("pages"))
    conflicts = merge_fields(facts).groupBy("doc").agg(F.count_if("conflict").alias("n_conflicts"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("conflict"), F.col("field")))), ",").alias("conflicts"))
    out = ledger.join(conflicts, "doc", "full_outer")
    return out.select("doc", F.coalesce(F.col("n_failed") == 0, F.lit(False)).alias("complete"), F.coalesce(F.size("pages"), F.lit(0)).alias("pages_done"), F.coalesce("n_failed", F.lit(0)).alias("n_failed"), F.coalesce("n_conflicts", F.lit(0)).alias("n_conflicts"), F.coalesce("conflicts", F.lit("")).alias("conflicts"))


def plan_batches(pages: DataFrame, max_pages: int = 5, limit: int = 20_000_000) -> DataFrame:
    """doc, page, batch (null: rejected, the page alone is over the limit): pages in order, greedy, at most max_pages and limit bytes each.

    A document's pages pass in order with its last batch as carry, so its size is no matter. Null bytes count as none.
    """

    def step(state: tuple, page: int, size: int) -> tuple[tuple, int | None]:
        batch, n, total = state
        if size > limit:
            return state, None
        if n and (n >= max_pages or total + size > limit):
            batch, n, total = batch + 1, 0, 0
        return (batch, n + 1, total + size), batch

    rows = pages.select("doc", "page", F.coalesce(F.col("bytes").cast("long"), F.lit(0)).alias("bytes"))
    return ordered_fold(rows, ["doc"], ["page", "bytes"], lambda doc: (1, 0, 0), step, "batch int").drop("bytes")
