"""Operator 1: quality rules as a ledger of failure bits.

Every rule is evaluated once for every text; the ledger keeps its measurements and one 64-bit field of failure bits. A policy is a
named, versioned set of rules, so applying or changing one is a bitwise test on the ledger, and an ablation (what each
rule alone decides) is one pass of bitwise sums. Expressions only: no shuffle, no Python on the executors. The ledger is written to the shared
folder: a filter on it would else be pushed below it and evaluate its array expressions once an element.

Windows of eight words are compared by 64-bit hashes within a text. Results: a null text has no words and fails too_few_words. Repeated
rows get equal results; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved

SPACES = " \t\n\x0b\x0c\r"
SPLIT = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 8

RULES: dict[str, Column] = {}
"""Rule name to the condition under which a row of measurements fails; a rule's bit is its place here."""


def _rules() -> dict[str, Column]:
    if not RULES:
        n = F.col("n_words")
        RULES["too_few_words"] = n < 20
        RULES["repeated_windows"] = 100 * F.col("n_repeat_words") > 30 * n
        RULES["many_symbols"] = 10 * F.col("n_symbols") > 3 * n
        RULES["repeated_lines"] = 2 * F.col("n_dup_lines") > F.col("n_lines")
        RULES["odd_word_length"] = (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 25 * n)
        RULES["mostly_capitals"] = 2 * F.col("n_upper_words") > n
        RULES["few_distinct_words"] = 20 * F.col("n_distinct_words") < n
    return RULES


POLICIES = {
    "base-1": ("too_few_words", "repeated_windows"),
    "web-1": ("too_few_words", "repeated_windows", "many_symbols", "repeated_lines", "mostly_capitals"),
    "web-2": ("too_few_words", "repeated_windows", "many_symbols", "repeated_lines", "odd_word_length", "mostly_capitals", "few_distinct_words"),
}


def mask(policy: str) -> int:
    names = list(_rules())
    return sum(1 << names.index(r) for r in POLICIES[policy])


def ledger(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, the measurements, and fail_bits; stored, so that policies and filters read it and evaluate no rule again."""
    text = F.coalesce("text", F.lit(""))
    words = F.array_remove(F.split(text, SPLIT), "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACES))) > 0)
    bare = F.translate(text, SPACES, "")
    a = docs.select("doc_id", words.alias("w"), lines.alias("l"), bare.alias("bare"))
    b = a.select(
        "doc_id",
        F.size("w").alias("n"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("h"),
        F.size(F.filter("w", lambda x: (F.upper(x) == x) & (F.lower(x) != x))).cast("long").alias("n_upper_words"),
        F.size("l").cast("long").alias("n_lines"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        F.length("bare").cast("long").alias("word_chars"),
        (F.length("bare") - F.length(F.translate("bare", SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )
    windows = F.transform(F.sequence(F.lit(0), F.col("n") - WINDOW), lambda i: F.xxhash64(*[F.get("h", i + k) for k in range(WINDOW)]))
    c = b.withColumn("g", F.when(F.col("n") >= WINDOW, windows)).withColumn("n_distinct_words", F.size(F.array_distinct("h")).cast("long")).drop("h")
    some = F.size(F.array_distinct("g")) < F.size("g")
    placed = F.array_sort(F.transform("g", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    d = c.withColumn("s", F.when(some, placed)).drop("g")
    twice = F.transform("s", lambda x, j: F.when((F.get("s", j - 1)["x"] == x["x"]) | (F.get("s", j + 1)["x"] == x["x"]), x["i"]))
    e = d.withColumn("p", F.array_sort(F.array_compact(twice))).drop("s")
    covered = F.aggregate(F.zip_with("p", F.slice("p", 2, F.greatest(F.size("p"), F.lit(1))), lambda x, y: F.coalesce(F.least(y - x, F.lit(WINDOW)), F.lit(WINDOW))), F.lit(0), lambda t, x: t + x)
    f = e.select("doc_id", F.col("n").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"), "n_lines", "n_upper_words", "n_distinct_words")
    bits = sum((F.when(bad, F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, bad in enumerate(_rules().values())), F.lit(0).cast("long"))
    return saved(f.withColumn("fail_bits", bits))


def passes(policy: str) -> Column:
    return F.col("fail_bits").bitwiseAND(F.lit(mask(policy)).cast("long")) == 0


def verdicts(docs: DataFrame, policy: str = "web-2") -> DataFrame:
    """The ledger with base_failed and kept, the policy's verdict."""
    base_failed = ~passes("base-1")
    return ledger(docs).withColumns({"base_failed": base_failed, "kept": ~base_failed & passes(policy)})


def ablations(rows: DataFrame, policy: str = "web-2") -> DataFrame:
    """One row a rule of the policy, from a ledger: texts it fails, texts that only it fails, texts kept with and without it."""
    m, names = mask(policy), list(_rules())
    failed = F.col("fail_bits").bitwiseAND(F.lit(m).cast("long"))
    sums = {"kept": F.count_if(failed == 0)}
    for r in POLICIES[policy]:
        bit = 1 << names.index(r)
        sums |= {f"f_{r}": F.count_if(failed.bitwiseAND(F.lit(bit).cast("long")) != 0), f"o_{r}": F.count_if(failed == bit)}
    one = rows.agg(*[c.alias(k) for k, c in sums.items()])
    return one.select("kept", F.inline(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"f_{r}").alias("n_failed"), F.col(f"o_{r}").alias("n_only")) for r in POLICIES[policy]]))).select("rule", "n_failed", "n_only", F.col("kept").alias("n_kept"), (F.col("kept") + F.col("n_only")).alias("n_kept_without"))
