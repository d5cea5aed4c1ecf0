"""Scores of readings against labels, their summaries, scenarios, and an independent recompute."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions import text as T

BUCKETS = (0, 50, 60, 70, 80, 90, 95)


def score_fields(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """doc, field, status over all fields of pred (value, conflict) and truth (value; null = not stated), any number of rows a field.

    A field is correct if its values and the label's are the same ones equally often, by what they measure (3 kW is 3000 W), in any order. A null value says nothing;
    a conflict on any row is one of the field.
    """
    rows = lambda df, read: df.select("doc", "field", "value", F.col("conflict") if read else F.lit(None).cast("boolean").alias("conflict"), F.lit(read).alias("read"))
    return score_rows(rows(pred, True).unionByName(rows(truth, False)))


def score_rows(rows: DataFrame) -> DataFrame:
    """score_fields of readings and labels in one table: doc, field, value, conflict, read (false: a label). Each row is read once and meets the others of its field in one group."""
    keys = lambda side: F.array_sort(F.collect_list(F.when(side, F.col("__k"))))
    label = ~F.col("read")
    # a null document or field is no other's
    apart = F.when(F.col("doc").isNull() | F.col("field").isNull(), F.col("read"))
    j = T.with_comparable(rows.withColumn("__apart", apart)).groupBy("doc", "field", "__apart").agg(keys(F.col("read")).alias("__said"), keys(label).alias("__stated"), F.max(label).alias("__labelled"), F.max(F.when(F.col("read"), F.col("conflict"))).alias("conflict"))
    j = j.withColumn("__stated", F.when(F.col("__labelled"), F.col("__stated")))
    conflict, has, stated = F.coalesce("conflict", F.lit(False)), F.coalesce(F.size("__said") > 0, F.lit(False)), F.size("__stated") > 0
    status = (
        F.when(F.col("__stated").isNull(), "not_labelled").when(~stated, F.when(has | conflict, "falsely_populated").otherwise("abstained"))
        .when(conflict, "conflict_flagged").when(~has, "missing").when(F.col("__said") == F.col("__stated"), "correct").otherwise("wrong")
    )
    return j.select("doc", "field", status.alias("status"))


def score_special(pred: DataFrame, truth: DataFrame, tasks: int | None = None) -> DataFrame:
    """doc, field, status of fields that several values can answer.

    pred: doc, field, kind, value, conflict, any number of rows a field. truth: doc, field, kind, value; a null value is not stated.
    subsidy takes the values of the labelled kind (of any, if null), subsidy_type their kinds. extra_charges_outside_total is right if all charges
    are the label's parts at + and ;. vendor_name is right with any one of the names between semicolons, without a last note in brackets.
    dcr_text is right if either text holds the other. Values are compared as amounts, else as folded text. Repeated labels count once each.
    tasks: over how many the fields are dealt.
    """
    # a text that is an amount has a parsed one, and no other has
    key = lambda c: F.coalesce(T.parse_amount(c)["parsed"].cast("decimal(18,2)").cast("string"), T.loose_key(c))
    is_ = lambda *names: F.col("field").isin(*names)
    labels = T.dealt(truth, tasks, "doc", "field").select("doc", "field", F.col("kind").alias("__kind"), F.col("value").alias("__stated")).distinct()
    said = F.when(is_("subsidy_type"), F.col("kind")).otherwise(F.col("value"))
    counts = T.dealt(pred, tasks, "doc", "field").where(is_("subsidy", "subsidy_type", "extra_charges_outside_total", "dcr_text", "vendor_name")).join(labels, ["doc", "field"], "right").where(~is_("subsidy") | F.col("__kind").isNull() | F.col("kind").isNull() | (F.col("kind") == F.col("__kind")))
    per = counts.groupBy("doc", "field").agg(F.coalesce(F.max("conflict"), F.lit(False)).alias("conflict"), F.array_sort(F.collect_list(F.when(~F.coalesce("conflict", F.lit(False)), key(said)))).alias("got"))
    j = labels.join(per, ["doc", "field"], "left").withColumns({"conflict": F.coalesce("conflict", F.lit(False)), "got": F.coalesce("got", F.array().cast("array<string>"))})
    names = F.transform(F.split("__stated", ";"), lambda x: F.trim(F.regexp_replace(x, "\\s*\\[[^\\]]*\\]\\s*$", "")))
    cut = F.when(is_("vendor_name"), names).when(is_("extra_charges_outside_total"), F.transform(F.split("__stated", "[+;]"), lambda x: F.trim(x))).otherwise(F.array("__stated"))
    want = F.array_sort(F.transform(F.filter(cut, lambda x: x != ""), key))
    one = F.get("got", F.lit(0))
    right = (
        F.when(is_("vendor_name"), (F.size("got") == 1) & F.array_contains("__want", one))
        .when(is_("dcr_text"), F.contains(F.get("__want", F.lit(0)), one) | F.contains(one, F.get("__want", F.lit(0)))).otherwise(F.col("__want") == F.col("got"))
    )
    status = (
        F.when(F.col("__stated").isNull(), F.when((F.size("got") > 0) | F.col("conflict"), "falsely_populated").otherwise("abstained"))
        .when(F.col("conflict"), "conflict_flagged").when(F.size("got") == 0, "missing").when(right, "correct").otherwise("wrong")
    )
    return j.withColumn("__want", F.when(F.col("__stated").isNotNull(), want)).select("doc", "field", status.alias("status"))


def summarise(scores: DataFrame) -> DataFrame:
    """field, n, accuracy (correct of stated), false_population_rate (of not stated), three decimals, null without a denominator."""
    c = lambda *s: F.count_if(F.col("status").isin(*s))
    stated, none = c("correct", "wrong", "missing", "conflict_flagged"), c("falsely_populated", "abstained")
    ratio = lambda a, b: F.round(F.try_divide(a, b), 3)
    return scores.groupBy("field").agg(F.count("*").alias("n"), ratio(c("correct"), stated).alias("accuracy"), ratio(c("falsely_populated"), none).alias("false_population_rate"))


def status_report(scores: DataFrame, by: str = "field") -> DataFrame:
    """Status counts for each field (or document: by="doc") and, with a null there and is_total 1, of all."""
    return scores.rollup(by).agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("correct", "wrong", "missing", "conflict_flagged", "falsely_populated", "abstained")], F.grouping(by).cast("int").alias("is_total"))


def confidence_table(answers: DataFrame) -> DataFrame:
    """bucket, kind, n, kept for each confidence bucket, empty ones too (a fixed list of buckets and two kinds)."""
    spark = answers.sparkSession
    grid = spark.createDataFrame([(b, k) for b in BUCKETS for k in ("money", "other")], "bucket int, kind string")
    bucket = F.lit(BUCKETS[0])
    for b in BUCKETS[1:]:
        bucket = F.when(F.col("confidence") >= b, b).otherwise(bucket)
    counts = answers.withColumn("bucket", bucket).groupBy("bucket", "kind").agg(F.count("*").alias("n"), F.count_if("kept").alias("kept"))
    return F.broadcast(grid).join(counts, ["bucket", "kind"], "left").na.fill(0, ["n", "kept"])


def compare_models(scores: DataFrame, models: list[str]) -> DataFrame:
    """One column a model for each (doc, field)."""
    return scores.groupBy("doc", "field").pivot("model", models).agg(F.min("status"))


def model_totals(runs: DataFrame) -> DataFrame:
    """model, n_batches, n_failed, seconds, tokens: sums over the batches (model, failed, seconds, tokens) that each model read."""
    return runs.groupBy("model").agg(F.count("*").alias("n_batches"), F.count_if("failed").alias("n_failed"), F.sum("seconds").alias("seconds"), F.sum("tokens").alias("tokens"))


def label_disagreement(hits: DataFrame, labels: DataFrame) -> DataFrame:
    return hits.join(labels, "doc_id", "full_outer").where(F.coalesce("hit", F.lit(0)) != F.coalesce("label", F.lit(0)))


def keyword_groups(docs: DataFrame, groups: dict[str, str]) -> DataFrame:
    """doc_id, group, hits: occurrences of each group's pattern; only groups that occur."""
    text = F.lower(F.coalesce("text", F.lit("")))
    rows = F.array(*[F.struct(F.lit(g).alias("group"), F.regexp_count(text, F.lit(p)).cast("long").alias("hits")) for g, p in groups.items()])
    return docs.select("doc_id", F.inline(rows)).where("hits > 0")


def recheck_findings(operands: DataFrame) -> DataFrame:
    """Long operands (quote_id, operand, value) pivoted and the total computed again: agrees or not."""
    wide = operands.groupBy("quote_id").pivot("operand", ["base", "gst", "discount", "total"]).agg(F.max("value"))
    expected = F.col("base") + F.col("gst") - F.coalesce("discount", F.lit(0))
    return wide.select("quote_id", F.when(F.abs(expected - F.col("total")) <= 1, "agree").otherwise("disagree").alias("result"))


FORMULAS = (
    # check, operand, weight, from, to: each operand adds weight * (what of it lies between from and to; all of it without bounds)
    *[("C1", o, w, None, None) for o, w in (("panel_watts", 0.001), ("stated_kw", -1))],
    *[("C2_general", "dc_kw", w, a, b) for w, a, b in ((30_000, 0, 2), (18_000, 2, 3))], ("C2_general", "subsidy", -1, None, None),
    *[("C2_special", "dc_kw", w, a, b) for w, a, b in ((33_000, 0, 2), (19_800, 2, 3))], ("C2_special", "subsidy", -1, None, None),
    *[("C3a", o, w, None, None) for o, w in (("base", 1), ("gst", 1), ("charge_inside", 1), ("discount", -1), ("total", -1))],
    *[("C3b", o, w, None, None) for o, w in (("total", 1), ("central", -1), ("state_subsidy", -1), ("combined", -1), ("net", -1))],
)
TOLERANCE = {"C1": 0.01, "C2_general": 1, "C2_special": 1, "C3a": 1, "C3b": 1}


def recheck_long(operands: DataFrame, findings: DataFrame, formulas: DataFrame | None = None) -> DataFrame:
    """set, check, n_agree, n_disagree: findings (set, doc, check, status consistent or not) computed again from long operands (doc, check, operand, value).

    A check's formula is rows, not code: the sum over its operands, several of one name adding up, has to be within TOLERANCE of zero. Operands without a formula
    row, and nulls, add nothing; findings without operands are left out. The formulas, a few rows a check, are broadcast: dealt by check and operand, all documents' operands of one name would
    meet in one task. Operands and findings meet in one group a document and check, with a document's findings of a check in an array.
    """
    spark = operands.sparkSession
    formulas = formulas or spark.createDataFrame([(c, o, float(w), None if a is None else float(a), None if b is None else float(b), float(TOLERANCE[c])) for c, o, w, a, b in FORMULAS], "check string, operand string, weight double, from_ double, to_ double, tolerance double")
    part = F.when(F.col("from_").isNull(), F.col("value")).otherwise(F.greatest(F.lit(0.0), F.least(F.col("value"), F.col("to_")) - F.col("from_")))
    parts = operands.where("doc is not null and value is not null").withColumn("value", F.col("value").cast("double")).join(F.broadcast(formulas), ["check", "operand"]).select("doc", "check", (F.col("weight") * part).alias("part"), "tolerance")
    told = findings.where("doc is not null and check is not null").select("doc", "check", F.struct("set", "status").alias("finding"))
    per = parts.unionByName(told, allowMissingColumns=True).groupBy("doc", "check").agg(F.abs(F.sum("part")).alias("off"), F.max("tolerance").alias("tolerance"), F.collect_list("finding").alias("told"))
    again = per.where("tolerance is not null").select("check", (F.col("off") <= F.col("tolerance") + 1e-9).alias("holds"), F.inline("told"))
    agree = F.col("holds") == (F.col("status") == "consistent")
    return again.groupBy("set", "check").agg(F.count_if(agree).alias("n_agree"), F.count_if(~agree).alias("n_disagree"))


def operands_in_text(operands: DataFrame, texts: DataFrame) -> DataFrame:
    """Whether each (doc, value) is among the numbers of its own document's text."""
    numbers = texts.select("doc", F.explode(F.array_distinct(F.regexp_extract_all(F.regexp_replace("text", ",", ""), F.lit("([0-9]+)"), 1))).alias("value")).distinct()
    return operands.join(numbers.withColumn("found", F.lit(True)), ["doc", "value"], "left").withColumn("found", F.coalesce("found", F.lit(False)))


def split_guard(docs: DataFrame, heldout: DataFrame, runs: DataFrame) -> DataFrame:
    """run_id, reason for runs that touch held-out documents but not the whole set, mix them with others, or use them again."""
    size = heldout.agg(F.count("*").alias("size"))
    per = runs.join(F.broadcast(heldout.select("doc", F.lit(1).alias("held"))), "doc", "left").groupBy("run_id").agg(F.sum(F.coalesce("held", F.lit(0))).alias("n_held"), F.count("*").alias("n"))
    per = per.join(F.broadcast(size), F.lit(True)).withColumn("again", F.when(F.col("n_held") > 0, F.row_number().over(Window.partitionBy(F.col("n_held") > 0).orderBy("run_id"))))
    reason = F.when((F.col("n_held") > 0) & (F.col("n_held") < F.col("n")), "pooled").when((F.col("n_held") > 0) & (F.col("n_held") < F.col("size")), "part").when(F.col("again") > 1, "again")
    return per.select("run_id", reason.alias("reason")).where("reason is not null")


def page_total_audit(stated: DataFrame, pages: DataFrame) -> DataFrame:
    actual = pages.groupBy("doc").agg(F.count("*").alias("n_pages"))
    return stated.join(actual, "doc", "left").where(~F.col("stated_pages").eqNullSafe(F.coalesce("n_pages", F.lit(0)))).select("doc", "stated_pages", F.coalesce("n_pages", F.lit(0)).alias("n_pages"))


def translation_problems(pairs: DataFrame) -> DataFrame:
    """id, piece: placeholders and numbers that do not occur equally often in source and target."""
    pieces = lambda c: F.regexp_extract_all(F.col(c), F.lit("(\\{[a-z_]+\\}|₹|[0-9][0-9,.]*[0-9]|[0-9])"), 1)
    counts = lambda c, n: pairs.select("id", F.explode(pieces(c)).alias("piece")).groupBy("id", "piece").agg(F.count("*").alias(n))
    both = counts("source", "a").join(counts("target", "b"), ["id", "piece"], "full_outer")
    return both.where(F.coalesce("a", F.lit(0)) != F.coalesce("b", F.lit(0))).select("id", "piece")


def labelled_quotes(truth: DataFrame) -> DataFrame:
    """doc, nth, count, watts, make from labels (doc, counts, ratings, makes; several items in one label are parted by + or ;): the nth parts belong together."""
    parts = lambda c: F.transform(F.split(F.coalesce(c, F.lit("")), "\\s*[+;]\\s*"), lambda x: F.nullif(F.trim(x), F.lit("")))
    zipped = F.arrays_zip(parts("counts").alias("c"), parts("ratings").alias("r"), parts("makes").alias("m"))
    rows = truth.select("doc", F.posexplode(zipped).alias("nth", "x"))
    # the generator keeps the parsed capacity from being copied into each use
    rows = rows.select("doc", "nth", "x", F.inline(F.array(T.parse_capacity(F.col("x.r")))))
    watts = F.when(F.col("lo") == F.col("hi"), T.measure_watts(F.col("lo").cast("string"), F.col("unit"))).cast("bigint")
    out = rows.select("doc", (F.col("nth") + 1).alias("nth"), T.parse_count(F.col("x.c")).alias("count"), watts.alias("watts"), F.col("x.m").alias("make"))
    return out.where("count is not null or watts is not null or make is not null")


def wrong_operands(findings: DataFrame, truth: DataFrame) -> DataFrame:
    """doc, check_id, operand, used, stated: operands (doc, check_id, operand, used) of definitive findings that differ from the labels (doc, operand, stated)."""
    return findings.join(truth, ["doc", "operand"], "left").where("used is distinct from stated").select("doc", "check_id", "operand", "used", "stated")


def accept_all(quotes: DataFrame, shown: Callable[[DataFrame], DataFrame], rounds: int = 4) -> tuple[DataFrame, int]:
    """(quotes with confirmed, rounds used): everything shown (quote_id, field; never conflicts) is confirmed until a round shows nothing new.

    quotes has quote_id and an array confirmed. `shown` looks at the quotes with what is confirmed so far; the rounds are few and fixed, each one a job.
    """
    for i in range(rounds):
        new = shown(quotes).where("not conflict").groupBy("quote_id").agg(F.collect_set("field").alias("__new"))
        joined = quotes.join(new, "quote_id", "left").withColumn("__new", F.array_except(F.coalesce("__new", F.array().cast("array<string>")), "confirmed"))
        if joined.where("size(__new) > 0").isEmpty():
            return quotes, i
        quotes = joined.withColumn("confirmed", F.array_sort(F.concat("confirmed", "__new"))).drop("__new")
    return quotes, rounds
