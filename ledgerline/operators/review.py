"""People's corrections and confirmations over facts, and what still has to be looked at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Confidence under which a value is marked, rules whose values are always marked, ranges of typed numbers.
LOW_CONFIDENCE = 80
RISKY_RULES = ("line", "unmatched")
GUARDS = {"base": (10_000, 3_000_000), "gst": (0, 600_000), "total": (10_000, 3_000_000), "net": (10_000, 3_000_000), "discount": (0, 600_000), "central": (0, 200_000), "state_subsidy": (0, 200_000), "combined": (0, 200_000), "unspecified": (0, 200_000), "stated_kw": (0.5, 20), "panel_count": (1, 100), "panel_wattage": (100, 800), "inverter_rating": (0.5, 20)}


def apply_corrections(facts: DataFrame, corrections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(facts with value, original and corrected; corrections of unknown paths). Paths are (doc, field); repeating a correction changes nothing."""
    last = corrections.groupBy("doc", "field").agg(F.max_by("new_value", "at").alias("new_value"))
    out = facts.join(last, ["doc", "field"], "left")
    changed = F.col("new_value").isNotNull() & ~F.col("new_value").eqNullSafe(F.col("value"))
    fixed = out.select(*[F.coalesce("new_value", "value").alias("value") if c == "value" else F.col(c) for c in facts.columns], F.when(changed, F.col("value")).alias("original"), changed.alias("corrected"))
    return fixed, corrections.join(facts.select("doc", "field").distinct(), ["doc", "field"], "left_anti")


# What a correction's path may name.
FIELD_PATHS = "base_price gst_amount discount gross_total subsidy_central subsidy_state subsidy_combined subsidy_unspecified net_cost stated_capacity dcr_declaration vendor_registration".split()
OWN_TO_OPTION = [f for f in FIELD_PATHS if f not in ("dcr_declaration", "vendor_registration")]
ITEM_PATHS = {"module_groups": ("count", "wattage", "make_model"), "inverters": ("make_model", "rating"), "extra_charges": ("label", "amount", "included_in_total")}
ADDED_CHARGE = "^U(?:[1-9]|10)$"


def correct_paths(facts: DataFrame, corrections: DataFrame, options: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(facts after the corrections; doc, path and reason of those that name nothing).

    facts: doc, option (null: of the whole quotation), list and item (null: a field), field, value, and original and corrected where corrections were applied
    before. corrections: doc, path, value, at; of one path the last counts. options: doc and option, the one in effect.

    A path is a field, or list[item].field. Prices and sizes go to the option's own fact where there is one, else to the whole quotation's, which is made if it is
    missing. Items are found by id; charges U1 to U10 are made, for the option in effect. A bare number for a wattage is watts. original is the value before the
    first correction, whatever comes after, so that the same corrections again change nothing.
    """
    for name, kind in (("original", "string"), ("corrected", "boolean")):
        if name not in facts.columns:
            facts = facts.withColumn(name, F.lit(None).cast(kind))
    last = corrections.groupBy("doc", "path").agg(F.max_by("value", F.struct("at", "value")).alias("new"))
    part = lambda i: F.regexp_extract("path", "^([a-z_]+)\\[([^\\]]+)\\][.]([a-z_]+)$", i)
    whole = F.col("path").isin(*FIELD_PATHS)
    paths = last.select("doc", "path", "new", F.nullif(part(1), F.lit("")).alias("list"), F.nullif(part(2), F.lit("")).alias("item"), F.when(whole, F.col("path")).otherwise(F.nullif(part(3), F.lit(""))).alias("field"), whole.alias("__whole"))
    known = F.col("__whole") | F.coalesce(*[F.when(F.col("list") == k, F.col("field").isin(*v)) for k, v in ITEM_PATHS.items()], F.lit(False))
    paths = paths.withColumn("__known", known).join(options.select("doc", F.col("option").alias("__option")).dropDuplicates(["doc"]), "doc", "left")
    own = facts.where("list is null and option is not null").select("doc", F.col("option").alias("__option"), "field", F.lit(True).alias("__own")).distinct()
    items = facts.where("list is not null").groupBy("doc", "list", "item").agg(F.first("option").alias("__of"), F.lit(True).alias("__there"))
    paths = paths.join(own, ["doc", "__option", "field"], "left").join(items, ["doc", "list", "item"], "left")
    added = (F.col("list") == "extra_charges") & F.col("item").rlike(ADDED_CHARGE)
    reason = F.when(~F.col("__known"), "unknown_path").when(~F.col("__whole") & F.col("__there").isNull() & ~F.coalesce(added, F.lit(False)), "unknown_item")
    watts = F.when((F.col("field") == "wattage") & F.col("new").rlike("^\\s*[0-9]+(?:[.][0-9]+)?\\s*$"), F.concat(F.trim("new"), F.lit(" W"))).otherwise(F.col("new"))
    option = F.when(F.col("__whole"), F.when(F.coalesce("__own", F.lit(False)) & F.col("field").isin(*OWN_TO_OPTION), F.col("__option"))).when(F.col("__there"), F.col("__of")).otherwise(F.col("__option"))
    paths = paths.withColumns({"reason": reason, "new": watts, "option": option})
    names = ["doc", "option", "list", "item", "field"]
    target = paths.where("reason is null").select(*[F.col(c).alias(f"__{c}_") for c in names], F.col("new"), F.lit(True).alias("__hit"))
    on = F.lit(True)
    for c in names:
        on &= F.col(c).eqNullSafe(F.col(f"__{c}_"))
    joined = facts.withColumn("__fact", F.lit(True)).join(target, on, "full_outer")
    hit = F.coalesce("__hit", F.lit(False))
    others = [c for c in facts.columns if c not in (*names, "value", "original", "corrected")]
    was = F.coalesce("corrected", F.lit(False))
    out = joined.select(*[F.when(F.col("__fact"), F.col(c)).otherwise(F.col(f"__{c}_")).alias(c) for c in names], F.when(hit, F.col("new")).otherwise(F.col("value")).alias("value"), *others, F.when(hit & ~was, F.col("value")).otherwise(F.col("original")).alias("original"), (hit | was).alias("corrected"))
    return out, paths.where("reason is not null").select("doc", "path", "reason")


def mark_check_this(merged: DataFrame, facts: DataFrame, verified: DataFrame) -> DataFrame:
    """doc, field, reasons in order: conflict, low_confidence, source_rule. A verified (doc, field) leaves only a conflict."""
    per = facts.groupBy("doc", "field").agg(F.min("confidence").alias("least"), F.max(F.col("rule").isin(*RISKY_RULES)).alias("risky"))
    out = merged.join(per, ["doc", "field"], "left").join(verified.select("doc", "field", F.lit(True).alias("seen")).distinct(), ["doc", "field"], "left")
    open_ = F.col("seen").isNull()
    reasons = F.array_compact(F.array(F.when(F.col("conflict"), "conflict"), F.when(open_ & (F.col("least") < LOW_CONFIDENCE), "low_confidence"), F.when(open_ & F.col("risky"), "source_rule")))
    return out.select("doc", "field", F.array_join(reasons, ",").alias("reasons")).where("reasons <> ''")


def near_power(a: Column, b: Column) -> Column:
    """a is about 10, 100 or 1000 times b, or b of a (within a fifth). Zeros are near nothing: the ratio may be taken before the signs are looked at."""
    ratio = F.try_divide(F.greatest(a, b), F.least(a, b))
    return (a > 0) & (b > 0) & (F.coalesce(F.abs(ratio - 10) <= 2, F.lit(False)) | F.coalesce(F.abs(ratio - 100) <= 20, F.lit(False)) | F.coalesce(F.abs(ratio - 1000) <= 200, F.lit(False)))


def guard_entries(view: DataFrame) -> DataFrame:
    """quote_id, field, reason: typed numbers out of range, else members of a relation about a power of ten off; a member out of range silences its relations.

    Panels' power and each inverter's rating stand beside the stated size, base and tax beside the total, the total less subsidies beside the net cost.
    """
    v = lambda c: F.col(c).cast("double")
    or_zero = lambda c: F.coalesce(v(c), F.lit(0.0))
    least_most = {"panel_count": ("count_least", "count_most"), "panel_wattage": ("watt_least", "watt_most"), "inverter_rating": ("inv_least", "inv_most")}
    ends = {f: least_most.get(f, (f, f)) for f in GUARDS}
    flags = {f"__bad_{f}": F.coalesce((v(lo) < GUARDS[f][0]) | (v(hi) > GUARDS[f][1]), F.lit(False)) for f, (lo, hi) in ends.items()}
    subsidies = ("central", "state_subsidy", "combined", "unspecified")
    relations = {
        "__panels": (("panel_count", "panel_wattage", "stated_kw"), near_power(F.when(F.col("all_exact"), v("w_lo") / 1000), v("stated_kw"))),
        "__total": (("base", "gst", "total"), near_power(v("base") + or_zero("gst"), v("total"))),
        "__net": (("total", *subsidies, "net"), near_power(v("total") - sum(map(or_zero, subsidies)), v("net"))),
        "__inverter": (("inverter_rating", "stated_kw"), F.col("inv_off")),
    }
    flags |= {name: F.coalesce(off, F.lit(False)) for name, (_, off) in relations.items()}

    def reason(field: str) -> Column:
        # an inverter out of range leaves the other inverters' relations, so inv_off already holds only those in range
        off = [F.col(r) & ~F.greatest(F.lit(False), *[F.col(f"__bad_{m}") for m in members if m != "inverter_rating"]) for r, (members, _) in relations.items() if field in members]
        scale = F.greatest(F.lit(False), F.lit(False), *off) & v(ends[field][0]).isNotNull()
        return F.when(F.col(f"__bad_{field}"), "range").when(scale, "relation")

    rows = [F.when(reason(f).isNotNull(), F.struct(F.lit(f).alias("field"), reason(f).alias("reason"))) for f in GUARDS]
    return view.withColumns(flags).select("quote_id", F.inline(F.array_compact(F.array(*rows))))


# The range of a typed extra charge.
EXTRA_CHARGE = (0, 300_000)


def guard_charges(charges: DataFrame) -> DataFrame:
    """quote_id, field (the charge's path), reason: extra charges (quote_id, charge_id, amount) out of range."""
    lo, hi = EXTRA_CHARGE
    path = F.concat(F.lit("extra_charges["), F.col("charge_id").cast("string"), F.lit("].amount"))
    return charges.where((F.col("amount") < lo) | (F.col("amount") > hi)).select("quote_id", path.alias("field"), F.lit("range").alias("reason"))


def json_text(c: Column | str) -> Column:
    """A value's text as a JSON string, null as null."""
    text = (F.col(c) if isinstance(c, str) else c).cast("string")
    for sign, to in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(sign), F.lit(to))
    return F.coalesce(F.concat(F.lit('"'), text, F.lit('"')), F.lit("null"))


def value_token(*fields: tuple[str, Column]) -> Column:
    """24 hex characters of SHA-256 over canonical JSON: keys sorted, separators ", " and ": ", values as text, nulls kept."""
    parts: list[Column] = []
    for i, (name, c) in enumerate(sorted(fields)):
        parts += [F.lit((", " if i else "{") + f'"{name}": '), json_text(c)]
    return F.substring(F.sha2(F.concat(*parts, F.lit("}")).cast("binary"), 256), 1, 24)


def hmac_token(key: bytes, payload: Column) -> Column:
    """HMAC-SHA256 of a text column, hex, from two nested hashes."""
    block = key.ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in block), bytes(b ^ 0x5C for b in block)
    first = F.unhex(F.sha2(F.concat(F.lit(bytearray(inner)), payload.cast("binary")), 256))
    return F.sha2(F.concat(F.lit(bytearray(outer)), first), 256)
