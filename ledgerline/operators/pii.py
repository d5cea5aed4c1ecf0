"""Personal data in lines: spans, boxes, masks and release checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.text import running_sums

# Patterns of personal and of protected data, in order.
PERSONAL = {
    "email": "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\\.[A-Za-z.]+",
    "id_number": "\\b[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}\\b",
    "phone": "(?:\\+91[ -]*|\\b91[ -]*|\\b0|\\b)[6-9][0-9]{4}[ -]?[0-9]{5}\\b",
    "tax_id": "\\b[A-Z]{5}[0-9]{4}[A-Z]\\b",
    "long_number": "\\b[0-9]{9,}\\b",
}
PROTECTED = {
    "capacity": "\\b[0-9]+(?:\\.[0-9]+)? ?(?:kWp|kW|Wp|kVA)\\b",
    "amount": "(?:Rs\\.?|₹) ?[0-9][0-9,]*",
    "percent": "[0-9]+(?:\\.[0-9]+)? ?%",
    "date": "\\b[0-9]{1,2}[/.-][0-9]{1,2}[/.-][0-9]{2,4}\\b",
    "quantity": "\\b(?!(?<=\\b[0-9]{4}[ -]?[0-9]{4}[ -])[0-9]{4}\\b|(?<=\\b[0-9]{4}[ -])[0-9]{8}\\b|(?<=[6-9][0-9]{4}[ -])[0-9]{5}\\b)[0-9]{1,8} ?(?:nos?|pcs|pieces|panels?|modules?|sets?|units?)\\b",
    "model": "(?<![A-Za-z0-9_@./-])(?![A-Z]{5}[0-9]{4}[A-Z](?![A-Za-z0-9]))(?=[A-Za-z./-]*[0-9])(?=[0-9./-]*[A-Za-z])[A-Za-z0-9][A-Za-z0-9_./-]{3,}[A-Za-z0-9](?![./-]*[A-Za-z0-9_@])",
}
LABELS = {"name": "\\b(?:name|attn)\\s*[:\\-]\\s*", "contact": "\\b(?:phone|mobile|contact)(?: no\\.?)?\\s*[:\\-]\\s*", "email": "\\be-?mail(?: id)?\\s*[:\\-]\\s*", "consumer_id": "\\bconsumer (?:no\\.?|id)\\s*[:\\-]\\s*", "address": "\\baddress\\s*[:\\-]\\s*"}


UNIT = "[\\p{L}\\p{N}_]+"
BROADCAST_TERMS = 200_000
"""Units of terms that go to all tasks; beyond, texts and terms meet in a shuffle join."""
OTHER = "term"


def _row() -> Column:
    """Tells rows with equal keys apart by their texts."""
    return F.xxhash64("__text").alias("__row")


def _keyed(docs: DataFrame, keys: tuple[str, ...], text: str) -> DataFrame:
    return docs.where(F.col(text).isNotNull()).select(*keys, F.col(text).alias("__text"))


def _located(docs: DataFrame, patterns: dict[str, str], keys: tuple[str, ...]) -> DataFrame:
    """keys, __row, kind, start, found of every match of each pattern: a match starts after the texts between matches and the matches before it."""

    def one(kind: str, p: str) -> Column:
        found, between = F.regexp_extract_all("__text", F.lit(f"({p})"), 1), F.split("__text", p, -1)
        gaps = F.transform(found, lambda x, i: F.length(F.get(between, i)) + F.when(i > 0, F.length(F.get(found, i - 1))).otherwise(0))
        return F.when(F.col("__text").rlike(p), F.struct(F.lit(kind).alias("kind"), found.alias("__found"), gaps.alias("__gaps")))

    rows = docs.select(*keys, _row(), F.inline(F.array_compact(F.array(*[one(k, p) for k, p in patterns.items()]))))
    rows = running_sums(rows, "__gaps", "__starts")
    return rows.select(*keys, "__row", "kind", F.inline(F.arrays_zip(F.col("__starts").alias("start"), F.col("__found").alias("found"))))


def spans(docs: DataFrame, patterns: dict[str, str], keys: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """keys, kind, start (from 0), found: every match of each pattern. A null text has none."""
    return _located(_keyed(docs, keys, text), patterns, keys).drop("__row")


def _units(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(f"({UNIT})"), 1)


def _with_some_term(docs: DataFrame, edges: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """The rows of docs in whose units those of some term (edges: unit, the first one, and units) follow each other: few, where most texts hold no term.

    Each distinct unit of a text meets the terms that begin with it; the text itself is moved only where one is found.
    """
    told = edges.select("unit", F.concat(F.lit(" "), F.array_join("units", " "), F.lit(" ")).alias("__said")).distinct()
    line = F.lower(F.concat(F.lit(" "), F.array_join(F.regexp_extract_all("__text", F.lit(f"({UNIT})"), 1), " "), F.lit(" ")))
    lines = docs.select(*keys, "__text", F.monotonically_increasing_id().alias("__id"), F.inline(F.array(F.struct(line.alias("__line")))))
    met = lines.select("*", F.explode(F.array_distinct(F.split("__line", " "))).alias("unit")).join(F.broadcast(told), "unit").where(F.contains("__line", F.col("__said")))
    return met.groupBy("__id").agg(*[F.first(c).alias(c) for c in (*keys, "__text")]).drop("__id")


def _term_places(docs: DataFrame, terms: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """keys, __row, kind, term, start, found of each occurrence of terms (term, kind) in the rows of _keyed.

    Texts and terms are cut into units of letters and digits. Each unit of a text, with the units after it up to the longest term's length, meets the terms that
    begin with it in an equi-join; those whose units follow are checked by their own pattern on the piece of text itself, so that only
    spaces, dots and commas stand between a term's words. No pattern grows with the number of terms.
    """
    inner = F.array_join(F.transform(F.split(F.trim("term"), "\\s+"), lambda w: F.concat(F.lit("\\Q"), F.regexp_replace(w, "\\\\E", ""), F.lit("\\E"))), "[\\s,.]+")
    known = terms.select(F.trim("term").alias("term"), "kind", _units(F.col("term")).alias("units"), F.concat(F.lit("(?iu)^"), inner, F.lit("$")).alias("pattern")).where("size(units) > 0").distinct()
    edges = known.select("*", F.get("units", F.lit(0)).alias("unit"), F.length(F.regexp_extract("term", f"^((?:(?!{UNIT}).)*)", 1)).alias("lead"), F.length(F.regexp_extract("term", f"((?:(?!{UNIT}).)*)$", 1)).alias("trail"))
    size = edges.agg(F.coalesce(F.max(F.size("units")), F.lit(0)).alias("longest"), F.coalesce(F.sum(F.size("units")), F.lit(0)).alias("n")).first()
    if size.n <= BROADCAST_TERMS:
        docs = _with_some_term(docs, edges, keys)
    units, between = F.regexp_extract_all("__text", F.lit(f"({UNIT})"), 1), F.split("__text", UNIT, -1)
    rows = docs.select(*keys, _row(), F.inline(F.array(F.struct(units.alias("__units"), between.alias("__between")))))
    gaps = F.transform("__units", lambda x, i: F.length(F.get("__between", i)) + F.when(i > 0, F.length(F.get("__units", i - 1))).otherwise(0))
    rows = running_sums(rows.select("*", F.inline(F.array(F.struct(gaps.alias("__gaps"))))), "__gaps", "__starts")
    most = F.lit(max(1, size.longest))
    word = lambda x, i: F.struct(F.lower(x).alias("unit"), F.get("__starts", i).alias("at"), F.slice("__units", i + 1, most + 1).alias("next"), F.slice("__between", i + 1, most + 2).alias("gaps"), (i == 0).alias("first"))
    words = rows.select(*keys, "__row", F.inline(F.transform("__units", word)))
    hits = words.join(F.broadcast(edges) if size.n <= BROADCAST_TERMS else edges, "unit").withColumn("n", F.size("units"))
    hits = hits.where(F.transform(F.slice("next", F.lit(1), F.col("n")), F.lower) == F.col("units"))
    # what the term has before its first unit and after its last one, and what stands beyond
    front, back = F.get("gaps", F.lit(0)), F.coalesce(F.get("gaps", F.col("n")), F.lit(""))
    fits = (F.length(front) >= F.col("lead")) & (F.length(back) >= F.col("trail"))
    alone = ((F.col("lead") == 0) | (F.length(front) > F.col("lead")) | F.col("first")) & ((F.col("trail") == 0) | (F.length(back) > F.col("trail")) | (F.size("next") == F.col("n")))
    inside = F.array_join(F.transform(F.slice("next", F.lit(1), F.col("n")), lambda u, i: F.concat(F.when(i > 0, F.get("gaps", i)).otherwise(""), u)), "")
    found = F.concat(F.expr("right(gaps[0], lead)"), inside, F.expr("left(coalesce(get(gaps, n), ''), trail)"))
    hits = hits.where(fits & alone).select(*keys, "__row", "kind", "term", "pattern", (F.col("at") - F.col("lead")).cast("int").alias("start"), found.alias("found"))
    return hits.where(F.regexp_like("found", F.col("pattern"))).drop("pattern")


def term_spans(docs: DataFrame, terms: DataFrame, keys: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """keys, kind, term, start, found: each occurrence of terms (term, kind deny or keep), in any case, words apart by any spaces, dots and commas."""
    return _term_places(_keyed(docs, keys, text), terms, keys).drop("__row")


def _same_row(keys: tuple[str, ...]) -> Column:
    on = F.col("a.__row") == F.col("b.__row")
    for k in keys:
        on &= F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    return on


def _personal(docs: DataFrame, terms: DataFrame | None, keys: tuple[str, ...]) -> DataFrame:
    """Personal data by pattern without what lies inside an occurrence of a kept term, and every occurrence of a denied term."""
    found = _located(docs, PERSONAL, keys)
    if terms is None:
        return found
    places = _term_places(docs, terms, keys)
    kept, said = places.where("kind = 'keep'"), places.where("kind = 'deny'")
    inside = _same_row(keys) & (F.col("b.start") <= F.col("a.start")) & (F.col("a.start") + F.length("a.found") <= F.col("b.start") + F.length("b.found"))
    left = found.alias("a").join(kept.alias("b"), inside, "left_anti")
    return left.unionByName(said.select(*keys, "__row", F.lit(OTHER).alias("kind"), "start", "found"))


def pii_spans(docs: DataFrame, terms: DataFrame | None = None, keys: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """keys, kind, start, found: personal data by pattern, and each occurrence of a denied term as kind `term`.

    terms: term and kind (deny or keep), as parse_terms gives them. A kept term only takes back pattern matches that lie inside one of its own occurrences in
    the same text; it never takes back a denied term. Rows with equal keys are told apart by their texts.
    """
    return _personal(_keyed(docs, keys, text), terms, keys).drop("__row")


def protected_spans(docs: DataFrame, **kw) -> DataFrame:
    return spans(docs, PROTECTED, **kw)


def label_spans(docs: DataFrame, **kw) -> DataFrame:
    """Labels whose value starts where the match ends."""
    out = spans(docs, {k: f"(?i){p}" for k, p in LABELS.items()}, **kw)
    return out.withColumn("value_start", F.col("start") + F.length("found"))


def mask_text(c: Column) -> Column:
    """The text with each match of a personal pattern replaced by its kind: the quick form of mask_documents, without terms and protected spans."""
    for kind, p in PERSONAL.items():
        c = F.regexp_replace(c, p, f"[{kind}]")
    return c


def mask_intervals(personal: DataFrame, protected: DataFrame, keys: list[str]) -> DataFrame:
    """keys, start, end, kind of the pieces to mask: the union of personal spans without protected ones, and all of the denied terms' spans.

    personal, protected: keys, kind, start, found. Ends of spans are events in order of place; how many spans of each sort are open is a running sum, and stretches
    between two events that are to be masked join where they touch. A piece's kind is that of its spans which comes first in PERSONAL, denied terms last.
    """
    rank = F.coalesce(*[F.when(F.col("kind") == k, F.lit(i)) for i, k in enumerate(PERSONAL)], F.lit(len(PERSONAL)))
    sorts = personal.select(*keys, "start", (F.col("start") + F.length("found")).alias("end"), F.when(F.col("kind") == OTHER, "deny").otherwise("mask").alias("sort"), rank.alias("rank"))
    sorts = sorts.unionByName(protected.select(*keys, "start", (F.col("start") + F.length("found")).alias("end"), F.lit("keep").alias("sort"), F.lit(99).alias("rank"))).where("end > start")
    change = lambda at, by: F.struct(F.col(at).alias("at"), *[F.when(F.col("sort") == x, by).otherwise(0).alias(x) for x in ("mask", "deny", "keep")], F.when((F.col("sort") != "keep") & F.lit(by > 0), F.col("rank")).alias("rank"))
    events = sorts.select(*keys, F.inline(F.array(change("start", 1), change("end", -1)))).groupBy(*keys, "at").agg(F.sum("mask").alias("mask"), F.sum("deny").alias("deny"), F.sum("keep").alias("keep"), F.min("rank").alias("rank"))
    order = Window.partitionBy(*keys).orderBy("at")
    far = order.rowsBetween(Window.unboundedPreceding, 0)
    open_ = {c: F.sum(c).over(far) for c in ("mask", "deny", "keep")}
    steps = events.select(*keys, "at", "rank", F.lead("at").over(order).alias("end"), ((open_["deny"] > 0) | ((open_["mask"] > 0) & (open_["keep"] == 0))).alias("hide"))
    starts = (F.col("hide") & ~F.coalesce(F.lag("hide").over(order), F.lit(False))).cast("int")
    pieces = steps.withColumn("piece", F.sum(starts).over(far)).where("hide")
    return pieces.groupBy(*keys, "piece").agg(F.min("at").alias("start"), F.max("end").alias("end"), F.min("rank").alias("rank")).select(*keys, "start", "end", F.coalesce(*[F.when(F.col("rank") == i, F.lit(k)) for i, k in enumerate(PERSONAL)], F.lit(OTHER)).alias("kind"))


def mask_documents(docs: DataFrame, terms: DataFrame | None = None, keys: tuple[str, ...] = ("doc_id",), text: str = "text", how: str = "left") -> DataFrame:
    """docs with masked: the text with personal data and denied terms replaced by [kind], protected text kept to the letter (a denied term inside it is masked).

    A null text stays null. Texts with spans meet their pieces in a join on keys and text; rows equal in both have equal pieces. how="inner" leaves only texts with pieces.
    """
    rows = _keyed(docs, keys, text)
    on = [*keys, "__row"]
    pieces = mask_intervals(_personal(rows, terms, keys), _located(rows, PROTECTED, keys), on)
    per = pieces.groupBy(*on).agg(F.array_sort(F.collect_list(F.struct("start", "end", "kind"))).alias("__pieces")).withColumnsRenamed({k: f"__b_{k}" for k in on})
    joined = docs.withColumn("__h", F.xxhash64(text))
    match = F.col("__h") == F.col("__b___row")
    for k in keys:
        match &= F.col(k).eqNullSafe(F.col(f"__b_{k}"))
    joined = joined.join(per, match, how)
    before = F.transform("__pieces", lambda p, i: F.concat(F.substring(F.col(text), F.coalesce(F.get("__pieces", i - 1)["end"], F.lit(0)) + 1, p["start"] - F.coalesce(F.get("__pieces", i - 1)["end"], F.lit(0))), F.lit("["), p["kind"], F.lit("]")))
    tail = F.substring(F.col(text), F.get("__pieces", F.size("__pieces") - 1)["end"] + 1, F.length(text))
    return joined.select(*docs.columns, F.when(F.col("__pieces").isNull(), F.col(text)).otherwise(F.concat(F.array_join(before, ""), tail)).alias("masked"))


def mask_audit(docs: DataFrame, terms: DataFrame | None = None, keys: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """One row: n_texts, n_masked (texts that masking changed), n_survivors (spans of the masked texts outside protected text), n_protected and n_kept (protected spans before, and those of them still there).

    A protected span is still there if its text occurs as often as before; those that a denied term breaks are not. A text without pieces is left as it is, so
    nothing survives in it and all its protected spans are there: only texts with pieces are masked and read again, and they are kept for that.
    """
    done = mask_documents(docs.select(*keys, text), terms, keys, text, "inner").persist()
    again = _keyed(done, keys, "masked")
    inside = _same_row(keys) & (F.col("b.start") < F.col("a.start") + F.length("a.found")) & (F.col("a.start") < F.col("b.start") + F.length("b.found")) & (F.col("a.kind") != OTHER)
    left = _personal(again, terms, keys).alias("a").join(_located(again, PROTECTED, keys).alias("b"), inside, "left_anti")
    counted = lambda d, n: d.groupBy("kind", "found").agg(F.count("*").alias(n))
    was, now = counted(spans(done, PROTECTED, keys, text), "n"), counted(spans(done, PROTECTED, keys, "masked"), "m")
    lost = was.join(now, ["kind", "found"], "left").agg(F.coalesce(F.sum(F.col("n") - F.least("n", F.coalesce("m", F.lit(0)))), F.lit(0)).alias("lost"))
    held = sum((F.regexp_count(text, F.lit(p)).cast("long") for p in PROTECTED.values()), F.lit(0))
    sums = docs.agg(F.count(text).alias("n_texts"), F.coalesce(F.sum(held), F.lit(0)).alias("n_protected"))
    out = _one_row(sums, done.agg(F.count_if(F.col(text) != F.col("masked")).alias("n_masked")), left.agg(F.count("*").alias("n_survivors")), lost)
    return out.select("n_texts", "n_masked", "n_survivors", "n_protected", (F.col("n_protected") - F.col("lost")).alias("n_kept"))


def _one_row(*rows: DataFrame) -> DataFrame:
    """The columns of tables of one row each, side by side."""
    out = rows[0].withColumn("__one", F.lit(1))
    for r in rows[1:]:
        out = out.join(r.withColumn("__one", F.lit(1)), "__one")
    return out.drop("__one")


def span_boxes(rows: DataFrame, pad: int = 2) -> DataFrame:
    """rows (text, start, found, x0, x1, y0, y1) with the span's share of the line's box, one character to each side, padded and clipped to the line."""
    n = F.greatest(F.length("text"), F.lit(1))
    width = (F.col("x1") - F.col("x0")) / n
    left = F.col("x0") + width * (F.col("start") - 1) - pad
    right = F.col("x0") + width * (F.col("start") + F.length("found") + 1) + pad
    return rows.withColumns({"bx0": F.greatest(left, F.col("x0").cast("double")), "bx1": F.least(right, F.col("x1").cast("double")), "by0": F.col("y0"), "by1": F.col("y1")})


def overlap_area(a: str, b: str) -> Column:
    w = F.least(f"{a}.x1", f"{b}.x1") - F.greatest(f"{a}.x0", f"{b}.x0")
    h = F.least(f"{a}.y1", f"{b}.y1") - F.greatest(f"{a}.y0", f"{b}.y0")
    return F.when((w > 0) & (h > 0), w * h).otherwise(0)


def overlap_join(a: DataFrame, b: DataFrame, share: float = 0.0) -> DataFrame:
    """Pairs of boxes of one page (doc, page) that overlap by more than a share of b: an equi-join on the page with inequality residuals."""
    x, y = a.alias("a"), b.alias("b")
    area = (F.col("b.x1") - F.col("b.x0")) * (F.col("b.y1") - F.col("b.y0"))
    on = (F.col("a.doc") == F.col("b.doc")) & (F.col("a.page") == F.col("b.page")) & (overlap_area("a", "b") > share * area)
    return x.join(y, on)


def mask_conflicts(boxes: DataFrame, protected: DataFrame) -> DataFrame:
    """doc, page, box_id, kinds of protected boxes of which a mask covers over 15%."""
    return overlap_join(boxes, protected, 0.15).groupBy("a.doc", "a.page", "a.box_id").agg(F.array_join(F.array_sort(F.collect_set("b.kind")), ",").alias("kinds"))


def dedupe_boxes(boxes: DataFrame) -> DataFrame:
    """Boxes of each page without those of which 90% lies in a kept larger one: by falling area, greedily, as an ordered fold."""
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    ordered = F.array_sort(F.collect_list(F.struct((-area).alias("rank"), "box_id", "x0", "y0", "x1", "y1")))

    def step(kept, b):
        size = (b["x1"] - b["x0"]) * (b["y1"] - b["y0"])
        inside = F.exists(kept, lambda k: F.greatest(F.lit(0), F.least(k["x1"], b["x1"]) - F.greatest(k["x0"], b["x0"])) * F.greatest(F.lit(0), F.least(k["y1"], b["y1"]) - F.greatest(k["y0"], b["y0"])) >= 0.9 * size)
        return F.when(inside, kept).otherwise(F.concat(kept, F.array(b)))

    per = boxes.groupBy("doc", "page").agg(ordered.alias("o"))
    kept = F.aggregate("o", F.slice("o", 1, 0), step)
    return per.select("doc", "page", F.inline(kept)).drop("rank")


def label_value_lines(labels: DataFrame, lines: DataFrame, below: int = 1) -> DataFrame:
    """doc, page, label_no, line_no, place for labels without a value on their line: the nearest line to the right that shares half of its height, else up to
    `below` lines under it, each within 1.2 heights of the one before and overlapping it in x. Lines and labels have boxes x0, y0, x1, y1 and line_no.

    Pairs of one page meet by an equi-join; the chain below is an ordered fold over the page's lines of one label.
    """
    a = labels.select("doc", "page", *[F.col(c).alias(f"l_{c}") for c in ("line_no", "x0", "y0", "x1", "y1")])
    pairs = a.join(lines.select("doc", "page", "line_no", "x0", "y0", "x1", "y1"), ["doc", "page"]).where("line_no <> l_line_no")
    shared = F.least("l_y1", "y1") - F.greatest("l_y0", "y0")
    beside = pairs.where((F.col("x0") >= F.col("l_x1")) & (2 * shared > F.least(F.col("l_y1") - F.col("l_y0"), F.col("y1") - F.col("y0"))))
    right = beside.groupBy("doc", "page", "l_line_no").agg(F.min(F.struct("x0", "line_no"))["line_no"].alias("line_no"))
    under = pairs.where("y0 >= l_y1").join(right.select("doc", "page", "l_line_no"), ["doc", "page", "l_line_no"], "left_anti")
    rows = under.groupBy("doc", "page", "l_line_no", "l_x0", "l_x1", "l_y0", "l_y1").agg(F.array_sort(F.collect_list(F.struct("y0", "line_no", "x0", "x1", "y1"))).alias("o"))
    start = F.struct(F.col("l_y1").alias("y1"), (F.col("l_y1") - F.col("l_y0")).alias("h"), F.array().cast("array<bigint>").alias("found"))

    def step(t, b):
        near = (b["y0"] - t["y1"] <= 1.2 * t["h"]) & (b["x0"] < F.col("l_x1")) & (b["x1"] > F.col("l_x0")) & (F.size(t["found"]) < below)
        return F.when(near, F.struct(b["y1"].alias("y1"), (b["y1"] - b["y0"]).alias("h"), F.concat(t["found"], F.array(b["line_no"].cast("bigint"))).alias("found"))).otherwise(t)

    down = rows.select("doc", "page", "l_line_no", F.explode(F.aggregate("o", start, step, lambda t: t["found"])).alias("line_no"), F.lit("below").alias("place"))
    return right.select("doc", "page", "l_line_no", F.col("line_no").cast("bigint").alias("line_no"), F.lit("right").alias("place")).unionByName(down).withColumnRenamed("l_line_no", "label_no")


def coalesce_rects(rects: DataFrame, gap: int = 20, least_area: int = 400) -> DataFrame:
    """doc, page, x0, y0, x1, y1: rectangles (with box_id) of a page joined, in the order of box_id, into the first one within `gap`; small results dropped."""
    box = lambda r: F.struct(*[r[c].cast("bigint").alias(c) for c in ("x0", "y0", "x1", "y1")])

    def step(kept, b):
        near = lambda k: (k["x0"] - gap <= b["x1"]) & (b["x0"] - gap <= k["x1"]) & (k["y0"] - gap <= b["y1"]) & (b["y0"] - gap <= k["y1"])
        at = F.aggregate(F.transform(kept, lambda k, i: F.when(near(k), i)), F.lit(None).cast("int"), lambda t, i: F.coalesce(t, i))
        joined = lambda k: F.struct(F.least(k["x0"], b["x0"]).alias("x0"), F.least(k["y0"], b["y0"]).alias("y0"), F.greatest(k["x1"], b["x1"]).alias("x1"), F.greatest(k["y1"], b["y1"]).alias("y1"))
        return F.transform(F.array(at), lambda j: F.when(j.isNull(), F.concat(kept, F.array(box(b)))).otherwise(F.transform(kept, lambda k, i: F.when(i == j, joined(k)).otherwise(k))))[0]

    per = rects.groupBy("doc", "page").agg(F.array_sort(F.collect_list(F.struct("box_id", "x0", "y0", "x1", "y1"))).alias("o"))
    kept = F.aggregate("o", F.array().cast("array<struct<x0:bigint,y0:bigint,x1:bigint,y1:bigint>>"), step)
    return per.select("doc", "page", F.inline(kept)).where((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) > least_area)


def clean_boxes(boxes: DataFrame, width: int, height: int, kinds: tuple[str, ...]) -> DataFrame:
    """Corners sorted and clipped, boxes under two pixels dropped, unknown kinds made manual."""
    lo = lambda a, b: F.greatest(F.least(a, b), F.lit(0))
    out = boxes.withColumns({"x0": lo("x0", "x1"), "x1": F.least(F.greatest("x0", "x1"), F.lit(width)), "y0": lo("y0", "y1"), "y1": F.least(F.greatest("y0", "y1"), F.lit(height))})
    return out.where("x1 - x0 >= 2 and y1 - y0 >= 2").withColumn("kind", F.when(F.col("kind").isin(*kinds), F.col("kind")).otherwise("manual"))


def page_warnings(lines: DataFrame) -> DataFrame:
    """doc, page, warnings: no_text_layer under 20 characters, low_confidence under a mean of 75."""
    per = lines.groupBy("doc", "page").agg(F.sum(F.length("text")).alias("chars"), F.avg("confidence").alias("mean"))
    w = F.array_compact(F.array(F.when(F.col("chars") < 20, "no_text_layer"), F.when(F.col("mean") < 75, "low_confidence")))
    return per.select("doc", "page", F.array_join(w, ",").alias("warnings")).where("warnings <> ''")


def release_ready(state: DataFrame, sources: DataFrame) -> DataFrame:
    """doc, ready, reason: source unchanged, all pages approved, nothing unresolved, in that order."""
    j = state.join(sources.select("doc", F.col("hash").alias("now")), "doc", "left").groupBy("doc").agg(F.min(F.col("hash").eqNullSafe(F.col("now"))).alias("same"), F.min("approved").alias("approved"), F.sum("unresolved").alias("open"))
    reason = F.when(~F.col("same"), "source_changed").when(~F.col("approved"), "not_approved").when(F.col("open") > 0, "unresolved")
    return j.select("doc", reason.isNull().alias("ready"), reason.alias("reason"))
