"""Block tables and text lines to typed facts with evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions import text as T

KINDS = (("skip", "\\b(?:s\\.? ?no|sr)\\b"), ("qty", "\\bqty|quantity|nos\\b"), ("make", "\\bmake|brand\\b"), ("option", "\\boption\\b"), ("input", "\\binput\\b"), ("rating", "\\brating|capacity|watt"), ("desc", "\\bdescription|item|particular"), ("amount", "\\bamount|price|cost|rate\\b"))


def block_children(edges: DataFrame, blocks: DataFrame, kind: str = "CHILD") -> DataFrame:
    """Children of each block by one kind of edge, in listed order: equi-join on (doc, page, id)."""
    e = edges.where(F.col("kind") == kind).select("doc", "page", "parent_id", "pos", F.col("child_id").alias("id"))
    return e.join(blocks, ["doc", "page", "id"])


def block_text(edges: DataFrame, blocks: DataFrame) -> DataFrame:
    """doc, page, parent_id, text (words in order), confidence (least of the words)."""
    words = block_children(edges, blocks.where("block_type = 'WORD'"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "text")))
    return words.groupBy("doc", "page", "parent_id").agg(F.array_join(F.transform(ordered, lambda w: w["text"]), " ").alias("text"), F.min("confidence").alias("confidence"))


def table_grid(cells: DataFrame, merged: DataFrame) -> DataFrame:
    """cells (doc, page, table, row, col, text, confidence) where each merged cell (row, col, row_span, col_span) fills all it covers with joined text and least confidence."""
    cover = merged.select("doc", "page", "table", F.monotonically_increasing_id().alias("m"), F.explode(F.sequence("row", F.col("row") + F.col("row_span") - 1)).alias("row"), "col", "col_span", F.col("row_span").alias("__r"))
    cover = cover.select("doc", "page", "table", "m", "row", F.explode(F.sequence("col", F.col("col") + F.col("col_span") - 1)).alias("col"), (F.col("__r") > 1).alias("row_merged"))
    parts = cells.join(cover, ["doc", "page", "table", "row", "col"], "left")
    whole = parts.where("m is not null").groupBy("m").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "col", "text"))), lambda x: x["text"]), " ").alias("joined"), F.min("confidence").alias("least"))
    out = parts.join(whole, "m", "left")
    return out.select("doc", "page", "table", "row", "col", F.coalesce(F.trim("joined"), "text").alias("text"), F.coalesce("least", "confidence").alias("confidence"), F.coalesce("row_merged", F.lit(False)).alias("row_merged"))


def column_kind(header: Column) -> Column:
    h = F.lower(header)
    return F.coalesce(*[F.when(h.rlike(p), F.lit(k)) for k, p in KINDS])


def column_kinds(grid: DataFrame) -> DataFrame:
    """doc, page, table, col, header, kind: the first row is the header."""
    first = Window.partitionBy("doc", "page", "table")
    head = grid.withColumn("top", F.min("row").over(first)).where("row = top")
    return head.groupBy("doc", "page", "table", "col").agg(F.array_join(F.array_sort(F.collect_list("text")), " ").alias("header")).withColumn("kind", column_kind(F.col("header")))


NOT_OF_QUOTE = "\\b(?:valid|due|delivery|expiry|expires|install\\w*)\\b"


def line_readings(lines: DataFrame, *keep: str) -> DataFrame:
    """Each line's keep columns with what is read from its text: role, denied, amounts, count, measure and watts (of panels' units), date and which words it has.

    Patterns are read once a line: the generator keeps their results from being copied into each later use.
    """
    t, text = F.lower("text"), F.col("text")
    word = lambda p: t.rlike(f"\\b(?:{p})\\b")
    read = F.struct(
        F.when(t.rlike(f"{T.ROLE_SIGNS}|{T.DENIAL_SIGNS}"), T.meanings(text)).otherwise("").alias("__m"), T.line_amounts(text).alias("amounts"), word("panels?|modules?").alias("panel"), word("inverters?").alias("inverter"), word("system|plant|capacity|project|rooftop|solar pv").alias("size_word"),
        word("sets?|kits?|lots?|lump ?sum").alias("sets"), T.one_count(text).alias("count"), T.one_measure(text, ("kwp", "kw", "wp", "w")).alias("measure"), T.one_measure(text, ("wp", "w")).alias("watts"),
        F.when(word("dated?") & ~t.rlike(NOT_OF_QUOTE), T.one_date(text)).alias("date"),
    )
    rows = lines.select(*keep, F.inline(F.array(read)))
    return rows.select(*keep, F.inline(F.array(F.struct(T.role_of(F.col("__m")).alias("role"), T.says(F.col("__m"), "denied", "aside_denied").alias("denied")))), *[c for c in rows.columns if c not in (*keep, "__m")])


def line_candidates(lines: DataFrame, threshold: int = 50) -> DataFrame:
    """doc, page, line_no, field, value, evidence: one amount with its price role, panel count, panel wattage, system size, date of the quotation.

    A line that denies what it names gives nothing. A date that is one of validity, delivery or the like is not the quotation's.
    """
    rows = line_readings(lines.where((F.col("confidence") >= threshold) & F.col("text").rlike("[0-9]")), "doc", "page", "line_no", "text").where("not denied")
    item = lambda f, v, when: F.when(when, F.struct(f.alias("field"), v.cast("string").alias("value")))
    of_panel = F.col("panel") & ~F.col("inverter")
    all_ = F.array_compact(F.array(
        item(F.col("role"), F.get("amounts", F.lit(0)).cast("bigint"), F.col("role").isNotNull() & (F.size("amounts") == 1)),
        item(F.lit("panel_count"), F.col("count"), of_panel & (F.col("count") >= 2) & ~F.col("sets")),
        item(F.lit("panel_wattage"), F.col("watts").cast("bigint"), of_panel & F.col("watts").isNotNull()),
        item(F.lit("system_size"), F.col("measure").cast("bigint"), F.col("size_word") & ~F.col("panel") & ~F.col("inverter") & F.col("measure").isNotNull()),
        item(F.lit("quote_date"), F.col("date"), F.col("date").isNotNull()),
    ))
    return rows.select("doc", "page", "line_no", F.inline(all_), F.col("text").alias("evidence"))


SIZED = "\\b(?:capacity|size|system|kwp?)\\b"


def row_cells(grid: DataFrame) -> DataFrame:
    """doc, page, table, row, cells (array of col, kind, text, confidence, row_merged, header, sized in column order), least confidence and evidence: the rows under the header, with each column's
    kind, and whether its heading names a size.

    Cells are dealt out by table once; rows, and then the rows of a page's table with its header, are gathered where they are, so that a heading is read once a table.
    """
    names = ["doc", "page", "table"]
    cells = grid.where(" and ".join(f"{c} is not null" for c in (*names, "row", "col"))).repartition(*names)
    rows = cells.groupBy(*names, "row").agg(F.sort_array(F.collect_list(F.struct("col", "text", "confidence", "row_merged"))).alias("__cells"))
    tables = rows.groupBy(*names).agg(F.sort_array(F.collect_list(F.struct("row", "__cells"))).alias("__rows"))
    top = F.get("__rows", F.lit(0))["__cells"]
    header = lambda c: F.array_join(F.array_sort(F.transform(F.filter(top, lambda x: x["col"] == c), lambda x: x["text"])), " ")
    heads = F.transform(F.array_distinct(F.transform(top, lambda x: x["col"])), lambda c: F.struct(c.alias("col"), header(c).alias("header")))
    # each step is a column of its own: a generator keeps it from being copied into the functions of the next
    tables = tables.select("*", F.inline(F.array(F.struct(heads.alias("__heads")))))
    kinds = F.map_from_entries(F.transform("__heads", lambda h: F.struct(h["col"], F.struct(column_kind(h["header"]).alias("kind"), h["header"].alias("header"), F.lower(h["header"]).rlike(SIZED).alias("sized")))))
    tables = tables.select("*", F.inline(F.array(F.struct(kinds.alias("__kinds")))))
    body = tables.select(*names, "__kinds", F.inline(F.slice("__rows", F.lit(2), F.size("__rows"))))
    of = lambda x: F.try_element_at("__kinds", x["col"])
    named = F.transform(F.filter("__cells", lambda x: of(x).isNotNull()), lambda x: F.struct(x["col"].alias("col"), of(x)["kind"].alias("kind"), x["text"].alias("text"), x["confidence"].alias("confidence"), x["row_merged"].alias("row_merged"), of(x)["header"].alias("header"), of(x)["sized"].alias("sized")))
    rows = body.select(*names, "row", F.inline(F.array(F.struct(named.alias("cells"))))).where("size(cells) > 0")
    return rows.select("*", F.inline(F.array(F.struct(F.array_min("cells.confidence").alias("least"), _row_text().alias("evidence")))))


def _of_kind(kind: str) -> Column:
    return F.filter("cells", lambda x: (x["kind"] == kind) & (F.trim(x["text"]) != ""))


def _row_text() -> Column:
    return F.array_join(F.filter(F.transform("cells", lambda x: F.trim(x["text"])), lambda x: x != ""), " | ")


def option_rows(grid: DataFrame, threshold: int = 50, rows: DataFrame | None = None) -> DataFrame:
    """doc, page, table, row, capacity (watts), amount, role: tables with two rows or more that each offer a capacity of their own at a price.

    The capacity's column is headed by capacity, size, system or kW, and gives its unit to cells without one; the price's heading gives the role, or none.
    """
    sized = F.filter("cells", lambda x: x["sized"] & (F.trim(x["text"]) != ""))
    once = lambda *xs: F.inline(F.array(F.struct(*xs)))
    names = ["doc", "page", "table", "row"]
    rows = (row_cells(grid) if rows is None else rows).select(*names, once(sized.alias("r"), _of_kind("amount").alias("a"), F.col("least"), F.col("evidence"))).where("least is not null")
    one = rows.where("size(r) = 1 and size(a) = 1").select(*names, "evidence", F.get("r", F.lit(0)).alias("r"), F.get("a", F.lit(0)).alias("a"))
    read = one.where((F.col("r.confidence") >= threshold) & (F.col("a.confidence") >= threshold) & ~F.lower("evidence").rlike("\\b(?:inverter|module|panel|structure|cable|meter)s?\\b") & ~T.denied(F.col("evidence")))
    unit = F.concat("r.text", F.lit(" "), F.regexp_extract("r.header", "(?i)\\b(kwp|kw|wp|w)\\b", 1))
    measure = F.coalesce(*[T.one_measure(x, ("kwp", "kw", "wp", "w")) for x in (F.col("r.text"), unit)])
    read = read.select(*names, F.col("a.header").alias("header"), "evidence", once(measure.alias("capacity"), T.one_amount(F.col("a.text")).alias("amount"))).where("capacity is not null and amount is not null")
    table = Window.partitionBy("doc", "page", "table")
    kept = read.withColumns({"n": F.count("*").over(table), "k": F.size(F.collect_set("capacity").over(table))}).where("n >= 2 and n = k")
    return kept.select(*names, "capacity", "amount", T.price_role(F.col("header")).alias("role"), "evidence")


def bom_rows(grid: DataFrame, threshold: int = 50, rows: DataFrame | None = None) -> DataFrame:
    """doc, page, table, row, item (panel or inverter), count, rating (watts), make: rows of tables with one description and one quantity column.

    A quantity under two, counted in sets or from a cell that spans rows gives no count; rows that deny what they name give nothing.
    """
    columns = F.struct(_of_kind("desc").alias("d"), _of_kind("qty").alias("q"), _of_kind("rating").alias("r"), _of_kind("make").alias("m"), F.col("least"), F.col("evidence"))
    rows = (row_cells(grid) if rows is None else rows).select("doc", "page", "table", "row", F.inline(F.array(columns)))
    text = lambda c: F.get(c, F.lit(0))["text"]
    d, q = F.lower(text("d")), F.lower(text("q"))
    item = F.when(d.rlike("\\binverters?\\b"), "inverter").when(d.rlike("\\b(?:panels?|modules?)\\b"), "panel")
    rows = rows.where((F.size("d") == 1) & (F.size("q") == 1) & (F.col("least") >= threshold) & item.isNotNull() & ~T.denied(F.col("evidence")))
    number = T.parse_count(q)
    count = F.when((number >= 2) & ~q.rlike("\\b(?:sets?|kits?|lots?)\\b") & ~F.get("q", F.lit(0))["row_merged"], number)
    units = lambda c: F.when(item == "panel", T.one_measure(c, ("wp", "w"))).otherwise(T.one_measure(c, ("kw", "kwp", "kva")))
    rating = F.coalesce(units(text("r")), units(text("d"))).cast("bigint")
    return rows.select("doc", "page", "table", "row", item.alias("item"), count.alias("count"), rating.alias("rating"), F.trim(text("m")).alias("make"), "evidence", F.col("least").alias("confidence"))


def amount_rows(grid: DataFrame, threshold: int = 50, rows: DataFrame | None = None) -> DataFrame:
    """doc, page, table, row, role, amount: rows with one amount cell and a label that names one price role."""
    once = lambda *xs: F.inline(F.array(F.struct(*xs)))
    names = ["doc", "page", "table", "row"]
    cells = F.transform(F.filter("cells", lambda x: x["kind"] == "amount"), lambda x: F.struct(x["text"].alias("text"), T.line_amounts(x["text"]).alias("amounts")))
    label = F.filter("cells", lambda x: F.coalesce(x["kind"] != "amount", F.lit(True)) & (F.trim(x["text"]) != ""))
    read = F.when(F.col("least") >= threshold, F.struct(F.filter(cells, lambda x: F.size(x["amounts"]) > 0).alias("a"), label.alias("l"), F.col("row"), F.col("evidence")))
    rows = (row_cells(grid) if rows is None else rows).select(*names[:3], "least", F.inline(F.array_compact(F.array(read)))).where("row is not null and length(evidence) >= 0")
    one = rows.where("size(a) = 1 and size(l) > 0").select(*names, F.get("a", F.lit(0)).alias("cell"), F.array_join("l.text", " ").alias("label"), "evidence", "least")
    one = one.where((F.size("cell.amounts") == 1) & ~F.contains("cell.text", F.lit("%")))
    out = one.select(*names, F.get("cell.amounts", F.lit(0)).cast("bigint").alias("amount"), "evidence", F.col("least").alias("confidence"), once(T.price_role(F.col("label")).alias("role")))
    return out.select(*names, "role", "amount", "evidence", "confidence").where("role is not null and amount is not null")


def evidence_boxes(facts: DataFrame, lines: DataFrame, table_rows: DataFrame | None = None, tasks: int | None = None) -> DataFrame:
    """doc, page, fact_id, boxes: for each piece of a fact's evidence (split at line ends), the boxes of the page's lines, or table rows, with that text.

    table_rows: doc, page, text (the cells' texts joined by " | "), row and box, as row_boxes gives them. tasks: over how many pages are dealt.
    """
    tidy = lambda c: T.squeeze(c)
    pieces = facts.select("doc", "page", "fact_id", F.posexplode(F.split("evidence", "\n")).alias("n", "piece")).select("doc", "page", "fact_id", "n", tidy(F.col("piece")).alias("k")).where("k <> ''")
    box = ["x0", "y0", "x1", "y1"]
    places = lines.select("doc", "page", tidy(F.col("text")).alias("k"), F.col("line_no").cast("long").alias("line_no"), *box)
    if table_rows is not None:
        places = places.unionByName(table_rows.select("doc", "page", tidy(F.col("text")).alias("k"), F.col("row").cast("long").alias("line_no"), *box))
    page = ["doc", "page", "k"]
    found = T.dealt(pieces, tasks, *page).join(T.dealt(places, tasks, *page), page)
    return T.dealt(found, tasks, "doc", "page", "fact_id").groupBy("doc", "page", "fact_id").agg(F.array_sort(F.collect_list(F.struct("n", "line_no", *box))).alias("boxes"))


def row_boxes(cells: DataFrame) -> DataFrame:
    """doc, page, table, row, text, x0, y0, x1, y1: table rows as evidence quotes them, with the box around their cells (col, text and box)."""
    ordered = F.sort_array(F.collect_list(F.struct("col", F.trim("text").alias("t"))))
    text = F.array_join(F.filter(F.transform(ordered, lambda x: x["t"]), lambda x: x != ""), " | ")
    return cells.groupBy("doc", "page", "table", "row").agg(text.alias("text"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


GRID = 64
"""Height of the fields into which pages are cut to find boxes that overlap, in the boxes' unit."""


def overlapping(a: DataFrame, b: DataFrame, on: tuple[str, ...] = ("doc", "page"), grid: float = GRID, tasks: int | None = None) -> DataFrame:
    """Pairs of rows of a and b (aliases a and b) that share `on` and whose boxes x0, y0, x1, y1 overlap.

    Boxes meet in the fields that they touch, by an equi-join, and a pair counts only in the first field that both touch: no pair comes twice and
    no page is paired with itself. A box over many fields has a row in each; fields are four times as wide as high, as lines of text are wide.
    """

    def squares(df: DataFrame, own: str) -> DataFrame:
        cell = lambda c, side: F.floor(F.col(c) / side).cast("int")
        rows = df.where("x1 > x0 and y1 > y0").withColumns({f"__{own}x": cell("x0", 4 * grid), f"__{own}y": cell("y0", grid)})
        for g, c, side in (("__gx", "x", 4 * grid), ("__gy", "y", grid)):
            rows = rows.withColumn(g, F.explode(F.sequence(F.col(f"__{own}{c}"), F.ceil(F.col(f"{c}1") / side).cast("int") - 1)))
        return T.dealt(rows, tasks, *on, "__gx", "__gy").alias(own)

    same = (F.col("a.__gx") == F.col("b.__gx")) & (F.col("a.__gy") == F.col("b.__gy"))
    for k in on:
        same &= F.col(f"a.{k}") == F.col(f"b.{k}")
    first = (F.col("a.__gx") == F.greatest("a.__ax", "b.__bx")) & (F.col("a.__gy") == F.greatest("a.__ay", "b.__by"))
    touch = (F.least("a.x1", "b.x1") > F.greatest("a.x0", "b.x0")) & (F.least("a.y1", "b.y1") > F.greatest("a.y0", "b.y0"))
    return squares(a, "a").join(squares(b, "b"), same & first & touch)


def evidence_lines(answers: DataFrame, lines: DataFrame, grid: float = GRID, tasks: int | None = None) -> DataFrame:
    """doc, page, answer_id, evidence, least (their lowest confidence): the lines an answer (raw, and x0, y0, x1, y1 or nulls) stands on.

    With a box, the lines that it overlaps, from top to bottom, if their joined loose text holds the answer's; without one, the lines that hold it.
    """
    box = ["x0", "y0", "x1", "y1"]
    for c in box:
        if c not in answers.columns:
            answers = answers.withColumn(c, F.lit(None).cast("double"))
    asked = answers.select("doc", "page", "answer_id", T.loose_key(F.col("raw")).alias("wanted"), *box).where("wanted <> ''")
    if not set(box) <= set(lines.columns):
        lines = lines.withColumns({"x0": F.lit(0), "y0": F.col("line_no"), "x1": F.lit(1), "y1": F.col("line_no") + 1})
    shown = lines.select("doc", "page", "line_no", "text", "confidence" if "confidence" in lines.columns else F.lit(100).alias("confidence"), *box)
    line = F.struct("y0", "x0", "line_no", T.squeeze(F.col("text")).alias("text"), "confidence").alias("line")
    boxed = overlapping(asked.where("x0 is not null"), shown.withColumn("line", line), grid=grid, tasks=tasks).select("a.doc", "a.page", "a.answer_id", "a.wanted", "b.line")
    loose = T.dealt(asked.where("x0 is null").drop(*box), tasks, "doc", "page").join(T.dealt(shown.withColumns({"line": line, "__t": T.loose_key(F.col("text"))}), tasks, "doc", "page"), ["doc", "page"]).where(F.contains("__t", "wanted")).select("doc", "page", "answer_id", "wanted", "line")
    # dealt by answer, so that neither the group nor the answers' own join with it deals again
    both = boxed.unionByName(loose)
    both = both.repartition(*[tasks] * bool(tasks), "doc", "page", "answer_id")
    per = both.groupBy("doc", "page", "answer_id", "wanted").agg(F.array_sort(F.collect_list("line")).alias("ls"))
    per = per.where(F.contains(T.loose_key(F.array_join("ls.text", "")), F.col("wanted")))
    return per.select("doc", "page", "answer_id", F.array_join("ls.text", "\n").alias("evidence"), F.array_min("ls.confidence").alias("least"))


def gate_answers(answers: DataFrame, lines: DataFrame, threshold: int = 50, grid: float = GRID, tasks: int | None = None) -> DataFrame:
    """answers (doc, page, answer_id, raw, confidence, and as known field, kind and a box) with kept, why, evidence and the raw text that counts.

    kind: amount (where there is none), capacity, count, registration, dcr or text. why, the first of: low_confidence, unparsed (also where only a line's value would
    read and there is no line), not_on_page, low_confidence of a line, negated, not_an_amount_on_its_line, input_not_output (inverter_rating), gstin, unparsed.
    tasks: over how many answers and lines are dealt.
    """
    for name, kind in (("kind", "amount"), ("field", "")):
        if name not in answers.columns:
            answers = answers.withColumn(name, F.lit(kind))
    raw, is_ = F.col("raw"), lambda *k: F.col("kind").isin(*k)
    parses = F.when(is_("amount"), T.parse_amount(raw)["parse_status"] == "ok").when(is_("capacity"), T.parse_capacity(raw)["parse_status"] == "ok").when(is_("count"), T.parse_count(raw).isNotNull()).otherwise(T.squeeze(raw) != "")
    count = F.coalesce(T.one_count(raw), F.regexp_extract(F.lower(raw), "^\\s*([0-9]{1,3})\\s*(?:solar\\s+)?(?:panels?|modules?)\\s*$", 1).try_cast("int"))
    typed = F.when(is_("amount"), T.one_amount(raw).cast("string")).when(is_("capacity"), F.concat(T.one_measure(raw, ("kwp", "kw", "wp", "w", "kva")).cast("string"), F.lit(" W"))).when(is_("count"), count.cast("string"))
    # a typed value is looked for only where the text as a whole is none
    read = answers.select(*answers.columns, F.inline(F.array(F.struct(parses.alias("__ok")))))
    read = read.select("*", F.inline(F.array(F.struct(F.when(~F.coalesce("__ok", F.lit(False)), typed).alias("__typed"))))).withColumn("__raw", F.when(F.col("__ok"), raw).otherwise(F.coalesce("__typed", raw)))
    out = T.dealt(read, tasks, "doc", "page", "answer_id").join(evidence_lines(answers, lines, grid, tasks), ["doc", "page", "answer_id"], "left")
    ev = F.col("evidence")
    on_line = T.line_amounts(ev)
    off_line = ~F.array_contains(on_line, T.parse_amount(F.col("__raw"))["parsed"]) | ((F.col("field") == "subsidy") & (F.size(on_line) > 1) & (T.subsidy_kind(ev) == "combined"))
    text = F.lower(ev)
    checks = F.struct(T.denied(ev).alias("no"), F.coalesce(off_line, F.lit(True)).alias("off"), (text.rlike("\\b(?:input|max(?:imum)?|pv|dc)\\b") & ~text.rlike("\\b(?:rated|output|ac)\\b")).alias("input"))
    out = out.select(*out.columns, F.inline(F.array(checks)))
    why = (
        F.when(F.col("confidence") < threshold, "low_confidence").when(~F.coalesce("__ok", F.lit(False)) & (F.col("__typed").isNull() | ev.isNull()), "unparsed").when(ev.isNull(), "not_on_page").when(F.col("least") < threshold, "low_confidence")
        .when(F.col("no"), "negated").when(is_("amount") & F.col("off"), "not_an_amount_on_its_line").when((F.col("field") == "inverter_rating") & F.col("input"), "input_not_output")
        .when(is_("registration") & F.upper(F.regexp_replace(raw, "\\s", "")).rlike(f"^{T.GST_ID}$"), "gstin").when(is_("dcr") & T.dcr_statement(F.concat_ws("\n", raw, ev)).isNull(), "unparsed")
    )
    return out.select(*answers.columns, "evidence", F.col("__raw").alias("value"), why.alias("why"), why.isNull().alias("kept"))


def line_flags(lines: DataFrame) -> DataFrame:
    """doc, gst: included, excluded or unclear (both), null if neither; least confidence of such lines."""
    t = F.lower("text")
    inc, exc = t.rlike("gst included|inclusive of gst|incl\\.? gst"), t.rlike("gst extra|exclusive of gst|plus gst|gst amount")
    per = lines.groupBy("doc").agg(F.max(inc).alias("i"), F.max(exc).alias("e"), F.min(F.when(inc | exc, F.col("confidence"))).alias("confidence"))
    return per.select("doc", F.when(F.col("i") & F.col("e"), "unclear").when(F.col("i"), "included").when(F.col("e"), "excluded").alias("gst"), "confidence")


def option_headings(lines: DataFrame) -> DataFrame:
    labels = lines.select("doc", "page", F.upper(F.regexp_extract("text", "(?i)^\\s*option[ -]*([a-z0-9]+)\\b", 1)).alias("o")).where("o <> ''")
    return labels.groupBy("doc", "page").agg(F.array_join(F.array_sort(F.collect_set("o")), ",").alias("options"), (F.count_distinct("o") > 1).alias("unbindable"))


# Words that open a section, and words of a line that name a side
BUYER_HEADING = "^(?:buyer|customer|client|recipient|consignee|purchaser|consumer|sold to|bill(?:ed)? to|ship(?:ped)? to|to ?[,:]?$)"
SUPPLIER_HEADING = "^(?:(?:quotation )?from|supplier|vendor|seller|our)\\b"
BUYER_WORDS = "\\b(?:buyer|customer|client|recipient|consignee|purchaser|consumer|(?:sold|bill(?:ed)?|ship(?:ped)?) to)\\b"
SUPPLIER_WORDS = "\\b(?:supplier|vendor|seller|our)\\b"
HEADING_WORDS = 4
SAME_ROW = 0.02
"""Part of a page's height within which two headings stand side by side."""


def section_kind(c: Column) -> Column:
    """buyer or supplier where a text of a few words opens the section of one."""
    t = T.squeeze(F.lower(c))
    return F.when(F.size(F.split(t, " ")) <= HEADING_WORDS, F.when(t.rlike(BUYER_HEADING), "buyer").when(t.rlike(SUPPLIER_HEADING), "supplier"))


def line_sections(lines: DataFrame, height: float = 1.0) -> DataFrame:
    """Each line with its section: letterhead until the first heading, then the last heading's kind; unclear on pages without headings.

    A heading beside the one before it, of the other kind and within SAME_ROW of the page's height, makes what follows unclear, as both blocks' lines
    follow. height: a page's height in the unit of y0; lines without y0 stand beside nothing.
    """
    order = Window.partitionBy("doc", "page").orderBy("y0", "line_no")
    page = Window.partitionBy("doc", "page")
    rows = lines.select("*", F.inline(F.array(F.struct(section_kind(F.col("text")).alias("__kind")))))
    head = F.when(F.col("__kind").isNotNull(), F.struct(F.col("__kind").alias("kind"), F.col("y0").alias("top")))
    rows = rows.withColumn("__before", F.last(head, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    beside = (F.col("__before.kind") != F.col("__kind")) & (F.abs(F.col("y0") - F.col("__before.top")) < SAME_ROW * height)
    opened = F.when(F.col("__kind").isNotNull(), F.when(beside, "unclear").otherwise(F.col("__kind")))
    last = F.last(opened, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    any_ = F.max(F.col("__kind").isNotNull()).over(page)
    return rows.withColumn("section", F.when(~any_, "unclear").otherwise(F.coalesce(last, F.lit("letterhead")))).drop("__kind", "__before")


def supplier_state(lines: DataFrame, height: float = 1.0) -> DataFrame:
    """doc, state_code: of valid tax ids in the supplier's section, the letterhead or a line that names the supplier, and in no line that names the buyer; none if there are two."""
    t = F.lower("text")
    own = line_sections(lines, height).where(~t.rlike(BUYER_WORDS) & (t.rlike(SUPPLIER_WORDS) | F.col("section").isin("supplier", "letterhead")))
    ids = own.select("doc", F.explode(T.gst_ids(F.col("text"))).alias("id")).where(T.gst_id_valid(F.col("id")))
    return ids.groupBy("doc").agg(F.collect_set(F.substring("id", 1, 2)).alias("s")).where("size(s) = 1").select("doc", F.get("s", F.lit(0)).alias("state_code"))


def resolve_occurrences(cands: DataFrame) -> DataFrame:
    """Of several fields that claim one occurrence (doc, occurrence), the one its line names stays, else none."""
    w = Window.partitionBy("doc", "occurrence")
    out = cands.withColumn("n_fields", F.size(F.collect_set("field").over(w))).withColumn("named", F.collect_set(F.when(F.col("field") == F.col("line_role"), F.col("field"))).over(w))
    return out.where((F.col("n_fields") == 1) | (F.size("named") == 1) & F.array_contains("named", F.col("field"))).drop("n_fields", "named")


def distinct_values(cands: DataFrame) -> DataFrame:
    """First evidence of each distinct value of a field; values that measure the same are one."""
    first = F.row_number().over(Window.partitionBy("doc", "field", "__k").orderBy("pos", "value"))
    return T.with_comparable(cands).withColumn("r", first).where("r = 1").drop("r", "__k")


def attach_provenance(values: DataFrame, claims: DataFrame) -> DataFrame:
    """values (doc, field, value) with the sorted rules that claim them and the least confidence; no claim: unmatched."""
    per = claims.groupBy("doc", "field", "value").agg(F.array_join(F.array_sort(F.collect_set("rule")), ",").alias("rules"), F.min("confidence").alias("confidence"))
    return values.join(per, ["doc", "field", "value"], "left").withColumn("rules", F.coalesce("rules", F.lit("unmatched")))


def slot_provenance(values: DataFrame, claims: DataFrame) -> DataFrame:
    """values (doc, slot, evidence, raw) with the sorted rules of the claims on the same slot and evidence, and their least confidence; no claim: unmatched.

    claims: doc, slot, evidence, raw, rule, confidence. The raw texts have to agree loosely; one that is null, on either side, agrees with any.
    """
    keys = ["doc", "slot", "evidence"]
    mine = values.select(*keys, "raw").distinct().withColumn("__v", T.loose_key(F.col("raw")))
    said = claims.groupBy(*keys, T.loose_key(F.col("raw")).alias("__c")).agg(F.collect_set("rule").alias("__r"), F.min("confidence").alias("confidence"))
    hits = mine.join(said, keys).where("__v is null or __c is null or __v = __c").groupBy(*keys, "raw").agg(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("__r")))), ",").alias("rules"), F.min("confidence").alias("confidence"))
    hits = hits.withColumnsRenamed({c: f"__{c}" for c in hits.columns})
    out = values.join(hits, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in (*keys, "raw")], "left")
    return out.select(*values.columns, F.coalesce("__rules", F.lit("unmatched")).alias("rules"), F.col("__confidence").alias("confidence"))


def extract_pages(lines: DataFrame, grid: DataFrame, threshold: int = 50) -> DataFrame:
    """doc, page, option, list, item, field, value, evidence, rule, conflict: the facts of pages from their lines and tables, one row a value.

    Rows of cells are made once and dealt out again, so that the three readings of tables share them as one exchange: each takes all columns of the rows, and filters only
    what its own generator made.

    Lines and amount rows give fields of the quotation, material rows items of module_groups and inverters, offers fields of an option. A field of
    the quotation that is read with several values is a conflict, whichever rule read them.
    """
    none = F.lit(None).cast("string")
    names = ("option", "list", "item", "field", "value")
    fact = lambda *xs: F.struct(*[x.cast("string").alias(n) for n, x in zip(names, xs, strict=True)])
    rows = row_cells(grid).repartition("table", "page", "doc")  # in the order in which row_cells has dealt them it would be no exchange
    row = F.concat_ws("/", F.col("table").cast("string"), F.col("row").cast("string"))
    of_lines = line_candidates(lines, threshold).select("doc", "page", fact(none, none, none, F.col("field"), F.col("value")).alias("f"), "evidence", F.lit("line").alias("rule"))
    of_amounts = amount_rows(grid, threshold, rows).select("doc", "page", fact(none, none, none, F.col("role"), F.col("amount")).alias("f"), "evidence", F.lit("table").alias("rule"))
    kind = F.when(F.col("item") == "panel", "module_groups").otherwise("inverters")
    parts = F.array(fact(none, kind, row, F.lit("count"), F.col("count")), fact(none, kind, row, F.when(F.col("item") == "panel", "wattage").otherwise("rating"), F.col("rating")), fact(none, kind, row, F.lit("make_model"), F.col("make")))
    of_items = bom_rows(grid, threshold, rows).select("doc", "page", F.explode(parts).alias("f"), "evidence", F.lit("table").alias("rule"))
    offer = F.array(fact(row, none, none, F.lit("system_size"), F.col("capacity").cast("bigint")), F.when(F.col("role").isNotNull(), fact(row, none, none, F.col("role"), F.col("amount").cast("bigint"))))
    of_offers = option_rows(grid, threshold, rows).select("doc", "page", F.explode(F.array_compact(offer)).alias("f"), "evidence", F.lit("table").alias("rule"))
    facts = of_lines.unionByName(of_amounts).unionByName(of_items).unionByName(of_offers).select("doc", "page", "f.*", "evidence", "rule").where("value is not null and value <> ''")
    same = Window.partitionBy("doc", "field", "option", "list")
    several = F.col("option").isNull() & F.col("list").isNull() & (F.min("value").over(same) != F.max("value").over(same))
    return facts.select("doc", "page", *names, "evidence", "rule", several.alias("conflict"))


def bind_items(rows: DataFrame, loose: DataFrame) -> DataFrame:
    """loose (doc, field, value) against table rows (doc, field, value): confirmed, conflict where rows have the field, fill where there are none."""
    has = rows.select("doc", "field", F.lit(True).alias("has")).distinct()
    same = T.with_comparable(rows).select("doc", "field", "__k", F.lit(True).alias("same")).distinct()
    out = T.with_comparable(loose).join(has, ["doc", "field"], "left").join(same, ["doc", "field", "__k"], "left")
    return out.select("doc", "field", "value", F.when(F.col("same"), "confirmed").when(F.col("has"), "conflict").otherwise("fill").alias("binding"))


def bind_loose(rows: DataFrame, loose: DataFrame) -> DataFrame:
    """doc, item, field, value, binding: table rows (doc, item, field, value) with the loose answers (doc, field, nth, value) bound to them.

    row: as the table has it. A loose value equal to some row's confirms it and gives no row of its own. Else it is a conflict on each item of the document that has the field,
    and fills the field of the only item if that lacks it. Where a document has no table rows, the nth answers of all fields make the nth item: paired,
    or conflict where a field has several different nth answers. Values that measure the same are equal.
    """
    mine, said = (T.with_comparable(df.where("value is not null")) for df in (rows, loose))
    items = mine.groupBy("doc").agg(F.count_distinct("item").alias("n_items"), F.min("item").alias("only"))
    apart = said.join(mine.select("doc", "field", "__k").distinct(), ["doc", "field", "__k"], "left_anti").join(items, "doc").select("doc", "field", "value", "__k", "n_items", "only").dropDuplicates(["doc", "field", "__k"])
    clash = apart.join(mine.select("doc", "item", "field").distinct(), ["doc", "field"]).select("doc", "item", "field", "value", F.lit("conflict").alias("binding"))
    fills = apart.where("n_items = 1").join(mine.select("doc", "field").distinct(), ["doc", "field"], "left_anti")
    n = F.count("*").over(Window.partitionBy("doc", "field"))
    fills = fills.withColumn("__n", n).select("doc", F.col("only").alias("item"), "field", "value", F.when(F.col("__n") > 1, "conflict").otherwise("filled").alias("binding"))
    free = said.join(items.select("doc"), "doc", "left_anti").dropDuplicates(["doc", "field", "nth", "__k"])
    several = F.count("*").over(Window.partitionBy("doc", "field", "nth")) > 1
    paired = free.select("doc", F.col("nth").cast(rows.schema["item"].dataType).alias("item"), "field", "value", F.when(several, "conflict").otherwise("paired").alias("binding"))
    own = mine.select("doc", "item", "field", "value", F.lit("row").alias("binding"))
    return own.unionByName(clash).unionByName(fills).unionByName(paired)


def verify_evidence(facts: DataFrame, page_texts: DataFrame) -> DataFrame:
    """facts (doc, page, evidence) with status: text_matched, mismatch, or not_machine_verified where the page has no text."""
    pages = page_texts.select("doc", "page", T.evidence_key(F.col("text")).alias("__t"))
    key = T.evidence_key(F.col("evidence"))
    status = F.when(F.coalesce(F.col("__t"), F.lit("")) == "", "not_machine_verified").when(F.contains("__t", key), "text_matched").otherwise("mismatch")
    return facts.join(pages, ["doc", "page"], "left").withColumn("evidence_status", status).drop("__t")
