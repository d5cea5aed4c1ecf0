"""What showed only on larger tables: zeros in ratios, long numbers before units, and results kept through cheaper plans."""

from pyspark.sql import functions as F

from ledgerline.functions import text as T
from ledgerline.operators import checks, evaluate, extract, merge, pii, review
from ledgerline.plans import queries
from ledgerline.sources import bindings


def test_subsidies_equal_to_the_total_divide_nothing(spark):
    names = "base gst total net central state_subsidy combined unspecified discount stated_kw w_lo count_least count_most watt_least watt_most inv_least inv_most".split()
    zero = dict.fromkeys(names, 0.0) | dict(total=78000.0, central=78000.0, net=142000.0, base=70000.0, gst=8000.0, stated_kw=3.0, count_least=6.0, count_most=6.0, watt_least=500.0, watt_most=500.0, inv_least=3.0, inv_most=3.0)
    rows = [(1, *[zero[n] for n in names], True, False), (2, *[(zero | {"net": 0.0, "total": 0.0, "base": 0.0, "gst": 0.0})[n] for n in names], True, False)]
    view = spark.createDataFrame(rows, "quote_id int, " + ", ".join(f"{n} double" for n in names) + ", all_exact boolean, inv_off boolean")
    assert {(r.quote_id, r.field) for r in review.guard_entries(view).collect()} == {(2, "base"), (2, "total"), (2, "net")}


def test_long_numbers_before_a_unit_are_masked(spark):
    texts = {1: "a 4183418637171908 no con", 2: "1234 5678 9012 nos, 12 nos", 3: "98765 43210 sets", 4: "12 nos of 12345678 panels", 5: "1234 56789012 units"}
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.masked for r in pii.mask_documents(d).collect()}
    assert got == {1: "a [long_number] no con", 2: "[id_number] nos, 12 nos", 3: "[phone] sets", 4: texts[4], 5: "[id_number] units"}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _table(spark, rows):
    cells = [("d", 1, 1, r, c, text, 90, False) for r, row in enumerate(rows, 1) for c, text in enumerate(row, 1)]
    return spark.createDataFrame(cells, "doc string, page int, table int, row int, col int, text string, confidence int, row_merged boolean")


def test_table_cells_are_dealt_out_once(spark):
    """Before, each of these moved all cells four times or more and read a price twice."""
    grid = _table(spark, [["Option", "Capacity", "Total price"], ["A", "3 kWp", "Rs. 180000/-"], ["B", "5", "Rs 2,50,000"], ["C", "", "Rs 1"]])
    for made in (extract.option_rows(grid), extract.bom_rows(grid), extract.amount_rows(grid)):
        assert _plan(made).count("Exchange hashpartitioning") == 1
    extra = spark.createDataFrame([("d", 1, 1, 2, 9, "no header", 90, False), ("d", 1, 1, None, 1, "no row", 90, False)], grid.schema)
    rows = {r.row: [(c.col, c.kind, c.header) for c in r.cells] for r in extract.row_cells(grid.unionByName(extra)).collect()}
    assert set(rows) == {2, 3, 4} and rows[2] == [(1, "option", "Option"), (2, "rating", "Capacity"), (3, "amount", "Total price")]


def test_only_texts_with_a_term_are_cut_into_places(spark):
    """Before, every text was: its words, each with those after it, went through the join."""
    terms = spark.createDataFrame([("asha rao", "deny"), ("acme", "keep")], "term string, kind string")
    d = spark.createDataFrame([(1, "asha, RAO asha rao"), (1, "asha, RAO asha rao"), (2, "asha was rao"), (3, "x " * 5000), (None, "Acme")], "doc_id long, __text string")
    edges = terms.select(F.split("term", " ").alias("units"), F.split("term", " ")[0].alias("unit"))
    assert sorted(r["__text"] for r in pii._with_some_term(d, edges, ("doc_id",)).collect()) == ["Acme", "asha, RAO asha rao", "asha, RAO asha rao"]
    assert pii.term_spans(d, terms, text="__text").count() == 5


def test_audit_reads_again_only_texts_with_pieces(spark):
    d = spark.createDataFrame([(1, "me@acme.example 5 kW"), (2, "12 nos"), (3, None)], "doc_id long, text string")
    audit = pii.mask_audit(d)
    assert "InMemoryTableScan" in audit._jdf.queryExecution().executedPlan().toString()
    assert tuple(audit.first()) == (2, 1, 0, 2, 2)


def test_readings_without_a_sign_of_what_is_read(spark):
    """Cells of a mark and a number, and texts without signs of a denial, take a short way to the same values."""
    texts = ["Rs. 12345/-", "₹5", "rs 007", "Rs 1,23,456/-", "no digits", "", None, "Rs 5 lakh", "12345"]
    got = [r.a and [float(x) for x in r.a] for r in spark.createDataFrame([(x,) for x in texts], "t string").select(T.line_amounts(F.col("t")).alias("a")).collect()]
    assert got == [[12345], [5], [7], [123456], [], [], [], [500000], [12345]]
    lines = {"5 Nos modules": False, "n'il": True, "No subsidy": True, "paid by the client": True, "Customer's scope": True, "baby client": False, "": False}
    rows = spark.createDataFrame(list(lines.items()), "t string, want boolean").select("t", "want", T.denied(F.col("t")).alias("no"), T.says(T.meanings(F.col("t")), "denied", "aside_denied").alias("full")).collect()
    assert all(r.no == r.full == r.want for r in rows)
    assert T.meanings(F.lit("x"))._jc.toString().count("?<=") == 0


def test_models_are_compared_over_one_set_of_scores(spark):
    """Before, the scores were computed once for each model."""
    plan = queries.QUERIES["model_comparison"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    scores = queries.QUERIES["score_fields"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == scores.count("Relation [") > 0


def _stages(df):
    """What a plan deals out, without what it broadcasts."""
    return [x.split("], plan_id")[0] for x in _plan(df).splitlines() if "Exchange hashpartitioning" in x]


def test_large_tables_are_dealt_by_document_before_rows_are_made(spark, monkeypatch):
    """Before, the tasks of a window stayed as many as the session's shuffle partitions, and the rows made of a table went through an exchange of their own."""
    sf = "/root/testdata/sf0.001"
    small = extract.line_sections(bindings.bound(spark, sf, "lines")).orderBy("doc", "line_no").collect()
    monkeypatch.setattr(bindings, "ROWS_A_TASK", 300)
    large = extract.line_sections(bindings.bound(spark, sf, "lines"))
    assert large.orderBy("doc", "line_no").collect() == small
    assert [x.split("hashpartitioning")[1][:12] for x in _stages(large)] == ["(o_orderkey#"]
    assert large.rdd.getNumPartitions() == 30 and bindings.bound(spark, sf, "facts").rdd.getNumPartitions() == bindings.bound(spark, sf, "quotes").rdd.getNumPartitions() > 8


def test_operands_meet_no_exchange_by_their_names(spark):
    """Before, all operands of one name went to one task, to meet the few rows of its formula."""
    ops = spark.createDataFrame([(1, "C3a", "base", 5.0), (1, "C3a", "total", 5.5), (2, "C3a", "base", 5.0), (3, "C3a", "base", None), (4, "C3a", "other", 1.0), (None, "C3a", "base", 1.0)], "doc int, check string, operand string, value double")
    found = spark.createDataFrame([(0, 1, "C3a", "consistent"), (0, 1, "C3a", "consistent"), (1, 2, "C3a", "consistent"), (1, 3, "C3a", "consistent"), (1, 4, "C3a", "consistent"), (1, None, "C3a", "consistent")], "set int, doc int, check string, status string")
    out = evaluate.recheck_long(ops, found)
    assert sorted(map(tuple, out.collect())) == [(0, "C3a", 2, 0), (1, "C3a", 0, 1)]
    assert not any("operand#" in x for x in _stages(out)) and "SortMergeJoin" not in _plan(out)


def test_items_are_grouped_once_with_their_batches(spark):
    """Before, items were read twice and joined with their own batches."""
    rows = [("d", "a", 1), ("d", "a", 2), ("d", "b", 1), ("d", "c", None), ("e", "a", None), ("f", None, 3), ("f", None, 3), (None, "a", 1)]
    out = merge.match_items(spark.createDataFrame(rows, "doc string, value string, batch int"))
    want = [("d", "a", True, 1), ("d", "b", False, 1), ("d", "c", False, 1), ("e", "a", False, 1), ("f", None, True, 1), ("f", None, True, 2)]
    assert sorted(map(tuple, out.collect()), key=str) == want
    assert "Join" not in _plan(out)


def test_gated_answers_are_dealt_once_to_meet_their_evidence(spark):
    """Before, evidence was dealt by answer and wanted text and then by answer; a line of text had a row in each square of its width."""
    a = spark.createDataFrame([("d", 1, 1, "Rs 5000", 90, 20, 2, 70, 10), ("d", 1, 2, "5000 only", 90, 300, 2, 340, 10)], "doc string, page int, answer_id int, raw string, confidence int, x0 int, y0 int, x1 int, y1 int")
    lines = spark.createDataFrame([("d", 1, 1, "Total Rs 5000", 90, 0, 0, 250, 15)], "doc string, page int, line_no int, text string, confidence int, x0 int, y0 int, x1 int, y1 int")
    for tasks in (None, 3):
        out = extract.gate_answers(a, lines, tasks=tasks)
        assert [(r.answer_id, r.why) for r in out.orderBy("answer_id").collect()] == [(1, None), (2, "not_on_page")]
        assert not any("wanted#" in x for x in _stages(out))
        assert tasks is None or any(", 3)" in x for x in _stages(out))
    assert extract.overlapping(lines.withColumn("id", F.lit(1)), lines).count() == 1


def test_amounts_that_are_plain_or_none_take_a_short_way(spark):
    want = {"Rs 123": 123, "RS. 5/-": 5, "₹7 ": 7, "INR12": 12, " 8 /-": 8, "123456789012345": None, "Rs 1,23,456 only": 123456, "1.5 Lakhs": 150000, "２ lacs": 200000, "4 kW": None, "only 3": None, "5 ONLY": 5, "rs": None, "1,2,3": None, "9 rs.": 9, "7/=": 7}
    got = {r.t: r.p for r in spark.createDataFrame([(x,) for x in want], "t string").select("t", T.parse_amount(F.col("t")).alias("p")).collect()}
    assert {t: p.parsed and float(p.parsed) for t, p in got.items()} == want
    assert {t: p.parse_status for t, p in got.items() if p.parsed is None} == {"123456789012345": "ambiguous", "4 kW": "ambiguous", "only 3": "ambiguous", "rs": "unparseable", "1,2,3": "ambiguous"}
    plan = evaluate.score_special(*[spark.createDataFrame([("d", "subsidy", "central", "Rs 5", False)], "doc string, field string, kind string, value string, conflict boolean")] * 2)
    assert plan.first().status == "correct" and str(plan._jdf.queryExecution().optimizedPlan()).count("lakhs?|lacs?") <= 4


def test_row_boxes_of_large_tables_meet_where_they_are(spark, monkeypatch):
    """Before, all cells were dealt by row once more to be gathered, over as many tasks as the session has."""
    monkeypatch.setattr(bindings, "ROWS_A_TASK", 300)
    out = queries.QUERIES["row_evidence"](spark, "/root/testdata/sf0.001")
    assert "Exchange hashpartitioning" in _plan(out) and "ENSURE_REQUIREMENTS" not in _plan(out)


def test_readings_and_labels_meet_in_one_group(spark):
    """Before, merged fields were computed for the readings and for the labels, and joined."""
    pred = spark.createDataFrame([("d", "a", "3 kW", False), ("d", "b", None, False), (None, "a", "1", False), ("d", "c", "1", True)], "doc string, field string, value string, conflict boolean")
    truth = spark.createDataFrame([("d", "a", "3000 W"), ("d", "b", "x"), (None, "a", "1"), ("e", "a", None)], "doc string, field string, value string")
    out = evaluate.score_fields(pred, truth)
    assert sorted(map(tuple, out.collect()), key=str) == sorted([("d", "a", "correct"), ("d", "b", "missing"), (None, "a", "not_labelled"), (None, "a", "missing"), ("d", "c", "not_labelled"), ("e", "a", "abstained")], key=str)
    assert "Join" not in _plan(out)
    assert queries.QUERIES["score_rollup"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1


SF = "/root/testdata/sf0.001"


def test_a_quotations_lines_are_numbered_and_summed_once(spark):
    """Before, items, charges and inverters each numbered all lines, items four times; findings were taken apart and gathered again."""
    for name in ("finding_summary", "vendor_questions", "vendor_messages"):
        plan = _plan(queries.QUERIES[name](spark, SF))
        assert plan.count("Window [row_number") == 1 and plan.count("Scan parquet") <= 4 and plan.count("Generate") == (name == "vendor_questions"), name
        assert "pivotfirst" not in plan


def test_parts_side_by_side_or_under_each_other_give_one_view(spark):
    d = checks.dims(spark)
    quotes, items, charges, inverters, answers, parts = (bindings.bound(spark, SF, t) for t in ("quotes", "items", "charges", "inverters", "answers", "parts"))
    view = lambda p: checks.quote_view(quotes, p, answers, d["state"], d["slab"])
    apart = view(checks.quote_parts(items, charges, inverters))
    assert apart.count() == quotes.count() and apart.exceptAll(view(parts)).isEmpty() and view(parts).exceptAll(apart).isEmpty()
    none = view(parts.where("false")).select("n_groups", "n_inverters", "any_outside", "has_net_meter", "inside", "panel_options", "outside_charges", "option_state")
    assert {tuple(r)[:7] for r in none.distinct().collect()} == {(None,) * 7} and {r.option_state for r in none.collect()} == {"selected", "single", "unknown"}
    # the only option of the items is the quotation's, and an inverter of another one is not
    one = parts.where("item is not null").limit(1).select("quote_id", F.col("item").withField("option_id", F.lit("A")).alias("item"), F.col("inverter").withField("option_id", F.lit("B")).alias("inverter"), "charge")
    row = view(one).where("n_groups is not null").first()
    assert (row.option_id, row.n_groups, row.n_inverters, row.inv_make_absent, row.inverter_options) == ("A", 1, None, None, None)


def test_findings_row_by_row_are_those_gathered(spark):
    view = queries._view(spark, SF)
    found = checks.run_checks(view)
    for gathered, by_row in ((checks.finding_summary(found), checks.view_summary(view)), (checks.vendor_questions(found), checks.view_questions(view)), (checks.vendor_message(checks.vendor_questions(found)), checks.view_messages(view))):
        assert gathered.dtypes == by_row.dtypes and sorted(gathered.collect()) == sorted(by_row.collect())


def test_states_in_capitals_of_any_alphabet(spark):
    names = ["SIKKIM", "sI\u212a\u212aim", "Jammu & KASHMIR", "\u0130", None]
    got = checks.state_category(spark.createDataFrame([(n,) for n in names], "state string"), checks.dims(spark)["state"]).collect()
    assert {r.state: r.state_name for r in got} == dict(zip(names, ["Sikkim", "Sikkim", "Jammu and Kashmir", None, None], strict=True))
    assert "lower(label" not in _plan(queries.finding_summary(spark, SF))


def test_rows_of_cells_are_made_once_for_all_readings(spark):
    """Before, each of the three readings of tables gathered the cells again: only the cells themselves were shared."""
    df = queries.QUERIES["extract_pages"](spark, "/root/testdata/sf0.001")
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    shared = [x for x in final.splitlines() if "ReusedExchange" in x and "least" in x and "hashpartitioning(table#" in x]
    assert "isFinalPlan=true" in final and len(shared) == 2


def test_texts_without_a_sign_of_a_role_name_none(spark):
    """Each phrase that names a role, whole and with an apostrophe, has a sign; the reading behind the sign gives the same as without it."""
    texts = ["Net cost", "Effective price", "Post subsidy", "After the CFA", "cost before MNRE subsidy", "Basic", "Base value", "Taxable amount", "Sub total", "Before GST", "CGST", "Grand t'otal", "Amount payable", "Make 3 panels", "Price", "", None, "Ne't price", "no subsidy", "Rate of the cable"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = df.select(T.price_role(F.col("t")).alias("a"), T.role_of(T.meanings(F.col("t"))).alias("b")).collect()
    assert [r.a for r in got] == [r.b for r in got] and len({r.a for r in got}) == 6
