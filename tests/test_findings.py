"""Findings on the way to people: tokens of operand sets, notes, questions and the message around them, guards of charges."""

import datetime
import hashlib
import json

import pytest

from ledgerline.operators import checks, evaluate, review

FOUND = "quote_id int, check_id string, item string, gate int, status string, question string, params map<string,string>"
OPERAND = "quote_id int, check_id string, item string, nth int, field string, value string, raw string, provenance string, source string"


def token(check, item, option, operands):
    keys = ("field", "value", "raw", "provenance", "source")
    body = {"check": check, "item": item, "option": option, "operands": [dict(zip(keys, o, strict=True)) for o in operands]}
    return hashlib.sha256(json.dumps(body, sort_keys=True, ensure_ascii=False).encode()).hexdigest()[:24]


ROWS = [
    (1, "C3a", None, 1, "base_price", "100", 'Rs "100"\n\\-', None, '{"page": 1, "text": "x"}'), (1, "C3a", None, 0, "gross_total", "118", None, "typed", None),
    (2, "C4", "panel_count", 0, "count", None, "₹\t5", "read", None), (3, "C3a", None, 0, "base_price", "7", None, "read", None),
]


def current(spark, rows=ROWS, options=((1, "A"), (2, None))):
    return checks.operand_tokens(spark.createDataFrame(rows, OPERAND), spark.createDataFrame(list(options), "quote_id int, option_id string"))


def test_operand_tokens_are_those_of_python(spark):
    got = {r.quote_id: r.token for r in current(spark).collect()}
    assert got[1] == token("C3a", None, "A", [("gross_total", "118", None, "typed", None), ("base_price", "100", 'Rs "100"\n\\-', "read", {"page": 1, "text": "x"})])
    assert got[2] == token("C4", "panel_count", None, [("count", None, "₹\t5", "read", None)])
    assert got[3] == token("C3a", None, None, [("base_price", "7", None, "read", None)])
    assert current(spark, []).count() == 0


@pytest.mark.parametrize(("rows", "options", "released"), [
    (ROWS, ((1, "A"),), True), ([*ROWS[1:], (*ROWS[0][:5], "100.0", *ROWS[0][6:])], ((1, "A"),), False), ([*ROWS[1:], (*ROWS[0][:7], "typed", ROWS[0][8])], ((1, "A"),), False), (ROWS, ((1, "B"),), False), (ROWS, (), False),
])
def test_any_change_clears_a_confirmation(spark, rows, options, released):
    found = spark.createDataFrame([(1, "C3a", "C3a", 7, "consistent", None, None), (1, "C1", "C1", 9, "inconsistent", "capacity_mismatch", {"stated": "3 kW"}), (2, "C3a", "C3a", 2, "missing", None, None)], FOUND)
    sent = current(spark).select("quote_id", "token")
    out = {(r.quote_id, r.check_id): r for r in checks.hold_until_confirmed(found, current(spark, rows, options or ((9, "A"),)), sent.union(sent)).collect()}
    assert len(out) == 3 and out[2, "C3a"].status == "missing" and out[2, "C3a"].confirm_token is None
    assert (out[1, "C3a"].status, out[1, "C3a"].question) == (("consistent", None) if released else ("needs_confirmation", "confirm_values"))
    assert (out[1, "C1"].status, out[1, "C1"].params) == ("needs_confirmation", None)  # confirming one check releases only that one


def test_vendor_message(spark):
    found = [
        (1, "C4", "panel_wattage", 0, "missing", "panel_wattage", None), (1, "C4", "dcr", 0, "missing", "dcr", None), (1, "C1", "C1", 10, "inconsistent", "capacity_mismatch", {"computed_kwp": "3.3", "stated": "3 kW"}),
        (1, "C4", "panel_count", 0, "needs_confirmation", "panel_count", None), (1, "C4", "extras_outside_total", 0, "needs_confirmation", "extras_outside_total", {"charges": "Meter: ₹5, outside the total"}),
        (2, "C2", "C2", 15, "needs_confirmation", "exact_capacity", None), (2, "C1", "C1", 4, "needs_confirmation", "exact_capacity", None), (3, "C1", "C1", 9, "consistent", None, None), (4, "C3a", "C3a", 1, "needs_confirmation", "confirm_values", None),
    ]
    asked = checks.vendor_questions(spark.createDataFrame(found, FOUND).repartition(3))
    assert [(r.quote_id, r.number, r.question) for r in asked.orderBy("quote_id", "number").collect()] == [(1, 1, "capacity_mismatch"), (1, 2, "dcr"), (1, 3, "extras_outside_total"), (2, 1, "exact_capacity")]
    said = {r.quote_id: r.message for r in checks.vendor_message(asked).collect()}
    assert said.keys() == {1, 2}
    assert said[2] == "\n".join([checks.INTRO, "", "1. The quote gives a range for the panels. What is the exact panel wattage, and the total capacity in kWp?", "", "Thank you."])
    lines = said[1].split("\n")
    assert lines[2] == "1. The panels listed add up to 3.3 kWp, but the quote says 3 kW. Could you confirm the panel count and wattage?"
    assert lines[4] == "3. These charges seem to be outside the total: Meter: ₹5, outside the total. What is the full amount we would pay, including them?" and "{" not in said[1]
    assert checks.vendor_message(checks.vendor_questions(spark.createDataFrame([], FOUND))).count() == 0


def test_notes_say_whether_the_rules_were_verified(spark):
    found = spark.createDataFrame([(1, "C2", "C2", 1, "consistent", None, None)], FOUND)
    day = datetime.date
    of = lambda *rows: checks.with_notes(found, spark.createDataFrame(list(rows), "rule_id string, verification string, verified_on date")).first().notes
    assert of(("a", "verified", day(2024, 2, 3)), ("b", "verified", day(2024, 10, 8))) == [checks.DCR_NOTE, "The rule values were checked against the MNRE guidelines on 8 Oct 2024."]
    assert of(("a", "verified", day(2024, 2, 3)), ("b", None, None)) == of(("a", "open", None)) == of() == [checks.DCR_NOTE, checks.PENDING_NOTE]


def test_charges_out_of_range(spark):
    c = spark.createDataFrame([(1, 1, -1), (1, 2, 300000), (1, 3, 300001), (2, 1, None)], "quote_id int, charge_id int, amount int")
    assert {tuple(r) for r in review.guard_charges(c).collect()} == {(1, "extra_charges[1].amount", "range"), (1, "extra_charges[3].amount", "range")}


def test_sums_of_models_and_statuses_of_documents(spark):
    runs = spark.createDataFrame([("a", True, 2.0, 5), ("a", None, None, None), ("b", False, 1.0, 3)], "model string, failed boolean, seconds double, tokens int")
    assert {tuple(r) for r in evaluate.model_totals(runs).collect()} == {("a", 2, 1, 2.0, 5), ("b", 1, 0, 1.0, 3)}
    scores = spark.createDataFrame([("d", "x", "correct"), ("d", "y", "wrong"), ("e", "x", "correct")], "doc string, field string, status string")
    rows = {(r.doc, r.is_total): (r.correct, r.wrong) for r in evaluate.status_report(scores, "doc").collect()}
    assert rows == {("d", 0): (1, 1), ("e", 0): (1, 0), (None, 1): (2, 1)}
