"""Sections of lines: headings of both sides, side by side or not, against a plain fold over the lines."""

import random

import pytest

from ledgerline.functions import text as T
from ledgerline.operators import extract

LINE = "doc int, page int, line_no int, y0 double, text string"
HEADINGS = {"Buyer": "buyer", "SOLD TO": "buyer", "Bill  to:": "buyer", "Shipped to": "buyer", "Client": "buyer", "To,": "buyer", "to": "buyer", "Consignee details": "buyer", "Vendor": "supplier", "Quotation from": "supplier", "From: Sun Ltd": "supplier", "Our details": "supplier"}
OTHERS = ["Dear customer", "Total to pay", "To be paid by the customer on delivery", "Buyer and seller agree on terms", "Fromage", "Supplierless", "", None, "Rs. 100"]


def fold(lines, height):
    """Sections of one page's lines (y0, line_no, text) in order."""
    section, last, out = "letterhead", None, []
    for y, _, text in lines:
        kind = HEADINGS.get(text)
        if kind:
            beside = last is not None and last[0] != kind and None not in (y, last[1]) and abs(y - last[1]) < 0.02 * height
            section, last = "unclear" if beside else kind, (kind, y)
        out.append(section)
    return out if last else ["unclear"] * len(out)


@pytest.mark.parametrize("height", [1.0, 50.0])
def test_sections_against_a_fold(spark, height):
    rng, rows = random.Random(int(height)), []
    for doc in range(60):
        for page in range(2):
            some = rng.choice([[*HEADINGS, *OTHERS], OTHERS, [*HEADINGS]])
            rows += [(doc, page, i, None if doc % 9 == 8 else round(height * rng.choice([0.1, 0.115, 0.13, 0.5]), 4), rng.choice(some)) for i in range(rng.randrange(1, 9))]
    want = {}
    for doc, page in {r[:2] for r in rows}:
        mine = sorted((r for r in rows if r[:2] == (doc, page)), key=lambda r: (r[3] or 0, r[2]))
        want |= {(*r[:3],): s for r, s in zip(mine, fold([(r[3], r[2], r[4]) for r in mine], height), strict=True)}
    got = {(r.doc, r.page, r.line_no): r.section for r in extract.line_sections(spark.createDataFrame(rows, LINE).repartition(3), height).collect()}
    assert got == want and set(got.values()) == {"letterhead", "buyer", "supplier", "unclear"}


def test_headings_side_by_side_give_no_state(spark):
    own = "27AAPFU0939F1ZV"
    other = "29AAGCB7383J1Z4"
    pages = {
        1: [(0.1, "Supplier"), (0.105, "Buyer"), (0.2, own)], 2: [(0.1, "Supplier"), (0.2, own), (0.3, "Bill to"), (0.4, other)], 3: [(0.1, own), (0.3, "Ship to"), (0.4, other)],
        4: [(0.2, own)], 5: [(0.2, "Our GSTIN " + own)], 6: [(0.1, "Vendor"), (0.2, "Customer " + own)], 7: [(0.1, "From"), (0.2, own), (0.3, other)],
    }
    rows = [(d, 1, i, y, t) for d, lines in pages.items() for i, (y, t) in enumerate(lines)]
    df = spark.createDataFrame(rows, LINE)
    valid = {r.id for r in df.selectExpr("explode(array('27AAPFU0939F1ZV', '29AAGCB7383J1Z4')) AS id").where(T.gst_id_valid(T.F.col("id"))).collect()}
    assert valid == {own, other}
    assert {r.doc: r.state_code for r in extract.supplier_state(df).collect()} == {2: "27", 3: "27", 5: "27"}
