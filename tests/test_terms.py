"""Term spans, masks and their audit against plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import pii
from ledgerline.sources import readers

TERMS = "# comment\nAcme Solar Ltd\nkeep: 98765 43210 helpline\nkeep: Acme Solar\nasha rao\nM/s. Ravi & Co.\n\nkeep: info@acme.example\nK-12\nÉcole\nsolar\n***\n"


@pytest.fixture(scope="module")
def terms(spark):
    return readers.parse_terms(spark.createDataFrame([(x,) for x in TERMS.split("\n")], "text string"))


def brute_terms(text, terms):
    out = []
    for term, kind in terms:
        if re.search(r"\w", term):
            pattern = r"(?<!\w)" + r"[\s,.]+".join(map(re.escape, term.split())) + r"(?!\w)"
            out += [(kind, term, m.start(), m.group()) for m in re.finditer(pattern, text, re.I)]
    return out


TEXTS = [
    "Call 98765 43210 helpline, or 98765 43210.", "acme,  SOLAR. ltd and Acme Solar and Acme Solarium; (Asha\nRao) asha. Raoul", "M/s. Ravi & Co. and m/s. ravi & co.", "K-12, K-123, xK-12 école ÉCOLE", "Mail info@acme.example or me@acme.example", None, "",
    "solar solar,solar", "Rs 123456789 for 123456789 and PAN ABCDE1234F; model ABC-500W solar", "9" * 30, "x " * 3000 + "asha rao " + "y " * 500, "5 kW 98765 43210 on 02/10/2026 at 12 %", "98765-43210 98765 43211 helpline",
]


def frame(spark, texts):
    rows = [(i, t, 1, "k", 0, "u", 5) for i, t in enumerate(texts)] + [(1, "another with id 1: 98765 43212", 1, "k", 0, "u", 5), (None, "null id asha rao", 1, "k", 0, "u", 5)]
    return spark.createDataFrame(rows, "doc_id long, text string, page int, kind string, start int, unit string, end int")


def test_terms_as_by_patterns(spark, terms):
    rng = random.Random(4)
    vocabulary = ["acme", "solar", "Ltd", "asha", "RAO", "ravi", "M/s.", "&", "Co.", "k-12", "école", ",", ".", "  ", "\n", "x"]
    texts = TEXTS + ["".join(rng.choice(vocabulary) + rng.choice([" ", " ", "", ", "]) for _ in range(rng.randint(1, 40))) for _ in range(150)]
    known = [(r.term, r.kind) for r in terms.collect()]
    got = sorted((r.doc_id, r.kind, r.term, r.start, r.found) for r in pii.term_spans(frame(spark, texts), terms).collect() if r.doc_id not in (None, 1))
    want = sorted((i, k, t, s, f) for i, x in enumerate(texts) if x and i != 1 for k, t, s, f in brute_terms(x, known))
    # patterns of one term do not overlap themselves; occurrences by units may: none of these terms repeats its own start
    assert got == want and len(want) > 100


def test_kept_terms_by_place_and_denied_terms_always(spark, terms):
    got = {(r.doc_id, r.kind, r.start, r.found) for r in pii.pii_spans(frame(spark, TEXTS), terms).collect()}
    assert (0, "phone", 30, "98765 43210") in got and (0, "phone", 5, "98765 43210") not in got
    assert (1, "term", 0, "acme,  SOLAR. ltd") in got and (1, "term", 27, "Solar") in got
    assert (4, "email", 26, "me@acme.example") in got and not any(g[:3] == (4, "email", 5) for g in got)
    assert (1, "phone", 19, "98765 43212") in got and (None, "term", 8, "asha rao") in got


def brute_mask(text, terms, personal, protected):
    """Character by character; each run of hidden characters becomes the kind of its first-ranked span."""
    hide, rank = [False] * len(text), [99] * len(text)
    kinds = [*pii.PERSONAL, pii.OTHER]
    for kind, start, found in personal:
        for i in range(start, start + len(found)):
            if kind == pii.OTHER or not any(s <= i < s + len(f) for _, s, f in protected):
                hide[i] = True
    out, i = "", 0
    while i < len(text):
        if not hide[i]:
            out += text[i]
            i += 1
            continue
        j = i
        while j < len(text) and hide[j]:
            j += 1
        first = min(kinds.index(k) for k, s, f in personal if s < j and i <= s or (s <= i < s + len(f)))
        out += f"[{kinds[first]}]"
        i = j
    return out


def test_masks_are_unions_without_protected_text(spark, terms):
    d = frame(spark, TEXTS)
    personal, protected = {}, {}
    for r in pii.pii_spans(d, terms).collect():
        personal.setdefault(r.doc_id, []).append((r.kind, r.start, r.found))
    for r in pii.protected_spans(d).collect():
        protected.setdefault(r.doc_id, []).append((r.kind, r.start, r.found))
    got = [r for r in pii.mask_documents(d, terms).collect()]
    assert len(got) == d.count() and set(pii.mask_documents(d, terms).columns) == {*d.columns, "masked"}
    for r in got:
        if r.doc_id != 1:
            want = r.text if r.text is None else brute_mask(r.text, terms, personal.get(r.doc_id, []), protected.get(r.doc_id, []))
            assert r.masked == want
    by = {(r.doc_id, r.text): r.masked for r in got}
    assert by[8, TEXTS[8]] == "Rs 123456789 for [long_number] and PAN [tax_id]; model ABC-500W [term]"
    assert by[1, TEXTS[1]].startswith("[term] and Acme [term] and Acme Solarium; ([term])")
    audit = pii.mask_audit(d, terms).first()
    assert audit.n_survivors == 0 and audit.n_kept == audit.n_protected > 3 and audit.n_texts == d.where("text is not null").count()


def test_many_terms_and_empty_tables(spark):
    many = spark.range(30_000).select(F.concat(F.lit("term"), F.col("id").cast("string"), F.lit(" x")).alias("term"), F.lit("deny").alias("kind"))
    d = spark.createDataFrame([(1, "a term77 x, TERM29999. X and term30000 x")], "doc_id long, text string")
    assert sorted(r.found for r in pii.pii_spans(d, many).collect()) == ["TERM29999. X", "term77 x"]
    assert pii.mask_documents(d, many).first().masked == "a [term], [term] and term30000 x"
    assert pii.pii_spans(d, many.limit(0)).count() == 0 and pii.mask_documents(d.limit(0), many).count() == 0
