"""Rows and classes that the stages of the pipeline must not leave out: texts under the id of a copy, items without an id, rare languages."""

import pytest
from pyspark.sql import functions as F

from ledgerline.llm import decontaminate, language, near_dup

SF = "/root/testdata/sf0.001"


def prose(n, seed=0):
    return " ".join(f"w{seed}x{i}" for i in range(n))


def near(text):
    return text + " end"


A, B, C, D = (prose(60, i) for i in range(4))


@pytest.mark.parametrize(
    "rows, stay",
    [
        ([(3, A), (5, A), (5, B), (7, near(B))], {(3, A), (5, B)}),
        ([(1, C), (5, near(C)), (5, D), (9, near(D)), (9, D)], {(1, C), (5, D)}),
        ([(2, A), (2, near(A)), (2, B), (4, C)], {(2, A), (2, near(A)), (2, B), (4, C)}),
    ],
)
def test_a_text_under_the_id_of_a_copy_stays(spark, rows, stay):
    kept = {tuple(r) for r in near_dup.keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    near_rows = {(2, A), (2, near(A))}
    if near_rows <= stay:  # near copies under one id: either one stays
        assert len(kept & near_rows) == 1
        kept, stay = kept - near_rows, stay - near_rows
    assert len({t.removesuffix(" end") for _, t in kept}) == len(kept) == len(stay)
    assert {t.removesuffix(" end") for _, t in kept} == {t.removesuffix(" end") for _, t in stay} and {i for i, _ in kept} == {i for i, _ in stay}


def test_an_item_without_an_id_is_searched(spark):
    docs = spark.createDataFrame([(1, prose(40, 1)), (2, prose(40, 2)), (3, prose(40, 3))], "doc_id long, text string")
    items = spark.createDataFrame([(None, prose(12, 1)), (7, prose(12, 2))], "item_id long, text string")
    got = {r.doc_id: (r.n_hit, r.n_items, r.contaminated) for r in decontaminate.decontamination(docs, items).collect()}
    assert got == {1: (12, 0, True), 2: (12, 1, True), 3: (0, 0, False)}
    assert [r.doc_id for r in decontaminate.drop_contaminated(docs, items).collect()] == [3]


def test_languages_beyond_those_held_at_once(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.unionByName(docs.limit(2).withColumn("text", F.lit("123")))
    want = sorted(map(tuple, language.identify(docs).collect()))
    stage = sorted(map(tuple, language.drop_unknown(docs).collect()))
    assert len({r[2] for r in want} - {"und"}) > 2
    monkeypatch.setattr(language, "MAX_LANGUAGES", 1)
    assert sorted(map(tuple, language.identify(docs).collect())) == want
    assert sorted(map(tuple, language.drop_unknown(docs).collect())) == stage
