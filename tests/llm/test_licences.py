"""Licence notices of many families, several in a paragraph, and wording that is in no notice."""

import pytest

from ledgerline.llm import license_scan

SCHEMA = "doc_id long, text string"
# text, families
PROBES = (
    ("GNU Affero General Public License, version 3", "AGPL"),
    ("Apache-2.0 for code, docs under CC BY 4.0, the rest under MIT", "Apache,CC-BY,MIT"),
    ("MIT license and the Apache License, Version 2.0 at your option", "Apache,MIT"),
    ("MIT or Apache-2.0", "Apache,MIT"),
    ("All rights reserved.", "proprietary"),
    ('THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED.', "MIT"),
    ("Licensed under the ISC License", "ISC"),
    ("Available under the terms of the Eclipse Public License 2.0", "EPL"),
    ("Distributed under the Boost Software License, Version 1.0", "BSL"),
    ("This is free and unencumbered software released into the public domain.", "public-domain"),
    ("Released under the zlib License", "zlib"),
    ("CC BY-ND 4.0", "CC-BY-ND"),
    ("You can redistribute it under the GNU Lesser General Public License", "LGPL"),
    ("He studied at MIT and flew an Apache helicopter.", ""),
    ("The general public and the Eclipse were seen from Boston, and all reserved their rights.", ""),
    ("", ""), (None, ""), ("and or , ; /", ""),
)


@pytest.fixture(scope="module")
def model(spark):
    return license_scan.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text"))


def test_families(spark, model):
    rows = [(i, t if not t or "or ," in t else f"Some words of a page about nothing.\n{t}\nand the end of it") for i, (t, _) in enumerate(PROBES)]
    got = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame([*rows, (None, rows[1][1])], SCHEMA).repartition(3), model).collect()}
    assert {PROBES[i][0]: got[i].families for i, _ in rows} == dict(PROBES)
    assert got[1].n_several == got[None].n_several == 1 and got[0].n_several == got[16].n_several == 0
    assert all(r.n_several <= r.n_paragraphs and (r.probability is None) == (r.families == "") for r in got.values())


def test_clauses_add_families_and_take_none(spark, model):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    gated, all_ = (sorted(map(str, license_scan.scan(d, model, gate=g).collect())) for g in (True, False))
    assert gated == all_ and len(all_) == d.count()
