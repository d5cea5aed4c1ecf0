"""Corpus operators on odd rows (nulls, empty and long texts, repeats, clashing columns, empty tables) against brute force."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import decontaminate, html_text, language, license_scan, line_dedup, mixing, near_dup, quality_model, quality_rules, token_files
from ledgerline.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k string, name string, page long"


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def prose(n, seed=0):
    return " ".join(f"w{(i * 7919 + seed * 104729) % 9973}" for i in range(n))


TEXTS = [None, "", " \n\t ", "one", "one two three four", prose(60), prose(60), prose(60) + " extra", "A B " * 200, prose(30, 1) + "\n" + prose(60, 2) + "\n\nend", prose(60, 2) + "\nother\n" + prose(30, 1), prose(30000, 3), "x\x00y é ß 中文 \U0001f600", "Released under the MIT License.\n" + prose(40, 5), "###" * 50, "The The The " * 50]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, [None, "en", "de"][i % 3], [None, "s1", "s2"][i % 3], len(t or ""), "k", "n", 1) for i, t in enumerate(TEXTS)]
    rows += [(5, TEXTS[5], "en", "s1", 1, None, None, None), (None, prose(60), None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r.doc_id: r for r in df.collect() if r.doc_id is not None}


def base_rules(t):
    t = t or ""
    w, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
    at = defaultdict(list)
    for i in range(len(w) - 7):
        at[tuple(w[i : i + 8])].append(i)
    again = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(again)


def test_rules(docs, none):
    rows = quality_rules.verdicts(docs)
    assert rows.count() == docs.count()
    got = by_id(rows)
    for i, t in enumerate(TEXTS):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base_rules(t)
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
    assert got[5].kept and not got[8].kept and not got[15].kept
    a = {r.rule: r for r in quality_rules.ablations(rows).collect()}
    kept = rows.where("kept").count()
    assert a["too_few_words"].n_kept == kept
    no_min = quality_rules.mask("web-2") & ~quality_rules.mask("base-1") | quality_rules.mask("base-1") & 2
    assert a["too_few_words"].n_kept_without == rows.where(F.col("fail_bits").bitwiseAND(F.lit(no_min)) == 0).count()
    assert quality_rules.verdicts(none).count() == 0


def test_language(spark, docs, none):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    got = language.identify(d).join(d.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got)
    odd = by_id(language.identify(docs))
    assert odd[0].lang_pred == odd[1].lang_pred == odd[14].lang_pred == "und" and all(0 <= r.score <= 1 for r in odd.values())
    assert language.identify(docs).count() == docs.count() and language.identify(none).count() == 0
    assert language.drop_unknown(docs).columns == docs.columns


def test_language_rejects_what_is_far(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    rng = np.random.default_rng(5)
    letters = " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 10))) for _ in range(60))
    far = ["Все люди рождаются свободными и равными в своем достоинстве и правах.", "人人生而自由，在尊严和权利上一律平等。他们赋有理性和良心，并应以兄弟关系的精神相对待。", "يولد جميع الناس أحرارا متساوين في الكرامة والحقوق", letters]
    clean = [(-100 - i, r.text[:n].rsplit(" ", 1)[0]) for i, (r, n) in enumerate((r, n) for r in d.where("length(text) > 300 and lang is not null").orderBy(F.xxhash64("doc_id")).limit(50).collect() for n in (30, 60, 300))]
    both = d.unionByName(spark.createDataFrame([(-1 - i, t, None) for i, t in enumerate(far)] + [(i, t, None) for i, t in clean], d.schema))
    got = by_id(language.identify(both))
    assert all(got[-1 - i].rejected for i in range(len(far)))
    assert sum(got[i].rejected for i, _ in clean) <= 0.02 * len(clean)
    assert sum(r.rejected for i, r in got.items() if i >= 0 and r.lang_pred != "und") <= 0.01 * len(got)
    kept = {r.doc_id for r in language.drop_unknown(both).collect()}
    assert kept == {i for i, r in got.items() if not r.rejected}


def components(texts):
    sets = {}
    for i, t in texts.items():
        w = WORD.findall(lower(t))
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    up = {i: i for i in texts}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in texts:
        for b in texts:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in texts}


def test_near_duplicates(spark, docs, none):
    got = by_id(near_dup.near_duplicates(docs))
    want = components(dict(enumerate(TEXTS)))
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
    assert all(r.kept == (r.component_id == i) for i, r in got.items())
    assert near_dup.near_duplicates(docs).count() == docs.count() and near_dup.near_duplicates(none).count() == 0


def test_star_loses_no_chain(spark):
    words = prose(100).split()
    texts = {i: " ".join(words[i * 6 :] + [f"z{i}_{j}" for j in range(6 * i)]) for i in range(8)}
    got = by_id(near_dup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")))
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == components(texts)


def test_estimate_is_near(spark):
    rng = np.random.default_rng(1)
    for share in (0.5, 0.75, 0.9):
        errors = []
        for n in (40, 400):
            both = rng.integers(0, 2**63, int(n * share), dtype=np.uint64)
            sides = [np.unique(np.concatenate([both, rng.integers(0, 2**63, n - len(both), dtype=np.uint64)]) * np.uint64(2)) for _ in range(2)]
            true = len(np.intersect1d(*sides)) / len(np.union1d(*sides))
            a, b = (near_dup.registers(s)[None, :] for s in sides)
            errors.append(abs(near_dup.estimate(a, b, np.array([n]), np.array([n]))[0] - true))
        assert max(errors) < 0.2


def test_decontamination(spark, docs, none):
    bench = spark.createDataFrame([(1, prose(12)), (10, prose(60, 2)), (2, "One"), (3, None), (4, " .. "), (1, prose(12))], "item_id long, text string")
    item = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = defaultdict(set)
    for r in bench.collect():
        w = item.findall(lower(r.text))
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[i : i + n])].add(str(r.item_id))
    got = by_id(decontaminate.decontamination(docs, bench))
    for i, t in enumerate(TEXTS):
        w, hit, items = item.findall(lower(t)), set(), set()
        for n in {len(k) for k in windows}:
            for j in range(len(w) - n + 1):
                if s := windows.get(tuple(w[j : j + n])):
                    items |= s
                    hit.update(range(j, j + n))
        r = got[i]
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256) == (len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest())
    assert decontaminate.decontamination(docs, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.decontamination(none, bench).count() == 0


def test_licences(docs, none):
    got = by_id(license_scan.scan(docs))
    assert got[13].families == "MIT" and got[5].families == "" and got[0].n_paragraphs == 0
    assert license_scan.scan(none).count() == 0


def test_licence_probes(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    notices = {
        -1: ("Creative Commons Attribution 4.0 International (CC BY 4.0)", "CC-BY"),
        -2: ("CC0 1.0 Universal", "public-domain"),
        -3: ("Distributed under the terms of the GNU GPL v3", "GPL"),
        -4: ("GPLv3", "GPL"),
        -5: ("SPDX: Apache-2.0", "Apache"),
        -6: ("Veröffentlicht unter der MIT-Lizenz.", "MIT"),
        -7: ("Licensed under the Apache License, Version 2.0; you may not use this\nfile except in compliance with the License.", "Apache"),
        -8: ("The city will license the Apache helicopter version 2.0 under the general public budget.", ""),
        -9: ("He lost his license in the public park.", ""),
    }
    both = d.unionByName(spark.createDataFrame([(i, f"{prose(40)}.\n{x}\n{prose(30, 2)}") for i, (x, _) in notices.items()], d.schema))
    model = license_scan.fit(both)
    got = license_scan.scan(both.union(both.limit(5)), model).collect()
    assert len(got) == d.count() + len(notices) + 5 and all(r.n_scored == r.n_paragraphs for r in got)
    by = {r.doc_id: r for r in got}
    assert {i: by[i].families for i in notices} == {i: f for i, (_, f) in notices.items()}
    assert by[-7].n_paragraphs == 3 and by[-7].n_confirmed == 1
    assert sorted(map(str, got)) == sorted(map(str, license_scan.scan(both.union(both.limit(5)), model, gate=False).collect()))
    held = model.held_out
    assert held["right"] >= 0.9 * held["given"] and held["right"] >= 0.7 * held["have"]
    # the sums by hand
    weight, texts = dict(zip(model.features, model.weights, strict=True)), [(r.doc_id, r.text) for r in both.where("doc_id < 0 or doc_id % 50 = 0").collect()]
    for i, text in texts:
        families = set()
        for line in re.sub(r"\n(?<=[^\n]{40}\n)(?<=[^\W_]\n)[ \t]*(?=[a-z])", " ", text or "").split("\n"):
            w = [x for x in re.split(r"[\W_]+", line.lower()) if x]
            bigrams = {f"{a} {b}" for a, b in zip(w, [*w[1:], ""], strict=True)}
            z = model.start + sum((weight[f] for f in {*w, *bigrams} if f in weight), np.zeros(len(model.families)))
            if w and np.exp(z.max()) / (1 + np.exp(z).sum()) >= 0.5:
                near = [len(bigrams & set(n)) / max(1, min(len(bigrams), len(n))) for f, n in model.notices if f == z.argmax()]
                families |= {model.families[z.argmax()]} if max(near) >= license_scan.MIN_OVERLAP else set()
        assert by[i].families == ",".join(sorted(families)), text


def test_mixing(spark, docs, none):
    d = spark.read.parquet(f"{SF}/documents.parquet").unionByName(docs.select("doc_id", "text", "lang", "source", "n_chars"))
    rows = mixing.mixture(d).collect()
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mixture(d.repartition(7)).collect()))
    per = defaultdict(lambda: [0, 0.0, 0, 0])
    for r in rows:
        x = per[r.source_size, r.target]
        x[0], x[1], x[2], x[3] = r.source_size, r.target, x[2] + r.taken, max(x[3], r.size)
        assert r.taken <= 3 * r.size
    assert all(abs(taken - target) <= 2 * most + 1 for _, target, taken, most in per.values())
    assert sum(x[2] for x in per.values()) <= sum(r.size for r in rows)
    assert mixing.mixture(none).count() == 0


def test_pages(spark):
    page = "<html><body><nav>Home</nav><div class='cookie-notice'>We use</div><article><h1>T&eacute;st</h1><p>One\n two<br>three<p>Four &lt;b&gt;</article><div class='comments'><p>Nice</p></div><form>Name</form><footer>c</footer></body></html>"
    rows = [(i, f"http://h{i % 2}.org/{i}", page.replace("One", f"One{i}")) for i in range(20)] + [(90, None, page), (91, "x", None), (92, "http://h0.org", ""), (93, "http://h0.org", "a < b <p>c"), (0, "http://h0.org/0", page)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    got = {r.page_id: r for r in html_text.main_text(df).collect()}
    assert got[3].text == "Tést\n\nOne3 two three\n\nFour <b>" and got[3].n_chars == len(got[3].text)
    assert got[91].text == got[92].text == "" and got[93].text == "a < b\n\nc"
    assert html_text.main_text(df).count() == len(rows) and html_text.main_text(df.limit(0)).count() == 0


def test_style_tree_cuts_what_repeats(spark):
    rows = [(i, f"http://h.org/{i}", f"<body><div class='lead'>Same words</div><div class='story'>Story {i}</div></body>") for i in range(12)]
    got = html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all(r.text == f"Story {r.page_id}" for r in got)


@pytest.mark.parametrize("broadcast", [50_000, 0])
def test_style_tree_cuts_repeats_of_articles(spark, monkeypatch, broadcast):
    monkeypatch.setattr(html_text, "BROADCAST_PATHS", broadcast)
    own = {3: "Own words of page 3"}
    body = {i: f"<h1>Story {i}</h1><p>Told {i}</p><div class='more'><p>{own.get(i, 'By the desk')}</p></div>" for i in range(20)} | {20: "<div class='more'><p>By the desk</p></div>"}
    rows = [(i, f"http://h.org/{i}", f"<body><article>{x}</article></body>") for i, x in body.items()]
    got = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: "\n\n".join([f"Story {i}", f"Told {i}", *([own[i]] if i in own else [])]) for i in range(20)} | {20: "By the desk"}


def test_boilerplate_inside_lines_and_odd_markup():
    text = lambda page: html_text._text(page, {})
    assert text("<article><p>Real text <button>Share this</button> more</p></article>") == "Real text more"
    assert text("<article><p>a<script>x('<p>');</script>b <span class='ad'>Buy now</span>c</p></article>") == "ab c"
    story = "long story " * 30
    assert text(f"<div><article><p>Teaser</p></article><p>{story}</p></div>") == "Teaser\n\n" + story.strip()
    assert text("<p title='x>a</p><p>b</p>") == "a\n\nb" and text("<p>x <b") == "x <b"
    for page in ("<p a='x\">" * 50_000, "<a \"" * 50_000, "<div>x" * 20_000, "<b>x" * 50_000):
        text(page)  # ends soon


def test_quality_model(spark, docs, none):
    d, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = quality_model.quality_scores(d, labels).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in got) >= 0.95 * len(got)
    odd = quality_model.quality_scores(docs, labels.limit(0))
    assert odd.count() == docs.count() and all(0 <= r.score <= 1 for r in odd.collect())
    assert quality_model.quality_scores(none, labels).count() == 0


def test_token_files(spark, docs, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    rows = sorted(token_files.token_digest(docs, tokenizer_path()).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted((r.doc_id for r in rows), key=lambda i: (i is not None, i or 0))
    start = 0
    for r in rows:
        assert r.start == start
        start += r.n_tokens
        if r.doc_id is not None:
            ids = np.array([*t.encode(TEXTS[r.doc_id] or "", add_special_tokens=False).ids, 0], dtype="<u4")
            assert (r.n_tokens, r.ids_crc32) == (len(ids), zlib.crc32(ids.tobytes()))
    assert len(rows) == docs.count() and token_files.token_digest(none, tokenizer_path()).count() == 0


def test_encoder_on_odd_white_space():
    import random

    import pyarrow as pa
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    t.encode_special_tokens = True
    rng = random.Random(3)
    texts = ["".join(rng.choice(" \n\t\r　\x85ab1!.,é\x1c\U0001f600'") for _ in range(rng.randint(0, 20))) for _ in range(3000)]
    ids, n = token_files.Encoder(tokenizer_path()).encode(pa.array([*texts, None]))
    cut = np.concatenate([[0], np.cumsum(n)])
    for i, x in enumerate(texts):
        assert ids[cut[i] : cut[i + 1]].tolist() == [*t.encode(x, add_special_tokens=False).ids, 0]


def test_line_dedup(docs, none):
    rows = line_dedup.dedup_lines(docs)
    got = by_id(rows)
    assert rows.count() == docs.count()
    assert got[6].text == "" and got[6].n_removed_lines == 1 and got[5].n_removed_lines == 1  # the copy with a null id is the first
    assert got[10].text == "other\n" + prose(30, 1) and got[9].text == TEXTS[9] and got[0].text is None
    assert line_dedup.dedup_lines(none).count() == 0


def brute_line_dedup(texts, least):
    """Maximal repeated runs by comparing all suffixes: texts in their order, the text of each afterwards."""
    lines = [[x for x in (t or "").split("\n") if WORD.search(x)] for t in texts]
    size = [[len(WORD.findall(x)) for x in v] for v in lines]
    gone = [set() for _ in texts]
    starts = [(d, i) for d, v in enumerate(lines) for i in range(len(v))]
    for k, (d, i) in enumerate(starts):
        for e, j in starts[:k]:
            n = 0
            while i + n < len(lines[d]) and j + n < len(lines[e]) and lines[d][i + n] == lines[e][j + n]:
                n += 1
            if sum(size[d][i : i + n]) >= least:
                gone[d].update(range(i, i + n))
    return ["\n".join(x for i, x in enumerate(v) if i not in g) for v, g in zip(lines, gone, strict=True)]


@pytest.mark.parametrize("least", [50, 7])
def test_line_dedup_against_all_suffixes(spark, least):
    import random

    rng = random.Random(least)
    pool = [prose(rng.choice([1, 1, 2, 3, 9, 20, 60]), i) for i in range(9)]
    texts = ["\n".join(rng.choice(pool) for _ in range(rng.randint(1, 14))) for _ in range(30)]
    texts += ["\n".join(["a"] * 120), "\n".join(["a"] * 70)]
    got = line_dedup.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n_lines", F.lit("clash")), least).orderBy("doc_id").collect()
    assert [r.text for r in got] == brute_line_dedup(texts, least)


def test_near_duplicates_in_large_groups(spark):
    """Copies of one text with few and many edits, some like each other but not like the first: components against all pairs."""
    import random

    rng, base = random.Random(5), prose(150, 4).split(" ")
    texts = []
    for i in range(160):
        t = list(base)
        for _ in range(rng.choice([0, 1, 2, 5, 6, 8])):
            t[rng.randrange(150)] = f"e{rng.randrange(30)}"
        texts.append(t)
    for i in range(0, 60, 3):
        t = list(texts[i])
        t[rng.randrange(150)] = "z"
        texts.append(t)
    sets = [{tuple(t[k : k + 5]) for k in range(len(t) - 4)} for t in texts]
    label = list(range(len(sets)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    d = spark.createDataFrame([*rows, rows[0], (None, rows[0][1]), (None, rows[0][1])], "doc_id long, text string").repartition(4)
    got = by_id(near_dup.near_duplicates(d))
    assert {i: r.component_id for i, r in got.items()} == {i: find(i) for i in range(len(sets))}
    assert len({find(i) for i in range(len(sets))}) > 10
    kept = near_dup.keep_one_of_each(d).collect()
    assert sorted((r.doc_id for r in kept), key=lambda i: (i is not None, i)) == [None, *sorted({find(i) for i in range(len(sets))})]


def test_mixed_documents_take_what_the_mix_says(spark):
    rows = [(i % 7, prose(20 + i % 7), f"s{i % 2}") for i in range(40)] + [(100 + i, prose(200, i), "s2") for i in range(5)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = {r.source: r.n for r in mixing.mixture(d).withColumn("source", F.expr("substring(sk, 2)")).groupBy("source").agg(F.sum("taken").alias("n")).collect()}
    got = {r.source: r.n for r in mixing.mixed_documents(d).groupBy("source").agg(F.sum(mixing.n_words(F.col("text"))).alias("n")).collect()}
    assert got == {k: v for k, v in want.items() if v}


def test_language_stage_with_clashing_columns(docs):
    d = docs.withColumn("score", F.lit("x")).withColumn("rejected", F.lit(1)).withColumn("lang_pred", F.lit(2))
    out = language.drop_unknown(d)
    assert out.columns == d.columns and all(r.score == "x" and r.lang_pred == 2 for r in out.collect())


def test_orc_files_have_stripes_row_index_and_bloom_filter(spark, tmp_path):
    import pyarrow.orc as orc

    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    token_files.write_tokens(d, f"file://{tmp_path}/t", tokenizer_path())
    files = sorted((tmp_path / "t").glob("*.orc"))
    seen = [orc.ORCFile(str(f)) for f in files]
    assert sum(f.nrows for f in seen) == d.count() and all(f.nstripes >= 1 and f.row_index_stride == token_files.INDEX_STRIDE for f in seen if f.nrows)
    assert all(b"org.apache.spark" in f.read_bytes() for f in files)
    rows = token_files.read_tokens(spark, f"file://{tmp_path}/t")
    one = rows.where("doc_id = 77")
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,77)" in one._jdf.queryExecution().toString().replace("IsNotNull(chunk), ", "").replace(", IsNotNull(chunk)", "") or one.count() == 1


def test_pipeline(spark):
    """Each stage's rows against plain Python over what the stage before kept."""
    from collections import Counter

    import corpus_pipeline
    from tokenizers import Tokenizer

    first = spark.read.parquet(f"{SF}/documents.parquet")
    again = first.limit(3).withColumn("source", F.lit("again"))
    before = first.unionByName(again).collect()
    after = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(before, first.schema)
        out = stage(spark, docs, SF)
        rows = after[name] = out.collect()
        if name != "token_files":
            assert out.columns == first.columns, name
        text = {r.doc_id: r.text for r in before}
        if name == "language_id":
            said = {r.doc_id: r for r in language.identify(docs).collect()}
            assert Counter((r.doc_id, r.lang) for r in rows) == Counter((r.doc_id, said[r.doc_id].lang_pred) for r in before if not said[r.doc_id].rejected)
        elif name == "near_dedup":
            sets = {}
            for i, t in text.items():
                w = WORD.findall(lower(t))
                sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
            label = {i: i for i in sets}
            for i in sorted(sets):
                for j in (j for j in sets if j < i and sets[i] and sets[j]):
                    both = len(sets[i] & sets[j])
                    if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both) and label[i] != label[j]:
                        old, new = max(label[i], label[j]), min(label[i], label[j])
                        label = {k: new if v == old else v for k, v in label.items()}
            assert sorted(r.doc_id for r in rows) == sorted(i for i, v in label.items() if i == v)
        elif name == "decontamination":
            item, windows = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), set()
            for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
                w = item.findall(lower(r.text))
                windows |= {tuple(w[k : k + min(10, len(w))]) for k in range(max(1, len(w) - 9)) if w}
            sizes = {len(x) for x in windows}
            clean = [i for i, t in text.items() if not any(tuple(w[k : k + n]) in windows for w in [item.findall(lower(t))] for n in sizes for k in range(len(w) - n + 1))]
            assert sorted(r.doc_id for r in rows) == sorted(clean)
        elif name == "mixing":
            taken = {r.doc_id: r.copies for r in mixing.mixture(docs).collect()}
            assert Counter(r.doc_id for r in rows) == {i: n for i, n in taken.items() if n} and all(text[r.doc_id] == r.text for r in rows)
        else:
            t, start = Tokenizer.from_file(tokenizer_path()), 0
            want = Counter((r.doc_id, zlib.crc32(np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 0], dtype="<u4").tobytes())) for r in before)
            assert Counter((r.doc_id, r.ids_crc32) for r in rows) == want
            for r in sorted(rows, key=lambda r: r.start):
                assert r.start == start
                start += r.n_tokens
        before = [tuple(r) for r in rows] if name != "token_files" else before
        before = spark.createDataFrame(before, first.schema).collect() if name != "token_files" else before
        assert before, name
    assert len(after["language_id"]) > len(after["near_dedup"]) >= len(after["decontamination"])
