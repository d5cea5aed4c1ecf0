"""Ordered folds, job states as stream and batch, admission, replayed merging, bindings and corrections against plain Python or by hand."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ledgerline.functions import text as T
from ledgerline.operators import evaluate, extract, merge, review
from ledgerline.streaming import jobs


def test_batches_of_a_long_document(spark):
    rng = random.Random(1)
    sizes = [rng.randint(0, 1000) for _ in range(30_000)]
    pages = spark.createDataFrame([("d", i, n) for i, n in enumerate(sizes)] + [("e", 1, 2000), ("e", 2, None)], "doc string, page long, bytes long").repartition(5)
    got = {(r.doc, r.page): r.batch for r in merge.plan_batches(pages, 5, 950).collect()}
    batch, n, total = 1, 0, 0
    for i, s in enumerate(sizes):
        if s > 950:
            assert got["d", i] is None
            continue
        if n and (n >= 5 or total + s > 950):
            batch, n, total = batch + 1, 0, 0
        n, total = n + 1, total + s
        assert got["d", i] == batch
    assert got["e", 1] is None and got["e", 2] == 1


day = lambda n: datetime(1970, 1, 1) + timedelta(days=n)

KINDS = ["upload", "claim", "finish", "fail", "retry", "other"]


def events(seed, n=400, jobs_=12):
    rng = random.Random(seed)
    at = 1_700_000_000
    out = []
    for _ in range(n):
        at += rng.choice([0, 1, 5, 300, 1000, 4000])
        out.append((rng.randint(1, jobs_), at, rng.choice(KINDS)))
    out += [(99, at + 5, "upload"), (99, at + 6, "claim"), (99, at + 200_000, "finish"), (99, at + 200_001, "upload")]
    return out


def brute_states(rows):
    out, by = [], {}
    for job, at, kind in sorted(rows, key=lambda r: (r[1], r[2])):
        now, since, retries, seen = by.get(job, ("awaiting_upload", 0, 0, None))
        if seen is not None and at - seen > 24 * 3600:
            now, since, retries = "awaiting_upload", 0, 0
        new = {("awaiting_upload", "upload"): "uploaded", ("uploaded", "claim"): "processing", ("processing", "finish"): "done", ("processing", "fail"): "failed", ("failed", "retry"): "uploaded"}.get((now, kind))
        if now == "processing" and kind == "claim" and at - since > 900:
            new = "processing"
        if kind == "retry" and retries >= 2:
            new = None
        if new:
            now, since, retries = new, at, retries + (kind == "retry")
            out.append((job, new, at))
        by[job] = (now, since, retries, at)
    return sorted(out)


def told(rows):
    return sorted((r.job, r.state, int(r.ts.timestamp())) for r in rows)


def table(spark, rows):
    return spark.createDataFrame(rows, "job long, at long, kind string").select("job", F.timestamp_seconds("at").alias("ts"), "kind")


def test_states_as_stream_and_batch(spark, tmp_path):
    rows = events(3)
    rows.sort(key=lambda r: r[1])
    df = table(spark, rows)
    assert told(jobs.job_states_batch(df).collect()) == brute_states(rows)
    for i, part in enumerate((rows[:150], rows[150:300], rows[300:])):
        table(spark, part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"n={i}"))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    stream = spark.readStream.schema("job long, ts timestamp, kind string").option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in" / "*"))
    q = jobs.job_states(stream, "1 hour").writeStream.format("memory").queryName("job_states_all").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    left = spark.read.format("statestore").option("path", str(tmp_path / "c")).option("stateVarName", "job").load()
    kept = {r.key.job for r in left.select("key").collect()}
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    assert told(spark.table("job_states_all").collect()) == brute_states(rows)
    last = max(r[1] for r in rows)
    idle = {j for j in {r[0] for r in rows} if max(r[1] for r in rows if r[0] == j) < last - 2 * 24 * 3600}
    assert 99 in kept and not kept & idle


def test_admission_is_all_or_nothing(spark):
    rng = random.Random(5)
    rows = [(i, 1_700_000_000 + rng.randint(0, 300_000), rng.randint(1, 8), rng.choice(["upload", "sample", "typed", "zzz"]), rng.choice([None, 1, 3, 9])) for i in range(2000)] + [(5000, None, 1, "upload", 1)]
    df = spark.createDataFrame(rows, "event_id long, at long, address long, kind string, pages int").select("event_id", F.timestamp_seconds("at").alias("ts"), "address", "kind", "pages")
    caps = {"upload": (9, 40), "sample": (5, 1000), "typed": (0, 10)}
    got = {r.event_id: (r.admitted, r.refusal) for r in jobs.admit_all(df, caps, 100).collect()}
    own, day, pages = {}, {}, {}
    for i, at, who, kind, n in sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, r[0])):
        d = None if at is None else at // 86400
        if kind == "typed":
            want = (False, "ip_limit")
        elif kind not in caps or d is None:
            want = (False, "daily_limit")
        elif own.get((d, kind, who), 0) >= caps[kind][0]:
            want = (False, "ip_limit")
        elif day.get((d, kind), 0) >= caps[kind][1] or kind == "upload" and pages.get(d, 0) + (n or 0) > 100:
            want = (False, "daily_limit")
        else:
            want = (True, None)
            own[d, kind, who] = own.get((d, kind, who), 0) + 1
            day[d, kind] = day.get((d, kind), 0) + 1
            pages[d] = pages.get(d, 0) + (n or 0) * (kind == "upload")
        assert got[i] == want
    assert sum(a for a, _ in got.values()) > 100 and {r for _, r in got.values()} == {None, "ip_limit", "daily_limit"}


def test_merging_is_replayable(spark, tmp_path):
    path, epochs = str(tmp_path / "out"), []
    rows = [[(1, 1, "p", "m", 2, "a", 1), (2, 1, "p", "m", 1, "x", 1)], [(1, 2, "p", "old", 2, "b", 2)], [(1, 2, "p", "m", 2, "c", 3), (3, 1, "p", "m", 2, None, 3)], [(1, 1, "p", "m", 2, "d", 4)]]

    class Stream:  # hands the epochs to the function that a stream would call
        sparkSession = spark

        def __getattr__(self, name):
            return lambda *a, **k: (epochs.append(a[0]) if name == "foreachBatch" else None) or self

    s = Stream()
    s.writeStream = s
    jobs.merge_stream(s, path, "c")
    make = lambda r: spark.createDataFrame([(*x[:6], day(x[6])) for x in r], jobs.READING)
    for i, r in enumerate(rows):
        epochs[0](make(r), i)
        epochs[0](make(r), i)  # the same epoch again
    ready = {(r.job, tuple(r["values"]), r.epoch) for r in spark.read.option("basePath", f"{path}/ready").parquet(f"{path}/ready").collect()}
    assert ready == {(2, ("x",), 0), (1, ("a", "c"), 2)}
    assert spark.read.parquet(f"{path}/readings").count() == sum(map(len, rows))


def test_merging_stream(spark, tmp_path):
    spark.createDataFrame([(1, 1, "p", "m", 1, "a", day(1))], jobs.READING).write.parquet(str(tmp_path / "in"))
    q = jobs.merge_stream(spark.readStream.schema(jobs.READING).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "c"))
    q.awaitTermination(120)
    assert [tuple(r["values"]) for r in spark.read.parquet(str(tmp_path / "out" / "ready")).collect()] == [("a",)]


@pytest.mark.parametrize("grid", [7, 64, 1000])
def test_overlaps_as_by_all_pairs(spark, grid):
    rng = random.Random(2)
    box = lambda: (lambda x, y: (x, y, x + rng.randint(0, 60), y + rng.randint(0, 40)))(rng.randint(-50, 300), rng.randint(0, 300))
    a, b = ([(rng.choice("de"), 1, i, *box()) for i in range(120)] for _ in range(2))
    schema = "doc string, page int, id int, x0 int, y0 int, x1 int, y1 int"
    got = sorted((r[0], r[1]) for r in extract.overlapping(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), grid=grid).select("a.id", "b.id").collect())
    want = sorted((x[2], y[2]) for x in a for y in b if x[0] == y[0] and min(x[5], y[5]) > max(x[3], y[3]) and min(x[6], y[6]) > max(x[4], y[4]))
    assert got == want and len(want) > 50


def test_answers_on_their_lines(spark):
    lines = spark.createDataFrame([("d", 1, 1, "Grand total Rs 1,65,850", 90, 0, 0, 100, 10), ("d", 1, 2, "Inverter: max PV", 90, 0, 20, 100, 30), ("d", 1, 3, "input 5 kW", 90, 0, 31, 100, 40), ("d", 1, 4, "Subsidy not applicable 78,000", 90, 0, 50, 100, 60), ("d", 1, 5, "GST 18% on 1,00,000", 90, 0, 70, 100, 80), ("d", 1, 6, "Reg. 27AAPFU0939F1ZV", 90, 0, 90, 100, 99), ("d", 1, 7, "Central and state subsidy 78,000 and 10,000", 90, 0, 110, 100, 120), ("d", 1, 8, "Faint 5,000", 30, 0, 130, 100, 140), ("d", 1, 9, "12 panels, DCR if available", 90, 0, 150, 100, 160)], "doc string, page int, line_no int, text string, confidence int, x0 int, y0 int, x1 int, y1 int")
    at = {1: (5, 2, 50, 8), 2: (5, 22, 50, 38), 4: (5, 52, 50, 58), 5: (5, 72, 50, 78), 6: (5, 92, 50, 98), 7: (5, 112, 50, 118), 8: (5, 132, 50, 138), 9: (5, 152, 50, 158)}
    none = (None,) * 4
    asked = [(1, "Rs 1,65,850", "amount", "", 90, at[1], None), (2, "1,65,850", "amount", "", 40, at[1], "low_confidence"), (3, "at actuals", "amount", "", 90, at[1], "unparsed"), (4, "1,65,850", "amount", "", 90, at[4], "not_on_page"), (5, "1,65,850", "amount", "", 90, none, None), (6, "5 kW", "capacity", "inverter_rating", 90, at[2], "input_not_output"), (7, "78,000", "amount", "", 90, at[4], "negated"), (8, "1,00,000", "amount", "", 90, at[5], "not_an_amount_on_its_line"), (9, "27AAPFU0939F1ZV", "registration", "", 90, at[6], "gstin"), (10, "78,000", "amount", "subsidy", 90, at[7], "not_an_amount_on_its_line"), (11, "5,000", "amount", "", 90, at[8], "low_confidence"), (12, "12 panels", "count", "", 90, at[9], None), (13, "DCR if available", "dcr", "", 90, at[9], "unparsed"), (14, "input 5 kW", "capacity", "x", 90, at[2], None), (15, "zero", "count", "", 90, none, "unparsed")]
    answers = spark.createDataFrame([("d", 1, i, raw, kind, field, c, *b) for i, raw, kind, field, c, b, _ in asked], "doc string, page int, answer_id int, raw string, kind string, field string, confidence int, x0 int, y0 int, x1 int, y1 int")
    got = {r.answer_id: r for r in extract.gate_answers(answers, lines).collect()}
    assert {i: r.why for i, r in got.items()} == {i: w for i, *_, w in asked}
    assert got[6].evidence == "Inverter: max PV\ninput 5 kW" and got[1].evidence == "Grand total Rs 1,65,850" and got[12].value == "12 panels"


def test_loose_answers(spark):
    rows = spark.createDataFrame([("a", 1, "w", "550 W"), ("a", 2, "w", "500 W"), ("b", 1, "w", "550 W")], "doc string, item int, field string, value string")
    loose = spark.createDataFrame([("a", "w", 0, "0.55 kW"), ("a", "w", 1, "600 W"), ("a", "m", 0, "X"), ("b", "m", 0, "X"), ("b", "c", 0, "5"), ("b", "c", 1, "6"), ("c", "w", 0, "1 kW"), ("c", "w", 1, "2 kW"), ("c", "m", 1, "Y"), ("c", "w", 1, "2000 W"), ("c", "w", 1, "3 kW"), ("c", "w", 2, None)], "doc string, field string, nth int, value string")
    got = sorted((r.doc, r.item, r.field, r.value, r.binding) for r in extract.bind_loose(rows, loose).collect() if r.binding != "row")
    fixed = [r for r in got if r[3] not in ("2 kW", "2000 W")]
    assert fixed == [("a", 1, "w", "600 W", "conflict"), ("a", 2, "w", "600 W", "conflict"), ("b", 1, "c", "5", "conflict"), ("b", 1, "c", "6", "conflict"), ("b", 1, "m", "X", "filled"), ("c", 0, "w", "1 kW", "paired"), ("c", 1, "m", "Y", "paired"), ("c", 1, "w", "3 kW", "conflict")]
    assert len(got) == 9 and all(r[4] == "conflict" for r in got if r not in fixed)


def test_corrections_by_path(spark):
    facts = spark.createDataFrame([("q", None, None, None, "gross_total", "1", 7), ("q", "A", None, None, "gross_total", "2", 7), ("q", "A", "module_groups", "G1", "wattage", "540 W", 7), ("q", None, "extra_charges", "E1", "amount", "5", 7)], "doc string, option string, list string, item string, field string, value string, page int")
    told_ = [("q", "gross_total", "3", 1), ("q", "gross_total", "4", 2), ("q", "net_cost", "9", 1), ("q", "module_groups[G1].wattage", "550", 1), ("q", "extra_charges[U3].amount", "6", 1), ("q", "extra_charges[U11].amount", "6", 1), ("q", "inverters[I1].rating", "3 kW", 1), ("q", "module_groups[G1].colour", "x", 1), ("q", "dcr_declaration", "yes", 1), ("q", "drop table", "x", 1)]
    c = spark.createDataFrame(told_, "doc string, path string, value string, at int")
    options = spark.createDataFrame([("q", "A")], "doc string, option string")
    once, errors = review.correct_paths(facts, c, options)
    key = lambda df: sorted((tuple(r) for r in df.select("option", "list", "item", "field", "value", "original", "corrected").collect()), key=repr)
    assert key(once) == sorted([
        (None, None, None, "gross_total", "1", None, False), ("A", None, None, "gross_total", "4", "2", True), (None, None, None, "net_cost", "9", None, True), ("A", "module_groups", "G1", "wattage", "550 W", "540 W", True),
        (None, "extra_charges", "E1", "amount", "5", None, False), ("A", "extra_charges", "U3", "amount", "6", None, True), (None, None, None, "dcr_declaration", "yes", None, True),
    ], key=repr)
    assert {(r.path, r.reason) for r in errors.collect()} == {("extra_charges[U11].amount", "unknown_item"), ("inverters[I1].rating", "unknown_item"), ("module_groups[G1].colour", "unknown_path"), ("drop table", "unknown_path")}
    twice, _ = review.correct_paths(once, c, options)
    assert key(twice) == key(once)
    again, _ = review.correct_paths(once, spark.createDataFrame([("q", "gross_total", "8", 1)], "doc string, path string, value string, at int"), options)
    assert ("A", None, None, "gross_total", "8", "2", True) in key(again)


def test_measures_compare(spark):
    same = [("3 kW", "3000 W"), ("3 kWp", "3.0 kW"), ("Rs 1,000", "1000"), ("ACME  x", "acme X"), ("1 - 2 kW", "1000 - 2000 W")]
    other = [("3 kW", "3 kVA"), ("3", "3 kW"), ("a", "b"), ("1 - 2 kW", "1 - 3 kW")]
    d = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(same + other)] + [(99, None, "x")], "i int, a string, b string")
    got = {r.i: (r.ka, r.kb) for r in T.with_comparable(T.with_comparable(d, "a", "ka"), "b", "kb").collect()}
    assert all((got[i][0] == got[i][1]) == (i < len(same)) for i in range(len(same + other))) and got[99][0] is None
    pred = spark.createDataFrame([("d", "w", "3 kW", False), ("d", "w", "1 kW", False), ("e", "w", "3 kVA", False), ("f", "w", "1 kW", False)], "doc string, field string, value string, conflict boolean")
    truth = spark.createDataFrame([("d", "w", "1000 W"), ("d", "w", "3000 W"), ("e", "w", "3 kW"), ("f", "w", "1 kW"), ("f", "w", "1 kW")], "doc string, field string, value string")
    assert {r.doc: r.status for r in evaluate.score_fields(pred, truth).collect()} == {"d": "correct", "e": "wrong", "f": "wrong"}


def test_checks_as_rows(spark):
    ops = [("q", "C3a", "base", 100.0), ("q", "C3a", "gst", 18.0), ("q", "C3a", "charge_inside", 5.0), ("q", "C3a", "charge_inside", 7.0), ("q", "C3a", "total", 130.0), ("q", "C2_special", "dc_kw", 2.5), ("q", "C2_special", "subsidy", 75_900.0), ("q", "C3a", "unknown", 99.0), ("r", "C1", "panel_watts", 3000.0), ("r", "C1", "stated_kw", 3.02)]
    findings = [("s", "q", "C3a", "consistent"), ("s", "q", "C2_special", "consistent"), ("s", "r", "C1", "consistent"), ("s", "r", "C3b", "consistent")]
    got = {(r.set, r.check): (r.n_agree, r.n_disagree) for r in evaluate.recheck_long(spark.createDataFrame(ops, "doc string, check string, operand string, value double"), spark.createDataFrame(findings, "set string, doc string, check string, status string")).collect()}
    assert got == {("s", "C3a"): (1, 0), ("s", "C2_special"): (1, 0), ("s", "C1"): (0, 1)}
