"""Job and review events: each job as a batch form and, where Spark's operators hold the state, as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.operators.ordered import ordered_fold

# Seconds after which a claim is stale, hours that records are kept, seconds a typed session lasts, caps.
STALE_SECONDS = 900
ALARM_WINDOW = "5 minutes"
KEPT_HOURS = {"job": 24, "counter": 48, "upload": 24, "log": 168}
SESSION_SECONDS = 900
CAPS = {"upload": (10, 200), "sample": (50, 1000), "typed": (200, 5000)}


def dedupe_uploads(log: DataFrame, kind: str = "signup") -> DataFrame:
    """The first event of a kind for each job."""
    first = F.row_number().over(Window.partitionBy("job").orderBy("ts", "event_id"))
    return log.where(F.col("kind") == kind).withColumn("r", first).where("r = 1").drop("r")


def _watermarked(log: DataFrame, delay: str) -> DataFrame:
    """Watermarks need a timestamp with time zone; one without is taken in the session's."""
    return log.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)


def dedupe_uploads_stream(log: DataFrame, delay: str = "1 hour") -> DataFrame:
    return _watermarked(log, delay).dropDuplicatesWithinWatermark(["job"])


def _before(rows: DataFrame, n: str, *groups: str) -> DataFrame:
    """groups, minute, before: the sum of n over all earlier minutes of the group; a group has as many rows here as it has minutes."""
    per = rows.groupBy(*groups, "__day", "__minute").agg(F.sum(n).alias("__n"))
    return per.select(*groups, "__minute", (F.sum("__n").over(Window.partitionBy(*groups, "__day").orderBy("__minute")) - F.col("__n")).alias("__before"))


def admit(log: DataFrame, per_address: int, per_day: int) -> DataFrame:
    """Unit requests (event_id, ts, job) with admitted: at most per_address a job and day, then at most per_day; a refused one takes nothing.

    Places within a day are sums over its earlier minutes and places within the minute, so that no task holds a day. Requests without a time are refused.
    """
    rows = log.withColumns({"__day": F.to_date("ts"), "__minute": F.date_trunc("minute", "ts"), "__one": F.lit(1)})
    inside = F.row_number().over(Window.partitionBy("job", "__minute").orderBy("ts", "event_id"))
    rows = rows.join(_before(rows, "__one", "job"), ["job", "__minute"], "left").withColumn("__own", (F.coalesce("__before", F.lit(0)) + inside <= per_address).cast("int")).drop("__before")
    place = F.sum("__own").over(Window.partitionBy("__minute").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("__place", place).join(_before(rows, "__own"), ["__minute"], "left")
    admitted = F.col("ts").isNotNull() & (F.col("__own") == 1) & (F.coalesce("__before", F.lit(0)) + F.col("__place") <= per_day)
    return rows.select(*log.columns, admitted.alias("admitted"))


def alarms(log: DataFrame, kinds: tuple[str, ...], watermark: str | None = None) -> DataFrame:
    """Windows of five minutes with events of an alarm kind; the same plan for batch and stream."""
    rows = _watermarked(log, watermark) if watermark else log
    per = rows.where(F.col("kind").isin(*kinds)).groupBy(F.window("ts", ALARM_WINDOW).alias("w"), "kind").agg(F.count("*").alias("n"))
    return per.select(F.col("w.start").alias("window_start"), "kind", "n")


def review_revisions(log: DataFrame) -> DataFrame:
    """event_id, job, revision: grows with every change of values, also back to earlier ones."""
    w = Window.partitionBy("job").orderBy("ts", "event_id")
    changed = F.coalesce(~F.col("value").eqNullSafe(F.lag("value").over(w)), F.lit(True)).cast("long")
    return log.withColumn("__c", changed).select("event_id", "job", F.sum("__c").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("revision"))


def read_budget(log: DataFrame, batches: int = 1) -> DataFrame:
    """Events of each job with allowed: the first four for each batch."""
    n = F.row_number().over(Window.partitionBy("job").orderBy("ts", "event_id"))
    return log.select("event_id", "job", (n <= 4 * batches).alias("allowed"))


def typed_sessions(log: DataFrame, gap: str = "900 seconds") -> DataFrame:
    """job, session_start, n: events no more than the gap apart."""
    per = log.groupBy(F.session_window("ts", gap).alias("w"), "job").agg(F.count("*").alias("n"))
    return per.select("job", F.col("w.start").alias("session_start"), "n")


def retention(log: DataFrame, now: str, hours: int = 24) -> DataFrame:
    return log.where(F.col("ts") >= F.to_timestamp(F.lit(now)) - F.expr(f"INTERVAL {hours} HOURS"))


def expired(records: DataFrame, now: str) -> DataFrame:
    """records (ts, record) with expired: older than their record's KEPT_HOURS. Records of other kinds, or without a time, never expire."""
    age = F.to_timestamp(F.lit(now)) - F.col("ts").cast("timestamp")
    over = F.coalesce(*[F.when(F.col("record") == k, age > F.expr(f"INTERVAL {h} HOURS")) for k, h in KEPT_HOURS.items()], F.lit(False))
    return records.withColumn("expired", over)


def typed_challenges(events: DataFrame) -> DataFrame:
    """Stream of (job, ts, value) to (job, ts, session, counter): the challenge each typed request gets.

    The same values keep the session's counter, changed ones move it on and renew its SESSION_SECONDS; a request after they are over starts the next
    session at 0. Values are held as a hash. State is kept by job, in Spark's state store; requests of a job count in order of time within a batch.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        session, counter, held, until = state.get if state.exists else (-1, 0, "", 0.0)
        rows = pd.concat(list(batches)).sort_values(["ts", "held"], kind="stable")
        out = []
        for ts, value in zip(rows["ts"], rows["held"], strict=True):
            at = ts.timestamp()
            if at >= until:
                session, counter, held, until = session + 1, 0, value, at + SESSION_SECONDS
            elif value != held:
                counter, held, until = counter + 1, value, at + SESSION_SECONDS
            out.append((key[0], ts, session, counter))
        state.update((session, counter, held, until))
        yield pd.DataFrame(out, columns=["job", "ts", "session", "counter"])

    keyed = events.where("job is not null and ts is not null").select("job", "ts", F.sha2(F.coalesce(F.col("value").cast("string"), F.lit("")), 256).alias("held"))
    return keyed.groupBy("job").applyInPandasWithState(step, "job long, ts timestamp, session int, counter int", "session int, counter int, held string, until double", "append", GroupStateTimeout.NoTimeout)


def failure_outcomes(log: DataFrame, reasons: DataFrame) -> DataFrame:
    """Counts by outcome: the reason dimension says whether a failure is retryable; unknown reasons are final."""
    j = log.join(F.broadcast(reasons), "kind", "left")
    return j.groupBy(F.when(F.coalesce("retryable", F.lit(False)), "retry").otherwise("final").alias("outcome"), "kind").agg(F.count("*").alias("n"))


def audit_log_fields(log: DataFrame, allowed: tuple[str, ...]) -> DataFrame:
    """event_id, extra: events whose props have fields outside the allow-list."""
    extra = F.array_except(F.json_object_keys("props"), F.array(*map(F.lit, allowed)))
    return log.withColumn("__e", extra).where(F.size("__e") > 0).select("event_id", F.array_join(F.array_sort("__e"), ",").alias("extra"))


_NEXT = {("awaiting_upload", "upload"): "uploaded", ("uploaded", "claim"): "processing", ("processing", "finish"): "done", ("processing", "fail"): "failed", ("failed", "retry"): "uploaded"}


def _moved(state: tuple, at: int, kind: str) -> tuple[tuple, str | None]:
    """(state, since, retries, seen) after an event at second `at`, and the state it moves to, if it does. A job unseen for longer than its record is kept starts anew."""
    now, since, retries, seen = state
    if seen and at - seen > 3600 * KEPT_HOURS["job"]:
        now, since, retries = _FRESH[:3]
    stale = now == "processing" and kind == "claim" and at - since > STALE_SECONDS
    new = "processing" if stale else _NEXT.get((now, kind))
    if new and kind == "retry" and retries >= 2:
        new = None
    if new:
        now, since, retries = new, at, retries + (kind == "retry")
    return (now, since, retries, max(seen, at)), new


_FRESH = ("awaiting_upload", 0, 0, 0)


def job_states(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Stream of (job, ts, kind) to (job, state, ts) on each legal transition.

    States: awaiting_upload, uploaded, processing, done, failed. A claim counts if the job is uploaded, or processing since over
    STALE_SECONDS; a retry at most twice; anything else is ignored. State is kept by job, in Spark's state store (RocksDB), until the watermark is KEPT_HOURS past the
    job's last event: a timer then removes it. Events of a job count in order of time within a batch. Events without job or time are ignored.
    """
    from pyspark.sql.streaming import StatefulProcessor

    class Jobs(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.job = handle.getValueState("job", "state string, since long, retries int, seen long")

        def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            state = tuple(self.job.get()) if self.job.exists() else _FRESH
            all_, out = pd.concat(list(rows)).sort_values(["ts", "kind"], kind="stable"), []
            for ts, kind in zip(all_["ts"], all_["kind"], strict=True):
                state, new = _moved(state, int(ts.timestamp()), kind)
                if new:
                    out.append((key[0], new, ts))
            self.job.update(state)
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(1000 * (state[3] + 3600 * KEPT_HOURS["job"] + 1))
            yield pd.DataFrame(out, columns=["job", "state", "ts"])

        def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            self.job.clear()
            yield pd.DataFrame([], columns=["job", "state", "ts"])

        def close(self) -> None:
            pass

    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = _watermarked(events.where("job is not null and ts is not null").select("job", "ts", "kind"), delay)
    return rows.groupBy("job").transformWithStateInPandas(Jobs(), "job long, state string, ts timestamp", "Append", "EventTime")


def job_states_batch(events: DataFrame) -> DataFrame:
    """The same transitions from a table of events: each job's events pass in order with its state as carry."""
    rows = events.where("job is not null and ts is not null").select("job", F.col("ts").cast("timestamp").alias("ts"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("__at"), "kind")
    step = lambda state, ts, at, kind: _moved(state, at, kind)
    return ordered_fold(rows, ["job"], ["ts", "kind"], lambda job: _FRESH, step, "state string").where("state is not null").select("job", "state", "ts")


PAGES_PER_DAY = 300


def admit_all(requests: DataFrame, caps: dict[str, tuple[int, int]] = CAPS, pages_per_day: int = PAGES_PER_DAY) -> DataFrame:
    """requests (event_id, ts, address, kind, pages) with admitted and refusal (ip_limit, daily_limit or null): all or nothing, a refused one takes nothing.

    Each kind has its slots for an address and a day and for all of a day (caps), and uploads the day's pages besides. A day's requests of a kind pass in order of time with
    what has been taken as carry: an entry for each address that was admitted, so never more than the day's slots. Days are UTC's of the session's
    time zone. Requests without a time or of another kind are refused as daily_limit; null pages are none.
    """

    def step(state: list, event_id: int, ts, address, pages: int) -> tuple[list, str]:
        kind, by_address, taken, read = state
        own, day = caps.get(kind, (0, 0))
        if own <= 0 and kind in caps:
            return state, "ip_limit"
        if day <= 0 or ts is None or ts != ts:
            return state, "daily_limit"
        if by_address.get(address, 0) >= own:
            return state, "ip_limit"
        if taken >= day or (kind == "upload" and read + pages > pages_per_day):
            return state, "daily_limit"
        by_address[address] = by_address.get(address, 0) + 1
        return [kind, by_address, taken + 1, read + pages * (kind == "upload")], ""

    rows = requests.select(F.to_date("ts").cast("string").alias("__day"), "kind", "event_id", "ts", "address", F.coalesce(F.col("pages").cast("long"), F.lit(0)).alias("pages"))
    out = ordered_fold(rows, ["__day", "kind"], ["ts", "event_id"], lambda day, kind: [kind, {}, 0, 0], step, "refusal string")
    return out.select("event_id", "ts", "address", "kind", "pages", (F.col("refusal") == "").alias("admitted"), F.nullif("refusal", F.lit("")).alias("refusal"))


READING = "job long, batch int, pages string, model string, n_batches int, value string, ts timestamp"


def merge_stream(readings: DataFrame, path: str, checkpoint: str):
    """Stream of page readings (READING) kept by (job, batch) under path/readings, and each job whose batches are all in written once under path/ready.

    Every epoch has a folder of its own, which a replay of the epoch writes again: nothing is added twice. The newest reading of a batch counts, if its pages and
    model are those of the job's newest reading plan. A job is ready in the first epoch with as many such batches as it has.
    """
    spark = readings.sparkSession

    def write(df: DataFrame, epoch: int) -> None:
        newest = df.groupBy("job", "batch").agg(F.max_by(F.struct("pages", "model", "n_batches", "value", "ts"), "ts").alias("r")).select("job", "batch", "r.*")
        newest.write.mode("overwrite").parquet(f"{path}/readings/epoch={epoch}")
        kept = spark.read.schema(f"{READING}, epoch long").option("basePath", f"{path}/readings").parquet(f"{path}/readings").where(F.col("epoch") <= epoch)
        touched = kept.join(F.broadcast(df.select("job").distinct()), "job", "left_semi") if df.select("job").distinct().count() <= 100_000 else kept
        whole, before = (complete_jobs(x) for x in (touched, touched.where(F.col("epoch") < epoch)))
        whole.join(before.select("job"), "job", "left_anti").write.mode("overwrite").parquet(f"{path}/ready/epoch={epoch}")

    return readings.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def complete_jobs(readings: DataFrame) -> DataFrame:
    """job, values: the readings of jobs of which all batches are in, in their order, from rows of READING with an epoch; older readings of a batch do not count, nor do those of another model."""
    newest = merged_readings(readings)
    plan = newest.groupBy("job").agg(F.max_by(F.struct("model", "n_batches"), F.struct("ts", "batch")).alias("plan"))
    fit = newest.join(plan, "job").where((F.col("model") == F.col("plan.model")) & F.col("batch").between(1, F.col("plan.n_batches")))
    per = fit.groupBy("job").agg(F.count("*").alias("n"), F.max("plan.n_batches").alias("want"), F.array_sort(F.collect_list(F.struct("batch", "value"))).alias("v"))
    return per.where("n = want").select("job", F.transform("v", lambda x: x["value"]).alias("values"))


def merged_readings(df: DataFrame) -> DataFrame:
    """The newest reading of each batch, by time and epoch."""
    rest = [c for c in df.columns if c not in ("job", "batch")]
    return df.groupBy("job", "batch").agg(F.max_by(F.struct(*rest), F.struct("ts", "epoch")).alias("r")).select("job", "batch", "r.*")
