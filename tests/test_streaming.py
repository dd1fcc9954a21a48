import datetime as dt
import random
import tempfile
from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import functions as F

from stockroom.plans.registry import cut
from stockroom.streaming import appends, meter, telemetry

START = dt.datetime(2024, 1, 1)


def events(spark, rows):
    return spark.createDataFrame([(k, 1, START + dt.timedelta(seconds=s), kind, n, 100) for k, (s, kind, n) in enumerate(rows)], "event_id long, aid long, at timestamp, kind string, bytes long, total long")


def as_stream(spark, frame):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    frame.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return spark.readStream.schema(frame.schema).parquet(f"{folder}/in"), folder


def test_rollup_stream_equals_batch(spark):
    frame = events(spark, [(0, "network", 10), (1, "network", 5), (6, "retry", 0), (7, "network", 9), (500, "network", 1)])
    frame = frame.union(frame.where("event_id = 1"))  # a copy of an event
    stream, folder = as_stream(spark, frame)
    got = {(r["start"], r["bytes"], r["events"], r["retries"]) for r in telemetry.drained(telemetry.rollup(stream), folder).collect()}
    want = {(r["start"], r["bytes"], r["events"], r["retries"]) for r in telemetry.rollup(frame).collect()}
    assert got <= want and len(got) >= 2  # the last window stays open


def metered(spark, frames, **settings):
    """The live meter over frames that come one after another, the stream being started anew for each."""
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    with meter.stores(spark):
        for frame in frames:
            frame.coalesce(1).write.mode("append").parquet(f"{folder}/in")
            stream = spark.readStream.schema(frame.schema).parquet(f"{folder}/in")
            out = telemetry.drained(meter.meter(stream, meter.Settings(**settings)), folder)
    return [r.asDict() | {"s": (r["at"] - START).total_seconds()} for r in out.orderBy("at", "what").collect()]


def test_meter_reports_stalls_outages_and_completion(spark):
    log = [(0, "network", 10), (2, "network", 20), (30, "offline", 0), (31, "offline", 0), (33, "network", 0), (34, "retry", 0), (36, "network", 30), (40, "local", 40), (50, "hash", 7), (400, "online", 0), (500, "online", 0)]
    rows = metered(spark, [events(spark, log)], cap=40, floor=0, free=50)
    reports = [(r["s"], r["phase"], r["percent"]) for r in rows if r["what"] == "report"]
    assert reports == [(0, "starting", 10), (2, "downloading", 30), (17, "stalled", 30), (30, "offline", 30), (36, "downloading", 60), (40, "downloading", 100), (50, "verifying", 100)]
    assert [(r["s"], r["seconds"], r["attempts"]) for r in rows if r["what"] == "outage"] == [(36, 6.0, 2)]
    assert [(r["s"], r["reason"]) for r in rows if r["what"] == "alert"] == [(36, "cap"), (36, "free")]
    samples = {r["s"]: r for r in rows if r["what"] == "sample"}
    assert samples[2]["rate"] == 10 and samples[36]["retries"] == 0 and samples[34]["retries"] == 1 and 500 not in samples
    assert next(r for r in rows if r["s"] == 40 and r["what"] == "report")["eta"] == 0


def test_heartbeats_go_on_without_events_until_the_artifact_is_idle(spark):
    rows = metered(spark, [events(spark, [(0, "network", 10), (1000, "online", 0), (1100, "online", 0)]), events(spark, [(5000, "network", 1), (9000, "online", 0)])], idle=1_500_000)
    reports = [(r["s"], r["phase"]) for r in rows if r["what"] == "report"]
    assert reports[:5] == [(0, "starting"), (15, "stalled"), (315, "stalled"), (615, "stalled"), (915, "stalled")]
    assert (2415, "stalled") in reports and not any(2600 < s < 5000 for s, _ in reports)  # 1500 s after the last event
    assert (5000, "starting") in reports  # begun afresh


class Held:
    """A state variable that counts the rows written to it."""

    def __init__(self):
        self.rows, self.written = [], 0

    def exists(self):
        return bool(self.rows)

    def get(self):
        return iter(self.rows)

    def put(self, rows):
        self.rows, self.written = list(rows), self.written + len(rows)

    def appendList(self, rows):
        self.put([*self.rows, *rows])

    def appendValue(self, row):
        self.appendList([row])

    def clear(self):
        self.rows = []


class Value(Held):
    def get(self):
        return self.rows[0] if self.rows else None

    def update(self, row):
        self.put([row])

    keys, updateValue = (lambda self: iter(())), (lambda self, *row: self.put([row]))


class Handle:
    def __init__(self):
        self.kept, self.timers = [], []

    def made(self, kind):
        self.kept.append(kind())
        return self.kept[-1]

    getValueState = getMapState = lambda self, *_: self.made(Value)
    getListState = lambda self, *_: self.made(Held)
    listTimers = lambda self: iter(self.timers)
    registerTimer = lambda self, t: self.timers.append(t)
    deleteTimer = lambda self, t: self.timers.remove(t)


@pytest.mark.parametrize("n", [10, 300])
def test_meter_writes_few_rows_of_state_whatever_the_events(n):
    """Each row of state is packed by itself, so an artifact's events aren't a row each."""
    handle, processor = Handle(), meter.MeterProcessor(meter.Settings(idle=10**9))
    processor.init(handle)
    rows = pd.DataFrame({"ms": range(0, n * 1000, 1000), "event_id": range(n), "kind": "network", "bytes": 5, "total": 10**6})
    assert list(processor.handleInputRows((1,), iter([rows]), None)) == [] and handle.timers == [0]
    told = pd.concat(processor.handleExpiredTimer((1,), SimpleNamespace(getCurrentWatermarkInMs=lambda: n * 1000 - 1500), None))
    assert (told["what"] == "sample").sum() == n - 1 and told["done"].max() == 5 * (n - 1)
    assert sum(x.written for x in handle.kept) <= 6


def test_meter_restarted_from_its_checkpoint_tells_the_same(spark):
    rng = random.Random(6)
    log, t = [], 0.0
    for _ in range(150):
        t += rng.choice([0.3, 0.5, 1, 2, 6, 16, 40])
        log.append((t, rng.choice(["network", "network", "local", "hash", "retry", "offline", "online"]), rng.randrange(3)))
    whole = events(spark, log)
    parts = [whole.where(F.col("event_id").between(*k)) for k in ((0, 39), (40, 41), (42, 110), (111, 149))]
    assert metered(spark, [whole], cap=20) == metered(spark, parts, cap=20)


def test_eta_and_rates_follow_the_last_minutes():
    fold, s, now = meter.Meter(), meter.Settings(), 0
    for k in range(200):  # 100 a second, then 50
        now = k * 1000
        list(fold.event(now, "network", 100 if k < 100 else 50, 100_000, s))
    assert len(fold.points) <= 60 and len(fold.rates) == 24 and abs(fold.ema - 50) < 1
    (t0, b0), (t1, b1) = fold.points[0], fold.points[-1]
    phase, eta = fold.state(now, s)
    assert phase == "downloading" and eta == fold.remaining() / ((b1 - b0) / ((t1 - t0) / 1000))
    assert fold.state(now + 5_000, s) == ("downloading", eta)  # held while quiet
    assert fold.state(now + 15_000, s) == ("stalled", None)


def test_replayed_batch_adds_nothing(spark, tmp_path):
    append = appends.once(str(tmp_path / "log"))
    append(spark.range(5), 0)
    append(spark.range(5), 0)
    spark.range(3).write.parquet(str(tmp_path / "log/batch=1"))
    (tmp_path / "log/batch=1/_SUCCESS").unlink()  # broke off
    append(spark.range(7), 1)
    assert spark.read.parquet(str(tmp_path / "log")).groupBy("batch").count().orderBy("batch").collect() == [(0, 5), (1, 7)]


def test_stream_meets_record(spark):
    seen = spark.createDataFrame([("a", "p", "1"), ("a", "q", "2"), ("a", "r", "3")], "aid string, path string, sha256 string")
    want = spark.createDataFrame([("a", "p", "1"), ("a", "q", "9")], "aid string, path string, sha256 string")
    stream, folder = as_stream(spark, seen)
    got = {r["path"]: r["verdict"] for r in telemetry.drained(telemetry.verified_as_landed(stream, want), folder).collect()}
    assert got == {"p": "verified", "q": "mismatched", "r": "extra"}


def test_outages_and_alerts(spark):
    log = events(spark, [(0, "network", 5), (3, "retry", 0), (9, "retry", 0), (12, "local", 1), (20, "retry", 0)]).withColumn("ts", F.unix_timestamp("at"))
    out = sorted((r["seconds"], r["attempts"]) for r in telemetry.batch_outages(log, cut).collect() if r["seconds"] is not None)
    assert out == [(9, 2)]
    assert telemetry.batch_outages(log, cut).where("ended is null").count() == 1
    assert telemetry.batch_budget_alerts(log, 5, cut).count() == 1 and telemetry.batch_budget_alerts(log, 6, cut).count() == 0


def test_stalls_need_remaining_bytes_and_no_digest(spark):
    log = events(spark, [(0, "network", 5), (20, "hash", 1), (50, "network", 5), (60, "hash", 1), (90, "network", 85), (120, "network", 5), (200, "online", 0), (300, "local", 5)]).withColumn("ts", F.unix_timestamp("at"))
    start = int(START.replace(tzinfo=dt.timezone.utc).timestamp())
    got = sorted((r["quiet_from"] - start, r["quiet_to"] - start) for r in telemetry.batch_stalls(log, cut).collect())
    assert got == [(0, 20), (90, 120)]  # after 120 s all has come


def test_heartbeats_count_from_the_last_report_sent(spark):
    rows = [("a", t, "downloading", 1) for t in (0, 200, 400, 590, 700, 1000)] + [("a", 1001, "stalled", 1), ("b", 5, "stalled", 1)]
    out = telemetry.due(spark.createDataFrame(rows, "aid string, ts long, phase string, percent int")).collect()
    assert sorted((r["aid"], r["ts"]) for r in out) == [("a", 0), ("a", 400), ("a", 700), ("a", 1000), ("a", 1001), ("b", 5)]
