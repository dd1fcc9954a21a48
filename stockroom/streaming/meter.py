"""The live meter of every transfer: rates, outages, alerts, stalls and reports, as one stateful operator.

Events (event_id, aid, at, kind, bytes, total) wait in the state of their artifact until the watermark has passed them and are
then folded in order of time, so what comes out depends neither on how a stream was cut into batches nor on the order
in which rows arrived. An event-time timer stands at the next moment at which something is due, be it an event that waits, a
stall, a report owed or the end of an idle artifact; so stalls and heartbeats are told when no event comes.

What comes out, `what` by `what`:
- sample, with each event: done, rate over the window, smoothed rate, hash_rate while digests are all that moves, retries;
- outage, when it ends: seconds and attempts from its first failed attempt to the first network bytes of an attempt begun since;
- alert, once for each reason: network bytes at the cap, the deadline, the free space under the floor;
- report, when the phase or the percent changes and at `heartbeat` after the last one sent while bytes remain: phase, percent, eta, rates.

Phases, the first that holds: offline (an outage is open), retrying (attempts since the last byte), verifying (a digest is
what moved last), stalled (no byte for `stall` while bytes remain), starting (no pace yet), downloading.

Scale: state and order are by artifact. An artifact holds the events of the last `WATERMARK` and of one window, 24 rates and at most
`points` points; one without an event for `idle` leaves the state. Needs the RocksDB state store, which `stores` sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from stockroom.streaming.telemetry import EMA, MOVING, WATERMARK

OUT = "aid long, at timestamp, what string, done long, rate double, ema double, hash_rate double, retries long, phase string, percent long, eta double, rates array<double>, reason string, seconds double, attempts long"
COLUMNS = [c.split()[0] for c in OUT.split(", ")]
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
DAY = 86_400_000


@dataclass(frozen=True)
class Settings:
    """Times in milliseconds; a cap, deadline or floor of None never alerts."""

    window: int = 8_000
    least_span: int = 400
    stall: int = 15_000
    fresh: int = 2_000
    heartbeat: int = 300_000
    point_every: int = 5_000
    points: int = 60
    horizon: int = 30_000
    rate_every: int = 5_000
    rates: int = 24
    idle: int = 7 * DAY
    cap: int | None = None
    deadline: int | None = None
    free: int = 0
    floor: int | None = None


@dataclass
class Meter:
    """What is kept of an artifact: plain values, and four lists."""

    total: int = 0
    start: int | None = None
    byte_at: int = 0
    done: int = 0
    network: int = 0
    moved: int = 0
    hashed: int = 0
    retries: int = 0
    hashing: bool = False
    down_since: int | None = None
    attempts: int = 0
    in_flight: bool = False
    ema: float | None = None
    held: float | None = None
    rated_at: int | None = None
    pointed_at: int | None = None
    last: int = 0
    phase: str | None = None
    percent: int = 0
    sent_at: int = 0
    stall_told: bool = False
    samples: list[tuple[int, int, int]] = field(default_factory=list)  # time, done, hashed
    points: list[tuple[int, int]] = field(default_factory=list)  # time, done
    rates: list[tuple[float]] = field(default_factory=list)
    fired: set[str] = field(default_factory=set)

    def remaining(self) -> int:
        return max(0, self.total - self.done)

    def next_moment(self, s: Settings) -> int | None:
        """When a stall begins or a report is owed."""
        if self.start is None or not self.remaining():
            return None
        owed = self.sent_at + s.heartbeat
        return owed if self.stall_told or self.hashing else min(owed, self.byte_at + s.stall)

    def state(self, now: int, s: Settings) -> tuple[str, float | None]:
        """Phase and seconds to go."""
        quiet = now - self.byte_at
        stalled = quiet >= s.stall and self.remaining() > 0 and not self.hashing
        pace = self.ema
        if len(self.points) > 1 and self.points[-1][0] - self.points[0][0] >= s.horizon:
            (t0, b0), (t1, b1) = self.points[0], self.points[-1]
            pace = max(0.0, (b1 - b0) / ((t1 - t0) / 1000))
        if not self.remaining() and self.total:
            eta = 0.0
        elif stalled:
            eta = self.held = None
        elif pace and pace > 1 and self.remaining() and quiet < s.fresh:
            eta = self.held = self.remaining() / pace
        else:
            eta = self.held
        if self.down_since is not None:
            return "offline", eta
        if self.retries and self.remaining():
            return "retrying", eta
        if self.hashing or stalled:
            return "verifying" if self.hashing else "stalled", eta
        return "starting" if eta is None and not self.ema else "downloading", eta

    def report(self, now: int, s: Settings) -> Iterator[dict[str, Any]]:
        """A report, if it says something new or is owed."""
        phase, eta = self.state(now, s)
        percent = min(100, self.done * 100 // self.total) if self.total else 0
        if (phase, percent) != (self.phase, self.percent) or now - self.sent_at >= s.heartbeat and self.remaining():
            self.phase, self.percent, self.sent_at = phase, percent, now
            yield {"ms": now, "what": "report", "done": self.done, "phase": phase, "percent": percent, "eta": eta, "rates": [r for (r,) in self.rates]}

    def moment(self, now: int, s: Settings) -> Iterator[dict[str, Any]]:
        """Time went on without an event."""
        if now >= self.byte_at + s.stall:
            self.stall_told = True
        yield from self.report(now, s)

    def event(self, now: int, kind: str, n: int, total: int, s: Settings) -> Iterator[dict[str, Any]]:
        if self.start is None:
            self.start = self.byte_at = now
        self.total, self.last = total, now
        if kind == "network" and n > 0:
            self.network += n
            if self.down_since is not None and self.in_flight:
                yield {"ms": now, "what": "outage", "seconds": (now - self.down_since) / 1000, "attempts": self.attempts}
                self.down_since, self.attempts, self.in_flight = None, 0, False
        elif kind == "offline":
            if self.down_since is None:
                self.down_since = now
            self.attempts, self.in_flight = self.attempts + 1, False
        elif kind == "retry":
            self.retries, self.in_flight = self.retries + 1, True
        elif kind == "hash":
            self.hashed, self.hashing = self.hashed + n, True
        if kind in MOVING:
            self.hashing, self.moved = False, self.moved + n
        done = min(total, self.moved) if total else self.moved
        if done != self.done:
            self.done, self.byte_at, self.retries, self.stall_told = done, now, 0, False
        rate, hash_rate = self.sample(now, s)
        yield {"ms": now, "what": "sample", "done": done, "rate": rate, "ema": self.ema, "hash_rate": hash_rate if self.hashing else None, "retries": self.retries}
        for reason, hit in (("cap", s.cap is not None and self.network >= s.cap), ("deadline", s.deadline is not None and now >= s.deadline), ("free", s.floor is not None and s.free - self.moved < s.floor)):
            if hit and reason not in self.fired:
                self.fired.add(reason)
                yield {"ms": now, "what": "alert", "reason": reason}
        yield from self.report(now, s)

    def sample(self, now: int, s: Settings) -> tuple[float | None, float | None]:
        """Rates of bytes and of digests over the window, which ends here."""
        self.samples = [x for x in self.samples if x[0] >= now - s.window] + [(now, self.done, self.hashed)]
        if self.pointed_at is None or now - self.pointed_at >= s.point_every:
            self.pointed_at = now
            self.points = [*self.points, (now, self.done)][-s.points :]
        (t0, b0, h0), (t1, b1, h1) = self.samples[0], self.samples[-1]
        if len(self.samples) < 2 or t1 - t0 < s.least_span:
            return None, None
        rate = max(0.0, (b1 - b0) / ((t1 - t0) / 1000))
        self.ema = rate if self.ema is None else EMA * rate + (1 - EMA) * self.ema
        if self.rated_at is None or now - self.rated_at >= s.rate_every:
            self.rated_at = now
            self.rates = [*self.rates, (self.ema,)][-s.rates :]
        return rate, max(0.0, (h1 - h0) / ((t1 - t0) / 1000))


#: Plain values of a meter, as a row of state.
PLAIN = "total long, start long, byte_at long, done long, network long, moved long, hashed long, retries long, hashing boolean, down_since long, attempts long, in_flight boolean, ema double, held double, rated_at long, pointed_at long, last long, phase string, percent long, sent_at long, stall_told boolean"
FIELDS = [c.split()[0] for c in PLAIN.split(", ")]
WHOLE = {c.split()[0] for c in PLAIN.split(", ") if c.split()[1] == "long"}


#: The lists of a meter, column by column.
LISTS = "sample_ms array<long>, sample_done array<long>, sample_hashed array<long>, point_ms array<long>, point_done array<long>, rates array<double>, fired array<string>"
WAITING = "ms array<long>, event_id array<long>, kind array<string>, bytes array<long>, total array<long>"


def columns(rows: list[tuple[Any, ...]], n: int) -> list[list[Any]]:
    return [list(c) for c in zip(*rows)] if rows else [[] for _ in range(n)]


class MeterProcessor(StatefulProcessor):
    """Every access to the state is a message to the JVM, and every row of it is packed by itself: so events wait as one row for
    each time that they were handed over, and the lists of a meter are one row."""

    def __init__(self, settings: Settings):
        self.settings = settings

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.plain = handle.getValueState("plain", PLAIN)
        self.lists = handle.getValueState("lists", LISTS)
        self.waiting = handle.getListState("waiting", WAITING)

    def handleInputRows(self, key: tuple[Any, ...], rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        new = [[] for _ in range(5)]
        for part in rows:
            for values, c in zip(new, ("ms", "event_id", "kind", "bytes", "total")):
                values += part[c].tolist()
        if not new[0]:
            return
        self.waiting.appendValue(tuple(new))
        timers = list(self.handle.listTimers())
        first = min(new[0])
        if not timers or first < min(timers):
            for t in timers:
                self.handle.deleteTimer(t)
            self.handle.registerTimer(first)
        yield from ()

    def handleExpiredTimer(self, key: tuple[Any, ...], timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto, s = timerValues.getCurrentWatermarkInMs(), self.settings
        meter = self.load()
        waiting = sorted(event for held in self.waiting.get() for event in zip(*held))
        ready, later = [w for w in waiting if w[0] < upto], [w for w in waiting if w[0] >= upto]
        out: list[dict[str, Any]] = []
        for ms, _, kind, n, total in [*ready, (upto, None, None, None, None)]:
            while (moment := meter.next_moment(s)) is not None and moment < min(ms, meter.last + s.idle):
                out += meter.moment(moment, s)
            if meter.start is not None and ms > meter.last + s.idle:
                meter = Meter()
            if kind is not None:
                out += meter.event(ms, kind, n, total, s)
        self.save(meter)
        if ready:
            self.waiting.put([tuple(columns(later, 5))]) if later else self.waiting.clear()
        moments = [later[0][0]] if later else []
        if meter.start is not None:
            moments += [meter.last + s.idle + 1] + [m for m in [meter.next_moment(s)] if m is not None]
        if moments:
            self.handle.registerTimer(max(min(moments), upto + 1))
        if out:
            frame = pd.DataFrame([tuple(map(row.get, COLUMNS)) for row in out], columns=COLUMNS, dtype=object)
            frame["aid"] = pd.Series([key[0]] * len(out), dtype=object)
            frame["at"] = np.array([row["ms"] for row in out], "datetime64[ms]").astype("datetime64[ns]")
            yield frame

    def load(self) -> Meter:
        plain = self.plain.get()
        if plain is None:
            return Meter()
        row = (None if v is None or v != v else v for v in plain)
        m = Meter(**{k: int(v) if k in WHOLE and v is not None else v for k, v in zip(FIELDS, row)})
        *lists, rates, fired = self.lists.get()
        m.samples, m.points, m.rates, m.fired = list(zip(*lists[:3])), list(zip(*lists[3:])), [(r,) for r in rates], set(fired)
        return m

    def save(self, m: Meter) -> None:
        if m.start is None:
            self.plain.clear()
            self.lists.clear()
        else:
            self.plain.update(tuple(getattr(m, c) for c in FIELDS))
            self.lists.update((*columns(m.samples, 3), *columns(m.points, 2), [r for (r,) in m.rates], sorted(m.fired)))

    def close(self) -> None:
        pass


def meter(events: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The live meter of a stream. Copies of an event count once; rows later than the watermark are dropped, and those without a
    time or an id. Bytes that aren't stated are none, and an artifact without a total has no percent and never stalls."""
    once = events.where("at is not null and event_id is not null").withWatermark("at", WATERMARK).dropDuplicatesWithinWatermark(["event_id"])
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    once = once.select("aid", "at", "event_id", F.unix_millis("at").alias("ms"), F.coalesce("kind", F.lit("")).alias("kind"), zero("bytes"), zero("total"))
    return once.groupBy("aid").transformWithStateInPandas(MeterProcessor(settings), OUT.replace("aid long", f"aid {events.schema['aid'].dataType.simpleString()}"), "Append", "EventTime")


@contextmanager
def stores(spark: SparkSession) -> Iterator[None]:
    """Streams started within keep their state in RocksDB, as several state variables and timers need."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)
