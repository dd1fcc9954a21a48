"""Live transfer accounting: rates, stalls, outages and alerts from events (event_id, aid, ts, kind, bytes).

Kinds: network, local, hash, retry, offline, online. Functions named `batch_*` answer over a finished log; the others
take a stream (or a table) with an event-time column `at`. Late rows beyond the watermark are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from stockroom.operators.ranks import Cut, first_rows, running

WATERMARK = "30 seconds"
RATE_SECONDS = 8
EMA = 0.35
#: 0.65 to this power is under 2**-150.
FOLDED = 256
STALL_SECONDS = 15
HEARTBEAT_SECONDS = 300
MOVING = ("network", "local")


def by_time(*more: str):
    return Window.partitionBy("aid").orderBy("ts", "event_id", *more)


def summed(events: DataFrame, value: Column, name: str, cut: Cut) -> DataFrame:
    """`events` with the sum of `value` up to and with each, taken in parts, so that a busy artifact is no single task."""
    x = running(events.withColumn("__value", value), ["aid"], ["ts", "event_id"], cut, "__value")
    return x.select(*events.columns, F.col("upto").alias(name))


def moved_bytes(kinds: tuple[str, ...] = MOVING) -> Column:
    return F.when(F.col("kind").isin(*kinds), F.col("bytes")).otherwise(0)


def recent(events: DataFrame, seconds: int) -> tuple[DataFrame, WindowSpec]:
    """Rows in stretches of `seconds` (`own`) and again as those before the next stretch (not `own`), and the window of the
    last `seconds` of a row, which lies within its stretch."""
    at = F.floor(F.col("ts") / seconds)
    x = events.withColumn("s", F.explode(F.array(F.struct(at.alias("stretch"), F.lit(True).alias("own")), F.struct((at + 1).alias("stretch"), F.lit(False).alias("own"))))).select(*events.columns, "s.*")
    return x, Window.partitionBy("aid", "stretch").orderBy("ts").rangeBetween(-seconds, 0)


def batch_done(events: DataFrame, totals: DataFrame, cut: Cut) -> DataFrame:
    """Bytes done after each event, clamped at the artifact's total."""
    return summed(events, moved_bytes(), "sum", cut).join(totals, "aid").select("event_id", "aid", F.least("sum", "total").alias("done"))


def batch_rate(events: DataFrame, cut: Cut, seconds: int = RATE_SECONDS, kinds: tuple[str, ...] = MOVING) -> DataFrame:
    """Bytes a second over the last `seconds` at each event; unknown with one sample or no span, never negative."""
    x, w = recent(summed(events, moved_bytes(kinds), "sum", cut), seconds)
    span, moved = F.max("ts").over(w) - F.min("ts").over(w), F.max("sum").over(w) - F.min("sum").over(w)
    rate = F.when(span > 0, F.floor(F.greatest(moved, F.lit(0)) / span).cast("long"))
    return x.withColumn("rate", rate).where("own").select("event_id", "aid", "rate")


def batch_retries(events: DataFrame, cut: Cut) -> DataFrame:
    """Attempts since the last byte, at each event."""
    x = summed(events, F.col("kind").isin(*MOVING).cast("long"), "island", cut)
    w = Window.partitionBy("aid", "island").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return x.select("event_id", "aid", F.sum(F.when(F.col("kind") == "retry", 1).otherwise(0)).over(w).alias("retries"))


def batch_outages(events: DataFrame, cut: Cut) -> DataFrame:
    """Outages: from the first failed attempt to the first byte after it, with attempts and seconds; open ones have no end."""
    x = events.where(F.col("kind").isin("retry", *MOVING)).withColumn("moved", F.col("kind").isin(*MOVING).cast("int"))
    x = summed(x, F.col("moved"), "upto", cut).withColumn("island", F.col("upto") - F.col("moved"))
    out = x.groupBy("aid", "island").agg(F.min(F.when(F.col("moved") == 0, F.col("ts"))).alias("started"), F.max(F.when(F.col("moved") == 1, F.col("ts"))).alias("ended"), F.count_if(F.col("moved") == 0).alias("attempts"))
    return out.where("attempts > 0").select("aid", "started", "ended", (F.col("ended") - F.col("started")).alias("seconds"), "attempts")


def batch_stalls(events: DataFrame, cut: Cut, seconds: int = STALL_SECONDS) -> DataFrame:
    """Gaps of `seconds` or more after a moment at which bytes moved, while bytes of the artifact's `total` remain. A digest ends a
    gap as bytes do: while digests are all that goes on, nothing is stalled."""
    busy = events.where(F.col("kind").isin(*MOVING, "hash")).withColumn("__moved", moved_bytes())
    x = running(busy, ["aid"], ["ts", "event_id"], cut, "__moved")
    after = x.select("aid", (F.col("rank") - 1).alias("rank"), F.col("ts").alias("quiet_to"))
    x = x.where((F.col("kind") != "hash") & (F.col("upto") < F.col("total"))).join(after, ["aid", "rank"])
    return x.where(F.col("quiet_to") - F.col("ts") >= seconds).select("aid", F.col("ts").alias("quiet_from"), "quiet_to")


def batch_budget_alerts(events: DataFrame, cap: int, cut: Cut) -> DataFrame:
    """The first event of each artifact at which network bytes reach the cap."""
    return summed(events, moved_bytes(("network",)), "used", cut).where(F.col("used") >= cap).groupBy("aid").agg(F.min(F.struct("ts", "event_id", "used")).alias("first")).select("aid", "first.ts", "first.event_id", "first.used")


def batch_alerts(events: DataFrame, cap: int, deadline: int, floor: int, cut: Cut) -> DataFrame:
    """The first event of each artifact at which network bytes reach the cap, the deadline has come, or what is free on
    its disk (`free` at the start, less what has moved) falls under the floor; each reason fires once."""
    x = summed(summed(events, moved_bytes(("network",)), "used", cut), moved_bytes(), "moved", cut)
    x = x.withColumns({"cap": F.col("used") >= cap, "deadline": F.col("ts") >= deadline, "free": F.col("free") - F.col("moved") < floor})
    fired = x.select("aid", "ts", "event_id", F.explode(F.array_compact(F.array(*(F.when(F.col(r), F.lit(r)) for r in ("cap", "deadline", "free"))))).alias("reason"))
    return fired.groupBy("aid", "reason").agg(F.min(F.struct("ts", "event_id")).alias("first")).select("aid", "reason", "first.ts", "first.event_id")


def batch_hash_rate(events: DataFrame, cut: Cut, seconds: int = RATE_SECONDS) -> DataFrame:
    """Hashed bytes a second over the last `seconds` at each hash event; unknown while anything else moves."""
    x, w = recent(events, seconds)
    rates = batch_rate(events, cut, seconds, ("hash",)).select("event_id", "rate")
    alone = x.withColumn("others", F.count_if(F.col("kind").isin(*MOVING)).over(w)).where("own and kind = 'hash'").select("event_id", "aid", "others")
    return alone.join(rates, "event_id").select("event_id", "aid", F.when(F.col("others") == 0, F.col("rate")).alias("rate"))


def batch_eta(points: DataFrame, most: int = 60, least_span: int = 30) -> DataFrame:
    """Seconds to go at each point (aid, ts, done, total, rate, quiet, stalled) of an artifact.

    The pace is that of the last `most` points where they span `least_span` seconds or more, else `rate`. Nothing is left
    to do: 0; stalled, or no pace: null; while quiet, what was last told holds."""
    w = Window.partitionBy("aid").orderBy("ts")
    seen = w.rowsBetween(-(most - 1), 0)
    span, gained = F.col("ts") - F.min("ts").over(seen), F.col("done") - F.first("done").over(seen)
    pace = F.when(span >= least_span, gained / span).otherwise(F.col("rate"))
    fresh = F.when(F.col("done") >= F.col("total"), 0.0).when(~F.col("stalled") & (pace > 0), (F.col("total") - F.col("done")) / pace)
    x = points.withColumn("fresh", fresh).withColumn("told", F.when(~F.col("quiet") | (F.col("done") >= F.col("total")), F.struct("fresh")))
    held = F.last("told", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)).getField("fresh")
    return x.select("aid", "ts", F.when(F.col("stalled"), F.lit(None)).otherwise(held).alias("eta"))


def due(reports: DataFrame, every: int = HEARTBEAT_SECONDS) -> DataFrame:
    """Reports (aid, ts, phase, percent) to send: a change of phase or percent, or `every` seconds since the last one sent.

    Each choice stands on the one before it. So an artifact's reports pass sorted through one task, which keeps the last one sent."""
    dealt = reports.select("aid", "ts", "phase", "percent").repartition("aid").sortWithinPartitions("aid", "ts")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = ()
        for batch in batches:
            sent = []
            for aid, ts, *key in zip(*(c.to_pylist() for c in batch.columns)):
                send = not last or (aid, key) != last[:2] or ts - last[2] >= every
                sent.append(send)
                if send:
                    last = (aid, key, ts)
            yield batch.filter(pa.array(sent, pa.bool_()))

    return dealt.mapInArrow(work, dealt.schema)


def batch_ema(events: DataFrame, cut: Cut, share: float = EMA, seconds: int = RATE_SECONDS) -> DataFrame:
    """The smoothed rate after all of an artifact's events: each new rate counts `share`.

    Only the last FOLDED rates are folded: those before them weigh less than a double resolves."""
    rates = batch_rate(events, cut, seconds).join(events.select("event_id", "ts"), "event_id").where("rate is not null")
    rates = first_rows(rates, ["aid"], [F.col("ts").desc(), F.col("event_id").desc()], FOLDED)
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "rate"))), lambda x: x.rate.cast("double"))
    fold = F.aggregate(F.slice(F.col("r"), 2, F.greatest(F.size("r"), F.lit(1))), F.get(F.col("r"), 0), lambda old, new: share * new + (1 - share) * old)
    return rates.groupBy("aid").agg(in_order.alias("r")).select("aid", fold.alias("ema"))


def rollup(events: DataFrame, every: str = "5 seconds") -> DataFrame:
    """Bytes, events and retries of each artifact in tumbling windows; copies of an event count once."""
    once = events.withWatermark("at", WATERMARK)
    once = once.dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else once.dropDuplicates(["event_id"])
    moved = F.sum(F.when(F.col("kind").isin(*MOVING), F.col("bytes")).otherwise(0))
    out = once.groupBy("aid", F.window("at", every).alias("w")).agg(moved.alias("bytes"), F.count("*").alias("events"), F.count_if(F.col("kind") == "retry").alias("retries"))
    return out.select("aid", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "bytes", "events", "retries")


def disk_short(progress: DataFrame, disks: DataFrame) -> DataFrame:
    """Progress rows with whether their disk can't take what remains above its floor (a stream meets a table)."""
    return progress.join(disks, "disk", "left").withColumn("short", F.col("remaining") > F.col("free") - F.col("floor"))


def verified_as_landed(observed: DataFrame, expected: DataFrame) -> DataFrame:
    """Newly observed files against the record, as they land (a stream meets a table)."""
    want = expected.select("aid", "path", F.col("sha256").alias("want"))
    verdict = F.when(F.col("want").isNull(), "extra").when(F.col("want") == F.col("sha256"), "verified").otherwise("mismatched")
    return observed.join(want, ["aid", "path"], "left").select("aid", "path", verdict.alias("verdict"))


def drained(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there now into Parquet under `path`, and reads it back."""
    q = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/out")


def transfer_events(raw: DataFrame) -> DataFrame:
    """Rows of the events table as transfer events."""
    kind = F.create_map(*(F.lit(x) for kv in {"purchase": "network", "click": "local", "view": "hash", "error": "retry"}.items() for x in kv))
    return raw.select("event_id", F.col("user_id").alias("aid"), F.col("ts").alias("at"), F.coalesce(kind[F.col("event_type")], F.lit("online")).alias("kind"), F.round(F.col("value") * 1000).cast("long").alias("bytes"))


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """A file stream of the events table, one file or a folder, as transfer events."""
    path = f"{path[:-1]}[{path[-1]}]"  # a pattern may name a single file, a plain path must be a folder
    return transfer_events(spark.readStream.schema("event_id long, ts timestamp, user_id long, event_type string, value double, props string").parquet(path))
