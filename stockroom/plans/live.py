"""Registered stream queries: each runs a stream over the events until it is drained."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockroom.plans import registry
from stockroom.plans.registry import query
from stockroom.streaming import appends, meter, telemetry

HOUR = 3_600_000
#: The events lie hours apart, so every span of the meter is longer here by about the same factor.
SPANS = meter.Settings(window=10 * HOUR, least_span=60_000, stall=6 * HOUR, fresh=HOUR, heartbeat=24 * HOUR, points=1, rate_every=0, idle=100 * meter.DAY, cap=6_000_000, deadline=1_705_276_800_000, free=20_000_000, floor=2_000_000)
TOTAL = 12_000_000


def transfers(spark: SparkSession, sf: str) -> DataFrame:
    """The event stream with failed attempts and a total."""
    kind = F.when((F.col("kind") == "retry") & (F.col("event_id") % 3 == 0), "offline").otherwise(F.col("kind"))
    return telemetry.event_stream(spark, f"{sf}/events.parquet").withColumns({"kind": kind, "bytes": F.col("bytes") * 10, "total": F.lit(TOTAL)})


@query("st_live_meter", f"""
  with top as (select epoch_us(max(ts)) // 1000 - 30000 as top from events),
  e as (select event_id, user_id as aid, epoch_us(ts) // 1000 as ms, case event_type when 'purchase' then 'network' when 'click' then 'local' when 'view' then 'hash' when 'error' then case when event_id % 3 = 0 then 'offline' else 'retry' end else 'online' end as kind,
    10 * cast(round(value * 1000) as bigint) as bytes from events, top where epoch_us(ts) // 1000 < top),
  c as (select *, cast(sum(case when kind in ('network', 'local') then bytes else 0 end) over w as bigint) as moved, sum(case when kind = 'network' then bytes else 0 end) over w as net, cast(sum(case when kind = 'hash' then bytes else 0 end) over w as bigint) as hashed,
    coalesce(last_value(case when kind in ('network', 'local', 'hash') then kind end ignore nulls) over w = 'hash', false) as hashing, last_value(case when kind in ('offline', 'retry') then kind end ignore nulls) over w as link
    from e window w as (partition by aid order by ms, event_id rows unbounded preceding)),
  d as (select *, least(moved, {TOTAL}) as done, kind = 'network' and bytes > 0 and coalesce(link = 'retry', false) as closes from c),
  g as (select *, done > coalesce(lag(done) over w, 0) as gain, coalesce(sum(closes::int) over (partition by aid order by ms, event_id rows between unbounded preceding and 1 preceding), 0) as outage from d window w as (partition by aid order by ms, event_id)),
  h as (select *, sum(gain::int) over w as gains, coalesce(max(case when gain then ms end) over w, min(ms) over (partition by aid)) as byte_at, count_if(kind = 'offline') over o as attempts, min(case when kind = 'offline' then ms end) over o as since,
    ms - min(ms) over r as span, done - min(done) over r as got, hashed - min(hashed) over r as digested
    from g window w as (partition by aid order by ms, event_id rows unbounded preceding), o as (partition by aid, outage order by ms, event_id rows unbounded preceding), r as (partition by aid order by ms range between {SPANS.window} preceding and current row)),
  i as (select *, case when span >= {SPANS.least_span} then got::double / (span::double / 1000::double) end as rate, case when hashing and span >= {SPANS.least_span} then digested::double / (span::double / 1000::double) end as hash_rate,
    count_if(kind = 'retry') over (partition by aid, gains order by ms, event_id rows unbounded preceding) as retries from h),
  j as (select *, list(rate order by ms, event_id) filter (where rate is not null) over (partition by aid order by ms, event_id rows unbounded preceding) as paces from (select * from i)),
  k as (select *, list_transform(range(1, len(coalesce(paces, [])) + 1), lambda n: list_reduce(paces[:n], lambda a, b: {telemetry.EMA}::double * b + {1 - telemetry.EMA}::double * a)) as emas from j),
  s as (select *, emas[len(emas)] as ema, array_to_string(list_transform(emas[greatest(1, len(emas) - 23):], lambda x: floor(x)::bigint), ',') as rates, attempts > 0 and not closes as down, 0 as tick from k),
  stall as (select aid, ms + {SPANS.stall} as ms from (select *, lead(ms) over (partition by aid order by ms, event_id) as after from (select aid, ms, event_id, row_number() over (partition by aid order by ms, event_id) as n, gain, done from s) where gain or n = 1), top
    where done < {TOTAL} and coalesce(after > ms + {SPANS.stall}, true) and ms + {SPANS.stall} < top),
  ticks as (select t.aid, t.ms, s.event_id, s.done, s.byte_at, s.hashing, s.down, s.retries, s.ema, s.rates, 1 as tick from stall t asof join s on t.aid = s.aid and t.ms >= s.ms),
  steps as (select aid, ms, event_id, done, byte_at, hashing, down, retries, ema, rates, tick from s union all select * from ticks),
  u as (select *, ms - byte_at >= {SPANS.stall} and done < {TOTAL} and not hashing as stalled from steps),
  v as (select *, case when stalled then {{'v': null::double}} when done < {TOTAL} and ema > 1 and ms - byte_at < {SPANS.fresh} then {{'v': ({TOTAL} - done)::double / ema}} end as told from u),
  w as (select *, case when done = {TOTAL} then 0::double else (last_value(told ignore nulls) over (partition by aid order by ms, tick, event_id rows unbounded preceding)).v end as eta from v),
  x as (select *, case when down then 'offline' when retries > 0 and done < {TOTAL} then 'retrying' when hashing then 'verifying' when stalled then 'stalled' when eta is null and coalesce(ema, 0) = 0 then 'starting' else 'downloading' end as phase, 100 * done // {TOTAL} as percent from w),
  changed as (select * from (select *, (phase || percent) is distinct from lag(phase || percent) over (partition by aid order by ms, tick, event_id) as new from x) where new),
  owed as (select aid, unnest(generate_series(ms + {SPANS.heartbeat}, least(coalesce(lead(ms) over (partition by aid order by ms, tick, event_id), top), top) - 1, {SPANS.heartbeat})) as ms, done < {TOTAL} as going from changed, top),
  reports as (select aid, ms, done, phase, percent, eta, rates from changed union all select o.aid, o.ms, x.done, x.phase, x.percent, x.eta, x.rates from (select * from owed where going) o asof join x on o.aid = x.aid and o.ms >= x.ms),
  alerts as (select aid, ms, event_id, reason from (select aid, ms, event_id, unnest(list_filter([case when net >= {SPANS.cap} then 'cap' end, case when ms >= {SPANS.deadline} then 'deadline' end, case when {SPANS.free} - moved < {SPANS.floor} then 'free' end], lambda r: r is not null)) as reason from s)
    qualify row_number() over (partition by aid, reason order by ms, event_id) = 1)
  select aid, ms, 'sample' as what, done, floor(rate)::bigint as rate, floor(ema)::bigint as ema, floor(hash_rate)::bigint as hash_rate, retries, null as phase, null::bigint as percent, null::bigint as eta, null as rates, null as reason, null::bigint as seconds, null::bigint as attempts from s
  union all select aid, ms, 'report', done, null, null, null, null, phase, percent, floor(eta)::bigint, coalesce(rates, ''), null, null, null from reports
  union all select aid, ms, 'alert', null, null, null, null, null, null, null, null, null, reason, null, null from alerts
  union all select aid, ms, 'outage', null, null, null, null, null, null, null, null, null, null, floor((ms - since) / 1000)::bigint, attempts from s where closes and attempts > 0""")
def live_meter(spark, sf):
    with meter.stores(spark):
        out = telemetry.drained(meter.meter(transfers(spark, sf), SPANS), registry.shared_path(spark, "live"))
    whole = {c: F.floor(c) for c in ("rate", "ema", "hash_rate", "eta", "seconds")}
    rates = F.array_join(F.transform("rates", lambda r: F.floor(r)), ",")
    return out.withColumns(whole | {"ms": F.unix_millis("at"), "rates": rates}).drop("at")


@query("st_late_and_replayed", """with e as (select *, event_id % 10 = 0 as second from events), w as (select epoch_us(max(ts)) // 1000 * 1000 - 30000000 as mark from e where not second),
  k as (select e.*, second and epoch_us(ts) <= mark as late from e, w) select user_id as aid, count(*) filter (not late) as events, cast(sum(case when not late then round(value * 1000) else 0 end) as bigint) as bytes, (select count(*) from k where late) as late from k group by user_id having count(*) filter (not late) > 0""")
def late_and_replayed(spark, sf):
    """The events as a log: a tenth of them comes after the stream was stopped and started again, and of these the rows behind
    the watermark are dropped and counted; each batch is handed over twice."""
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    came, log, state = (registry.shared_path(spark, kind) for kind in ("came", "log", "state"))
    late, append = appends.LateRows(), appends.once(log)

    def twice(batch: DataFrame, number: int) -> None:
        append(batch, number)
        append(batch, number)

    spark.streams.addListener(late)
    try:
        for second in (False, True):
            events.where((F.col("event_id") % 10 == 0) == second).write.mode("append").parquet(came)
            stream = telemetry.transfer_events(spark.readStream.schema(events.schema).parquet(came))
            stream = stream.withWatermark("at", telemetry.WATERMARK).dropDuplicatesWithinWatermark(["event_id"])
            q = stream.writeStream.foreachBatch(twice).option("checkpointLocation", state).trigger(availableNow=True).start()
            q.awaitTermination()
            dropped = late.total(str(q.id))
    finally:
        spark.streams.removeListener(late)
    return spark.read.parquet(log).groupBy("aid").agg(F.count("*").alias("events"), F.sum("bytes").alias("bytes")).withColumn("late", F.lit(dropped).cast("long"))
