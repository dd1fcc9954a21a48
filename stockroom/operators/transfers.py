"""Accounting and planning of transfers, for all artifacts at once."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from stockroom.operators import integrity
from stockroom.operators.ranks import Cut, running
from stockroom.operators.rules import listed


def transfer_plan(states: DataFrame) -> DataFrame:
    """Files and bytes by state; a partial file has what lies on disk, at most its size."""
    size, part = F.coalesce("size", F.lit(0)), F.least(F.coalesce("partial", F.lit(0)), F.coalesce("size", F.lit(0)))
    is_ = lambda s: F.col("status") == s
    done = F.when(is_("verified") | is_("handed_off"), size).when(is_("partial"), part).otherwise(0)
    out = states.groupBy("aid").agg(
        F.count("*").alias("files"),
        *(F.count_if(is_(s)).alias(f"{s}_files") for s in ("verified", "handed_off", "partial", "missing")),
        F.sum(size).alias("total_bytes"),
        F.sum(done).alias("done_bytes"),
    )
    left = F.greatest(F.lit(0), F.col("total_bytes") - F.col("done_bytes"))
    whole = F.col("verified_files") + F.col("handed_off_files") == F.col("files")
    return out.withColumn("remaining_bytes", left).withColumn("complete", whole)


def percent(done: Column, total: Column) -> Column:
    """Whole percent, never over 100; none done of nothing."""
    return F.when(total > 0, F.least(F.lit(100), F.floor(done * 100 / total))).otherwise(0).cast("long")


def session_summary(sessions: DataFrame) -> DataFrame:
    return sessions.groupBy("aid").agg(F.count("*").alias("sessions"), F.min_by("started", "ordinal").alias("first_start"), F.max_by("ended", "ordinal").alias("last_end"), F.sum("bytes").alias("bytes"), F.sum("retries").alias("retries"))


def session_rate(sessions: DataFrame, least_seconds: int = 60) -> DataFrame:
    """Bytes a second over the sessions with positive bytes and span; unknown under a minute in all."""
    good = sessions.where("bytes > 0 and ended > started")
    out = good.groupBy("aid").agg(F.sum("bytes").alias("bytes"), F.sum(F.col("ended") - F.col("started")).alias("seconds"))
    return out.select("aid", "seconds", F.when(F.col("seconds") >= least_seconds, F.floor(F.col("bytes") / F.col("seconds")).cast("long")).alias("rate"))


def reconcile(expected: DataFrame, state: DataFrame, present: DataFrame) -> DataFrame:
    """What each file's record should become, from what is expected, recorded and on disk. Nothing is deleted here."""
    key = ["aid", "path"]
    e = expected.select(*key, F.col("size").alias("want"), F.lit(True).alias("e"))
    s = state.select(*key, "status", F.lit(True).alias("s"))
    p = present.select(*key, F.col("size").alias("got"), F.lit(True).alias("p"))
    x = e.join(s, key, "full").join(p, key, "full")
    wanted, there, whole = F.col("e").isNotNull(), F.col("p").isNotNull(), F.col("got") == F.col("want")
    verified = F.col("status") == "verified"
    decision = (
        F.when(~wanted & F.col("s").isNotNull(), "remove")
        .when(~wanted, "stray")
        .when(verified & there & whole, "keep")
        .when(F.col("status") == "handed_off", "keep_handed_off")
        .when(verified, "demote")
        .when(there & whole, "adopt")
        .when(there, "resume")
        .otherwise("missing")
    )
    return x.select(*key, decision.alias("decision"))


def handoff_eligible(source: DataFrame, destination: DataFrame) -> DataFrame:
    """Files that are verified on both sides."""
    ok = F.col("status") == "verified"
    return source.where(ok).select("aid", "path", "size").join(destination.where(ok).select("aid", "path"), ["aid", "path"])


def scope_signature(expected: DataFrame) -> DataFrame:
    """A digest of an artifact's whole expectation: transfers with the same one can be combined."""
    line = F.concat_ws("\t", F.col("path"), F.coalesce(F.col("size").cast("string"), F.lit("?")))
    return integrity.ordered_digest(expected, [], line, "signature")


def combinable(expected: DataFrame) -> DataFrame:
    """Artifacts that share their expectation with others: the smallest name and how many there are."""
    return scope_signature(expected).groupBy("signature").agg(F.min("aid").alias("first"), F.count("*").alias("members")).where("members > 1")


def disk_fit(files: DataFrame, budget: Column, cut: Cut) -> DataFrame:
    """How many files fit a budget, smallest first, up to the first that doesn't. Sizes ascend, so that is a prefix."""
    x = running(files, ["aid"], ["size", "path"], cut, "size").withColumn("fits", F.col("upto") <= budget)
    return x.groupBy("aid").agg(F.count_if("fits").alias("fit_files"), F.coalesce(F.sum(F.when(F.col("fits"), F.col("size"))), F.lit(0)).alias("fit_bytes"), F.count_if(~F.col("fits")).alias("left_files"))


def disk_verdict(need: Column, free: Column, floor: Column) -> Column:
    usable = free - floor
    return F.when(usable >= need * 1.1, "ok").when(usable >= need, "tight").otherwise("insufficient")


def disk_verdicts(need: DataFrame, disks: DataFrame, floor: int) -> DataFrame:
    """The verdict of each artifact (aid, need) on each disk of a small table (disk, free)."""
    x = need.withColumn("d", F.explode(listed(disks.select("disk", "free")))).select("aid", "need", "d.*")
    return x.select("aid", "disk", disk_verdict(F.col("need"), F.col("free"), F.lit(floor)).alias("verdict"))


def lane_runs(sizes: list[tuple[int, int]], n: int) -> Iterator[tuple[int, int, int, list[int]]]:
    """(size, first, files, lanes): from `first` on, so many files of a size go to these lanes in turn.

    `sizes` are (size, files), largest first. A file goes to the lightest lane, ties to the fewer files, then the lower
    number. Lanes within one file of the lightest take turns until they reach the next heavier one. Files of size zero leave
    the loads as they are: of the lightest lanes those with the fewest files take turns until they have as many as the next."""
    load = [[0, 0, k] for k in range(n)]
    for size, files in sizes:
        first = 0
        while first < files:
            load.sort()
            if not size:
                lightest = [x for x in load if x[0] == load[0][0]]
                turn = [x for x in lightest if x[1] == lightest[0][1]]
                rounds = (files - first) // len(turn)
                if len(turn) < len(lightest):
                    rounds = min(rounds, lightest[len(turn)][1] - turn[0][1])
                if not rounds:
                    turn, rounds = turn[: files - first], 1
                yield size, first, rounds * len(turn), [x[2] for x in turn]
                for x in turn:
                    x[1] += rounds
                first += rounds * len(turn)
                continue
            turn = [x for x in load if x[0] < load[0][0] + size] or load[:1]
            above = load[len(turn)][0] if len(turn) < n else None
            heaviest = turn[-1][0]
            rounds = (files - first) // len(turn)
            if above is not None:
                rounds = min(rounds, max(-((heaviest - above) // size), 0))
            if rounds:
                took = len(turn) * rounds
            else:  # what is left of a round goes one by one
                turn, rounds, took = load[:1], 1, 1
            yield size, first, took, [x[2] for x in turn]
            for x in turn:
                x[0] += size * rounds
                x[1] += rounds
            first += took


def lanes(files: DataFrame, n: int, cut: Cut) -> DataFrame:
    """Files dealt to n lanes, largest first to the lightest lane, ties to the fewer files, then the lower number.

    The plan is made on how many files of each size an artifact has, and says which lanes take turns from which rank on;
    files of equal size rank by path. An unknown size counts as zero. A size takes a few rows of the plan for each lane, however
    many files have it."""

    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size", ascending=False)
        out = [(pdf["aid"].iloc[0], *r) for r in lane_runs(list(zip(pdf["size"].tolist(), pdf["files"].tolist())), n)]
        return pd.DataFrame(out, columns=["aid", "size", "first", "took", "turn"])

    kind = {f.name: f.dataType.simpleString() for f in files.schema}
    x = files.select("aid", "path", F.coalesce("size", F.lit(0)).cast("long").alias("size"))
    counts = x.groupBy("aid", "size").agg(F.count("*").alias("files"))
    turns = counts.groupBy("aid").applyInPandas(plan, f"aid {kind['aid']}, size long, first long, took long, turn array<int>")
    ranked = running(x, ["aid", "size"], ["path"], cut).withColumn("at", F.col("rank") - 1).drop("rank", "upto")
    dealt = ranked.join(turns, ["aid", "size"]).where("at >= first and at < first + took")
    return dealt.select("aid", "path", "size", F.get("turn", ((F.col("at") - F.col("first")) % F.size("turn")).cast("int")).cast("long").alias("lane"))


def lane_stats(dealt: DataFrame, n: int) -> DataFrame:
    """Files, bytes and share of each lane, and whether the heaviest is over one and a half times the ideal."""
    by = dealt.groupBy("aid", "lane").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))
    w = Window.partitionBy("aid")
    return by.withColumn("skewed", F.max("bytes").over(w) * n > F.sum("bytes").over(w) * 1.5)


def scan_budget(files: DataFrame, each: int, total: int, most: int | None = None) -> DataFrame:
    """Files to read within a budget of bytes and a number of files, in order of priority, then path: one that is too
    large is skipped, one that the rest of the budget can't hold too, but later ones are still considered.

    Each choice stands on those before it. So a tree's files pass sorted through one task, which keeps two numbers and
    neither the files nor a round for each of them; the sort spills."""
    size = F.coalesce("size", F.lit(0)).cast("long")
    dealt = files.select("aid", "path", "priority", size.alias("size")).repartition("aid").sortWithinPartitions("aid", "priority", "path").select("aid", "path", "size")
    schema = T.StructType([*dealt.schema.fields[:2], T.StructField("outcome", T.StringType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, left, slots = None, 0, 0
        begun = False
        for batch in batches:
            out = []
            for aid, size in zip(batch.column("aid").to_pylist(), batch.column("size").to_pylist()):
                if not begun or aid != now:
                    begun, now, left, slots = True, aid, total, most or 2**62
                if size > each:
                    out.append("oversize")
                elif slots and size <= left:
                    out.append("read")
                    left, slots = left - size, slots - 1
                else:
                    out.append("over budget")
            yield pa.RecordBatch.from_arrays([batch.column("aid"), batch.column("path"), pa.array(out, pa.string())], schema.names)

    return dealt.mapInArrow(work, schema)


def latest(history: DataFrame, keep: int = 50) -> DataFrame:
    """The last runs of each artifact."""
    w = Window.partitionBy("aid").orderBy(F.col("done").desc(), F.col("ordinal").desc())
    return history.withColumn("n", F.row_number().over(w)).where(F.col("n") <= keep).drop("n")


def drift(history: DataFrame, cut: Cut) -> DataFrame:
    """Changes of result between consecutive runs of an artifact."""
    x = running(history.select("aid", "done", "ordinal", "status"), ["aid"], ["done", "ordinal"], cut)
    last = x.select("aid", (F.col("rank") + 1).alias("rank"), F.col("status").alias("before"))
    return x.join(last, ["aid", "rank"]).where("before <> status").select("aid", "ordinal", "before", F.col("status").alias("after"))


def assembled(states: DataFrame) -> DataFrame:
    """Per pin and path the first holder of a verified copy, null where none has one."""
    held = F.when(F.col("status") == "verified", F.col("holder"))
    return states.groupBy("pin", "path").agg(F.min(held).alias("holder"), F.max("size").alias("size"))


def distinct_hosts(sessions: DataFrame) -> DataFrame:
    return sessions.groupBy("aid").agg(F.sort_array(F.collect_set("host")).alias("hosts"))


def latest_by(runs: DataFrame, *keys: str) -> DataFrame:
    """The latest run of each key."""
    w = Window.partitionBy(*keys).orderBy(F.col("done").desc(), F.col("ordinal").desc())
    return runs.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


