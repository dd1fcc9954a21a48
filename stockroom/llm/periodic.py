"""Operator 13, periodic run detection: stretches of words that repeat one after another at least four times.

Method: an online sparse diagonal DP. Going through the words of a text, an earlier occurrence at a lag d begins a
diagonal; each next word that also stands d words before adds one to its match length; a word that doesn't ends it, and a
diagonal that ends after 3 d matches (and at least 6 words in all) emits its run there and then.

Only few occurrences have to begin one. A run of period d goes on for at least 2 d words after its first 2 d, so some word
there has a number that 2^k divides, with 2^k <= d < 2^(k+1), and up to 4 words before it match at lag d as well. Word i
therefore looks back less than twice the largest power of two that divides i, and the text's own number of looks is n
log n at most. A lag d isn't begun either where a shorter one has matched for d words: if both went on for long, they
would share a shorter period. What was missed before a diagonal was begun is matched backwards.

Words are numbered, and places where a diagonal may begin found, for some MB of texts at once in numpy; the DP itself
walks over words only where a diagonal is open.

Scale: a narrow map over whole texts, no shuffle. Edge cases: a null or empty text has no word and no run; null ids
pass through; repeated rows are treated each on its own; extra columns are left alone, one that bears the name of a
result gives way to it; an empty table gives an empty result. A task needs about 60 bytes for each byte of its longest text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockroom.llm import common, words

#: A run has at least this many words, and its period at least so many times.
SHORTEST, TIMES = 6, 4
#: Words before and with the one that begins a diagonal which must match, for lags of 4 and more.
CONTEXT = 4
MIX = np.uint64(0x9E3779B97F4A7C15)

Run = tuple[int, int, int]  # start, length, period


def openings(ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places where a diagonal of lag 4 or more may begin, as marks; the word before with the same CONTEXT words up to it, or
    -1; places where one of lag 1 to 3 may begin, as bits 1, 2, 4)."""
    n = len(ids)
    counts = np.diff(first)
    begin = np.repeat(first[:-1], counts)
    room = np.arange(n) - begin  # number of the word in its text
    near = np.zeros(n, np.uint8)
    for lag, back in ((1, 1), (2, 1), (3, 1)):
        if n > lag + back:
            same = np.zeros(n, bool)
            same[lag:] = (ids[lag:] == ids[:-lag]) & (room[lag:] >= lag)
            both = same.copy()
            both[1:] &= same[:-1]
            both &= room >= lag + back
            if lag > 1:
                both &= room % 2 == 0
            near |= both.astype(np.uint8) << (lag - 1)
    before = np.full(n, -1, np.int64)
    if n > CONTEXT:
        mixed = np.zeros(n, np.uint64)
        wide = ids.astype(np.uint64)
        for k in range(CONTEXT):  # names may collide, the DP looks at the words
            mixed[k:] = mixed[k:] * MIX + (wide[: n - k] + np.uint64(k + 1)) * MIX if k else wide * MIX
            mixed ^= mixed >> np.uint64(29)
        place = int(n).bit_length()
        key = mixed >> np.uint64(place) << np.uint64(place) | np.arange(n, dtype=np.uint64)
        key = np.sort(key[room >= CONTEXT - 1])
        at = (key & np.uint64((1 << place) - 1)).astype(np.int64)
        name = key >> np.uint64(place)
        same = np.flatnonzero(name[1:] == name[:-1])
        before[at[same + 1]] = at[same]
    reach = 2 * (room & -room)
    far = (before >= begin + CONTEXT - 1) & (room % 4 == 0) & (np.arange(n) - before < reach)
    return far, before, near


def runs_of(ids: list[int], far: np.ndarray, before: list[int], near: np.ndarray) -> list[Run]:
    """All runs of one text, by start, then period. `before`: as of `openings`, with places in this text."""
    n, active, i = len(ids), {}, 0
    out: dict[tuple[int, int], int] = {}  # (start, end): period; the smallest period of a stretch closes first
    marked = np.flatnonzero(far | (near > 0)).tolist()
    marked.append(n)
    turn = 0

    def close(lag: int, end: int) -> None:
        length = active.pop(lag) + lag
        if length >= max(SHORTEST, TIMES * lag):
            out.setdefault((end - length, end), lag)

    while True:
        if not active:  # on to the next place where a diagonal may begin
            while marked[turn] < i:
                turn += 1
            i = marked[turn]
        if i >= n:
            break
        for lag in sorted(active):
            if ids[i] == ids[i - lag]:
                active[lag] += 1
            else:
                close(lag, i)
        while marked[turn] < i:
            turn += 1
        if marked[turn] == i:
            lags = [lag for lag in (1, 2, 3) if near[i] >> (lag - 1) & 1]
            if far[i]:
                reach, p = 2 * (i & -i), before[i]
                if not any(q < CONTEXT and m >= reach - 1 for q, m in active.items()):  # else none of them would be begun
                    while p >= 0 and i - p < reach:
                        if i - p >= CONTEXT:
                            lags.append(i - p)
                        p = before[p]
            for lag in lags:
                if lag in active or any(q < lag <= m for q, m in active.items()):
                    continue
                m, j = 0, i
                while j >= lag and ids[j] == ids[j - lag]:
                    m, j = m + 1, j - 1
                if m:
                    active[lag] = m
        i += 1
    for lag in sorted(active):
        close(lag, n)
    return sorted(((start, end - start, lag) for (start, end), lag in out.items()), key=lambda r: (r[0], r[2]))


def batch_runs(found: words.Words) -> list[list[Run]]:
    """The runs of each text."""
    ids, first = found.numbered(), found.first
    far, before, near = openings(ids, first)
    open_texts = np.unique(np.searchsorted(first, np.flatnonzero(far | (near > 0)), "right") - 1)
    out: list[list[Run]] = [[] for _ in range(len(first) - 1)]
    for t in open_texts.tolist():
        a, b = int(first[t]), int(first[t + 1])
        out[t] = runs_of(ids[a:b].tolist(), far[a:b], (before[a:b] - a).tolist(), near[a:b])
    return out


def kept_stretches(n: int, runs: list[Run]) -> list[tuple[int, int]]:
    """Stretches of the words that no run holds after its first period."""
    keep = np.ones(n, bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    edges = np.flatnonzero(np.diff(np.concatenate([[0], keep.view(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def collapsed(found: words.Words, text: int, runs: list[Run]) -> bytes:
    """The kept words of a text, joined by one space."""
    a, b = int(found.first[text]), int(found.first[text + 1])
    return b" ".join(found.joined(a + s, a + e) for s, e in kept_stretches(b - a, runs)) if runs else found.joined(a, b)


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
RUNS = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))


def found_runs(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep`; runs, an array of (start, length, period) in words, by start, then period; and collapsed, the words that no run
    holds after its first period, joined by one space (empty for a null text)."""
    slim = common.without(docs.withColumn("__text", F.col(text)).select(*keep, "__text"), "runs", "collapsed")
    schema = T.StructType([*slim.schema.fields[:-1], T.StructField("runs", RUNS), T.StructField("collapsed", T.StringType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.pieces(batches, "__text"):
            found = words.split(batch.column("__text"), words.NOT_BLANK)
            runs = batch_runs(found)
            texts = [collapsed(found, t, r).decode() for t, r in enumerate(runs)]
            listed = pa.array([[dict(zip(("start", "length", "period"), r)) for r in own] for own in runs], pa.list_(RUN))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], listed, pa.array(texts, pa.string())], schema.names)

    return slim.mapInArrow(work, schema)


def planted(text: Column, doc_id: Column) -> Column:
    """The texts of the contract: those of a tenth of the ids repeat some of their words up to their end."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)
    own = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n = F.size(own)
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8))
    times = F.ceil((n - a) / p).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice(own, (a + 1).cast("int"), p.cast("int")), times)), F.lit(1), (n - a).cast("int"))
    return F.when((h % 10 == 0) & (n > 0), F.array_join(F.concat(F.slice(own, F.lit(1), a.cast("int")), tail), " ")).otherwise(text)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents").select("doc_id", planted(F.col("text"), F.col("doc_id")).alias("text"))
    fields = [*docs.schema.fields[:1], *T.StructType.fromDDL("n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string").fields]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for runs, text in zip(batch.column("runs").to_pylist(), batch.column("collapsed").to_pylist()):
                each = [(r["start"], r["length"], r["period"]) for r in runs]
                best = greatest(each)
                listed = "".join(f"{s},{n},{q}\n" for s, n, q in each)
                rows.append((len(each), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, hashlib.sha256(listed.encode()).hexdigest(), common.sha256(text.encode())))
            columns = [pa.array(c, pa.int64() if k < 5 else pa.string()) for k, c in enumerate(zip(*rows))] if rows else [pa.array([], pa.int64() if k < 5 else pa.string()) for k in range(7)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], [f.name for f in fields])

    return found_runs(docs).mapInArrow(digest, T.StructType(fields))


def greatest(runs: list[Run]) -> Run | None:
    """The run with the greatest length by period, compared exactly; ties to the smallest start, then period."""
    best = None
    for r in sorted(runs, key=lambda r: (r[0], r[2])):
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return best
