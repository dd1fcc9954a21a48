"""Operator 11, importance resampling towards a target: documents whose hashed n-grams look like the target's weigh
more, and a share of them is drawn without replacement by Gumbel keys.

Method: a document's words, joined by single spaces, are scanned once for all lengths of n-gram, and the CRC-32 of every
prefix is kept. The CRC of an n-gram follows from the two prefixes it lies between: a CRC is linear over GF(2), so what
stands before the n-gram is shifted by its length and cancelled by exclusive or. The scan itself goes over many stretches
of a batch side by side, byte by byte.

Scale: one pass over the texts counts buckets (a task sends one row for each bucket), a second one weighs them; no text is
shuffled. The driver holds `buckets` gains, whatever the input. Ranks are taken over narrow rows (an id and five
numbers), dealt by range over score and id, so equal scores lie in many parts as well.

Edge cases: a null or empty text has no word, so no feature and weight 0; null ids are hashed as an empty id, and are drawn
last of equal scores; repeated rows count and may be drawn each on its own; extra columns are left alone, one that bears
the name of a result gives way to it; an empty table gives an empty result, an empty target gains from an empty histogram.
A task needs about 40 bytes for each byte of its longest text.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockroom.llm import common, words
from stockroom.operators import ranks

#: Bytes of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]` before A-Z are lower-cased, and the lower-casing.
LETTERS = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)
#: Bytes that are scanned side by side, one from each stretch of this length.
STRETCH = 1024
ONES = np.uint32(0xFFFFFFFF)
RESULTS = ("n_words", "n_features", "weight", "score")


@dataclass(frozen=True)
class Features:
    """Runs of `shortest` to `longest` words, in `buckets` buckets by their CRC."""

    shortest: int = 1
    longest: int = 1
    buckets: int = 10_000


def byte_table() -> np.ndarray:
    """What one byte does to a CRC register: the reflected CRC-32 polynomial, divided out bit by bit."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, table >> np.uint32(1) ^ np.uint32(0xEDB88320), table >> np.uint32(1))
    return table.astype(np.uint32)


BYTE = byte_table()


def applied(shift: np.ndarray, states: np.ndarray) -> np.ndarray:
    """A linear map over GF(2), given as its values on the 256 values of each of four bytes."""
    return shift[0][states & 0xFF] ^ shift[1][states >> 8 & 0xFF] ^ shift[2][states >> 16 & 0xFF] ^ shift[3][states >> 24]


def shift_tables(n: int = 31) -> list[np.ndarray]:
    """Shifts of a register by 1, 2, 4, ... zero bytes; each is the one before, applied twice."""
    values = np.arange(256, dtype=np.uint32)
    one = np.stack([(values << np.uint32(8 * k)) for k in range(4)])
    tables = [one >> np.uint32(8) ^ BYTE[one & 0xFF]]
    for _ in range(n - 1):
        tables.append(np.stack([applied(tables[-1], row) for row in tables[-1]]))
    return tables


SHIFTS = shift_tables()


def shifted(states: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each register after as many zero bytes as its length says."""
    states, most = states.copy(), int(lengths.max(initial=0))
    for k in range(most.bit_length()):
        at = np.flatnonzero(lengths >> k & 1)
        states[at] = applied(SHIFTS[k], states[at])
    return states


class Prefixes:
    """CRC registers, begun at zero, of all prefixes of some bytes."""

    def __init__(self, data: np.ndarray):
        rows = max(1, -(-len(data) // STRETCH))
        grid = np.zeros((rows, STRETCH), np.uint8)
        grid.reshape(-1)[: len(data)] = data
        grid = np.ascontiguousarray(grid.T)
        self.inner = np.zeros((STRETCH + 1, rows), np.uint32)  # after so many bytes of each stretch, begun at zero
        for k in range(STRETCH):
            s = self.inner[k]
            self.inner[k + 1] = s >> np.uint32(8) ^ BYTE[(s ^ grid[k]) & 0xFF]
        self.before = np.zeros(rows, np.uint32)  # the register where each stretch begins
        whole, state = SHIFTS[STRETCH.bit_length() - 1], 0
        tables, last = [t.tolist() for t in whole], self.inner[STRETCH].tolist()
        for r in range(1, rows):
            state = tables[0][state & 0xFF] ^ tables[1][state >> 8 & 0xFF] ^ tables[2][state >> 16 & 0xFF] ^ tables[3][state >> 24] ^ last[r - 1]
            self.before[r] = state

    def crcs(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """CRC-32 of each data[start:end]."""
        row, last = start // STRETCH, np.maximum(end - 1, start) // STRETCH
        ahead, upto = self.inner[start - row * STRETCH, row], self.inner[end - last * STRETCH, last]
        over = np.flatnonzero(row != last)  # the few that lie over the edge of a stretch need the registers before it
        ahead[over] ^= shifted(self.before[row[over]], start[over] - row[over] * STRETCH)
        upto[over] ^= shifted(self.before[last[over]], end[over] - last[over] * STRETCH)
        return upto ^ shifted(ahead ^ ONES, end - start) ^ ONES


def features_of(found: words.Words, shape: Features) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length of n-gram: the buckets of all of them, and the place of the first one of each text with the end."""
    prefixes = Prefixes(found.data)
    counts = np.diff(found.first)
    for n in range(shape.shortest, shape.longest + 1):
        each = np.maximum(counts - n + 1, 0)
        first = np.concatenate([[0], np.cumsum(each)])
        at = np.arange(first[-1]) + np.repeat(found.first[:-1] - first[:-1], each)
        yield prefixes.crcs(found.start[at], found.end[at + n - 1]) % np.uint32(shape.buckets), first


def bucket_counts(docs: DataFrame, shape: Features = Features(), text: str = "text") -> DataFrame:
    """(bucket int, n long) of all features of all texts; buckets without a feature are left out."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape.buckets, np.int64)
        for batch in common.pieces(batches, "__text"):
            for buckets, _ in features_of(words.split(batch.column("__text"), LETTERS, LOWER), shape):
                total += np.bincount(buckets, minlength=shape.buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])

    return docs.select(F.col(text).alias("__text")).mapInArrow(work, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, shape: Features = Features(), text: str = "text") -> np.ndarray:
    """What one feature of each bucket adds to a weight: 1000 times the logarithm of how much likelier it is in the target,
    with one added to every count, rounded down. `shape.buckets` rows at most come to the driver from either table."""
    own, other = np.zeros(shape.buckets, np.int64), np.zeros(shape.buckets, np.int64)
    for counts, table in ((own, docs), (other, target)):
        for bucket, n in bucket_counts(table, shape, text).collect():
            counts[bucket] = n
    sums = int(own.sum()) + shape.buckets, int(other.sum()) + shape.buckets
    ratio = [float((t + 1) * sums[0]) / float((s + 1) * sums[1]) for s, t in zip(own.tolist(), other.tolist())]
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], np.int64)


def noise(doc_id: object, seed: int) -> int:
    """1000 times a Gumbel variable that the seed and the id fix, rounded down."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, shape: Features = Features(), seed: int = 2024, text: str = "text", doc_id: str = "doc_id", keep: tuple[str, ...] | None = None) -> DataFrame:
    """The rows with the columns `keep` (all, if not given) and n_words, n_features, weight, score, each long."""
    docs = docs.withColumns({"__text": F.col(text), "__id": F.col(doc_id).cast("string")})
    keep = [c for c in (keep or docs.columns[:-2]) if c.lower() not in RESULTS]
    slim = docs.select(*keep, "__text", "__id")
    schema = T.StructType([*slim.schema.fields[:-2], *(T.StructField(c, T.LongType()) for c in RESULTS)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.pieces(batches, "__text"):
            found = words.split(batch.column("__text"), LETTERS, LOWER)
            n, weight = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for buckets, first in features_of(found, shape):
                upto = np.concatenate([[0], np.cumsum(gain[buckets])])
                n += np.diff(first)
                weight += np.diff(upto[first])
            score = weight + np.array([noise(i, seed) for i in batch.column("__id").to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keep))), *map(pa.array, (np.diff(found.first), n, weight, score))], schema.names)

    return slim.mapInArrow(work, schema)


def drawn(scores: DataFrame, percent: int = 10, min_words: int = 20, doc_id: str = "doc_id") -> DataFrame:
    """`scores` with rank long: 1, 2, 3, ... of those drawn, null of all others. Of the N rows with enough words the
    floor(percent * N / 100) highest scores are drawn, ties to the smaller id."""
    scores = common.stored(common.without(scores, "rank")).withColumn("__row", F.monotonically_increasing_id())  # over stored files, so a task run again numbers alike
    enough = F.col("n_words") >= min_words
    n = scores.where(enough).count() * percent // 100
    sort = scores.where(enough).withColumns({"__last": F.col(doc_id).isNull(), "__least": -F.col("score")})
    ranked = ranks.running(sort, [], ["__least", "__last", doc_id, "__row"], common.stored).withColumn("rank", F.when(F.col("rank") <= n, F.col("rank").cast("long")))
    rest = scores.where(~enough).withColumn("rank", F.lit(None).cast("long"))
    return ranked.select(*rest.columns).union(rest).drop("__row")


def resampled(docs: DataFrame, target: DataFrame, percent: int = 10, min_words: int = 20, shape: Features = Features(), seed: int = 2024, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of `docs` that are drawn, with all columns. Repeated rows of the last one drawn all stay."""
    gain = gains(docs, target, shape, text)
    last = drawn(scored(docs, gain, shape, seed, text, doc_id, (doc_id,)), percent, min_words, doc_id).orderBy(F.col("rank").desc_nulls_last()).first()
    if last is None or last["rank"] is None:
        return docs.limit(0)
    score, of = F.col("__score"), F.col(doc_id)
    inside = (score > last["score"]) | (score == last["score"]) & (F.lit(True) if last[doc_id] is None else F.coalesce(of <= F.lit(last[doc_id]), F.lit(False)))
    named = scored(docs.select(F.struct(*(f"`{c}`" for c in docs.columns)).alias("__all"), F.col(text).alias("__t"), of.alias("__i")), gain, shape, seed, "__t", "__i")
    kept = named.withColumnsRenamed({"score": "__score", "__i": doc_id}).where(inside & (F.col("n_words") >= min_words))
    return kept.select(*(F.col("__all").getField(c).alias(c) for c in docs.columns))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    gain = gains(docs, common.read(spark, sf_dir, "benchmark"))
    return drawn(scored(docs, gain, keep=("doc_id",))).select("doc_id", "n_features", "weight", "score", "rank")


#: CRC-32 is a fold over the bytes of each distinct word, with the byte table derived from the polynomial.
SQL = r"""
    with recursive bits(v, c, k) as (
        select v, v, 0 from range(256) t(v)
        union all select v, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from bits where k < 8),
    crc as (select list(c order by v) as t from bits where k = 8),
    d as (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
    b as (select regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
    each as (select doc_id, unnest(w) as word from d),
    theirs as (select unnest(w) as word from b),
    known as (select distinct word from (select word from each union all select word from theirs)),
    coded as (select word, hex(encode(word)) as h from known),
    bucket as (select word, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(length(h) // 2), lambda i: (16 * (instr('0123456789ABCDEF', h[2 * i + 1]) - 1) + instr('0123456789ABCDEF', h[2 * i + 2]) - 1)::bigint)),
            lambda s, x: xor(s >> 8, t[(xor(s, x) & 255) + 1])), 4294967295::bigint) % 10000 as bucket
        from coded, crc),
    s as (select bucket, count(*) as n from each join bucket using (word) group by bucket),
    t as (select bucket, count(*) as n from theirs join bucket using (word) group by bucket),
    total as (select (select count(*) from each) + 10000 as s, (select count(*) from theirs) + 10000 as t),
    gain as (select k.bucket, floor(1000 * ln(((coalesce(t.n, 0) + 1) * total.s)::double / ((coalesce(s.n, 0) + 1) * total.t)::double))::bigint as gain
        from (select distinct bucket from bucket) k left join s using (bucket) left join t using (bucket), total),
    weight as (select doc_id, sum(gain)::bigint as weight from each join bucket using (word) join gain using (bucket) group by doc_id),
    scored as (select doc_id, coalesce(len(w), 0)::bigint as n_features, coalesce(weight, 0) as weight,
            coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('2024:' || coalesce(doc_id::varchar, ''))[1:8])::bigint + 0.5::double) / 4294967296)))::bigint as score
        from d left join weight using (doc_id)),
    placed as (select doc_id, row_number() over (order by score desc, doc_id) as r, floor(10 * count(*) over () / 100) as most from scored where n_features >= 20)
    select doc_id, n_features, weight, score, case when r <= most then r end as rank from scored left join placed using (doc_id)"""
