"""Operator 2, SimHash near-duplicates by meet-in-the-middle ball hashing.

Every distinct fingerprint emits all variants within half the radius (radius 2: itself and its 64 one-bit
changes). Two fingerprints at 2 or fewer differing bits share a variant, so one shuffle on variants finds every
link. Scale: copies collapse to one fingerprint before that shuffle, which is then 65 short rows for each distinct
fingerprint. Within a variant the fingerprints lie at most 2 bits apart and number at most 65; chaining them in
order (a lag) keeps the components without emitting all pairs of a group. Colliding pairs are verified.

Edge cases: a null or empty text has the fingerprint zero and links like any other; null ids link and pass
through but name no component unless a component has no other id; repeated rows come back as often as they came; texts are
taken whole, however long; extra columns are left out; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from stockroom.llm import common
from stockroom.llm.graph import components

SHINGLE = 3
RADIUS = 2


def fingerprint_of(texts: list[str | None], shingle: int = SHINGLE) -> np.ndarray:
    """Unsigned 64-bit fingerprints: a bit is set if it is in over half the shingles' hashes."""
    digest, out = xxhash.xxh64_intdigest, np.zeros(len(texts), np.uint64)
    for k, text in enumerate(texts):
        words = text.encode().lower().split() if text else ()
        if not words:
            continue
        if len(words) <= shingle:
            out[k] = digest(b" ".join(words), 42)
            continue
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = [0, *(ends[: len(words) - shingle] + 1).tolist()]
        hashes = np.array([digest(joined[s:e], 42) for s, e in zip(starts, ends[shingle - 1 :].tolist())], np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.zeros(64, np.int64)
        for at in range(0, len(bits), 255):  # sums of 255 rows stay within a byte
            ones += np.add.reduce(bits[at : at + 255], axis=0, dtype=np.uint8)
        out[k] = np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0]
    return out


def with_fingerprint(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), fp: str = "fp") -> DataFrame:
    """`keep` and `fp` (the fingerprint's bits as a signed long)."""
    slim = docs.select(*keep, F.col(text).alias("__text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.pieces(batches, "__text"):
            found = fingerprint_of(batch.column("__text").to_pylist()).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(found)], [*keep, fp])

    return slim.mapInArrow(work, T.StructType([*slim.drop("__text").schema.fields, T.StructField(fp, T.LongType())]))


def links(fps: DataFrame) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints within the radius that connect whatever lies within it."""
    flips = F.array(F.lit(0).cast("long"), *(F.lit(1 << b if b < 63 else -(1 << 63)).cast("long") for b in range(64)))
    variants = fps.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("variant"))
    before = F.lag("fp").over(Window.partitionBy("variant").orderBy("fp"))
    pairs = variants.select(before.alias("a"), F.col("fp").alias("b")).where("a is not null")
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS).distinct()


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, fp, component (the smallest fingerprint reachable), component_id (the smallest id there)."""
    with common.small_batches(docs.sparkSession):
        marked = common.cut(with_fingerprint(docs, text, (doc_id,)))
    return grouped(marked, doc_id)


def grouped(marked: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The same from rows that have their fingerprint already.

    What is known of each fingerprint is stored before it meets the rows again, so that both sides of that join are plain
    shuffles and the rows of a fingerprint that a third of them share can be split over tasks."""
    ids = marked.groupBy("fp").agg(F.min(doc_id).alias("least"))
    joined = components(links(ids.select("fp")), "a", "b").withColumnRenamed("node", "fp")
    ids = ids.join(joined, "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    whole = ids.groupBy("component").agg(F.min("least").alias("component_id"))
    return marked.join(common.cut(ids.drop("least").join(whole, "component")), "fp")


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One document of each group: the one with the smallest id, null ids last; of rows that share it, the smallest text.

    Columns and their order stay. Whole rows are stored once, with their fingerprint; what is shuffled with a text is
    a kept row only, since those that go are dropped by the join on the fingerprint before rows of one id meet.
    """
    names = docs.columns
    with common.small_batches(docs.sparkSession):
        rows = common.stored(with_fingerprint(docs, text, tuple(names), "__fp"))
    near = grouped(rows.select(doc_id, F.col("__fp").alias("fp")), doc_id)
    keys = near.groupBy("fp", "component").agg(F.min(doc_id).alias("id"))
    best = keys.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "fp")).alias("best"))
    best = best.select(F.col("best.id").alias("__id"), F.col("best.fp").alias("__best"))
    kept = rows.join(best, (rows["__fp"] == best["__best"]) & rows[doc_id].eqNullSafe(best["__id"]))
    order = Window.partitionBy("__fp").orderBy(F.col(text), F.to_json(F.struct(*names)))
    return kept.withColumn("__k", F.row_number().over(order)).where("__k = 1").select(*names)


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = near_duplicates(common.read(spark, sf_dir, "documents"))
    return near.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
