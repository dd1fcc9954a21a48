"""What was recorded against what is observed, for all artifacts at once.

Joins are on (artifact, path), which spreads an artifact of any size; counts combine before their shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FILE = ["aid", "path"]


def integrity_diff(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """One row for each file that is missing, extra or mismatched by digest."""
    e, o = expected.select(*FILE, F.col("sha256").alias("want")), observed.select(*FILE, F.col("sha256").alias("got"))
    both = e.withColumn("in_record", F.lit(True)).join(o.withColumn("on_disk", F.lit(True)), FILE, "full")
    verdict = F.when(F.col("on_disk").isNull(), "missing").when(F.col("in_record").isNull(), "extra").when(~F.col("want").eqNullSafe(F.col("got")), "mismatched")
    return both.select(*FILE, verdict.alias("verdict")).where("verdict is not null")


def size_diff(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """The same by size alone, which reads no content; an unknown recorded size fits any."""
    e, o = expected.select(*FILE, F.col("size").alias("want"), F.lit(True).alias("in_record")), observed.select(*FILE, F.col("size").alias("got"), F.lit(True).alias("on_disk"))
    verdict = F.when(F.col("on_disk").isNull(), "missing").when(F.col("in_record").isNull(), "extra").when(F.col("want") != F.col("got"), "size_mismatch")
    return e.join(o, FILE, "full").select(*FILE, verdict.alias("verdict")).where("verdict is not null")


def verification_summary(expected: DataFrame, diff: DataFrame) -> DataFrame:
    """Files checked, counts by verdict and the result of each artifact; no difference is a pass."""
    checked = expected.groupBy("aid").agg(F.count("*").alias("files_checked"))
    by = diff.groupBy("aid").agg(*(F.count_if(F.col("verdict") == v).alias(v) for v in ("missing", "extra", "mismatched")))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    out = checked.join(by, "aid", "full").select("aid", *(zero(F.col(c)).alias(c) for c in ("files_checked", "missing", "extra", "mismatched")))
    return out.withColumn("result", F.when(F.col("missing") + F.col("extra") + F.col("mismatched") == 0, "pass").otherwise("fail"))


def artifact_hash(inventory: DataFrame) -> DataFrame:
    """SHA-256 of the lines `digest, two blanks, path` in order of the path, each closed by a newline."""
    return ordered_digest(inventory, ["path"], F.concat("sha256", F.lit("  "), "path"), "artifact_sha256", end="\n")


def ordered_digest(rows: DataFrame, order: list[str], line: Column, name: str, end: str = "") -> DataFrame:
    """SHA-256 of an artifact's lines in an order, joined by newlines, with `end` after the last; null lines are left out.

    The rows of an artifact meet sorted in one task, which digests them batch by batch as they come: the sort spills, and
    neither the text nor a list of lines is ever held. A digest is a chain, so more tasks couldn't share one artifact."""
    dealt = rows.select("aid", *order, F.concat(line, F.lit("\n")).alias("__line")).repartition("aid").sortWithinPartitions("aid", *order, "__line").select("aid", "__line")
    schema = T.StructType([dealt.schema["aid"], T.StructField(name, T.StringType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aid = sha = kind = None
        empty = True
        done: list[tuple] = []

        def rows_done() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([x for x, _ in done], kind), pa.array([x for _, x in done], pa.string())], schema.names)
            done.clear()
            return out

        for batch in batches:
            ids, lines = batch.column("aid"), batch.column("__line").fill_null("")
            kind = ids.type
            _, places, data = lines.buffers()
            at = np.frombuffer(places, np.int64 if pa.types.is_large_string(lines.type) else np.int32)[lines.offset :].tolist()
            text = memoryview(data) if data is not None else b""
            codes = ids.dictionary_encode(null_encoding="encode").indices.to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), batch.num_rows]
            names = ids.take(pa.array(edges[:-1])).to_pylist() if batch.num_rows else []
            for a, b, name in zip(edges, edges[1:], names):
                if sha is None or name != aid:
                    if sha is not None:
                        sha.update(end.encode())
                        done.append((aid, sha.hexdigest()))
                    aid, sha, empty = name, hashlib.sha256(), True
                if at[a] < at[b]:
                    if not empty:
                        sha.update(b"\n")
                    sha.update(text[at[a] : at[b] - 1])
                    empty = False
            if done:
                yield rows_done()
        if sha is not None:
            sha.update(end.encode())
            done.append((aid, sha.hexdigest()))
            yield rows_done()

    return dealt.mapInArrow(work, schema)


def status_fold(result: Column, prior: Column) -> Column:
    """A failure compromises; a pass verifies unless the record disagreed with its source before."""
    return F.when(result == "fail", "compromised").when(prior == "upstream-mismatch", prior).otherwise("verified")


def landing(source: DataFrame, destination: DataFrame) -> DataFrame:
    """Per artifact: files present, resized, missing and extra at the destination, and bytes still to copy."""
    s, d = source.select(*FILE, F.col("size").alias("want"), F.lit(True).alias("here")), destination.select(*FILE, F.col("size").alias("got"), F.lit(True).alias("there"))
    x = s.join(d, FILE, "full")
    here, there = F.col("here").isNotNull(), F.col("there").isNotNull()
    same = here & there & (F.col("want") == F.col("got"))
    resized = here & there & (F.col("want") != F.col("got"))
    return x.groupBy("aid").agg(
        F.count_if(same).alias("present"),
        F.count_if(resized).alias("resized"),
        F.count_if(here & ~there).alias("missing"),
        F.count_if(there & ~here).alias("extra"),
        F.coalesce(F.sum(F.when(resized | (here & ~there), F.col("want"))), F.lit(0)).alias("bytes_to_copy"),
    )


def outside_scope(present: DataFrame, expected: DataFrame) -> DataFrame:
    """Files on disk that the pinned selection doesn't name, with sizes."""
    return present.join(expected.select(*FILE), FILE, "left_anti").select(*FILE, "size")


def files_to_hash(expected: DataFrame, present: DataFrame, verified: DataFrame, rehash: bool = False) -> DataFrame:
    """Expected files on disk whose digest isn't on record as verified; all of them with `rehash`."""
    found = expected.select(*FILE).join(present.select(*FILE), FILE, "left_semi")
    return found if rehash else found.join(verified.select(*FILE), FILE, "left_anti")


def git_blob_id(content: Column) -> Column:
    """The object id that git gives a file: SHA-1 over a length header and the bytes."""
    return F.sha1(F.concat(F.encode(F.format_string("blob %d", F.length(content)), "utf-8"), F.unhex(F.lit("00")), content))


def upstream_verdict(sha256: Column, want_sha256: Column, git_sha1: Column, want_git_sha1: Column) -> Column:
    """Whether bytes match what their source published: large-file digest first, git id else, null if it gave neither."""
    return F.when(want_sha256.isNotNull(), sha256 == want_sha256).when(want_git_sha1.isNotNull(), git_sha1 == want_git_sha1)
