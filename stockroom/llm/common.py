"""What the operators of this subpackage share: reading tables, cutting lineage, batching texts."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a task holds as Python objects at once.
BATCH_BYTES = 8 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Cuts lineage through the shared checkpoint folder, so that a lost executor costs a reread.

    The folder is the one in ``spark.checkpoint.dir``; only where that is unset in a local session (tests) one is made.
    """
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(local_folder(spark))
    return df.checkpoint()


def local_folder(spark: SparkSession) -> str:
    """A folder of this machine, which only a local session may share."""
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the ids that nothing is learned from; null ids are held out as well."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


@contextmanager
def setting(spark: SparkSession, key: str, value: object) -> Iterator[None]:
    """Within it the session has this setting, and then its own again."""
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def small_batches(spark: SparkSession, rows: int = 512):
    """Within it, what runs sends this many rows at once to Python: whole texts are large rows."""
    return setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def freed_shuffles(spark: SparkSession):
    """Frames made within it give their shuffle files back when their query ends, not when the driver collects its garbage.

    For steps of many queries that each store their result; a frame that is handed out is made outside, since its caller
    may run it again."""
    return setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", True)


def pieces(batches: Iterable[pa.RecordBatch], column: str, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices Arrow batches so that each has about `limit` bytes of `column` (a single longer row stays whole)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        if batch.column(column).nbytes <= limit:
            yield batch
            continue
        lengths = batch.column(column).fill_null("" if pa.types.is_string(batch.column(column).type) else b"")
        start = total = 0
        for i, value in enumerate(lengths):
            size = value.as_buffer().size
            if i > start and total + size > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += size
        yield batch.slice(start, n - start)


def first_by_hash(rows: DataFrame, columns: list[str], limit: int) -> DataFrame:
    """The `limit` rows with the smallest hash of `columns`, ties by the columns: a sample that no layout changes.

    Of many rows only those under a hash that about twice the limit lie under are sorted, so partitions send few."""
    hashed = F.xxhash64(*columns)
    n = rows.count()
    if n > 4 * limit:
        few = rows.where(hashed <= F.lit(int(-(2**63) + 2 * limit / n * 2**64)))
        rows = few if few.count() >= limit else rows
    return rows.orderBy(hashed, *columns).limit(limit)


def without(docs: DataFrame, *columns: str) -> DataFrame:
    """`docs` without columns of these names, which an operator adds; names are compared as Spark does, without case."""
    taken = {c.lower() for c in columns}
    return docs.select(*(F.col(f"`{c}`") for c in docs.columns if c.lower() not in taken))


def kept(keep: Iterable[str], *added: str) -> tuple[str, ...]:
    """Columns to keep, without those whose names an operator gives to its results."""
    taken = {c.lower() for c in added}
    return tuple(c for c in keep if c.lower() not in taken)


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def shared_path(spark: SparkSession) -> str:
    """A new place in the shared folder."""
    to = spark.conf.get("spark.checkpoint.dir", None) or local_folder(spark)
    return f"{to.rstrip('/')}/stored-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Written as Parquet in the shared folder and reread."""
    path = shared_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def bucketed(df: DataFrame, key: str, compression: str = "none") -> DataFrame:
    """Stored in the shared folder in buckets of a key, so that grouping by it needs no further shuffle.

    Buckets need a table's description; it is dropped again, and the frame keeps the files and their layout."""
    spark = df.sparkSession
    n, name = int(spark.conf.get("spark.sql.shuffle.partitions")), f"bucketed_{uuid.uuid4().hex}"
    df.repartition(n, key).write.bucketBy(n, key).option("path", shared_path(spark)).option("compression", compression).saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return out
