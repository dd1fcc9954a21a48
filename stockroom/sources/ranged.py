"""Files of a tree read in ranges, whatever their size: the base of the data sources that read digests, headers and
footers, and a sink that writes files of bytes.

A source lists its tree (`path`, a folder or a file) once, through the file system that the path names (local, or any that
Arrow opens), and keeps the files with one of its suffixes outside a `.cache` folder at the root. Filters on path and
size are pushed to that listing, so what they leave out is never opened. Files are put together in partitions by
the bytes that reading them takes, and a row, not a failure, tells of a file that can't be read.
"""

from __future__ import annotations

import hashlib
import posixpath
import uuid
from collections.abc import Iterable, Iterator
from typing import Any

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, Not, StringContains, StringEndsWith, StringStartsWith

from stockroom.operators.ranks import by_size

#: Bytes that a file is read in, and that the files of one partition take to read.
CHUNK_BYTES, PARTITION_BYTES = 4 << 20, 128 << 20
#: Reading any file takes as long as so many bytes.
OPEN_BYTES = 1 << 20
BATCH_ROWS = 4096
#: Files that one task writes.
FILES = 20_000
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
#: Names that Hadoop gives to stores which Arrow knows by another.
SCHEMES = {"s3a": "s3", "s3n": "s3"}

TESTS = {
    EqualTo: lambda a, b: a == b,
    In: lambda a, b: a in b,
    GreaterThan: lambda a, b: a > b,
    GreaterThanOrEqual: lambda a, b: a >= b,
    LessThan: lambda a, b: a < b,
    LessThanOrEqual: lambda a, b: a <= b,
    StringStartsWith: lambda a, b: a.startswith(b),
    StringEndsWith: lambda a, b: a.endswith(b),
    StringContains: lambda a, b: b in a,
}


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path, and the path in it."""
    scheme, mark, rest = path.partition("://")
    if mark:
        return pafs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}://{rest}")
    return pafs.LocalFileSystem(), path.removeprefix("file:")


def passes(test: Filter, row: dict[str, Any]) -> bool:
    if isinstance(test, Not):
        return not passes(test.child, row)
    return TESTS[type(test)](row[test.attribute[0]], test.value)


def known(test: Filter) -> bool:
    """Whether the listing can decide a filter."""
    inner = test.child if isinstance(test, Not) else test
    return type(inner) in TESTS and inner.attribute in (("path",), ("size",)) and inner.value is not None and not (isinstance(inner, In) and None in inner.value)


class Files(InputPartition):
    def __init__(self, files: list[tuple[str, int]]):
        self.files = files


class RangedReader(DataSourceReader):
    """Subclasses say which files they read, what reading one costs, and what rows it gives."""

    suffixes: tuple[str, ...] = ("",)
    columns: pa.Schema
    errors: tuple[type[Exception], ...] = (OSError, ValueError)

    def __init__(self, options: dict[str, str]):
        self.root, self.filters = options["path"], []
        self.limit = int(options.get("partitionBytes", PARTITION_BYTES))

    def cost(self, size: int) -> int:
        return size

    def rows(self, file: pa.NativeFile, size: int) -> Iterator[tuple]:
        """Rows without path, size and error; those given before an error are kept."""
        raise NotImplementedError

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if known(f):
                self.filters.append(f)
            else:
                yield f

    def listing(self) -> list[tuple[str, int]]:
        """Paths below the root (of one file: its name) with their sizes, in order."""
        system, root = opened(self.root)
        own = system.get_file_info(root)
        if own.type == pafs.FileType.File:
            found = [(posixpath.basename(root), own.size)]
        else:
            base = len(root.rstrip("/")) + 1
            found = [(x.path[base:], x.size) for x in system.get_file_info(pafs.FileSelector(root, recursive=True)) if x.type == pafs.FileType.File]
        kept = [f for f in found if f[0].lower().endswith(self.suffixes) and not f[0].startswith(".cache/")]
        return sorted(f for f in kept if all(passes(t, {"path": f[0], "size": f[1]}) for t in self.filters))

    def partitions(self) -> list[Files]:
        out: list[Files] = []
        held: list[tuple[str, int]] = []
        taken = 0
        for path, size in self.listing():
            cost = self.cost(size) + OPEN_BYTES
            if held and taken + cost > self.limit:
                out.append(Files(held))
                held, taken = [], 0
            held.append((path, size))
            taken += cost
        return [*out, Files(held)]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, root = opened(self.root)
        single = system.get_file_info(root).type == pafs.FileType.File
        empty = (None,) * (len(self.columns) - 3)
        rows: list[tuple] = []
        for path, size in partition.files:
            try:
                with system.open_input_file(root if single else posixpath.join(root, path)) as file:
                    for row in self.rows(file, size):
                        rows.append((path, size, *row, None))
                        if len(rows) >= BATCH_ROWS:
                            yield self.batch(rows)
                            rows = []
            except self.errors as error:
                rows.append((path, size, *empty, str(error).splitlines()[0] if str(error) else type(error).__name__))
        if rows:
            yield self.batch(rows)

    def batch(self, rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), self.columns)], schema=self.columns)


def columns(*more: tuple[str, pa.DataType]) -> pa.Schema:
    return pa.schema([("path", pa.string()), ("size", pa.int64()), *more, ("error", pa.string())])


def load(spark: SparkSession, source: type[DataSource], path: str, **options: Any) -> DataFrame:
    """A tree through a source. The session must let filters be pushed to sources, which this sets."""
    spark.conf.set(PUSHDOWN, "true")
    spark.dataSource.register(source)
    return spark.read.format(source.name()).options(**options).load(path)


# digests


def digest(file: pa.NativeFile, size: int) -> tuple[str, str]:
    """SHA-256 and git object id in one pass, a chunk at a time."""
    sha, git, seen = hashlib.sha256(), hashlib.sha1(b"blob %d\0" % size), 0
    while chunk := file.read(CHUNK_BYTES):
        sha.update(chunk)
        git.update(chunk)
        seen += len(chunk)
    if seen != size:
        raise ValueError(f"{seen} bytes where {size} were listed")
    return sha.hexdigest(), git.hexdigest()


class DigestReader(RangedReader):
    columns = columns(("sha256", pa.string()), ("git_sha1", pa.string()))

    def rows(self, file: pa.NativeFile, size: int) -> Iterator[tuple]:
        yield digest(file, size)


class PayloadDigests(DataSource):
    """path, size, sha256, git_sha1; or an error."""

    @classmethod
    def name(cls) -> str:
        return "payload_digests"

    def schema(self) -> str:
        return "path string, size long, sha256 string, git_sha1 string, error string"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return DigestReader(self.options)


def digests(spark: SparkSession, path: str, **options: Any) -> DataFrame:
    """Digests of every file of a tree, of any size, in bounded memory."""
    return load(spark, PayloadDigests, path, **options)


def listed_digests(files: DataFrame, root: str) -> DataFrame:
    """`files` (path, size, ...) with sha256, git_sha1 and error, read below `root`. For a table of files, such as those that
    still need a digest, of which no other is opened; it is dealt out by size first."""
    total = files.agg(F.sum(F.col("size") + OPEN_BYTES)).first()[0] or 0
    dealt = files.drop("sha256", "git_sha1", "error").repartition(1 + total // PARTITION_BYTES, "path")
    schema = T.StructType([*dealt.schema.fields, *(T.StructField(c, T.StringType()) for c in ("sha256", "git_sha1", "error"))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = opened(root)
        for batch in batches:
            found = []
            for path, size in zip(batch.column("path").to_pylist(), batch.column("size").to_pylist()):
                try:
                    with system.open_input_file(posixpath.join(base, path)) as file:
                        found.append((*digest(file, size), None))
                except (OSError, ValueError) as error:
                    found.append((None, None, str(error).splitlines()[0]))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, pa.string()) for c in (zip(*found) if found else ((), (), ())))], schema.names)

    return dealt.mapInArrow(work, schema)


# the sink


def write_files(rows: DataFrame, root: str) -> int:
    """Writes each row (path, content) as a file below `root`; how many. A task that runs again puts the same file in place.

    Rows are dealt out by path, FILES to a task, since few files of a table may hold very many of them."""
    rows = by_size(rows, "path", each=FILES)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = opened(root)
        made: set[str] = set()
        for batch in batches:
            sizes = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                to = posixpath.join(base, path)
                if posixpath.dirname(to) not in made:
                    system.create_dir(posixpath.dirname(to), recursive=True)
                    made.add(posixpath.dirname(to))
                part = f"{posixpath.dirname(to)}/.{posixpath.basename(to)}.{uuid.uuid4().hex}"
                with system.open_output_stream(part) as out:
                    out.write(content.as_buffer() or b"")
                system.move(part, to)
                sizes.append(len(content.as_buffer() or b""))
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(sizes, pa.int64())], ["path", "size"])

    return rows.select("path", F.col("content").cast("binary").alias("content")).mapInArrow(work, "path string, size long").agg(F.count("*")).first()[0]
