"""Headers of weight files and footers of data files, as tables: sources that read only those ranges of each file."""

from __future__ import annotations

import io
import json
import struct
from collections.abc import Iterator
from typing import Any, BinaryIO

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader

from stockroom.operators.ranks import by_size
from stockroom.sources.ranged import RangedReader, columns, load

#: A header that claims more is malformed, as is a string or a count beyond its bound.
TENSOR_HEADER_BYTES = 100_000_000
KEY_VALUE_BYTES, STRING_BYTES, MOST_PAIRS = 64 << 20, 32 << 20, 65_536
#: Widths of the scalar value types of a key-value header, by type number. Fixed values; 8 is a string and 9 an array.
SCALARS = {0: "B", 1: "b", 2: "H", 3: "h", 4: "I", 5: "i", 6: "f", 7: "?", 10: "Q", 11: "q", 12: "d"}
#: What reading a header or a footer takes, as a guess for dealing files out.
HEADER_BYTES = 4 << 20


# tensors


def tensors_in(file: BinaryIO, size: int) -> Iterator[tuple]:
    """(tensor, dtype, shape) of a header: eight bytes of length, then JSON."""
    head = file.read(8)
    if len(head) < 8:
        raise ValueError("truncated")
    (n,) = struct.unpack("<Q", head)
    if n > TENSOR_HEADER_BYTES:
        raise ValueError("header too long")
    if n > size - 8:
        raise ValueError("truncated")
    try:
        found = json.loads(file.read(n))
        each = [(name, t["dtype"], [int(d) for d in t["shape"]]) for name, t in found.items() if name != "__metadata__"]
    except (ValueError, KeyError, TypeError, AttributeError) as error:
        raise ValueError("no JSON" if isinstance(error, ValueError) else "no header") from error
    yield from each


class TensorReader(RangedReader):
    suffixes = (".safetensors",)
    columns = columns(("tensor", pa.string()), ("dtype", pa.string()), ("shape", pa.list_(pa.int64())))

    def cost(self, size: int) -> int:
        return min(size, HEADER_BYTES)

    def rows(self, file: pa.NativeFile, size: int) -> Iterator[tuple]:
        return tensors_in(file, size)


class TensorHeaders(DataSource):
    """path, size, tensor, dtype, shape; or an error."""

    @classmethod
    def name(cls) -> str:
        return "tensor_headers"

    def schema(self) -> str:
        return "path string, size long, tensor string, dtype string, shape array<long>, error string"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return TensorReader(self.options)


def tensors(spark: SparkSession, path: str, **options: Any) -> DataFrame:
    return load(spark, TensorHeaders, path, **options)


# key-value headers


class Cursor:
    """Reads on from a file, counting against a cap only what it reads and not what it seeks over."""

    def __init__(self, file: BinaryIO, size: int, cap: int = KEY_VALUE_BYTES):
        self.file, self.size, self.left, self.at = file, size, cap, 0

    def take(self, n: int) -> bytes:
        if self.at + n > self.size:
            raise ValueError("truncated")
        if n > self.left:
            raise ValueError("read cap")
        self.left -= n
        self.at += n
        data = self.file.read(n)
        if len(data) < n:
            raise ValueError("truncated")
        return data

    def skip(self, n: int) -> None:
        self.at += n
        self.file.seek(self.at)

    def number(self, code: str) -> Any:
        return struct.unpack("<" + code, self.take(struct.calcsize("<" + code)))[0]

    def length(self) -> int:
        n = self.number("Q")
        if n > STRING_BYTES:
            raise ValueError("string too long")
        return n

    def text(self) -> str:
        return self.take(self.length()).decode("utf-8", "replace")

    def value(self, kind: int) -> str:
        if kind == 8:
            return self.text()
        if kind == 9:
            of, n = self.number("I"), self.number("Q")
            if of in SCALARS:
                self.skip(n * struct.calcsize("<" + SCALARS[of]))
            elif of == 8:
                for _ in range(n):
                    self.skip(self.length())
            elif of == 9:
                for _ in range(n):
                    self.value(of)
            else:
                raise ValueError(f"value type {of}")
            return f"array({of}, {n})"
        if kind not in SCALARS:
            raise ValueError(f"value type {kind}")
        return str(self.number(SCALARS[kind]))


def pairs(file: BinaryIO, size: int, cap: int = KEY_VALUE_BYTES) -> Iterator[tuple]:
    """(key, type, value) of a key-value header; arrays are told by type and length."""
    at = Cursor(file, size, cap)
    if size < 4 or at.take(4) != b"GGUF":
        raise ValueError("no such header")
    if at.number("I") < 2:
        raise ValueError("old version")
    at.number("Q")
    n = at.number("Q")
    if n > MOST_PAIRS:
        raise ValueError("too many pairs")
    for _ in range(n):
        key, kind = at.text(), at.number("I")
        yield key, kind, at.value(kind)


class KeyValueReader(RangedReader):
    suffixes = (".gguf",)
    columns = columns(("key", pa.string()), ("type", pa.int32()), ("value", pa.string()))

    def cost(self, size: int) -> int:
        return min(size, HEADER_BYTES)

    def rows(self, file: pa.NativeFile, size: int) -> Iterator[tuple]:
        return pairs(file, size)


class KeyValueHeaders(DataSource):
    """path, size, key, type, value; or an error after the pairs before it."""

    @classmethod
    def name(cls) -> str:
        return "key_value_headers"

    def schema(self) -> str:
        return "path string, size long, key string, type int, value string, error string"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return KeyValueReader(self.options)


def key_values(spark: SparkSession, path: str, **options: Any) -> DataFrame:
    return load(spark, KeyValueHeaders, path, **options)


# footers


class FooterReader(RangedReader):
    suffixes = (".parquet",)
    columns = columns(("rows", pa.int64()), ("row_groups", pa.int64()), ("columns", pa.int64()))

    def cost(self, size: int) -> int:
        return min(size, HEADER_BYTES)

    def rows(self, file: pa.NativeFile, size: int) -> Iterator[tuple]:
        if size < 12:
            raise ValueError("too small")
        try:
            found = pq.read_metadata(file)
        except (pa.ArrowInvalid, OSError) as error:
            raise ValueError("no footer") from error
        yield found.num_rows, found.num_row_groups, found.num_columns


class ParquetFooters(DataSource):
    """path, size, rows, row_groups, columns; or an error."""

    @classmethod
    def name(cls) -> str:
        return "parquet_footers"

    def schema(self) -> str:
        return "path string, size long, rows long, row_groups long, columns long, error string"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return FooterReader(self.options)


def footers(spark: SparkSession, path: str, **options: Any) -> DataFrame:
    return load(spark, ParquetFooters, path, **options)


# the same from bytes that a table holds


def tensors_of(rows: DataFrame) -> DataFrame:
    """Tensors from (path, content), in any store that Spark reads.

    Contents are dealt out by path first, since few files of a table may hold very many of them; each is parsed once."""
    rows = by_size(rows.select("path", "content"), "path", each=50_000)
    digits = F.hex(F.substring("content", 1, 8))
    size = F.conv(F.concat(*(F.substring(digits, 2 * k - 1, 2) for k in range(8, 0, -1))), 16, 10).cast("decimal(20,0)")
    whole = F.length("content") >= size + 8
    head = F.decode(F.expr("substring(content, 9, int(least(__size, 2147483639)))"), "utf-8")
    parsed = F.from_json(head, "map<string,struct<dtype:string,shape:array<bigint>>>")
    error = F.when(F.length("content") < 8, "truncated").when(F.col("__size") > TENSOR_HEADER_BYTES, "header too long").when(~whole, "truncated")
    row = lambda tensor, dtype, shape, error: F.struct(tensor.alias("tensor"), dtype.alias("dtype"), shape.alias("shape"), error.alias("error"))
    none = lambda kind: F.lit(None).cast(kind)
    failed = lambda error: F.array(row(none("string"), none("string"), none("array<bigint>"), error))
    entries = lambda m: F.transform(F.filter(F.map_entries(m), lambda e: e.key != "__metadata__"), lambda e: row(e.key, e.value.dtype, e.value.shape, none("string")))
    read = F.flatten(F.transform(F.array(parsed), lambda m: F.when(m.isNull(), failed(F.lit("no JSON"))).otherwise(entries(m))))  # parsed once
    found = F.when(F.col("error").isNotNull(), failed(F.col("error"))).otherwise(read)
    x = rows.withColumn("__size", size).withColumn("error", error)
    return x.select("path", F.explode(found).alias("t")).select("path", "t.*")


def key_values_of(rows: DataFrame) -> DataFrame:
    """The same for key-value headers; pairs before an error are kept."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                data = content.as_py() or b""
                try:
                    for pair in pairs(io.BytesIO(data), len(data)):
                        out.append((path, *pair, None))
                except (ValueError, struct.error) as error:
                    out.append((path, None, None, None, str(error) or type(error).__name__))
            yield pa.RecordBatch.from_pylist([dict(zip(("path", "key", "type", "value", "error"), r)) for r in out], FIELDS)

    return rows.select("path", "content").mapInArrow(work, "path string, key string, type int, value string, error string")


FIELDS = pa.schema([("path", pa.string()), ("key", pa.string()), ("type", pa.int32()), ("value", pa.string()), ("error", pa.string())])
