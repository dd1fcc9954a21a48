"""Operator 4, secret scans: an Aho-Corasick automaton finds keywords, regular expressions are anchored at
the hits only, and tokens that embed a checksum are kept only if it holds.

Scale: a narrow map over whole texts, no shuffle; a task holds one slice of about 8 MB of text.

Edge cases: a null or empty text has no span; null ids pass through; repeated rows are scanned each on its
own; extra columns stay out of the digest and are untouched by `redact`; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockroom.llm import common

#: Kinds in the order in which spans of one start are listed. Fixed values.
KINDS = ("assign", "access", "hex", "github", "npm")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
CHECKED = {"ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github", "ghr_": "github", "npm_": "npm"}
ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
CHECKED_BODY = re.compile(r"(?:gh[pousr]|npm)_([A-Za-z0-9]{36})(?![A-Za-z0-9])")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
REPLACEMENT = "[REDACTED]"


SPANS = T.ArrayType(T.StructType().add("kind", "string").add("start", "integer").add("end", "integer"))


def base62_crc(body: str) -> str:
    """The six base-62 digits that such tokens end with: the CRC-32 of what stands before them."""
    n, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, d = divmod(n, 62)
        out = BASE62[d] + out
    return out


def automaton() -> ahocorasick.Automaton:
    """All keywords in lower case with the kind that each announces."""
    found = ahocorasick.Automaton()
    for word in ASSIGN_WORDS:
        found.add_word(word, ("assign", len(word)))
    found.add_word("akia", ("access", 4))
    for word, kind in CHECKED.items():
        found.add_word(word, (kind, len(word)))
    found.make_automaton()
    return found


def lower_ascii(text: str) -> str:
    """A-Z in lower case and nothing else, so that every code point keeps its place."""
    return text.lower() if text.isascii() else text.encode().lower().decode()


def scan(text: str, words: ahocorasick.Automaton) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind as listed in KINDS; per kind leftmost and non-overlapping.

    A base match is taken off the text even when it fails its length test, as a plain left-to-right search would.
    """
    spans, ends = [], dict.fromkeys(KINDS, 0)
    for last, (kind, size) in words.iter(lower_ascii(text)):
        start = last - size + 1
        if start < ends[kind]:
            continue
        if kind == "assign":
            if m := ASSIGN.match(text, start):
                ends[kind] = m.end()
                if m.end(1) - m.start(1) >= 6:
                    spans.append((start, m.end(), kind))
        elif kind == "access":
            if m := ACCESS.match(text, start):
                ends[kind] = m.end()
                if m.end() - start >= 20:
                    spans.append((start, m.end(), kind))
        elif (m := CHECKED_BODY.match(text, start)) and base62_crc(m[1][:30]) == m[1][30:]:
            ends[kind] = m.end()
            spans.append((start, m.end(), kind))
    spans += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))


def listed(spans: Iterable[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def merged(spans: Iterable[tuple[int, int, str]]) -> list[list[int]]:
    """Overlapping or touching spans as one."""
    out: list[list[int]] = []
    for start, end, _ in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out


def redacted(text: str, spans: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for start, end in merged(spans):
        out += [text[at:start], REPLACEMENT]
        at = end
    return "".join([*out, text[at:]])


def secret_spans(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` and `spans`: array of (kind, start, end), code points with end exclusive."""
    keep = common.kept(keep, "spans")
    slim = docs.select(*keep, F.col(text).alias("__text"))
    schema = T.StructType(slim.drop("__text").schema.fields + [T.StructField("spans", SPANS)])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = automaton()
        for batch in common.pieces(batches, "__text"):
            found = [[{"kind": k, "start": s, "end": e} for s, e, k in scan(t, words)] if t else [] for t in batch.column("__text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(found, kind)], [*keep, "spans"])

    return slim.mapInArrow(work, schema)


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """The same rows and columns with each secret in `text` replaced; null texts stay null."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = automaton()
        for batch in common.pieces(batches, text):
            at = batch.schema.get_field_index(text)
            out = [redacted(t, s) if t and (s := scan(t, words)) else t for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, text, pa.array(out, batch.schema.field(at).type))

    return docs.mapInArrow(work, docs.schema)


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = secret_spans(common.read(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long")
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
    base = F.filter("spans", lambda s: s.kind.isin(*KINDS[:3]))
    return spans.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(text(base), 256).alias("base_sha256"),
        text("spans").alias("spans"),
    )
