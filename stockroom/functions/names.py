"""Reads the lineage that a release name states: family, generation, member, variants, formats and sizes."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Closed vocabularies of name words.
VARIANT_WORDS = {
    "instruct": "instruct|it|sft",
    "chat": "chat",
    "thinking": "thinking|reasoning|reasoner|think",
    "abliterated": r"abliterat\w*|obliterat\w*|heretic|ablated",
    "uncensored": "uncensored",
    "distill": r"distill\w*",
}
FORMAT_WORDS = {
    "gguf": "gguf",
    "imatrix": "i1|imatrix",
    "fp8": "fp8",
    "nvfp4": "nvfp4",
    "mxfp4": "mxfp4",
    "fp4": "fp4",
    "awq": "awq",
    "gptq": "gptq",
    "int4": "int4|4bit|w4a16",
    "int8": "int8|8bit|w8a8|w8a16",
    "bnb": "bnb|bitsandbytes",
    "mlx": "mlx",
    "exl2": "exl2",
    "exl3": "exl3",
    "onnx": "onnx",
    "safetensors": "safetensors",
}
TIERS = {"nano", "micro", "tiny", "mini", "small", "base", "medium", "large", "xl", "xxl"}
SCALE = {"k": 1e3, "m": 1e6, "b": 1e9, "t": 1e12}

VERSION = re.compile(r"([A-Za-z]*)(\d+(?:\.\d+)*)([A-Za-z]?)")
SIZE = re.compile(r"(?:(\d+)[xX])?([Aa]?)(\d+(?:\.\d+)?)([KMBTkmbt])")
SCHEMA = "family string, generation string, member string, variants array<string>, formats array<string>, size_total double, size_active double"


def word_kind(word: str, vocabulary: dict[str, str]) -> str | None:
    return next((kind for kind, forms in vocabulary.items() if re.fullmatch(forms, word, re.I)), None)


def size_of(word: str) -> tuple[float | None, float | None] | None:
    """(total, active) parameters that a size word states, or None: `NxM` is both, a leading A is active only."""
    m = SIZE.fullmatch(word)
    if not m or (m[2] and (m[1] or m[4] in "kK")) or (m[1] and m[4] in "kK"):
        return None
    n = float(m[3]) * SCALE[m[4].lower()]
    return (None, n) if m[2] else (int(m[1]) * n, n) if m[1] else (n, None)


def read_name(name: str | None) -> dict:
    words = [w for w in re.split(r"[-_\s]+", name or "") if w]
    family: list[str] = []
    generation, member, at = None, [], 0
    known = lambda w: word_kind(w, VARIANT_WORDS) or word_kind(w, FORMAT_WORDS)
    while at < len(words) and words[at].isalpha() and not known(words[at]) and not (family and words[at] in TIERS):
        family.append(words[at])
        at += 1
    m = VERSION.fullmatch(words[at]) if at < len(words) and not known(words[at]) else None
    if m and not size_of(words[at]) and m[3].lower() not in SCALE:
        letters, number, tail = m.groups()
        if letters and (not family or len(letters) > 2):
            family.append(letters)  # glued to its version
            letters = ""
        if family:
            generation = letters + number
            member = [tail] if tail else []
            at += 1
    variants, formats, total, active, after_size = [], [], None, None, False
    for word in words[at:]:
        size = size_of(word)
        kind = "base" if word == "Base" or (after_size and re.fullmatch("base|pt", word, re.I)) else word_kind(word, VARIANT_WORDS)
        if size:
            total, active = total if total is not None else size[0], active if active is not None else size[1]
            member.append(word)
        elif kind:
            variants += [kind] if kind not in variants else []
        elif form := word_kind(word, FORMAT_WORDS):
            formats += [form] if form not in formats else []
        else:
            member.append(word)
        after_size = bool(size)
    return {"family": "-".join(family) or None, "generation": generation, "member": "-".join(member) or None, "variants": variants, "formats": formats, "size_total": total, "size_active": active}


def fields_of(names: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([read_name(n) for n in names], columns=["family", "generation", "member", "variants", "formats", "size_total", "size_active"])


def with_lineage(rows: DataFrame, name: str = "name") -> DataFrame:
    """Rows with a `lineage` struct. Each distinct name is read once and joined back."""
    fields = F.pandas_udf(fields_of, SCHEMA)
    read = rows.select(F.col(name).alias("__name")).where("__name is not null").distinct().withColumn("lineage", fields("__name"))
    return rows.join(read, rows[name] == read["__name"], "left").drop("__name")
