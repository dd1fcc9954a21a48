"""Selections, classes and totals over inventories of files."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stockroom.operators.ranks import Cut, running

#: Names of files that ride along with any selection, compared without case. Fixed values.
SIDECARS = (
    "README", "README.*", "LICENSE", "LICENSE.*", "LICENCE", "LICENCE.*", "COPYING", "COPYING.*", "license", "license.*",
    "config.json", "generation_config.json", "*.index.json", "tokenizer.json", "tokenizer.model", "tokenizer_config.json", "vocab.json", "merges.txt",
    "special_tokens_map.json", "added_tokens.json", "chat_template*", "preprocessor_config.json", "video_preprocessor_config.json", "spiece.model", "tiktoken.model",
    "*.tiktoken", "*.py", "dataset_infos.json",
)
WEIGHTS = (".safetensors", ".gguf", ".bin", ".pt", ".pth", ".onnx", ".h5", ".msgpack")


def glob_regex(pattern: str) -> str:
    """An anchored regular expression for a glob in which `*` and `?` cross `/`; `[...]` is a class."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        end = pattern.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif end > 0:
            body = pattern[i + 1 : end].replace("\\", "\\\\").replace("[", "\\[").replace("&", "\\&")
            out += "[" + ("^" + body[1:] if body[0] == "!" else body) + "]"
            i = end
        else:
            out += re.escape(c)
        i += 1
    return f"(?s)^{out}$"


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """Lower-case suffix with its dot, `(none)` without one; a leading dot starts no suffix."""
    found = F.lower(F.regexp_extract(basename(path), r"^.+(\.[^.]+)$", 1))
    return F.when(found == "", "(none)").otherwise(found)


def matches(path: Column, patterns: list[str]) -> Column:
    """Any pattern fits the whole path or the basename; a leading `/` anchors it to the root and to the whole path."""
    hit = F.lit(False)
    for p in patterns:
        if p.startswith("/"):
            hit = hit | path.rlike(glob_regex(p[1:]))
        else:
            hit = hit | path.rlike(glob_regex(p)) | basename(path).rlike(glob_regex(p))
    return hit


def is_sidecar(path: Column) -> Column:
    every = "|".join(dict.fromkeys(glob_regex(p.lower())[4:] for p in SIDECARS))
    return F.lower(basename(path)).rlike(f"(?s)({every})")


def selected(inventory: DataFrame, patterns: list[str], sidecars: bool = True) -> DataFrame:
    """Files that patterns name, with what rides along; an artifact in which patterns name nothing selects nothing."""
    hit = matches(F.col("path"), patterns)
    named = inventory.where(hit).select("aid").distinct()
    keep = hit | is_sidecar(F.col("path")) if sidecars else hit
    return inventory.where(keep).join(named, "aid", "left_semi")


def empty_selections(inventory: DataFrame, patterns: list[str]) -> DataFrame:
    """Artifacts in which patterns name no file."""
    return inventory.select("aid").distinct().join(inventory.where(matches(F.col("path"), patterns)).select("aid"), "aid", "left_anti")


def selection_totals(inventory: DataFrame, kept: DataFrame) -> DataFrame:
    """Files, bytes and unknown sizes of the whole and of what is kept."""
    totals = lambda df, name: df.groupBy("aid").agg(F.count("*").alias(f"{name}_files"), F.coalesce(F.sum("size"), F.lit(0)).alias(f"{name}_bytes"), F.count_if(F.col("size").isNull()).alias(f"{name}_unknown"))
    out = totals(inventory, "full").join(totals(kept, "kept"), "aid", "left")
    return out.fillna(0, ["kept_files", "kept_bytes", "kept_unknown"])


def file_role(path: Column) -> Column:
    """weight, index, data or support, by suffix."""
    low = F.lower(path)
    return (
        F.when(low.rlike(r"\.index\.json$"), "index")
        .when(low.rlike("(" + "|".join(map(re.escape, WEIGHTS)) + ")$"), "weight")
        .when(low.rlike(r"\.(parquet|jsonl|csv|tsv|arrow|txt)$"), "data")
        .otherwise("support")
    )


def unsafe_paths(inventory: DataFrame) -> DataFrame:
    """Absolute paths, paths that climb, and empty ones."""
    return inventory.where(F.col("path").rlike(r"^$|^/|^[A-Za-z]:|\\|(^|/)\.\.(/|$)")).select("aid", "path")


def oversize(inventory: DataFrame, limit: int = 4 * 1024**3 - 1) -> DataFrame:
    """Files that a destination with a size limit can't take."""
    return inventory.where(F.col("size") > limit).select("aid", "path", "size")


def format_breakdown(inventory: DataFrame) -> DataFrame:
    """Files and bytes by extension; an unknown size adds nothing."""
    return inventory.groupBy("aid", extension(F.col("path")).alias("ext")).agg(F.count("*").alias("files"), F.sum(F.coalesce("size", F.lit(0))).alias("bytes"))


def dominant_format(inventory: DataFrame) -> DataFrame:
    """The extension with most bytes, then most files, then the smallest name."""
    w = Window.partitionBy("aid").orderBy(F.col("bytes").desc(), F.col("files").desc(), "ext")
    return format_breakdown(inventory).withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")


def payload_split(inventory: DataFrame) -> DataFrame:
    """Primary and support files and bytes, the largest file and how many sizes are unknown."""
    primary = file_role(F.col("path")).isin("weight", "data")
    size = F.coalesce("size", F.lit(0))
    return inventory.groupBy("aid").agg(
        F.count_if(primary).alias("primary_files"),
        F.sum(F.when(primary, size).otherwise(0)).alias("primary_bytes"),
        F.count_if(~primary).alias("support_files"),
        F.max(F.struct(F.col("size"), F.col("path"))).getField("path").alias("largest_path"),
        F.max("size").alias("largest_bytes"),
        F.count_if(F.col("size").isNull()).alias("unknown_sizes"),
    )


def usage(holdings: DataFrame, *levels: str, size: str = "size") -> DataFrame:
    """Bytes and files rolled up over the levels, totals under null."""
    return holdings.rollup(*levels).agg(F.sum(size).alias("bytes"), F.count("*").alias("files"))


def exact_twins(sets: DataFrame) -> DataFrame:
    """Sets of one artifact with the same digests: all but the keeper, with the keeper's directory.

    `sets` has aid, dir and digests; the keeper lies at the root or else least deep, ties to the smaller name.
    A set with an unknown digest has no twin."""
    known = sets.where(~F.exists("digests", lambda x: x.isNull())).withColumn("signature", F.sha2(F.array_join(F.sort_array("digests"), ","), 256))
    depth = F.when(F.col("dir") == "", -1).otherwise(F.length("dir") - F.length(F.replace(F.col("dir"), F.lit("/"), F.lit(""))))
    w = Window.partitionBy("aid", "signature").orderBy("depth", "dir")
    ranked = known.withColumn("depth", depth).withColumn("k", F.row_number().over(w)).withColumn("keeper", F.first("dir").over(w))
    return ranked.where("k > 1").select("aid", "dir", "keeper")


def loose_license_files(inventory: DataFrame) -> DataFrame:
    """Licence texts at the root of a payload."""
    return inventory.where(F.col("path").rlike(r"(?i)^(licen[cs]e|copying|notice)[^/]*$")).select("aid", "path")


def size_order(inventory: DataFrame, cut: Cut) -> DataFrame:
    """Smallest first, an unknown size as zero, ties by path."""
    x = inventory.select("aid", "path", "size", F.coalesce("size", F.lit(0)).alias("__size"))
    return running(x, ["aid"], ["__size", "path"], cut).select("aid", "path", "size", F.col("rank").alias("position"))
