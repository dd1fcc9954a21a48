"""Records put together from the results of other operators, in closed schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockroom.operators.ranks import parts

#: Fields of an estimate that a want-list keeps, in order.
ESTIMATE = ("as_of", "revision", "total_bytes", "files", "unknown_sizes", "dominant_format", "parameters", "precision", "license", "gated", "hints", "parents")
TIERS = ("declared", "evidence", "mentioned")


def completed_records(expected: DataFrame, states: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, refused): inventory records of artifacts all of whose expected files are verified, and the others with
    how many files stand in the way."""
    n, key = parts(expected), ["aid", "path"]
    told = states.select(*key, "status", F.col("sha256").alias("got"), F.col("upstream_ok").alias("verified_against_upstream"))
    x = expected.repartition(n, *key).join(told.repartition(n, *key), key, "left")
    open_ = x.groupBy("aid").agg(F.count_if(F.coalesce(F.col("status") != "verified", F.lit(True))).alias("unverified"))
    done = x.join(open_.where("unverified = 0").select("aid"), "aid", "left_semi")
    return done.select("aid", "path", "size", F.col("got").alias("sha256"), "verified_against_upstream"), open_.where("unverified > 0")


def estimate_digest(rows: DataFrame, *keys: str) -> DataFrame:
    """The closed digest of each estimate; a field that a row lacks is null, parents lose repeats and empty names."""
    have = set(rows.columns)
    field = lambda c: (F.col(c) if c in have else F.lit(None).cast("string")).alias(c)
    clean = F.array_distinct(F.filter("parents", lambda p: F.coalesce(F.trim(p), F.lit("")) != "")).alias("parents") if "parents" in have else F.lit(None).cast("array<string>").alias("parents")
    return rows.select(*keys, F.struct(*(clean if c == "parents" else field(c) for c in ESTIMATE)).alias("estimate"))


def vault_rows(holdings: DataFrame) -> DataFrame:
    """Holdings in the form of want-list rows; nothing remains of what is held whole."""
    status = F.when(F.col("status") == "registered", "have").otherwise("partial")
    return holdings.select(F.col("aid").alias("source"), status.alias("status"), F.when(status == "have", 0).otherwise(F.col("remaining_bytes")).alias("remaining"), F.col("payload_bytes").alias("on_disk"), F.lit(None).cast("int").alias("desire"))


def bundle_records(identity: DataFrame, inventory: DataFrame, hashes: DataFrame, lineage: DataFrame, licensing: DataFrame, completeness: DataFrame) -> DataFrame:
    """One nested record for each artifact (identity: aid, bundle_name, revision, artifact_type, canonical); parts that
    are missing stay null. Files are ordered by path."""
    one = lambda df, name: df.select("aid", F.struct(*(c for c in df.columns if c != "aid")).alias(name))
    files = inventory.groupBy("aid").agg(F.array_sort(F.collect_list(F.struct("path", "size", "sha256"))).alias("files"), F.sum("size").alias("total_bytes"))
    parents = lineage.groupBy(F.col("child").alias("aid")).agg(F.array_sort(F.collect_list(F.struct("parent", "relation", "declared_by"))).alias("parents"))
    out = identity.withColumn("bundle_id", F.concat("bundle_name", F.lit("@"), F.substring("revision", 1, 12)))
    for part in (one(files.join(hashes, "aid", "left"), "inventory"), parents, one(licensing, "licensing"), one(completeness.groupBy("aid").agg(F.first("status").alias("status")), "validation")):
        out = out.join(part, "aid", "left")
    return out.withColumn("schema_version", F.lit("2.0.0"))


def code_record(repository: DataFrame, declarations: DataFrame, references: DataFrame) -> DataFrame:
    """Description, topics and default branch of a source tree with its build files and what it refers to."""
    build = declarations.groupBy("aid").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "files")))).alias("runtime"))
    refs = references.groupBy(F.col("tree").alias("aid")).agg(F.array_sort(F.collect_list(F.struct("kind", "ref", "tier", "occurrences"))).alias("references"))
    return repository.join(build, "aid", "left").join(refs, "aid", "left")


def reference_order() -> list[Column]:
    """Strongest tier first, then what resolves, what is unknown, what doesn't; then kind and name."""
    tier = F.array_position(F.array(*map(F.lit, TIERS)), F.col("tier"))
    return [tier, F.when(F.col("resolved"), 0).when(F.col("resolved").isNull(), 1).otherwise(2), F.col("kind"), F.col("ref")]
