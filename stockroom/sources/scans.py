"""Readers of records as tables, with a row and not a failure for what can't be read, and the sinks that go with them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stockroom.operators.ranks import first_rows

FILE = "struct<path:string,size:long,sha256:string,upstream_lfs_sha256:string,upstream_git_sha1:string,verified_against_upstream:boolean>"
MANIFEST = f"schema_version string, bundle_id string, artifact_type string, source struct<canonical:string,revision:string>, inventory struct<files:array<{FILE}>>, _corrupt string"
LEDGER = "version long, source struct<canonical:string,revision:string>, expected array<struct<path:string,size:long,sha256:string>>, files map<string,struct<status:string,partial:long>>, _corrupt string"
CATALOG = "schema_version string, id string, title string, curator string, updated string, entries array<struct<source:string,revision:string,include:array<string>,desire:int,note:string,added:string>>, _corrupt string"
SNAPSHOT = "source string, revision string, files array<struct<path:string,size:long,blob_id:string,lfs:struct<sha256:string,size:long>>>"


def texts(spark: SparkSession, path: str) -> DataFrame:
    """(file, text) of every file of a tree of records."""
    return spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def parsed(rows: DataFrame, schema: str) -> DataFrame:
    """One row for each JSON text (file, text); what can't be read is in `_corrupt`."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    return rows.select("file", F.from_json("text", schema, options).alias("r")).select("r.*", "file")


def documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The same over the files of a tree."""
    return parsed(texts(spark, path), schema)


def manifests(spark: SparkSession, path: str) -> DataFrame:
    return standing(documents(spark, path, MANIFEST))


def standing(rows: DataFrame) -> DataFrame:
    """Manifests with a standing: unreadable, older (migrate), current or newer (unsupported); reserved folders are left out."""
    major = F.try_to_number(F.substring_index("schema_version", ".", 1), F.lit("999")).cast("int")
    rows = rows.where(F.col("file").endswith("/manifest.json") & ~F.col("file").rlike(r"/(\.[^/]+|_[^/]+)/"))
    found = F.when(F.col("_corrupt").isNotNull() | major.isNull(), "unreadable").when(major < 2, "migrate").when(major > 2, "unsupported").otherwise("current")
    return rows.withColumn("standing", found)


def inventory(manifest_rows: DataFrame) -> DataFrame:
    """Files that readable manifests record."""
    return manifest_rows.where("standing = 'current'").select(F.col("bundle_id").alias("aid"), F.explode("inventory.files").alias("f")).select("aid", "f.*")


def partials(ledger_rows: DataFrame, manifest_rows: DataFrame) -> DataFrame:
    """Transfers without a manifest beside them."""
    folder = F.regexp_replace("file", r"/[^/]+$", "")
    done = manifest_rows.select(folder.alias("folder")).distinct()
    return ledger_rows.withColumn("folder", folder).join(done, "folder", "left_anti")


def ledger_states(ledger_rows: DataFrame) -> DataFrame:
    """aid, path, size, status and partial bytes of what each ledger expects; what it says nothing of is missing."""
    x = ledger_rows.select(F.col("source.canonical").alias("aid"), "files", F.explode("expected").alias("e"))
    state = F.col("files")[F.col("e.path")]
    return x.select("aid", "e.path", "e.size", F.coalesce(state.getField("status"), F.lit("missing")).alias("status"), F.coalesce(state.getField("partial"), F.lit(0)).alias("partial"))


def loose_manifests(manifest_rows: DataFrame, registered: DataFrame) -> DataFrame:
    """Manifests outside every registered folder (`folder`), by an equi-join on each parent folder."""
    parts = F.split(F.regexp_replace("file", r"/[^/]+$", ""), "/")
    parents = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    inside = manifest_rows.select("file", F.explode(parents).alias("folder")).join(registered.select("folder").distinct(), "folder", "left_semi").select("file").distinct()
    return manifest_rows.join(inside, "file", "left_anti")


def catalog_entries(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, rejects with a reason): an entry needs a source, a desire between 1 and 9 or none, and no empty pattern."""
    x = rows.where("_corrupt is null").select(F.col("id").alias("catalog_id"), F.posexplode("entries").alias("k", "e")).select("catalog_id", "k", "e.*")
    reason = (
        F.when(~F.col("catalog_id").rlike("^[a-z0-9][a-z0-9-]*$"), "catalog id")
        .when(F.coalesce(F.trim("source"), F.lit("")) == "", "source")
        .when(~F.col("desire").between(1, 9), "desire")
        .when(F.exists("include", lambda p: F.coalesce(p, F.lit("")) == ""), "include")
    )
    x = x.withColumn("reason", reason)
    return x.where("reason is null").drop("reason"), x.where("reason is not null")


def snapshot_inventory(rows: DataFrame) -> DataFrame:
    """Upstream listings as files: the large-file digest where there is one, else the git id."""
    x = rows.select(F.col("source").alias("aid"), "revision", F.explode("files").alias("f"))
    return x.select("aid", "revision", "f.path", F.coalesce("f.lfs.size", "f.size").alias("size"), F.col("f.lfs.sha256").alias("sha256"), F.when(F.col("f.lfs").isNull(), F.col("f.blob_id")).alias("git_sha1"))


def payload_listing(spark: SparkSession, path: str) -> DataFrame:
    """Paths and sizes of a tree, content unread."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "modificationTime").where(~F.col("path").rlike(r"/\.cache/"))


def payload_digests(spark: SparkSession, path: str) -> DataFrame:
    """Paths, sizes and SHA-256 of a tree of files that fit a row (2 GiB); `ranged.digests` reads files of any size."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).where(~F.col("path").rlike(r"/\.cache/"))
    return rows.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def lfs_pointers(spark: SparkSession, path: str) -> DataFrame:
    """Pointer files of a tree. The size limit is pushed to the listing."""
    return pointers(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path))


def pointers(rows: DataFrame) -> DataFrame:
    """Object id and size of what pointer files (path, length, content) of at most 1024 bytes stand for."""
    small = rows.where("length <= 1024")
    text = F.decode("content", "utf-8")
    found = small.where(text.startswith("version https://git-lfs.github.com/spec/v1"))
    return found.select("path", F.regexp_extract(text, r"oid sha256:([0-9a-f]{64})", 1).alias("oid"), F.regexp_extract(text, r"size (\d+)", 1).cast("long").alias("size"))


def hash_list(records: DataFrame) -> DataFrame:
    """Lines in the order of paths, ready to write as one text for each artifact."""
    return records.select("aid", "path", F.concat("sha256", F.lit("  "), "path").alias("value"))


def write_hash_lists(records: DataFrame, path: str) -> None:
    hash_list(records).repartition("aid").sortWithinPartitions("aid", "path").select("aid", "value").write.partitionBy("aid").text(path)


def catalog_json(entries: DataFrame) -> DataFrame:
    """Each catalog as one JSON document with stable keys, entries in order."""
    row = F.struct("k", "source", "revision", "desire", "note")
    out = entries.groupBy("catalog_id").agg(F.array_sort(F.collect_list(row)).alias("entries"))
    return out.select("catalog_id", F.to_json(F.struct(F.lit("3.0.0").alias("schema_version"), F.col("catalog_id").alias("id"), F.transform("entries", lambda e: e.dropFields("k")).alias("entries"))).alias("value"))


def append_history(rows: DataFrame, path: str, every: str = "day") -> None:
    """Sessions, events or runs, by day or another period; batch and stream read the same files."""
    rows.withColumn(every, F.date_format(F.date_trunc(every, "at"), "yyyy-MM-dd")).hint("rebalance", every).write.mode("append").partitionBy(every).parquet(path)


def run_history(spark: SparkSession, path: str) -> DataFrame:
    """Check runs of a tree, latest first."""
    return runs(texts(spark, path)).orderBy(F.col("run_id").desc())


def runs(rows: DataFrame) -> DataFrame:
    """Check runs by their reports (file, text); an unreadable report is incomplete, and its folder names the run."""
    rows = parsed(rows, "run_id string, created string, command string, status string, _corrupt string")
    bad = F.col("_corrupt").isNotNull() | F.col("status").isNull()
    return rows.select(F.coalesce("run_id", F.regexp_extract("file", r"/([^/]+)/[^/]+$", 1)).alias("run_id"), "created", "command", F.when(bad, "incomplete").otherwise(F.col("status")).alias("status"))


def measured_rows(counts: DataFrame, heads: DataFrame) -> DataFrame:
    """Row counts of an artifact's data files and how much of it was measured.

    `heads` (aid, path, verdict) are all data files with their structural verdict, `counts` (path, rows) those that could
    be read: measured if all were, partial if some, skipped if none; errors name the first ten others."""
    x = heads.join(counts, "path", "left")
    read = F.col("rows").isNotNull()
    out = x.groupBy("aid").agg(F.sum("rows").alias("rows"), F.count_if(read).alias("files"), F.bool_and(read).alias("all"), F.bool_or(read).alias("any"))
    unread = x.where(~read).select("aid", F.concat_ws(": ", "path", F.coalesce("verdict", F.lit("unread"))).alias("error")).distinct()
    ten = first_rows(unread, ["aid"], ["error"], 10).groupBy("aid").agg(F.sort_array(F.collect_list("error")).alias("errors"))
    status = F.when(F.col("all"), "measured").when(F.col("any"), "partial").otherwise("skipped").alias("status")
    return out.join(ten, "aid", "left").select("aid", "rows", "files", F.coalesce("errors", F.array().cast("array<string>")).alias("errors"), status)


def latest_of(rows: DataFrame, keep: int = 50, *ties: str) -> DataFrame:
    """The view that history readers take: the last rows of each artifact."""
    w = Window.partitionBy("aid").orderBy(F.col("at").desc(), *(F.col(c).desc() for c in ties))
    return rows.withColumn("n", F.row_number().over(w)).where(F.col("n") <= keep).drop("n")
