"""Records of the first major version in the shape of the second, for all artifacts at once.

Nothing is fetched: an address is spelled from the origin and id that a record has, parents from its relationships and recorded
tags, a layout from its type, the reading of its name from the name grammar. A record of the present major stays as it is, and one
of a newer major is left alone and called so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockroom.functions.names import with_lineage
from stockroom.functions.tables import COMPLETENESS

MAJOR, PRESENT = 2, "2.1.0"
#: Words of the first version and what they are called now. Fixed values.
POLICIES, VERDICTS = {"masters": "negatives"}, {"master": "negative"}
EDGES = "array<struct<source:string,relation:string,declared_by:string>>"


def renamed(word: Column, words: dict[str, str]) -> Column:
    out = word
    for old, new in words.items():
        out = F.when(word == old, new).otherwise(out)
    return out


def standing(version: Column) -> Column:
    """current, older or newer; unreadable if it states no major."""
    major = F.regexp_extract(version, r"^(\d+)(\.|$)", 1)
    number = F.when(major != "", major.cast("int"))
    return F.when(number.isNull(), "unreadable").when(number < MAJOR, "older").when(number > MAJOR, "newer").otherwise("current")


def parents(kind: Column, prefix: Column, bases: Column, relation: Column, trained_on: Column, derived_from: Column, tags: Column) -> Column:
    """Edges that a record of the first version states.

    A base that a tag names has the tag's relation; the recorded relation is the card's, unless it is the one that all tags agree
    on. Data sets that a model was trained on, and those that a data set derives from, are the card's too."""
    none = F.array().cast("array<string>")
    edge = lambda source, relation, by: F.struct(source.alias("source"), relation.cast("string").alias("relation"), F.lit(by).alias("declared_by"))
    told = F.filter(F.coalesce(tags, none), lambda t: t.rlike("^base_model:([a-z_]+:)?[^:/]+/[^:]+$"))
    repo = lambda t: F.regexp_extract(t, "([^:]+)$", 1)
    word = lambda t: F.regexp_extract(t, "^base_model:([a-z_]+):", 1)
    words = F.array_distinct(F.filter(F.transform(told, word), lambda w: w != ""))
    agreed = (F.size(words) == 1) & (F.get(words, 0) == relation)
    stated = lambda b: F.get(F.filter(told, lambda t: (repo(t) == b) & (word(t) != "")), 0)
    by_tag = lambda b: F.exists(told, lambda t: repo(t) == b)
    base = lambda b: F.when(by_tag(b), edge(F.concat(prefix, b), F.coalesce(word(stated(b)), relation), "tag")).otherwise(edge(F.concat(prefix, b), F.when(~F.coalesce(agreed, F.lit(False)), relation), "card"))
    data = lambda names, relation: F.transform(F.filter(F.coalesce(names, none), lambda n: F.trim(n) != ""), lambda n: edge(F.concat(prefix, F.lit("datasets/"), n), F.lit(relation), "card"))
    model = F.concat(F.transform(F.coalesce(bases, none), base).cast(EDGES), data(trained_on, "trained_on").cast(EDGES))
    return F.when(kind == "dataset", data(derived_from, "derived").cast(EDGES)).otherwise(model)


def migrated(records: DataFrame) -> DataFrame:
    """aid, standing, schema_version, artifact_type, provider, address, identity (of the name, as read now), parents, policy, verdicts,
    payload_root and changes, from (aid, schema_version, artifact_type, origin, provider, repo_id, address, base_models,
    base_model_relation, training_datasets, source_datasets, tags, policy, verdicts, payload_root)."""
    old, kind = F.col("standing") == "older", F.coalesce("artifact_type", F.lit("model"))
    x = records.withColumn("standing", standing(F.col("schema_version"))).withColumn("artifact_type", F.when(old, kind).otherwise(F.col("artifact_type")))
    provider = F.when(old, F.coalesce("provider", "origin")).otherwise(F.col("provider"))
    path = F.when((kind == "dataset") & ~F.col("repo_id").startswith("datasets/"), F.concat(F.lit("datasets/"), "repo_id")).otherwise(F.col("repo_id"))
    address = F.when(old, F.coalesce("address", F.concat("origin", F.lit(":"), path))).otherwise(F.col("address"))
    root = F.coalesce(*(F.when(kind == t, r) for t, r in COMPLETENESS), F.lit("model/"))
    edges = parents(kind, F.concat(F.coalesce("provider", "origin", F.lit("huggingface")), F.lit(":")), F.col("base_models"), F.col("base_model_relation"), F.col("training_datasets"), F.col("source_datasets"), F.col("tags"))
    change = lambda condition, what: F.when(old & condition, F.lit(what))
    words = F.col("policy").isin(*POLICIES) | F.exists(F.coalesce("verdicts", F.array().cast("array<string>")), lambda v: v.isin(*VERDICTS))
    changes = F.array_compact(F.array(change(F.lit(True), "schema_version"), change(F.lit(True), "identity"), change(F.lit(True), "lineage"), change(F.col("address").isNull() & F.col("origin").isNotNull(), "address"), change(F.coalesce(words, F.lit(False)), "classification"), change(F.col("payload_root").isNull(), "layout")))
    out = x.select(
        "aid",
        "standing",
        F.when(old, PRESENT).otherwise(F.col("schema_version")).alias("schema_version"),
        "artifact_type",
        provider.alias("provider"),
        address.alias("address"),
        F.when(old, edges).alias("parents"),
        F.when(old, renamed(F.col("policy"), POLICIES)).otherwise(F.col("policy")).alias("policy"),
        F.when(old, F.transform("verdicts", lambda v: renamed(v, VERDICTS))).otherwise(F.col("verdicts")).alias("verdicts"),
        F.when(old, F.coalesce("payload_root", root)).otherwise(F.col("payload_root")).alias("payload_root"),
        changes.alias("changes"),
        F.when(old, F.regexp_extract("repo_id", r"([^/:]+)/*$", 1)).alias("__name"),
    )
    return with_lineage(out, "__name").withColumnRenamed("lineage", "identity").drop("__name")
