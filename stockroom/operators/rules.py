"""Rules over the file listing of an artifact; rule tables are small dimensions that a user may extend."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockroom.operators.globs import fitting
from stockroom.operators.ranks import first_rows


#: Rows that a dimension may have; a larger one is an error and not a silent broadcast.
DIMENSION_ROWS = 10_000


def checked(dimension: DataFrame) -> DataFrame:
    """A rule table that is counted before it is broadcast."""
    if dimension.limit(DIMENSION_ROWS + 1).count() > DIMENSION_ROWS:
        raise ValueError(f"a dimension has over {DIMENSION_ROWS} rows")
    return F.broadcast(dimension)


def rule_hits(inventory: DataFrame, rules: DataFrame) -> DataFrame:
    """Files that each rule (artifact_type, label, glob, required) names, within its artifact type.

    A rule with a slash matches the path, else the basename. Where the table says so (`root`), only files at the root count."""
    checked(rules)
    whole = F.contains("glob", F.lit("/"))
    r = rules.withColumn("__glob", F.regexp_replace("glob", "^/", ""))
    on = ["artifact_type"]
    by_path = fitting(inventory, r.where(whole), on, F.col("path"), "__glob", small=True)
    by_name = fitting(inventory, r.where(~whole), on, F.substring_index("path", "/", -1), "__glob", small=True)
    hits = by_path.unionByName(by_name).drop("__glob")
    return hits.where(~F.col("root") | ~F.contains("path", F.lit("/"))) if "root" in rules.columns else hits


def completeness(inventory: DataFrame, rules: DataFrame) -> DataFrame:
    """Each artifact's labels: present or not, with the first ten files, and the artifact's status over required ones.

    A label that nothing matches is there as false; an artifact type without rules has status unknown."""
    artifacts = inventory.select("aid", "artifact_type").distinct()
    wanted = artifacts.join(checked(rules.select("artifact_type", "label", "required").distinct()), "artifact_type", "left")
    hit = first_rows(rule_hits(inventory, rules).select("aid", "label", "path"), ["aid", "label"], ["path"], 10, ties=True)
    hit = hit.groupBy("aid", "label").agg(F.sort_array(F.collect_set("path")).alias("files"))
    out = wanted.join(hit, ["aid", "label"], "left").withColumn("present", F.col("files").isNotNull())
    state = out.groupBy("aid").agg(F.when(F.bool_and(F.col("label").isNull()), "unknown").when(F.bool_or(F.col("required") & ~F.col("present")), "incomplete").otherwise("complete").alias("status"))
    return out.join(state, "aid").select("aid", "label", "required", "present", "files", "status")


def engines(inventory: DataFrame, rules: DataFrame) -> DataFrame:
    """Engines (label) all of whose required globs and, where it lists others, any of those match, in the order of the registry."""
    hits = rule_hits(inventory, rules).select("aid", "label", "glob").distinct()
    need = rules.groupBy("label").agg(F.count_if("required").alias("all_of"), F.count_if(~F.col("required")).alias("any_of"), F.min("ordinal").alias("ordinal"))
    got = hits.join(checked(rules.select("label", "glob", "required").distinct()), ["label", "glob"]).groupBy("aid", "label").agg(F.count_if("required").alias("has_all"), F.count_if(~F.col("required")).alias("has_any"))
    ok = (F.col("has_all") == F.col("all_of")) & ((F.col("any_of") == 0) | (F.col("has_any") > 0))
    named = got.join(checked(need), "label").where(ok).groupBy("aid").agg(F.array_sort(F.collect_list(F.struct("ordinal", "label"))).alias("e"))
    return named.select("aid", F.transform("e", lambda x: x.label).alias("engines"))


def declarations(inventory: DataFrame, rules: DataFrame, most: int = 20) -> DataFrame:
    """Build files by label: how many there are, and the first `most`."""
    each = rule_hits(inventory, rules).select("aid", "label", "path").distinct()
    count = each.groupBy("aid", "label").agg(F.count("path").alias("files"))
    first = first_rows(each, ["aid", "label"], ["path"], most).groupBy("aid", "label").agg(F.sort_array(F.collect_list("path")).alias("paths"))
    return count.join(first, ["aid", "label"])


def lfs_routed(inventory: DataFrame, attributes: DataFrame) -> DataFrame:
    """Files that attribute lines (aid, dir, pattern) route to large-file storage: a pattern reaches what lies under its
    folder; with a slash it is anchored there, else it names a basename."""
    anchored = F.contains("pattern", F.lit("/"))
    a = attributes.select("aid", "dir", anchored.alias("__anchored"), F.regexp_replace("pattern", "^/", "").alias("__glob")).distinct()
    folders = F.split(F.regexp_replace("path", "/?[^/]*$", ""), "/")
    above = F.array_distinct(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(folders)), lambda n: F.array_join(F.slice(folders, 1, n), "/"))))
    x = inventory.select("aid", "path", F.explode(above).alias("dir")).join(a.select("aid", "dir").distinct(), ["aid", "dir"], "left_semi")
    below = F.when(F.col("dir") == "", F.col("path")).otherwise(F.expr("substring(path, length(dir) + 2)"))
    whole = fitting(x, a.where("__anchored"), ["aid", "dir"], below, "__glob")
    return whole.unionByName(fitting(x, a.where("not __anchored"), ["aid", "dir"], F.substring_index("path", "/", -1), "__glob")).select("aid", "path").distinct()


def changed_since(listing: DataFrame, moment: Column) -> DataFrame:
    """Artifacts whose newest file was changed at a moment or later."""
    return listing.groupBy("aid").agg(F.max("modified").alias("newest")).where(F.col("newest") >= moment)


def listed(dimension: DataFrame, *columns: str) -> Column:
    """A small table as one array column, its rows counted first; rows then meet all of it without a join."""
    rows = dimension.toDF(*columns) if columns else dimension
    got = rows.limit(DIMENSION_ROWS + 1).collect()
    if len(got) > DIMENSION_ROWS:
        raise ValueError(f"a dimension has over {DIMENSION_ROWS} rows")
    kinds = {f.name: f.dataType for f in rows.schema}
    one = lambda r: [F.lit(r[c]).cast(t).alias(c) for c, t in kinds.items()]
    made = [F.struct(*one(r)) if len(kinds) > 1 else one(r)[0] for r in got]
    return F.array(*made) if made else F.array().cast(f"array<{rows.schema.simpleString()}>" if len(kinds) > 1 else f"array<{rows.schema[0].dataType.simpleString()}>")


def runnable(models: DataFrame, machines: DataFrame) -> DataFrame:
    """Each model on each machine of a small table: an error under its need of memory, a warning under 1.3 times."""
    x = models.withColumn("m", F.explode(listed(machines.select("machine", "ram_bytes")))).select("aid", "need", "m.*")
    verdict = F.when(F.col("need").isNull(), "unknown").when(F.col("ram_bytes") < F.col("need"), "error").when(F.col("ram_bytes") < F.col("need") * 1.3, "warning").otherwise("ok")
    return x.select("aid", "machine", verdict.alias("verdict"))


def preflight(models: DataFrame, machines: DataFrame, architectures: DataFrame) -> DataFrame:
    """Issues (level, code), in this order, of running each model (aid, engine, architecture, need) on each machine (machine,
    ram_bytes) of a small table: an architecture with none of the engine's endings is an error, an unknown one a warning; memory
    under the need is an error, under 1.3 times a warning. Engines that take any architecture ask for none."""
    ends = F.expr("exists(endings, e -> endswith(architecture, e))")
    x = models.join(checked(architectures), "engine", "left").withColumn("m", F.explode(listed(machines.select("machine", "ram_bytes"))))
    x = x.select("aid", "engine", "architecture", "need", "endings", "m.*")
    issue = lambda level, code: F.struct(F.lit(level).alias("level"), F.lit(code).alias("code"))
    shape = F.when(F.col("endings").isNull() | ends, F.lit(None)).when(F.col("architecture").isNull(), issue("warning", "unknown-architecture")).otherwise(issue("error", "unsupported-architecture"))
    memory = F.when(F.col("ram_bytes") < F.col("need"), issue("error", "insufficient-ram")).when(F.col("ram_bytes") < F.col("need") * 1.3, issue("warning", "tight-ram"))
    return x.select("aid", "engine", "machine", F.array_compact(F.array(shape, memory)).alias("issues"))


def weights_choice(groups: DataFrame) -> DataFrame:
    """The one runnable weight file of each artifact: refused while any group is incomplete, ambiguous with several."""
    ok = F.col("complete") & ~F.col("projector")
    x = groups.groupBy("aid").agg(F.bool_or(~F.col("complete")).alias("broken"), F.count_if(ok).alias("n"), F.sort_array(F.collect_set(F.when(ok, F.col("variant")))).alias("candidates"))
    outcome = F.when(F.col("broken"), "refused").when(F.col("n") == 1, "chosen").when(F.col("n") == 0, "none").otherwise("ambiguous")
    return x.select("aid", outcome.alias("outcome"), F.when((F.col("n") == 1) & ~F.col("broken"), F.get("candidates", 0)).alias("chosen"), "candidates")
