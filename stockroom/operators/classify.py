"""Which weight files of an artifact must be kept, by rules over sets of files.

Sets come first (indexed shards, loose files of a folder, level-named groups, legacy files, support); then evidence as
columns of a set; then the rules, one cascade in a fixed order; then patterns that select what is kept. All artifacts
are judged in one job. A group-level file that an index claims stays in its group alone.

Scale: whatever is joined, grouped or ordered here is so within an artifact. With `by_artifact` tables that lie by artifact once
stay so: joins on artifact and path, folder or digest, the groups and the windows need no further shuffle. What is left
out stands on names, indexes and digests (`skipped`); a keep list asks for no more, and is made set by set.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stockroom.operators.enrich import FULL_FIDELITY
from stockroom.operators.files import basename, is_sidecar
from stockroom.operators.globs import glob_column
from stockroom.operators.weights import SHARD

#: Suffixes of weights, and stored types by the names that configurations give them. Fixed values.
WEIGHT = r"\.(safetensors|bin|gguf|pt|pth)$"
STORED = {"float64": "F64", "float32": "F32", "float16": "F16", "bfloat16": "BF16"}
#: Header keys that claim a source, and the prefix of those that tell of importance data. Fixed values.
SOURCE_KEYS = ("general.source.url", "general.source.huggingface.repository")
IMPORTANCE = "quantize.imatrix."
#: Rules whose sets may be what a level-named group was made from.
CANDIDATES = ("R2", "R3", "R4", "R6", "R12", "R13")
NUMBERED = r"^(.+-)\d+(-of-\d+\.\w+)$"
SET = ["aid", "kind", "set"]


def by_artifact(spark: SparkSession) -> None:
    """Lets joins of this session take tables that are dealt by some of the join's columns; Spark else deals them again by all."""
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")


def folder(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def joined(at: Column, name: Column) -> Column:
    return F.when(at == "", name).otherwise(F.concat(at, F.lit("/"), name))


def weight_map(text: Column) -> Column:
    return F.from_json(F.get_json_object(text, "$.weight_map"), "map<string,string>")


def index_members(indexes: DataFrame) -> DataFrame:
    """Files that each readable index (aid, path, text) claims, in its own folder; the first index by path wins."""
    x = indexes.select("aid", F.col("path").alias("index"), F.explode(F.array_distinct(F.map_values(weight_map(F.col("text"))))).alias("name"))
    return x.where(~F.contains("name", F.lit("/"))).select("aid", "index", joined(folder(F.col("index")), F.col("name")).alias("path")).groupBy("aid", "path").agg(F.min("index").alias("index"))


def file_sets(files: DataFrame, indexes: DataFrame, hashed: bool = False) -> DataFrame:
    """Files with the set they belong to: kind, format, and the set's name within the artifact.

    An unreadable index taints the loose tensor files of its own folder; a readable one that names tensor files makes
    those of its folder that it doesn't claim orphans. With `hashed`, what indexes say is hashed in its task, so that files
    needn't be ordered to meet it."""
    low, dir_ = F.lower("path"), folder(F.col("path"))
    named = F.exists(F.map_values("map"), lambda n: F.lower(n).endswith(".safetensors"))
    state = indexes.select("aid", folder(F.col("path")).alias("dir"), weight_map(F.col("text")).alias("map"))
    state = state.select("aid", "dir", F.col("map").isNotNull().alias("ok"), F.coalesce(named, F.lit(False)).alias("named"))
    state = state.groupBy("aid", "dir").agg(F.bool_and("ok").alias("all_ok"), F.bool_or("named").alias("some_named"))
    side = (lambda table: table.hint("shuffle_hash")) if hashed else lambda table: table
    x = files.withColumn("dir", dir_).join(side(index_members(indexes)), ["aid", "path"], "left").join(side(state), ["aid", "dir"], "left")
    form = F.when(low.endswith(".safetensors"), "safetensors").when(low.endswith(".gguf"), "gguf").when(low.rlike(WEIGHT), "legacy").otherwise("support")
    kind = (
        F.when(form.isin("gguf", "support"), form)
        .when(F.col("index").isNotNull(), "indexed")
        .when(form == "legacy", "legacy")
        .when(~F.col("all_ok"), "index_error")
        .when(F.col("some_named"), "orphan")
        .otherwise("standalone")
    )
    group = F.when(F.col("path").rlike(SHARD), F.regexp_extract("path", SHARD, 1)).otherwise(F.col("path"))
    name = F.when(kind == "gguf", group).when(kind == "indexed", F.col("index")).when(kind == "support", "").otherwise(F.col("dir"))
    return x.select(*files.columns, form.alias("format"), kind.alias("kind"), name.alias("set"))


def base_identical(sets: DataFrame, base: DataFrame) -> DataFrame:
    """Sets each of whose files has a digest that the base repository holds (sets: aid, set, base, sha256)."""
    b = base.select(F.col("aid").alias("base"), "sha256", F.lit(True).alias("held")).distinct()
    x = sets.join(b, ["base", "sha256"], "left")
    return x.groupBy(*SET).agg((F.bool_and(F.col("sha256").isNotNull()) & F.bool_and(F.coalesce("held", F.lit(False)))).alias("base_identical"))


def header_facts(headers: DataFrame) -> DataFrame:
    """What the header of each file (aid, path, key, value, error) tells: read, importance data, split numbers, claims."""
    value = lambda key: F.max(F.when(F.col("key") == key, F.col("value")))
    return headers.groupBy("aid", "path").agg(
        F.bool_and(F.col("error").isNull()).alias("read"),
        F.coalesce(F.bool_or(F.startswith("key", F.lit(IMPORTANCE))), F.lit(False)).alias("importance"),
        value("split.count").cast("int").alias("split_count"),
        value("split.no").cast("int").alias("split_no"),
        F.collect_set(F.when(F.col("key").isin(*SOURCE_KEYS), F.lower("value"))).alias("claims"),
    )


def known_digests() -> Column:
    """The digests of a set's files, null unless all are known."""
    return F.when(F.count("sha256") == F.count("*"), F.sort_array(F.collect_list("sha256")))


def evidence(members: DataFrame, configs: DataFrame, types: DataFrame, headers: DataFrame, base: DataFrame, locators: DataFrame) -> DataFrame:
    """One row for each set of `file_sets` with what the rules ask of it.

    `configs`: aid, dir, text; `types`: aid, path, dtype, n from tensor headers; `headers`: as `header_facts` takes;
    `base`: aid, sha256 of the files of the repository that an artifact names as its base; `locators`: aid, locator.
    The stored type is that of most parameters in the headers, ties to the smaller name, else the configuration's."""
    x = members.withColumn("dir", folder(F.col("path")))
    text, method = F.col("text"), F.get_json_object("text", "$.quantization_config.quant_method")
    quantized = F.get_json_object("text", "$.quantization_config").isNotNull()
    stated = F.coalesce(F.get_json_object("text", "$.torch_dtype"), F.get_json_object("text", "$.dtype"))
    known = F.create_map(*(F.lit(v) for kv in STORED.items() for v in kv))
    settings = configs.select(
        "aid",
        "dir",
        (F.try_parse_json(text).isNull() | ~F.trim(text).startswith("{")).alias("config_unreadable"),
        F.when(quantized, F.coalesce(method, F.lit("unspecified"))).when(F.get_json_object("text", "$.quantization").startswith("{"), "mlx").alias("quant_method"),
        F.coalesce(known[F.lower(stated)], F.upper(stated)).alias("stated"),
    )
    most = x.join(types, ["aid", "path"]).groupBy(*SET, "dtype").agg(F.sum("n").alias("n")).groupBy(*SET).agg(F.min(F.struct(-F.col("n"), "dtype")).dtype.alias("counted"))
    facts, number, of = header_facts(headers), F.regexp_extract("path", SHARD, 2).cast("int"), F.regexp_extract("path", SHARD, 3).cast("int")
    x = x.join(facts, ["aid", "path"], "left").join(locators, "aid", "left")
    x = x.join(base.select("aid", "sha256", F.lit(True).alias("held")).distinct(), ["aid", "sha256"], "left")
    foreign = F.exists("claims", lambda c: ~F.contains(c, F.lower("locator")))
    numbers = F.sort_array(F.collect_list(F.coalesce(F.when(F.col("path").rlike(SHARD), number), F.lit(1))))
    total = F.max(F.coalesce(F.when(F.col("path").rlike(SHARD), of), F.lit(1)))
    rows = x.groupBy(*SET).agg(
        F.min_by("format", "path").alias("format"),
        F.min("dir").alias("dir"),
        F.min("path").alias("first_path"),
        F.count("*").alias("files"),
        F.sum(F.coalesce("size", F.lit(0))).alias("bytes"),
        known_digests().alias("digests"),
        (F.bool_and(F.col("sha256").isNotNull()) & F.bool_and(F.coalesce("held", F.lit(False)))).alias("base_identical"),
        (numbers == F.sequence(F.lit(1), F.greatest(total, F.lit(1)))).alias("complete"),
        F.bool_and(F.coalesce("read", F.lit(False))).alias("header_read"),
        (F.bool_or(F.col("split_count").isNotNull()) & (F.count("*") > 1) & F.bool_or(F.col("split_count").isNotNull() & F.coalesce(F.col("split_no") != number - 1, F.lit(False)))).alias("misnumbered"),
        (F.count("*") > 1).alias("several"),
        F.min("split_count").alias("least_count"),
        F.max("split_count").alias("most_count"),
        F.bool_or(F.coalesce("importance", F.lit(False))).alias("imatrix"),
        F.bool_or(F.coalesce(foreign, F.lit(False))).alias("foreign_source"),
    )
    miscounted = F.col("several") & ((F.col("least_count") != F.col("files")) | (F.col("most_count") != F.col("files")))
    rows = rows.withColumn("headers_disagree", F.coalesce(miscounted, F.lit(False)) | F.col("misnumbered")).drop("misnumbered", "several", "least_count", "most_count")
    rows = rows.join(settings, ["aid", "dir"], "left").join(most, SET, "left")
    return rows.withColumn("dtype", F.coalesce("counted", "stated")).drop("counted", "stated")


def with_twins(sets: DataFrame) -> DataFrame:
    """Sets with `twin_of`: the keeper of the exact twins they belong to, null for the keeper and for sets without one.

    Only tensor and legacy sets have twins: a set whose digests aren't all known has none, and a level-named group is
    never taken for a copy. A set at the root is kept before others, then the least deep, ties by folder, then file."""
    twinned = ~F.col("kind").isin("support", "gguf") & F.col("digests").isNotNull() & ~F.exists("digests", lambda d: d.isNull())
    known = F.when(twinned, F.sha2(F.array_join(F.sort_array("digests"), ","), 256))
    dir_ = folder(F.col("first_path"))
    depth = F.when(dir_ == "", -1).otherwise(F.length(dir_) - F.length(F.replace(dir_, F.lit("/"), F.lit(""))))
    # sets without known digests are each alone
    key = F.coalesce(known, F.concat_ws("|", "kind", "set"))
    w = Window.partitionBy("aid", key).orderBy(depth, dir_, "first_path")
    return sets.withColumn("twin_of", F.when(known.isNotNull() & (F.row_number().over(w) > 1), F.first("set").over(w)))


def is_skipped() -> Column:
    """Whether a set of `with_twins` is left out: rule R15, which stands before all others but R1 and is the only one to skip."""
    return (F.col("kind") != "support") & F.col("twin_of").isNotNull()


def skipped(files: DataFrame, indexes: DataFrame) -> DataFrame:
    """Sets with their paths and `skip`, as in `classified`: names, indexes and digests decide on twins, so nothing else is asked."""
    of = [F.min("path").alias("first_path"), F.collect_list("path").alias("paths"), F.count("*").alias("files"), known_digests().alias("digests")]
    sets = with_twins(file_sets(files, indexes, hashed=True).groupBy(*SET).agg(*of))
    return sets.select(*SET, "files", "paths", is_skipped().alias("skip"))


def judged(sets: DataFrame) -> DataFrame:
    """Sets with verdict and rule: the first rule that applies, in a fixed order.

    Evidence columns of a set: kind, format, base_identical, config_unreadable, dtype, quant_method, complete,
    header_read, headers_disagree, imatrix, foreign_source, twin_of. Tensor and legacy sets are judged first; how many
    of an artifact may be a conversion source, and how many are unknown, then decides on its level-named groups."""
    w = Window.partitionBy("aid")
    flag = lambda name: F.coalesce(F.col(name), F.lit(False))
    tensors, legacy, group = F.col("format") == "safetensors", F.col("format") == "legacy", F.col("kind") == "gguf"
    full = F.col("dtype").isin(*FULL_FIDELITY)
    own = (
        F.when(F.col("kind") == "support", "R1")
        .when(is_skipped(), "R15")
        .when(~group & flag("base_identical"), "R2")
        .when(tensors & ((F.col("kind") == "index_error") | flag("config_unreadable")), "R14")
        .when(tensors & (F.col("quant_method").isNotNull() | ~full), "R5")
        .when(tensors & F.col("dtype").isNull(), "R14")
        .when(tensors & (F.col("kind") == "orphan"), "R6")
        .when(tensors & (F.col("kind") == "indexed"), "R3")
        .when(tensors, "R4")
        .when(legacy & F.max(tensors).over(w), "R12")
        .when(legacy, "R13")
    )
    counted = sets.withColumn("own", own)
    counted = counted.withColumn("established", F.sum(F.col("own").isin(*CANDIDATES).cast("int")).over(w)).withColumn("uncertain", F.sum((F.col("own") == "R14").cast("int")).over(w))
    rule = (
        F.when(F.col("own").isNotNull(), F.col("own"))
        .when(~flag("complete") | ~flag("header_read") | flag("headers_disagree"), "R14")
        .when(flag("imatrix"), "R7")
        .when(flag("foreign_source"), "R8")
        .when(F.coalesce("uncertain", F.lit(0)) > 0, "R11")
        .when(F.coalesce("established", F.lit(0)) == 0, "R10")
        .when(F.col("established") == 1, "R9")
        .otherwise("R11")
    )
    verdict = F.when(F.col("rule") == "R1", "support").when(F.col("rule").isin("R2", "R15"), "print").when(F.col("rule").isin("R3", "R4", "R5", "R7", "R10", "R13"), "negative").otherwise("unknown")
    return counted.withColumn("rule", rule).withColumn("verdict", verdict).withColumn("skip", is_skipped()).drop("own", "established", "uncertain")


def classified(files: DataFrame, indexes: DataFrame, configs: DataFrame, types: DataFrame, headers: DataFrame, base: DataFrame, locators: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files with the kind, set, rule, verdict and skip of their set; the judged sets)."""
    members = file_sets(files, indexes)
    sets = judged(with_twins(evidence(members, configs, types, headers, base, locators)))
    return members.join(sets.select(*SET, "rule", "verdict", "skip"), SET), sets


def verdict_totals(sets: DataFrame) -> DataFrame:
    """Sets and bytes of each verdict, and what is kept and skipped."""
    kinds = ("negative", "print", "unknown", "support")
    of = lambda v: F.col("verdict") == v
    return sets.groupBy("aid").agg(
        *(F.count_if(of(v)).alias(f"{v}_sets") for v in kinds),
        *(F.coalesce(F.sum(F.when(of(v), F.col("bytes"))), F.lit(0)).alias(f"{v}_bytes") for v in kinds),
        F.coalesce(F.sum(F.when(~F.col("skip"), F.col("bytes"))), F.lit(0)).alias("kept_bytes"),
        F.coalesce(F.sum(F.when(F.col("skip"), F.col("bytes"))), F.lit(0)).alias("skipped_bytes"),
    )


def literal(path: Column) -> Column:
    """A path as a pattern anchored to the root, its special characters in brackets."""
    return F.concat(F.lit("/"), F.regexp_replace(path, r"([*?\[])", r"[$1]"))


def set_pattern(paths: Column, files: Column) -> Column:
    """The pattern of a weight set: its one path, or that of its numbered shards, else null."""
    shape = lambda p: F.when(basename(p).rlike(NUMBERED), joined(folder(p), F.concat(F.regexp_extract(basename(p), NUMBERED, 1), F.lit("*"), F.regexp_extract(basename(p), NUMBERED, 2))))
    shapes = F.array_distinct(F.transform(paths, shape))
    return F.when(files == 1, F.get(paths, F.lit(0))).when((F.size(paths) == files) & (F.size(shapes) == 1), F.get(shapes, F.lit(0)))


def keep_list(files: DataFrame) -> DataFrame:
    """`kept_patterns` of files (aid, path, kind, set, skip)."""
    return kept_patterns(files.groupBy(*SET, "skip").agg(F.collect_list("path").alias("paths"), F.count("*").alias("files")))


def kept_patterns(sets: DataFrame) -> DataFrame:
    """Patterns that select exactly the kept files of each artifact, from its sets (aid, kind, set, skip, files, paths), found by replay.

    Tried in turn: a pattern for each kept weight set, which also fits base names; the same anchored to the root; every
    kept path. Support files that don't ride along anyway are listed in each. Where nothing is skipped `include` is
    null; where nothing would be left, or no attempt selects just what is kept, it is null with a note.
    Only artifacts with something skipped and something left are replayed. A plain pattern is the path of a file, so files
    of one name tell each other which of them it fits; only patterns of shards are matched one by one within an artifact."""
    weight, path, artifact = F.col("kind") != "support", F.col("path"), Window.partitionBy("aid")
    mine = ~F.col("skip") & weight
    x = sets.select("aid", "skip", "paths", weight.alias("weight"), mine.alias("mine"), F.when(mine, set_pattern(F.col("paths"), F.col("files"))).alias("pattern"))
    weight, mine = F.col("weight"), F.col("mine")
    x = x.withColumn("wild", F.col("pattern").rlike(r"[*?\[]"))
    x = x.withColumns({"open": F.max("skip").over(artifact) & F.max("mine").over(artifact), "globs": F.collect_set(F.when(F.col("wild"), glob_column(F.col("pattern")))).over(artifact)})
    x = x.select("*", F.explode_outer(F.when(F.col("open"), F.col("paths"))).alias("path")).drop("paths")
    flag = lambda c: F.coalesce(c, F.lit(False))
    fits = lambda text: flag(F.when(weight & (F.size("globs") > 0), F.exists("globs", lambda g: F.rlike(text, g))))
    x = x.withColumns({"name": basename(path), "sidecar": flag(is_sidecar(path)), "plain": mine & ~F.col("wild") & (F.col("pattern") == path)})
    x = x.withColumns({"fits_path": fits(path), "fits_name": fits(F.col("name")), "literal": literal(path)}).drop("globs")
    named = Window.partitionBy("aid", "name").orderBy("path")
    same, every = named.rangeBetween(Window.currentRow, Window.currentRow), named.rangeBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    anchored = F.col("fits_path") | flag(F.max("plain").over(same))
    loose = F.col("fits_name") | flag(F.max(F.col("plain") & (path == F.col("name"))).over(every))
    x = x.withColumns({"anchored": anchored, "loose": anchored | loose})
    replayed = lambda column: F.bool_and((~weight | F.col("sidecar") | F.col(column)) == ~F.col("skip"))
    out = x.groupBy("aid").agg(
        F.bool_or("skip").alias("some"),
        F.bool_or("mine").alias("left"),
        replayed("loose").alias("loose"),
        replayed("anchored").alias("anchored"),
        F.bool_and(~(F.col("skip") & F.col("sidecar"))).alias("by_path"),
        F.collect_set(F.when(~weight & ~F.col("sidecar"), F.col("literal"))).alias("support"),
        F.sort_array(F.collect_set(F.when(~F.col("skip"), F.col("literal")))).alias("paths"),
        F.coalesce(F.bool_and(F.when(mine, F.col("pattern").isNotNull())), F.lit(False)).alias("all"),
        F.collect_set(F.when(F.col("open"), F.col("pattern"))).alias("globs"),
    )
    all_ = F.col("all")
    with_support = lambda globs: F.sort_array(F.array_union(globs, F.col("support")))
    open_ = F.col("some") & F.col("left")
    include = (
        F.when(~open_, F.lit(None))
        .when(all_ & F.col("loose"), with_support(F.col("globs")))
        .when(all_ & F.col("anchored"), with_support(F.transform("globs", lambda g: F.concat(F.lit("/"), g))))
        .when(F.col("by_path"), F.col("paths"))
    )
    note = F.when(F.col("some") & ~F.col("left"), "nothing would be left").when(open_ & include.isNull(), "no pattern selects just this")
    by_path = F.when(include.isNotNull(), ~(all_ & (F.col("loose") | F.col("anchored"))))
    return out.select("aid", include.alias("include"), by_path.alias("explicit_paths"), note.alias("note"))
