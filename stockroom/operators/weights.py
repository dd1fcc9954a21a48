"""Weight files: shard groups, single-model sizes, levels and starting selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stockroom.operators.ranks import by_size

SHARD = r"^(.*)-(\d{5})-of-(\d{5})\.gguf$"
#: Bytes for each element of a stored type. Fixed values.
WIDTHS = {"F64": 8, "I64": 8, "F32": 4, "I32": 4, "F16": 2, "BF16": 2, "I16": 2, "F8_E4M3": 1, "F8_E5M2": 1, "I8": 1, "U8": 1, "BOOL": 1}


def gguf_groups(files: DataFrame) -> DataFrame:
    """Shard groups by prefix: complete if the numbers are exactly 1 to the total, each once; an unknown size makes the
    group's unknown; a file without shard numbers is a group of its own. Projectors are marked."""
    p = F.col("path")
    sharded = p.rlike(SHARD)
    rows = files.where(F.lower(p).endswith(".gguf")).select(
        "aid",
        F.when(sharded, F.regexp_extract(p, SHARD, 1)).otherwise(p).alias("variant"),
        F.when(sharded, F.regexp_extract(p, SHARD, 2).cast("int")).otherwise(1).alias("shard"),
        F.when(sharded, F.regexp_extract(p, SHARD, 3).cast("int")).otherwise(1).alias("of"),
        "size",
    )
    numbers = F.sort_array(F.collect_list("shard"))
    return rows.groupBy("aid", "variant", "of").agg(
        F.count("*").alias("files"),
        (numbers == F.sequence(F.lit(1), F.greatest(F.max("of"), F.lit(1)))).alias("complete"),
        F.when(F.bool_or(F.col("size").isNull()), F.lit(None)).otherwise(F.sum("size")).alias("bytes"),
        F.bool_or(F.substring_index(F.lower("variant"), "/", -1).contains("mmproj")).alias("projector"),
    )


def publication(files: DataFrame) -> DataFrame:
    """Variants and companions of each artifact; totals are unknown if any size is."""
    g = gguf_groups(files)
    total = lambda c: F.when(F.bool_or(c & F.col("bytes").isNull()), F.lit(None)).otherwise(F.coalesce(F.sum(F.when(c, F.col("bytes"))), F.lit(0)))
    mine, other = ~F.col("projector"), F.col("projector")
    return g.groupBy("aid").agg(F.count_if(mine).alias("variants"), F.count_if(other).alias("companions"), total(mine).alias("variant_bytes"), total(other).alias("companion_bytes"))


def model_bytes(files: DataFrame) -> DataFrame:
    """Bytes of the one model that an artifact holds, else null: of weights in one format the only complete group, or
    else all of one directory and suffix with known sizes."""
    low = F.lower("path")
    w = files.where(low.rlike(r"\.(gguf|safetensors|bin|pt|pth)$")).withColumn("ext", F.regexp_extract(low, r"\.([a-z]+)$", 1))
    w = w.withColumn("dir", F.regexp_extract("path", r"^(.*)/[^/]*$", 1))
    shape = w.groupBy("aid").agg(
        F.bool_and(F.col("ext") == "gguf").alias("gguf"),
        F.bool_or(F.col("ext") == "gguf").alias("some_gguf"),
        (F.count_distinct("dir", "ext") == 1).alias("one"),
        F.when(~F.bool_or(F.col("size").isNull()), F.sum("size")).alias("total"),
    )
    groups = gguf_groups(files).where("not projector and complete").groupBy("aid").agg(F.count("*").alias("n"), F.max("bytes").alias("only"))
    value = F.when(F.col("gguf"), F.when(F.col("n") == 1, F.col("only"))).when(~F.col("some_gguf") & F.col("one"), F.col("total"))
    return shape.join(groups, "aid", "left").select("aid", value.cast("long").alias("model_bytes"))


def gguf_level(path: Column) -> Column:
    """The quantization level that a file name states, upper case, or null."""
    found = F.upper(F.regexp_extract(F.substring_index(path, "/", -1), r"(?i)(?:^|[-_.])((?:i?q[1-8](?:_[0-9a-z]+)*)|tq[12]_0|bf16|f16|f32|mxfp4)(?=[-_.]|$)", 1))
    return F.when(found != "", found)


def level_bits(level: Column) -> Column:
    """Bits of a quantized level; null for floating-point ones."""
    found = F.regexp_extract(level, r"^(?:I|T)?Q(\d)", 1)
    return F.when(level == "MXFP4", 4).when(found != "", found.cast("int"))


def level_family(bits: Column) -> Column:
    return F.when(bits <= 3, "compact").when(bits <= 5, "middle").when(bits.isNotNull(), "wide")


def starting_selection(variants: DataFrame, bits: tuple[int, ...] = (4,)) -> DataFrame:
    """The smallest complete variant of known size at each wanted width, ties by name; none where there is none."""
    at = level_bits(gguf_level(F.concat("variant", F.lit(".gguf"))))
    ok = variants.withColumn("bits", at).where("complete and not projector and bytes is not null").where(F.col("bits").isin(*bits))
    return ok.groupBy("aid", "bits").agg(F.min(F.struct("bytes", "variant")).alias("best")).select("aid", "bits", "best.variant", "best.bytes")


def expected_bytes(dtypes: DataFrame) -> DataFrame:
    """Weight bytes that counts by stored type imply; a type without a known width makes the total unknown."""
    width = F.create_map(*(F.lit(x) for kv in WIDTHS.items() for x in kv))[F.col("dtype")]
    return dtypes.groupBy("aid").agg(F.when(F.count_if(width.isNull()) == 0, F.sum(F.col("n") * width)).cast("long").alias("expected_bytes"))


def parameter_counts(tensors: DataFrame) -> DataFrame:
    """Parameters, tensors and files by stored type; one unreadable header makes the artifact unknown (no rows)."""
    n = F.aggregate("shape", F.lit(1).cast("long"), lambda a, x: a * x)
    x = tensors.select("aid", "dtype", "path", n.alias("n"), F.col("error").isNotNull().alias("bad"))
    x = by_size(x, "aid").groupBy("aid", "dtype", "path").agg(F.sum("n").alias("n"), F.count("*").alias("tensors"), F.bool_or("bad").alias("bad"))
    x = x.groupBy("aid", "dtype").agg(F.sum("n").alias("parameters"), F.sum("tensors").alias("tensors"), F.count("path").alias("files"), F.bool_or("bad").alias("bad"))
    unknown = F.bool_or("bad").over(Window.partitionBy("aid"))
    return x.withColumn("bad", unknown).where("not bad").drop("bad")


def imatrix_marks(variants: DataFrame, headers: DataFrame) -> DataFrame:
    """True if any header of a variant has importance data, false if all were read and none has, null if any wasn't read."""
    x = variants.select("aid", "variant", F.explode("paths").alias("path")).join(headers, ["aid", "path"], "left")
    mark = F.when(F.bool_or("imatrix"), True).when(F.bool_or(F.col("imatrix").isNull()), F.lit(None).cast("boolean")).otherwise(False)
    return x.groupBy("aid", "variant").agg(mark.alias("imatrix"))


def bytes_per_parameter(total: Column, parameters: Column) -> Column:
    """To three digits, null unless both are positive."""
    return F.when((total > 0) & (parameters > 0), F.bround(total / parameters, 3))


def context_bytes(full: Column, sliding: Column, window: Column, heads: Column, dim: Column, values: Column, width: Column, tokens: Column) -> Column:
    """Cache bytes of a context: full layers hold every token, sliding ones at most their window."""
    return (full * tokens + sliding * F.least(tokens, F.coalesce(window, tokens))) * heads * dim * values * width


def minimum_ram_gib(model_bytes: Column) -> Column:
    return F.bround(model_bytes * 1.2 / 1024**3, 1)
