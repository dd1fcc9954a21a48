"""Facts about an artifact that its records, configuration texts and names state.

JSON texts are parsed with fixed partial schemas; what is absent or unreadable is null, never guessed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stockroom.operators.ranks import first_rows
from stockroom.operators.rules import checked
from stockroom.operators.weights import gguf_level

CONFIG = (
    "architectures array<string>, model_type string, torch_dtype string, dtype string, max_position_embeddings long, hidden_size long, num_hidden_layers long, num_attention_heads long,"
    " num_key_value_heads long, head_dim long, kv_lora_rank long, qk_rope_head_dim long, sliding_window long, use_sliding_window boolean, layer_types array<string>, sliding_window_pattern long,"
    " vocab_size long, quantization_config struct<quant_method:string,bits:int,load_in_4bit:boolean,load_in_8bit:boolean>"
)
TOKENIZER = "tokenizer_class string, chat_template string, bos_token string, eos_token string, pad_token string, unk_token string, sep_token string, cls_token string, mask_token string"
SPECIAL_TOKENS = ("bos", "eos", "pad", "unk", "sep", "cls", "mask")
#: Defaults of generation that a record keeps. Fixed values.
GENERATION = ("temperature", "top_p", "top_k", "do_sample", "repetition_penalty", "max_new_tokens")
FORMAT_TAGS = ("safetensors", "gguf", "onnx", "mlx", "awq", "gptq")
FULL_FIDELITY = ("F64", "F32", "F16", "BF16")
PHASES = ("offline", "retrying", "verifying", "stalled", "starting", "downloading")


def config(text: Column) -> Column:
    """The configuration as a struct, null where the text is no JSON object."""
    return F.when(F.try_parse_json(text).isNotNull() & F.trim(text).startswith("{"), F.from_json(text, CONFIG))


def release_precision(levels: Column, settings: Column, dominant: Column) -> Column:
    """(precision, read_from): the one level of a release of level-named files, else the stated method, else the stored type."""
    method, bits = settings.quantization_config.quant_method, settings.quantization_config.bits
    stated = F.coalesce(settings.torch_dtype, settings.dtype)
    of = lambda value, source: F.struct(value.alias("precision"), F.lit(source).alias("read_from"))
    return (
        F.when(F.size(levels) == 1, of(F.get(levels, 0), "file names"))
        .when(method.isNotNull(), of(F.concat_ws("-", method, bits.cast("string")), "quantization_config"))
        .when(dominant.isNotNull(), of(dominant, "stored types"))
        .when(stated.isNotNull(), of(stated, "config"))
    )


def levels_of(files: DataFrame) -> DataFrame:
    """Distinct levels that an artifact's file names state."""
    return files.groupBy("aid").agg(F.sort_array(F.collect_set(gguf_level(F.col("path")))).alias("levels"))


def attention_shape(c: Column) -> Column:
    """Kind of attention, full and sliding layers, heads, width and values of a cached token; null where layers or heads aren't stated."""
    layers, heads = c.num_hidden_layers, c.num_attention_heads
    kv = F.coalesce(c.num_key_value_heads, heads)
    latent = c.kv_lora_rank.isNotNull()
    kind = F.when(latent, "mla").when(kv == 1, "mqa").when(kv < heads, "gqa").otherwise("mha")
    listed = F.size(F.filter(c.layer_types, lambda t: t == "sliding_attention"))
    recurrent = F.size(F.filter(c.layer_types, lambda t: t.contains("linear") | t.contains("recurrent") | t.contains("mamba")))
    every = F.when(c.sliding_window_pattern > 0, layers - F.floor(layers / c.sliding_window_pattern))
    slides = c.sliding_window.isNotNull() & F.coalesce(c.use_sliding_window, F.lit(True))
    sliding = F.when(c.layer_types.isNotNull(), listed).when(slides & every.isNotNull(), every).when(slides, layers).otherwise(0).cast("long")
    recurrent = F.when(c.layer_types.isNotNull(), recurrent).otherwise(0).cast("long")
    dim = F.when(latent, c.kv_lora_rank + F.coalesce(c.qk_rope_head_dim, F.lit(0))).otherwise(F.coalesce(c.head_dim, F.floor(c.hidden_size / heads)))
    shape = F.struct(
        kind.alias("kind"),
        (layers - sliding - recurrent).alias("full_layers"),
        sliding.alias("sliding_layers"),
        F.when(sliding > 0, c.sliding_window).alias("sliding_window"),
        recurrent.alias("recurrent_layers"),
        F.when(latent, 1).otherwise(kv).cast("long").alias("kv_heads"),
        dim.alias("head_dim"),
        F.when(latent, 1).otherwise(2).cast("long").alias("values"),
    )
    return F.when(layers.isNotNull() & heads.isNotNull() & dim.isNotNull(), shape)


def model_record(files: DataFrame) -> DataFrame:
    """One record for each artifact from its configuration and tokenizer texts (aid, name, text) and, named `card`, what its
    card states as JSON. Languages are a list, also where the card states one as a word."""
    text = lambda name: F.max(F.when(F.col("name") == name, F.col("text")))
    x = files.groupBy("aid").agg(text("config.json").alias("c"), text("tokenizer_config.json").alias("t"), text("generation_config.json").alias("g"), text("card").alias("card"), F.bool_or(F.col("name").startswith("chat_template.")).alias("template"))
    x = x.withColumn("c", config(F.col("c"))).withColumn("t", F.from_json("t", TOKENIZER))
    tokens = F.array_compact(F.array(*(F.when(F.col(f"t.{k}_token").isNotNull(), F.lit(k)) for k in SPECIAL_TOKENS)))
    spoken = F.get_json_object("card", "$.language")
    languages = F.when(spoken.startswith("["), F.from_json(spoken, "array<string>")).when(spoken != "", F.array(spoken))
    kept = F.array_compact(F.array(*(F.when(F.get_json_object("g", f"$.{k}").isNotNull(), F.lit(k)) for k in GENERATION)))
    return x.select(
        "aid",
        F.get("c.architectures", 0).alias("architecture"),
        F.col("c.model_type").alias("model_type"),
        F.col("c.max_position_embeddings").alias("context_length"),
        F.col("c.num_attention_heads").alias("heads"),
        F.col("t.tokenizer_class").alias("tokenizer"),
        tokens.alias("special_tokens"),
        (F.col("template") | (F.coalesce("t.chat_template", F.lit("")) != "")).alias("chat_template"),
        F.col("g").isNotNull().alias("generation_defaults"),
        F.when(F.size(kept) > 0, kept).alias("generation_keys"),
        languages.alias("languages"),
    )


def license_of(tags: Column) -> Column:
    """The first licence tag."""
    return F.substring_index(F.get(F.filter(tags, lambda t: t.startswith("license:")), 0), ":", -1)


def format_labels(tags: Column, name: Column) -> Column:
    """Formats that tags list or the name holds, in the order of the list."""
    listed = F.array(*map(F.lit, FORMAT_TAGS))
    return F.filter(listed, lambda t: F.array_contains(F.transform(tags, F.lower), t) | F.contains(F.lower(name), t))


def parameters(by_dtype: Column, total: Column, gguf_total: Column) -> Column:
    """(total, dominant): counts by stored type first, then a stated total; none that isn't positive."""
    entries = F.filter(F.map_entries(by_dtype), lambda e: e.value > 0)
    most = F.array_max(F.transform(entries, lambda e: F.struct(e.value.alias("n"), e.key.alias("dtype"))))
    summed = F.aggregate(entries, F.lit(0).cast("long"), lambda a, e: a + e.value)
    n = F.when(F.size(entries) > 0, summed).when(total > 0, total).when(gguf_total > 0, gguf_total)
    return F.when(n.isNotNull(), F.struct(n.alias("total"), most.dtype.alias("dominant")))


def licensing(rows: DataFrame, flags: DataFrame) -> DataFrame:
    """Rights by licence id (flags: license, commercial, derivatives, note); an unknown id or gated access wants review."""
    x = rows.join(checked(flags.withColumn("known", F.lit(True))), "license", "left")
    review = F.col("known").isNull() | F.coalesce(F.col("gated"), F.lit(False))
    gated = F.when(F.col("gated"), "access is gated")
    return x.select(*rows.columns, "commercial", "derivatives", F.concat_ws(" ", "note", gated).alias("notes"), review.alias("needs_manual_review"))


def licence_records(rows: DataFrame, licences: DataFrame) -> DataFrame:
    """`rows` (license, gated, license_files, ...) with all that the table of licences states of an id, why a review is due, and
    whether it is. Nothing is stated of an unknown id, and gated access wants a review whatever the licence."""
    flags = [c for c in licences.columns if c != "license"]
    x = rows.join(checked(licences.withColumn("__known", F.lit(True))), "license", "left")
    gated, unknown = F.coalesce(F.col("gated"), F.lit(False)), F.col("__known").isNull()
    notes = F.array_compact(F.array(F.when(F.coalesce(F.size("license_files"), F.lit(0)) == 0, "no licence text is shipped"), F.when(unknown & F.col("license").isNotNull(), "the licence id is not in the table"), F.when(gated, "access is gated")))
    return x.select(*rows.columns, *flags, notes.alias("notes"), (unknown | gated).alias("needs_manual_review"))


def access(gated: Column) -> Column:
    """Access mode of a stated `gated`, which may be a boolean or a word."""
    low = F.lower(gated)
    return F.when(low.isNull() | low.isin("false", ""), "open").when(low == "true", "gated").otherwise(low)


def dataset_infos(infos: DataFrame, card: DataFrame) -> DataFrame:
    """Splits of each configuration: those of the infos file win, the card fills the rest (aid, config, split, examples)."""
    x = infos.withColumn("rank", F.lit(0)).unionByName(card.withColumn("rank", F.lit(1)))
    w = Window.partitionBy("aid", "config")
    best = x.withColumn("best", F.min("rank").over(w)).where("rank = best")
    return best.groupBy("aid", "config").agg(F.sort_array(F.collect_set("split")).alias("splits"), F.sum("examples").alias("examples"))


def is_table(head: Column, whole: Column) -> Column:
    """Whether a text reads as rows of one dialect: some delimiter stands equally often, and at least once, in every line
    outside quotes, or none stands anywhere, which is one column. The last line counts only if the head is the `whole` file."""
    bare = F.regexp_replace(head, r'"[^"]*(?:""[^"]*)*"', "q")
    lines = F.split(bare, r"\r?\n")
    lines = F.filter(F.when(whole | (F.size(lines) < 2), lines).otherwise(F.slice(lines, F.lit(1), F.size(lines) - 1)), lambda line: F.trim(line) != "")
    count = lambda d: lambda line: F.char_length(line) - F.char_length(F.replace(line, F.lit(d), F.lit("")))
    each = [F.transform(lines, count(d)) for d in (",", ";", "\t", "|")]
    same = [(F.array_min(n) == F.array_max(n)) & (F.array_min(n) > 0) for n in each]
    return reduce(lambda a, b: a | b, same) | reduce(lambda a, b: a & b, [F.array_max(n) == 0 for n in each])


def structure(head: Column, tail: Column, path: Column, size: Column) -> Column:
    """Whether a data file looks like what its name says, from its first and last bytes: ok, empty, malformed, or null for other kinds."""
    low = F.lower(path)
    mark = F.encode(F.lit("PAR1"), "utf-8")
    parquet = (F.substring(head, 1, 4) == mark) & (F.substring(tail, -4, 4) == mark)
    first = F.substring_index(F.decode(head, "utf-8"), "\n", 1)
    json = F.try_parse_json(first).isNotNull()
    table = F.coalesce(is_table(F.decode(head, "utf-8"), F.length(head) >= size), F.lit(False))
    verdict = lambda ok: F.when(size == 0, "empty").when(ok, "ok").otherwise("malformed")
    return F.when(low.endswith(".parquet"), verdict(parquet)).when(low.endswith(".jsonl"), verdict(json)).when(low.rlike(r"\.(csv|tsv)$"), verdict(table))


def phase(offline: Column, retrying: Column, verifying: Column, stalled: Column, started: Column) -> Column:
    """The first phase that applies, in a fixed order."""
    return F.when(offline, PHASES[0]).when(retrying, PHASES[1]).when(verifying, PHASES[2]).when(stalled, PHASES[3]).when(~started, PHASES[4]).otherwise(PHASES[5])


def progress_report(rows: DataFrame) -> DataFrame:
    """aid, percent, the last 24 rates and the largest file in flight."""
    x = rows.groupBy("aid").agg(F.max("done").alias("done"), F.max("total").alias("total"), F.max_by("path", F.struct("size", "path")).alias("largest"))
    last = first_rows(rows.select("aid", "ts", "rate"), ["aid"], [F.col("ts").desc(), F.col("rate").desc()], 24)
    last = last.groupBy("aid").agg(F.array_sort(F.collect_list(F.struct("ts", "rate"))).alias("r"))
    percent = F.when(F.col("total") > 0, F.least(F.lit(100), F.floor(F.col("done") * 100 / F.col("total")))).otherwise(0)
    return x.join(last, "aid").select("aid", percent.cast("long").alias("percent"), F.transform("r", lambda x: x.rate).alias("rates"), "largest")


def relocated(history: DataFrame) -> DataFrame:
    """Runs whose place or machine differs from the run before; machines compare by first label without case, an empty one never equals."""
    w = Window.partitionBy("aid").orderBy("done", "ordinal")
    host = F.lower(F.substring_index("host", ".", 1))
    x = history.withColumn("was", F.lag("location").over(w)).withColumn("h", host).withColumn("had", F.lag(host).over(w)).withColumn("first", F.row_number().over(w) == 1)
    moved = (F.col("was") != F.col("location")) | (F.col("h") != F.col("had")) | (F.col("h") == "")
    return x.where(~F.col("first") & moved).select("aid", "ordinal", F.col("was").alias("relocated_from"))


def holdings(registered: DataFrame, partial_plans: DataFrame) -> DataFrame:
    """Registered bundles and transfers under way as one table, with whole percents and a status."""
    r = registered.select("aid", F.lit("registered").alias("status"), "payload_bytes", F.lit(0).cast("long").alias("remaining_bytes"), F.lit(100).cast("long").alias("percent"))
    done = F.col("verified_files") + F.col("handed_off_files") + F.col("partial_files")
    percent = F.when(F.col("files") > 0, F.floor(done * 100 / F.col("files"))).otherwise(0).cast("long")
    return r.unionByName(partial_plans.select("aid", F.lit("partial").alias("status"), F.col("done_bytes").alias("payload_bytes"), "remaining_bytes", percent.alias("percent")))


def realized(overlay_rows: DataFrame) -> DataFrame:
    """What work on an entry would fetch: a partial goes on with the revision and patterns that it has, a want takes the entry's own."""
    partial = F.col("status") == "partial"
    return overlay_rows.where(F.col("status").isin("partial", "want")).select("k", "source", F.when(partial, F.col("held_revision")).otherwise(F.col("revision")).alias("revision"), F.when(partial, F.col("held_include")).otherwise(F.col("include")).alias("include"))


def normalized(records: DataFrame) -> DataFrame:
    """Older records in the present form (aid, schema_version, lineage, relationships, masters), with what was changed."""
    major = F.substring_index("schema_version", ".", 1).cast("int")
    old = major < 2
    lineage_ = F.when(old & F.col("lineage").isNull(), F.col("relationships")).otherwise(F.col("lineage"))
    changes = F.array_compact(F.array(F.when(old, F.lit("schema_version")), F.when(old & F.col("lineage").isNull() & F.col("relationships").isNotNull(), F.lit("lineage")), F.when(old & F.col("masters").isNotNull(), F.lit("masters -> negatives"))))
    return records.select("aid", F.when(old, "2.0.0").otherwise(F.col("schema_version")).alias("schema_version"), lineage_.alias("lineage"), F.col("masters").alias("negatives"), changes.alias("changes"))


def replicas(copies: DataFrame) -> DataFrame:
    """Bundles with their other places, the latest report of each, and whether they have a copy at all."""
    w = Window.partitionBy("aid", "location").orderBy(F.col("at").desc())
    latest = copies.where("location <> own_location").withColumn("n", F.row_number().over(w)).where("n = 1")
    out = latest.groupBy("aid").agg(F.count("*").alias("copies"), F.max("at").alias("latest"))
    return copies.select("aid").distinct().join(out, "aid", "left").select("aid", F.coalesce("copies", F.lit(0)).alias("copies"), "latest", F.when(F.col("copies") > 0, "replicated").otherwise("single").alias("backup_status"))


def entry_fields(entries: DataFrame) -> DataFrame:
    """Entries (k, source, estimate) with what the stored estimate says of precision and size, how the name reads, and
    the address of closed work; one without an estimate has null there."""
    from stockroom.functions import names
    from stockroom.operators.overlay import closed_source

    name = F.regexp_extract("source", r"([^/:]+)/*$", 1)
    x = names.with_lineage(entries.withColumn("name", name))
    stated = [F.col(f"estimate.{c}").alias(c) for c in ("precision", "bytes_per_param", "size_basis", "unknown_size_count")]
    return x.select("k", "source", "lineage", *stated, closed_source(F.col("source")).alias("home"))
