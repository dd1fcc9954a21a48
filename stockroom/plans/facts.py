"""Facts about artifacts: what configurations, tags, licences and headers state, and how transfers go on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockroom.functions import tables
from stockroom.operators import enrich, files, lineage, migrate, overlay, rules, weights
from stockroom.plans.derive import cte, view
from stockroom.plans.registry import cut, query, shared_path
from stockroom.streaming import telemetry


def part(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/part.parquet")


def pick(values: tuple, at) -> F.Column:
    return F.get(F.array(*map(F.lit, values)), at.cast("int"))


REFS = """with r as (select c_custkey as k, case c_custkey % 5 when 0 then 'https://example.org/x' || c_custkey || '/#top' when 1 then 'https://huggingface.co/o/m' || c_custkey when 2 then 'http://example.org//' when 3 then 'o/m' || c_custkey else 'https://github.com/o/r' || c_custkey end as ref from customer)"""


def refs(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    kinds = [F.concat(F.lit("https://example.org/x"), k, F.lit("/#top")), F.concat(F.lit("https://huggingface.co/o/m"), k), F.lit("http://example.org//"), F.concat(F.lit("o/m"), k), F.concat(F.lit("https://github.com/o/r"), k)]
    return spark.read.parquet(f"{sf}/customer.parquet").select(k.alias("k"), F.get(F.array(*kinds), (k % 5).cast("int")).alias("ref"))


@query("p2_closed_work", REFS + " select k, k % 5 in (0, 2) as closed, case k % 5 when 0 then 'https://example.org/x' || k when 2 then 'http://example.org' end as source from r")
def p2(spark, sf):
    return refs(spark, sf).select("k", overlay.is_closed(F.col("ref")).alias("closed"), overlay.closed_source(F.col("ref")).alias("source"))


@query("p37_entry_fields", """with n as (select c_custkey as k, case c_custkey % 4 when 0 then 'Ax' when 1 then 'Bx' else 'Cx' end || c_custkey % 9 || '.' || c_custkey % 7 as name from customer)
  select k, regexp_extract(name, '^([A-Za-z]+)', 1) as family, regexp_extract(name, '^[A-Za-z]+([0-9.]+)', 1) as generation, case when k % 3 = 0 then 'BF16' end as precision, case when k % 3 = 0 then 'files' end as size_basis, case when k % 4 = 3 then 'https://example.org/' || name end as home from n""")
def p37(spark, sf):
    k = F.col("c_custkey")
    name = F.concat(pick(("Ax", "Bx", "Cx", "Cx"), k % 4), k % 9, F.lit("."), k % 7)
    estimate = F.when(k % 3 == 0, F.struct(F.lit("BF16").alias("precision"), F.lit(2.0).alias("bytes_per_param"), F.lit("files").alias("size_basis"), F.lit(0).alias("unknown_size_count")))
    e = spark.read.parquet(f"{sf}/customer.parquet").select(k.alias("k"), F.concat(F.when(k % 4 == 3, "https://example.org/").otherwise("huggingface:own/"), name).alias("source"), estimate.alias("estimate"))
    return enrich.entry_fields(e).select("k", "lineage.family", "lineage.generation", "precision", "size_basis", "home")


def configs(spark: SparkSession, sf: str) -> DataFrame:
    """A configuration text for each part: heads and layers by its size, window and method by its key."""
    k, s = F.col("p_partkey"), F.col("p_size")
    more = [F.when(k % 5 == 0, F.lit(1)).alias("num_key_value_heads"), F.when(k % 5 == 1, F.lit(512)).alias("kv_lora_rank"), F.when(k % 3 == 0, F.lit(4096)).alias("sliding_window"), F.when(k % 6 == 3, F.lit(4)).alias("sliding_window_pattern")]
    quant = F.when(k % 7 == 0, F.struct(F.lit("awq").alias("quant_method"), F.lit(4).alias("bits"))).alias("quantization_config")
    text = F.to_json(F.struct(F.array(F.concat(F.lit("Arch"), s)).alias("architectures"), (s + 3).alias("num_hidden_layers"), F.lit(8).alias("num_attention_heads"), F.lit(64).alias("head_dim"), F.when(k % 4 == 0, "bfloat16").alias("torch_dtype"), *more, quant))
    return part(spark, sf).select(k, s, F.when(k % 11 == 0, "no json").otherwise(text).alias("text"))


SHAPE = """with s as (select p_partkey as k, p_size + 3 as layers, case when p_partkey % 3 <> 0 then 0 when p_partkey % 6 = 3 then p_size + 3 - (p_size + 3) // 4 else p_size + 3 end as sliding from part where p_partkey % 11 <> 0)"""


@query("p7_attention_shape", SHAPE + """ select k, case k % 5 when 1 then 'mla' when 0 then 'mqa' else 'mha' end as kind, cast(layers - sliding as bigint) as full_layers, cast(sliding as bigint) as sliding_layers, case when sliding > 0 then cast(4096 as bigint) end as sliding_window, cast(case k % 5 when 1 then 1 when 0 then 1 else 8 end as bigint) as kv_heads,
  cast(case when k % 5 = 1 then 512 else 64 end as bigint) as head_dim from s""")
def p7(spark, sf):
    shape = enrich.attention_shape(enrich.config(F.col("text")))
    x = configs(spark, sf).select(F.col("p_partkey").alias("k"), shape.alias("s")).where("s is not null")
    return x.select("k", "s.kind", "s.full_layers", "s.sliding_layers", "s.sliding_window", "s.kv_heads", "s.head_dim")


@query("p4_release_precision", """select p_partkey as k, case when p_partkey % 10 = 0 then 'Q4_K_M' when p_partkey % 11 = 0 then case when p_partkey % 13 = 0 then 'F16' end when p_partkey % 7 = 0 then 'awq-4' when p_partkey % 13 = 0 then 'F16' when p_partkey % 4 = 0 then 'bfloat16' end as precision,
  case when p_partkey % 10 = 0 then 'file names' when p_partkey % 11 = 0 then case when p_partkey % 13 = 0 then 'stored types' end when p_partkey % 7 = 0 then 'quantization_config' when p_partkey % 13 = 0 then 'stored types' when p_partkey % 4 = 0 then 'config' end as read_from from part""")
def p4(spark, sf):
    k = F.col("p_partkey")
    x = configs(spark, sf).withColumn("path", F.when(k % 10 == 0, "m-q4_k_m.gguf").otherwise("model.safetensors"))
    levels = enrich.levels_of(x.select(k.alias("aid"), "path"))
    x = x.join(levels, x["p_partkey"] == levels["aid"])
    p = enrich.release_precision(F.col("levels"), enrich.config(F.col("text")), F.when(k % 13 == 0, "F16"))
    return x.select(k.alias("k"), p.alias("p")).select("k", "p.precision", "p.read_from")


@query("p31_model_record", """select p_partkey as aid, case when p_partkey % 11 <> 0 then 'Arch' || p_size end as architecture, case when p_partkey % 11 <> 0 then cast(8 as bigint) end as heads, case when p_partkey % 2 = 0 then 'Tok' end as tokenizer, case when p_partkey % 2 = 0 then 'bos,eos' else '' end as special_tokens, p_partkey % 6 = 0 as chat_template, p_partkey % 3 = 0 as generation_defaults from part""")
def p31(spark, sf):
    k = F.col("p_partkey")
    tokens = F.to_json(F.struct(F.lit("Tok").alias("tokenizer_class"), F.lit("<s>").alias("bos_token"), F.lit("</s>").alias("eos_token"), F.when(k % 6 == 0, "{{x}}").alias("chat_template")))
    rows = configs(spark, sf).select(k.alias("aid"), F.explode(F.array(F.struct(F.lit("config.json").alias("name"), F.col("text").alias("text")), F.struct(F.lit("tokenizer_config.json").alias("name"), F.when(k % 2 == 0, tokens).alias("text")), F.struct(F.lit("generation_config.json").alias("name"), F.when(k % 3 == 0, "{}").alias("text")))).alias("f")).select("aid", "f.*")
    return enrich.model_record(rows.where("text is not null")).select("aid", "architecture", "heads", "tokenizer", F.array_join("special_tokens", ",").alias("special_tokens"), "chat_template", "generation_defaults")


@query("p9_minimum_ram", cte("shards") + """, g as (select aid, regexp_extract(path, '^(.*)-[0-9]{5}-of', 1) as variant, count(*) = 4 as complete, case when bool_or(size is null) then null else cast(sum(size) as bigint) end as bytes from shards group by 1, 2)
  select aid, cast(round_even(case when count(*) filter (complete) = 1 then max(bytes) filter (complete) end * 1000000 * 1.2 / 1073741824, 1) * 10 as bigint) as tenths from g group by aid""")
def p9(spark, sf):
    m = weights.model_bytes(view(spark, sf, "shards"))
    return m.select("aid", F.round(weights.minimum_ram_gib(F.col("model_bytes") * 1000000) * 10).cast("long").alias("tenths"))


@query("p13_licensing", """select p_partkey as aid, case p_size % 3 when 0 then true when 1 then false end as commercial, concat_ws(' ', case p_size % 3 when 0 then 'free' when 1 then 'no trade' end, case when p_partkey % 4 = 0 then 'access is gated' end) as notes, p_size % 3 = 2 or p_partkey % 4 = 0 as needs_manual_review from part""")
def p13(spark, sf):
    flags = spark.createDataFrame([("mit", True, True, "free"), ("cc-by-nc-4.0", False, True, "no trade")], "license string, commercial boolean, derivatives boolean, note string")
    rows = part(spark, sf).select(F.col("p_partkey").alias("aid"), pick(("mit", "cc-by-nc-4.0", "odd"), F.col("p_size") % 3).alias("license"), (F.col("p_partkey") % 4 == 0).alias("gated"))
    return enrich.licensing(rows, flags).select("aid", "commercial", "notes", "needs_manual_review")


@query("p14_normalized", """select p_partkey as aid, case when p_size % 3 = 0 then '2.0.0' else '2.1.0' end as schema_version, case when p_partkey % 2 = 0 then 'l' when p_size % 3 = 0 and p_partkey % 5 = 0 then 'r' end as lineage, case when p_partkey % 7 = 0 then 'm' end as negatives,
  concat_ws(',', case when p_size % 3 = 0 then 'schema_version' end, case when p_size % 3 = 0 and p_partkey % 2 = 1 and p_partkey % 5 = 0 then 'lineage' end, case when p_size % 3 = 0 and p_partkey % 7 = 0 then 'masters -> negatives' end) as changes from part""")
def p14(spark, sf):
    k = F.col("p_partkey")
    rows = part(spark, sf).select(k.alias("aid"), F.when(F.col("p_size") % 3 == 0, "1.8.0").otherwise("2.1.0").alias("schema_version"), F.when(k % 2 == 0, "l").alias("lineage"), F.when(k % 5 == 0, "r").alias("relationships"), F.when(k % 7 == 0, "m").alias("masters"))
    return enrich.normalized(rows).withColumn("changes", F.array_join("changes", ","))


@query("p20_dataset_infos", """with x as (select l_orderkey as aid, l_returnflag as config, l_linestatus as split, l_partkey as examples, l_linenumber % 2 as rank from lineitem), b as (select *, min(rank) over (partition by aid, config) as best from x)
  select aid, config, string_agg(distinct split, ',' order by split) as splits, cast(sum(case when examples % 3 > 0 then examples end) as bigint) as examples from b where rank = best group by aid, config""")
def p20(spark, sf):
    x = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.col("l_orderkey").alias("aid"), F.col("l_returnflag").alias("config"), F.col("l_linestatus").alias("split"), F.when(F.col("l_partkey") % 3 > 0, F.col("l_partkey")).alias("examples"), "l_linenumber")
    told = lambda at: x.where(f"l_linenumber % 2 = {at}").drop("l_linenumber")
    return enrich.dataset_infos(told(0), told(1)).withColumn("splits", F.array_join("splits", ","))


@query("p24_parameters", """with p as (select p_partkey as k, p_size as a, p_size % 7 as b, p_partkey % 4 as c from part) select k, cast(case when c = 0 then a + b when c = 1 then a * 10 when c = 2 then a * 20 end as bigint) as total, case when c = 0 then case when b > a then 'F16' else 'F32' end end as dominant from p where c < 3""")
def p24(spark, sf):
    k, s = F.col("p_partkey"), F.col("p_size").cast("long")
    by = F.when(k % 4 == 0, F.create_map(F.lit("F32"), s, F.lit("F16"), s % 7)).otherwise(F.create_map(F.lit("F32"), F.lit(0).cast("long")))
    x = part(spark, sf).select(k.alias("k"), enrich.parameters(by, F.when(k % 4 == 1, s * 10).otherwise(0), F.when(k % 4 == 2, s * 20)).alias("p")).where("p is not null")
    return x.select("k", "p.total", "p.dominant")


@query("p26_structure", """with d as (select doc_id, list_filter(string_split_regex(regexp_replace(text, '"[^"]*(?:""[^"]*)*"', 'q', 'g'), '\\r?\\n'), lambda l: trim(l, ' ') <> '') as lines from documents where text <> ''),
  c as (select doc_id, list_transform([',', ';', chr(9), '|'], lambda d: list_transform(lines, lambda l: len(l) - len(replace(l, d, '')))) as n from d)
  select doc_id, case doc_id % 5 when 0 then 'ok' when 1 then 'malformed' when 2 then 'ok' when 3 then case when len(list_filter(n, lambda k: list_min(k) = list_max(k) and list_min(k) > 0)) > 0 or len(list_filter(n, lambda k: list_max(k) = 0)) = 4 then 'ok' else 'malformed' end end as verdict from c""")
def p26(spark, sf):
    at, text = F.col("doc_id") % 5, F.encode("text", "utf-8")
    mark, brace = F.encode(F.lit("PAR1"), "utf-8"), F.encode(F.lit('{"a": 1}\n'), "utf-8")
    head = F.when(at == 0, F.concat(mark, text)).when(at == 2, F.concat(brace, text)).otherwise(text)
    tail = F.when(at == 0, F.concat(text, mark)).otherwise(text)
    path = pick(("a.parquet", "a.parquet", "a.jsonl", "a.csv", "a.md"), at)
    d = spark.read.parquet(f"{sf}/documents.parquet").where("text <> ''")
    return d.select("doc_id", enrich.structure(head, tail, path, F.length(text)).alias("verdict"))


@query("p28_progress", """with o as (select o_custkey as aid, o_orderkey as ts, o_orderkey % 100 as rate, o_orderkey % 50 as done, 'f' || (o_orderkey % 9) as path, o_orderkey % 13 as size from orders), r as (select *, row_number() over (partition by aid order by ts desc) as n from o)
  select aid, cast(least(100, max(done) * 100 // 40) as bigint) as percent, string_agg(rate, ',' order by ts) filter (n <= 24) as rates, arg_max(path, row(size, path)) as largest from r group by aid""")
def p28(spark, sf):
    k = F.col("o_orderkey")
    o = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_custkey").alias("aid"), k.alias("ts"), (k % 100).alias("rate"), (k % 50).alias("done"), F.lit(40).alias("total"), F.concat(F.lit("f"), k % 9).alias("path"), (k % 13).alias("size"))
    return enrich.progress_report(o).withColumn("rates", F.array_join("rates", ","))


@query("p36_realized", """select c_custkey as k, case when c_custkey % 3 = 0 then 'held' || c_custkey when c_custkey % 4 = 0 then 'main' end as revision, case when c_custkey % 3 = 0 then '*.x' else '*.y' end as include from customer where c_custkey % 3 in (0, 1)""")
def p36(spark, sf):
    k = F.col("c_custkey")
    rows = spark.read.parquet(f"{sf}/customer.parquet").select(k.alias("k"), F.lit("s").alias("source"), pick(("partial", "want", "have"), k % 3).alias("status"), F.when(k % 4 == 0, "main").alias("revision"), F.concat(F.lit("held"), k).alias("held_revision"), F.array(F.lit("*.x")).alias("held_include"), F.array(F.lit("*.y")).alias("include"))
    return enrich.realized(rows).select("k", "revision", F.array_join("include", ",").alias("include"))


ENGINES = (("m", "e1", "*.de", True, 1), ("m", "e1", "*.fr", False, 1), ("m", "e1", "*.es", False, 1), ("m", "e0", "*.en", True, 0))


@query("f12_engines", """with a as (select source || '/' || (doc_id % 7) as aid, bool_or(lang = 'de') and bool_or(lang in ('fr', 'es')) as e1, bool_or(lang = 'en') as e0 from documents group by 1) select aid, concat_ws(',', case when e0 then 'e0' end, case when e1 then 'e1' end) as engines from a where e0 or e1""")
def f12(spark, sf):
    table = spark.createDataFrame(list(ENGINES), "artifact_type string, label string, glob string, required boolean, ordinal int")
    rows = spark.read.parquet(f"{sf}/documents.parquet").select(F.concat_ws("/", "source", F.col("doc_id") % 7).alias("aid"), F.lit("m").alias("artifact_type"), F.concat_ws(".", "doc_id", "lang").alias("path"))
    return rules.engines(rows, table).withColumn("engines", F.array_join("engines", ","))


@query("f14_license_files", """select source as aid, case doc_id % 6 when 0 then 'LICENSE.' || doc_id when 1 then 'licence-' || doc_id else 'NOTICE' || doc_id end as path from documents where doc_id % 6 in (0, 1, 3)""")
def f14(spark, sf):
    k = F.col("doc_id")
    path = F.concat(pick(("LICENSE.", "licence-", "d/LICENSE", "NOTICE", "relicense", "README"), k % 6), k)
    return files.loose_license_files(spark.read.parquet(f"{sf}/documents.parquet").select(F.col("source").alias("aid"), path.alias("path")))


@query("g1_graph_edges", """with c as (select c_custkey as k from customer), e as (select 'w' || k as child, 'base/b' || (k % 50) as parent, case when k % 4 = 0 then 'finetune' end as relation, 'card' as declared_by, 0 as rank from c where k % 2 = 0 union all select 'w' || k, 'base/b' || (k % 10), 'fork', 'provider', 1 from c where k % 3 = 0
  union all select 'w' || k, 'base/b' || (k % 5), 'references', 'scan', 2 from c where k % 5 > 0) select child, parent, relation, declared_by from e qualify row_number() over (partition by child, parent order by rank) = 1""")
def g1(spark, sf):
    k = F.col("c_custkey")
    c, none = spark.read.parquet(f"{sf}/customer.parquet"), F.array().cast("array<string>")
    name = F.concat(F.lit("w"), k)
    base = lambda n: F.concat(F.lit("base/b"), k % n)
    m = c.select(name.alias("child"), F.when(k % 2 == 0, F.array(base(50))).otherwise(none).alias("card_parents"), F.when(k % 4 == 0, "finetune").alias("card_relation"), none.alias("tags"), none.alias("card_datasets"))
    return lineage.graph_edges(m, c.where("c_custkey % 3 = 0").select(name.alias("child"), base(10).alias("parent")), c.select(name.alias("tree"), F.when(k % 5 > 0, base(5)).alias("primary")))


# transfers over time

STREAM = cte("stream") + ", o as (select *, case when kind in ('network', 'local') then bytes else 0 end as moved from stream)"


@query("st10_alerts", STREAM + """, u as (select aid, ts, event_id, sum(case when kind = 'network' then bytes else 0 end) over w as used, 200000 - sum(moved) over w as free from o window w as (partition by aid order by ts, event_id rows unbounded preceding)),
  f as (select aid, ts, event_id, 'cap' as reason from u where used >= 50000 union all select aid, ts, event_id, 'deadline' from u where ts >= 1705276800 union all select aid, ts, event_id, 'free' from u where free < 20000)
  select aid, reason, ts, event_id from f qualify row_number() over (partition by aid, reason order by ts, event_id) = 1""")
def st10(spark, sf):
    return telemetry.batch_alerts(view(spark, sf, "stream").withColumn("free", F.lit(200000)), 50000, 1705276800, 20000, cut)


@query("st13_hash_rate", STREAM + """, c as (select *, sum(case when kind = 'hash' then bytes else 0 end) over (partition by aid order by ts, event_id rows unbounded preceding) as s from o), r as (select event_id, aid, kind, max(ts) over w - min(ts) over w as span, max(s) over w - min(s) over w as m, count(*) filter (kind in ('network', 'local')) over w as others from c window w as (partition by aid order by ts range between 36000 preceding and current row))
  select event_id, aid, case when others = 0 and span > 0 then cast(m // span as bigint) end as rate from r where kind = 'hash'""")
def st13(spark, sf):
    return telemetry.batch_hash_rate(view(spark, sf, "stream"), cut, 36000)


POINTS = STREAM + """, p as (select aid, (ts // 21600) * 21600 as ts, sum(moved) as got, bool_or(kind = 'retry') as quiet, count(*) filter (kind in ('network', 'local')) = 0 and bool_and(kind = 'online') as stalled from o group by aid, (ts // 21600) * 21600),
  d as (select aid, ts, least(sum(got) over (partition by aid order by ts rows unbounded preceding), 400000) as done, 400000 as total, got / 21600.0 as rate, quiet, stalled from p)"""


@query("st5_eta", POINTS + """, w as (select *, ts - min(ts) over s as span, done - first(done) over s as gained from d window s as (partition by aid order by ts rows between 7 preceding and current row)), f as (select *, case when span >= 86400 then gained / span else rate end as pace from w),
  g as (select *, case when done >= total then 0.0 when not stalled and pace > 0 then (total - done) / pace end as fresh from f), t as (select *, case when not quiet or done >= total then {'v': fresh} end as told from g)
  select aid, ts, case when stalled then null else cast(floor((last_value(told ignore nulls) over (partition by aid order by ts rows unbounded preceding)).v) as bigint) end as eta from t""")
def st5(spark, sf):
    e = view(spark, sf, "stream")
    moving = F.col("kind").isin("network", "local")
    p = e.groupBy("aid", (F.floor(F.col("ts") / 21600) * 21600).alias("ts")).agg(F.sum(F.when(moving, F.col("bytes")).otherwise(0)).alias("got"), F.bool_or(F.col("kind") == "retry").alias("quiet"), ((F.count_if(moving) == 0) & F.bool_and(F.col("kind") == "online")).alias("stalled"))
    from pyspark.sql.window import Window

    upto = Window.partitionBy("aid").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    d = p.select("aid", "ts", F.least(F.sum("got").over(upto), F.lit(400000)).alias("done"), F.lit(400000).alias("total"), (F.col("got") / 21600).alias("rate"), "quiet", "stalled")
    return telemetry.batch_eta(d, 8, 86400).select("aid", "ts", F.floor("eta").alias("eta"))


@query("st9_due_reports", STREAM.replace("with ", "with recursive ", 1) + """, r as (select aid, ts, case when kind in ('network', 'local') then 'downloading' when kind = 'hash' then 'verifying' else kind end as phase, cast(min(bytes % 2) as bigint) as percent from o group by all), u as (select aid, ts, min(phase) as phase, min(percent) as percent from r group by aid, ts),
  c as (select *, (phase || ' ' || percent) is distinct from lag(phase || ' ' || percent) over (partition by aid order by ts) as changed from u), i as (select *, sum(changed::int) over (partition by aid order by ts rows unbounded preceding) as island from c),
  n as (select a.aid, a.island, a.ts, min(b.ts) as after from i a join i b on a.aid = b.aid and a.island = b.island and b.ts >= a.ts + 40000 group by all), s(aid, island, ts) as (select aid, island, min(ts) from i group by aid, island union all select s.aid, s.island, n.after from s join n on s.aid = n.aid and s.island = n.island and s.ts = n.ts)
  select i.aid, i.ts, i.phase, i.percent from i join s on i.aid = s.aid and i.island = s.island and i.ts = s.ts""")
def st9(spark, sf):
    e = view(spark, sf, "stream")
    phase = F.when(F.col("kind").isin("network", "local"), "downloading").when(F.col("kind") == "hash", "verifying").otherwise(F.col("kind"))
    r = e.select("aid", "ts", phase.alias("phase"), (F.col("bytes") % 2).alias("percent")).groupBy("aid", "ts").agg(F.min("phase").alias("phase"), F.min("percent").alias("percent"))
    return telemetry.due(r, 40_000)


@query("st11_disk_short", STREAM + """, d as (select aid, 'd' || (aid % 25) as disk, cast(1000000 - sum(moved) as bigint) as remaining from o group by aid) select d.aid, d.disk, d.remaining, d.remaining > n_nationkey * 60000 - 20000 as short from d left join nation on 'd' || n_nationkey = d.disk""")
def st11(spark, sf):
    moved = F.when(F.col("kind").isin("network", "local"), F.col("bytes")).otherwise(0)
    progress = view(spark, sf, "stream").groupBy("aid").agg((1000000 - F.sum(moved)).alias("remaining")).withColumn("disk", F.concat(F.lit("d"), F.col("aid") % 25))
    disks = spark.read.parquet(f"{sf}/nation.parquet").select(F.concat(F.lit("d"), "n_nationkey").alias("disk"), (F.col("n_nationkey") * 60000).alias("free"), F.lit(20000).alias("floor"))
    return telemetry.disk_short(progress, disks).select("aid", "disk", "remaining", "short")


@query("st12_verified_as_landed", cte("inventory", "observed") + """ select o.aid, o.path, case when e.path is null then 'extra' when e.sha256 = o.sha256 then 'verified' else 'mismatched' end as verdict from observed o left join inventory e on e.aid = o.aid and e.path = o.path""")
def st12(spark, sf):
    """Files as they land, in a stream, against the recorded table."""
    at = shared_path(spark, "landed")
    seen = view(spark, sf, "observed")
    seen.write.parquet(at)
    stream = spark.readStream.schema(seen.schema).parquet(at)
    return telemetry.drained(telemetry.verified_as_landed(stream, view(spark, sf, "inventory")), shared_path(spark, "verdicts"))


# the tables that come with the engine

NAMES = (
    "model/config.json", "model/a.safetensors", "model/sub/b.gguf", "model/tokenizer.json", "model/README-x.md", "model/license.txt", "model/generation_config.json", "data/t.parquet", "data/x/README.md",
    "code/readme", "Dockerfile", "x/Makefile", "Makefile", "run.sh", "x/run.sh", "requirements/dev.txt", "x/docker-compose.dev.yml", "package.json", "model/w.npz", "model/tokenizer_config.json", "x/api.Dockerfile", ".env.sample",
)
TYPES = ("model", "dataset", "code")


def payloads(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as files with names that the shipped tables speak of; what an artifact holds depends on its documents."""
    k = F.col("doc_id")
    kind = pick(TYPES, k % 3)
    return spark.read.parquet(f"{sf}/documents.parquet").select(F.concat_ws("/", kind, "source", F.col("n_chars") % 29).alias("aid"), kind.alias("artifact_type"), pick(NAMES, F.floor(k / 3) % len(NAMES)).alias("path"))


def sql_rows(rows: list[tuple]) -> str:
    """Rules as SQL values, their globs as LIKE patterns in which a backslash goes before what is no wildcard."""
    like = lambda g: g.replace("_", r"\_").replace("*", "%")
    return ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v).lower() for v in (*r[:2], like(r[2]), r[2], *r[3:])) + ")" for r in rows)


PAYLOADS = "with p as (select ['" + "', '".join(TYPES) + "'][doc_id % 3 + 1] as artifact_type, ['" + "', '".join(NAMES) + f"'][(doc_id // 3) % {len(NAMES)} + 1] as path, source || '/' || (n_chars % 29) as rest from documents), f as (select artifact_type || '/' || rest as aid, artifact_type, path from p)"


@query("f11_shipped_rules", PAYLOADS + f""", r(artifact_type, label, pat, raw, required, ordinal) as (values {sql_rows(tables.completeness_rows())}), w as (select distinct f.aid, r.label, r.required from f join r using (artifact_type)),
  h as (select aid, label, list_sort(list(distinct path))[:10] as files from f join r on f.artifact_type = r.artifact_type and f.path like r.pat escape '\\' group by aid, label), o as (select w.*, h.files is not null as present, array_to_string(h.files, ',') as files from w left join h using (aid, label))
  select aid, label, required, present, files, case when bool_or(required and not present) over (partition by aid) then 'incomplete' else 'complete' end as status from o""")
def f11_shipped(spark, sf):
    return rules.completeness(payloads(spark, sf), tables.completeness_rules(spark)).withColumn("files", F.array_join("files", ","))


@query("f12_shipped_engines", PAYLOADS + f""", r(artifact_type, label, pat, raw, required, ordinal) as (values {sql_rows(tables.engine_rows())}), h as (select distinct f.aid, r.label, r.raw, r.required from f join r on f.artifact_type = r.artifact_type and f.path like r.pat escape '\\'),
  n as (select label, count(*) filter (required) as every, count(*) filter (not required) as any_n, min(ordinal) as ordinal from r group by label), g as (select aid, label, count(*) filter (required) as has, count(*) filter (not required) as any_of from h group by aid, label)
  select aid, string_agg(label, ',' order by ordinal) as engines from g join n using (label) where has = every and (any_n = 0 or any_of > 0) group by aid""")
def f12_shipped(spark, sf):
    return rules.engines(payloads(spark, sf), tables.engine_rules(spark)).withColumn("engines", F.array_join("engines", ","))


@query("f13_shipped_builds", PAYLOADS + f""", r(artifact_type, label, pat, raw, required, ordinal, root) as (values {sql_rows(tables.build_rows())}), h as (select distinct f.aid, r.label, f.path from f join r on f.artifact_type = r.artifact_type
    and case when contains(r.raw, '/') then f.path else split_part(f.path, '/', -1) end like r.pat escape '\\' and not (r.root and contains(f.path, '/')))
  select aid, label, count(*) as files, array_to_string(list_sort(list(path))[:20], ',') as paths from h group by aid, label""")
def f13_shipped(spark, sf):
    return rules.declarations(payloads(spark, sf), tables.build_files(spark)).withColumn("paths", F.array_join("paths", ","))


@query("p13_licence_records", """with l(license, name, commercial_use, patent_grant, trademark_terms) as (values """ + ", ".join("(" + ", ".join("null" if v is None else str(v).lower() if isinstance(v, bool) else "'" + v.replace("'", "''") + "'" for v in r) + ")" for r in tables.LICENCES) + """),
  a as (select p_partkey as aid, case when p_size % 15 < 12 then (select list(license) from l)[p_size % 15 + 1] when p_size % 15 < 14 then 'own-' || p_size end as license, p_partkey % 4 = 0 as gated, p_partkey % 3 > 0 as text from part)
  select aid, a.license, l.name, commercial_use, l.license is not null as redistribution, patent_grant, trademark_terms, concat_ws('; ', case when not text then 'no licence text is shipped' end, case when l.license is null and a.license is not null then 'the licence id is not in the table' end, case when gated then 'access is gated' end) as notes, l.license is null or gated as needs_manual_review
  from a left join l on a.license = l.license""")
def p13_records(spark, sf):
    k, at = F.col("p_partkey"), F.col("p_size") % 15
    key = F.when(at < 12, pick(tuple(r[0] for r in tables.LICENCES), at)).when(at < 14, F.concat(F.lit("own-"), "p_size"))
    rows = part(spark, sf).select(k.alias("aid"), key.alias("license"), (k % 4 == 0).alias("gated"), F.when(k % 3 > 0, F.array(F.lit("LICENSE"))).alias("license_files"))
    out = enrich.licence_records(rows, tables.licences(spark)).withColumns({"notes": F.array_join("notes", "; "), "redistribution": F.coalesce("redistribution", F.lit(False))})
    return out.select("aid", "license", "name", "commercial_use", "redistribution", "patent_grant", "trademark_terms", "notes", "needs_manual_review")


@query("f19_preflight", """with m as (select p_partkey as aid, ['transformers', 'llama-cpp', 'mlx'][p_partkey % 3 + 1] as engine, case p_size % 4 when 0 then 'LlamaForCausalLM' when 1 then 'BertModel' when 2 then 'GPT2LMHeadModel' end as architecture, p_size * 1000 as need from part), c as (select 'm' || n_nationkey as machine, n_nationkey * 2500 as ram_bytes from nation)
  select aid, engine, machine, concat_ws(',', case when engine <> 'llama-cpp' then case when architecture is null then 'warning unknown-architecture' when architecture = 'BertModel' then 'error unsupported-architecture' end end, case when ram_bytes < need then 'error insufficient-ram' when ram_bytes < need * 1.3 then 'warning tight-ram' end) as issues from m, c""")
def f19_preflight(spark, sf):
    k = F.col("p_partkey")
    models = part(spark, sf).select(k.alias("aid"), pick(("transformers", "llama-cpp", "mlx"), k % 3).alias("engine"), pick(("LlamaForCausalLM", "BertModel", "GPT2LMHeadModel", None), F.col("p_size") % 4).alias("architecture"), (F.col("p_size") * 1000).alias("need"))
    machines = spark.read.parquet(f"{sf}/nation.parquet").select(F.concat(F.lit("m"), "n_nationkey").alias("machine"), (F.col("n_nationkey") * 2500).alias("ram_bytes"))
    out = rules.preflight(models, machines, tables.engine_architectures(spark))
    return out.withColumn("issues", F.array_join(F.transform("issues", lambda i: F.concat_ws(" ", i.level, i.code)), ","))


@query("p31_languages", """select p_partkey as aid, case p_size % 3 when 0 then 'en' when 1 then 'de,fr-' || p_size end as languages, case when p_partkey % 2 = 0 then 'top_p,max_new_tokens' end as generation_keys, p_partkey % 5 = 0 or p_partkey % 7 = 0 as chat_template, case when p_partkey % 7 = 0 then 'bos,cls,mask' else '' end as special_tokens from part""")
def p31_languages(spark, sf):
    k, size = F.col("p_partkey"), F.col("p_size")
    card = F.when(size % 3 == 0, F.lit('{"language": "en"}')).when(size % 3 == 1, F.concat(F.lit('{"language": ["de", "fr-'), size, F.lit('"], "license": "mit"}'))).otherwise('{"tags": []}')
    made = {"config.json": F.lit("{}"), "card": card, "generation_config.json": F.when(k % 2 == 0, '{"max_new_tokens": 5, "top_p": 0.5, "other": 1}').otherwise("{}"), "chat_template.jinja": F.when(k % 5 == 0, "x"), "tokenizer_config.json": F.when(k % 7 == 0, '{"bos_token": "a", "cls_token": "b", "mask_token": "c", "chat_template": "t"}')}
    files = part(spark, sf).select(k.alias("aid"), F.explode(F.array(*(F.struct(F.lit(n).alias("name"), t.alias("text")) for n, t in made.items()))).alias("f")).select("aid", "f.*").where("text is not null")
    return enrich.model_record(files).select("aid", F.array_join("languages", ",").alias("languages"), F.array_join("generation_keys", ",").alias("generation_keys"), "chat_template", F.array_join("special_tokens", ",").alias("special_tokens"))


@query("p14_migrated", """with r as (select p_partkey as k, ['1.8.0', '2.1.0', '1.2', '3.0.0', 'odd'][p_partkey % 5 + 1] as version, case p_size % 3 when 0 then 'dataset' when 1 then 'model' end as type, case when p_partkey % 4 > 0 then 'hub' end as origin, p_size as z from part),
  s as (select *, case when version = 'odd' then 'unreadable' when version like '1%' then 'older' when version like '3%' then 'newer' else 'current' end as standing, coalesce(type, 'model') as kind from r)
  select k as aid, standing, case when standing = 'older' then '2.1.0' else version end as schema_version, case when standing = 'older' then kind else type end as artifact_type, case when standing = 'older' then origin end as provider,
    case when standing = 'older' then origin || ':' || case when kind = 'dataset' then 'datasets/' else '' end || 'own/Net' || z || '-7B' end as address,
    case when standing = 'older' then case when kind = 'dataset' then coalesce(origin, 'huggingface') || ':datasets/raw/d' || z || ' derived card' else concat_ws(',', coalesce(origin, 'huggingface') || ':base/a ' || case when z % 2 = 0 then 'quantized' else 'finetune' end || ' tag',
      coalesce(origin, 'huggingface') || ':base/b ' || case when z % 2 = 0 then 'finetune ' else '' end || 'card', coalesce(origin, 'huggingface') || ':datasets/web/c trained_on card') end end as parents,
    case when standing = 'older' and z % 4 = 0 then 'negatives' when z % 4 = 0 then 'masters' end as policy, case when standing = 'older' then 'negative,skip' else 'master,skip' end as verdicts, case when standing = 'older' then case when z % 5 = 0 then 'own/' when kind = 'dataset' then 'data/' else 'model/' end when z % 5 = 0 then 'own/' end as payload_root,
    case when standing = 'older' then concat_ws(',', 'schema_version', 'identity', 'lineage', case when origin is not null then 'address' end, 'classification', case when z % 5 <> 0 then 'layout' end) else '' end as changes, case when standing = 'older' then 'Net' end as family, case when standing = 'older' then 7000000000 end as size from s""")
def p14_migrated(spark, sf):
    k, z = F.col("p_partkey"), F.col("p_size")
    rows = part(spark, sf).select(
        k.alias("aid"), pick(("1.8.0", "2.1.0", "1.2", "3.0.0", "odd"), k % 5).alias("schema_version"), F.when(z % 3 == 0, "dataset").when(z % 3 == 1, "model").alias("artifact_type"), F.when(k % 4 > 0, "hub").alias("origin"), F.lit(None).cast("string").alias("provider"),
        F.concat(F.lit("own/Net"), z, F.lit("-7B")).alias("repo_id"), F.lit(None).cast("string").alias("address"), F.array(F.lit("base/a"), F.lit("base/b")).alias("base_models"), F.lit("finetune").alias("base_model_relation"), F.array(F.lit("web/c"), F.lit(" ")).alias("training_datasets"), F.array(F.concat(F.lit("raw/d"), z)).alias("source_datasets"),
        F.array(F.lit("x"), F.lit("base_model:base/a"), F.when(z % 2 == 0, "base_model:quantized:base/a").otherwise("base_model:finetune:base/a")).alias("tags"), F.when(z % 4 == 0, "masters").alias("policy"), F.array(F.lit("master"), F.lit("skip")).alias("verdicts"), F.when(z % 5 == 0, "own/").alias("payload_root"),
    )
    out = migrate.migrated(rows)
    edges = F.array_join(F.transform("parents", lambda e: F.concat_ws(" ", e.source, e.relation, e.declared_by)), ",")
    return out.select("aid", "standing", "schema_version", "artifact_type", "provider", "address", edges.alias("parents"), "policy", F.array_join("verdicts", ",").alias("verdicts"), "payload_root", F.array_join("changes", ",").alias("changes"), F.regexp_extract("identity.family", "^([A-Za-z]+)", 1).alias("family"), F.col("identity.size_total").alias("size"))
