"""The classification of weight files: from listing, indexes, configurations and headers to sets, verdicts and patterns.

Every order is an artifact whose lines are files; their keys decide which folder, format, digest and header each has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockroom.operators import classify, weights
from stockroom.operators.ranks import by_size
from stockroom.plans.registry import query

LISTING = """select l_orderkey as aid, n, l_partkey % 8 as k, l_suppkey as s, l_partkey as p, cast(round(l_extendedprice * 100) as bigint) as size, l_quantity as quantity from
  (select l_orderkey, l_partkey, l_suppkey, l_extendedprice, l_quantity, cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as int) as n from lineitem) as numbered"""
PATH = """case k when 0 then concat('w', n, '.safetensors') when 1 then concat('v', s % 3, '/w', n, '.safetensors') when 2 then concat('q', cast(floor((n + 1) / 2) as int), '-0000', (n + 1) % 2 + 1, '-of-00002.gguf') when 3 then concat('x', n, '-Q4_K_M.gguf')
  when 4 then concat('pytorch', n, '.bin') when 5 then concat('copy/w', n - 1, '.safetensors') when 6 then concat('README.', n) else concat('notes', n, '.txt') end"""


def listing(spark: SparkSession, sf: str) -> DataFrame:
    lines = by_size(spark.read.parquet(f"{sf}/lineitem.parquet"), "l_orderkey", each=200_000)  # a task's part, in all steps up to the end
    rows = spark.sql(LISTING.replace("from lineitem", "from {lineitem}"), lineitem=lines)
    digest = F.when(F.col("quantity") != 7, F.sha2((F.col("s") % 4).cast("string"), 256))
    return rows.withColumn("path", F.expr(PATH)).withColumn("sha256", digest)


def facts(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """What `classify.classified` takes."""
    classify.by_artifact(spark)
    rows = listing(spark, sf)
    aids = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.col("l_orderkey").alias("aid")).distinct()
    aid, s, gguf = F.col("aid"), F.col("s"), F.col("k").isin(2, 3)
    index = F.when(aid % 4 == 0, '{"metadata": {}, "weight_map": {"a": "w1.safetensors", "b": "w3.safetensors", "c": "sub/w2.safetensors"}}').when(aid % 4 == 1, "{broken")
    root = F.when(aid % 3 == 0, '{"torch_dtype": "bfloat16"}').when(aid % 3 == 1, '{"quantization_config": {"quant_method": "awq"}}')
    config = F.array(F.struct(F.lit("").alias("dir"), root.alias("text")), F.struct(F.lit("copy").alias("dir"), F.when(aid % 5 == 0, "no json").alias("text")))
    none, text = F.lit(None).cast("string"), lambda k, v: F.struct(F.lit(k).alias("key"), v.cast("string").alias("value"), F.lit(None).cast("string").alias("error"))
    number = (F.col("n") + 1) % 2
    pairs = [
        F.when(s % 11 == 0, F.struct(none.alias("key"), none.alias("value"), F.lit("cut").alias("error"))),
        text("general.name", F.lit("m")),
        F.when(s % 6 == 0, text("quantize.imatrix.file", F.lit("i"))),
        F.when(s % 7 == 1, text("general.source.url", F.concat(F.lit("https://hub/Own/m"), aid))),
        F.when(s % 7 == 2, text("general.source.url", F.lit("https://hub/other/x"))),
        F.when(F.col("k") == 2, text("split.count", F.when(s % 5 == 0, 3).otherwise(2))),
        F.when((F.col("k") == 2) & (s % 3 > 0), text("split.no", F.when(s % 13 == 0, 1 - number).otherwise(number))),
    ]
    return {
        "files": rows.select("aid", "path", "size", "sha256"),
        "indexes": aids.select("aid", F.lit("model.safetensors.index.json").alias("path"), index.alias("text")).where("text is not null"),
        "configs": aids.select("aid", F.explode(config).alias("c")).select("aid", "c.*").where("text is not null"),
        "types": rows.where("k in (0, 1, 5) and s % 5 in (1, 2, 3)").select("aid", "path", F.get(F.array(*map(F.lit, ("", "F16", "I8", "F32"))), (s % 5).cast("int")).alias("dtype"), F.col("p").alias("n")),
        "headers": rows.where(gguf).select("aid", "path", F.explode(F.array_compact(F.array(*pairs))).alias("h")).select("aid", "path", "h.*"),
        "base": aids.where("aid % 6 = 0").select("aid", F.explode(F.array(*(F.sha2(F.lit(x), 256) for x in "01"))).alias("sha256")),
        "locators": aids.select("aid", F.concat(F.lit("own/m"), aid).alias("locator")),
    }


JUDGED = f"""with l as ({LISTING}), f as (select *, {PATH} as path, case when quantity <> 7 then sha256(cast(s % 4 as varchar)) end as sha256 from l),
  m as (select *, case when k in (2, 3) then 'gguf' when k in (6, 7) then 'support' when k = 4 then 'legacy' else 'safetensors' end as format,
    case when k in (2, 3) then 'gguf' when k in (6, 7) then 'support' when k = 4 then 'legacy' when k = 0 and aid % 4 = 0 and n in (1, 3) then 'indexed' when k = 0 and aid % 4 = 1 then 'index_error' when k = 0 and aid % 4 = 0 then 'orphan' else 'standalone' end as kind,
    case when k = 0 and aid % 4 = 0 and n in (1, 3) then 'model.safetensors.index.json' when k = 1 then 'v' || (s % 3) when k = 2 then 'q' || ((n + 1) // 2) when k = 3 then path when k = 5 then 'copy' else '' end as set,
    case k when 1 then 'v' || (s % 3) when 5 then 'copy' else '' end as dir from f),
  t as (select aid, kind, set, case s % 5 when 1 then 'F16' when 2 then 'I8' else 'F32' end as dtype, sum(p) as n from m where k in (0, 1, 5) and s % 5 in (1, 2, 3) group by all), d as (select aid, kind, set, arg_min(dtype, row(-n, dtype)) as counted from t group by all),
  e as (select aid, kind, set, min(format) as format, min(dir) as dir, min(path) as first_path, count(*) as files, cast(sum(size) as bigint) as bytes, case when count(sha256) = count(*) then string_agg(sha256, ',' order by sha256) end as digests,
    aid % 6 = 0 and count(sha256) = count(*) and bool_and(s % 4 in (0, 1)) as base_identical, case when kind <> 'gguf' then null when max(k) = 3 then true else count(*) = 2 end as complete, bool_and(s % 11 <> 0) as header_read,
    count(*) > 1 and bool_or(s % 5 = 0 or (s % 3 > 0 and s % 13 = 0)) as headers_disagree, bool_or(s % 6 = 0) as imatrix, bool_or(s % 7 = 2) as foreign_source from m group by aid, kind, set),
  v as (select e.*, coalesce(d.counted, case when e.dir = '' and e.aid % 3 = 0 then 'BF16' end) as dtype, case when e.dir = '' and e.aid % 3 = 1 then 'awq' end as quant_method, e.dir = 'copy' and e.aid % 5 = 0 as config_unreadable from e left join d using (aid, kind, set)),
  w as (select *, case when format in ('safetensors', 'legacy') and digests is not null then row_number() over (partition by aid, format in ('safetensors', 'legacy'), digests order by case when dir = '' then 0 else 1 end, dir, first_path) end as place from v),
  o as (select *, case when kind = 'support' then 'R1' when place > 1 then 'R15' when kind <> 'gguf' and base_identical then 'R2' when format = 'safetensors' and (kind = 'index_error' or config_unreadable) then 'R14'
    when format = 'safetensors' and (quant_method is not null or dtype not in ('F64', 'F32', 'F16', 'BF16')) then 'R5' when format = 'safetensors' and dtype is null then 'R14' when kind = 'orphan' then 'R6' when kind = 'indexed' then 'R3' when format = 'safetensors' then 'R4'
    when format = 'legacy' then case when bool_or(format = 'safetensors') over (partition by aid) then 'R12' else 'R13' end end as own from w),
  c as (select *, count(*) filter (own in ('R2', 'R3', 'R4', 'R6', 'R12', 'R13')) over (partition by aid) as established, count(*) filter (own = 'R14') over (partition by aid) as uncertain from o),
  r as (select *, case when own is not null then own when not complete or not header_read or headers_disagree then 'R14' when imatrix then 'R7' when foreign_source then 'R8' when uncertain > 0 then 'R11' when established = 0 then 'R10' when established = 1 then 'R9' else 'R11' end as rule from c),
  judged as (select *, case when rule = 'R1' then 'support' when rule in ('R2', 'R15') then 'print' when rule in ('R3', 'R4', 'R5', 'R7', 'R10', 'R13') then 'negative' else 'unknown' end as verdict, rule = 'R15' as skip from r)"""


@query("k_classification", JUDGED + " select aid, kind, set, files, bytes, dtype, rule, verdict, skip from judged")
def k_classification(spark, sf):
    """K1-K11: from listing, indexes, configurations and headers to the rule and verdict of every set."""
    _, sets = classify.classified(**facts(spark, sf))
    return sets.select("aid", "kind", "set", "files", "bytes", "dtype", "rule", "verdict", "skip")


@query("k_rule_counts", JUDGED + " select rule, verdict, count(*) as sets, cast(sum(files) as bigint) as files, cast(sum(bytes) as bigint) as bytes from judged group by all")
def k_rule_counts(spark, sf):
    _, sets = classify.classified(**facts(spark, sf))
    return sets.groupBy("rule", "verdict").agg(F.count("*").alias("sets"), F.sum("files").alias("files"), F.sum("bytes").alias("bytes"))


@query("j8_index_members", JUDGED + " select aid, path, set as index from m where kind = 'indexed' union all select aid, 'w' || n || '.safetensors', 'model.safetensors.index.json' from (select distinct aid from m where aid % 4 = 0) a, (values (1), (3)) x(n) where not exists (select 1 from m where m.aid = a.aid and m.kind = 'indexed' and m.path = 'w' || x.n || '.safetensors')")
def j8(spark, sf):
    return classify.index_members(facts(spark, sf)["indexes"])


@query("j15_ambiguity", JUDGED + " select aid, set, rule from judged where kind = 'gguf' and rule in ('R9', 'R10', 'R11')")
def j15(spark, sf):
    _, sets = classify.classified(**facts(spark, sf))
    return sets.where("kind = 'gguf' and rule in ('R9', 'R10', 'R11')").select("aid", "set", "rule")


@query("j16_imatrix_marks", JUDGED + ", h as (select aid, set as variant, case when bool_or(s % 11 <> 0 and s % 6 = 0) then true when bool_or(s % 11 = 0) then null else false end as imatrix from m where kind = 'gguf' group by all) select * from h")
def j16(spark, sf):
    x = facts(spark, sf)
    read = classify.header_facts(x["headers"]).where("read").select("aid", "path", F.col("importance").alias("imatrix"))
    members = classify.file_sets(x["files"], x["indexes"]).where("kind = 'gguf'").groupBy("aid", F.col("set").alias("variant")).agg(F.collect_list("path").alias("paths"))
    return weights.imatrix_marks(members, read)


@query("j9_base_identity", """with f as (select source as aid, lang as set, sha256(text) as s from documents), b as (select distinct sha256(text) as s from documents where doc_id % 10 <> 7)
  select f.aid, 'indexed' as kind, f.set, bool_and(b.s is not null) as base_identical from f left join b on f.s = b.s group by f.aid, f.set""")
def j9(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    s = F.sha2("text", 256).alias("sha256")
    sets = d.select(F.col("source").alias("aid"), F.lit("indexed").alias("kind"), F.col("lang").alias("set"), F.lit("base").alias("base"), s)
    return classify.base_identical(sets, d.where("doc_id % 10 <> 7").select(F.lit("base").alias("aid"), s))


TOTALS = ", ".join(f"count(*) filter (verdict = '{v}') as {v}_sets, cast(coalesce(sum(bytes) filter (verdict = '{v}'), 0) as bigint) as {v}_bytes" for v in ("negative", "print", "unknown", "support"))


@query("a12_verdict_totals", JUDGED + f" select aid, {TOTALS}, cast(coalesce(sum(bytes) filter (not skip), 0) as bigint) as kept_bytes, cast(coalesce(sum(bytes) filter (skip), 0) as bigint) as skipped_bytes from judged group by aid")
def a12(spark, sf):
    _, sets = classify.classified(**facts(spark, sf))
    return classify.verdict_totals(sets)


@query("k12_keep_list", JUDGED + """, x as (select m.aid, m.path, m.kind, m.set, m.n, j.skip, m.kind <> 'support' as weight, m.k = 6 as sidecar from m join judged j using (aid, kind, set)),
  p as (select aid, kind, set, case when count(*) = 1 then min(path) when kind = 'gguf' then set || '-*-of-00002.gguf' end as pattern from x where weight and not skip group by aid, kind, set),
  g as (select aid, bool_and(pattern is not null) as every from p group by aid),
  y as (select x.*, exists (select 1 from p where p.aid = x.aid and (p.pattern = x.path or (p.pattern like '%*%' and x.path like replace(p.pattern, '*', '%')))) as anchored,
    exists (select 1 from p where p.aid = x.aid and p.pattern = regexp_extract(x.path, '[^/]*$', 0)) as named from x),
  z as (select aid, bool_or(skip) as part, bool_or(weight and not skip) as rest, bool_and((not weight or anchored or named) = not skip) as fits_name, bool_and((not weight or anchored) = not skip) as fits_path from y group by aid),
  q as (select z.*, coalesce(g.every, false) as every from z left join g using (aid)),
  u as (select distinct aid, '/' || path as t from x where not weight and not sidecar),
  l1 as (select aid, string_agg(t, ',' order by t) as every_t from (select distinct aid, pattern as t from p union select * from u) group by aid),
  l2 as (select aid, string_agg(t, ',' order by t) as every_t from (select distinct aid, '/' || pattern as t from p union select * from u) group by aid),
  l3 as (select aid, string_agg(t, ',' order by t) as every_t from (select distinct aid, '/' || path as t from x where not skip) group by aid)
  select q.aid, case when not part or not rest then null when every and fits_name then l1.every_t when every and fits_path then l2.every_t else l3.every_t end as include,
  case when part and not rest then 'nothing would be left' end as note, case when part and rest then not (every and (fits_name or fits_path)) end as explicit_paths from q left join l1 using (aid) left join l2 using (aid) left join l3 using (aid)""")
def k12(spark, sf):
    x = facts(spark, sf)
    return classify.kept_patterns(classify.skipped(x["files"], x["indexes"]).where("aid is not null")).select("aid", F.array_join("include", ",").alias("include"), "note", "explicit_paths")
