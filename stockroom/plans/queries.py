"""Registered queries over the derived artifact tables, each with the SQL that it is held against."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockroom.functions import names
from stockroom.operators import enrich, files, findings, integrity, lineage, overlay, rules, transfers, weights
from stockroom.plans import registry
from stockroom.plans.derive import cte, view
from stockroom.plans.registry import query
from stockroom.streaming import telemetry

PAIR = cte("inventory", "observed")
DIFF = PAIR + """, diff as (select coalesce(e.aid, o.aid) as aid, coalesce(e.path, o.path) as path,
  case when o.path is null then 'missing' when e.path is null then 'extra' when e.sha256 is distinct from o.sha256 then 'mismatched' end as verdict
  from inventory e full join observed o on e.aid = o.aid and e.path = o.path)"""


@query("j1_integrity_diff", DIFF + " select * from diff where verdict is not null")
def j1(spark, sf):
    return integrity.integrity_diff(view(spark, sf, "inventory"), view(spark, sf, "observed"))


@query("j2_size_diff", PAIR + """ select aid, path, verdict from (select coalesce(e.aid, o.aid) as aid, coalesce(e.path, o.path) as path,
  case when o.path is null then 'missing' when e.path is null then 'extra' when e.size <> o.size then 'size_mismatch' end as verdict
  from inventory e full join (select aid, path, size + case when length(path) % 2 = 0 then 0 else 1 end as size from observed) o on e.aid = o.aid and e.path = o.path) where verdict is not null""")
def j2(spark, sf):
    grown = F.col("size") + F.when(F.length("path") % 2 == 0, 0).otherwise(1)
    return integrity.size_diff(view(spark, sf, "inventory"), view(spark, sf, "observed").withColumn("size", grown))


@query("a1_artifact_hash", cte("inventory") + " select aid, sha256(string_agg(sha256 || '  ' || path, chr(10) order by path) || chr(10)) as artifact_sha256 from inventory group by aid")
def a1(spark, sf):
    return integrity.artifact_hash(view(spark, sf, "inventory"))


@query("a2_verification_summary", DIFF + """, c as (select aid, count(*) as n from inventory group by aid), d as (select aid,
  count(*) filter (verdict = 'missing') as missing, count(*) filter (verdict = 'extra') as extra, count(*) filter (verdict = 'mismatched') as mismatched from diff where verdict is not null group by aid)
  select coalesce(c.aid, d.aid) as aid, coalesce(n, 0) as files_checked, coalesce(missing, 0) as missing, coalesce(extra, 0) as extra, coalesce(mismatched, 0) as mismatched,
  case when coalesce(missing, 0) + coalesce(extra, 0) + coalesce(mismatched, 0) = 0 then 'pass' else 'fail' end as result from c full join d on c.aid = d.aid""")
def a2(spark, sf):
    expected = view(spark, sf, "inventory")
    return integrity.verification_summary(expected, integrity.integrity_diff(expected, view(spark, sf, "observed")))


@query("j12_landing_diff", PAIR + """ select coalesce(e.aid, o.aid) as aid, count(*) filter (e.path is not null and o.path is not null and e.size = o.size) as present,
  count(*) filter (e.path is not null and o.path is not null and e.size <> o.size) as resized, count(*) filter (o.path is null) as missing, count(*) filter (e.path is null) as extra,
  cast(coalesce(sum(case when e.path is not null and (o.path is null or e.size <> o.size) then e.size end), 0) as bigint) as bytes_to_copy
  from inventory e full join observed o on e.aid = o.aid and e.path = o.path group by 1""")
def j12(spark, sf):
    return integrity.landing(view(spark, sf, "inventory"), view(spark, sf, "observed"))


@query("j21_outside_scope", PAIR + " select o.aid, o.path, o.size from observed o where not exists (select 1 from inventory e where e.aid = o.aid and e.path = o.path)")
def j21(spark, sf):
    return integrity.outside_scope(view(spark, sf, "observed"), view(spark, sf, "inventory"))


@query("f22_files_to_hash", PAIR + """ select e.aid, e.path from inventory e where exists (select 1 from observed o where o.aid = e.aid and o.path = e.path)
  and not exists (select 1 from inventory v where v.aid = e.aid and v.path = e.path and v.size % 2 = 0)""")
def f22(spark, sf):
    expected = view(spark, sf, "inventory")
    return integrity.files_to_hash(expected, view(spark, sf, "observed"), expected.where("size % 2 = 0"))


@query("p18_git_blob_id", "select doc_id, sha1('blob ' || strlen(text) || chr(0) || text) as git_id from documents")
def p18(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    return docs.select("doc_id", integrity.git_blob_id(F.encode("text", "utf-8")).alias("git_id"))


@query("a3_status_fold", "select o_orderkey, case when o_orderstatus = 'F' then 'compromised' when o_orderkey % 5 = 0 then 'upstream-mismatch' else 'verified' end as status from orders")
def a3(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    result = F.when(F.col("o_orderstatus") == "F", "fail").otherwise("pass")
    prior = F.when(F.col("o_orderkey") % 5 == 0, "upstream-mismatch").otherwise("verified")
    return o.select("o_orderkey", integrity.status_fold(result, prior).alias("status"))


@query("a4_format_breakdown", cte("observed") + " select aid, '.' || regexp_extract(path, '[.]([^.]+)$', 1) as ext, count(*) as files, cast(sum(size) as bigint) as bytes from observed group by all")
def a4(spark, sf):
    return files.format_breakdown(view(spark, sf, "observed"))


@query("a5_dominant_format", cte("observed") + """, b as (select aid, '.' || regexp_extract(path, '[.]([^.]+)$', 1) as ext, count(*) as files, cast(sum(size) as bigint) as bytes from observed group by all)
  select aid, ext, files, bytes from b qualify row_number() over (partition by aid order by bytes desc, files desc, ext) = 1""")
def a5(spark, sf):
    return files.dominant_format(view(spark, sf, "observed"))


@query("a23_payload_split", cte("observed") + """ select aid, count(*) filter (path like '%.txt') as primary_files, cast(sum(case when path like '%.txt' then size else 0 end) as bigint) as primary_bytes,
  count(*) filter (path not like '%.txt') as support_files, arg_max(path, row(size, path)) as largest_path, max(size) as largest_bytes, cast(0 as bigint) as unknown_sizes from observed group by aid""")
def a23(spark, sf):
    return files.payload_split(view(spark, sf, "observed"))


@query("a16_usage_rollup", cte("inventory") + " select aid, split_part(path, '/', 1) as dir, cast(sum(size) as bigint) as bytes, count(*) as files from inventory group by rollup(1, 2)")
def a16(spark, sf):
    return files.usage(view(spark, sf, "inventory").withColumn("dir", F.substring_index("path", "/", 1)), "aid", "dir")


@query("f1_f3_selection", cte("inventory") + """ select i.aid, i.path, i.size from inventory i where (path like 'de/%' or path similar to '.*/0000[0-4][0-9].txt')
  and aid in (select aid from inventory where path like 'de/%' or path similar to '.*/0000[0-4][0-9].txt')""")
def f3(spark, sf):
    return files.selected(view(spark, sf, "inventory"), ["/de/*", "0000[0-4]?.txt"]).select("aid", "path", "size")


RIDING = ("README.md", "ReadMe", "x/LICENSE-MIT", "x/licence.txt", "config.json", "my-config.json", "w.index.json", "tokenizer_config.json", "a.tiktoken", "chat_template.jinja", "run.PY", "weights.bin", "w-1.safetensors", "readme-x.md")


@query("f2_sidecars", "with f as (select source || '/' || (n_chars % 17) as aid, ['" + "', '".join(RIDING) + f"'][doc_id % {len(RIDING)} + 1] as path, doc_id from documents), s as (select *, split_part(lower(path), '/', -1) as name from f), k as (select *, " + " or ".join("name like '" + g.lower().replace("_", r"\_").replace("*", "%") + r"' escape '\'" for g in dict.fromkeys(files.SIDECARS)) + """ as rides, path = 'weights.bin' as named from s)
  select aid, path, doc_id from k where (rides or named) and aid in (select aid from k where named)""")
def f2(spark, sf):
    """What rides along with a selection, by names of every kind; an artifact without a selected file selects nothing."""
    d = spark.read.parquet(f"{sf}/documents.parquet")
    path = F.get(F.array(*map(F.lit, RIDING)), (F.col("doc_id") % len(RIDING)).cast("int"))
    rows = d.select(F.concat_ws("/", "source", F.col("n_chars") % 17).alias("aid"), path.alias("path"), "doc_id")
    return files.selected(rows, ["weights.bin"])


@query("f3_empty_selection", cte("inventory") + " select distinct aid from inventory where aid not in (select aid from inventory where path similar to '.*/00000[0-9].txt')")
def f3_empty(spark, sf):
    return files.empty_selections(view(spark, sf, "inventory"), ["00000?.txt"])


@query("f4_selection_totals", cte("inventory") + """, t as (select aid, count(*) as full_files, cast(sum(size) as bigint) as full_bytes, cast(0 as bigint) as full_unknown,
  count(*) filter (path like 'fr/%') as kept_files, cast(coalesce(sum(case when path like 'fr/%' then size end), 0) as bigint) as kept_bytes, cast(0 as bigint) as kept_unknown from inventory group by aid) select * from t""")
def f4(spark, sf):
    inventory = view(spark, sf, "inventory")
    return files.selection_totals(inventory, files.selected(inventory, ["fr/*"], sidecars=False))


@query("f5_file_roles", cte("observed", "shards") + """, a as (select aid, path from observed union all select aid, path from shards)
  select aid, case when lower(path) like '%.gguf' then 'weight' when path like '%.txt' then 'data' else 'support' end as role, count(*) as files from a group by all""")
def f5(spark, sf):
    every = view(spark, sf, "observed").select("aid", "path").union(view(spark, sf, "shards").select("aid", "path"))
    return every.groupBy("aid", files.file_role(F.col("path")).alias("role")).agg(F.count("*").alias("files"))


@query("f17_unsafe_paths", cte("inventory") + """, p as (select aid, case doc_id % 9 when 0 then '/' || path when 1 then 'a/../' || path when 2 then 'a..b/' || path else path end as path from inventory)
  select aid, path from p where path like '/%' or path like '../%' or path like '%/../%' or path like '%/..'""")
def f17(spark, sf):
    at = F.col("doc_id") % 9
    path = F.concat(F.when(at == 0, "/").when(at == 1, "a/../").when(at == 2, "a..b/").otherwise(""), F.col("path"))
    return files.unsafe_paths(view(spark, sf, "inventory").withColumn("path", path))


@query("f18_oversize", cte("inventory") + " select aid, path, size from inventory where size > 8191")
def f18(spark, sf):
    return files.oversize(view(spark, sf, "inventory"), 8191)


@query("a11_exact_twins", """with k as (select lang as aid, source as dir, doc_id, sha256(text) as s, row_number() over (partition by lang, sha256(text), source order by doc_id) as r from documents),
  t as (select aid, dir || '/' || doc_id as dir, s from k), w as (select aid, dir, row_number() over p as r, first(dir) over p as keeper from t window p as (partition by aid, s order by dir rows between unbounded preceding and current row))
  select aid, dir, keeper from w where r > 1""")
def a11(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sets = docs.select(F.col("lang").alias("aid"), F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("dir"), F.array(F.sha2("text", 256)).alias("digests"))
    return files.exact_twins(sets)


@query("w4_size_order", cte("inventory") + " select aid, path, size, cast(row_number() over (partition by aid order by size, path) as int) as position from inventory")
def w4(spark, sf):
    return files.size_order(view(spark, sf, "inventory"), registry.cut).withColumn("position", F.col("position").cast("int"))


# want-lists

HELD = cte("entries", "holdings") + """, m as (select e.k, e.source, h.source as hs, h.part, h.archived, h.o_orderkey from entries e left join holdings h on e.source = h.source
  and (e.revision is null or e.revision = h.revision) and (h.include is null or h.policy)),
  overlaid as (select k, source, case when hs is null then 'want' when part then 'partial' else 'have' end as status, lpad(cast(o_orderkey as varchar), 12, '0') as held_at, archived from m
  qualify row_number() over (partition by k order by part nulls last, archived desc nulls last, o_orderkey) = 1)"""


def overlaid(spark: SparkSession, sf: str) -> DataFrame:
    entries = view(spark, sf, "entries").withColumn("include", F.lit(None).cast("array<string>"))
    holdings = view(spark, sf, "holdings").select("source", "revision", F.lit("main").alias("ref"), F.when(F.col("include").isNotNull(), F.array("include")).alias("include"), "policy", "part", "archived", F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("path"))
    return overlay.overlay(entries, holdings)


@query("j3_catalog_overlay", HELD + " select k, source, status, held_at, archived from overlaid")
def j3(spark, sf):
    return overlaid(spark, sf)


WORK = HELD + """, w as (select o.k, o.source, o.status, e.catalog_id, e.desire, case when o.status = 'have' then 0 when o.k % 6 = 0 then null else o.k * 1000 end as remaining,
  case when o.status = 'want' then null else o.k * 10 end as on_disk from overlaid o join entries e on o.k = e.k)"""


def work(spark: SparkSession, sf: str) -> DataFrame:
    rows = overlaid(spark, sf).select("k", "source", "status").join(view(spark, sf, "entries").select("k", "catalog_id", "desire"), "k")
    return rows.withColumn("remaining", F.when(F.col("status") == "have", 0).when(F.col("k") % 6 == 0, None).otherwise(F.col("k") * 1000)).withColumn("on_disk", F.when(F.col("status") == "want", None).otherwise(F.col("k") * 10))


@query("a9_overlay_stats", WORK + """ select count(*) filter (status = 'want') as want, count(*) filter (status = 'partial') as partial, count(*) filter (status = 'have') as have, count(*) filter (status = 'closed') as closed,
  cast(coalesce(sum(case when status in ('want', 'partial') then remaining end), 0) as bigint) as remaining_bytes, count(*) filter (status in ('want', 'partial') and remaining is null) as remaining_unknown, cast(coalesce(sum(on_disk), 0) as bigint) as on_disk_bytes from w""")
def a9(spark, sf):
    return overlay.overlay_stats(work(spark, sf))


@query("t3_next_entry", WORK + " select k, source, status, catalog_id, desire from w where status in ('want', 'partial') qualify row_number() over (partition by catalog_id order by case when status = 'partial' then 0 else 1 end, desire desc nulls last, source) = 1")
def t3(spark, sf):
    return overlay.next_entry(work(spark, sf)).select("k", "source", "status", "catalog_id", "desire")


RANK = "case status when 'partial' then 0 when 'want' then 1 when 'have' then 2 when 'closed' then 3 else 4 end"
ORDERS = {"next": f"{RANK}, desire desc nulls last", "desire": "desire desc nulls last", "size": "coalesce(remaining, -1) desc", "name": "lower(split_part(source, '/', -1))", "status": RANK, "family": "lower(split_part(split_part(source, '/', 1), ':', -1)) nulls last"}


@query("t1_listing_order", WORK + ", " + ", ".join(f"o_{by} as (select k, '{by}' as sort, cast(row_number() over (partition by catalog_id order by {order}, lower(source)) as int) as listed from w)" for by, order in ORDERS.items()) + " " + " union all ".join(f"select * from o_{by}" for by in ORDERS))
def t1(spark, sf):
    """The place of every row in each of the six listings of its catalog."""
    rows = work(spark, sf).withColumn("family", F.regexp_extract("source", ":([^/]+)/", 1))
    out = [overlay.listed(rows, by).select("k", F.lit(by).alias("sort"), "listed") for by in ORDERS]
    return reduce(DataFrame.union, out)


@query("a30_idle_reason", WORK + """ select catalog_id, case when count(k) = 0 then 'empty' when count(*) filter (status in ('want', 'partial')) > 0 then 'not idle'
  when count(*) filter (status = 'closed') > 0 then 'only closed work' else 'complete' end as reason from w group by catalog_id""")
def a30(spark, sf):
    return overlay.idle_reason(work(spark, sf))


@query("f6_wanted", WORK + " select k, source, status from w where status in ('want', 'partial')")
def f6(spark, sf):
    return work(spark, sf).where(F.col("status").isin("want", "partial")).select("k", "source", "status")


DRIVES = cte("holdings") + """, b as (select source || '/' || revision as bundle_id, part, sha256(cast(max(payload) as varchar)) as sha256, min(o_orderkey) % 2 as side from holdings group by source, revision, part),
  v as (select * from b where not part), d as (select bundle_id, part, case when length(bundle_id) % 3 = 0 then sha256(sha256) else sha256 end as sha256 from b where side = 1 or not part)"""


@query("j6_drive_overlay", DRIVES + """, s as (select d.bundle_id, case when d.part then 'partial' when v.bundle_id is null then 'new' when v.sha256 <> d.sha256 then 'differ' else 'have' end as status
  from d left join (select * from v where side = 0) v on d.bundle_id = v.bundle_id) select bundle_id, status, cast(case status when 'new' then 0 when 'differ' then 1 when 'partial' then 2 else 3 end as int) as listed from s""")
def j6(spark, sf):
    h = view(spark, sf, "holdings")
    b = h.groupBy("source", "revision", "part").agg(F.sha2(F.max("payload").cast("string"), 256).alias("sha256"), (F.min("o_orderkey") % 2).alias("side"))
    b = b.withColumn("bundle_id", F.concat_ws("/", "source", "revision"))
    drive = b.where("side = 1 or not part").withColumn("sha256", F.when(F.length("bundle_id") % 3 == 0, F.sha2("sha256", 256)).otherwise(F.col("sha256")))
    return overlay.drive_overlay(b.where("side = 0"), drive)


@query("u1_adoptable", cte("entries") + """, o as (select * from entries where k % 2 = 0 union all select k + 1000000, source, revision, desire, catalog_id, note from entries where k % 4 = 0)
  select source, revision, k from o where not exists (select 1 from entries m where m.k % 3 = 0 and m.source = o.source and m.revision is not distinct from o.revision)
  qualify row_number() over (partition by source, coalesce(revision, '') order by k) = 1""")
def u1(spark, sf):
    e = view(spark, sf, "entries").withColumn("include", F.lit(None).cast("array<string>"))
    other = e.where("k % 2 = 0").union(e.where("k % 4 = 0").withColumn("k", F.col("k") + 1000000))
    return overlay.adoptable(e.where("k % 3 = 0"), other).select("source", "revision", "k")


@query("u2_upsert", cte("entries") + """, b as (select source, coalesce(revision, '') as revision, desire, note from entries where k % 5 <> 1), c as (select source, coalesce(revision, '') as revision, case when k % 2 = 0 then 9 end as desire, case when k % 3 = 0 then 'changed' end as note from entries where k % 4 = 1 or k % 10 = 2)
  select coalesce(b.source, c.source) as source, coalesce(b.revision, c.revision) as revision, cast(coalesce(c.desire, b.desire) as int) as desire, coalesce(c.note, b.note) as note,
  case when b.source is null then 'added' when c.source is null or (coalesce(c.desire, b.desire) is not distinct from b.desire and coalesce(c.note, b.note) is not distinct from b.note) then 'unchanged' else 'updated' end as outcome
  from b full join c on b.source = c.source and b.revision = c.revision""")
def u2(spark, sf):
    e = view(spark, sf, "entries")
    changes = e.where("k % 4 = 1 or k % 10 = 2").withColumn("desire", F.when(F.col("k") % 2 == 0, 9)).withColumn("note", F.when(F.col("k") % 3 == 0, "changed"))
    return overlay.upsert(e.where("k % 5 <> 1"), changes)


@query("u3_drop", cte("entries") + """, e2 as (select * from entries union all select k + 1000000, source, 'main', desire, catalog_id, note from entries where k % 3 = 0), r as (select k as request, case when k % 7 = 0 then 'nowhere' else source end as source from entries where k % 2 = 0)
  select r.request, case count(e2.k) when 1 then 'dropped' when 0 then 'not found' else 'ambiguous' end as outcome from r left join e2 on r.source = e2.source group by r.request""")
def u3(spark, sf):
    e = view(spark, sf, "entries")
    both = e.union(e.where("k % 3 = 0").withColumn("k", F.col("k") + 1000000).withColumn("revision", F.lit("main")))
    requests = e.where("k % 2 = 0").select(F.col("k").alias("request"), F.when(F.col("k") % 7 == 0, "nowhere").otherwise(F.col("source")).alias("source"), F.lit(None).cast("string").alias("revision"))
    return overlay.dropped(both, requests)


@query("u4_readdress", cte("entries") + """, m as (select source, case when k % 4 = 0 then 'huggingface:cust' || (k + 1) || '/work' else 'huggingface:moved' || k || '/work' end as address from entries where k % 2 = 0)
  select e.k, case when m.address is not null and t.source is null then m.address else e.source end as source, e.revision, m.address is not null and t.source is null as moved
  from entries e left join m on e.source = m.source left join entries t on t.source = m.address and coalesce(t.revision, '') = coalesce(e.revision, '')""")
def u4(spark, sf):
    e = view(spark, sf, "entries")
    new = F.when(F.col("k") % 4 == 0, F.concat(F.lit("huggingface:cust"), F.col("k") + 1, F.lit("/work"))).otherwise(F.concat(F.lit("huggingface:moved"), F.col("k"), F.lit("/work")))
    return overlay.readdressed(e, e.where("k % 2 = 0").select("source", new.alias("address")))


@query("a26_catalog_index", cte("entries") + """, c as (select 'catalog' || n_nationkey as catalog_id from nation), n as (select catalog_id, count(*) as entries from entries group by 1) select c.catalog_id, coalesce(n.entries, 0) as entries from c left join n on c.catalog_id = n.catalog_id""")
def a26(spark, sf):
    catalogs = spark.read.parquet(f"{sf}/nation.parquet").select(F.concat(F.lit("catalog"), "n_nationkey").alias("catalog_id"))
    return overlay.catalog_index(catalogs, view(spark, sf, "entries"))


NOW = "timestamp '1998-08-02 00:00:00'"


@query("a28_estimate_age", f"""with o as (select 'catalog' || (o_custkey % 7) as catalog_id, case when o_orderkey % 5 = 0 then null else o_orderdate end as as_of from orders where o_orderkey % 3 = 0 or o_custkey % 7 = 2)
  select catalog_id, case when min(as_of) is null then 'none' when not bool_or(coalesce(as_of < {NOW} - interval 7 day, false)) then 'fresh' else date_diff('day', min(as_of), {NOW}) || ' d' end as age from o group by 1""")
def a28(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet").where("o_orderkey % 3 = 0 or o_custkey % 7 = 2")
    at = F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderdate").cast("string"))
    return overlay.estimate_age(o.select(F.concat(F.lit("catalog"), F.col("o_custkey") % 7).alias("catalog_id"), at.alias("as_of")), F.expr(NOW))


@query("f7_stale", f"select o_orderkey, case when o_orderkey % 5 = 0 then false else o_orderdate < {NOW} - interval 7 day end as stale from orders")
def f7(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    at = F.when(F.col("o_orderkey") % 5 == 0, "someday").otherwise(F.col("o_orderdate").cast("string"))
    return o.select("o_orderkey", overlay.stale(at, F.expr(NOW)).alias("stale"))


@query("p30_publisher", cte("entries") + " select k, regexp_extract(source, ':([^/]+)/', 1) as publisher from entries")
def p30(spark, sf):
    return view(spark, sf, "entries").select("k", overlay.publisher(F.col("source")).alias("publisher"))


@query("p1_canonical_source", """with r as (select c_custkey as k, case c_custkey % 6 when 0 then 'hf:o' || c_custkey || '/m' when 1 then 'https://huggingface.co/o/m' || c_custkey || '/tree/main' when 2 then 'gh:o/r' || c_custkey || '.git'
  when 3 then 'o/m' || c_custkey when 4 then 'https://example.org/x' else 'https://github.com/o/r' || c_custkey || '?tab=readme' end as ref from customer)
  select k, case k % 6 when 0 then 'huggingface:o' || k || '/m' when 1 then 'huggingface:o/m' || k when 2 then 'github:o/r' || k when 3 then 'huggingface:o/m' || k when 5 then 'github:o/r' || k end as source from r""")
def p1(spark, sf):
    c = spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_custkey").alias("k"))
    k = F.col("k").cast("string")
    kinds = [F.concat(F.lit("hf:o"), k, F.lit("/m")), F.concat(F.lit("https://huggingface.co/o/m"), k, F.lit("/tree/main")), F.concat(F.lit("gh:o/r"), k, F.lit(".git")), F.concat(F.lit("o/m"), k), F.lit("https://example.org/x"), F.concat(F.lit("https://github.com/o/r"), k, F.lit("?tab=readme"))]
    return c.select("k", overlay.canonical_source(F.get(F.array(*kinds), (F.col("k") % 6).cast("int"))).alias("source"))


# weights

GROUPS = cte("shards") + """, g as (select aid, regexp_extract(path, '^(.*)-[0-9]{5}-of', 1) as variant, cast(4 as int) as "of", count(*) as files,
  count(distinct path) = 4 and count(*) = 4 as complete, case when bool_or(size is null) then null else cast(sum(size) as bigint) end as bytes, false as projector from shards group by 1, 2)"""


@query("a7_shard_groups", GROUPS + " select * from g")
def a7(spark, sf):
    return weights.gguf_groups(view(spark, sf, "shards"))


@query("a8_model_bytes", GROUPS + " select aid, case when count(*) filter (complete) = 1 then max(bytes) filter (complete) end as model_bytes from g group by aid")
def a8(spark, sf):
    return weights.model_bytes(view(spark, sf, "shards"))


@query("a29_publication", GROUPS + " select aid, count(*) as variants, cast(0 as bigint) as companions, case when bool_or(bytes is null) then null else cast(sum(bytes) as bigint) end as variant_bytes, cast(0 as bigint) as companion_bytes from g group by aid")
def a29(spark, sf):
    return weights.publication(view(spark, sf, "shards"))


LEVELS = """with n as (select p_partkey, 'm-' || case p_size % 8 when 0 then 'Q4_K_M' when 1 then 'q8_0' when 2 then 'IQ2_XS' when 3 then 'BF16' when 4 then 'mxfp4' when 5 then 'Q3_K_S' when 6 then 'plain' else 'f16' end || '.gguf' as path, p_size % 8 as s from part)"""


@query("p5_gguf_level", LEVELS + """ select p_partkey, case s when 0 then 'Q4_K_M' when 1 then 'Q8_0' when 2 then 'IQ2_XS' when 3 then 'BF16' when 4 then 'MXFP4' when 5 then 'Q3_K_S' when 7 then 'F16' end as level,
  cast(case s when 0 then 4 when 1 then 8 when 2 then 2 when 4 then 4 when 5 then 3 end as int) as bits, case s when 0 then 'middle' when 1 then 'wide' when 2 then 'compact' when 4 then 'middle' when 5 then 'compact' end as family from n""")
def p5(spark, sf):
    names = F.array(*map(F.lit, ("Q4_K_M", "q8_0", "IQ2_XS", "BF16", "mxfp4", "Q3_K_S", "plain", "f16")))
    p = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", F.concat(F.lit("m-"), F.get(names, F.col("p_size") % 8), F.lit(".gguf")).alias("path"))
    p = p.withColumn("level", weights.gguf_level(F.col("path"))).withColumn("bits", weights.level_bits(F.col("level")))
    return p.select("p_partkey", "level", "bits", weights.level_family(F.col("bits")).alias("family"))


@query("t4_starting_selection", """with v as (select p_brand as aid, 'm' || p_partkey || case p_size % 3 when 0 then '-Q4_K_M' when 1 then '-Q8_0' else '-F16' end as variant, p_size % 3 as s, case when p_partkey % 6 = 0 then null else cast(p_size * 1000 as bigint) end as bytes, p_partkey % 5 <> 0 as complete from part)
  select aid, cast(case s when 0 then 4 else 8 end as int) as bits, variant, bytes from v where s < 2 and complete and bytes is not null qualify row_number() over (partition by aid, s order by bytes, variant) = 1""")
def t4(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet")
    level = F.get(F.array(*map(F.lit, ("-Q4_K_M", "-Q8_0", "-F16"))), F.col("p_size") % 3)
    v = p.select(F.col("p_brand").alias("aid"), F.concat(F.lit("m"), F.col("p_partkey"), level).alias("variant"), F.when(F.col("p_partkey") % 6 != 0, (F.col("p_size") * 1000).cast("long")).alias("bytes"), (F.col("p_partkey") % 5 != 0).alias("complete"), F.lit(False).alias("projector"))
    return weights.starting_selection(v, (4, 8))


@query("p11_expected_bytes", """with d as (select p_brand as aid, case p_size % 4 when 0 then 'F32' when 1 then 'BF16' when 2 then 'F8_E4M3' else case when p_brand like '%1' then 'ODD' else 'I8' end end as dtype, p_partkey as n from part)
  select aid, case when count(*) filter (dtype = 'ODD') = 0 then cast(sum(n * case dtype when 'F32' then 4 when 'BF16' then 2 else 1 end) as bigint) end as expected_bytes from d group by aid""")
def p11(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet")
    at = F.col("p_size") % 4
    dtype = F.when(at == 0, "F32").when(at == 1, "BF16").when(at == 2, "F8_E4M3").when(F.col("p_brand").endswith("1"), "ODD").otherwise("I8")
    return weights.expected_bytes(p.select(F.col("p_brand").alias("aid"), dtype.alias("dtype"), F.col("p_partkey").alias("n")))


@query("a6_parameter_counts", """with t as (select l_orderkey as aid, l_returnflag as dtype, l_partkey as path, l_suppkey * l_linenumber as n, l_linenumber = 7 as bad from lineitem), b as (select distinct aid from t where bad)
  select aid, dtype, cast(sum(n) as bigint) as parameters, count(*) as tensors, count(distinct path) as files from t where aid not in (select aid from b) group by aid, dtype""")
def a6(spark, sf):
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    shape = F.array(F.col("l_suppkey"), F.col("l_linenumber").cast("long"))
    return weights.parameter_counts(li.select(F.col("l_orderkey").alias("aid"), F.col("l_returnflag").alias("dtype"), F.col("l_partkey").alias("path"), shape.alias("shape"), F.when(F.col("l_linenumber") == 7, "unreadable").alias("error")))


# transfers

@query("a13_transfer_plan", cte("states") + """, s as (select *, case when status in ('verified', 'handed_off') then size when status = 'partial' then size // 2 else 0 end as done from states)
  select aid, count(*) as files, count(*) filter (status = 'verified') as verified_files, count(*) filter (status = 'handed_off') as handed_off_files, count(*) filter (status = 'partial') as partial_files, count(*) filter (status = 'missing') as missing_files,
  cast(sum(size) as bigint) as total_bytes, cast(sum(done) as bigint) as done_bytes, cast(sum(size) - sum(done) as bigint) as remaining_bytes, count(*) filter (status in ('verified', 'handed_off')) = count(*) as complete from s group by aid""")
def a13(spark, sf):
    return transfers.transfer_plan(view(spark, sf, "states").withColumn("partial", F.expr("size div 2")))


@query("a14_session_summary", cte("sessions") + " select aid, count(*) as sessions, arg_min(started, ordinal) as first_start, arg_max(ended, ordinal) as last_end, cast(sum(bytes) as bigint) as bytes, cast(sum(retries) as bigint) as retries from sessions group by aid")
def a14(spark, sf):
    return transfers.session_summary(view(spark, sf, "sessions"))


@query("a15_session_rate", cte("sessions") + " select aid, cast(sum(ended - started) as bigint) as seconds, case when sum(ended - started) >= 60 then cast(sum(bytes) // sum(ended - started) as bigint) end as rate from sessions where bytes > 0 and ended > started group by aid")
def a15(spark, sf):
    return transfers.session_rate(view(spark, sf, "sessions"))


RECONCILE = cte("states") + """, e as (select aid, path, size from states where path <> 3), s as (select aid, path, status from states where path <> 2 and status <> 'missing'), p as (select aid, path, case when size % 4 = 0 then size // 2 else size end as size from states where size % 3 <> 0 and status <> 'handed_off')
  select aid, path, case when not e and s then 'remove' when not e then 'stray' when status = 'verified' and p and whole then 'keep' when status = 'handed_off' then 'keep_handed_off' when status = 'verified' then 'demote'
  when p and whole then 'adopt' when p then 'resume' else 'missing' end as decision from (select coalesce(e.aid, s.aid, p.aid) as aid, coalesce(e.path, s.path, p.path) as path, e.path is not null as e, s.path is not null as s, p.path is not null as p, s.status, e.size = p.size as whole
  from e full join s on e.aid = s.aid and e.path = s.path full join p on coalesce(e.aid, s.aid) = p.aid and coalesce(e.path, s.path) = p.path)"""


@query("j11_reconcile", RECONCILE)
def j11(spark, sf):
    x = view(spark, sf, "states")
    present = x.where("size % 3 <> 0 and status <> 'handed_off'").withColumn("size", F.expr("case when size % 4 = 0 then size div 2 else size end"))
    return transfers.reconcile(x.where("path <> 3"), x.where("path <> 2 and status <> 'missing'"), present)


@query("j13_handoff_eligible", cte("states") + " select a.aid, a.path, a.size from states a join states b on a.aid = b.aid and a.path = b.path where a.status = 'verified' and (b.status = 'verified' and b.size % 2 = 0)")
def j13(spark, sf):
    x = view(spark, sf, "states")
    return transfers.handoff_eligible(x, x.withColumn("status", F.when(F.col("size") % 2 == 0, F.col("status")).otherwise("missing")))


@query("j14_combinable", cte("states") + """, g as (select aid, sha256(string_agg(path || chr(9) || (size % 2), chr(10) order by path || chr(9) || (size % 2))) as signature from states group by aid) select signature, min(aid) as first, count(*) as members from g group by signature having count(*) > 1""")
def j14(spark, sf):
    return transfers.combinable(view(spark, sf, "states").withColumn("size", F.col("size") % 2))


@query("w1_disk_fit", cte("inventory") + """, r as (select aid, size, sum(size) over (partition by aid order by size, path rows unbounded preceding) <= 100000 as fits from inventory)
  select aid, count(*) filter (fits) as fit_files, cast(coalesce(sum(size) filter (fits), 0) as bigint) as fit_bytes, count(*) filter (not fits) as left_files from r group by aid""")
def w1(spark, sf):
    return transfers.disk_fit(view(spark, sf, "inventory"), F.lit(100000), registry.cut)


@query("f20_disk_verdict", cte("inventory") + """, n as (select aid, cast(sum(size) as bigint) as need from inventory group by aid), d as (select n_nationkey as disk, cast(n_nationkey * 20000 as bigint) as free from nation)
  select aid, disk, case when free - 10000 >= need * 1.1 then 'ok' when free - 10000 >= need then 'tight' else 'insufficient' end as verdict from n, d""")
def f20(spark, sf):
    need = view(spark, sf, "inventory").groupBy("aid").agg(F.sum("size").alias("need"))
    disks = spark.read.parquet(f"{sf}/nation.parquet").select(F.col("n_nationkey").alias("disk"), (F.col("n_nationkey") * 20000).alias("free"))
    return transfers.disk_verdicts(need, disks, 10000)


LANES = cte("inventory").replace("with ", "with recursive ", 1) + """, r as (select aid, path, size, row_number() over (partition by aid order by size desc, path) as i from inventory),
  s(aid, i, loads, lane) as (select distinct aid, cast(0 as bigint), [{'l': cast(0 as bigint), 'c': cast(0 as bigint), 'k': cast(0 as bigint)}, {'l': 0, 'c': 0, 'k': 1}, {'l': 0, 'c': 0, 'k': 2}, {'l': 0, 'c': 0, 'k': 3}], cast(null as bigint) from r
    union all select s.aid, r.i, list_sort(list_prepend({'l': loads[1].l + r.size, 'c': loads[1].c + 1, 'k': loads[1].k}, loads[2:])), loads[1].k from s join r on r.aid = s.aid and r.i = s.i + 1),
  lanes as (select r.aid, r.path, r.size, s.lane from r join s on r.aid = s.aid and r.i = s.i)"""


@query("w3_lanes", LANES + " select * from lanes")
def w3(spark, sf):
    return transfers.lanes(view(spark, sf, "inventory"), 4, registry.cut)


@query("a27_lane_stats", LANES + ", b as (select aid, lane, count(*) as files, cast(sum(size) as bigint) as bytes from lanes group by aid, lane) select *, max(bytes) over (partition by aid) * 4 > sum(bytes) over (partition by aid) * 1.5 as skewed from b")
def a27(spark, sf):
    return transfers.lane_stats(transfers.lanes(view(spark, sf, "inventory"), 4, registry.cut), 4)


@query("w2_scan_budget", cte("inventory").replace("with ", "with recursive ", 1) + """, c as (select aid, path, size, length(path) % 3 as priority from inventory), r as (select *, row_number() over (partition by aid order by priority, path) as i from c where size <= 2048),
  s(aid, i, budget, taken) as (select distinct aid, cast(0 as bigint), cast(20000 as bigint), false from r union all select s.aid, r.i, case when r.size <= s.budget then s.budget - r.size else s.budget end, r.size <= s.budget from s join r on r.aid = s.aid and r.i = s.i + 1)
  select r.aid, r.path, case when s.taken then 'read' else 'over budget' end as outcome from r join s on r.aid = s.aid and r.i = s.i union all select aid, path, 'oversize' from c where size > 2048""")
def w2(spark, sf):
    listing = view(spark, sf, "inventory").select("aid", "path", "size", (F.length("path") % 3).alias("priority"))
    return transfers.scan_budget(listing, 2048, 20000)


HISTORY = "with h as (select o_custkey as aid, o_orderkey as ordinal, o_orderdate as done, case when o_orderstatus = 'F' then 'fail' else 'pass' end as status from orders)"


def history(spark: SparkSession, sf: str) -> DataFrame:
    o = spark.read.parquet(f"{sf}/orders.parquet")
    return o.select(F.col("o_custkey").alias("aid"), F.col("o_orderkey").alias("ordinal"), F.col("o_orderdate").alias("done"), F.when(F.col("o_orderstatus") == "F", "fail").otherwise("pass").alias("status"))


@query("w7_history_retention", HISTORY + " select aid, ordinal, done, status from h qualify row_number() over (partition by aid order by done desc, ordinal desc) <= 5")
def w7(spark, sf):
    return transfers.latest(history(spark, sf), 5)


@query("w8_verification_drift", HISTORY + ", d as (select aid, ordinal, lag(status) over (partition by aid order by done, ordinal) as before, status as after from h) select * from d where before <> after")
def w8(spark, sf):
    return transfers.drift(history(spark, sf), registry.cut)


@query("a31_latest_run", HISTORY + " select aid, status, done, ordinal from h qualify row_number() over (partition by aid, status order by done desc, ordinal desc) = 1")
def a31(spark, sf):
    return transfers.latest_by(history(spark, sf), "aid", "status")


@query("u6_assembled", cte("states") + " select aid as pin, path, min(case when status = 'verified' then size % 5 end) as holder, max(size) as size from states group by aid, path")
def u6(spark, sf):
    return transfers.assembled(view(spark, sf, "states").select(F.col("aid").alias("pin"), "path", "status", "size", (F.col("size") % 5).alias("holder")))


@query("a21_hosts", "select o_custkey as aid, string_agg(distinct o_orderpriority, ',' order by o_orderpriority) as hosts from orders group by 1")
def a21(spark, sf):
    s = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_custkey").alias("aid"), F.col("o_orderpriority").alias("host"))
    return transfers.distinct_hosts(s).withColumn("hosts", F.array_join("hosts", ","))


# lineage

NAMES = "with n as (select p_partkey, upper(left(p_brand, 1)) || 'x' || (p_partkey % 4) || '.' || (p_partkey % 10) || '-' || p_size || 'B' || case p_partkey % 3 when 0 then '-Instruct' when 1 then '-GGUF' else '' end as name from part)"


@query("p3_name_lineage", NAMES + """ select p_partkey, regexp_extract(name, '^([A-Za-z]+)', 1) as family, regexp_extract(name, '^[A-Za-z]+([0-9.]+)', 1) as generation, regexp_extract(name, '-([0-9]+B)', 1) as member,
  case when name like '%Instruct' then 'instruct' else '' end as variants, case when name like '%GGUF' then 'gguf' else '' end as formats, cast(regexp_extract(name, '-([0-9]+)B', 1) as bigint) * 1000000000 as size_total from n""")
def p3(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet")
    tail = F.get(F.array(*map(F.lit, ("-Instruct", "-GGUF", ""))), (F.col("p_partkey") % 3).cast("int"))
    p = p.select("p_partkey", F.concat(F.upper(F.left("p_brand", F.lit(1))), F.lit("x"), F.col("p_partkey") % 4, F.lit("."), F.col("p_partkey") % 10, F.lit("-"), "p_size", F.lit("B"), tail).alias("name"))
    x = names.with_lineage(p)
    return x.select("p_partkey", "lineage.family", "lineage.generation", "lineage.member", F.array_join("lineage.variants", ",").alias("variants"), F.array_join("lineage.formats", ",").alias("formats"), F.col("lineage.size_total").cast("long").alias("size_total"))


@query("a10_family_tree", """with r as (select 'huggingface:pub' || (p_size % 7) || '/m' || p_partkey as source, 'pub' || (p_size % 7) as publisher, case when p_partkey % 3 = 0 then upper(p_type) else p_type end as family, cast(p_size % 3 as varchar) as generation, p_partkey % 5 <> 0 as provider from part),
  v as (select lower(family) as key, family, sum(case when provider then 2 else 1 end) as votes from r group by 1, 2), h as (select lower(family) as key, publisher, count(*) as votes from r group by 1, 2), g as (select lower(family) as key, generation, count(*) as members, min(source) as first from r group by 1, 2),
  bv as (select key, family from v qualify row_number() over (partition by key order by votes desc, family) = 1), bh as (select key, publisher from h qualify row_number() over (partition by key order by votes desc, publisher) = 1)
  select g.key, g.generation, g.members, g.first, bv.family, bh.publisher from g join bv on g.key = bv.key join bh on g.key = bh.key""")
def a10(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet")
    pub = F.concat(F.lit("pub"), F.col("p_size") % 7)
    rows = p.select(F.concat(F.lit("huggingface:"), pub, F.lit("/m"), "p_partkey").alias("source"), pub.alias("publisher"), F.when(F.col("p_partkey") % 3 == 0, F.upper("p_type")).otherwise(F.col("p_type")).alias("family"), (F.col("p_size") % 3).cast("string").alias("generation"), (F.col("p_partkey") % 5 != 0).alias("provider"))
    return lineage.family_tree(rows)


@query("t5_generation_order", "with g as (select distinct (p_size % 12) || '.' || (p_partkey % 15) as generation from part) select generation, cast(row_number() over (order by cast(split_part(generation, '.', 1) as int), cast(split_part(generation, '.', 2) as int)) as int) as place from g")
def t5(spark, sf):
    from pyspark.sql.window import Window

    g = spark.read.parquet(f"{sf}/part.parquet").select(F.concat(F.col("p_size") % 12, F.lit("."), F.col("p_partkey") % 15).alias("generation")).distinct()  # 180 at most
    return g.select("generation", F.row_number().over(Window.orderBy(lineage.generation_key(F.col("generation")))).alias("place"))


@query("a24_descendants", cte("edges") + " select parent, count(*) as children, count(*) filter (relation = 'quantized') as quantized, count(*) filter (relation = 'finetune') as finetune, count(*) filter (relation = 'adapter') as adapter, count(*) filter (relation = 'merge') as merge, cast(0 as bigint) as trained_on from edges group by parent")
def a24(spark, sf):
    return lineage.descendants(view(spark, sf, "edges"))


@query("g3_ancestor_closure", cte("edges").replace("with ", "with recursive ", 1) + """, up(child, ancestor, depth) as (select child, parent, 1 from edges union all select up.child, e.parent, up.depth + 1 from up join edges e on up.ancestor = e.child)
  select child, ancestor, cast(min(depth) as int) as depth from up group by all""")
def g3(spark, sf):
    return lineage.ancestors(view(spark, sf, "edges"), registry.cut)


@query("p21_declared_parents", """with m as (select c_custkey as c, 'work' || c_custkey as child from customer), e as (select child, 'base/b' || (c % 50) as parent, case when c % 4 = 0 then 'finetune' end as relation, 'card' as declared_by from m where c % 2 = 0
  union all select child, 'base/b' || (c % 30), case when c % 3 = 0 then 'quantized' when c % 4 = 0 then 'finetune' end, 'tag' from m where c % 5 = 0 union all select child, 'data/d' || (c % 10), 'trained_on', 'card' from m where c % 7 = 0)
  select child, parent, coalesce(max(case when declared_by = 'tag' then relation end), arg_min(relation, case when declared_by = 'card' then 0 else 1 end)) as relation, min(declared_by) as declared_by from e group by child, parent""")
def p21(spark, sf):
    c = F.col("c_custkey")
    one = lambda test, prefix, n: F.when(test, F.array(F.concat(F.lit(prefix), c % n))).otherwise(F.array().cast("array<string>"))
    tag = F.concat(F.lit("base_model:"), F.when(c % 3 == 0, "quantized:").otherwise(""), F.lit("base/b"), c % 30)
    m = spark.read.parquet(f"{sf}/customer.parquet").select(
        F.concat(F.lit("work"), c).alias("child"),
        one(c % 2 == 0, "base/b", 50).alias("card_parents"),
        F.when(c % 4 == 0, "finetune").alias("card_relation"),
        F.when(c % 5 == 0, F.array(F.lit("license:mit"), tag)).otherwise(F.array().cast("array<string>")).alias("tags"),
        one(c % 7 == 0, "data/d", 10).alias("card_datasets"),
    )
    return lineage.parents(m)


# findings

FOUND = DIFF + """, f as (select 'payload:' || left(sha256('payload' || chr(0) || aid || '/' || path), 10) as id, case when verdict = 'extra' then 'warning' else 'critical' end as severity, aid || '/' || path as path, verdict as summary from diff where verdict is not null)"""


def found(spark: SparkSession, sf: str) -> DataFrame:
    return findings.from_diff(integrity.integrity_diff(view(spark, sf, "inventory"), view(spark, sf, "observed")))


@query("q3_payload_findings", FOUND + " select id, 'payload' as check_id, severity, path, summary from f")
def q3(spark, sf):
    return found(spark, sf)


@query("a20_finding_report", FOUND + """ select cast(0 as bigint) as info, count(*) filter (severity = 'warning') as warning, count(*) filter (severity = 'critical') as critical, count(*) as findings,
  case when count(*) filter (severity = 'critical') > 0 then 'degraded' when count(*) > 0 then 'partial' else 'healthy' end as status from f""")
def a20(spark, sf):
    return findings.report(found(spark, sf))


@query("u5_findings_diff", FOUND + """, b as (select distinct id from f where length(path) % 3 <> 0), a as (select distinct id from f where length(path) % 3 <> 1) select coalesce(a.id, b.id) as id, case when b.id is null then 'new' when a.id is null then 'resolved' else 'persisting' end as state from b full join a on a.id = b.id""")
def u5(spark, sf):
    x = found(spark, sf)
    return findings.difference(x.where("length(path) % 3 <> 0"), x.where("length(path) % 3 <> 1"))


@query("f8_finding_selection", FOUND + " select id, severity from f where severity = 'critical'")
def f8(spark, sf):
    return findings.selected(found(spark, sf), only=["payload"], skip=["other"], least="critical").select("id", "severity")


@query("p17_redaction", "select doc_id, sha256(regexp_replace(text, '(?i)(token|password|secret|api[_-]?key)(\\s*[:=]\\s*)([^\\s,;]+)', '\\1\\2[redacted]', 'g')) as redacted from documents")
def p17(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.sha2(findings.redacted(F.col("text")), 256).alias("redacted"))


# transfers over time

STREAM = cte("stream") + ", o as (select *, case when kind in ('network', 'local') then bytes else 0 end as moved from stream)"


@query("st1_done_bytes", STREAM + ", d as (select event_id, aid, sum(moved) over (partition by aid order by ts, event_id rows unbounded preceding) as s from o) select event_id, aid, cast(least(s, 1000000) as bigint) as done from d")
def st1(spark, sf):
    e = view(spark, sf, "stream")
    return telemetry.batch_done(e, e.select("aid").distinct().withColumn("total", F.lit(1000000)), registry.cut)


@query("st2_window_rate", STREAM + """, c as (select *, sum(moved) over (partition by aid order by ts, event_id rows unbounded preceding) as s from o), r as (select event_id, aid, max(ts) over w - min(ts) over w as span, max(s) over w - min(s) over w as m from c window w as (partition by aid order by ts range between 36000 preceding and current row))
  select event_id, aid, case when span > 0 then cast(m // span as bigint) end as rate from r""")
def st2(spark, sf):
    return telemetry.batch_rate(view(spark, sf, "stream"), registry.cut, 36000)


@query("st7_retries", STREAM + ", i as (select *, sum(case when kind in ('network', 'local') then 1 else 0 end) over (partition by aid order by ts, event_id rows unbounded preceding) as island from o) select event_id, aid, cast(sum(case when kind = 'retry' then 1 else 0 end) over (partition by aid, island order by ts, event_id rows unbounded preceding) as bigint) as retries from i")
def st7(spark, sf):
    return telemetry.batch_retries(view(spark, sf, "stream"), registry.cut)


@query("st8_outages", STREAM + """, x as (select *, case when kind = 'retry' then 0 else 1 end as m from o where kind in ('retry', 'network', 'local')), i as (select *, coalesce(sum(m) over (partition by aid order by ts, event_id rows between unbounded preceding and 1 preceding), 0) as island from x)
  select aid, min(ts) filter (m = 0) as started, max(ts) filter (m = 1) as ended, max(ts) filter (m = 1) - min(ts) filter (m = 0) as seconds, count(*) filter (m = 0) as attempts from i group by aid, island having count(*) filter (m = 0) > 0""")
def st8(spark, sf):
    return telemetry.batch_outages(view(spark, sf, "stream"), registry.cut)


@query("st6_stalls", STREAM + """, l as (select aid, kind, ts, lead(ts) over (partition by aid order by ts, event_id) as after, sum(moved) over (partition by aid order by ts, event_id rows unbounded preceding) as done from o where kind in ('network', 'local', 'hash'))
  select aid, ts as quiet_from, after as quiet_to from l where kind <> 'hash' and done < 1200000 and after - ts >= 86400""")
def st6(spark, sf):
    return telemetry.batch_stalls(view(spark, sf, "stream").withColumn("total", F.lit(1_200_000)), registry.cut, 86400)


@query("st10_budget_alerts", STREAM + ", u as (select aid, ts, event_id, cast(sum(case when kind = 'network' then bytes else 0 end) over (partition by aid order by ts, event_id rows unbounded preceding) as bigint) as used from o) select aid, ts, event_id, used from u where used >= 50000 qualify row_number() over (partition by aid order by ts, event_id) = 1")
def st10(spark, sf):
    return telemetry.batch_budget_alerts(view(spark, sf, "stream"), 50000, registry.cut)


@query("st3_smoothed_rate", STREAM + """, c as (select *, sum(moved) over (partition by aid order by ts, event_id rows unbounded preceding) as s from o), r as (select event_id, aid, ts, max(ts) over w - min(ts) over w as span, max(s) over w - min(s) over w as m from c window w as (partition by aid order by ts range between 36000 preceding and current row))
  select aid, cast(floor(list_reduce(list(cast(m // span as double) order by ts, event_id), lambda a, b: 0.35::double * b + 0.65::double * a)) as bigint) as ema from r where span > 0 group by aid""")
def st3(spark, sf):
    return telemetry.batch_ema(view(spark, sf, "stream"), registry.cut, seconds=36000).select("aid", F.floor("ema").alias("ema"))


@query("st4_rollup", STREAM + ", h as (select aid, (ts // 3600) * 3600 as start, moved, kind from o) select aid, start, cast(sum(moved) as bigint) as bytes, count(*) as events, count(*) filter (kind = 'retry') as retries from h group by aid, start")
def st4(spark, sf):
    e = view(spark, sf, "stream").withColumn("at", F.timestamp_seconds("ts"))
    return telemetry.rollup(e, "1 hour").select("aid", F.unix_timestamp("start").alias("start"), "bytes", "events", "retries")


# rules and facts


RULES = (("en", "first", "*00001*", True, 0), ("en", "tens", "/en/0000?0.txt", False, 1), ("fr", "any", "*.txt", True, 0), ("de", "none", "*.gguf", True, 0))


def rule_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(RULES), "artifact_type string, label string, glob string, required boolean, ordinal int")


def typed(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "inventory").withColumn("artifact_type", F.substring_index("path", "/", 1))


TYPED = cte("inventory") + """, i as (select *, split_part(path, '/', 1) as artifact_type from inventory), r(artifact_type, label, pattern, required) as (values ('en', 'first', '.*00001.*', true), ('en', 'tens', 'en/0000.0[.]txt', false), ('fr', 'any', '.*[.]txt', true), ('de', 'none', '.*[.]gguf', true)),
  h as (select i.aid || i.artifact_type as aid, r.label, i.path from i join r on i.artifact_type = r.artifact_type and regexp_full_match(i.path, r.pattern)),
  w as (select distinct i.aid || i.artifact_type as aid, r.label, r.required from i left join r on i.artifact_type = r.artifact_type)"""


@query("f11_completeness", TYPED + """, p as (select w.aid, w.label, w.required, exists (select 1 from h where h.aid = w.aid and h.label = w.label) as present from w), s as (select aid, case when bool_and(label is null) then 'unknown' when bool_or(required and not present) then 'incomplete' else 'complete' end as status from p group by aid)
  select p.aid, p.label, p.required, p.present, s.status from p join s on p.aid = s.aid""")
def f11(spark, sf):
    rows = typed(spark, sf).withColumn("aid", F.concat("aid", "artifact_type"))
    return rules.completeness(rows, rule_table(spark)).drop("files")


@query("f13_declarations", TYPED + " select aid, label, count(distinct path) as files from h group by aid, label")
def f13(spark, sf):
    rows = typed(spark, sf).withColumn("aid", F.concat("aid", "artifact_type"))
    return rules.declarations(rows, rule_table(spark)).drop("paths")


@query("f10_lfs_routing", cte("inventory") + """, a as (select distinct source as aid, lang as dir, '*' || (n_chars % 10) || '.txt' as pattern from documents) select distinct i.aid, i.path from inventory i join a on i.aid = a.aid and i.path like a.dir || '/%' and i.path like replace('%' || a.pattern, '*', '%')""")
def f10(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    lines = d.select(F.col("source").alias("aid"), F.col("lang").alias("dir"), F.concat(F.lit("*"), F.col("n_chars") % 10, F.lit(".txt")).alias("pattern"))
    return rules.lfs_routed(view(spark, sf, "inventory").select("aid", "path"), lines)


@query("f9_changed_since", "select o_custkey as aid, max(o_orderdate) as newest from orders group by 1 having max(o_orderdate) >= timestamp '1998-01-01'")
def f9(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_custkey").alias("aid"), F.col("o_orderdate").alias("modified"))
    return rules.changed_since(o, F.expr("timestamp '1998-01-01'"))


@query("f19_runnable", cte("inventory") + """, m as (select aid, cast(sum(size) as bigint) as need from inventory group by aid), c as (select 'm' || n_nationkey as machine, n_nationkey * 20000 as ram_bytes from nation)
  select aid, machine, case when ram_bytes < need then 'error' when ram_bytes < need * 1.3 then 'warning' else 'ok' end as verdict from m, c""")
def f19(spark, sf):
    need = view(spark, sf, "inventory").groupBy("aid").agg(F.sum("size").alias("need"))
    machines = spark.read.parquet(f"{sf}/nation.parquet").select(F.concat(F.lit("m"), "n_nationkey").alias("machine"), (F.col("n_nationkey") * 20000).alias("ram_bytes"))
    return rules.runnable(need, machines)


@query("f21_weights_choice", GROUPS + """ select aid, case when bool_or(not complete) then 'refused' when count(*) filter (complete) = 1 then 'chosen' when count(*) filter (complete) = 0 then 'none' else 'ambiguous' end as outcome,
  case when count(*) filter (complete) = 1 and not bool_or(not complete) then max(variant) filter (complete) end as chosen from g group by aid""")
def f21(spark, sf):
    return rules.weights_choice(weights.gguf_groups(view(spark, sf, "shards"))).drop("candidates")


@query("p6_bytes_per_parameter", "select p_partkey, case when p_size > 0 and p_partkey % 5 > 0 then cast(round_even(p_size * 1.0 / (p_partkey % 5), 3) * 1000 as bigint) end as milli from part")
def p6(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet")
    return p.select("p_partkey", F.round(weights.bytes_per_parameter(F.col("p_size"), F.col("p_partkey") % 5) * 1000).cast("long").alias("milli"))


@query("p8_context_price", """select p_partkey, (r_regionkey + 1) * 1000 as tokens, cast(((p_size % 5) * (r_regionkey + 1) * 1000 + (p_size % 3) * least((r_regionkey + 1) * 1000, 4096)) * 8 * 128 * 2 * 2 as bigint) as bytes from part, region""")
def p8(spark, sf):
    contexts = rules.listed(spark.read.parquet(f"{sf}/region.parquet").select((F.col("r_regionkey") + 1) * 1000), "tokens")
    p = spark.read.parquet(f"{sf}/part.parquet").withColumn("tokens", F.explode(contexts))
    price = weights.context_bytes(F.col("p_size") % 5, F.col("p_size") % 3, F.lit(4096), F.lit(8), F.lit(128), F.lit(2), F.lit(2), F.col("tokens"))
    return p.select("p_partkey", "tokens", price.cast("long").alias("bytes"))


@query("p10_hints", """select p_partkey, concat_ws(',', case when p_size % 7 = 0 then 'gated' end, case when cast(p_size as bigint) * 1000000000 >= 21474836480 then 'large' end, case when p_size % 3 = 0 then 'quant' end, case when p_size * 100 >= 1.75 * p_partkey then 'redundant' end, case when p_size % 4 = 0 and p_size % 5 <> 0 then 'subset' end) as hints from part""")
def p10(spark, sf):
    s, n = F.col("p_size"), F.col("p_size").cast("long")
    include = F.when(s % 4 == 0, F.array(F.lit("*.x")))
    policy = F.when(s % 5 == 0, "weights")
    return spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", F.array_join(overlay.hints(s % 7 == 0, n * 1000000000, s % 3 == 0, F.col("p_partkey"), n * 100, include, policy), ",").alias("hints"))


@query("p22_p23_tags", """select p_partkey, case when p_size % 3 = 0 then 'lic' || p_size end as license, concat_ws(',', case when p_size % 2 = 0 then 'safetensors' end, case when p_size % 5 = 0 then 'gguf' end, case when p_size % 7 = 0 then 'awq' end) as formats from part""")
def p22(spark, sf):
    s = F.col("p_size")
    tags = F.array_compact(F.array(F.when(s % 2 == 0, F.lit("Safetensors")), F.when(s % 3 == 0, F.concat(F.lit("license:lic"), s)), F.when(s % 5 == 0, F.lit("gguf"))))
    name = F.when(s % 7 == 0, "x-AWQ").otherwise("x")
    return spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", enrich.license_of(tags).alias("license"), F.array_join(enrich.format_labels(tags, name), ",").alias("formats"))


@query("p35_access", "select p_partkey, case p_size % 4 when 0 then 'open' when 1 then 'gated' when 2 then 'manual' else 'open' end as access from part")
def p35(spark, sf):
    s = F.col("p_size") % 4
    return spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", enrich.access(F.when(s == 0, "false").when(s == 1, "True").when(s == 2, "Manual")).alias("access"))


@query("p27_phase", "select l_orderkey, l_linenumber, case when l_partkey % 11 = 0 then 'offline' when l_partkey % 7 = 0 then 'retrying' when l_partkey % 5 = 0 then 'verifying' when l_partkey % 3 = 0 then 'stalled' when l_partkey % 2 = 0 then 'starting' else 'downloading' end as phase, count(*) as n from lineitem group by all")
def p27(spark, sf):
    at = lambda n: F.col("l_partkey") % n == 0
    x = spark.read.parquet(f"{sf}/lineitem.parquet").withColumn("phase", enrich.phase(at(11), at(7), at(5), at(3), ~at(2)))
    return x.groupBy("l_orderkey", "l_linenumber", "phase").agg(F.count("*").alias("n"))


@query("p34_holdings", """with c as (select l_orderkey as aid, count(*) as files, count(*) filter (l_returnflag <> 'N' or l_linestatus = 'F') as done from lineitem group by 1) select aid, 'partial' as status, cast(done * 100 // files as bigint) as percent from c
  union all select o_orderkey + 10000000, 'registered', 100 from orders""")
def p34(spark, sf):
    plans = transfers.transfer_plan(view(spark, sf, "states").withColumn("partial", F.expr("size div 2")))
    registered = spark.read.parquet(f"{sf}/orders.parquet").select((F.col("o_orderkey") + 10000000).alias("aid"), F.col("o_orderkey").alias("payload_bytes"))
    return enrich.holdings(registered, plans).select("aid", "status", "percent")


@query("p38_relocated", """with h as (select o_custkey as aid, o_orderkey as ordinal, o_orderdate as done, o_orderpriority as location, case when o_orderkey % 10 = 0 then '' else 'h' || (o_orderkey % 2) end as h from orders), l as (select *, lag(location) over w as was, lag(h) over w as had, row_number() over w as r from h window w as (partition by aid order by done, ordinal))
  select aid, ordinal, was as relocated_from from l where r > 1 and (was <> location or h <> had or h = '')""")
def p38(spark, sf):
    k = F.col("o_orderkey")
    host = F.when(k % 10 == 0, "").otherwise(F.concat(F.when(k % 3 == 0, "H").otherwise("h"), k % 2, F.when(k % 4 == 0, ".lan").otherwise("")))
    o = spark.read.parquet(f"{sf}/orders.parquet")
    return enrich.relocated(o.select(F.col("o_custkey").alias("aid"), k.alias("ordinal"), F.col("o_orderdate").alias("done"), F.col("o_orderpriority").alias("location"), host.alias("host")))


@query("a25_replicas", """with c as (select o_custkey as aid, o_orderpriority as location, o_orderdate as done from orders where o_orderpriority <> '1-URGENT'), a as (select distinct o_custkey as aid from orders), l as (select aid, location, max(done) as latest from c group by 1, 2), n as (select aid, count(*) as copies, max(latest) as latest from l group by 1)
  select a.aid, coalesce(copies, 0) as copies, latest, case when copies > 0 then 'replicated' else 'single' end as backup_status from a left join n on a.aid = n.aid""")
def a25(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    return enrich.replicas(o.select(F.col("o_custkey").alias("aid"), F.col("o_orderpriority").alias("location"), F.lit("1-URGENT").alias("own_location"), F.col("o_orderdate").alias("at")))


@query("j7_board_entries", cte("entries") + " select e.k as row, m.k from entries e left join (select source, coalesce(revision, '') as r, min(k) as k from entries where k % 3 <> 0 group by all) m on e.source = m.source and coalesce(e.revision, '') = m.r")
def j7(spark, sf):
    e = view(spark, sf, "entries").withColumn("include", F.lit(None).cast("array<string>"))
    return overlay.board_entries(e.withColumnRenamed("k", "row"), e.where("k % 3 <> 0"))


@query("j20_resumable", cte("entries", "holdings") + """ select e.k as request, case count(h.o_orderkey) when 0 then 'none' when 1 then 'resume' else 'ambiguous' end as outcome from entries e left join (select * from holdings where part) h on e.source = h.source and (e.revision is null or e.revision = h.revision) group by e.k""")
def j20(spark, sf):
    partial = view(spark, sf, "holdings").where("part").select("source", "revision", F.lit("main").alias("ref"), F.col("o_orderkey").cast("string").alias("path"))
    return overlay.resumable(view(spark, sf, "entries").select(F.col("k").alias("request"), "source", "revision"), partial).drop("paths")


@query("j22_scope_fit", """select o_orderkey as request, case when o_orderkey % 4 = 0 then 'new' when o_orderkey % 3 = 0 then 'same' when o_orderkey % 2 = 0 and o_custkey % 2 = 0 then 'policy' else 'other selection' end as outcome from orders""")
def j22(spark, sf):
    k = F.col("o_orderkey")
    o = spark.read.parquet(f"{sf}/orders.parquet")
    none, star = F.array().cast("array<string>"), F.array(F.lit("b"), F.lit("a"))
    wanted = F.when(k % 3 == 0, F.array(F.lit("a"), F.lit("b"), F.lit("a"))).when(k % 2 == 0, none).otherwise(F.array(F.lit("z")))
    pins = o.where("o_orderkey % 4 <> 0").select(k.alias("aid"), star.alias("include"), (F.col("o_custkey") % 2 == 0).alias("policy"))
    return overlay.scope_fit(o.select(k.alias("request"), k.alias("aid"), wanted.alias("include")), pins)


@query("j10_reusable", """with i as (select doc_id, source as aid, lang as src, sha256(text) as s, strlen(text) as size from documents), p as (select * from i where doc_id % 2 = 0), h as (select distinct src, s, aid from i where doc_id % 3 <> 0)
  select aid, count(*) as files, cast(sum(size) as bigint) as bytes from (select distinct p.doc_id, p.aid, p.size from p join h on p.src = h.src and p.s = h.s and p.aid <> h.aid) group by aid""")
def j10(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    i = d.select("doc_id", F.col("source").alias("aid"), F.col("lang").alias("source"), F.lit("t").alias("artifact_type"), F.sha2("text", 256).alias("sha256"), F.octet_length("text").alias("size"), F.col("doc_id").cast("string").alias("path"))
    return overlay.reusable(i.where("doc_id % 2 = 0"), i.withColumn("verified", F.col("doc_id") % 3 != 0))


@query("t7_top_variants", "select p_brand as parent, p_partkey as child, cast(p_size as bigint) as downloads from part qualify row_number() over (partition by p_brand order by p_size desc, p_partkey) <= 10")
def t7(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_brand").alias("parent"), F.col("p_partkey").alias("child"), F.col("p_size").cast("long").alias("downloads"))
    return overlay.top_variants(p).drop("n")


@query("q4_hash_list", cte("inventory") + ", o as (select aid, doc_id, case when doc_id % 97 = 0 then sha256(sha256) else sha256 end as s, sha256, path from inventory) select aid, string_agg(sha256 || path, '' order by path) = string_agg(s || path, '' order by path) as agrees from o group by aid")
def q4(spark, sf):
    inventory = view(spark, sf, "inventory")
    other = inventory.withColumn("sha256", F.when(F.col("doc_id") % 97 == 0, F.sha2("sha256", 256)).otherwise(F.col("sha256")))
    stored = integrity.artifact_hash(other).withColumnRenamed("artifact_sha256", "stored")
    return integrity.artifact_hash(inventory).join(stored, "aid").select("aid", (F.col("artifact_sha256") == F.col("stored")).alias("agrees"))


@query("st_live_rollup", STREAM + ", h as (select aid, (ts // 3600) * 3600 as start, moved, kind, ts from o), m as (select max(ts) as top from o) select aid, start, cast(sum(moved) as bigint) as bytes, count(*) as events, count(*) filter (kind = 'retry') as retries from h, m where start + 3600 <= top - 31 group by aid, start")
def st_live(spark, sf):
    """The hourly roll-up as a stream that is drained; windows that the watermark hasn't passed stay open."""
    live = telemetry.rollup(telemetry.event_stream(spark, f"{sf}/events.parquet"), "1 hour")
    out = telemetry.drained(live, registry.shared_path(spark, "live"))
    return out.select("aid", F.unix_timestamp("start").alias("start"), "bytes", "events", "retries")
