"""Sources, sinks and records: texts, headers and lists that Spark makes from the tables, stored and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockroom.operators import findings, integrity, records
from stockroom.plans.derive import cte, view
from stockroom.plans.registry import query, shared_path
from stockroom.sources import headers, ranged, scans


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def pick(values: tuple, at) -> F.Column:
    return F.get(F.array(*map(F.lit, values)), at.cast("int"))


# manifests, ledgers, want-lists, listings

MANIFESTS = """with m as (select s_suppkey as k, case when s_suppkey % 5 = 0 then 'v/_trash/r' || s_suppkey || '/manifest.json' else 'v/s' || s_nationkey || '/r' || s_suppkey || '/manifest.json' end as file,
  case when s_suppkey % 7 = 0 then 'unreadable' when s_suppkey % 4 = 0 then 'migrate' when s_suppkey % 4 = 3 then 'unsupported' else 'current' end as standing from supplier), n as (select * from m where k % 5 <> 0)"""


def manifests(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    entry = F.struct(F.concat(F.lit("b"), k).alias("path"), k.alias("size"), F.sha2(k.cast("string"), 256).alias("sha256"))
    record = F.to_json(F.struct(pick(("1.8.0", "2.1.0", "2.0.0", "3.0.0"), k % 4).alias("schema_version"), F.concat(F.lit("b"), k).alias("bundle_id"), F.struct(F.array(entry, F.struct(F.lit("x").alias("path"), F.lit(None).cast("long").alias("size"), F.lit(None).cast("string").alias("sha256"))).alias("files")).alias("inventory")))
    file = F.when(k % 5 == 0, F.concat(F.lit("v/_trash/r"), k, F.lit("/manifest.json"))).otherwise(F.concat(F.lit("v/s"), "s_nationkey", F.lit("/r"), k, F.lit("/manifest.json")))
    rows = table(spark, sf, "supplier").select(file.alias("file"), F.when(k % 7 == 0, "{broken").otherwise(record).alias("text"))
    return scans.standing(scans.parsed(rows, scans.MANIFEST))


@query("s1_manifests", MANIFESTS + " select file, standing from n")
def s1(spark, sf):
    return manifests(spark, sf).select("file", "standing")


@query("s1_inventory", MANIFESTS + " select 'b' || k as aid, 'b' || k as path, k as size, sha256(cast(k as varchar)) as sha256 from n where standing = 'current' union all select 'b' || k, 'x', null, null from n where standing = 'current'")
def s1_inventory(spark, sf):
    return scans.inventory(manifests(spark, sf)).select("aid", "path", "size", "sha256")


@query("q1_manifest_findings", MANIFESTS + " select 'manifest:' || left(sha256('manifest' || chr(0) || file), 10) as id, case standing when 'migrate' then 'warning' else 'critical' end as severity, file as path, standing as summary from n where standing <> 'current'")
def q1(spark, sf):
    return findings.from_manifests(manifests(spark, sf)).drop("check_id")


REPORT = MANIFESTS + """, b as (select source as aid, concat(lang, '/', lpad(cast(doc_id as varchar), 6, '0'), '.txt') as path, doc_id from documents), u as (select aid || '/' || case when doc_id % 9 = 0 then '/' || path else 'a/../' || path end as path from b where doc_id % 9 in (0, 1)),
  e as (select 'manifest' as check_id, case standing when 'migrate' then 'warning' else 'critical' end as severity, file as path from n where standing <> 'current' union all select 'paths', 'critical', path from u),
  f as (select check_id || ':' || left(sha256(check_id || chr(0) || path), 10) as id, check_id, severity, path from e)"""


def every_finding(spark: SparkSession, sf: str) -> DataFrame:
    at = F.col("doc_id") % 9
    unsafe = view(spark, sf, "inventory").where(at.isin(0, 1)).select("aid", F.concat(F.when(at == 0, "/").otherwise("a/../"), "path").alias("path"))
    return findings.assembled(findings.from_manifests(manifests(spark, sf)), findings.from_paths(unsafe), least="warning")


@query("q5_report", REPORT + " select id, check_id, severity, path from f")
def q5(spark, sf):
    return every_finding(spark, sf).drop("summary")


@query("t9_finding_order", REPORT + " select check_id, path, lag(path) over (partition by check_id order by path, id) as before from f")
def t9(spark, sf):
    """Each finding with the one listed before it: the listing's sort, checked row by row in every check."""
    from pyspark.sql.window import Window

    rows = findings.ordered(every_finding(spark, sf))
    return rows.select("check_id", "path", F.lag("path").over(Window.partitionBy("check_id").orderBy("path", "id")).alias("before"))


@query("s2_ledgers", cte("states") + """, p as (select s.*, row_number() over (partition by aid order by path) as r from states s join orders on o_orderkey = aid where o_orderstatus <> 'F')
  select 'o' || aid as aid, 'f' || path as path, size, status, case when status = 'partial' then size // 2 else 0 end as partial from p""")
def s2(spark, sf):
    """Ledgers without a manifest beside them, as states of the files that they expect."""
    x = view(spark, sf, "states").withColumn("path", F.concat(F.lit("f"), "path"))
    told = F.map_from_entries(F.collect_list(F.when(F.col("status") != "missing", F.struct("path", F.struct("status", F.when(F.col("status") == "partial", F.expr("size div 2")).alias("partial"))))))
    ledgers = x.groupBy("aid").agg(F.collect_list(F.struct("path", "size")).alias("expected"), told.alias("files"))
    folder = F.concat(F.lit("v/o"), "aid")
    text = F.to_json(F.struct(F.lit(1).alias("version"), F.struct(F.concat(F.lit("o"), "aid").alias("canonical")).alias("source"), "expected", "files"))
    rows = scans.parsed(ledgers.select(F.concat(folder, F.lit("/transfer.json")).alias("file"), text.alias("text")), scans.LEDGER)
    done = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.concat(F.lit("v/o"), "o_orderkey", F.lit("/manifest.json")).alias("file"))
    return scans.ledger_states(scans.partials(rows, done))


@query("s3_catalog_entries", """with e as (select case when c_nationkey % 6 = 0 then 'Bad ' else 'cat-' end || c_nationkey as catalog_id, case when c_custkey % 17 = 0 then ' ' else 'o/m' || c_custkey end as source, c_custkey % 11 as desire, c_custkey % 19 = 0 as blank, c_custkey % 13 = 0 as free, c_nationkey from customer where c_nationkey <> 3)
  select catalog_id, source, case when c_nationkey % 6 = 0 then 'catalog id' when source = ' ' then 'source' when not free and desire not between 1 and 9 then 'desire' when blank then 'include' end as reason from e""")
def s3(spark, sf):
    """Entries of want-lists, good ones and rejects with their reason; an unreadable list brings none."""
    k, nation = F.col("c_custkey"), F.col("c_nationkey")
    entry = F.struct(F.when(k % 17 == 0, " ").otherwise(F.concat(F.lit("o/m"), k)).alias("source"), F.when(k % 13 != 0, k % 11).alias("desire"), F.when(k % 19 == 0, F.array(F.lit("*.x"), F.lit(""))).alias("include"))
    lists = table(spark, sf, "customer").groupBy("c_nationkey").agg(F.sort_array(F.collect_list(F.struct(k, entry.alias("e")))).alias("s"))
    text = F.to_json(F.struct(F.concat(F.when(nation % 6 == 0, "Bad ").otherwise("cat-"), nation).alias("id"), F.transform("s", lambda x: x.e).alias("entries")))
    rows = lists.select(F.concat(F.lit("c/"), nation, F.lit(".json")).alias("file"), F.when(nation == 3, "[1").otherwise(text).alias("text"))
    good, bad = scans.catalog_entries(scans.parsed(rows, scans.CATALOG))
    return good.withColumn("reason", F.lit(None).cast("string")).unionByName(bad).select("catalog_id", "source", "reason")


@query("s5_snapshots", cte("inventory") + " select aid, path, size, case when size > 2000 then sha256 end as sha256, case when size <= 2000 then sha1(sha256) end as git_sha1 from inventory")
def s5(spark, sf):
    big = F.col("size") > 2000
    one = F.struct("path", F.when(~big, F.col("size")).alias("size"), F.when(~big, F.sha1("sha256")).otherwise("0").alias("blob_id"), F.when(big, F.struct("sha256", "size")).alias("lfs"))
    text = F.to_json(F.struct("source", F.lit("r").alias("revision"), "files"))
    listings = view(spark, sf, "inventory").groupBy(F.col("aid").alias("source"), (F.col("doc_id") % 64).alias("page")).agg(F.collect_list(one).alias("files"))
    rows = scans.parsed(listings.select(F.concat_ws("/", "source", "page").alias("file"), text.alias("text")), scans.SNAPSHOT)
    return scans.snapshot_inventory(rows).drop("revision")


@query("s11_loose_manifests", "select case when s_suppkey % 3 = 0 then 'v/loose' else 'v/x' end || (s_suppkey % 10) || '/deep/r' || s_suppkey || '/manifest.json' as file from supplier where s_suppkey % 3 = 0 or s_suppkey % 10 not in (1, 2, 4)")
def s11(spark, sf):
    """Manifests inside no registered folder; `v/x1` doesn't hold `v/x10`."""
    k = F.col("s_suppkey")
    s = table(spark, sf, "supplier")
    rows = s.select(F.concat(F.when(k % 3 == 0, "v/loose").otherwise("v/x"), k % 10, F.lit("/deep/r"), k, F.lit("/manifest.json")).alias("file"))
    registered = s.where("s_suppkey % 10 in (1, 2, 4)").select(F.concat(F.lit("v/x"), k % 10).alias("folder"))
    return scans.loose_manifests(rows, registered)


@query("s13_runs", """select case when s_suppkey % 4 = 0 then 'r' || s_suppkey else 'run-' || s_suppkey end as run_id, case when s_suppkey % 4 = 0 or s_suppkey % 6 = 1 then 'incomplete' else 'complete' end as status, case when s_suppkey % 4 <> 0 then 'check' end as command from supplier""")
def s13(spark, sf):
    k = F.col("s_suppkey")
    text = F.to_json(F.struct(F.concat(F.lit("run-"), k).alias("run_id"), F.lit("check").alias("command"), F.when(k % 6 != 1, "complete").alias("status")))
    rows = table(spark, sf, "supplier").select(F.concat(F.lit("runs/r"), k, F.lit("/report.json")).alias("file"), F.when(k % 4 == 0, "{cut").otherwise(text).alias("text"))
    return scans.runs(rows).drop("created")


# files that are written and read back


@query("s4_s9_hash_lists", cte("inventory") + " select aid, cast(sum(strlen(path) + 67) as bigint) as size, sha256(string_agg(sha256 || '  ' || path, chr(10) order by path) || chr(10)) as sha256 from inventory group by aid")
def s4(spark, sf):
    """Hash lists written as one text for each artifact; the tree is then read as payload: sizes and digests of its files."""
    at = shared_path(spark, "lists")
    scans.write_hash_lists(view(spark, sf, "inventory"), at)
    listed = scans.payload_listing(spark, at).select("path", F.col("length").alias("listed"))
    rows = scans.payload_digests(spark, at).join(listed, "path").where("path like '%.txt' and size = listed")
    return rows.select(F.regexp_extract("path", "/aid=([^/]+)/", 1).alias("aid"), "size", "sha256")


@query("s8_history", "select o_custkey as aid, o_orderkey as ordinal, o_orderdate as at from orders qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) <= 3")
def s8(spark, sf):
    """Two appends to a history, and the last three rows of each artifact in it."""
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("aid"), F.col("o_orderkey").alias("ordinal"), F.col("o_orderdate").alias("at"))
    at = shared_path(spark, "history")
    for part in ("ordinal % 2 = 0", "ordinal % 2 = 1"):
        scans.append_history(o.where(part), at, "year")
    return scans.latest_of(spark.read.parquet(at).drop("year"), 3, "ordinal")


@query("s12_session_log", cte("sessions") + " select aid, count(*) as sessions, cast(sum(bytes) as bigint) as bytes from sessions group by aid")
def s12(spark, sf):
    """Sessions appended to a log that a stream reads."""
    from stockroom.streaming import telemetry

    at = shared_path(spark, "sessions")
    rows = view(spark, sf, "sessions").withColumn("at", F.timestamp_seconds("started"))
    scans.append_history(rows, at, "year")
    log = spark.readStream.schema(spark.read.parquet(at).schema).parquet(at)
    out = telemetry.drained(log.select("aid", "bytes"), shared_path(spark, "seen"))
    return out.groupBy("aid").agg(F.count("*").alias("sessions"), F.sum("bytes").alias("bytes"))


@query("s10_catalog_json", cte("entries") + """, j as (select catalog_id, k, '{"source":"' || source || '"' || case when revision is null then '' else ',"revision":"' || revision || '"' end || case when desire is null then '' else ',"desire":' || desire end || ',"note":"' || note || '"}' as t from entries)
  select catalog_id, sha256('{"schema_version":"3.0.0","id":"' || catalog_id || '","entries":[' || string_agg(t, ',' order by k) || ']}') as sha256 from j group by catalog_id""")
def s10(spark, sf):
    return scans.catalog_json(view(spark, sf, "entries")).select("catalog_id", F.sha2("value", 256).alias("sha256"))


def little(n, size: int) -> F.Column:
    """A number under 256 as little-endian bytes."""
    return F.unhex(F.concat(F.lpad(F.hex(n.cast("long")), 2, "0"), F.lit("00" * (size - 1))))


@query("s6_tensor_headers", """select p_partkey as path, 't' || x as tensor, case when p_size % 2 = 0 then 'F16' else 'BF16' end as dtype, cast(p_size + x as varchar) || ',3' as shape, cast(null as varchar) as error from part, (values (1), (2)) v(x) where p_partkey % 6 not in (0, 1) union all
  select p_partkey, null, null, null, case p_partkey % 6 when 0 then 'truncated' else 'no JSON' end from part where p_partkey % 6 in (0, 1)""")
def s6(spark, sf):
    k, size = F.col("p_partkey"), F.col("p_size")
    one = lambda x: F.struct(F.when(size % 2 == 0, "F16").otherwise("BF16").alias("dtype"), F.array(size + x, F.lit(3)).alias("shape"))
    text = F.when(k % 6 == 1, "{cut").otherwise(F.to_json(F.create_map(F.lit("t1"), one(1), F.lit("t2"), one(2))))
    raw = F.encode(text, "utf-8")
    content = F.concat(little(F.length(raw), 8), raw, F.unhex(F.lit("0000")))
    rows = table(spark, sf, "part").select(k.alias("path"), F.when(k % 6 == 0, F.substring(content, 1, 20)).otherwise(content).alias("content"))
    return headers.tensors_of(rows).withColumn("shape", F.array_join("shape", ","))


@query("s7_key_values", """select cast(p_partkey as varchar) as path, 'general.name' as key, p_type as value, cast(null as varchar) as error from part where p_partkey % 5 <> 0 union all select cast(p_partkey as varchar), 'n', cast(p_size as varchar), null from part where p_partkey % 5 > 1
  union all select cast(p_partkey as varchar), 'list', 'array(4, 2)', null from part where p_partkey % 5 > 1 union all select cast(p_partkey as varchar), null, null, case p_partkey % 5 when 0 then 'no such header' else 'truncated' end from part where p_partkey % 5 < 2""")
def s7(spark, sf):
    k = F.col("p_partkey")
    text = lambda x: F.concat(little(F.length(F.encode(x, "utf-8")), 8), F.encode(x, "utf-8"))
    pair = lambda name, kind, *more: F.concat(text(F.lit(name)), little(F.lit(kind), 4), *more)
    start = F.concat(F.encode(F.when(k % 5 == 0, "nope").otherwise("GGUF"), "utf-8"), little(F.lit(3), 4), little(F.lit(0), 8), little(F.lit(3), 8), pair("general.name", 8, text(F.col("p_type"))))
    whole = F.concat(start, pair("n", 4, little(F.col("p_size"), 4)), pair("list", 9, little(F.lit(4), 4), little(F.lit(2), 8), little(F.lit(1), 4), little(F.lit(2), 4)))
    rows = table(spark, sf, "part").select(k.cast("string").alias("path"), F.when(k % 5 == 1, start).otherwise(whole).alias("content"))
    return headers.key_values_of(rows).drop("type")


# files that Spark writes from the tables and reads back in ranges


@query("s4_digests", """select source || '/' || (doc_id // 20) || '.txt' as path, cast(strlen(string_agg(text, chr(10) order by doc_id)) as bigint) as size, sha256(string_agg(text, chr(10) order by doc_id)) as sha256,
  sha1('blob ' || strlen(string_agg(text, chr(10) order by doc_id)) || chr(0) || string_agg(text, chr(10) order by doc_id)) as git_sha1 from documents where (doc_id // 20) % 7 <> 3 group by source, doc_id // 20""")
def s4_digests(spark, sf):
    """Texts written as files, and digests of a tree that holds them, with those that a filter leaves out never opened."""
    group = F.floor(F.col("doc_id") / 20)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "text"))), lambda x: x.text), "\n")
    rows = table(spark, sf, "documents").groupBy("source", group.alias("g")).agg(text.alias("text"))
    name = F.concat(F.when(F.col("g") % 7 == 3, "skipped/").otherwise(""), "source", F.lit("/"), "g", F.lit(".txt"))
    at = shared_path(spark, "payload")
    ranged.write_files(rows.select(name.alias("path"), F.encode("text", "utf-8").alias("content")), at)
    return ranged.digests(spark, at).where(~F.col("path").startswith("skipped/") & (F.col("size") > 0)).select("path", "size", "sha256", "git_sha1")


@query("f22_s4_listed_digests", """select 'p' || p_partkey as path, cast(p_size % 5 as bigint) as size, case when p_partkey % 4 = 0 then null else sha256(repeat('x', p_size % 5)) end as sha256, p_partkey % 4 = 0 as unread from part where p_partkey % 3 > 0""")
def f22_s4(spark, sf):
    """The files that still need a digest are read, and no others; one in four has another size than was listed."""
    k, n = F.col("p_partkey"), (F.col("p_size") % 5).cast("long")
    rows = table(spark, sf, "part").select(F.lit("a").alias("aid"), F.concat(F.lit("p"), k).alias("path"), n.alias("size"), k.alias("k"))
    at = shared_path(spark, "payload")
    content = F.concat(F.repeat(F.lit("x"), F.col("size").cast("int")), F.when(F.col("k") % 4 == 0, "more").otherwise(""))
    ranged.write_files(rows.select("path", F.encode(content, "utf-8").alias("content")), at)
    need = integrity.files_to_hash(rows, rows, rows.where("k % 3 = 0")).join(rows.select("path", "size"), "path")
    return ranged.listed_digests(need.select("path", "size"), at).select("path", "size", "sha256", F.col("error").isNotNull().alias("unread"))


@query("s6_tensor_files", """select p_brand || '/' || p_type || '.safetensors' as path, 't' || p_partkey as tensor, case when p_size % 2 = 0 then 'F16' else 'BF16' end as dtype, p_size || ',3' as shape, cast(null as varchar) as error from part where length(p_type) % 3 > 0
  union all select distinct p_brand || '/' || p_type || '.safetensors', null, null, null, 'truncated' from part where length(p_type) % 3 = 0""")
def s6_files(spark, sf):
    """Headers of weight files, one for each brand and type, of which some are cut."""
    one = F.struct(F.when(F.col("p_size") % 2 == 0, "F16").otherwise("BF16").alias("dtype"), F.array(F.col("p_size"), F.lit(3)).alias("shape"))
    tensors = F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("t"), "p_partkey"), one)))
    text = F.encode(F.to_json(tensors), "utf-8")
    size = F.unhex(F.concat(*(F.substring(F.lpad(F.hex(F.length(text)), 16, "0"), k, 2) for k in range(15, 0, -2))))
    content = F.concat(size, text, F.unhex(F.lit("00" * 64)))
    cut = F.length("p_type") % 3 == 0
    rows = table(spark, sf, "part").groupBy("p_brand", "p_type").agg(F.when(F.first(cut), F.substring(content, 1, 20)).otherwise(content).alias("content"))
    at = shared_path(spark, "weights")
    ranged.write_files(rows.select(F.concat_ws("/", "p_brand", F.concat("p_type", F.lit(".safetensors"))).alias("path"), "content"), at)
    return headers.tensors(spark, at).select("path", "tensor", "dtype", F.array_join("shape", ",").alias("shape"), "error")


@query("s7_key_value_files", """with f as (select p_brand, count(*) as n, max(p_size) as most, sum(p_size) as total from part group by p_brand), g as (select p_brand || '.gguf' as path, right(p_brand, 1) as d, n, most, total from f)
  select path, 'general.name' as key, path as value, cast(null as varchar) as error from g where d <> '1' union all select path, 'scores', 'array(6, ' || n || ')', null from g where d not in ('1', '2') union all select path, 'words', 'array(8, ' || n || ')', null from g where d not in ('1', '2')
  union all select path, 'most', cast(most as varchar), null from g where d not in ('1', '2') union all select path, null, null, case d when '1' then 'no such header' else 'truncated' end from g where d in ('1', '2')""")
def s7_files(spark, sf):
    """Key-value headers, one file for each brand, with arrays over which the source seeks; some are cut, some no such files."""
    number = lambda n, size: F.unhex(F.concat(*(F.substring(F.lpad(F.hex(n), 2 * size, "0"), k, 2) for k in range(2 * size - 1, 0, -2))))
    text = lambda x: F.concat(number(F.octet_length(x), 8), F.encode(x, "utf-8"))
    pair = lambda name, kind, *more: F.concat(text(F.lit(name)), number(F.lit(kind), 4), *more)
    path, n = F.concat("p_brand", F.lit(".gguf")), F.col("n")
    rows = table(spark, sf, "part").groupBy("p_brand").agg(F.count("*").alias("n"), F.max("p_size").alias("most"), F.array_join(F.collect_list(F.hex(text(F.col("p_type")))), "").alias("words"))
    d = F.right("p_brand", F.lit(1))
    start = F.concat(F.encode(F.when(d == "1", "nope").otherwise("GGUF"), "utf-8"), number(F.lit(3), 4), number(F.lit(0), 8), number(F.lit(4), 8), pair("general.name", 8, text(path)))
    scores = pair("scores", 9, number(F.lit(6), 4), number(n, 8), F.unhex(F.repeat(F.lit("0000803f"), n.cast("int"))))
    whole = F.concat(start, scores, pair("words", 9, number(F.lit(8), 4), number(n, 8), F.unhex("words")), pair("most", 4, number(F.col("most"), 4)))
    at = shared_path(spark, "weights")
    ranged.write_files(rows.select(path.alias("path"), F.when(d == "2", start).otherwise(whole).alias("content")), at)
    return headers.key_values(spark, at).select("path", "key", "value", "error")


@query("a17_payload_rows", """with o as (select o_custkey % 24 as a, o_orderkey from orders), b as (select * from (values (3, 'no footer'), (5, 'too small')) v(a, why))
  select 'a=' || o.a as aid, cast(case when o.a % 8 <> 7 then count(*) end as bigint) as rows, case when o.a % 8 = 7 then 'skipped' when b.a is null then 'measured' else 'partial' end as status,
    case when o.a % 8 = 7 then 'a=' || o.a || '/b.parquet: no footer' when b.a is null then '' else 'a=' || o.a || '/b.parquet: ' || b.why end as errors from o left join b on o.a % 8 = b.a group by o.a, b.a, b.why""")
def a17_payload(spark, sf):
    """Rows of payloads from their footers: Parquet written by Spark, with broken files beside it or alone."""
    o = table(spark, sf, "orders").withColumn("a", F.col("o_custkey") % 24)
    at = shared_path(spark, "payload")
    o.where("a % 8 <> 7").select("a", "o_orderkey").write.partitionBy("a").parquet(at)
    why = F.col("a") % 8
    bad = o.where(why.isin(3, 5, 7)).select("a").distinct().select(F.concat(F.lit("a="), "a", F.lit("/b.parquet")).alias("path"), F.encode(F.when(why == 5, "PAR1").otherwise("PAR1 and no more PAR1"), "utf-8").alias("content"))
    ranged.write_files(bad, at)
    found = headers.footers(spark, at).withColumn("aid", F.regexp_extract("path", "^([^/]+)/", 1))
    out = scans.measured_rows(found.where("error is null").select("path", "rows"), found.select("aid", "path", F.col("error").alias("verdict")))
    return out.select("aid", "rows", "status", F.array_join("errors", ",").alias("errors"))


@query("p25_lfs_pointers", """select 'p' || p_partkey as path, sha256(cast(p_partkey as varchar)) as oid, cast(p_size * 1000 as bigint) as size from part where p_partkey % 3 <> 0 and p_partkey % 7 <> 0""")
def p25(spark, sf):
    k = F.col("p_partkey")
    text = F.concat(F.when(k % 3 == 0, "other\n").otherwise("version https://git-lfs.github.com/spec/v1\n"), F.lit("oid sha256:"), F.sha2(k.cast("string"), 256), F.lit("\nsize "), F.col("p_size") * 1000, F.lit("\n"), F.when(k % 7 == 0, F.repeat(F.lit("x"), 1024)).otherwise(""))
    content = F.encode(text, "utf-8")
    return scans.pointers(table(spark, sf, "part").select(F.concat(F.lit("p"), k).alias("path"), F.length(content).alias("length"), content.alias("content")))


@query("a17_measured_rows", """with d as (select o_custkey as aid, o_orderkey % 4 = 0 as bad, o_orderkey % 9 as n, o_orderkey from orders), e as (select aid, string_agg('d' || lpad(cast(o_orderkey as varchar), 9, '0') || ': malformed', ',' order by 'd' || lpad(cast(o_orderkey as varchar), 9, '0')) as errors from (select *, row_number() over (partition by aid order by o_orderkey) as r from d where bad) where r <= 10 group by aid)
  select d.aid, cast(sum(case when not bad then n end) as bigint) as rows, count(*) filter (not bad) as files, coalesce(any_value(e.errors), '') as errors, case when not bool_or(bad) then 'measured' when bool_or(not bad) then 'partial' else 'skipped' end as status from d left join e on d.aid = e.aid group by d.aid""")
def a17(spark, sf):
    o = table(spark, sf, "orders").withColumn("path", F.concat(F.lit("d"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0")))
    bad = F.col("o_orderkey") % 4 == 0
    counts = o.where(~bad).select("path", (F.col("o_orderkey") % 9).alias("rows"))
    heads = o.select(F.col("o_custkey").alias("aid"), "path", F.when(bad, "malformed").otherwise("ok").alias("verdict"))
    return scans.measured_rows(counts, heads).withColumn("errors", F.array_join("errors", ","))


# records put together


@query("p12_estimate_digest", """select p_partkey as k, p_size * 1000 as total_bytes, concat_ws(',', 'base/' || p_brand, case when p_size % 2 = 0 then 'x' end) as parents, cast(null as varchar) as license from part""")
def p12(spark, sf):
    size = F.col("p_size")
    parents = F.array(F.concat(F.lit("base/"), "p_brand"), F.lit(""), F.when(size % 2 == 0, "x"), F.concat(F.lit("base/"), "p_brand"))
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("k"), (size * 1000).alias("total_bytes"), parents.alias("parents"))
    return records.estimate_digest(rows, "k").select("k", "estimate.total_bytes", F.array_join("estimate.parents", ",").alias("parents"), "estimate.license")


@query("p15_vault_rows", """select l_orderkey as source, case when count(*) filter (l_returnflag = 'A') = count(*) then 'have' else 'partial' end as status, cast(case when count(*) filter (l_returnflag = 'A') = count(*) then 0 else count(*) filter (l_returnflag <> 'A') end as bigint) as remaining, count(*) as on_disk from lineitem group by 1""")
def p15(spark, sf):
    held = F.col("l_returnflag") == "A"
    x = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("aid")).agg(F.when(F.bool_and(held), "registered").otherwise("partial").alias("status"), F.count_if(~held).alias("remaining_bytes"), F.count("*").alias("payload_bytes"))
    return records.vault_rows(x).drop("desire")


COMPLETED = cte("states") + ", r as (select aid from states group by aid having count(*) filter (status <> 'verified') = 0)"


@query("p19_completed_records", COMPLETED + " select s.aid, s.path, s.size, sha256(cast(s.size as varchar)) as sha256, case when s.size % 3 = 0 then null else s.size % 3 = 1 end as verified_against_upstream from states s join r on s.aid = r.aid")
def p19(spark, sf):
    x = view(spark, sf, "states")
    size = F.col("size")
    told = F.when(size % 3 == 1, F.sha2(size.cast("string"), 256)).when(size % 3 == 2, "other")
    ok = integrity.upstream_verdict(F.sha2(size.cast("string"), 256), told, F.lit(None), F.lit(None))
    return records.completed_records(x.drop("status"), x.select("aid", "path", "status", F.sha2(size.cast("string"), 256).alias("sha256"), ok.alias("upstream_ok")))[0]


@query("p19_refused", cte("states") + " select aid, count(*) filter (status <> 'verified') as unverified from states group by aid having count(*) filter (status <> 'verified') > 0")
def p19_refused(spark, sf):
    x = view(spark, sf, "states")
    return records.completed_records(x.drop("status"), x.select("aid", "path", "status", F.lit("").alias("sha256"), F.lit(None).cast("boolean").alias("upstream_ok")))[1]


@query("p32_code_record", cte("inventory") + """, b as (select aid, count(*) as n from inventory where path like '%0.txt' group by aid), f as (select source as tree, count(distinct lang) as n from documents group by 1)
  select 's' || n_nationkey as aid, n_name as description, coalesce(b.n, 0) as build_files, coalesce(f.n, 0) as refs from nation left join b on b.aid = 'src' || n_nationkey left join f on f.tree = 'src' || n_nationkey""")
def p32(spark, sf):
    repository = table(spark, sf, "nation").select(F.concat(F.lit("src"), "n_nationkey").alias("aid"), F.col("n_name").alias("description"))
    build = view(spark, sf, "inventory").where("path like '%0.txt'").groupBy("aid").agg(F.lit("tens").alias("label"), F.count("*").alias("files"))
    refs = table(spark, sf, "documents").groupBy(F.col("source").alias("tree"), F.col("lang").alias("ref")).agg(F.count("*").alias("occurrences")).withColumns({"kind": F.lit("hub"), "tier": F.lit("declared")})
    out = records.code_record(repository, build, refs)
    return out.select(F.regexp_replace("aid", "src", "s").alias("aid"), "description", F.coalesce(F.col("runtime")["tens"], F.lit(0)).alias("build_files"), F.coalesce(F.size("references"), F.lit(0)).cast("long").alias("refs"))


@query("p33_bundle_records", cte("inventory") + """, i as (select aid, count(*) as files, cast(sum(size) as bigint) as total_bytes, sha256(string_agg(sha256 || '  ' || path, chr(10) order by path) || chr(10)) as artifact_sha256 from inventory group by aid)
  select aid, aid || '@' || left(sha256(aid), 12) as bundle_id, files, total_bytes, artifact_sha256, case when files % 2 = 0 then 'mit' end as license, case when files % 3 = 0 then 1 else 0 end as parents, '2.0.0' as schema_version from i""")
def p33(spark, sf):
    inventory = view(spark, sf, "inventory")
    totals = inventory.groupBy("aid").agg(F.count("*").alias("n"))
    identity = totals.select("aid", F.col("aid").alias("bundle_name"), F.sha2("aid", 256).alias("revision"), F.lit("dataset").alias("artifact_type"))
    lineage = totals.where("n % 3 = 0").select(F.col("aid").alias("child"), F.lit("p").alias("parent"), F.lit("merge").alias("relation"), F.lit("card").alias("declared_by"))
    status = totals.select("aid", F.lit("complete").alias("status"))
    out = records.bundle_records(identity, inventory, integrity.artifact_hash(inventory), lineage, totals.where("n % 2 = 0").select("aid", F.lit("mit").alias("license")), status)
    return out.select("aid", "bundle_id", F.size("inventory.files").cast("long").alias("files"), "inventory.total_bytes", "inventory.artifact_sha256", F.col("licensing.license").alias("license"), F.coalesce(F.size("parents"), F.lit(0)).alias("parents"), "schema_version")


@query("t6_reference_order", """with r as (select p_brand as tree, 'o/m' || p_partkey as ref, case p_size % 3 when 0 then 'declared' when 1 then 'evidence' else 'mentioned' end as tier, case when p_partkey % 5 = 0 then null else p_partkey % 2 = 0 end as resolved, case when p_partkey % 4 = 0 then 'image' else 'hub' end as kind from part)
  select tree, ref, cast(row_number() over (partition by tree order by case tier when 'declared' then 0 when 'evidence' then 1 else 2 end, case when resolved then 0 when resolved is null then 1 else 2 end, kind, ref) as int) as place from r""")
def t6(spark, sf):
    from pyspark.sql.window import Window

    k = F.col("p_partkey")
    rows = table(spark, sf, "part").select(F.col("p_brand").alias("tree"), F.concat(F.lit("o/m"), k).alias("ref"), pick(("declared", "evidence", "mentioned"), F.col("p_size") % 3).alias("tier"), F.when(k % 5 != 0, k % 2 == 0).alias("resolved"), F.when(k % 4 == 0, "image").otherwise("hub").alias("kind"))
    return rows.select("tree", "ref", F.row_number().over(Window.partitionBy("tree").orderBy(*records.reference_order())).alias("place"))
