"""What source trees refer to: documents as files of trees, scanned line by line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockroom.operators import overlay, references
from stockroom.plans.derive import cte, view
from stockroom.plans.registry import cut, query


def trees(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as files of source trees, each with a first line that refers to something."""
    d = spark.read.parquet(f"{sf}/documents.parquet")
    k, at = F.col("doc_id").cast("string"), F.col("doc_id") % 5
    name = F.when(at == 0, ".env.sample").when(at == 1, "compose.yaml").when(at == 2, "Dockerfile").when(at == 3, "run.py").otherwise("README.md")
    line = (
        F.when(at == 0, F.concat(F.lit("MODEL=own"), F.col("doc_id") % 7, F.lit("/net-"), F.col("doc_id") % 11))
        .when(at == 1, F.concat(F.lit("    image: reg.example/own:v"), F.col("doc_id") % 9))
        .when(at == 2, F.concat(F.lit("FROM own/img:"), F.col("doc_id") % 9))
        .when(at == 3, F.concat(F.lit('NAME = "own'), F.col("doc_id") % 7, F.lit("/net-"), F.col("doc_id") % 11, F.lit('"')))
        .otherwise(F.concat(F.lit("see https://huggingface.co/own"), F.col("doc_id") % 7, F.lit("/net-"), F.col("doc_id") % 11))
    )
    return d.select(F.col("source").alias("tree"), F.concat(k, F.lit("/"), name).alias("path"), F.concat(line, F.lit("\n"), F.lower("text")).alias("text"))


@query("x2_line_counts", "with l as (select source as tree, regexp_split_to_array(lower(text), '\\r\\n|[\\n\\r]') as a from documents) select tree, cast(sum(len(a) + 1) as bigint) as lines from l group by tree")
def x2(spark, sf):
    return references.lines_of(trees(spark, sf)).groupBy("tree").agg(F.count("*").alias("lines"))


@query("x4_declared", r"""with planted as (select source as tree, case doc_id % 5 when 0 then 'own' || (doc_id % 7) || '/net-' || (doc_id % 11) when 1 then 'reg.example/own:v' || (doc_id % 9) else 'own/img:' || (doc_id % 9) end as value from documents where doc_id % 5 < 3),
  l as (select source as tree, doc_id, doc_id % 5 as slot, unnest(regexp_split_to_array(lower(text), '\r\n|[\n\r]')) as line from documents where doc_id % 5 < 3), stages as (select doc_id, regexp_extract(line, '^\s*from\s+\S+\s+as\s+(\S+)', 1) as stage from l where slot = 2),
  v as (select tree, doc_id, case slot when 0 then regexp_extract(line, '^\s*(?:export\s+)?[a-z_]\w*\s*=\s*["''`]?([^"''`#\s]+)', 1) when 1 then regexp_extract(line, '^\s*(?:-\s*)?image:\s*["'']?([^"''#\s]+)', 1) else regexp_extract(line, '^\s*from\s+(?:--platform=\S+\s+)?(\S+)', 1) end as value, slot from l),
  own as (select tree, value from v where value <> '' and not (slot = 2 and (value = 'scratch' or exists (select 1 from stages s where s.doc_id = v.doc_id and s.stage = v.value))))
  select tree, value, count(*) as n from (select * from planted union all select * from own) group by all""")
def x4(spark, sf):
    return references.declared(references.lines_of(trees(spark, sf))).groupBy("tree", "value").agg(F.count("*").alias("n"))


FOLDED = """with h as (select source as tree, case when doc_id % 5 in (1, 2) then 'image' else 'hub' end as kind, case doc_id % 5 when 1 then 'reg.example/own:v' || (doc_id % 9) when 2 then 'own/img:' || (doc_id % 9) else 'own' || (doc_id % 7) || '/net-' || (doc_id % 11) end as ref,
  case when doc_id % 5 < 3 then 1 when doc_id % 5 = 3 then 2 else 3 end as rank from documents), f as (select tree, kind, ref, min(rank) as rank, count(*) as occurrences from h group by all)"""


@query("a18_reference_items", FOLDED + " select tree, kind, ref, case rank when 1 then 'declared' when 2 then 'evidence' else 'mentioned' end as tier, occurrences from f")
def a18(spark, sf):
    """All references of the whole texts; at the size of the SQL check the texts' own lines hold none."""
    return references.folded(references.hits(trees(spark, sf))).select("tree", "kind", "ref", "tier", "occurrences")


@query("x10_self_links", FOLDED + " select tree, kind, ref, occurrences from f where lower(ref) <> 'own1/net-1'")
def x10(spark, sf):
    return references.folded(references.hits(trees(spark, sf)), F.lit("Own1/net-1")).select("tree", "kind", "ref", "occurrences")


@query("j17_a19_primary_work", FOLDED + """, q as (select *, kind = 'hub' and rank < 3 as asked from f), r as (select *, asked and ref like '%1' as resolved from q)
  select tree, case when count(*) filter (resolved) = 1 then max(ref) filter (resolved) end as primary, case count(*) filter (resolved) when 1 then 'one' when 0 then 'none resolves' else 'several resolve' end as reason from r group by tree""")
def a19(spark, sf):
    items = cut(references.folded(references.hits(trees(spark, sf))))  # read twice, and the texts once
    known = items.where("ref like '%1'").select("ref")
    return references.primary(references.resolved(items, known))


@query("j18_primary_price", cte("inventory") + """, t as (select aid, count(*) as files, cast(sum(size) as bigint) as bytes from inventory group by aid) select 't' || n_nationkey as tree, case when n_nationkey % 4 > 0 then 'src' || n_nationkey end as primary, t.aid is not null as held, t.files, t.bytes
  from nation left join t on n_nationkey % 4 > 0 and t.aid = 'src' || n_nationkey""")
def j18(spark, sf):
    k = F.col("n_nationkey")
    primary = spark.read.parquet(f"{sf}/nation.parquet").select(F.concat(F.lit("t"), k).alias("tree"), F.when(k % 4 > 0, F.concat(F.lit("src"), k)).alias("primary"))
    return overlay.priced(primary, view(spark, sf, "inventory").withColumnRenamed("aid", "source")).drop("unknown_sizes")


@query("j19_code_twins", """with i as (select p_brand as tree, case p_partkey % 3 when 0 then 'code' else 'hub' end as kind, case p_partkey % 3 when 0 then 'Own/R' else 'own/r' end || (p_partkey % 50) as ref, case p_size % 2 when 0 then 'mentioned' else 'declared' end as tier, p_partkey from part)
  select tree, kind, ref, tier, p_partkey from i where not (kind = 'hub' and tier = 'mentioned' and exists (select 1 from i c where c.tree = i.tree and c.kind = 'code' and lower(c.ref) = lower(i.ref)))""")
def j19(spark, sf):
    k = F.col("p_partkey")
    code = k % 3 == 0
    items = spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_brand").alias("tree"), F.when(code, "code").otherwise("hub").alias("kind"), F.concat(F.when(code, "Own/R").otherwise("own/r"), k % 50).alias("ref"), F.when(F.col("p_size") % 2 == 0, "mentioned").otherwise("declared").alias("tier"), k)
    return references.without_code_twins(items)


PATH = "case doc_id % 6 when 0 then concat(doc_id, '/.env') when 1 then concat('d', doc_id, '.py') when 2 then concat(doc_id, '/a.py') when 3 then concat(doc_id, '.md') when 4 then concat('w', doc_id, '.bin') else concat(doc_id, '/compose.yaml') end"
CHOSEN = cte("inventory").replace("with ", "with recursive ", 1) + f""", c as (select aid, {PATH} as path, size, case doc_id % 6 when 0 then 1 when 1 then 10000 when 2 then 20001 when 3 then 30000 when 5 then 1 end as priority from inventory), r as (select *, row_number() over (partition by aid order by priority, path) as i from c where priority is not null and size <= 4096),
  s(aid, i, budget, slots, taken) as (select distinct aid, cast(0 as bigint), cast(15000 as bigint), cast(12 as bigint), false from r union all select s.aid, r.i, case when r.size <= s.budget and s.slots > 0 then s.budget - r.size else s.budget end, case when r.size <= s.budget and s.slots > 0 then s.slots - 1 else s.slots end, r.size <= s.budget and s.slots > 0 from s join r on r.aid = s.aid and r.i = s.i + 1),
  o as (select r.aid, r.path, case when s.taken then 'read' else 'over budget' end as outcome from r join s on r.aid = s.aid and r.i = s.i union all select aid, path, case when priority is null then 'not text' else 'oversize' end from c where priority is null or size > 4096)"""


def chosen(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return references.scan_selection(view(spark, sf, "inventory").select("aid", F.expr(PATH).alias("path"), "size"), 4096, 15000, 12)


@query("x1_scan_selection", CHOSEN + " select * from o")
def x1(spark, sf):
    return chosen(spark, sf)[0]


@query("x1_scan_counts", CHOSEN + " select aid, count(*) filter (outcome = 'read') as read, count(*) filter (outcome = 'not text') as not_text, count(*) filter (outcome = 'oversize') as too_large, count(*) filter (outcome = 'over budget') as over_budget, bool_or(outcome in ('oversize', 'over budget')) as partial from o group by aid")
def x1_counts(spark, sf):
    return chosen(spark, sf)[1]


#: Lines with a number in them; what each refers to is stated in the SQL.
SHAPES = (
    "use bf16/fp32 now", "use Org/net-x# now", 'use "and/or" now', "use in/out now", "run team/img:v# now", "see https://github.com/own/r#.git and https://huggingface.co/datasets/own/d",
    "in docs/net-x or https://github.com/topics/x", "a/b-#, c/d_2", "run team/img:v#. Then", "M=${A:-${B:-own/n-#}} ${C:-https://hf.co/own/m#?$x} ${D:-a$b}", "pull reg.example:5000/a/b#:1.2-x, or a/b:latest)",
    "at http://www.github.com/o#/r.x. and https://hf.co:443/o/m, 'own/q#' \"own/p#'", "lone/img#@sha256:" + "0" * 64 + " and a/b:c/d:e, $own/net-1, x@own/net-1",
)


@query("x6_line_shapes", """with d as (select source as tree, doc_id % 2 = 0 as prose, doc_id % 13 as slot, cast(doc_id % 40 as varchar) as k from documents), r as (select tree, prose, unnest(case slot when 0 then case when prose then [] else [{'kind': 'hub', 'ref': 'bf16/fp32'}] end when 1 then [{'kind': 'hub', 'ref': 'Org/net-x' || k}] when 2 then [{'kind': 'hub', 'ref': 'and/or'}] when 4 then [{'kind': 'image', 'ref': 'team/img:v' || k}]
  when 5 then [{'kind': 'code', 'ref': 'own/r' || k}, {'kind': 'hub', 'ref': 'datasets/own/d'}] when 7 then [{'kind': 'hub', 'ref': 'a/b-' || k}, {'kind': 'hub', 'ref': 'c/d_2'}] when 8 then [{'kind': 'image', 'ref': 'team/img:v' || k}]
  when 9 then case when prose then [{'kind': 'hub', 'ref': 'own/m' || k}] else [{'kind': 'hub', 'ref': 'own/m' || k}, {'kind': 'hub', 'ref': 'own/m' || k}, {'kind': 'hub', 'ref': 'own/n-' || k}] end when 10 then [{'kind': 'image', 'ref': 'reg.example:5000/a/b' || k || ':1.2-x'}, {'kind': 'image', 'ref': 'a/b:latest'}]
  when 11 then [{'kind': 'code', 'ref': 'o' || k || '/r.x'}, {'kind': 'hub', 'ref': 'own/q' || k}] || case when prose then [] else [{'kind': 'hub', 'ref': 'own/p' || k}] end else [] end) as h from d)
  select tree, h.kind as kind, h.ref as ref, case when prose then 'mentioned' else 'evidence' end as tier, count(*) as n from r group by all""")
def x6(spark, sf):
    """Half of the shapes stand in prose and half in code, by the number of the document, beneath the document's own text."""
    d = spark.read.parquet(f"{sf}/documents.parquet")
    k = (F.col("doc_id") % 40).cast("string")
    line = F.replace(F.get(F.array(*map(F.lit, SHAPES)), (F.col("doc_id") % len(SHAPES)).cast("int")), F.lit("#"), k)
    text = F.concat_ws("\n", F.replace(F.col("text"), F.lit("/"), F.lit(" ")), line)
    files = d.select(F.col("source").alias("tree"), F.concat("doc_id", F.when(F.col("doc_id") % 2 == 0, ".md").otherwise(".js")).alias("path"), text.alias("text"))
    return references.hits(files).groupBy("tree", "kind", "ref", "tier").agg(F.count("*").alias("n"))


@query("x7_front_matter", """with d as (select source as tree, doc_id as k from documents where doc_id % 3 <> 0) select tree, 'own/m' || k as ref from d union all select tree, 'datasets/own/d' || k from d union all select tree, 'datasets/own/e' from d""")
def x7(spark, sf):
    k = F.col("doc_id").cast("string")
    head = F.concat(F.lit("---\ntitle: x\nmodels:\n  - own/m"), k, F.lit("\ndatasets: [own/d"), k, F.lit(", bad, 'own/e']\ntags:\n  - own/no\n---\nmodels:\n- own/late\n"))
    files = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("source").alias("tree"), F.concat(k, F.lit("/README.md")).alias("path"), F.concat(F.when(F.col("doc_id") % 3 == 0, "text\n").otherwise(""), head, "text").alias("text"))
    return references.front_matter(references.lines_of(files)).select("tree", "ref")


@query("x9_plausible", """with w as (select p_partkey, p_size % 6 as o, p_partkey % 4 as n from part) select p_partkey, o in (1, 5) and n in (0, 3) as plausible from w""")
def x9(spark, sf):
    pick = lambda values, at: F.get(F.array(*map(F.lit, values)), at.cast("int"))
    work = F.concat_ws("/", pick(("usr", "Own", "own.py", "12", "a--b", "team"), F.col("p_size") % 6), pick(("net", "x.JSON", "7", "m-1"), F.col("p_partkey") % 4))
    return spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", references.plausible(work).alias("plausible"))


@query("x3_prose_lines", """select source as tree, doc_id as k, cast(case doc_id % 3 when 0 then 3 when 1 then 2 + doc_id % 4 else 1 end as bigint) as prose from documents""")
def x3(spark, sf):
    """Comments, and what stands between quotes of three; quotes that aren't closed reach to the end of the file."""
    k = F.col("doc_id")
    body = F.when(k % 3 == 0, 'a = 1\n"""\ninside\n"""\nb = 2\n# c').when(k % 3 == 1, F.concat(F.lit("a = 1\n'''open"), F.repeat(F.lit("\nx = 1"), (k % 4).cast("int") + 1), F.lit("\n# d"))).otherwise('a = """one line"""\nb = 2\n  # c')
    files = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("source").alias("tree"), F.concat(k, F.lit(".py")).alias("path"), body.alias("text"))
    lines = references.prose_marks(references.lines_of(files))
    return lines.groupBy("tree", F.regexp_extract("path", r"(\d+)", 1).cast("long").alias("k")).agg(F.count_if("prose").alias("prose"))


NAMES = (".env", ".env.local", "docker-compose.dev.yml", "Dockerfile.gpu", "x.dockerfile", "LICENSE", "notes.MD", "Makefile", "a.RS", "weights.bin", ".github/ci.yml", ".github/logo.png")


@query("f15_file_classes", """select p_partkey, case p_partkey % 12 when 0 then 'env_template' when 2 then 'compose' when 3 then 'dockerfile' when 4 then 'dockerfile' when 5 then 'prose' when 6 then 'prose' when 7 then 'code' when 8 then 'code' when 10 then case when p_size % 2 = 0 then 'prose' else 'code' end else 'skip' end as class from part""")
def f15(spark, sf):
    name = F.get(F.array(*map(F.lit, NAMES)), (F.col("p_partkey") % 12).cast("int"))
    path = F.concat(F.when(F.col("p_size") % 2 == 1, "d/").otherwise(""), name)
    return spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", references.file_class(path).alias("class"))


@query("f16_text_test", "select doc_id, not (strlen(text) < 8192 and doc_id % 3 = 0) as is_text from documents")
def f16(spark, sf):
    content = F.concat(F.encode("text", "utf-8"), F.unhex(F.when(F.col("doc_id") % 3 == 0, "00").otherwise("20")))
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", references.is_text(content).alias("is_text"))
