"""Artifact tables derived from the star-schema tables, so that operators run over data that grows with them.

Each view is one SELECT; the two dialects differ in a few function names only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: name -> (tables it reads, SELECT with dialect marks)
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "inventory": (
        ("documents",),
        "select source as aid, doc_id, concat(lang, '/', lpad(cast(doc_id as {string}), 6, '0'), '.txt') as path,"
        " cast({bytes}(text) as bigint) as size, {sha256} as sha256 from documents",
    ),
    "observed": (
        ("documents",),
        "select source as aid, concat(lang, '/', lpad(cast(doc_id as {string}), 6, '0'), '.txt') as path,"
        " cast({bytes}(text) as bigint) as size, case when doc_id % 13 = 0 then {sha256_more} else {sha256} end as sha256"
        " from documents where doc_id % 17 <> 0"
        " union all select source as aid, concat(lang, '/', lpad(cast(doc_id as {string}), 6, '0'), '.txt.bak') as path,"
        " cast({bytes}(text) as bigint) as size, {sha256} as sha256 from documents where doc_id % 23 = 0",
    ),
    "entries": (
        ("customer",),
        "select c_custkey as k, concat('huggingface:cust', cast(c_custkey as {string}), '/work') as source,"
        " case when c_custkey % 5 = 0 then {sha256_cust} end as revision,"
        " case when c_nationkey % 4 = 3 then null else cast(c_nationkey % 9 + 1 as int) end as desire,"
        " concat('catalog', cast(c_nationkey % 5 as {string})) as catalog_id, c_mktsegment as note from customer",
    ),
    "holdings": (
        ("orders",),
        "select o_orderkey, concat('huggingface:cust', cast(o_custkey as {string}), '/work') as source,"
        " {sha256_hold} as revision, o_orderstatus = 'P' as part, o_orderdate as archived,"
        " cast(round(o_totalprice * 1000) as bigint) as payload,"
        " case when o_orderkey % 3 = 0 then '*.txt' end as include, o_orderkey % 7 = 0 as policy from orders",
    ),
    "states": (
        ("lineitem",),
        "select l_orderkey as aid, cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as bigint) as path,"
        " cast(round(l_extendedprice * 100) as bigint) as size,"
        " case when l_returnflag = 'A' then 'verified' when l_returnflag = 'R' then 'handed_off'"
        " when l_linestatus = 'O' then 'missing' else 'partial' end as status from lineitem",
    ),
    "sessions": (
        ("orders",),
        "select o_custkey as aid, o_orderkey as ordinal, {epoch} as started, {epoch} + case when o_orderkey % 11 = 0 then -60 else o_orderkey % 3600 end as ended,"
        " case when o_orderkey % 13 = 0 then 0 else cast(round(o_totalprice * 100) as bigint) end as bytes, cast(o_orderkey % 3 as bigint) as retries from orders",
    ),
    "shards": (
        ("part",),
        "select p_brand as aid, concat(p_type, '-', lpad(cast(p_size % 4 + 1 as {string}), 5, '0'), '-of-00004.gguf') as path,"
        " case when min(p_partkey) % 9 = 0 then null else cast(sum(p_size) * 1000 as bigint) end as size from part where p_partkey % 7 <> 0 group by p_brand, p_type, p_size % 4",
    ),
    "edges": (
        ("customer",),
        "select concat('work', cast(c_custkey as {string})) as child, concat('work', cast({floor3} as {string})) as parent,"
        " case c_nationkey % 4 when 0 then 'quantized' when 1 then 'finetune' when 2 then 'adapter' else 'merge' end as relation"
        " from customer where c_custkey >= 3",
    ),
    "stream": (
        ("events",),
        "select event_id, user_id as aid, {epoch_ts} as ts, cast(round(value * 1000) as bigint) as bytes,"
        " case event_type when 'purchase' then 'network' when 'click' then 'local' when 'view' then 'hash' when 'error' then 'retry' else 'online' end as kind from events",
    ),
}

SPARK = {
    "string": "string",
    "bytes": "octet_length",
    "sha256": "sha2(text, 256)",
    "sha256_more": "sha2(concat(text, '!'), 256)",
    "sha256_cust": "sha2(cast(c_custkey as string), 256)",
    "sha256_hold": "sha2(cast(case when o_orderkey % 2 = 0 then o_custkey else o_orderkey end as string), 256)",
    "epoch": "unix_timestamp(o_orderdate)",
    "epoch_ts": "unix_timestamp(ts)",
    "floor3": "cast(floor(c_custkey / 3) as bigint)",
}
DUCK = {
    "string": "varchar",
    "bytes": "strlen",
    "sha256": "sha256(text)",
    "sha256_more": "sha256(concat(text, '!'))",
    "sha256_cust": "sha256(cast(c_custkey as varchar))",
    "sha256_hold": "sha256(cast(case when o_orderkey % 2 = 0 then o_custkey else o_orderkey end as varchar))",
    "epoch": "cast(epoch(o_orderdate) as bigint)",
    "epoch_ts": "cast(floor(epoch(ts)) as bigint)",
    "floor3": "c_custkey // 3",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tables, sql = VIEWS[name]
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables}
    for t in tables:
        sql = sql.replace(f"from {t}", f"from {{{t}}}")
    filled = sql
    for mark, text in SPARK.items():
        filled = filled.replace("{" + mark + "}", text)
    return spark.sql(filled, **frames)


def cte(*names: str) -> str:
    """WITH clause of the views in the other dialect; further tables of a query follow after a comma."""
    parts = []
    for name in names:
        sql = VIEWS[name][1]
        for mark, text in DUCK.items():
            sql = sql.replace("{" + mark + "}", text)
        parts.append(f"{name} as ({sql})")
    return "with " + ", ".join(parts)
