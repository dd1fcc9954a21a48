"""Operator 12, URL filters: a blocked Bloom filter of the listed canonical URLs passes possible hits to an exact hash
join, which removes false positives.

A rule (action, host, path) fits its host and all subdomains of it, if the path of a URL begins with the rule's. A URL is
therefore looked up as each of its host's suffixes with each beginning of its path that is as long as a listed path.
The filter holds listed hosts as well, so the paths of a host that isn't listed are never taken apart. The longest rule
that the join confirms decides (host and path together, then host); a URL without one isn't listed and is allowed.

Scale: JVM expressions only. Rows without a possible hit, which are most, are decided where they are read. The others
carry an id, a host and a path to the join and to the choice of the longest rule, which combines before its shuffle. The
filter has at most `MAX_BLOCKS` blocks of 64 bytes whatever the list: a longer list has more false positives, which
the join removes. The list is broadcast if its size, which is counted, is at most `BROADCAST_BYTES`; beyond that the join is a shuffle,
in which Spark splits a host that holds many rows, since only one row of the list meets them.

Edge cases: host and path of a URL that is null or has no `://` are empty; URLs are never cut, however long; repeated
rows are judged each on its own; of a host and path listed twice the blocking rule counts; rules with a null are left
out; an empty list allows everything; extra columns are left alone, one that bears the name of a result gives way to it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stockroom.llm import common

#: Words of 64 bits in a block; a key sets one bit in each. Bits for each key, and the most blocks of a filter.
WORDS, BITS_A_KEY, MAX_BLOCKS = 8, 16, 1 << 15
#: A list of at most so many bytes, with 100 added for each row, is broadcast.
BROADCAST_BYTES = 16 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The rules of `op12_url_filter`.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def canonical(url: Column) -> tuple[Column, Column]:
    """Host, in lower case, and path."""
    part = lambda k: F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", k), F.lit(""))
    return F.translate(part(1), UPPER, LOWER), part(2)


def hashes(*key: Column) -> Column:
    """Two hashes of a key: one chooses the block, the other a bit in each word of it."""
    return F.struct(F.xxhash64(*key).alias("block"), F.xxhash64(F.lit(1), *key).alias("bits"))


def masks(bits: Column) -> list[Column]:
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(bits, 6 * k).bitwiseAND(F.lit(63)).cast("int")) for k in range(WORDS)]


class BlockedBloom:
    """Built from the columns of a table of `n` keys; `holds` is a column expression over `hashes` of a key."""

    def __init__(self, keys: DataFrame, n: int):
        self.blocks = min(MAX_BLOCKS, 1 << (n * BITS_A_KEY // (64 * WORDS)).bit_length())
        hashed = keys.select(hashes(*(F.col(c) for c in keys.columns)).alias("h")).select(self.block(F.col("h.block")).alias("block"), "h.bits")
        rows = hashed.select("block", *(m.alias(f"w{k}") for k, m in enumerate(masks(F.col("bits"))))).groupBy("block").agg(*(F.bit_or(f"w{k}") for k in range(WORDS)))
        words = [0] * (self.blocks * WORDS)
        for at, *own in rows.collect():  # at most MAX_BLOCKS
            words[at * WORDS : at * WORDS + WORDS] = own
        self.words = F.split(F.lit(",".join(map(str, words))), ",").cast("array<bigint>")  # folded to one literal

    def block(self, h: Column) -> Column:
        return F.pmod(h, F.lit(self.blocks)).cast("int")

    def holds(self, hashed: Column) -> Column:
        at = self.block(hashed.getField("block")) * WORDS
        tests = [F.get(self.words, at + k).bitwiseAND(m) != 0 for k, m in enumerate(masks(hashed.getField("bits")))]
        return reduce(lambda a, b: a & b, tests)


def judged(pages: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """All columns with host, path, rule (null if none fits) and verdict.

    `rules`: (action, host, path), action block or allow."""
    pages = common.without(pages.withColumn("__url", F.col(url)), "host", "path", "rule", "verdict")
    own = [f"`{c}`" for c in pages.columns if c != "__url"]
    rules = rules.select("action", F.translate("host", UPPER, LOWER).alias("rule_host"), F.col("path").alias("rule_path")).dropna()
    rules = rules.groupBy("rule_host", "rule_path").agg(F.max("action").alias("action"))  # block comes after allow
    n, size, labels = rules.agg(F.count("*"), F.sum(F.octet_length("rule_host") + F.octet_length("rule_path")), F.max(F.size(F.split("rule_host", r"\.")))).first()
    lengths = sorted(r[0] for r in rules.select(F.char_length("rule_path")).distinct().collect())  # no more than the longest path has characters
    no_path = F.lit(None).cast("string")
    listed = BlockedBloom(rules.select("rule_host", "rule_path").union(rules.select("rule_host", no_path)), 2 * n)
    if (size or 0) + 100 * n <= BROADCAST_BYTES:
        rules = F.broadcast(rules)

    host, path = canonical(F.col("__url"))
    pages = pages.select(*own, host.alias("host"), path.alias("path")).withColumn("__label", F.split("host", r"\."))
    count = F.size("__label")
    suffixes = F.transform(F.sequence(F.greatest(F.lit(1), count - (labels or 1) + 1), count), lambda i: F.array_join(F.slice("__label", i, count), "."))
    hosts = F.filter(suffixes, lambda h: listed.holds(hashes(h, no_path)))
    starts = F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: n <= F.char_length("path"))
    keys = F.flatten(F.transform(hosts, lambda h: F.transform(starts, lambda n: F.struct(h.alias("rule_host"), F.substring(F.col("path"), F.lit(1), n).alias("rule_path")))))
    # the row's number keeps what is computed here from being computed again in the filters
    pages = pages.withColumns({"__possible": F.filter(keys, lambda k: listed.holds(hashes(k.rule_host, k.rule_path))), "__row": F.monotonically_increasing_id()})

    free = pages.where((F.size("__possible") == 0) & (F.col("__row") >= 0)).select(*own, "host", "path", no_path.alias("rule"), F.lit("allow").alias("verdict"))
    hit = pages.where(F.size("__possible") > 0).select("__row", F.struct(*own, "host", "path").alias("__page"), F.inline("__possible"))
    hit = hit.join(rules, ["rule_host", "rule_path"], "left")
    name = F.concat("rule_host", "rule_path")
    best = F.max(F.when(F.col("action").isNotNull(), F.struct(F.char_length(name).alias("n"), F.char_length("rule_host").alias("h"), name.alias("rule"), "action"))).alias("__best")
    hit = hit.groupBy("__row").agg(F.first("__page").alias("__page"), best)
    return free.union(hit.select("__page.*", F.col("__best.rule").alias("rule"), F.coalesce("__best.action", F.lit("allow")).alias("verdict")))


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = common.read(spark, sf_dir, "pages").select("page_id", "url")
    return judged(pages, spark.createDataFrame(RULES, "action string, host string, path string")).drop("url")


SQL = """
    with rules(action, host, path) as (values ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
    p as (select page_id, row_number() over () as k, translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
        coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's'), '') as path from pages),
    f as (select p.k, r.host || r.path as rule, r.action, row_number() over (partition by p.k order by length(r.host || r.path) desc, length(r.host) desc) as n
        from p join rules r on (p.host = r.host or ends_with(p.host, '.' || r.host)) and starts_with(p.path, r.path))
    select page_id, host, path, rule, coalesce(action, 'allow') as verdict from p left join f on f.k = p.k and f.n = 1"""
