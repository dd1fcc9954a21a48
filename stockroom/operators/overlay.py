"""Want-lists laid over what is held.

An entry and a holding meet on the canonical source and on a key of the revision (an equi-join); the rest of the revision and
the selection are residual conditions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rank of a status in a listing; others come last.
STATUS_ORDER = ("partial", "want", "have", "closed")


def revisions_match(got: Column, want: Column) -> Column:
    """Two revisions of 12 or more characters: hexadecimal ones if either starts the other, else if equal; shorter never."""
    long = (F.length(got) >= 12) & (F.length(want) >= 12)
    both_hex = got.rlike("^[0-9a-fA-F]+$") & want.rlike("^[0-9a-fA-F]+$")
    return F.coalesce(F.when(~long, False).when(both_hex, got.startswith(want) | want.startswith(got)).otherwise(got == want), F.lit(False))


def revision_fits(want: Column, got: Column, ref: Column) -> Column:
    """Whether a holding serves an entry's revision: any does if the entry names none; a short or non-hexadecimal
    one must be the revision or the requested name itself."""
    loose = (F.length(want) < 12) | ~want.rlike("^[0-9a-fA-F]+$")
    return F.when(want.isNull(), True).when(loose, (want == got) | F.coalesce(want == ref, F.lit(False))).otherwise(revisions_match(got, want))


def entry_meets(want: Column) -> Column:
    """What an entry's revision must share with a holding's: nothing, all of it, or its first 12 digits."""
    loose = (F.length(want) < 12) | ~want.rlike("^[0-9a-fA-F]+$")
    return F.when(want.isNull(), "any").when(loose, F.concat(F.lit("is "), want)).otherwise(F.concat(F.lit("starts "), F.left(want, F.lit(12))))


def holding_keys(got: Column, ref: Column) -> Column:
    """Every key under which an entry may ask for a holding, so that a source with very many revisions is no theta join."""
    digits = (F.length(got) >= 12) & got.rlike("^[0-9a-fA-F]+$")
    keys = F.array(F.lit("any"), F.concat(F.lit("is "), got), F.concat(F.lit("is "), ref), F.when(digits, F.concat(F.lit("starts "), F.left(got, F.lit(12)))))
    return F.array_distinct(F.array_compact(keys))


def include_key(include: Column) -> Column:
    """Patterns as an ordered set; `/*` alone selects everything and so equals no selection."""
    key = F.array_sort(F.array_distinct(F.coalesce(include, F.array().cast("array<string>"))))
    return F.when((F.size(key) == 1) & (F.get(key, 0) == "/*"), F.array().cast("array<string>")).otherwise(key)


def canonical_source(ref: Column) -> Column:
    """Provider-prefixed name of a hub model or dataset or a code repository; null where a reference is none of these."""
    text = F.regexp_replace(F.regexp_replace(F.trim(ref), r"[?#].*$", ""), r"/+$", "")
    hub = F.regexp_extract(text, r"^(?:huggingface:|hf:|https?://huggingface\.co/)((?:datasets/)?[A-Za-z0-9][\w.-]*/[\w.-]+)(?:/(?:tree|blob|resolve)/.*)?$", 1)
    code = F.regexp_extract(text, r"^(?:github:|gh:|https?://github\.com/)([A-Za-z0-9][\w-]*/[\w.-]+?)(?:\.git)?(?:/(?:tree|blob)/.*)?$", 1)
    bare = F.regexp_extract(text, r"^((?:datasets/)?[A-Za-z0-9][\w.-]*/[\w.-]+)$", 1)
    return F.when(hub != "", F.concat(F.lit("huggingface:"), hub)).when(code != "", F.concat(F.lit("github:"), code)).when(bare != "", F.concat(F.lit("huggingface:"), bare))


def is_closed(ref: Column) -> Column:
    """An address on a host that no provider serves: work that can't be fetched."""
    return F.coalesce(F.trim(ref).rlike(r"^https?://") & canonical_source(ref).isNull(), F.lit(False))


def closed_source(ref: Column) -> Column:
    """The canonical form of closed work: its address without fragment and closing slashes."""
    return F.when(is_closed(ref), F.regexp_replace(F.regexp_replace(F.trim(ref), r"#.*$", ""), r"/+$", ""))


def publisher(source: Column) -> Column:
    """Who published a canonical source; null for addresses and single-segment names."""
    found = F.regexp_extract(source, r"^(?:[a-z]+:)?(?:datasets/)?([^/:]+)/[^/]+$", 1)
    return F.when(source.rlike("^https?://") | (found == ""), F.lit(None)).otherwise(found)


def overlay(entries: DataFrame, holdings: DataFrame) -> DataFrame:
    """Every entry with its best holding and a status.

    `entries`: k, source, revision, include; `holdings`: source, revision, ref, include, policy, part, archived, path.
    A holding that a policy selected serves an entry without a selection. Complete beats partial, then the latest
    date, then the smaller path. An address that no provider serves is closed work."""
    e = entries.select("k", F.col("source").alias("e_source"), F.col("revision").alias("e_revision"), include_key(F.col("include")).alias("e_include"))
    h = holdings.select(*(F.col(c).alias(f"h_{c}") for c in holdings.columns))
    fits = revision_fits(F.col("e_revision"), F.col("h_revision"), F.col("h_ref"))
    same = (F.col("e_include") == include_key(F.col("h_include"))) | ((F.size("e_include") == 0) & F.col("h_policy"))
    e, h = e.withColumn("e_meet", entry_meets(F.col("e_revision"))), h.withColumn("h_meet", F.explode(holding_keys(F.col("h_revision"), F.col("h_ref"))))
    found = e.join(h, (F.col("e_source") == F.col("h_source")) & (F.col("e_meet") == F.col("h_meet")) & fits & same, "left")
    best = Window.partitionBy("k").orderBy(F.col("h_part").asc_nulls_last(), F.col("h_archived").desc_nulls_last(), "h_path")
    closed = is_closed(F.col("e_source"))
    status = F.when(closed, "closed").when(F.col("h_source").isNull(), "want").when(F.col("h_part"), "partial").otherwise("have")
    return found.withColumn("n", F.row_number().over(best)).where("n = 1").select("k", F.col("e_source").alias("source"), status.alias("status"), F.col("h_path").alias("held_at"), F.col("h_archived").alias("archived"))


def overlay_stats(rows: DataFrame) -> DataFrame:
    """Counts by status, remaining bytes with how many are unknown, bytes on disk."""
    return rows.agg(
        *(F.count_if(F.col("status") == s).alias(s) for s in ("want", "partial", "have", "closed")),
        F.coalesce(F.sum(F.when(F.col("status").isin("want", "partial"), F.col("remaining"))), F.lit(0)).alias("remaining_bytes"),
        F.count_if(F.col("status").isin("want", "partial") & F.col("remaining").isNull()).alias("remaining_unknown"),
        F.coalesce(F.sum("on_disk"), F.lit(0)).alias("on_disk_bytes"),
    )


def idle_reason(rows: DataFrame) -> DataFrame:
    """Why nothing is next in a catalog: it is empty, only closed work is left, or all is held; else it isn't idle."""
    counts = rows.groupBy("catalog_id").agg(F.count("k").alias("n"), F.count_if(F.col("status").isin("want", "partial")).alias("open"), F.count_if(F.col("status") == "closed").alias("closed"))
    reason = F.when(F.col("n") == 0, "empty").when(F.col("open") > 0, "not idle").when(F.col("closed") > 0, "only closed work").otherwise("complete")
    return counts.select("catalog_id", reason.alias("reason"))


def next_entry(rows: DataFrame) -> DataFrame:
    """The next unit of work of each catalog: partial before want, higher desire first and none last, then the source."""
    w = Window.partitionBy("catalog_id").orderBy(F.when(F.col("status") == "partial", 0).otherwise(1), F.col("desire").desc_nulls_last(), "source")
    return rows.where(F.col("status").isin("want", "partial")).withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def sort_keys(by: str) -> list[Column]:
    """Sort keys of a listing; each ends in the source without case."""
    last = F.lower("source")
    rank = reduce(lambda c, x: c.when(F.col("status") == x[1], x[0]), enumerate(STATUS_ORDER), F.when(F.lit(False), -1)).otherwise(len(STATUS_ORDER))
    remaining = F.coalesce(F.col("remaining"), F.lit(-1))
    return {
        "next": [rank, F.col("desire").desc_nulls_last(), last],
        "desire": [F.col("desire").desc_nulls_last(), last],
        "size": [remaining.desc(), last],
        "name": [F.lower(F.substring_index("source", "/", -1)), last],
        "status": [rank, last],
        "family": [F.lower("family").asc_nulls_last(), last] if by == "family" else [],
    }[by]


def stale(as_of: Column, now: Column) -> Column:
    """An estimate older than seven days; one without a readable date isn't stale."""
    return F.coalesce(F.try_to_timestamp(as_of) < now - F.expr("INTERVAL 7 DAYS"), F.lit(False))


def estimate_age(entries: DataFrame, now: Column) -> DataFrame:
    """Per catalog: none, fresh, or the age of the oldest estimate in days if any is stale."""
    at = F.try_to_timestamp("as_of")
    out = entries.groupBy("catalog_id").agg(F.min(at).alias("oldest"), F.bool_or(stale(F.col("as_of"), now)).alias("any_stale"))
    label = F.when(F.col("oldest").isNull(), "none").when(~F.col("any_stale"), "fresh").otherwise(F.concat(F.datediff(now, F.col("oldest")), F.lit(" d")))
    return out.select("catalog_id", label.alias("age"))


def drive_overlay(vault: DataFrame, drive: DataFrame) -> DataFrame:
    """Each bundle of a drive against the vault: partial, new, have, or differ by recorded hash (an unknown one never differs)."""
    whole = vault.where(~F.col("part")).select("bundle_id", F.col("sha256").alias("held"), F.lit(True).alias("known"))
    status = F.when(F.col("part"), "partial").when(F.col("known").isNull(), "new").when(F.col("held") != F.col("sha256"), "differ").otherwise("have")
    rank = F.when(status == "new", 0).when(status == "differ", 1).when(status == "partial", 2).otherwise(3)
    return drive.join(whole, "bundle_id", "left").select("bundle_id", status.alias("status"), rank.alias("listed"))


def entry_key() -> list[Column]:
    return [F.col("source"), F.coalesce("revision", F.lit("")), F.array_join(include_key(F.col("include")), "\n")]


def adoptable(mine: DataFrame, other: DataFrame) -> DataFrame:
    """Entries of another catalog that this one lacks, each key once, the first by ordinal."""
    keyed = lambda df: df.withColumns(dict(zip(("__a", "__b", "__c"), entry_key())))
    w = Window.partitionBy("__a", "__b", "__c").orderBy("k")
    once = keyed(other).withColumn("__n", F.row_number().over(w)).where("__n = 1")
    return once.join(keyed(mine).select("__a", "__b", "__c"), ["__a", "__b", "__c"], "left_anti").drop("__a", "__b", "__c", "__n")


def upsert(base: DataFrame, changes: DataFrame) -> DataFrame:
    """Entries after changes, by source and revision; only a non-null desire or note overwrites."""
    keyed = lambda df, p: df.select("source", F.coalesce("revision", F.lit("")).alias("revision"), F.col("desire").alias(f"{p}_desire"), F.col("note").alias(f"{p}_note"), F.lit(True).alias(p))
    x = keyed(base, "old").join(keyed(changes, "new"), ["source", "revision"], "full")
    desire, note = F.coalesce("new_desire", "old_desire"), F.coalesce("new_note", "old_note")
    same = desire.eqNullSafe(F.col("old_desire")) & note.eqNullSafe(F.col("old_note"))
    outcome = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull() | same, "unchanged").otherwise("updated")
    return x.select("source", "revision", desire.alias("desire"), note.alias("note"), outcome.alias("outcome"))


def dropped(entries: DataFrame, requests: DataFrame) -> DataFrame:
    """What becomes of each request (request, source, revision?): dropped if it names one entry, ambiguous, or not found."""
    r, e = requests.select("request", F.col("source").alias("r_source"), F.col("revision").alias("r_revision")), entries
    hit = (r["r_source"] == e["source"]) & (r["r_revision"].isNull() | r["r_revision"].eqNullSafe(e["revision"]))
    n = r.join(e, hit, "left").groupBy("request").agg(F.count("k").alias("n"))
    return n.select("request", F.when(F.col("n") == 1, "dropped").when(F.col("n") == 0, "not found").otherwise("ambiguous").alias("outcome"))


def readdressed(entries: DataFrame, moves: DataFrame) -> DataFrame:
    """Entries with sources changed by `moves` (source, address), except where that key is taken already."""
    x = entries.join(moves, "source", "left")
    taken = entries.select(F.col("source").alias("address"), F.coalesce("revision", F.lit("")).alias("__r"), F.lit(True).alias("__taken")).distinct()
    x = x.withColumn("__r", F.coalesce("revision", F.lit(""))).join(taken, ["address", "__r"], "left")
    moved = F.col("address").isNotNull() & F.col("__taken").isNull()
    return x.select("k", F.when(moved, F.col("address")).otherwise(F.col("source")).alias("source"), "revision", moved.alias("moved"))


def catalog_index(catalogs: DataFrame, entries: DataFrame) -> DataFrame:
    """Catalogs with how many entries they hold; an empty one holds none."""
    n = entries.groupBy("catalog_id").agg(F.count("*").alias("entries"))
    return catalogs.join(n, "catalog_id", "left").fillna(0, ["entries"])


def hints(gated: Column, total: Column, quantized: Column, expected: Column, weight_bytes: Column, include: Column, policy: Column) -> Column:
    """The closed set of hints that hold, in order of name."""
    large, redundant = total >= 20 * 1024**3, weight_bytes >= 1.75 * expected
    subset = (F.size(include_key(include)) > 0) & policy.isNull()
    named = {"gated": gated, "large": large, "quant": quantized, "redundant": redundant, "subset": subset}
    return F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in named.items())))


def board_entries(rows: DataFrame, entries: DataFrame) -> DataFrame:
    """Board rows (row, source, revision, include) with the first entry (k) of the same source, revision and selection."""
    keyed = lambda df: df.withColumns(dict(zip(("__a", "__b", "__c"), entry_key())))
    first = keyed(entries).groupBy("__a", "__b", "__c").agg(F.min("k").alias("k"))
    return keyed(rows).join(first, ["__a", "__b", "__c"], "left").select("row", "k")


def resumable(requests: DataFrame, partials: DataFrame) -> DataFrame:
    """Transfers under way that serve a request (request, source, revision); more than one is ambiguous and listed."""
    r = requests.select("request", F.col("source").alias("r_source"), F.col("revision").alias("r_revision"))
    same = (F.col("r_source") == F.col("source")) & (F.col("r_revision").isNull() | (F.col("r_revision") == F.col("revision")) | (F.col("r_revision") == F.col("ref")))
    found = r.join(partials, same, "left").groupBy("request").agg(F.count("path").alias("n"), F.array_sort(F.collect_list("path")).alias("paths"))
    return found.select("request", F.when(F.col("n") == 0, "none").when(F.col("n") == 1, "resume").otherwise("ambiguous").alias("outcome"), "paths")


def scope_fit(requests: DataFrame, pins: DataFrame) -> DataFrame:
    """Whether a request's selection fits the pin that exists (aid, include, policy): equal ones do, and a pin that a
    policy selected fits a request without one."""
    r = requests.select("request", "aid", include_key(F.col("include")).alias("want"))
    x = r.join(pins.select("aid", include_key(F.col("include")).alias("have"), "policy", F.lit(True).alias("pinned")), "aid", "left")
    outcome = F.when(F.col("pinned").isNull(), "new").when(F.col("want") == F.col("have"), "same").when((F.size("want") == 0) & F.col("policy"), "policy").otherwise("other selection")
    return x.select("request", outcome.alias("outcome"))


def reusable(pending: DataFrame, inventory: DataFrame) -> DataFrame:
    """Bytes of each pending pin that verified files of sibling bundles (same source and type) already hold, by digest."""
    have = inventory.where("verified").select("source", "artifact_type", "sha256", F.col("aid").alias("holder")).distinct()
    key = ["source", "artifact_type", "sha256"]
    hit = pending.join(have, key).where(F.col("holder") != F.col("aid")).groupBy("aid", "path").agg(F.max("size").alias("size"), F.min("holder").alias("holder"))
    return hit.groupBy("aid").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def priced(primary: DataFrame, inventory: DataFrame) -> DataFrame:
    """Each tree's primary work with whether it is held, its files, bytes and unknown sizes."""
    totals = inventory.groupBy(F.col("source").alias("primary")).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), F.count_if(F.col("size").isNull()).alias("unknown_sizes"))
    return primary.join(totals, "primary", "left").select("tree", "primary", F.col("files").isNotNull().alias("held"), "files", "bytes", "unknown_sizes")


def listed(rows: DataFrame, by: str = "next") -> DataFrame:
    """Rows with their place in the listing of their own catalog."""
    return rows.withColumn("listed", F.row_number().over(Window.partitionBy("catalog_id").orderBy(*sort_keys(by))))


def top_variants(variants: DataFrame, most: int = 10) -> DataFrame:
    """Variants of each parent by downloads, ties by name."""
    w = Window.partitionBy("parent").orderBy(F.col("downloads").desc(), "child")
    return variants.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most)
