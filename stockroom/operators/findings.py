"""Data-quality findings: their identity, selection, order, report and difference between runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEVERITIES = ("info", "warning", "critical")


def finding_id(check: Column, path: Column, summary: Column) -> Column:
    """The check and the first ten hexadecimal digits of a digest of it and what it is about."""
    about = F.coalesce(path, summary, F.lit(""))
    return F.concat(check, F.lit(":"), F.substring(F.sha2(F.concat(check, F.char(F.lit(0)), about), 256), 1, 10))


def redacted(text: Column) -> Column:
    """Values of secret-looking settings masked."""
    return F.regexp_replace(text, r"(?i)(token|password|secret|api[_-]?key)(\s*[:=]\s*)([^\s,;]+)", "$1$2[redacted]")


def selected(findings: DataFrame, only: list[str] | None = None, skip: list[str] | None = None, least: str = "info") -> DataFrame:
    """Findings by check or id, from a severity on."""
    rank = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity"))
    out = findings.where(rank >= SEVERITIES.index(least) + 1)
    named = lambda names: F.col("check_id").isin(*names) | F.col("id").isin(*names)
    if only:
        out = out.where(named(only))
    return out.where(~named(skip)) if skip else out


def from_diff(diff: DataFrame) -> DataFrame:
    """Integrity differences as findings."""
    severity = F.when(F.col("verdict") == "extra", "warning").otherwise("critical")
    path = F.concat_ws("/", "aid", "path")
    return diff.select(finding_id(F.lit("payload"), path, F.lit(None)).alias("id"), F.lit("payload").alias("check_id"), severity.alias("severity"), path.alias("path"), F.col("verdict").alias("summary"))


def from_manifests(rows: DataFrame) -> DataFrame:
    """Standings of manifests (file, standing) as findings: unreadable and unsupported ones are critical, an older form
    is a warning with an action."""
    bad = rows.where("standing <> 'current'")
    severity = F.when(F.col("standing") == "migrate", "warning").otherwise("critical")
    return bad.select(finding_id(F.lit("manifest"), F.col("file"), F.lit(None)).alias("id"), F.lit("manifest").alias("check_id"), severity.alias("severity"), F.col("file").alias("path"), F.col("standing").alias("summary"))


def from_paths(unsafe: DataFrame) -> DataFrame:
    """Unsafe paths (aid, path) as findings."""
    path = F.concat_ws("/", "aid", "path")
    return unsafe.select(finding_id(F.lit("paths"), path, F.lit(None)).alias("id"), F.lit("paths").alias("check_id"), F.lit("critical").alias("severity"), path.alias("path"), F.lit("outside the payload").alias("summary"))


def ordered(findings: DataFrame) -> DataFrame:
    """By check, then path."""
    return findings.orderBy("check_id", "path", "id")


def assembled(*checks: DataFrame, only: list[str] | None = None, skip: list[str] | None = None, least: str = "info") -> DataFrame:
    """What several checks found as one table, selected; a finding that two checks report counts once."""
    every = checks[0]
    for more in checks[1:]:
        every = every.unionByName(more)
    return selected(every.dropDuplicates(["id"]), only, skip, least)


def report(findings: DataFrame) -> DataFrame:
    """Counts by severity and the overall status."""
    out = findings.agg(*(F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES), F.count("*").alias("findings"))
    return out.withColumn("status", F.when(F.col("critical") > 0, "degraded").when(F.col("warning") > 0, "partial").otherwise("healthy"))


def difference(before: DataFrame, after: DataFrame) -> DataFrame:
    """Findings that are new, resolved or persisting, by id."""
    b, a = before.select("id", F.lit(True).alias("b")).distinct(), after.select("id", F.lit(True).alias("a")).distinct()
    state = F.when(F.col("b").isNull(), "new").when(F.col("a").isNull(), "resolved").otherwise("persisting")
    return b.join(a, "id", "full").select("id", state.alias("state"))
