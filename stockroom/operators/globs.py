"""Tables of globs met by tables of paths, as equi-joins.

Nearly every glob in use is a name, a `*` before an ending or a beginning before a `*`. Such a glob is a key: a path looks up its
whole text, its endings and its beginnings of the lengths that the table has, so a thousand globs cost what ten do. Globs with
anything else in them are tried one by one on the rows of their own group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def glob_column(pattern: Column) -> Column:
    """A column of globs as anchored regular expressions; `*` and `?` cross `/` and are literal inside brackets."""
    x = F.regexp_replace(pattern, r"([.+^${}()|\\])", r"\\$1")
    for glob, regex in ((r"\*(?![^\[]*\])", ".*"), (r"\?(?![^\[]*\])", "."), (r"\[!", "[^")):
        x = F.regexp_replace(x, glob, regex)
    return F.concat(F.lit("(?s)^"), x, F.lit("$"))


def fitting(rows: DataFrame, patterns: DataFrame, on: list[str], text: Column, glob: str = "glob", small: bool = False) -> DataFrame:
    """`rows` with the columns of each pattern of their group (`on`) whose glob fits `text`, a column of `rows`.

    `small` says that the caller has checked the size of `patterns`, which is then broadcast."""
    g = F.regexp_replace(glob, r"\*+", "*")
    plain = ~g.rlike(r"[?\[]")
    kind = F.when(plain & ~F.contains(g, F.lit("*")), "is").when(plain & g.rlike(r"^\*[^*]*$"), "ends").when(plain & g.rlike(r"^[^*]*\*$"), "starts").otherwise("glob")
    named = patterns.withColumns({"__kind": kind, "__key": F.replace(g, F.lit("*"), F.lit(""))})
    lengths: dict[str, list[int]] = {}
    for of, n in sorted(named.select("__kind", F.when(F.col("__kind").isin("ends", "starts"), F.char_length("__key")).otherwise(0)).distinct().collect()):  # no more than the longest glob has characters, twice
        lengths.setdefault(of, []).append(n)
    meet = F.broadcast if small else lambda table: table

    x = rows.withColumn("__text", text)
    key = lambda of, value: F.struct(F.lit(of).alias("__kind"), value.alias("__key"))
    some = lambda of, cut: F.transform(F.filter(F.array(*map(F.lit, lengths[of])), lambda n: n <= F.char_length("__text")), lambda n: key(of, cut(n)))
    keys = [F.array(key("is", F.col("__text")))] if "is" in lengths else []
    keys += [some("ends", lambda n: F.right(F.col("__text"), n))] if "ends" in lengths else []
    keys += [some("starts", lambda n: F.left(F.col("__text"), n))] if "starts" in lengths else []
    out = None
    if keys:
        looked = x.select("*", F.inline(F.concat(*keys)))
        out = looked.join(meet(named.where("__kind <> 'glob'")), [*on, "__kind", "__key"]).drop("__kind", "__key", "__text")
    if "glob" in lengths or out is None:
        odd = named.where("__kind = 'glob'").withColumn("__regex", glob_column(F.col(glob))).drop("__kind", "__key")
        tried = x.join(meet(odd), on).where(F.rlike("__text", F.col("__regex"))).drop("__regex", "__text")
        out = tried if out is None else out.unionByName(tried)
    return out
