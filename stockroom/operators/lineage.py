"""Families of releases and the graph of declared parents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def generation_key(generation: Column) -> Column:
    """Numbers of a dotted generation as an array, which sorts element by element; none or no number sorts first."""
    digits = F.regexp_extract_all(F.coalesce(generation, F.lit("")), F.lit(r"(\d+)"))
    return F.when(F.size(digits) == 0, F.array(F.lit(-1))).otherwise(F.transform(digits, lambda d: d.cast("int")))


def family_tree(rows: DataFrame) -> DataFrame:
    """Members, home publisher and spelling of each family and generation; families meet without case.

    `rows`: source, publisher, family, generation, provider (true for a reference to a provider, which weighs twice
    an address in the vote on spelling). Ties go to the smaller name."""
    x = rows.where("family is not null").withColumn("key", F.lower("family"))
    vote = x.groupBy("key", "family").agg(F.sum(F.when(F.col("provider"), 2).otherwise(1)).alias("votes"))
    home = x.where("publisher is not null").groupBy("key", "publisher").agg(F.count("*").alias("votes"))
    most = lambda df, name: df.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy(F.col("votes").desc(), name))).where("n = 1").select("key", name)
    groups = x.groupBy("key", "generation").agg(F.count("*").alias("members"), F.min("source").alias("first"))
    return groups.join(most(vote, "family"), "key").join(most(home, "publisher"), "key", "left")


def parents(metadata: DataFrame) -> DataFrame:
    """Edges that metadata declares: card parents first, then tags, then training sets; the first of a pair wins.

    `metadata`: child, card_parents, card_relation, tags, card_datasets."""
    card = metadata.select("child", F.posexplode("card_parents").alias("n", "parent"), F.col("card_relation").alias("relation"), F.lit(0).alias("rank"), F.lit("card").alias("declared_by"))
    tag = r"^base_model:(?:(adapter|finetune|merge|quantized):)?([^:]+/[^:]+)$"
    tagged = metadata.select("child", "card_relation", F.posexplode("tags").alias("n", "tag")).where(F.col("tag").rlike(tag))
    stated = F.regexp_extract("tag", tag, 1)
    tagged = tagged.select("child", "n", F.regexp_extract("tag", tag, 2).alias("parent"), F.when(stated != "", stated).otherwise(F.col("card_relation")).alias("relation"), F.lit(1).alias("rank"), F.lit("tag").alias("declared_by"))
    trained = metadata.select("child", F.posexplode("card_datasets").alias("n", "parent"), F.lit("trained_on").alias("relation"), F.lit(2).alias("rank"), F.lit("card").alias("declared_by"))
    # a relation that only a tag states fills the card's parent
    every = card.unionByName(tagged).unionByName(trained)
    stated_for = tagged.groupBy("child", "parent").agg(F.min_by("relation", "n").alias("tag_relation"))
    first = every.withColumn("k", F.row_number().over(Window.partitionBy("child", "parent").orderBy("rank", "n"))).where("k = 1")
    return first.join(stated_for, ["child", "parent"], "left").select("child", "parent", F.coalesce("tag_relation", "relation").alias("relation"), "declared_by")


def descendants(edges: DataFrame) -> DataFrame:
    """Children of each parent by relation."""
    kinds = ("quantized", "finetune", "adapter", "merge", "trained_on")
    return edges.groupBy("parent").agg(F.count("*").alias("children"), *(F.count_if(F.col("relation") == k).alias(k) for k in kinds))


def graph_edges(metadata: DataFrame, forks: DataFrame, references: DataFrame) -> DataFrame:
    """All edges as one table: declared parents, forks (child, parent) and the primary works of source trees (tree,
    primary); a declared pair wins over a fork, and that over a reference."""
    every = parents(metadata).withColumn("rank", F.lit(0))
    fork = forks.select("child", "parent", F.lit("fork").alias("relation"), F.lit("provider").alias("declared_by"), F.lit(1).alias("rank"))
    read = references.where("primary is not null").select(F.col("tree").alias("child"), F.col("primary").alias("parent"), F.lit("references").alias("relation"), F.lit("scan").alias("declared_by"), F.lit(2).alias("rank"))
    first = F.min_by(F.struct("relation", "declared_by"), "rank").alias("e")
    return every.unionByName(fork).unionByName(read).groupBy("child", "parent").agg(first).select("child", "parent", "e.relation", "e.declared_by")


def ancestors(edges: DataFrame, cut: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Every ancestor and the fewest steps to it, at any depth; cycles end there.

    Each round doubles the steps: known ways meet known ways, so a chain of n takes about log2(n) rounds. A round ends in
    `cut` (a checkpoint or a stored table), and the last is the one that adds or shortens nothing."""
    known = cut(edges.where("child <> parent").select("child", F.col("parent").alias("ancestor"), F.lit(1).alias("depth")).distinct())
    state = None
    while True:
        further = known.select(F.col("child").alias("ancestor"), F.col("ancestor").alias("next"), F.col("depth").alias("more"))
        ways = known.join(further, "ancestor").where("child <> next").select("child", F.col("next").alias("ancestor"), (F.col("depth") + F.col("more")).alias("depth"))
        known = cut(known.union(ways).groupBy("child", "ancestor").agg(F.min("depth").alias("depth")))
        now = tuple(known.agg(F.count("*"), F.sum("depth")).first())
        if now == state:
            return known
        state = now
