"""Ranks and running sums inside groups that may hold a third of all rows.

A window over such a group is one task. Here rows are dealt by range over key and order, so that a large group lies in many
parts; each part ranks its own rows, and what the parts before it hold is added from one row for each part and group.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

Cut = Callable[[DataFrame], DataFrame]


def running(rows: DataFrame, keys: list[str], order: list[str], cut: Cut, value: str | None = None) -> DataFrame:
    """`rows` with `rank` (from 1) within their keys by `order`, and `upto`: the sum of `value` up to and with the row.

    `order` must tell the rows of a group apart. `cut` stores the dealt rows, whose parts are read twice."""
    placed = cut(rows.repartitionByRange(*keys, *order).withColumn("__part", F.spark_partition_id()))
    own = Window.partitionBy("__part", *keys).orderBy(*order)
    n, total = F.count(F.lit(1)).alias("__n"), F.sum(value or F.lit(0)).alias("__total")
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy("__part", *keys).agg(n, total)
    parts = parts.select("__part", *keys, *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("__n", "__total")))
    upto = F.sum(value or F.lit(0)).over(own.rowsBetween(Window.unboundedPreceding, 0))
    x = placed.withColumns({"__rank": F.row_number().over(own), "__upto": upto}).join(parts, ["__part", *keys])
    return x.select(*rows.columns, (F.col("__rank") + F.col("__n")).alias("rank"), (F.col("__upto") + F.col("__total")).alias("upto"))


def first_rows(rows: DataFrame, keys: list[str], order: list[str | Column], n: int, ties: bool = False) -> DataFrame:
    """The first `n` rows of each group by `order`; with `ties`, all rows that have the first `n` values. The limit is a part of the plan before the shuffle as well, so a task
    sends `n` rows of a group at most, however many it has."""
    place = (F.dense_rank() if ties else F.row_number()).over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("__place", place).where(F.col("__place") <= n).drop("__place")


def by_size(rows: DataFrame, *keys: str, each: int = 500_000) -> DataFrame:
    """Rows dealt by their keys to as many tasks as about `each` rows for one ask for, so that what a task holds doesn't grow."""
    return rows.repartition(parts(rows, each), *keys)


def parts(rows: DataFrame, each: int = 500_000) -> int:
    """Tasks that `each` rows for one ask for, and no fewer than a shuffle has anyway."""
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 + rows.count() // each)
