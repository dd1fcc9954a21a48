"""What the two vector searches share: usable vectors, the stated queries, and both dealt into blocks.

A query set that grows with the table can't be broadcast. Candidates and queries are dealt into blocks of bounded
size, each block of the one meets each block of the other in one group, and only what a search keeps of the scores
goes on. Blocks are dealt by row number, so neither a repeated id nor a group of copies makes a large one.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A query is every row whose id is divisible by this.
QUERY_EVERY = 20
CANDIDATE_ROWS = 4096
QUERY_ROWS = 2048


def usable(table: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", zero: bool = True) -> DataFrame:
    """(vec_id, vector of doubles, dim): rows with an id whose vector isn't null or empty and holds finite components
    only; with zero=False also no zero vector."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = table.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("vector"))
    rows = rows.where("vec_id is not null and size(vector) > 0").where(F.forall("vector", finite)).withColumn("dim", F.size("vector"))
    return rows if zero else rows.where(F.exists("vector", lambda x: x != 0))


def stated_queries(rows: DataFrame) -> DataFrame:
    """One row for each id divisible by QUERY_EVERY; of rows that share it, the smallest vector."""
    return rows.where(F.col("vec_id") % QUERY_EVERY == 0).groupBy("vec_id", "dim").agg(F.min("vector").alias("vector"))


def block_pairs(candidates: DataFrame, queries: DataFrame, work: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """`work(candidates, queries)` for every block of candidates with every block of queries of the same dim.

    Both frames must be cut before, since rows are dealt by their number."""
    blocks = 1 + candidates.count() // CANDIDATE_ROWS
    query_blocks = 1 + queries.count() // QUERY_ROWS
    keys = ["dim", "__c", "__q"]
    dealt = lambda df, n: F.pmod(F.monotonically_increasing_id(), F.lit(n))
    left = candidates.withColumn("__c", dealt(candidates, blocks)).withColumn("__q", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(query_blocks - 1).cast("long"))))
    fresh = queries.select(*(F.col(c).alias(c) for c in queries.columns))  # both sides may stem from one frame
    right = fresh.withColumn("__q", dealt(queries, query_blocks)).withColumn("__c", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(work, schema)


def matrix(frame: pd.DataFrame) -> np.ndarray:
    return np.stack(frame["vector"].to_numpy()) if len(frame) else np.empty((0, 0))


def at_least(scores: np.ndarray, k: int, slack: float = 0.0) -> np.ndarray:
    """Places of the k largest scores with all that tie, or come within `slack` of, the last."""
    if len(scores) <= k:
        return np.arange(len(scores))
    edge = np.partition(scores, len(scores) - k)[len(scores) - k]
    return np.flatnonzero(scores >= edge - slack)


def ranked(found: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of each query, ties to the smaller id.

    Ranked in salted groups first, so that a query's candidates from very many blocks meet in no single group."""
    order = [F.col("score").desc(), F.col("vec_id")]
    first = Window.partitionBy("query_id", F.pmod(F.xxhash64("vec_id", "query_id"), F.lit(16))).orderBy(*order)
    few = found.withColumn("__k", F.row_number().over(first)).where(F.col("__k") <= k)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return few.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
