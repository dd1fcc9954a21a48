"""Operator 10, exact top-k search by distributed histogram selection.

Everything is scored, in blocks. A histogram of scores over all blocks says in which bin each query's k-th value
lies; that bin is divided again until it is one score wide. Then scores at or above the k-th value are kept, and
ties at it go to the smaller ids. Scale: a block sends at most k bins a query, since bins under its own k-th best
can't hold the k-th value of all; scores themselves stay in the block.

Edge cases: vectors that are null, empty or hold null or non-finite components, and null ids, take no part; of
rows that share a query's id the smallest vector asks; rows with the query's id are never its candidates, other
repeated ids count as often as they come; vectors of different lengths aren't compared; with fewer than k
candidates all are returned; scores beyond 2**62 - 1 in size count as that.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stockroom.llm import common, vectors

K = 20
BINS = 1024
MOST = (1 << 62) - 1
SCALE = 64


def scaled(rows: np.ndarray) -> np.ndarray:
    return np.floor(np.clip(SCALE * rows, -1e300, 1e300))


def products(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Integer inner products: exact in doubles where no sum can pass 2**53, else by unbounded integers."""
    q, c = scaled(queries), scaled(candidates)
    if np.abs(q).max() * np.abs(c).max() * q.shape[1] < 2**53:
        return (q @ c.T).astype(np.int64)
    whole = lambda m: np.array([[int(x) for x in row] for row in m], object)
    return np.clip(whole(q) @ whole(c).T, -MOST, MOST).astype(np.int64)


def counts(candidates: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
    """(query_id, bin, n): bins of `width` between `lo` and `hi`, from the top down until `need` scores are counted."""
    out = []
    if len(candidates) and len(queries):
        ids, scores = candidates["vec_id"].to_numpy(), products(vectors.matrix(queries), vectors.matrix(candidates))
        for query, lo, hi, width, need, row in zip(queries["vec_id"], queries["lo"], queries["hi"], queries["width"], queries["need"], scores):
            row = row[(row >= lo) & (row < hi) & (ids != query)]
            n = np.bincount((row - lo) // width, minlength=1)
            bins = np.flatnonzero(n)[::-1]
            enough = np.searchsorted(np.cumsum(n[bins]), need) + 1
            bins = bins[:enough]
            out.append(pd.DataFrame({"query_id": query, "bin": bins, "n": n[bins]}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "bin": [], "n": []})


def kept(candidates: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
    """(query_id, vec_id, score): scores over the k-th value, and of those at it the `need` smallest ids."""
    out = []
    if len(candidates) and len(queries):
        candidates = candidates.sort_values("vec_id")
        ids, scores = candidates["vec_id"].to_numpy(), products(vectors.matrix(queries), vectors.matrix(candidates))
        for query, lo, need, row in zip(queries["vec_id"], queries["lo"], queries["need"], scores):
            others = ids != query
            at = np.append(np.flatnonzero((row > lo) & others), np.flatnonzero((row == lo) & others)[:need])
            out.append(pd.DataFrame({"query_id": query, "vec_id": ids[at], "score": row[at]}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})


def next_bin(rows: DataFrame, state: DataFrame) -> DataFrame:
    """The state with each query's range narrowed to the bin of its k-th value, and what is still needed there.

    A width of zero says that `lo` is that value. A query without candidates goes."""
    found = vectors.block_pairs(rows, state, counts, "query_id long, bin long, n long").groupBy("query_id", "bin").agg(F.sum("n").alias("n"))
    mine = Window.partitionBy("query_id")
    found = found.withColumn("over", F.sum("n").over(mine.orderBy(F.col("bin").desc())) - F.col("n")).withColumn("last", F.min("bin").over(mine))
    upto, need, width = F.col("over") + F.col("n"), F.col("need"), F.col("width")
    short = (F.col("bin") == F.col("last")) & (upto < need)  # fewer candidates than k: all are wanted
    holds = (F.col("over") < need) & (upto >= need)
    lo = F.col("lo") + F.col("bin") * width
    return state.join(found, state["vec_id"] == found["query_id"]).where(short | holds).select(
        "vec_id",
        "dim",
        "vector",
        F.when(short, F.lit(-MOST)).otherwise(lo).alias("lo"),
        F.when(short, F.lit(1 - MOST)).otherwise(F.least(lo + width, "hi")).alias("hi"),
        F.when(short | (width == 1), F.lit(0)).otherwise(F.ceil(width / BINS)).cast("long").alias("width"),
        F.when(short, need).otherwise(need - F.col("over")).alias("need"),
    )


def top_k(table: DataFrame, k: int = K, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) for every stated query against all rows."""
    rows = common.cut(vectors.usable(table, vec_id, embedding))
    queries = common.cut(vectors.stated_queries(rows))
    # no score lies outside these bounds
    norm = lambda df: df.agg(F.max(F.aggregate("vector", F.lit(0.0), lambda s, x: s + (F.abs(x) * SCALE + 1) * (F.abs(x) * SCALE + 1)))).first()[0]
    bound = int(min(float(MOST), 2 + 1.001 * ((norm(rows) or 0) * (norm(queries) or 0)) ** 0.5))
    width = -(-(2 * bound + 1) // BINS)
    first = {"lo": -bound, "hi": bound + 1, "width": width, "need": k}
    state = queries.select("vec_id", "dim", "vector", *(F.lit(v).cast("long").alias(c) for c, v in first.items()))
    done = []
    while True:
        state = common.cut(next_bin(rows, state))
        done.append(state.where("width = 0"))
        state = state.where("width > 0")
        if state.isEmpty():
            break
    final = reduce(DataFrame.union, done)
    return vectors.ranked(vectors.block_pairs(rows, final, kept, "query_id long, vec_id long, score long"), k)


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(common.read(spark, sf_dir, "embeddings"))
