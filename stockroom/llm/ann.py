"""Operator 7, approximate nearest neighbours by a hierarchical k-means tree.

The tree is fitted on a bounded sample and every row is led down it to a leaf. A query goes through the tree best
bin first: a priority queue holds the branches not yet taken, and leaves are visited in the order in which they
leave it. How many are visited is calibrated: for a bounded set of queries the true neighbours are found by brute
force over all rows, and visits widen until the share of them that lies in visited leaves reaches the target.

Scale: leaves are grouped into branches of about `BRANCH_ROWS` rows, so a query's vector is sent once to each branch
it visits, not to each leaf; a branch with more rows, copies of one vector above all, is dealt into chunks of bounded
size, and a row is sent once for each `QUERY_ROWS` queries that visit its branch, not for each block of all queries. The tree's size is bounded by the sample's. Scores are taken exactly, in doubles, on the original vectors.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components, and null ids, take no part;
only vectors of the most frequent length in the sample are indexed by the tree, others are searched exactly among
their own; of rows that share a query's id the smallest vector asks, and such rows are never its candidates.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockroom.llm import common, vectors

K = 20
#: Rows the tree is fitted on, at most, and rows of it that a leaf holds, about.
SAMPLE_ROWS = 16_384
LEAF_ROWS = 64
BRANCHING = 8
#: Queries that visits are calibrated on, at most, and the share of their true neighbours that must be met.
CALIBRATION_QUERIES = 256
TARGET_RECALL = 0.97
BRANCH_ROWS = 4096


class KMeansTree:
    """Nodes in order of creation; `children[i]` is empty for a leaf, and `leaf[i]` is its number."""

    def __init__(self, sample: np.ndarray, leaf_rows: int = LEAF_ROWS, branching: int = BRANCHING, seed: int = 7):
        self.rng = np.random.default_rng(seed)
        self.centers: list[np.ndarray] = [sample.mean(axis=0)]
        self.reach: list[float] = [0.0]
        self.children: list[list[int]] = [[]]
        self.leaf: list[int] = [-1]
        self.leaves = 0
        self.grow(0, sample, leaf_rows, branching)
        self.points = np.array(self.centers)

    def grow(self, node: int, rows: np.ndarray, leaf_rows: int, branching: int) -> None:
        near = self.cluster(rows, branching) if len(rows) > leaf_rows else None
        if near is None:
            self.leaf[node] = self.leaves
            self.leaves += 1
            return
        for c in range(near.max() + 1):
            part = rows[near == c]
            child = len(self.centers)
            self.centers.append(part.mean(axis=0))
            self.reach.append(float(np.sqrt(((part - self.centers[child]) ** 2).sum(axis=1).mean())))
            self.children.append([])
            self.leaf.append(-1)
            self.children[node].append(child)
        for child, c in zip(self.children[node], range(near.max() + 1)):
            self.grow(child, rows[near == c], leaf_rows, branching)

    def cluster(self, rows: np.ndarray, k: int) -> np.ndarray | None:
        """Lloyd's iterations; the nearest centre of each row, numbered without gaps; None where all rows agree."""
        distinct = np.unique(rows, axis=0)
        if len(distinct) < 2:
            return None
        centers = distinct[self.rng.choice(len(distinct), min(k, len(distinct)), replace=False)]
        for _ in range(12):
            near = nearest(rows, centers)
            used = np.unique(near)
            centers = np.stack([rows[near == c].mean(axis=0) for c in used])
        used, near = np.unique(nearest(rows, centers), return_inverse=True)
        return near if len(used) > 1 else None

    def assign(self, rows: np.ndarray) -> np.ndarray:
        """Each row's leaf, by the nearest child at every node."""
        out, todo = np.zeros(len(rows), np.int32), [(0, np.arange(len(rows)))]
        while todo:
            node, at = todo.pop()
            if not len(at):
                continue
            if not self.children[node]:
                out[at] = self.leaf[node]
                continue
            kids = np.array(self.children[node])
            near = nearest(rows[at], self.points[kids])
            todo += [(int(kid), at[near == c]) for c, kid in enumerate(kids)]
        return out

    def visits(self, query: np.ndarray, most: int) -> list[int]:
        """The first `most` leaves best bin first: the branch whose rows may score highest leaves the queue first."""
        hope = -(self.points @ query + np.sqrt(query @ query) * 0.5 * np.array(self.reach))
        heap, out = [(float(hope[0]), 0)], []
        while heap and len(out) < most:
            _, node = heapq.heappop(heap)
            while self.children[node]:
                best, *rest = sorted((float(hope[c]), c) for c in self.children[node])
                for item in rest:
                    heapq.heappush(heap, item)
                node = best[1]
            out.append(self.leaf[node])
        return out


def nearest(rows: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.argmin((centers**2).sum(axis=1) - 2 * (rows @ centers.T), axis=1)


def exact(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products summed from the first component to the last, so that equal vectors score equal to the last bit."""
    total = np.zeros(len(rows))
    for d in range(len(query)):
        total += query[d] * rows[:, d]
    return total


def best_of(candidates: pd.DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    """(query_id, vec_id, score, leaf): each query's k best in a block, among the leaves that it visits if it names some."""
    out = []
    if len(candidates) and len(queries):
        ids, leaf = candidates["vec_id"].to_numpy(), candidates["leaf"].to_numpy()
        rows, asked = vectors.matrix(candidates), vectors.matrix(queries)
        rough = asked @ rows.T
        slack = 1e-9 * np.sqrt((asked**2).sum(axis=1) * (rows**2).sum(axis=1).max())
        visited = queries["leaves"] if "leaves" in queries else [None] * len(queries)
        for i, (query, leaves) in enumerate(zip(queries["vec_id"], visited)):
            may = ids != query
            if leaves is not None:
                may &= np.isin(leaf, leaves)
            at = np.flatnonzero(may)
            at = at[vectors.at_least(rough[i, at], k, slack[i])]
            score = exact(asked[i], rows[at])
            first = np.lexsort((ids[at], -score))[:k]
            out.append(pd.DataFrame({"query_id": query, "vec_id": ids[at[first]], "score": score[first], "leaf": leaf[at[first]]}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": [], "leaf": []})


FOUND = "query_id long, vec_id long, score double, leaf int"


def calibrated(tree: KMeansTree, dim: int, rows: DataFrame, queries: DataFrame, k: int, target: float, most: int = CALIBRATION_QUERIES) -> int:
    """Leaf visits at which the calibration queries meet `target` of their true neighbours."""
    some = common.cut(common.first_by_hash(queries.where(F.col("dim") == dim), ["vec_id"], most))
    found = vectors.block_pairs(rows, some, lambda c, q: best_of(c, q, k), FOUND)
    true = vectors.ranked(found, k).join(rows.select("vec_id", "leaf").distinct(), "vec_id").select("query_id", "leaf").collect()  # bounded
    asked = {r["vec_id"]: tree.visits(np.array(r["vector"]), tree.leaves) for r in some.select("vec_id", "vector").collect()}
    place = {q: {leaf: at for at, leaf in enumerate(order)} for q, order in asked.items()}
    at = np.array([place[r["query_id"]][r["leaf"]] for r in true])
    visits = 1
    while visits < tree.leaves and len(at) and (at < visits).mean() < target:
        visits += 1
    return visits if len(at) else tree.leaves


def search(table: DataFrame, k: int = K, target: float = TARGET_RECALL, vec_id: str = "vec_id", embedding: str = "embedding", calibration: int = CALIBRATION_QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score) for every stated query against all rows of the index."""
    rows = common.cut(vectors.usable(table, vec_id, embedding, zero=False))
    queries = common.cut(vectors.stated_queries(rows))
    sample = common.first_by_hash(rows, ["vec_id", "vector"], SAMPLE_ROWS).select("dim", "vector").collect()  # bounded
    lengths = [r["dim"] for r in sample]
    dim = max(sorted(set(lengths)), key=lengths.count, default=0)
    tree = KMeansTree(np.array([r["vector"] for r in sample if r["dim"] == dim])) if dim else KMeansTree(np.zeros((1, 1)))

    def leaves(batches):
        for batch in batches:
            leaf, mine = np.full(len(batch), -1, np.int32), (batch["dim"] == dim).to_numpy()
            if mine.any():
                leaf[mine] = tree.assign(vectors.matrix(batch[mine]))
            yield batch.assign(leaf=leaf)

    rows = common.cut(rows.mapInPandas(leaves, "vec_id long, vector array<double>, dim int, leaf int"))
    sizes = {r["leaf"]: r["count"] for r in rows.groupBy("leaf").count().collect()}  # as many as the tree has leaves
    # leaves are numbered depth first, so neighbours in number are neighbours in the tree
    branch, chunks, held = [], [], 0
    for leaf in range(-1, tree.leaves):
        n = sizes.get(leaf, 0)
        if not chunks or leaf == 0 or held + n > BRANCH_ROWS:
            chunks.append(1)
            held = 0
        held += n
        chunks[-1] = 1 + held // BRANCH_ROWS
        branch.append(len(chunks) - 1)
    visits = calibrated(tree, dim, rows, queries, k, target, calibration)

    def routes(batches):
        for batch in batches:
            out = []
            for query, vector, d in zip(batch["vec_id"], batch["vector"], batch["dim"]):
                by: dict[int, list[int]] = {}
                for leaf in tree.visits(np.asarray(vector), visits) if d == dim else [-1]:
                    by.setdefault(branch[leaf + 1], []).append(leaf)
                out += [(query, d, b, x) for b, x in by.items()]
            yield pd.DataFrame(out, columns=["vec_id", "dim", "branch", "leaves"])

    ways = common.cut(queries.mapInPandas(routes, "vec_id long, dim int, branch int, leaves array<int>"))
    asked = {r["branch"]: r["count"] for r in ways.groupBy("branch").count().collect()}  # as many as there are branches
    # a branch is sent once for each QUERY_ROWS queries that visit it, whatever the number of all queries
    blocks = [1 + asked.get(b, 0) // vectors.QUERY_ROWS if b in asked else 0 for b in range(len(chunks))]
    of = lambda values: F.get(F.lit(values), F.col("branch"))
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), (n - 1).cast("long")))
    dealt = ways.join(queries, ["vec_id", "dim"]).withColumn("block", F.pmod(F.xxhash64("vec_id"), of(blocks))).withColumn("chunk", upto(of(chunks)))
    held = rows.withColumn("branch", F.get(F.lit(branch), F.col("leaf") + 1)).where(of(blocks) > 0)
    held = held.withColumn("chunk", F.pmod(F.monotonically_increasing_id(), of(chunks)).cast("long")).withColumn("block", upto(of(blocks)))
    keys = ["dim", "branch", "chunk", "block"]
    fresh = dealt.select(*(F.col(c).alias(c) for c in dealt.columns))
    found = held.groupBy(*keys).cogroup(fresh.groupBy(*keys)).applyInPandas(lambda c, q: best_of(c, q, k), FOUND)
    return vectors.ranked(found, k)


def op7_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(common.read(spark, sf_dir, "embeddings"))
