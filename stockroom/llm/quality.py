"""Operator 9, a quality classifier as a sparse ensemble of rules.

Statistics of a text are Spark columns. Small trees are fitted to them on a bounded sample of labelled rows, every
path of a tree becomes a rule (a conjunction of thresholds), a lasso logistic fit weights the rules and drops most,
and what is left is compiled back into one Spark column.

Scale: scoring is a narrow, JVM-side map over whole texts. Learning scans the texts once, joined to at most
`SAMPLE_ROWS` labelled ids, which are broadcast; only their statistics reach the driver.

Edge cases: a null or empty text has statistics of zero and is scored like any other; null ids count as held out;
labels that are null are not learned from, of labels that share an id the largest counts; without labels of both
kinds every score is the share of label 1 (one half without labels).
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stockroom.llm import common

#: Labelled rows that the rules are learned from, at most.
SAMPLE_ROWS = 20_000
TREES, DEPTH, LEAST = 24, 3, 8
#: Weight of the lasso term.
LASSO = 2e-3
THRESHOLD = 0.3

#: feature, threshold, True for "above"
Condition = tuple[int, float, bool]


def statistics(docs: DataFrame, text: str = "text") -> tuple[DataFrame, dict[str, Column]]:
    """The rows with their words and lines, and per-text statistics over these: ratios or logarithms but the longest word."""
    whole = F.coalesce(F.col(text), F.lit(""))
    docs = docs.withColumns({"__words": F.split(F.trim(whole), r"\s+"), "__lines": F.split(whole, "\n")})
    words, lines = F.col("__words"), F.col("__lines")
    n, n_words = F.greatest(F.char_length(whole), F.lit(1)), F.size(words)
    share = lambda pattern: F.regexp_count(whole, F.lit(pattern)) / n
    same = F.zip_with(words, F.slice(words, 2, n_words), lambda a, b: F.coalesce(a == b, F.lit(False)))
    return docs, {
        "log_chars": F.log1p(F.char_length(whole).cast("double")),
        "word_length": n / n_words,
        "longest_word": F.array_max(F.transform(words, F.char_length)).cast("double"),
        "upper": share(r"\p{Lu}"),
        "digits": share(r"\p{Nd}"),
        "symbols": share(r"[^\p{L}\p{N}\s.,]"),
        "distinct_words": F.size(F.array_distinct(words)) / n_words,
        "repeated_next": F.size(F.filter(same, lambda x: x)) / n_words,
        "distinct_lines": F.size(F.array_distinct(lines)) / F.size(lines),
    }


def grow(x: np.ndarray, residual: np.ndarray, rows: np.ndarray, features: np.ndarray, path: tuple[Condition, ...], depth: int) -> list[tuple[tuple[Condition, ...], np.ndarray, float]]:
    """Nodes of a least-squares tree under the root as (path, rows, mean)."""
    if depth == 0 or len(rows) < 2 * LEAST:
        return []
    best, total = None, residual[rows].sum()
    for f in features:
        order = rows[np.argsort(x[rows, f], kind="stable")]
        value, left = x[order, f], np.cumsum(residual[order])[:-1]
        k = np.arange(1, len(rows))
        gain = left**2 / k + (total - left) ** 2 / (len(rows) - k)
        gain[(value[1:] <= value[:-1]) | (k < LEAST) | (len(rows) - k < LEAST)] = -1
        at = int(np.argmax(gain))
        if gain[at] > (best[0] if best else total**2 / len(rows) + 1e-12):
            best = (gain[at], int(f), float((value[at] + value[at + 1]) / 2))
    if best is None:
        return []
    _, f, cut = best
    out = []
    for above in (False, True):
        part = rows[(x[rows, f] > cut) == above]
        here = (*path, (f, cut, above))
        out += [(here, part, float(residual[part].mean()))] + grow(x, residual, part, features, here, depth - 1)
    return out


def learn_rules(x: np.ndarray, y: np.ndarray, seed: int = 5) -> list[tuple[Condition, ...]]:
    """Paths of boosted trees, each fitted to half the rows and two thirds of the statistics."""
    rng, score, found = np.random.default_rng(seed), np.zeros(len(y)), {}
    for _ in range(TREES):
        residual = y - 1 / (1 + np.exp(-score))
        rows = np.flatnonzero(rng.random(len(y)) < max(0.5, min(1.0, 400 / len(y))))
        features = rng.permutation(x.shape[1])[: -(-2 * x.shape[1] // 3)]
        nodes = grow(x, residual, rows, np.sort(features), (), DEPTH)
        for path, _, mean in nodes:
            found[tuple(sorted(path))] = None
            if len(path) == DEPTH or not any(other[: len(path)] == path and len(other) > len(path) for other, _, _ in nodes):
                score[holds(x, path)] += 2 * mean
    return list(found)


def holds(x: np.ndarray, rule: tuple[Condition, ...]) -> np.ndarray:
    return np.logical_and.reduce([(x[:, f] > cut) == above for f, cut, above in rule])


def lasso_logistic(a: np.ndarray, y: np.ndarray, lasso: float = LASSO, rounds: int = 400) -> tuple[float, np.ndarray]:
    """Bias and weights by accelerated proximal gradient steps; the bias isn't shrunk."""
    n, k = a.shape
    a = np.hstack([np.ones((n, 1)), a])
    step = 4 * n / max(np.linalg.norm(a, 2) ** 2, 1e-9)
    w = z = np.zeros(k + 1)
    t = 1.0
    for _ in range(rounds):
        new = z - step * (a.T @ (1 / (1 + np.exp(-(a @ z))) - y)) / n
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * lasso, 0)
        t, old = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        z, w = new + (old - 1) / t * (new - w), new
    return float(w[0]), w[1:]


class RuleEnsemble:
    """Weighted rules over statistics in a fixed order."""

    def __init__(self, names: list[str], bias: float, rules: list[tuple[tuple[Condition, ...], float]]):
        self.names, self.bias, self.rules = names, bias, rules

    @classmethod
    def fit(cls, names: list[str], x: np.ndarray, y: np.ndarray) -> RuleEnsemble:
        if len(set(y.tolist())) < 2:
            share = float(y.mean()) if len(y) else 0.5
            share = min(max(share, 1e-6), 1 - 1e-6)
            return cls(names, float(np.log(share / (1 - share))), [])
        rules = learn_rules(x, y)
        bias, weights = lasso_logistic(np.stack([holds(x, r) for r in rules], axis=1).astype(float), y)
        return cls(names, bias, [(r, float(w)) for r, w in zip(rules, weights) if w])

    def column(self, of: dict[str, Column]) -> Column:
        """The score, between 0 and 1."""
        test = lambda c: of[self.names[c[0]]] > F.lit(c[1]) if c[2] else of[self.names[c[0]]] <= F.lit(c[1])
        terms = [F.when(reduce(lambda a, b: a & b, map(test, rule)), F.lit(w)).otherwise(F.lit(0.0)) for rule, w in self.rules]
        return 1 / (1 + F.exp(-reduce(lambda a, b: a + b, terms, F.lit(self.bias))))


def learn(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality") -> RuleEnsemble:
    """Rules learned from labelled documents whose id isn't held out."""
    known = labels.select(F.col(doc_id).alias("__id"), F.col(label).alias("__y")).where(F.col("__y").isNotNull() & ~common.held_out(F.col("__id")))
    known = common.first_by_hash(known.groupBy("__id").agg(F.max("__y").alias("__y")), ["__id"], SAMPLE_ROWS)
    rows, stats = statistics(docs.join(F.broadcast(known), F.col(doc_id) == F.col("__id")), text)
    rows = rows.select(F.col("__y").cast("double").alias("y"), *(c.cast("double").alias(n) for n, c in stats.items()))
    got = np.array(sorted(tuple(r) for r in rows.orderBy(F.xxhash64(*stats), *stats).limit(SAMPLE_ROWS).collect()), float).reshape(-1, len(stats) + 1)
    return RuleEnsemble.fit(list(stats), got[:, 1:], (got[:, 0] >= 1).astype(float))


def scored(docs: DataFrame, model: RuleEnsemble, text: str = "text", score: str = "score") -> DataFrame:
    """`docs` with the score, in place of a column of that name; statistics are projected once and dropped."""
    docs = common.without(docs, score)
    rows, stats = statistics(docs, text)
    wide = rows.select("*", *(c.cast("double").alias(f"__{n}") for n, c in stats.items()))
    return wide.select(*(F.col(f"`{c}`") for c in docs.columns), model.column({n: F.col(f"__{n}") for n in stats}).alias(score))


def keep_good(docs: DataFrame, model: RuleEnsemble, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Rows and columns of the documents that the model doesn't reject."""
    return scored(docs, model, text, "__score").where(F.col("__score") >= threshold).drop("__score")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn(docs, common.read(spark, sf_dir, "labels"))
    out = scored(docs, model)
    return out.select("doc_id", common.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
