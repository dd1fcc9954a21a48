"""Operator 1, language identification by a bidirectional gated recurrent network over bytes.

The network is trained in numpy by backpropagation through time on windows of labelled texts. It labels every
byte position from both sides; a document's probabilities are pooled over all its positions.

Scale: scoring is a narrow map over whole texts; a task holds one slice of about 8 MB, cut into windows that are
stepped through side by side. Learning takes windows of at most `DOCS_PER_LANG` documents for each language; their
ids are few and are broadcast. The network has a few thousand weights.

Edge cases: a text that is null or holds no letter is `und` with score 0; null ids count as held out; null
languages are not learned; with no labelled document at all every text is `und`; with one language it is that one. Of
equal probabilities the label that sorts first is told. Of rows that share an id and a language one is learned from; each row
is tagged on its own. Extra columns are left alone, one that bears the name of a result gives way to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from stockroom.llm import common

UNKNOWN = "und"
#: Labelled documents of each language, and windows of each of them, that are learned from, at most.
DOCS_PER_LANG, WINDOWS = 400, 6
STEPS, HIDDEN = 64, 8
SIDE_BY_SIDE = 4096
PAD = 256


class Direction:
    """Weights of one direction: bytes and states into update gate, reset gate and candidate."""

    def __init__(self, rng: np.random.Generator, hidden: int):
        self.byte = (rng.normal(size=(3 * hidden, PAD + 1)) * 0.3).astype(np.float32)
        self.state = (rng.normal(size=(3 * hidden, hidden)) / hidden**0.5).astype(np.float32)

    def step(self, h: np.ndarray, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """New state, gates (update over reset), reset state and candidate; columns are windows."""
        k = len(h)
        x = self.byte.take(byte, axis=1)
        gates = np.tanh(0.5 * (x[: 2 * k] + self.state[: 2 * k] @ h))
        gates *= 0.5
        gates += 0.5
        reset = gates[k:] * h
        candidate = np.tanh(x[2 * k :] + self.state[2 * k :] @ reset)
        return h + gates[:k] * (candidate - h), gates, reset, candidate


class ByteTagger:
    def __init__(self, labels: list[str], hidden: int = HIDDEN, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.labels, self.hidden = labels, hidden
        self.ways = (Direction(rng, hidden), Direction(rng, hidden))
        self.out = (rng.normal(size=(len(labels), 2 * hidden)) * 0.3).astype(np.float32)
        self.bias = np.zeros((len(labels), 1), np.float32)

    def weights(self) -> list[np.ndarray]:
        return [*(w for d in self.ways for w in (d.byte, d.state)), self.out, self.bias]

    def run(self, way: int, windows: np.ndarray, trace: bool = False):
        """States at every step (steps, hidden, windows); padding resets the state."""
        d, (steps, n) = self.ways[way], windows.shape
        states, h, kept = np.empty((steps, self.hidden, n), np.float32), np.zeros((self.hidden, n), np.float32), [None] * steps
        for t in range(steps) if way == 0 else range(steps - 1, -1, -1):
            before = h
            h, gates, reset, candidate = d.step(h, windows[t])
            h *= windows[t] != PAD
            states[t] = h
            if trace:
                kept[t] = (before, gates, reset, candidate)
        return (states, kept) if trace else states

    def position_probabilities(self, windows: np.ndarray, forward: np.ndarray, backward: np.ndarray) -> Iterator[np.ndarray]:
        k = self.hidden
        for t in range(len(windows)):
            p = self.out[:, :k] @ forward[t] + self.out[:, k:] @ backward[t] + self.bias
            p -= p.max(axis=0)
            np.exp(p, out=p)
            p /= p.sum(axis=0)
            yield p

    def fit(self, windows: np.ndarray, target: np.ndarray, epochs: int = 5, batch: int = 256, rate: float = 0.02, seed: int = 4) -> None:
        """Adam on the mean cross-entropy of all positions; a third of the windows are shortened at random."""
        rng, w = np.random.default_rng(seed), self.weights()
        m, v, step = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w], 0
        total = epochs * -(-windows.shape[1] // batch)
        for _ in range(epochs):
            order = rng.permutation(windows.shape[1])
            for at in range(0, len(order), batch):
                part = order[at : at + batch]
                seen = windows[:, part].copy()
                length = np.where(rng.random(len(part)) < 0.33, rng.integers(4, len(seen) + 1, len(part)), len(seen))
                seen[np.arange(len(seen))[:, None] >= length] = PAD
                step += 1
                pace = rate * min(1.0, 1.2 - step / total) * (1 - 0.999**step) ** 0.5 / (1 - 0.9**step)
                for x, g, mean, square in zip(w, self.gradient(seen, target[part]), m, v):
                    mean += 0.1 * (g - mean)
                    square += 0.001 * (g * g - square)
                    x -= pace * mean / (np.sqrt(square) + 1e-8)

    def gradient(self, windows: np.ndarray, target: np.ndarray) -> list[np.ndarray]:
        """Gradients in the order of `weights()`, by backpropagation through time in both directions."""
        k, (steps, n) = self.hidden, windows.shape
        runs = [self.run(way, windows, trace=True) for way in (0, 1)]
        real = windows != PAD
        scale = 1 / max(real.sum(), 1)
        d_out, d_bias = np.zeros_like(self.out), np.zeros_like(self.bias)
        d_states = [np.empty((steps, k, n), np.float32) for _ in (0, 1)]
        for t, p in enumerate(self.position_probabilities(windows, runs[0][0], runs[1][0])):
            p[target, np.arange(n)] -= 1
            p *= real[t] * scale
            d_bias += p.sum(axis=1, keepdims=True)
            for way in (0, 1):
                d_out[:, way * k : way * k + k] += p @ runs[way][0][t].T
                d_states[way][t] = self.out[:, way * k : way * k + k].T @ p
        grads = []
        for way in (0, 1):
            d, kept = self.ways[way], runs[way][1]
            d_byte, d_state, dh = np.zeros_like(d.byte), np.zeros_like(d.state), np.zeros((k, n), np.float32)
            for t in range(steps - 1, -1, -1) if way == 0 else range(steps):
                before, gates, reset, candidate = kept[t]
                update, r = gates[:k], gates[k:]
                dh = (dh + d_states[way][t]) * real[t]
                da = dh * update * (1 - candidate**2)
                d_reset = d.state[2 * k :].T @ da
                dz = dh * (candidate - before) * update * (1 - update)
                dr = d_reset * before * r * (1 - r)
                dx = np.concatenate([dz, dr, da])
                d_state[: 2 * k] += dx[: 2 * k] @ before.T
                d_state[2 * k :] += da @ reset.T
                for row, g in zip(d_byte, dx):
                    row += np.bincount(windows[t], g, PAD + 1)
                dh = dh * (1 - update) + d_reset * r + d.state[: 2 * k].T @ dx[: 2 * k]
            grads += [d_byte, d_state]
        return [*grads, d_out, d_bias]

    def document_probabilities(self, texts: list[bytes]) -> np.ndarray:
        """One row for each text: the mean of its positions' probabilities (zeros where it is empty)."""
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(lengths)
        data = np.append(np.frombuffer(b"".join(texts), np.uint8).astype(np.int16), np.full(STEPS, PAD, np.int16))
        count = -(-lengths // STEPS)
        doc = np.repeat(np.arange(len(texts)), count)
        starts = (ends - lengths)[doc] + STEPS * (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count))
        total = np.zeros((len(texts), len(self.labels)))
        for at in range(0, len(doc), SIDE_BY_SIDE):
            part = doc[at : at + SIDE_BY_SIDE]
            place = starts[at : at + SIDE_BY_SIDE] + np.arange(STEPS)[:, None]
            windows = np.where(place < ends[part], data[place], PAD)
            real = windows != PAD
            pooled = np.zeros((len(self.labels), len(part)), np.float32)
            for t, p in enumerate(self.position_probabilities(windows, self.run(0, windows), self.run(1, windows))):
                p *= real[t]
                pooled += p
            np.add.at(total, part, pooled.T)
        return total / np.maximum(lengths, 1)[:, None]


def windows_of(texts: list[bytes]) -> np.ndarray:
    """(STEPS, texts): the first bytes of each text, padded."""
    out = np.full((STEPS, len(texts)), PAD, np.int16)
    for k, text in enumerate(texts):
        row = np.frombuffer(text[:STEPS], np.uint8)
        out[: len(row), k] = row
    return out


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> ByteTagger | None:
    """A tagger learned from windows spread over the whole texts of labelled documents that aren't held out."""
    known = docs.where(F.col(lang).isNotNull() & ~common.held_out(F.col(doc_id)))
    known = known.select(F.col(doc_id).alias("__id"), F.col(lang).alias("__lang"), F.xxhash64(doc_id).alias("__h"))
    for keys in (["__lang", F.pmod("__h", F.lit(64))], ["__lang"]):
        known = known.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy("__h", "__id"))).where(F.col("__k") <= DOCS_PER_LANG)
    known = known.select("__id", "__lang").distinct()
    rows = docs.where(F.col(text).isNotNull()).join(F.broadcast(known), (F.col(doc_id) == F.col("__id")) & (F.col(lang) == F.col("__lang")))
    spread = F.transform(F.sequence(F.lit(0), F.lit(WINDOWS - 1)), lambda k: F.substring(F.col(text), 1 + F.floor(F.greatest(F.char_length(text) - STEPS, F.lit(0)) * k / (WINDOWS - 1)).cast("int"), F.lit(STEPS)))
    rows = rows.groupBy("__id", F.col("__lang").alias("lang")).agg(F.min(F.struct(F.xxhash64(text), F.array_distinct(spread).alias("w"))).alias("one"))  # of rows that share both, one
    got = sorted({(r["lang"], w) for r in rows.select("lang", "one.w").collect() for w in r["w"] if any(map(str.isalpha, w))})
    if not got:
        return None
    labels = sorted({lang for lang, _ in got})
    model = ByteTagger(labels)
    model.fit(windows_of([w.encode() for _, w in got]), np.array([labels.index(lang) for lang, _ in got]))
    return model


def tagged(docs: DataFrame, model: ByteTagger | None, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep`, lang_pred, score and the probability of each label."""
    keep = common.kept(keep, "lang_pred", "score", "probabilities")
    slim = docs.select(*keep, F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("__letters"), F.col(text).alias("__text"))
    labels = model.labels if model else []

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.pieces(batches, "__text"):
            letters = batch.column("__letters").to_pylist()
            p = np.zeros((batch.num_rows, 1))
            if model:
                texts = [t.encode() if yes else b"" for t, yes in zip(batch.column("__text").to_pylist(), letters)]
                p = model.document_probabilities(texts)
            best = p.argmax(axis=1)
            lang = [labels[k] if model and yes else UNKNOWN for k, yes in zip(best, letters)]
            score = np.clip(p[np.arange(len(p)), best], 0, 1)
            every = pa.array([dict(zip(labels, row)) if model and yes else {} for row, yes in zip(p.tolist(), letters)], pa.map_(pa.string(), pa.float64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(lang, pa.string()), pa.array(score), every], [*keep, "lang_pred", "score", "probabilities"])

    fields = T.StructType.fromDDL("lang_pred string, score double, probabilities map<string,double>").fields
    return slim.mapInArrow(work, T.StructType([*(slim.schema[c] for c in keep), *fields]))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    found = tagged(docs, learn(docs))
    return found.select("doc_id", common.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
