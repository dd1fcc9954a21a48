"""Operator 5, language-model scores by masked pseudo-likelihood.

A window network predicts every token from those on both its sides; the summed conditional log-probabilities score
a document. Tokens are words. Its output is factored: a class, a member of the class, and where the member is one of
BUCKETS shared by all words beyond the WORDS most frequent ones, the word's share of that bucket by its count in the
whole corpus. So no two words are confounded, and what a score rests on grows with the corpus.

The network sees a neighbour as one of a few kinds (the most frequent words each their own, the others by bands of rank),
the next ones finely and those beyond coarsely. A window is then one of CONTEXTS, and which word stands how often in which
context is all that this training needs of the texts: every position of every text counts, sums commute, and neither that model
nor a score by it depends on how rows lie in files or partitions.

From there `with_windows` goes on, and operator 5's query scores by it: each of the VOCABULARY ids has a vector of its own at each
of the four places, learned from every window of all texts in tasks whose weights are averaged. What it learns depends on
which texts lie in a task together.

Scale: texts are encoded once, in blocks of stored rows. Distinct words of a block go to buckets of a hash, which send back
counts over all texts; a word that a third of all rows hold is sent once by each block. Counts by context come combined
from each task. What meets on the driver is bounded by the model: CONTEXTS x VOCABULARY counts and a histogram of counts.
Two words with one 64-bit hash would share their count.

Edge cases: null texts and texts without a word have no tokens, log-probability 0 and a null mean; words that the corpus
lacks count as seen less than once; null ids and repeated rows pass through; an empty table gives an empty result; a
column that bears the name of a result gives way to it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockroom.llm import common

#: Words with an id of their own, and buckets that all others share.
WORDS, BUCKETS = 3840, 256
VOCABULARY = WORDS + BUCKETS
CLASS = 64
#: Kinds of a neighbour by its rank: the first words one by one, then bands; shared words and the end of a text come last.
ALONE, BANDS = 11, (11, 64, 512, WORDS)
NEAR = ALONE + len(BANDS) + 1
#: Kinds of the neighbours beyond: frequent words, and all else.
FAR, FREQUENT = 2, 64
SIDE, HIDDEN = 2, 32
#: Windows of one step, and the lengths of steps for the vectors at the places and for the output.
STEP, PLACE_RATE, OUTPUT_RATE = 16384, 0.15, 0.02
#: Units of the sums from which tasks' weights are averaged; whole numbers, so that their order is nothing.
UNIT = 2.0**-24
CONTEXTS = FAR * NEAR * NEAR * FAR
ROUNDS, RATE = 120, 0.05
BLOCK_BYTES = 4 << 20
#: Bytes of word hashes that one bucket is meant to hold.
NAME_BYTES = 8 << 20
SLICES = 64
U64 = np.uint64


@dataclass
class Corpus:
    """What is learned from all texts: hashes of the words with an id, the log-probability of every id in every context,
    tokens and distinct words of each bucket, and a stored table of the counts of all words."""

    words: np.ndarray
    table: np.ndarray
    bucket_tokens: np.ndarray
    bucket_words: np.ndarray
    counts: DataFrame
    buckets: int
    network: WindowNetwork | None = None
    windows: Windows | None = None

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        return ids_of(self.words, hashes)

    def shares(self, hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Log of each word's share of its bucket; zero for words with an id of their own."""
        own, bucket = self.ids(hashes) < WORDS, (hashes % U64(BUCKETS)).astype(np.int64)
        share = np.log((counts + 0.5) / (self.bucket_tokens[bucket] + 0.5 * self.bucket_words[bucket] + 0.5))
        return np.where(own, 0.0, share)


def ids_of(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The rank of each word, or its bucket behind all ranks. `words` are hashes by rank."""
    order = np.argsort(words)
    at = np.searchsorted(words[order], hashes)
    hit = (at < len(words)) & (words[order][np.minimum(at, len(words) - 1)] == hashes) if len(words) else np.zeros(len(hashes), bool)
    rank = order[np.minimum(at, len(words) - 1)] if len(words) else np.zeros(len(hashes), np.int64)
    return np.where(hit, rank, WORDS + (hashes % U64(BUCKETS)).astype(np.int64))


def kinds() -> tuple[np.ndarray, np.ndarray]:
    """The near and the far kind of every id, and of the end of a text behind them."""
    near = np.full(VOCABULARY + 1, NEAR - 1)
    near[:ALONE] = np.arange(ALONE)
    for k, (low, high) in enumerate(zip(BANDS, (*BANDS[1:], VOCABULARY))):
        near[low:high] = ALONE + k
    far = (np.arange(VOCABULARY + 1) >= FREQUENT).astype(np.int64)
    return near, far


def contexts(ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The context of each token of texts that stand one behind the other, `sizes` tokens each."""
    near, far = kinds()
    end = VOCABULARY
    wide = np.full(len(ids) + 2 * SIDE * (len(sizes) + 1), end)
    at = np.arange(len(ids)) + np.repeat(2 * SIDE * np.arange(1, len(sizes) + 1), sizes)
    wide[at] = ids
    return ((far[wide[at - 2]] * NEAR + near[wide[at - 1]]) * NEAR + near[wide[at + 1]]) * FAR + far[wide[at + 2]]


class WindowNetwork:
    """Tables of what each neighbour adds to the hidden layer, and the factored output."""

    def __init__(self, counts: np.ndarray, seed: int = 9, kind: type = np.float32):
        """Output biases start from the counts of the ids."""
        rng = np.random.default_rng(seed)
        drawn = lambda *shape: rng.normal(size=shape).astype(kind)
        self.left_far, self.left, self.right, self.right_far = (drawn(n, HIDDEN) * kind(0.3) for n in (FAR, NEAR, NEAR, FAR))
        self.classes = drawn(HIDDEN, VOCABULARY // CLASS) * kind(0.1)
        self.members = drawn(HIDDEN, VOCABULARY) * kind(0.1)
        share = (counts + 0.5).reshape(-1, CLASS)
        self.class_bias = np.log(share.sum(axis=1) / share.sum()).astype(kind)
        self.member_bias = np.log(share / share.sum(axis=1, keepdims=True)).ravel().astype(kind)
        c = np.arange(CONTEXTS)
        self.at = (c // (NEAR * NEAR * FAR), c // (NEAR * FAR) % NEAR, c // FAR % NEAR, c % FAR)

    def weights(self) -> list[np.ndarray]:
        return [self.left_far, self.left, self.right, self.right_far, self.classes, self.members, self.class_bias, self.member_bias]

    def hidden(self) -> np.ndarray:
        return np.tanh(sum(w[k] for w, k in zip(self.weights(), self.at)))

    def log_probabilities(self) -> np.ndarray:
        """Of every id in every context."""
        h = self.hidden()
        cls = log_softmax(h @ self.classes + self.class_bias)
        member = log_softmax((h @ self.members + self.member_bias).reshape(CONTEXTS, -1, CLASS))
        return (cls[:, :, None] + member).reshape(CONTEXTS, VOCABULARY)

    def loss(self, counts: np.ndarray) -> float:
        return float(-(counts * self.log_probabilities()).sum())

    def gradient(self, counts: np.ndarray) -> list[np.ndarray]:
        """Of the mean loss; `counts` says which share of all positions each id in each context has."""
        h = self.hidden()
        blocks = counts.reshape(CONTEXTS, -1, CLASS)
        in_class = blocks.sum(axis=2)
        d_class = softmax(h @ self.classes + self.class_bias) * in_class.sum(axis=1, keepdims=True) - in_class
        d_member = softmax((h @ self.members + self.member_bias).reshape(CONTEXTS, -1, CLASS))
        d_member *= in_class[:, :, None]
        d_member -= blocks
        d_member = d_member.reshape(CONTEXTS, VOCABULARY)
        d_hidden = (d_class @ self.classes.T + d_member @ self.members.T) * (1 - h * h)
        tables = []
        for w, k in zip(self.weights(), self.at):
            g = np.zeros_like(w)
            np.add.at(g, k, d_hidden)
            tables.append(g)
        return [*tables, h.T @ d_class, h.T @ d_member, d_class.sum(axis=0), d_member.sum(axis=0)]

    def learn(self, counts: np.ndarray, rounds: int = ROUNDS, rate: float = RATE) -> WindowNetwork:
        """Gradient descent with adaptive steps over all positions at once."""
        counts = (counts / counts.sum()).astype(self.members.dtype)
        mean, square = ([np.zeros_like(w) for w in self.weights()] for _ in range(2))
        for t in range(1, rounds + 1):
            for w, g, m, v in zip(self.weights(), self.gradient(counts), mean, square):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                w -= rate * (1 - t / (rounds + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        return self


class Windows:
    """The network with a vector of its own for every id at each of the four places, from the texts' windows themselves.

    It starts from a `WindowNetwork`, where all ids of a kind share the kind's vector."""

    def __init__(self, network: WindowNetwork):
        near, far = kinds()
        self.places = [w[k] for w, k in zip(network.weights()[:4], (far, near, near, far))]
        members = network.members.reshape(HIDDEN, -1, CLASS).transpose(1, 0, 2)
        self.output = [network.classes, network.class_bias, np.ascontiguousarray(members), network.member_bias.reshape(-1, CLASS)]

    def weights(self) -> list[np.ndarray]:
        return [*self.places, *self.output]

    def copy(self) -> Windows:
        other = object.__new__(Windows)
        other.places, other.output = [w.copy() for w in self.places], [w.copy() for w in self.output]
        return other

    def learning(self) -> Windows:
        self.squares = [np.full_like(w, 0.01) for w in self.weights()]
        return self

    def batch(self, window: list[np.ndarray], ids: np.ndarray, learn: bool) -> tuple[np.ndarray, list]:
        """Log-probability of each id in its window (ids at each place); and the gradient of their negative sum: (ids,
        gradient) of each place, and that of the output's weights."""
        cls = ids // CLASS
        order = np.argsort(cls.astype(np.uint8), kind="stable")
        window, cls, member = [x[order] for x in window], cls[order], ids[order] % CLASS
        h = sum(w[x] for w, x in zip(self.places, window))
        np.tanh(h, out=h)
        classes, class_bias, members, member_bias = self.output
        safe = max(np.abs(classes).sum(axis=0).max() + np.abs(class_bias).max(), np.abs(members).sum(axis=1).max() + np.abs(member_bias).max()) < 80
        found, gradient = np.zeros(len(ids), h.dtype), [np.zeros_like(w) for w in self.output] if learn else []

        def softmax_of(x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            if not safe:
                x -= x.max(axis=1, keepdims=True)
            hit = x[np.arange(len(x)), at]
            np.exp(x, out=x)
            total = x.sum(axis=1)
            if learn:
                x /= total[:, None]
                x[np.arange(len(x)), at] -= 1
            return hit - np.log(total), x

        found, e = softmax_of(h @ classes + class_bias, cls)
        if learn:
            d = e @ classes.T
            gradient[0], gradient[1] = h.T @ e, e.sum(axis=0)
        starts = np.searchsorted(cls, np.arange(len(members) + 1))
        for c in np.flatnonzero(np.diff(starts)):
            of = slice(starts[c], starts[c + 1])
            likely, e = softmax_of(h[of] @ members[c] + member_bias[c], member[of])
            found[of] += likely
            if learn:
                d[of] += e @ members[c].T
                gradient[2][c], gradient[3][c] = h[of].T @ e, e.sum(axis=0)
        back = np.empty_like(found)
        back[order] = found
        if not learn:
            return back, []
        d *= 1 - h * h
        sums = []
        for x in window:
            by = np.argsort(x.astype(np.uint16), kind="stable")
            x = x[by]
            first = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
            sums.append((x[first], np.add.reduceat(d[by], first, axis=0)))
        return back, [*sums, *gradient]

    def step(self, window: list[np.ndarray], ids: np.ndarray) -> None:
        """One step down the gradient, each weight by what its gradients have been."""
        _, gradient = self.batch(window, ids, True)
        for w, q, (at, g) in zip(self.places, self.squares, gradient[:4]):
            q[at] += g * g
            w[at] -= PLACE_RATE * g / np.sqrt(q[at])
        for w, q, g in zip(self.output, self.squares[4:], gradient[4:]):
            q += g * g
            w -= OUTPUT_RATE * g / np.sqrt(q)


def surroundings(ids: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """The ids at each place of the window around each token of texts that stand one behind the other."""
    wide = np.full(len(ids) + 2 * SIDE * (len(sizes) + 1), VOCABULARY)
    at = np.arange(len(ids)) + np.repeat(2 * SIDE * np.arange(1, len(sizes) + 1), sizes)
    wide[at] = ids
    return [wide[at + k] for k in (-2, -1, 1, 2)]


def log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(axis=-1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=-1, keepdims=True))


def softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=-1, keepdims=True))
    x /= x.sum(axis=-1, keepdims=True)
    return x


def squeezed(values: np.ndarray, kind: str) -> bytes:
    return zlib.compress(values.astype(kind).tobytes(), 1)


def loosened(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), kind)


def cut_up(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens of each text, place of each token among the distinct words, hashes of these)."""
    lists = pc.utf8_split_whitespace(pc.fill_null(texts.cast(pa.string()), ""))
    starts = lists.offsets.to_numpy()
    words = lists.flatten().dictionary_encode()
    place, known = words.indices.to_numpy(), words.dictionary.to_pylist()
    word = np.array([bool(w) for w in known], bool)  # white space at an end leaves an empty piece
    real = word[place]
    upto = np.append(0, np.cumsum(real))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, known), U64, len(known))
    return np.diff(upto[starts - starts[0]]), (np.cumsum(word) - 1)[place[real]], hashes[word]


BLOCK = "block long, rows binary, sizes binary, tokens binary, hashes binary"


def encoded(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Stored blocks of about BLOCK_BYTES of text: the columns of `keep`, and tokens as places among the block's words."""
    slim = docs.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)), F.col(text).alias("__text"))
    names = [f"k{i}" for i in range(len(keep))]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []
        size = 0

        def out() -> pa.RecordBatch:
            nonlocal number, size
            table = pa.Table.from_batches(held)
            sizes, tokens, hashes = cut_up(table.column("__text").combine_chunks())
            sink = pa.BufferOutputStream()
            rows = table.select(names)
            with pa.ipc.new_stream(sink, rows.schema) as stream:
                stream.write_table(rows)
            columns = [zlib.compress(sink.getvalue().to_pybytes(), 1), squeezed(sizes, "<i4"), squeezed(tokens, "<i4"), hashes.astype("<u8").tobytes()]
            block = pa.RecordBatch.from_arrays([pa.array([number]), *(pa.array([c], pa.binary()) for c in columns)], ["block", "rows", "sizes", "tokens", "hashes"])
            number += 1
            held.clear()
            size = 0
            return block

        for batch in batches:
            for part in common.pieces([batch], "__text", BLOCK_BYTES):
                held.append(part)
                size += part.column("__text").nbytes
                if size >= BLOCK_BYTES:
                    yield out()
        if held:
            yield out()

    with common.small_batches(docs.sparkSession):
        return common.bucketed(slim.mapInArrow(work, BLOCK), "block")


def names(blocks: DataFrame, buckets: int) -> DataFrame:
    """(bucket, block, hashes, counts) of the distinct words of each block."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for block, tokens, hashes in zip(*(batch.column(c).to_pylist() for c in ("block", "tokens", "hashes"))):
                hashes = np.frombuffer(hashes, "<u8")
                n = np.bincount(loosened(tokens, "<i4"), minlength=len(hashes))
                bucket = hashes % U64(buckets)
                order = np.argsort(bucket, kind="stable")
                for at in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
                    if len(at):
                        out.append((int(bucket[at[0]]), block, hashes[at].tobytes(), squeezed(n[at], "<u4")))
            yield pa.RecordBatch.from_pylist([dict(zip(("bucket", "block", "hashes", "counts"), r)) for r in out], NAMED)

    return blocks.select("block", "tokens", "hashes").mapInArrow(work, "bucket long, block long, hashes binary, counts binary")


NAMED = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("hashes", pa.binary()), ("counts", pa.binary())])


def summed(rows: pa.Table) -> pa.Table:
    """Counts of a bucket's words over all blocks, by hash."""
    parts = [np.frombuffer(x.as_py(), "<u8") for x in rows.column("hashes")]
    counts = [loosened(x.as_py(), "<u4") for x in rows.column("counts")]
    hashes, place = np.unique(np.concatenate(parts), return_inverse=True)
    total = np.bincount(place, np.concatenate(counts), len(hashes)).astype(np.int64)
    return pa.table({"bucket": rows.column("bucket")[:1], "hashes": pa.array([hashes.astype("<u8").tobytes()], pa.binary()), "totals": pa.array([squeezed(total, "<i8")], pa.binary())})


def each_bucket(counts: DataFrame, of, schema: str) -> DataFrame:
    """Rows that `of` makes of the (hashes, totals) of each bucket."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for hashes, totals in zip(batch.column("hashes").to_pylist(), batch.column("totals").to_pylist()):
                yield of(np.frombuffer(hashes, "<u8"), loosened(totals, "<i8"))

    return counts.select("hashes", "totals").mapInArrow(work, schema)


def band(n: np.ndarray) -> np.ndarray:
    """Counts as few values: each its own up to 1024, beyond that 64 to each doubling."""
    return np.where(n <= 1024, n, 1024 + np.floor(64 * np.log2(np.maximum(n, 1) / 1024))).astype(np.int64)


def frequent(counts: DataFrame, most: int = WORDS) -> np.ndarray:
    """Hashes of the `most` most frequent words, ties to the smaller hash.

    A histogram of counts says from which on words are wanted, and one over hashes which of those that tie there, so that
    little more than `most` rows is ever sorted."""

    def row(**columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in columns.items()})

    def bands(hashes, totals):
        value, n = np.unique(band(totals), return_counts=True)
        return row(band=value, n=n)

    found = each_bucket(counts, bands, "band long, n long").groupBy("band").agg(F.sum("n").alias("n")).collect()  # bounded by the bands
    over, edge = 0, 0
    for r in sorted(found, key=lambda r: -r["band"]):
        edge = r["band"]
        if over + r["n"] >= most:
            break
        over += r["n"]
    top = lambda hashes: (hashes >> U64(52)).astype(np.int64)

    def places(hashes, totals):
        value, n = np.unique(top(hashes[band(totals) == edge]), return_counts=True)
        return row(place=value, n=n)

    tied, limit, upto = each_bucket(counts, places, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).collect(), 4096, 0  # 4096 rows
    if edge <= 1024:  # within a band of one value, smaller hashes go first
        for r in sorted(tied, key=lambda r: r["place"]):
            limit, upto = r["place"], upto + r["n"]
            if over + upto >= most:
                break

    def wanted(hashes, totals):
        at = (band(totals) > edge) | ((band(totals) == edge) & (top(hashes) <= limit))
        return row(hash=hashes[at].view(np.int64), n=totals[at])

    rows = each_bucket(counts, wanted, "hash long, n long")
    least = F.col("hash").bitwiseXOR(F.lit(-(1 << 63)))  # the order of unsigned hashes
    got = rows.orderBy(F.col("n").desc(), least).limit(most).collect()  # bounded
    return np.array([r["hash"] for r in got], np.int64).view(U64)


def learn_blocks(blocks: DataFrame) -> Corpus:
    """Vocabulary, counts and network from all texts of `encoded` blocks."""
    buckets = 1 + blocks.count() * (BLOCK_BYTES // 8) // NAME_BYTES
    counts = common.stored(names(blocks, buckets).groupBy("bucket").applyInArrow(summed, "bucket long, hashes binary, totals binary"))
    words = frequent(counts)

    def rest(hashes, totals):
        ids = ids_of(words, hashes)
        own = ids < WORDS
        at = np.where(own, ids, WORDS + (hashes % U64(BUCKETS)).astype(np.int64))
        n, kinds_ = np.bincount(at, totals, VOCABULARY).astype(np.int64), np.bincount(at, minlength=VOCABULARY)
        some = np.flatnonzero(kinds_)
        return pa.RecordBatch.from_pydict({"id": pa.array(some), "n": pa.array(n[some]), "words": pa.array(kinds_[some])})

    totals = each_bucket(counts, rest, "id long, n long, words long").groupBy("id").agg(F.sum("n").alias("n"), F.sum("words").alias("words")).collect()  # VOCABULARY rows
    n, distinct = np.zeros(VOCABULARY), np.zeros(VOCABULARY)
    for r in totals:
        n[r["id"]], distinct[r["id"]] = r["n"], r["words"]

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(CONTEXTS * VOCABULARY, np.int64)
        some = False
        for batch in batches:
            for sizes, tokens, hashes in zip(*(batch.column(c).to_pylist() for c in ("sizes", "tokens", "hashes"))):
                ids = ids_of(words, np.frombuffer(hashes, "<u8"))[loosened(tokens, "<i4")]
                if len(ids):
                    seen += np.bincount(contexts(ids, loosened(sizes, "<i4")) * VOCABULARY + ids, minlength=len(seen))
                    some = True
        if some:
            parts = [squeezed(x, "<i8") for x in np.split(seen, SLICES)]
            yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int64()), pa.array(parts, pa.binary())], ["slice", "counts"])

    def together(rows: pa.Table) -> pa.Table:
        total = np.zeros(CONTEXTS * VOCABULARY // SLICES, np.int64)
        for x in rows.column("counts"):
            total += loosened(x.as_py(), "<i8")
        return pa.table({"slice": rows.column("slice")[:1], "counts": pa.array([squeezed(total, "<i8")], pa.binary())})

    schema = "slice long, counts binary"
    tallied = blocks.select("sizes", "tokens", "hashes").mapInArrow(tally, schema)
    tallied = tallied.groupBy("slice", F.pmod(F.spark_partition_id(), F.lit(64)).alias("__part")).applyInArrow(lambda _, rows: together(rows), schema)
    seen = np.zeros((SLICES, CONTEXTS * VOCABULARY // SLICES))
    for r in tallied.groupBy("slice").applyInArrow(together, schema).collect():  # the counts once
        seen[r["slice"]] = loosened(r["counts"], "<i8")
    network = WindowNetwork(n)
    if n.sum():
        network.learn(seen.reshape(CONTEXTS, VOCABULARY))
    return Corpus(words, network.log_probabilities().astype(np.float32), n[WORDS:], distinct[WORDS:], counts, buckets, network)


def with_windows(blocks: DataFrame, corpus: Corpus) -> Corpus:
    """The corpus with `Windows` learned from every window of all texts, once.

    Each task goes over its blocks by steps, from the corpus' network on. What it has moved is averaged over the tasks: an
    id's vector by how often each task met the id at that place, the output by positions."""
    words, start = corpus.words, Windows(corpus.network)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, met, n = start.copy().learning(), np.zeros((4, VOCABULARY + 1), np.int64), 0
        for batch in batches:
            for sizes, tokens, hashes in zip(*(batch.column(c).to_pylist() for c in ("sizes", "tokens", "hashes"))):
                ids = ids_of(words, np.frombuffer(hashes, "<u8"))[loosened(tokens, "<i4")]
                window = surroundings(ids, loosened(sizes, "<i4"))
                for k, x in enumerate(window):
                    met[k] += np.bincount(x, minlength=VOCABULARY + 1)
                for at in range(0, len(ids), STEP):
                    mine.step([x[at : at + STEP] for x in window], ids[at : at + STEP])
                n += len(ids)
        if n:
            for k, (now, was) in enumerate(zip(mine.weights(), start.weights())):
                weight = met[k] if k < 4 else np.array([n])
                moved = np.rint((now.astype(float) - was) / UNIT).astype(np.int64).reshape(len(weight), -1) * weight[:, None]
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([squeezed(moved, "<i8")]), pa.array([squeezed(weight, "<i8")])], ["k", "moved", "weight"])

    def together(rows: pa.Table) -> pa.Table:
        total = lambda c: squeezed(sum(loosened(x.as_py(), "<i8") for x in rows.column(c)), "<i8")
        return pa.table({"k": rows.column("k")[:1], "moved": pa.array([total("moved")]), "weight": pa.array([total("weight")])})

    schema = "k long, moved binary, weight binary"
    moved = blocks.select("block", "sizes", "tokens", "hashes").sortWithinPartitions("block").mapInArrow(work, schema)
    moved = moved.groupBy("k", F.pmod(F.spark_partition_id(), F.lit(64)).alias("__part")).applyInArrow(lambda _, rows: together(rows), schema)
    out = start.copy()
    for r in moved.groupBy("k").applyInArrow(together, schema).collect():  # the weights once
        weight = loosened(r["weight"], "<i8")
        w = out.weights()[r["k"]]
        w += (loosened(r["moved"], "<i8").reshape(len(weight), -1) * UNIT / np.maximum(weight, 1)[:, None]).reshape(w.shape).astype(w.dtype)
    return replace(corpus, windows=out)


def scored_blocks(blocks: DataFrame, corpus: Corpus, fields: list[T.StructField]) -> DataFrame:
    """The rows of `encoded` blocks under `fields`, with n_tokens, log_probability (summed) and mean_log_probability."""
    counts = corpus.counts

    def answer(asked: pa.Table, known: pa.Table) -> pa.Table:
        hashes, totals = (np.frombuffer(known.column("hashes")[0].as_py(), "<u8"), loosened(known.column("totals")[0].as_py(), "<i8")) if len(known) else (np.zeros(0, U64), np.zeros(0, np.int64))
        out = []
        for x in asked.column("hashes"):
            mine = np.frombuffer(x.as_py(), "<u8")
            at = np.minimum(np.searchsorted(hashes, mine), max(len(hashes) - 1, 0))
            out.append(squeezed(np.where(hashes[at] == mine, totals[at], 0) if len(hashes) else np.zeros(len(mine)), "<i8"))
        return pa.table({"block": asked.column("block"), "hashes": asked.column("hashes"), "totals": pa.array(out, pa.binary())})

    asked = names(blocks, corpus.buckets).groupBy("bucket")
    replies = asked.cogroup(counts.groupBy("bucket")).applyInArrow(answer, "block long, hashes binary, totals binary")
    windows, keep = corpus.windows, [f.name for f in fields]
    table = None if windows else corpus.table.ravel()  # CONTEXTS x VOCABULARY, whatever the input
    corpus = replace(corpus, table=None, counts=None, network=None, windows=None)

    def likely(ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        if not windows:
            return table[contexts(ids, sizes) * VOCABULARY + ids]
        around = surroundings(ids, sizes)
        return np.concatenate([windows.batch([x[at : at + STEP] for x in around], ids[at : at + STEP], False)[0] for at in range(0, len(ids), STEP)])

    def score(block: pa.Table, heard: pa.Table) -> pa.Table:
        rows = pa.ipc.open_stream(zlib.decompress(block.column("rows")[0].as_py())).read_all()
        sizes, tokens, hashes = loosened(block.column("sizes")[0].as_py(), "<i4"), loosened(block.column("tokens")[0].as_py(), "<i4"), np.frombuffer(block.column("hashes")[0].as_py(), "<u8")
        known = np.concatenate([np.zeros(0, U64), *(np.frombuffer(x.as_py(), "<u8") for x in heard.column("hashes"))])
        total = np.concatenate([np.zeros(0), *(loosened(x.as_py(), "<i8") for x in heard.column("totals"))])
        order = np.argsort(known)
        share = corpus.shares(hashes, total[order][np.searchsorted(known[order], hashes)]) if len(hashes) else np.zeros(0)
        ids = corpus.ids(hashes)[tokens]
        every = likely(ids, sizes) + share[tokens] if len(ids) else np.zeros(0)
        texts = np.repeat(np.arange(len(sizes)), sizes)
        summed_ = np.bincount(texts, every, len(sizes)).astype(float)
        columns = [pa.array(sizes.astype(np.int64)), pa.array(summed_), pa.array(summed_ / np.maximum(sizes, 1), mask=sizes == 0)]
        return pa.table([*(rows.column(f"k{i}") for i in range(len(keep))), *columns], names=[*keep, "n_tokens", "log_probability", "mean_log_probability"])

    added = T.StructType.fromDDL("n_tokens long, log_probability double, mean_log_probability double").fields
    return blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(score, T.StructType([*fields, *added]))


def learn(docs: DataFrame, text: str = "text", windows: bool = False) -> Corpus:
    """With `windows` neighbours are ids and not kinds; operator 5's query asks for that."""
    blocks = encoded(docs, text, ())
    return with_windows(blocks, learn_blocks(blocks)) if windows else learn_blocks(blocks)


def scored(docs: DataFrame, corpus: Corpus, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep`, n_tokens, log_probability and mean_log_probability of each row."""
    keep = common.kept(keep, "n_tokens", "log_probability", "mean_log_probability")
    return scored_blocks(encoded(docs, text, keep), corpus, [docs.schema[c] for c in keep])


def op5_lm_scoring(spark, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    blocks = encoded(docs)
    return scored_blocks(blocks, with_windows(blocks, learn_blocks(blocks)), [docs.schema["doc_id"]])
