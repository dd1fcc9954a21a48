"""Operator 3, removal of repeated byte strings by blockwise sorting of suffixes sifted by a difference cover.

Only one question is put to the order of suffixes: which suffixes agree with another in their first `LENGTH` bytes.
Suffixes at positions of a difference cover are the sample. For any two positions there is a shift under `CYCLE` that
takes both into the cover, so any repeat shows in the sample. Texts are packed in blocks; a block sends names
(fingerprints of byte strings) to suffix buckets, each bucket is sorted on its own, and a reply of a byte a name comes
back. Blocks send each name once, so a string that a third of all texts hold makes no large bucket. In turn:

1. cover samples are named by their next `LENGTH - CYCLE + 1` bytes; those that are alone drop out;
2. the rest get their rank class: the bytes of every window of `LENGTH` that the sample can stand for. A class with two
   members settles all those windows at once; so long ties are resolved by cover samples, not suffix by suffix;
3. samples without such a partner announce their name, and one member of each settled class asks whether it is wanted;
4. only suffixes next to samples without a partner, and those of the members that are wanted, are sorted one by one.

A `Shape` says what a position is (a byte or a word), how many make a window, and whether the first copy of a window stays.
Where it does, the rows are put in order of their ids, so that blocks are in order; a class settles all its members but
the first, which like samples without a partner has its windows sorted where another class has its name. So each window
is known to be the first of its kind, or to have an earlier copy.

Names may collide, so for windows of bytes they only sift (no repeat is missed by them), and bytes decide:

5. each window taken for repeated has an anchor, the GRAM bytes in it whose name is least; windows that have theirs at one
   place go together, as a context of bytes, to the bucket of these bytes. There the suffixes that start at the anchors
   are sorted, and what stands before them, read backwards. Two windows agree if both parts agree in these orders, and
   a window stays repeated only if another one agrees with it byte for byte.

Scale: the sample is 12 of 133 positions at 5 bytes each, the other rounds are a fraction of that; after the first round
bits of the samples that are left stand for its replies. Only bytes of windows that were found repeated are ever sent,
and a block sends equal contexts once. Bucket memory is bounded by the number of buckets, which grows with the input,
and by the number of blocks for any one name. A text holds less than 2**28 bytes.

Edge cases: null texts count as empty; texts under `LENGTH` bytes lose nothing; repeated rows are copies of one
another; all columns pass through, null ids too; an empty table gives an empty result. Where removal cuts a character
in two, `removed` drops the broken bytes from the text; the digest keeps them.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockroom.llm import common

LENGTH = 400
#: The cover has PRIME + 1 of every CYCLE positions.
PRIME = 11
CYCLE = PRIME * PRIME + PRIME + 1
NAMED = LENGTH - CYCLE + 1
BLOCK_BYTES = 4 << 20
ROUNDS = 4
#: Input bytes for each suffix bucket.
BUCKET_BYTES = 12 << 20
BASE = 0x9E3779B97F4A7C15
U64 = np.uint64
#: Bytes of an anchor, and the low bits of its name that give way to its place. A text of Spark has less than 2**31 bytes.
GRAM = 32
PLACE_BITS, MASK = U64(31), U64((1 << 31) - 1)
#: Bucket of the rows that hold what is left of the cover samples.
SURVIVORS = -1


@dataclass(frozen=True)
class Shape:
    """Windows of `length` bytes or words over the cover of a prime; with `first`, only later copies count as repeats."""

    length: int = LENGTH
    prime: int = PRIME
    words: bool = False
    first: bool = False

    @property
    def cycle(self) -> int:
        return self.prime * self.prime + self.prime + 1

    @property
    def named(self) -> int:
        return self.length - self.cycle + 1


BYTES = Shape()
#: Passages of over 50 words, whatever stands between the words; their first copy stays.
PASSAGES = Shape(51, 5, words=True, first=True)


@lru_cache
def cover(prime: int = PRIME) -> np.ndarray:
    """Residues whose pairwise differences give every residue once: the zeros of a linear recurrence over GF(prime)."""
    cycle = prime * prime + prime + 1
    for a, b, c in itertools.product(range(prime), repeat=3):
        s = [0, 0, 1]
        while len(s) < cycle:
            s.append((a * s[-1] + b * s[-2] + c * s[-3]) % prime)
        zeros = [k for k, x in enumerate(s) if x == 0]
        if len(zeros) == prime + 1 and len({(x - y) % cycle for x in zeros for y in zeros}) == cycle:
            return np.array(zeros)
    raise AssertionError("there is a difference set for every prime")


@lru_cache(maxsize=1)
def tables() -> dict:
    return {"byte": np.random.default_rng(11).integers(1, 2**63, 256, dtype=U64), "power": np.ones(1, U64), "inverse": np.ones(1, U64)}


def upto(n: int) -> dict:
    """Tables of powers for texts of up to n bytes."""
    t = tables()
    if len(t["power"]) <= n:
        m = 1 << n.bit_length()
        for key, base in (("power", BASE), ("inverse", pow(BASE, -1, 1 << 64))):
            t[key] = np.cumprod(np.append(U64(1), np.full(m, base, U64)))
    return t


@lru_cache(maxsize=2)
def samples_upto(prime: int, m: int) -> np.ndarray:
    return (np.arange(0, m, prime * prime + prime + 1)[:, None] + cover(prime)).ravel()


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(31))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


#: What bytes.split() takes as blank.
BLANK = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))


def word_bounds(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word in bytes."""
    inside = np.concatenate([[False], ~BLANK[np.frombuffer(data, np.uint8)], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


def prefix_sums(values: np.ndarray, power: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(values) + 1, U64)
    np.cumsum(values * power[: len(values)], out=sums[1:])
    return sums


class Text:
    """Fingerprints of any stretch of one text, its cover samples, and what is known of them."""

    def __init__(self, data: bytes, shape: Shape = BYTES):
        self.shape, self.tables = shape, (t := upto(len(data)))
        self.sums = prefix_sums(t["byte"][np.frombuffer(data, np.uint8)], t["power"])
        self.n, self.bounds = len(data), None
        if shape.words:
            start, end = word_bounds(data)
            self.n, self.bounds = len(start), np.append(start, len(data))
            self.sums = prefix_sums(self.name(start, end), t["power"])
        sample = samples_upto(shape.prime, 1 << self.n.bit_length())
        self.at = sample[: np.searchsorted(sample, self.n - shape.named, side="right")] if self.n >= shape.length else sample[:0]
        self.windows = max(self.n - shape.length + 1, 0)

    def name(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.tables["inverse"][start])

    def names(self) -> np.ndarray:
        return self.name(self.at, self.at + self.shape.named) >> U64(24)

    def tile(self) -> tuple[np.ndarray, np.ndarray]:
        """First and last window that each sample can stand for."""
        return np.maximum(self.at - self.shape.cycle + 1, 0), np.minimum(self.at, self.windows - 1)

    def classes(self) -> np.ndarray:
        first, _ = self.tile()
        end = np.minimum(self.at + self.shape.length, self.n)
        shape = ((self.at - first) * (2 * self.shape.length) + (end - first)).astype(U64)
        return mixed(self.name(first, end) + shape * U64(0xD6E8FEB86659FD93))

    def marked(self, which: np.ndarray) -> np.ndarray:
        """True for every window in the tile of a sample in `which`."""
        first, last = self.tile()
        edge = np.zeros(self.windows + 1, np.int32)
        np.add.at(edge, first[which], 1)
        np.add.at(edge, last[which] + 1, -1)
        return np.cumsum(edge[:-1]) > 0

    def keep(self, which: np.ndarray) -> np.ndarray:
        self.at = self.at[which]
        return self.at


def least_places(names: np.ndarray, length: int) -> np.ndarray:
    """The place of the least name in each stretch of `length`, the first of those whose leading bits tie.

    Minima of stretches from running minima to both sides of every `length`-th place."""
    n = len(names)
    keys = (names >> PLACE_BITS << PLACE_BITS) | (np.arange(n, dtype=U64) & MASK)
    grid = np.full(-(-n // length) * length, ~U64(0))
    grid[:n] = keys
    grid = grid.reshape(-1, length)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = np.arange(n - length + 1)
    return (np.minimum(behind[starts], ahead[starts + length - 1]) & MASK).astype(np.int64)


def confirmed(parts: list[tuple[bytes, int]], weights: np.ndarray, length: int) -> list[np.ndarray]:
    """For each context (bytes, place of its anchor) and each of its windows: whether the windows of that place and these
    bytes have a weight of two or more.

    Contexts meet at their anchors. They are put in the order of the suffixes that start there, and in that of what
    stands before, read backwards; two windows agree if both parts do, and in a sorted order those whose neighbours have
    no less in common lie together."""
    n = len(parts)
    after, before = [d[p : p + length] for d, p in parts], [d[:p][::-1] for d, p in parts]

    def ordered(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        order = sorted(range(n), key=strings.__getitem__)
        wide = np.zeros((n, length + 1), np.int16)  # a place behind the end agrees with nothing but an end
        for row, k in enumerate(order):
            x = np.frombuffer(strings[k], np.uint8)
            wide[row, : len(x)] = x.astype(np.int16) + 1
        same = wide[1:] == wide[:-1]
        common_ = np.where(same.all(axis=1), length + 1, np.argmin(same, axis=1))
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        return rank, np.append(0, common_)

    (rank_a, common_a), (rank_b, common_b) = ordered(after), ordered(before)
    high = np.array([p for _, p in parts])
    windows = np.array([len(d) - length + 1 for d, _ in parts])
    low = high - windows + 1
    base = np.cumsum(windows) - windows
    out = np.zeros(int(windows.sum()), bool)
    for shift in range(int(low.min()), int(high.max()) + 1):
        mine = np.flatnonzero((low <= shift) & (shift <= high))
        if len(mine):
            right = np.cumsum(common_a < length - shift)[rank_a[mine]]
            left = np.cumsum(common_b < shift)[rank_b[mine]]
            _, group = np.unique(right * (n + 1) + left, return_inverse=True)
            out[base[mine] + high[mine] - shift] = np.bincount(group, weights[mine])[group] >= 2
    return np.split(out, base[1:])


class Block:
    """The texts of a block, brought forward by the replies to its rounds."""

    def __init__(self, table: pa.Table, text: str, buckets: int, shape: Shape = BYTES):
        self.table, self.buckets, self.shape = table, buckets, shape
        column = table.column(text).combine_chunks().cast(pa.large_binary())
        self.data = [x.as_py() or b"" for x in column]
        self.texts = [Text(d, shape) if len(d) >= shape.length else None for d in self.data]
        self.live = [t for t in self.texts if t]
        self.every = [t.at for t in self.live]

    def join(self, parts: list[np.ndarray], kind=U64) -> np.ndarray:
        return np.concatenate(parts) if parts else np.zeros(0, kind)

    def split(self, values: np.ndarray, sizes: list[int]) -> list[np.ndarray]:
        return np.split(values, np.cumsum(sizes)[:-1]) if sizes else []

    def ask(self, turn: int) -> tuple[np.ndarray, np.ndarray]:
        """The names of a round, one for each position, and their weights."""
        if turn == 1:
            names = self.join([t.names() for t in self.live])
            return names, np.ones(len(names), np.int64)
        if turn == 2:
            names = self.join([t.classes() for t in self.live])
            return names, np.ones(len(names), np.int64)
        if turn == 3:
            open_, lead = self.join([~s for s in self.settled], bool), self.join(self.leads, bool)
            return self.join([t.names() for t in self.live])[open_ | lead], (open_ | (lead & self.shape.first))[open_ | lead].astype(np.int64)
        emitted = [np.flatnonzero(w) for w in self.wanted]
        names = self.join([t.name(w, w + self.shape.length) for t, w in zip(self.live, emitted)])
        return names, np.ones(len(names), np.int64)

    def sent(self, turn: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct names by bucket then name, their weights, and each position's place among them."""
        names, weight = self.ask(turn)
        names, place = np.unique(names, return_inverse=True)
        order = np.argsort(names % U64(self.buckets), kind="stable")
        rank = np.empty(len(names), np.int64)
        rank[order] = np.arange(len(names))
        return names[order], np.minimum(np.bincount(place, weight, len(names)).astype(np.int64), 2)[order], rank[place]

    def survivors(self) -> bytes:
        """Which of all cover samples are left after the first round, as bits."""
        return zlib.compress(np.packbits(self.join([np.isin(a, t.at, assume_unique=True) for a, t in zip(self.every, self.live)], bool)).tobytes(), 1)

    def survive(self, bits: bytes) -> None:
        """The state after the first round, from the bits of its survivors."""
        left = np.unpackbits(np.frombuffer(zlib.decompress(bits), np.uint8)).astype(bool)
        for t, which in zip(self.live, self.split(left[: sum(len(t.at) for t in self.live)], [len(t.at) for t in self.live])):
            t.keep(which)

    def records(self) -> list[tuple[int, int, int, int, int]]:
        """(text, first window, last window, anchor, bucket of the anchor's bytes) of the windows taken for repeated: those of
        a text that have their anchor, the GRAM of least name in a window, at one place."""
        out = []
        for k, (t, flagged) in enumerate(zip(self.live, self.repeated)):
            at = np.flatnonzero(flagged)
            if not len(at):
                continue
            names = t.name(np.arange(t.n - GRAM + 1), np.arange(GRAM, t.n + 1))
            anchor = least_places(names, self.shape.length - GRAM + 1)[at]
            cut = np.flatnonzero((np.diff(at) > 1) | (np.diff(anchor) != 0))
            first, last = at[np.append(0, cut + 1)], at[np.append(cut, len(at) - 1)]
            place = anchor[np.append(0, cut + 1)]
            bucket = (names[place] >> PLACE_BITS) % U64(self.buckets)
            out += zip([k] * len(first), first.tolist(), last.tolist(), place.tolist(), bucket.tolist())
        return out

    def contexts(self) -> tuple[dict[tuple[int, bytes, int], list[int]], list[tuple[int, int, int, int, int]]]:
        """Distinct (bucket, bytes, place of the anchor in them) by bucket with the numbers of the records that have them."""
        found: dict[tuple[int, bytes, int], list[int]] = {}
        live = [d for d, t in zip(self.data, self.texts) if t]
        records = self.records()
        for n, (k, first, last, place, bucket) in enumerate(records):
            found.setdefault((bucket, live[k][first : last + self.shape.length], place - first), []).append(n)
        return dict(sorted(found.items(), key=lambda x: x[0][0])), records

    def verify(self, bits: np.ndarray) -> None:
        """`bits`: for each distinct context sent, whether each of its windows stands elsewhere too, byte for byte."""
        found, records = self.contexts()
        at = 0
        for (_, data, _), numbers in found.items():
            n = len(data) - self.shape.length + 1
            for k in numbers:
                text, first, last, _, _ = records[k]
                self.repeated[text][first : last + 1] &= bits[at : at + n]
            at += n

    def hear(self, turn: int, reply: np.ndarray) -> None:
        """`reply`: for each distinct name sent, its total weight up to 2, and 4 more for the first block that sent it."""
        place = self.sent(turn)[2]
        code = reply[place]
        total, first = code & 3, code >= 4
        later = total >= 2
        if self.shape.first:
            here = np.zeros(len(place), bool)
            here[np.unique(place, return_index=True)[1]] = True
            first &= here
            later &= ~first
        sizes = [len(t.at) for t in self.live]
        if turn == 1:
            for t, which in zip(self.live, self.split(total >= 2, sizes)):
                t.keep(which)
        elif turn == 2:
            self.settled = self.split(total >= 2, sizes)
            self.later = self.split(later, sizes)
            self.leads = self.split((total >= 2) & first, sizes)
        elif turn == 3:
            contested = np.zeros(sum(sizes), bool)
            open_, lead = self.join([~s for s in self.settled], bool), self.join(self.leads, bool)
            contested[open_ | lead] = total >= (2 if self.shape.first else 1)
            self.repeated = [t.marked(s) for t, s in zip(self.live, self.later)]
            self.wanted = [t.marked(c) for t, c in zip(self.live, self.split(contested, sizes))]
        else:
            for r, w, found in zip(self.repeated, self.wanted, self.split(later, [int(w.sum()) for w in self.wanted])):
                r[np.flatnonzero(w)[found]] = True

    def covered(self) -> list[np.ndarray]:
        """For each text the maximal runs (start, end) of bytes that repeated windows cover."""
        out, repeated, length = [], iter(self.repeated), self.shape.length
        for t in self.texts:
            if t is None:
                out.append(np.zeros((0, 2), np.int64))
                continue
            at = np.flatnonzero(next(repeated))
            gaps = np.flatnonzero(np.diff(at) > length)
            start, end = at[np.append(0, gaps + 1)] if len(at) else at, at[np.append(gaps, -1)] + length if len(at) else at
            runs = np.stack([start, end], axis=1)
            out.append(runs if t.bounds is None else t.bounds[runs])  # a word goes with the blank behind it
        return out


def packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def unpacked(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


NAMES = "bucket long, block long, names binary, weights binary"
REPLY = "block long, turn int, bucket long, codes binary"


def sort_bucket(turn: int) -> Callable[[pa.Table], pa.Table]:
    def work(rows: pa.Table) -> pa.Table:
        """Sorts one bucket's names and tells each block what became of those that it sent."""
        rows = rows.sort_by("block")
        names = [widened(x.as_py()) for x in rows.column("names")]
        weights = [np.frombuffer(x.as_py(), np.uint8) for x in rows.column("weights")]
        _, first, place = np.unique(np.concatenate(names), return_index=True, return_inverse=True)
        total = np.minimum(np.bincount(place, np.concatenate(weights)), 2).astype(np.uint8)
        code = total[place]
        code[first] += 4  # blocks are in order, and a stable sort finds the first
        cuts = np.cumsum([len(n) for n in names])[:-1]
        n = len(rows)
        codes = pa.array([zlib.compress(c.tobytes(), 1) for c in np.split(code, cuts)], pa.binary())
        return pa.table({"block": rows.column("block"), "turn": pa.array([turn] * n, pa.int32()), "bucket": rows.column("bucket"), "codes": codes})

    return work


def narrowed(names: np.ndarray, width: int) -> bytes:
    return bytes([width]) + np.ascontiguousarray(names.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def widened(data: bytes) -> np.ndarray:
    width = data[0]
    out = np.zeros(((len(data) - 1) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8, offset=1).reshape(-1, width)
    return out.view("<u8").ravel()


def opened(block: pa.Table, replies: pa.Table, text: str, buckets: int, shape: Shape) -> tuple[Block, dict[int, list[tuple[int, bytes]]]]:
    state = Block(unpacked(block.column("data")[0].as_py()), text, buckets, shape)
    turns: dict[int, list[tuple[int, bytes]]] = {}
    for turn, bucket, codes in zip(*(replies.column(c).to_pylist() for c in ("turn", "bucket", "codes"))):
        turns.setdefault(turn, []).append((bucket, codes))
    return state, turns


def joined(codes: list[tuple[int, bytes]]) -> np.ndarray:
    return np.frombuffer(b"".join(zlib.decompress(c) for _, c in sorted(codes)), np.uint8)


def replay(block: pa.Table, replies: pa.Table, text: str, buckets: int, rounds: int, shape: Shape = BYTES) -> Block:
    """The block after so many rounds; one in which it sent no name brought no reply."""
    state, turns = opened(block, replies, text, buckets, shape)
    for turn in range(1, min(rounds, ROUNDS) + 1):
        codes = turns.get(turn, [])
        if turn == 1 and codes and codes[0][0] == SURVIVORS:
            state.survive(codes[0][1])
        else:
            state.hear(turn, joined(codes))
    if rounds > ROUNDS:
        state.verify(joined(turns.get(rounds, [])).astype(bool))
    return state


def ask(state: Block, turn: int, block: int) -> pa.Table:
    names, weights, _ = state.sent(turn)
    bucket, width = names % U64(state.buckets), 5 if turn in (1, 3) else 8
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    rows = [(int(b[0]), narrowed(n, width), w.astype(np.uint8).tobytes()) for b, n, w in zip(np.split(bucket, cuts), np.split(names, cuts), np.split(weights, cuts)) if len(b)]
    if turn == 2:
        rows.append((SURVIVORS, state.survivors(), b""))
    return asked(rows, block)


def asked(rows: list[tuple[int, bytes, bytes]], block: int) -> pa.Table:
    types = (pa.int64(), pa.binary(), pa.binary())
    b, n, w = (pa.array(c, t) for c, t in zip(zip(*rows) if rows else ([], [], []), types))
    return pa.table({"bucket": b, "block": pa.array([block] * len(rows), pa.int64()), "names": n, "weights": w})


def show(state: Block, block: int) -> pa.Table:
    """The distinct contexts of the block, by bucket: their bytes behind one another, and sizes, anchors and weights."""
    rows = []
    for bucket, part in itertools.groupby(state.contexts()[0].items(), key=lambda x: x[0][0]):
        part = list(part)
        shape = np.array([(len(data), place, min(len(numbers), 2)) for (_, data, place), numbers in part], "<i4")
        rows.append((bucket, bytes(pa.compress(b"".join(data for (_, data, _), _ in part), codec="zstd", asbytes=True)), shape.tobytes()))
    return asked(rows, block)


def compare_bucket(length: int, turn: int) -> Callable[[pa.Table], pa.Table]:
    def work(rows: pa.Table) -> pa.Table:
        """Compares the contexts of a bucket byte by byte and tells each block which windows stand elsewhere too."""
        rows = rows.sort_by("block")
        parts, weights, counts = [], [], []
        for names, shape in zip(rows.column("names").to_pylist(), rows.column("weights").to_pylist()):
            shape = np.frombuffer(shape, "<i4").reshape(-1, 3)
            data = pa.decompress(names, decompressed_size=int(shape[:, 0].sum()), codec="zstd", asbytes=True)
            ends = np.cumsum(shape[:, 0]).tolist()
            parts += [(data[s:e], p) for s, e, p in zip([0, *ends], ends, shape[:, 1].tolist())]
            weights.append(shape[:, 2])
            counts.append(len(shape))
        found = confirmed(parts, np.concatenate(weights), length)
        cuts = np.cumsum([0, *counts])
        codes = [zlib.compress(np.concatenate(found[s:e]).astype(np.uint8).tobytes(), 1) for s, e in zip(cuts, cuts[1:])]
        n = len(rows)
        return pa.table({"block": rows.column("block"), "turn": pa.array([turn] * n, pa.int32()), "bucket": rows.column("bucket"), "codes": pa.array(codes, pa.binary())})

    return work


def blocks_of(docs: DataFrame) -> DataFrame:
    """(block, data): whole rows in compressed blocks of about BLOCK_BYTES."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []

        def out() -> pa.RecordBatch:
            nonlocal number
            row = pa.RecordBatch.from_arrays([pa.array([number]), pa.array([packed(pa.Table.from_batches(held))], pa.binary())], ["block", "data"])
            number += 1
            held.clear()
            return row

        for batch in batches:
            step = max(1, int(batch.num_rows * BLOCK_BYTES / max(batch.nbytes, 1)))
            for at in range(0, batch.num_rows, step):
                held.append(batch.slice(at, step))
                if sum(b.nbytes for b in held) >= BLOCK_BYTES:
                    yield out()
        if held:
            yield out()

    return docs.mapInArrow(work, "block long, data binary")


def in_order(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """Rows by id, null ids last and rows of one id by their text, over all partitions."""
    order = [F.col(doc_id).isNull(), F.col(doc_id), F.xxhash64(text)]
    return docs.repartitionByRange(*order).sortWithinPartitions(*order)


def resolved(docs: DataFrame, text: str, finish: Callable[[Block], pa.Table], schema: T.StructType, shape: Shape = BYTES, doc_id: str = "doc_id") -> DataFrame:
    """`finish` of every block after all rounds."""
    if shape.first:
        docs = in_order(docs, text, doc_id)
    with common.small_batches(docs.sparkSession):
        blocks = common.bucketed(blocks_of(docs), "block")  # blocks meet replies five times and are shuffled once
    buckets = 1 + blocks.count() * BLOCK_BYTES // BUCKET_BYTES
    replies = docs.sparkSession.createDataFrame([], REPLY)

    def asking(turn: int):
        def work(block: pa.Table, heard: pa.Table) -> pa.Table:
            return ask(replay(block, heard, text, buckets, turn - 1, shape), turn, block.column("block")[0].as_py())

        return work

    for turn in range(1, ROUNDS + 1):
        names = blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(asking(turn), NAMES)
        if turn == 2:  # from here on, bits of what the first round left stand for its replies
            names = common.stored(names)
            left = F.col("bucket") == SURVIVORS
            replies = names.where(left).select("block", F.lit(1).alias("turn"), "bucket", F.col("names").alias("codes"))
            names = names.where(~left)
        replies = replies.union(common.cut(names.groupBy("bucket").applyInArrow(sort_bucket(turn), REPLY)))
    rounds = ROUNDS
    if not shape.words:  # what the names say is held against the bytes

        def showing(block: pa.Table, heard: pa.Table) -> pa.Table:
            return show(replay(block, heard, text, buckets, ROUNDS, shape), block.column("block")[0].as_py())

        shown = blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(showing, NAMES)
        rounds = ROUNDS + 1
        replies = replies.union(common.cut(shown.groupBy("bucket").applyInArrow(compare_bucket(shape.length, rounds), REPLY)))

    def finishing(block: pa.Table, heard: pa.Table) -> pa.Table:
        return finish(replay(block, heard, text, buckets, rounds, shape))

    return blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(finishing, schema)


def kept_bytes(data: bytes, runs: np.ndarray) -> bytes:
    edges = [0, *runs.ravel().tolist(), len(data)]
    return b"".join(data[s:e] for s, e in zip(edges[::2], edges[1::2]))


def removed(docs: DataFrame, text: str = "text", shape: Shape = BYTES, doc_id: str = "doc_id") -> DataFrame:
    """The same rows and columns with what repeats taken off `text`; null texts stay null."""

    def finish(block: Block) -> pa.Table:
        at = block.table.schema.get_field_index(text)
        null = block.table.column(text).is_null().to_pylist()
        texts = [None if none else kept_bytes(d, r).decode("utf-8", "ignore") for none, d, r in zip(null, block.data, block.covered())]
        return block.table.set_column(at, text, pa.array(texts, pa.string()))

    return resolved(docs, text, finish, docs.schema, shape, doc_id)


def repeated_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns and `spans` (in place of one of that name): array of (start, end) in bytes, end exclusive, of what
    `removed` takes off."""
    docs = common.without(docs, "spans")
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def finish(block: Block) -> pa.Table:
        spans = [[{"start": s, "end": e} for s, e in r.tolist()] for r in block.covered()]
        return block.table.append_column("spans", pa.array(spans, span))

    kind = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    return resolved(docs, text, finish, T.StructType([*docs.schema.fields, T.StructField("spans", kind)]))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")

    def finish(block: Block) -> pa.Table:
        runs = block.covered()
        of = lambda f: pa.array([f(d, r) for d, r in zip(block.data, runs)])
        count = lambda f: of(f).cast(pa.int64())
        return pa.table({
            "doc_id": block.table.column("doc_id"),
            "n_bytes": count(lambda d, r: len(d)),
            "n_removed": count(lambda d, r: int((r[:, 1] - r[:, 0]).sum())),
            "n_spans": count(lambda d, r: len(r)),
            "kept_sha256": of(lambda d, r: common.sha256(kept_bytes(d, r))).cast(pa.string()),
        })

    fields = T.StructType.fromDDL("n_bytes long, n_removed long, n_spans long, kept_sha256 string").fields
    return resolved(docs, "text", finish, T.StructType([docs.schema["doc_id"], *fields]))
