"""Operator 8, byte-level BPE encoding and decoding with a pair occurrence index.

A task cuts its texts into words at blanks, keeps the distinct ones it has not met, and encodes those together:
an index maps each adjacent pair with a rank to all its positions, active ranks are applied in ascending order,
and each merge updates the lists of the pairs beside it. Ids of a text are then joined from its words'.

Scale: a narrow map over whole texts, no shuffle. A task holds about 8 MB of text and a cache of at most
`CACHE_WORDS` words; nothing is broadcast but the tokenizer's path.

Edge cases: a null or empty text has no ids and decodes to the empty text; special tokens that stand in a text
are encoded as themselves; null ids and repeated rows pass through; an empty table gives an empty result; a
column that bears the name of a result gives way to it.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockroom.llm import common

CACHE_WORDS = 500_000
PIECE_BYTES = 8 << 20
#: Positions of a pair that are merged one by one and not as arrays.
FEW = 16

#: How this kind of vocabulary splits a text before merging. Fixed value.
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
#: A blank before another character always starts a new word. A blank before white space may stand inside a run.
INSIDE_RUN, BEFORE_BLANK = re.compile(r" (?=\s)"), re.compile(r"(?= \S)")
#: The same for a column of texts, with what counts as white space anywhere.
ODD = r" [\s\p{Z}\x0b\x1c-\x1f\x{85}]"
#: Marks that after letters make a piece of their own, however many there are.
CLOSING = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte: itself where printable, else the next from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}


class PairIndexBpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters, vocab = byte_letters(), spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, k in vocab.items():
            self.bytes_of[k] = bytes(letters[c] for c in token)
        for token, k in self.special.items():
            self.bytes_of[k] = token.encode()
        self.byte_id = np.array([vocab[c] for c in sorted(letters, key=letters.get)], np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.pair = np.array([[vocab[a], vocab[b]] for a, b in merges], np.int64).reshape(-1, 2)
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int64)
        keys = self.pair[:, 0] << 32 | self.pair[:, 1]
        order = np.argsort(keys)
        self.keys, self.ranks = np.append(keys[order], -1), np.append(order, 0)
        self.rank_by_key = dict(zip(keys.tolist(), range(len(keys))))
        self.cache: dict[str, bytes] = {}  # words after a blank
        self.firsts: dict[str, bytes] = {}  # words that a text starts with
        self.stops = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, or -1."""
        keys = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.keys[:-1], keys)
        return np.where(self.keys[at] == keys, self.ranks[at], -1)

    def merge(self, data: bytes, ends: np.ndarray) -> list[bytes]:
        """The ids of each piece of `data` (none is empty) as little-endian 32-bit integers."""
        n = len(data)
        token = np.append(self.byte_id[np.frombuffer(data, np.uint8)], -1).astype(np.int32)
        after, before = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
        after[ends - 1] = n
        before[np.append(0, ends[:-1])] = n
        before[n] = after[n] = n
        at = np.flatnonzero(after[:n] < n).astype(np.int32)
        rank = self.rank_of(token[at], token[at + 1])
        at, rank = at[rank >= 0], rank[rank >= 0]
        order = np.argsort(rank, kind="stable")
        at, rank = at[order], rank[order]
        cuts = np.flatnonzero(np.diff(rank, prepend=-1))
        index: dict[int, list] = {r: [p] for r, p in zip(rank[cuts].tolist(), np.split(at, cuts[1:]))} if len(at) else {}
        heap = sorted(index)
        tokens, afters, befores, rank_of = memoryview(token), memoryview(after), memoryview(before), self.rank_by_key.get

        def listed(r: int, p) -> None:
            if r in index:
                index[r].append(p)
            else:
                index[r] = [p]
                heapq.heappush(heap, r)

        while heap:
            r = heapq.heappop(heap)
            lists = index.pop(r)
            (a, b), merged = self.pair[r].tolist(), int(self.merged[r])
            if sum(p.size if isinstance(p, np.ndarray) else 1 for p in lists) <= FEW:
                places = [q for p in lists for q in (p.tolist() if isinstance(p, np.ndarray) else (p,))]
                for p in sorted(places):  # from the left, so a run pairs up as it should
                    gone = afters[p]
                    if tokens[p] != a or gone == n or tokens[gone] != b:
                        continue
                    tokens[p], tokens[gone] = merged, -1
                    afters[p] = beyond = afters[gone]
                    befores[beyond] = p
                    left = befores[p]
                    if left < n and (k := rank_of(tokens[left] << 32 | merged)) is not None:
                        listed(k, left)
                    if beyond < n and (k := rank_of(merged << 32 | tokens[beyond])) is not None:
                        listed(k, p)
                continue
            at = np.concatenate([p if isinstance(p, np.ndarray) else np.array([p], np.int32) for p in lists]) if len(lists) > 1 else lists[0]
            at = at[(token[at] == a) & (token[after[at]] == b)]
            if a == b and len(at) > 1:  # in a run, every second one from the left
                at.sort()
                starts = np.append(True, after[at[:-1]] != at[1:])
                place = np.arange(len(at))
                at = at[(place - np.maximum.accumulate(np.where(starts, place, 0))) % 2 == 0]
            if not len(at):
                continue
            gone = after[at]
            token[at], token[gone] = merged, -1
            after[at] = beyond = after[gone]
            before[beyond] = at
            left = before[at]
            left = left[(left < n) & (token[left] != merged)]  # that pair is the other merge's own
            pairs = np.concatenate([left, at[beyond < n]])
            rank = self.rank_of(token[pairs], token[after[pairs]])
            pairs, rank = pairs[rank >= 0], rank[rank >= 0]
            if not len(pairs):
                continue
            order = np.argsort(rank, kind="stable")
            pairs, rank = pairs[order], rank[order]
            cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            for k, p in zip(rank[np.append(0, cuts)].tolist(), np.split(pairs, cuts)):
                listed(k, p)
        alive = token[:n] >= 0
        blob = token[:n][alive].astype("<u4").tobytes()
        stop = (4 * np.cumsum(alive)[ends - 1]).tolist()
        return [blob[s:e] for s, e in zip([0, *stop[:-1]], stop)]

    @staticmethod
    def words(text: str) -> tuple[str, list[str]]:
        """The text cut at blanks that start a word: its first word, and the others without their blank."""
        if INSIDE_RUN.search(text):
            first, *rest = BEFORE_BLANK.split(text)
            return first, [w[1:] for w in rest]
        first, *rest = text.split(" ")
        return first, rest

    def learn(self, words: Iterable[str], firsts: Iterable[str]) -> None:
        """Encodes words after a blank into `cache` and words without one into `firsts`, all in one merge."""
        index: dict[str, int] = {}
        place = index.setdefault
        kinds = {" ": ([], [], [], []), "": ([], [], [], [])}

        def sort(words: Iterable[str], blank: str, cache: dict[str, bytes]) -> None:
            plain, closed, lined, others = kinds[blank]
            for word in words:
                if word.isalpha():
                    plain.append(word)
                elif (head := word.rstrip(CLOSING)).isalpha():
                    closed.append((word, head, place(word[len(head) :], len(index))))
                elif "\n" in word and (parts := word.split("\n")) == word.split():
                    lined.append((word, parts))
                else:
                    others.append((word, [place(p, len(index)) for p in SPLIT.findall(blank + word)]))

        sort(words, " ", self.cache)
        sort(firsts, "", self.firsts)
        lined = [parts for k in kinds.values() for _, parts in k[2]]
        if lined:  # a line break between two words is a piece of its own
            after, inner = {parts[0] for _, parts in kinds[" "][2]}, {p for _, parts in kinds[" "][2] for p in parts[1:]}
            inner.update(p for _, parts in kinds[""][2] for p in parts)
            for blank, cache, more in ((" ", self.cache, after), ("", self.firsts, inner)):
                sort(more.difference(cache, *([x[0] if isinstance(x, tuple) else x for x in k] for k in kinds[blank])), blank, cache)
        line = place("\n", len(index))
        for blank, cache in ((" ", self.cache), ("", self.firsts)):
            plain, closed = kinds[blank][:2]
            plain.extend({head for _, head, _ in closed}.difference(cache, plain))
        after, bare = kinds[" "][0], kinds[""][0]
        # plain words after a blank are one text in which each blank starts a piece
        data = [*(p.encode() for p in index), *(w.encode() for w in bare)]
        joined = "".join([" ", " ".join(after)]).encode() if after else b""
        starts = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
        sizes = np.append(np.fromiter(map(len, data), np.int64, len(data)), np.diff(np.append(starts, len(joined))) if after else [])
        ids = self.merge(b"".join([*data, joined]), np.cumsum(sizes.astype(np.int64)))
        self.firsts.update(zip(bare, ids[len(index) :]))
        self.cache.update(zip(after, ids[len(data) :]))
        for blank, cache in ((" ", self.cache), ("", self.firsts)):
            _, closed, _, others = kinds[blank]
            for word, found in others:
                cache[word] = b"".join([ids[k] for k in found])
            for word, head, k in closed:
                cache[word] = cache[head] + ids[k]
        for blank, cache in ((" ", self.cache), ("", self.firsts)):
            for word, parts in kinds[blank][2]:
                cache[word] = ids[line].join([cache[parts[0]], *map(self.firsts.__getitem__, parts[1:])])

    def segments(self, text: str) -> list[str | int]:
        """Ordinary text and the ids of special tokens that stand in it, in order."""
        if self.stops is None or not self.stops.search(text):
            return [text]
        out: list[str | int] = []
        at = 0
        for m in self.stops.finditer(text):
            out += [text[at : m.start()], self.special[m[0]]]
            at = m.end()
        return [*out, text[at:]]

    def encode(self, texts: list[str | None] | pa.Array) -> list[bytes]:
        """Each text's ids as little-endian 32-bit integers.

        Texts that hold no special token and no run of white space with a blank in it are cut, and their words counted
        once each, as one Arrow array; the others word by word."""
        column = pc.fill_null(pa.array(texts, pa.string()) if isinstance(texts, list) else texts.cast(pa.string()), "")
        if len(self.cache) + len(self.firsts) > CACHE_WORDS:
            self.cache, self.firsts = {}, {}
        odd = pc.match_substring_regex(column, ODD)
        for token in self.special:
            odd = pc.or_(odd, pc.match_substring(column, token))
        odd = odd.to_numpy(zero_copy_only=False)
        even = np.flatnonzero(~odd)
        slow = {int(k): self.segments(column[int(k)].as_py()) for k in np.flatnonzero(odd)}
        lists = pc.split_pattern(column.take(pa.array(even)), " ")
        starts = lists.offsets.to_numpy()
        cut = lists.flatten().dictionary_encode()
        # words hold no blank, so one joined text gives them all
        known = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(cut.dictionary)], pa.int32()), cut.dictionary), " ")[0].as_py().split(" ") if len(cut.dictionary) else []
        place = cut.indices.to_numpy()
        first = np.zeros(len(place), bool)
        first[starts[:-1] - starts[0]] = True
        openers, openers_at = np.unique(place[first], return_inverse=True)
        inside = np.zeros(len(known), bool)
        inside[place[~first]] = True
        heads = [known[k] for k in openers.tolist()]
        rest = [known[k] for k in np.flatnonzero(inside).tolist()]
        self.firsts.setdefault("", b"")
        new, firsts = [w for w in rest if w not in self.cache], [w for w in heads if w not in self.firsts]
        if slow:
            cuts = [self.words(part) for parts in slow.values() for part in parts if isinstance(part, str)]
            new = {w for _, others in cuts for w in others if w not in self.cache}.union(new)
            firsts = {opener for opener, _ in cuts if opener not in self.firsts}.union(firsts)
        self.learn(new, firsts)
        # one table of ids for the distinct words, and each text's ids gathered from it
        row = np.cumsum(inside) - 1
        blobs = [*map(self.cache.__getitem__, rest), *map(self.firsts.__getitem__, heads)]
        sizes = np.fromiter(map(len, blobs), np.int64, len(blobs)) // 4
        begin, table = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(blobs), "<u4")
        which = np.where(first, 0, row[place])
        which[first] = len(rest) + openers_at
        n = sizes[which]
        ends = np.append(0, np.cumsum(n))
        flat = table[np.repeat(begin[which] - ends[:-1], n) + np.arange(ends[-1])].tobytes() if len(which) else b""
        bounds = (4 * ends[starts - starts[0]]).tolist() if len(even) else []
        out: list[bytes] = [b""] * len(column)
        for k, s, e in zip(even.tolist(), bounds, bounds[1:]):
            out[k] = flat[s:e]
        for k, parts in slow.items():
            ids = []
            for part in parts:
                if isinstance(part, str):
                    opener, others = self.words(part)
                    ids += [self.firsts[opener], *map(self.cache.__getitem__, others)]
                else:
                    ids.append(part.to_bytes(4, "little"))
            out[k] = b"".join(ids)
        return out

    def decode(self, ids: bytes) -> str:
        """Special tokens stay; bytes that are no UTF-8 become the replacement character."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=1)
def codec(path: str) -> PairIndexBpe:
    """One codec for each Python worker."""
    return PairIndexBpe(path)


def encode(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), path: str | None = None) -> DataFrame:
    """`keep` and `ids`, the array of token ids of each whole text."""
    keep = common.kept(keep, "ids")
    path = path or default_path()
    slim = docs.select(*keep, F.col(text).alias("__text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.pieces(batches, "__text", PIECE_BYTES):
            ids = codec(path).encode(batch.column("__text"))
            offsets = np.cumsum([0, *(len(x) // 4 for x in ids)])
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), lists], [*keep, "ids"])

    return slim.mapInArrow(work, T.StructType([*slim.drop("__text").schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def decode(rows: DataFrame, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",), path: str | None = None) -> DataFrame:
    """`keep` and `text`, from an array of token ids; null ids give a null text."""
    keep = common.kept(keep, "text")
    path = path or default_path()
    slim = rows.select(*keep, F.col(ids).cast("array<int>").alias("__ids"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if x is None else codec(path).decode(np.array(x, "<u4").tobytes()) for x in batch.column("__ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(texts, pa.string())], [*keep, "text"])

    return slim.mapInArrow(work, T.StructType([*slim.drop("__ids").schema.fields, T.StructField("text", T.StringType())]))


def op8_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the text decoded from them; ids stay in the task that made them."""
    path = default_path()
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.pieces(batches, "text", PIECE_BYTES):
            bpe = codec(path)
            ids = bpe.encode(batch.column("text"))
            counts, digests = [len(x) // 4 for x in ids], [common.sha256(x) for x in ids]
            texts = [common.sha256(bpe.decode(x).encode()) for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(digests), pa.array(texts)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.mapInArrow(work, T.StructType([docs.schema["doc_id"], *T.StructType.fromDDL("n_tokens long, ids_sha256 string, decoded_sha256 string").fields]))
