"""Words of many texts at once, as places in one buffer of bytes.

What a byte is decides everything here: all bytes of a character beyond ASCII are 0x80 or more, so classes of ASCII
characters need no decoding.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of `[^\x20\x09-\x0D]`.
NOT_BLANK = np.array([b != 0x20 and not 0x09 <= b <= 0x0D for b in range(256)])


@dataclass
class Words:
    """`data`: all words, each with one space behind it. Word k stands in data[start[k]:end[k]]; text t has the words
    first[t] to first[t + 1], the end not included."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def joined(self, a: int, b: int) -> bytes:
        """Words a to b, the end not included, joined by one space."""
        return self.data[self.start[a] : self.end[b - 1]].tobytes() if a < b else b""

    def numbered(self) -> np.ndarray:
        """For each word a number that only equal words share."""
        edges = np.append(self.start, len(self.data)).astype(np.int64)
        each = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(self.start), [None, pa.py_buffer(edges), pa.py_buffer(self.data)])
        return each.dictionary_encode().indices.to_numpy(zero_copy_only=False)


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of an array of texts (nulls are empty), and the place where each text begins, with the end of the last."""
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    _, places, data = texts.buffers()
    at = np.frombuffer(places, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def split(texts: pa.Array, word_byte: np.ndarray, to: np.ndarray | None = None) -> Words:
    """Longest runs of bytes that `word_byte` marks, none over the edge of a text, their bytes put through `to`."""
    raw, at = bytes_of(texts)
    inside = word_byte[raw]
    edges = at[(at > 0) & (at < len(raw))]
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    opens[edges], closes[edges - 1] = inside[edges], inside[edges - 1]
    start = np.flatnonzero(opens)
    length = np.flatnonzero(closes) + 1 - start
    end = np.cumsum(length + 1) - 1
    data = np.full(int(end[-1]) + 1 if len(end) else 0, 0x20, np.uint8)
    letter = np.ones(len(data), bool)
    letter[end] = False
    data[letter] = raw[inside] if to is None else to[raw[inside]]
    return Words(data, end - length, end, np.searchsorted(start, at))
