"""Words of whole texts as arrays of positions, for use inside Arrow tasks.

Texts arrive in Arrow batches that Spark partitions. ``slices`` cuts a batch by bytes so that the memory
of a task does not depend on how long its documents are (one document is never cut). ``Words`` finds the
words of all texts of a slice at once: byte starts and ends, the words of each text, and 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20

#: Separator bytes of the two kinds of words.
WHITE = bytes(1 if b == 0x20 or 0x09 <= b <= 0x0D else 0 for b in range(256))
NOT_WORD = bytes(0 if 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b > 0x7F else 1
                 for b in range(256))
LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_KEEP = np.array([0] + [(1 << 8 * n) - 1 for n in range(1, 9)], np.uint64)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Pieces of the batches whose texts hold about ``limit`` bytes; always at least one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.nan_to_num(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False))
        part = np.cumsum(sizes.astype(np.int64)) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Words:
    """Words of the texts of one slice; null counts as empty."""

    def __init__(self, texts: pa.Array, separators: bytes = WHITE, lower: bool = False):
        joined = pc.binary_join_element_wise(texts.cast(pa.large_string()).fill_null(""), pa.scalar("\n", pa.large_string()),
                                             pa.scalar("", pa.large_string()))
        _, offsets, data = joined.buffers()
        self.offsets = np.frombuffer(offsets, np.int64)[joined.offset:joined.offset + len(joined) + 1]
        size = int(self.offsets[-1])
        raw = bytes(memoryview(data)[:size]) if size else b""
        if lower:
            raw = raw.translate(LOWER)
        self.raw = raw
        self.bytes = np.frombuffer(raw + bytes(8), np.uint8)
        edge = np.flatnonzero(np.diff(np.frombuffer(b"\x01" + raw.translate(separators), np.int8)))
        self.starts, self.ends = edge[::2], edge[1::2]  # each text ends with a separator
        self.first = np.searchsorted(self.starts, self.offsets)
        self.counts = np.diff(self.first)

    def __len__(self) -> int:
        return len(self.starts)

    def doc(self) -> np.ndarray:
        """The text that each word belongs to."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def word(self, i: int) -> str:
        return self.raw[self.starts[i]:self.ends[i]].decode("utf-8", "replace")

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word, from eight bytes at a time."""
        eights = np.ndarray((len(self.bytes) - 7,), "<u8", self.bytes, 0, (1,))
        size = self.ends - self.starts
        out = mix(size.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        live, at, left = np.arange(len(size)), self.starts, size
        while len(live):
            got = eights[at] & _KEEP[np.minimum(left, 8)]
            out[live] = mix(out[live] ^ got)
            more = left > 8
            live, at, left = live[more], at[more] + 8, left[more] - 8
        return out


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words that start at each word; the last k - 1 places are left out."""
    n = max(0, len(hashes) - k + 1)
    out, odd = np.full(n, k, np.uint64), 1
    for i in range(k):
        odd = odd * 0x9E3779B97F4A7C15 % (1 << 64)
        out += hashes[i:i + n] * np.uint64(odd)
    return mix(out)


def long_grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """``grams`` for many words: runs of doubled length are hashed from those before and joined."""
    n = max(0, len(hashes) - k + 1)
    out, done, power, size = np.full(n, k, np.uint64), 0, hashes, 1
    while n:
        if k & size:
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + power[done:done + n])
            done += size
        if 2 * size > k:
            break
        power = mix(power[:-size] * np.uint64(0x9E3779B97F4A7C15) + power[size:])
        size *= 2
    return out


def winnow(gram: np.ndarray, words_left: np.ndarray, width: int, k: int) -> np.ndarray:
    """Places of the kept k-grams. words_left: words from each place to the end of its text."""
    n = len(gram) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    low = gram[:n].copy()
    for i in range(1, width):
        np.minimum(low, gram[i:i + n], out=low)
    open_ = words_left[:n] >= width + k - 1
    kept = np.zeros(len(gram), bool)
    for i in reversed(range(width)):
        here = open_ & (gram[i:i + n] == low)
        kept[i:i + n] |= here
        open_ &= ~here
    return np.flatnonzero(kept)


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of all ranges, one after the other."""
    total = int(sizes.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(total)
