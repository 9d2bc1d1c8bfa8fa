"""The best-scoring choice of every name, exactly, by branch and bound in bounded blocks.

Score: sort the words of both names, then 2 * LCS / (sum of their lengths), LCS being the longest common subsequence of
characters. It can't exceed 2 * (common letters, with repeats) / (sum of lengths), which is cheap for a whole block of
choices at once. The choices of the highest bounds are scored first; after that only those whose bound still reaches the best
score, so no choice that could win is left out.

Names and choices of a match block are cut into pieces of bounded size, and each pair of pieces is one join unit: a block
of very many names or choices is spread over tasks, and nothing is broadcast. Within a unit the LCS of one name with many choices
is a bit-vector recurrence over arrays of 64-bit words with a carry between words, for names of any length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.similarity import sort_words

NAMES_PER_UNIT = 1024
CHOICES_PER_UNIT = 16384
FIRST = 48          # choices of the highest bounds, scored before the others
PART = 2048         # choices scored at a time
LETTERS = 64        # columns of letter counts; rarer letters share one, which only loosens the bound
BITS = 63
_LOW = np.uint64((1 << BITS) - 1)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Choices:
    """A block of choices, packed for scoring names against all of them."""

    def __init__(self, labels: list[str], words: list[str]):
        self.labels = labels
        self.flat = np.concatenate([_codes(w) for w in words]) if words else np.zeros(0, np.uint32)
        self.sizes = np.array([len(w) for w in words], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.alphabet, letter, often = np.unique(self.flat, return_inverse=True, return_counts=True)
        self.flat = letter
        order = np.empty(len(often), np.int64)
        order[np.argsort(-often, kind="stable")] = np.arange(len(often))
        self.column = np.minimum(order, LETTERS - 1)
        self.counts = np.bincount(np.repeat(np.arange(len(words)), self.sizes) * LETTERS + self.column[letter],
                                  minlength=len(words) * LETTERS).reshape(-1, LETTERS).astype(np.int32)
        self.equal: dict[str, str] = {}
        for label, w in zip(labels, words):
            self.equal[w] = min(label, self.equal.get(w, label))

    def _letters(self, codes: np.ndarray) -> np.ndarray:
        """Places of the letters in the alphabet of the block; -1 for others."""
        if not len(self.alphabet):
            return np.full(len(codes), -1)
        at = np.minimum(np.searchsorted(self.alphabet, codes), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == codes, at, -1)

    def bounds(self, name: np.ndarray) -> np.ndarray:
        known = name[name >= 0]
        own = np.bincount(self.column[known], minlength=LETTERS)
        at = np.flatnonzero(own)
        common = np.minimum(self.counts[:, at], own[at]).sum(1)
        return 2.0 * common / (len(name) + self.sizes)

    def lcs(self, name: np.ndarray, which: np.ndarray) -> np.ndarray:
        """LCS lengths of a name (places of its letters) with the choices ``which``."""
        n_words = max(1, -(-len(name) // BITS))
        masks = np.zeros((n_words, len(self.alphabet)), np.uint64)
        for i, letter in enumerate(name.tolist()):
            if letter >= 0:
                masks[i // BITS, letter] |= np.uint64(1 << i % BITS)
        full = np.array([(1 << min(BITS, len(name) - BITS * w)) - 1 for w in range(n_words)], np.uint64)
        order = np.argsort(-self.sizes[which], kind="stable")  # longest first: the others end on the way
        starts, sizes = self.starts[which][order], self.sizes[which][order]
        state = np.repeat(full[:, None], len(which), axis=1)
        live = len(which)
        for j in range(int(sizes[0]) if live else 0):
            while sizes[live - 1] <= j:
                live -= 1
            letter, carry = self.flat[starts[:live] + j], np.uint64(0)
            for w in range(n_words):
                v = state[w, :live]
                hit = v & masks[w, letter]
                total = v + hit + carry
                carry = total >> np.uint64(BITS)
                state[w, :live] = ((total & _LOW) | (v - hit)) & full[w]
        out = np.empty(len(which), np.int64)
        out[order] = len(name) - np.bitwise_count(state).astype(np.int64).sum(0)
        return out

    def best(self, words: str, at_least: float = 0.0) -> tuple[float, str | None, int]:
        """(score, choice, choices scored): the best choice of at least that score, ties to the smallest label."""
        if words in self.equal:
            return 1.0, self.equal[words], 0
        name = self._letters(_codes(words))
        bound, best, label, scored = self.bounds(name), at_least, None, 0
        order = np.argsort(-bound, kind="stable")
        at, size = 0, FIRST
        while at < len(order) and bound[order[at]] >= best:
            part = order[at:at + size]
            part = part[bound[part] >= best]
            got = 2.0 * self.lcs(name, part) / (len(name) + self.sizes[part])
            top = got.max()
            if top >= best:
                tied = min(self.labels[i] for i in part[got == top].tolist())
                label = tied if label is None or top > best else min(label, tied)
                best = float(top)
            scored += len(part)
            at, size = at + size, PART
        return best if label is not None else 0.0, label, scored


def best_choices(names: DataFrame, choices: DataFrame, at_least: float = 0.0, blocked: bool = False) -> DataFrame:
    """(n, score, match, scored): the best choice of each name with a score of at least ``at_least`` (0 to 1).

    Both tables have a distinct column ``n``; with ``blocked`` also a column ``block`` that must be equal. Ties go to the
    alphabetically first choice. A name without such a choice has no row. ``scored`` is how many LCS were computed for it.
    """
    block = F.col("block") if blocked else F.lit("")
    left = names.select(block.alias("block"), "n", sort_words(F.col("n")).alias("words"))
    right = choices.select(block.alias("block"), "n", sort_words(F.col("n")).alias("words"))

    def pieces(size: int) -> Column:
        return F.greatest(F.ceil(F.count(F.lit(1)) / size), F.lit(1)).cast("int")

    ours, theirs = pieces(NAMES_PER_UNIT).alias("_ln"), pieces(CHOICES_PER_UNIT).alias("_rn")
    cuts = left.groupBy("block").agg(ours).join(right.groupBy("block").agg(theirs), "block")

    def units(df: DataFrame, own: str, own_n: str, other: str, other_n: str) -> DataFrame:
        sized = df.join(cuts, "block") if blocked else df.withColumns(
            {"_ln": left.select(ours).scalar(), "_rn": right.select(theirs).scalar()})
        return sized.select("block", "n", "words", F.pmod(F.xxhash64("n"), F.col(own_n)).cast("int").alias(own),
                            F.explode(F.sequence(F.lit(0), F.col(other_n) - 1)).alias(other))

    def score(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        block_of = Choices(theirs.column("n").to_pylist(), theirs.column("words").to_pylist())
        asked = mine.column("n").to_pylist()
        found = [block_of.best(w, at_least) for w in mine.column("words").to_pylist()]
        return pa.table({"n": pa.array(asked, pa.string()), "score": pa.array([f[0] for f in found], pa.float64()),
                         "match": pa.array([f[1] for f in found], pa.string()), "scored": pa.array([f[2] for f in found], pa.int64())})

    unit = ["block", "_l", "_r"]
    met = units(left, "_l", "_ln", "_r", "_rn").groupBy(*unit).cogroup(units(right, "_r", "_rn", "_l", "_ln").groupBy(*unit))
    rows = met.applyInArrow(score, "n string, score double, match string, scored bigint")
    best = rows.groupBy("n").agg(F.min(F.when(F.col("match").isNotNull(), F.struct((-F.col("score")).alias("worse"), "match"))).alias("b"),
                                 F.sum("scored").alias("scored"))
    return best.filter("b is not null").select("n", (-F.col("b.worse")).alias("score"), F.col("b.match").alias("match"), "scored")
