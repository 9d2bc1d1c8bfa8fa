"""Jaccard join of word 4-gram sets by PartEnum signatures.

Two sets of similarity ``THRESHOLD`` % differ in at most (100 - t) / (100 + t) of the sum of their sizes. Sizes are
cut into overlapping bands so that any two similar sets share a band, and a band's largest size bounds the
difference k of all its pairs. For a band the hashed feature domain is dealt into groups, each group into a few parts; of
every group all subsets of parts that leave out ``free`` parts are enumerated, and the features in a subset are summed
into one signature. At most k // (free + 1) groups hold more than ``free`` differences, so two similar sets have
equal signatures in all other groups.

A signature of no features says nothing and is not made. There are ``spare`` groups more than needed, so a pair has
``spare + 1`` agreeing groups at least. A set in which more than ``spare`` groups have an empty subset is dealt again
with the next seed (and again, until one suits). A pair could be missed under a seed only if all its agreeing
groups had empty subsets in both sets; then both go on to the next one. So no pair is lost, and no signature is shared for
want of features.

Equal sets are one class, known by a 64-bit number of the set. Classes that share a signature aren't compared in
pairs at first: each is compared with the one of them that shares the most signatures with others, which for copies of one
text is mostly its source. Only classes that share a signature but no component after that are paired, in tiles of bounded
size, if their sizes and parity sketches allow the similarity. Every link is verified by the words themselves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lookthru.llm.shared import components, stored
from lookthru.llm.text import LOWER, WHITE, Words, grams, mix, slices
from lookthru.operators.tiles import pair_condition, tiled

WIDTH = 4
THRESHOLD = 85
GROWTH = 1.5        # of the sizes from band to band
LARGEST = 1 << 40
SKETCH = 1024       # bits of a sketch; of fewer, those of large sets allow nearly any pair
SKETCHED = 1024     # sets whose sketches are made at a time
FEW = 32            # up to so many differences, groups have parts; beyond, a part is a group of its own


class Band(NamedTuple):
    low: int
    high: int       # largest size of a set in the band
    k: int          # most differences of a similar pair
    groups: int
    parts: int
    free: int       # parts left out of a subset
    spare: int      # groups beyond those that k differences can spoil


def _band(low: int, after: int) -> Band:
    high = (after - 1) * 100 // THRESHOLD
    k = (100 - THRESHOLD) * 2 * high // (100 + THRESHOLD)
    parts, free = (4, 2) if k == 2 else (3, 1) if 0 < k < FEW else (1, 0)
    least, spare = k // (free + 1) + 1, 0
    while True:  # as many spare groups as a small set of the band has with an empty subset, and half of them again
        groups = least + spare
        empty = groups * min(1.0, math.comb(parts, free) * math.exp(-low * (parts - free) / parts / groups))
        if empty < 0.3 or 1.5 * empty <= spare or spare >= least:
            return Band(low, high, k, groups, parts, free, spare)
        spare += max(1, spare // 8)


def _bands() -> list[Band]:
    out, low = [], 1
    while low < LARGEST:
        after = max(low + 1, int(low * GROWTH))
        out.append(_band(low, after))
        low = after
    return out


BANDS = _bands()


def feature_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, sizes): the distinct shingle hashes of each text, one text after the other."""
    words = Words(texts, WHITE, lower=True)
    hashes, doc = words.hashes(), words.doc()
    left = words.first[1:][doc] - np.arange(len(hashes)) if len(hashes) else np.zeros(0, np.int64)
    found, owner = [], []
    for k in range(1, WIDTH + 1):
        gram = grams(hashes, k)
        at = np.flatnonzero(left[:len(gram)] >= WIDTH) if k == WIDTH else words.first[:-1][words.counts == k]
        found.append(gram[at])
        owner.append(doc[at])
    h, owner = np.concatenate(found), np.concatenate(owner)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return h[new], np.bincount(owner[new], minlength=len(words.counts))


def _sums(values: np.ndarray, cell: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, np.uint64)
    np.add.at(out, cell, values)
    return out


def set_numbers(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 64-bit number of each set."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return mix(_sums(mix(hashes ^ np.uint64(0x5851F42D4C957F2D)), owner, len(sizes)) + sizes.astype(np.uint64))


def sketches(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``SKETCH`` parities of each set as integers of 64: two sets differ in at least as many features as their sketches in bits."""
    owner, place = np.repeat(np.arange(len(sizes)), sizes), (hashes >> np.uint64(7) & np.uint64(SKETCH - 1)).astype(np.int64)
    out = np.zeros((len(sizes), SKETCH // 64), np.int64)
    ends = np.cumsum(np.append(0, sizes))
    for i in range(0, len(sizes), SKETCHED):
        n, own = len(sizes[i:i + SKETCHED]), slice(ends[i], ends[min(i + SKETCHED, len(sizes))])
        odd = np.bincount((owner[own] - i) * SKETCH + place[own], minlength=SKETCH * n) & 1
        out[i:i + n] = np.packbits(odd.astype(np.uint8)).view(np.int64).reshape(n, -1)
    return out


def signatures(hashes: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(sets, signatures): the PartEnum signatures of all sets, by band and seed."""
    if not len(hashes):
        return
    start = np.cumsum(sizes) - sizes
    value = mix(hashes + np.uint64(0x14057B7EF767814F))
    for number, band in enumerate(BANDS):
        if band.low > sizes.max():
            return
        live, seed = np.flatnonzero((sizes >= band.low) & (sizes <= band.high)), 0
        while len(live) and band.k:
            n = sizes[live]
            own = np.repeat(np.arange(len(live)), n)
            at = np.repeat(start[live] - np.cumsum(n) + n, n) + np.arange(n.sum())
            dealt = mix(hashes[at] ^ mix(np.uint64([number * 4096 + seed + 1])))
            group = ((dealt >> np.uint64(32)) * np.uint64(band.groups) >> np.uint64(32)).astype(np.int64)
            part = ((dealt & np.uint64(0xFFFF)) * np.uint64(band.parts) >> np.uint64(16)).astype(np.int64)
            cell = (own * band.groups + group) * band.parts + part
            shape = (len(live), band.groups, band.parts)
            total = _sums(value[at], cell, math.prod(shape)).reshape(shape)
            count = np.bincount(cell, minlength=math.prod(shape)).reshape(shape)
            bare = np.zeros(shape[:2], bool)
            for j, subset in enumerate(combinations(range(band.parts), band.parts - band.free)):
                full = count[:, :, subset].sum(2) > 0
                tag = np.uint64((number * 4096 + seed) * 64 + j + 1) * np.uint64(1 << 32) + np.arange(band.groups).astype(np.uint64)
                made = mix(total[:, :, subset].sum(2) + mix(tag))
                bare |= ~full
                yield live[np.nonzero(full)[0]], made[full]
            live, seed = live[bare.sum(1) > band.spare], seed + 1


def _prints(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(id, tkey, n, cls, sketch) of every row; cls is null for an empty set."""
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            h, n = feature_sets(part.column("text"))
            yield pa.RecordBatch.from_arrays([
                part.column("id"), part.column("tkey"), pa.array(n), pa.array(set_numbers(h, n).view(np.int64), mask=n == 0),
                pa.array(list(sketches(h, n)), pa.list_(pa.int64()))], ["id", "tkey", "n", "cls", "sketch"])

    given = docs.select(F.col(id_column).alias("id"), F.xxhash64(text_column).alias("tkey"), F.col(text_column).alias("text"))
    return given.mapInArrow(run, f"id {kind}, tkey bigint, n bigint, cls bigint, sketch array<bigint>")


def _signed(docs: DataFrame, text_column: str) -> DataFrame:
    """(sig, cls) of every class; a task gives a class once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for part in slices(batches, "text"):
            h, n = feature_sets(part.column("text"))
            cls = set_numbers(h, n)
            fresh = np.zeros(len(n), bool)
            for i, c in enumerate(cls.tolist()):
                fresh[i] = c not in seen
                seen.add(c)
            h, n, cls = h[np.repeat(fresh, n)], n[fresh], cls[fresh]
            for owner, sig in signatures(h, n):
                yield pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array(cls[owner].view(np.int64))], ["sig", "cls"])

    return docs.select(F.col(text_column).alias("text")).mapInArrow(run, "sig bigint, cls bigint")


def shingle_set(text: bytes | None) -> set[bytes]:
    words = (text or b"").translate(LOWER).split()
    if len(words) < WIDTH:
        return {b" ".join(words)} if words else set()
    return set(map(b" ".join, zip(*(words[i:] for i in range(WIDTH)))))


def _verified(pairs: DataFrame, prints: DataFrame, docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """The pairs (a, b) of classes whose texts have the similarity."""
    wanted = pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct()
    rows = (prints.join(wanted, "cls", "left_semi").groupBy("cls")
            .agg(F.min(F.struct("tkey", F.col("id").isNull().alias("none"), "id")).alias("r")).select("cls", F.col("r.tkey").alias("tkey"), F.col("r.id").alias("id")))
    given = docs.select(F.col(id_column).alias("own"), F.xxhash64(text_column).alias("hash"), F.col(text_column).cast("binary").alias("text"))
    texts = stored(given.join(rows, (F.col("hash") == F.col("tkey")) & F.col("own").eqNullSafe(F.col("id"))).groupBy("cls").agg(F.first("text").alias("text")))
    sides = (pairs.join(texts.withColumnsRenamed({"cls": "a", "text": "text_a"}), "a").join(texts.withColumnsRenamed({"cls": "b", "text": "text_b"}), "b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, set()
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                ok = []
                for a, x, y in zip(*(part.column(c).to_pylist() for c in ("a", "text_a", "text_b"))):
                    if a != last:
                        last, held = a, shingle_set(x)
                    other = shingle_set(y)
                    both = len(held & other)
                    ok.append(100 * both >= THRESHOLD * (len(held) + len(other) - both))
                yield part.select(["a", "b"]).filter(pa.array(ok))

    return sides.select("a", "b", "text_a", "text_b").mapInArrow(run, "a bigint, b bigint")


def class_links(docs: DataFrame, prints: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(a, b): verified links of classes whose components are those of all links."""
    signed = _signed(docs, text_column)
    shared = signed.groupBy("sig").agg(F.min("cls").alias("low"), F.max("cls").alias("high")).filter("low <> high").select("sig")
    members = stored(signed.join(shared, "sig").select("sig", "cls"))
    ties = members.groupBy("cls").agg(F.count("*").alias("ties"))
    best = members.join(ties, "cls").groupBy("sig").agg(F.max(F.struct("ties", "cls")).alias("best")).select("sig", F.col("best.cls").alias("hub"))
    near = members.join(best, "sig").filter("cls <> hub").select(F.least("cls", "hub").alias("a"), F.greatest("cls", "hub").alias("b")).distinct()
    links = stored(_verified(stored(near), prints, docs, id_column, text_column))
    tied = components(links, "a", "b")
    marked = members.join(tied.withColumnRenamed("node", "cls"), "cls", "left").select("sig", "cls", F.coalesce("component", "cls").alias("label"))
    marked = stored(marked)
    split = marked.groupBy("sig").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("sig")
    sizes = prints.filter("cls is not null").groupBy("cls").agg(F.max("n").alias("n"), F.max("sketch").alias("sketch"))
    rest = tiled(marked.join(split, "sig").distinct().join(sizes, "cls"), ["sig"], "cls")
    bits = sum((F.bit_count(F.col("x.sketch")[i].bitwiseXOR(F.col("y.sketch")[i])) for i in range(SKETCH // 64)), F.lit(0))
    fits = ((F.col("x.label") != F.col("y.label")) & (100 * F.least("x.n", "y.n") >= THRESHOLD * F.greatest("x.n", "y.n"))
            & ((100 + THRESHOLD) * bits <= (100 - THRESHOLD) * (F.col("x.n") + F.col("y.n"))))
    far = (rest.alias("x").join(rest.alias("y"), pair_condition("x", "y", ["sig"], "cls", "cls") & fits)
           .select(F.col("x.cls").alias("a"), F.col("y.cls").alias("b")).distinct())
    far = stored(far.join(near, ["a", "b"], "left_anti"))
    return links.unionByName(_verified(far, prints, docs, id_column, text_column))


def similar_sets(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, tkey, n_shingles, cls, component): one row per row of ``docs``. cls is the class of equal sets, component the smallest
    id reachable over links, the row itself included.

    Words are runs without blanks, tabs and line breaks, A-Z lower-cased; a set holds the distinct runs of four words, or
    all words of a shorter text as one run. Texts without words, and null ones, have an empty set, which is linked with nothing, not
    even with an equal row: component is their own id. Repeated rows each give a row. A null id is the smallest only if all
    ids of its component are null. An empty table gives an empty table. Other columns are not looked at.
    """
    prints = stored(_prints(docs, id_column, text_column))
    tied = components(class_links(docs, prints, id_column, text_column), "a", "b").withColumnRenamed("node", "cls")
    classes = prints.filter("cls is not null").groupBy("cls").agg(F.min("id").alias("least")).join(tied, "cls", "left")
    classes = stored(classes.withColumn("label", F.coalesce("component", "cls")).drop("component"))
    lows = classes.groupBy("label").agg(F.min("least").alias("component"))
    found = classes.join(lows, "label").select("cls", "component")
    full = prints.filter("cls is not null").join(found, "cls").select("id", "tkey", F.col("n").alias("n_shingles"), "cls", "component")
    return full.unionByName(prints.filter("cls is null").select("id", "tkey", F.col("n").alias("n_shingles"), "cls", F.col("id").alias("component")))


def op13_jaccard(docs: DataFrame) -> DataFrame:
    return similar_sets(docs).select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


ORACLE = """
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
    FROM documents),
t AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]))) END AS s FROM d),
c AS MATERIALIZED (SELECT row_number() OVER (ORDER BY min(doc_id)) AS c, min(doc_id) AS low, s FROM t WHERE len(s) > 0 GROUP BY s),
f AS MATERIALIZED (SELECT c, len(s) AS n, unnest(s) AS x FROM c),
e AS MATERIALIZED (SELECT a.c AS a, b.c AS b FROM f a JOIN f b ON a.x = b.x AND a.c <> b.c GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
r(a, b) AS (SELECT c, c FROM c UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT r.a AS c, min(low) AS component FROM r JOIN c ON c.c = r.b GROUP BY r.a)
SELECT t.doc_id, CAST(len(t.s) AS BIGINT) AS n_shingles, coalesce(component, t.doc_id) AS component_id
FROM t LEFT JOIN c ON c.s = t.s AND len(t.s) > 0 LEFT JOIN m USING (c)
"""
