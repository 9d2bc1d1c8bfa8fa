"""Benchmark decontamination by winnowing.

Documents and benchmark items are cut into k-grams of words; of every run of ``SPAN - K + 1`` k-grams the one with
the smallest hash is kept (the last of equals). Two texts that share a span of ``SPAN`` words keep the same
k-gram of it, so joining the kept fingerprints finds every shared span. A match is extended word by word on both
sides, by the words themselves, and counts if it reaches ``SPAN`` words. Items of fewer words are one
window: their whole text is the fingerprint, and documents then keep all grams of that length.

Before the join, documents drop fingerprints that no item has, by a bit map of fixed size (no false negatives, and
exact after the join). The map does not grow with either table; a large benchmark only makes it let more through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lookthru.llm.shared import spare
from lookthru.llm.text import NOT_WORD, Words, grams, mix, slices, winnow

SPAN = 10
K = 5
MAP_BITS = 1 << 22


def _kept(words: Words, lengths: list[int]) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(k, places, hashes) of the long windows and of each short length."""
    hashes = words.hashes()
    left = np.repeat(words.first[1:], words.counts) - np.arange(len(hashes))
    gram = grams(hashes, K)
    at = winnow(gram, left, SPAN - K + 1, K)
    out = [(K, at, gram[at])]
    for m in lengths:
        gram = grams(hashes, m)
        at = np.flatnonzero(left[:len(gram)] >= m)
        out.append((m, at, mix(gram[at] + np.uint64(SPAN))))
    return out


_FOUND = "kind int, key bigint, at bigint, gram string, before array<string>, after array<string>"


def _rows(words: Words, k: int, at: np.ndarray, key: np.ndarray, long: bool) -> tuple[list[pa.Array], np.ndarray]:
    """Fingerprints with the words around them, nearest first, as far as a window may reach; and their texts."""
    doc = np.searchsorted(words.first, at, side="right") - 1
    start, end = words.first[doc], words.first[doc + 1]
    back = np.minimum(at - start, SPAN - k) if long else np.zeros(len(at), np.int64)
    ahead = np.minimum(end - at - k, SPAN - k) if long else np.zeros(len(at), np.int64)
    at_list = at.tolist()
    gram = [" ".join(words.word(i + j) for j in range(k)) for i in at_list]
    before = [[words.word(i - 1 - j) for j in range(n)] for i, n in zip(at_list, back.tolist())]
    after = [[words.word(i + k + j) for j in range(n)] for i, n in zip(at_list, ahead.tolist())]
    n = len(at)
    return [pa.array(np.full(n, k if long else k + SPAN), pa.int32()), pa.array(key.view(np.int64)), pa.array(at - start),
            pa.array(gram, pa.string()), pa.array(before, pa.list_(pa.string())), pa.array(after, pa.list_(pa.string()))], doc


def _fingerprints(rows: DataFrame, kind: str, lengths: list[int] | None, bits: np.ndarray | None) -> DataFrame:
    """One marker row (kind 0) with n_words per row, and a row per kept fingerprint that is in the map. With
    ``lengths`` None the rows are items: a short one gives its whole text."""
    names = ["id", "tkey", "n_words", "kind", "key", "at", "gram", "before", "after"]

    def run(batches):
        for part in slices(batches, "text"):
            words = Words(part.column("text"), NOT_WORD, lower=True)
            n, ids = len(words.counts), part.column("id")
            tkey = part.column("tkey").to_numpy(zero_copy_only=False)
            spread = mix(tkey.view(np.uint64) + np.arange(n).astype(np.uint64)).view(np.int64)
            empty = pa.ListArray.from_arrays(pa.array([0] * (n + 1), pa.int32()), pa.array([], pa.string()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(tkey), pa.array(words.counts.astype(np.int64)), pa.array([0] * n, pa.int32()),
                                              pa.array(spread), pa.array([0] * n, pa.int64()), pa.array([""] * n), empty, empty], names)
            short = [m for m in range(1, SPAN)] if lengths is None else lengths
            for j, (k, at, key) in enumerate(_kept(words, short)):
                if lengths is None and j:  # an item's own length only, from its first word
                    doc = np.searchsorted(words.first, at, side="right") - 1
                    own = words.counts[doc] == k
                    at, key = at[own], key[own]
                if bits is not None and len(at):
                    place = key % np.uint64(MAP_BITS)
                    own = (bits[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1
                    at, key = at[own], key[own]
                if not len(at):
                    continue
                columns, doc = _rows(words, k, at, key, j == 0)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(doc)), pa.array(tkey[doc]), pa.nulls(len(at), pa.int64()), *columns], names)

    return rows.mapInArrow(run, f"id {kind}, tkey bigint, n_words bigint, {_FOUND}")


def _prefix(mine: str, theirs: str) -> Column:
    """How many words at the start of two arrays are equal."""
    out = F.lit(0)
    for i in reversed(range(SPAN - K)):
        out = F.when(F.get(mine, F.lit(i)) == F.get(theirs, F.lit(i)), F.lit(1) + out).otherwise(F.lit(0))
    return out


def _given(rows: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return rows.select(F.col(id_column).alias("id"), F.coalesce(F.xxhash64(text_column), F.lit(0)).alias("tkey"),
                       F.col(text_column).alias("text"))


def overlaps(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text",
             item_column: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, tkey, n_words, spans (start, end in words of every hit, end exclusive) and items
    (the ids, as strings, of items with a window in the document; sorted).

    Words are runs of letters, digits and characters beyond ASCII, A-Z lower-cased. A window is ``SPAN`` consecutive
    item words, or all words of a shorter item. Null and empty texts have no words; items without words
    match nothing; items without an id give hits but no name. Rows that repeat an id and a text each give the same row. Empty
    tables give empty tables, and an empty benchmark no hits.
    """
    kind, item_kind = docs.schema[id_column].dataType.simpleString(), items.schema[item_column].dataType.simpleString()
    prints = _fingerprints(_given(items, item_column, item_text), item_kind, None, None).filter("kind > 0").select(
        F.col("id").cast("string").alias("item"), "kind", "key", F.col("gram").alias("item_gram"),
        F.col("before").alias("item_before"), F.col("after").alias("item_after")).distinct()
    place = F.pmod(F.col("key"), F.lit(MAP_BITS))  # the modulus is a power of two: as of the unsigned key
    words = prints.select(place.alias("p")).select(F.shiftright("p", 6).alias("w"), F.expr("shiftleft(1L, cast(p & 63 as int))").alias("bit"))
    bits = np.zeros(MAP_BITS >> 6, np.uint64)
    for w, bit in words.groupBy("w").agg(F.bit_or("bit").alias("bit")).collect():  # at most MAP_BITS / 64 rows
        bits[w] = np.uint64(bit % (1 << 64))
    lengths = sorted(r[0] - SPAN for r in prints.filter(F.col("kind") > SPAN).select("kind").distinct().collect())  # at most nine
    found = _fingerprints(_given(docs, id_column, text_column), kind, lengths, bits)
    hit = (F.col("gram") == F.col("item_gram"))
    left, right = _prefix("before", "item_before"), _prefix("after", "item_after")
    met = (found.join(prints, ["kind", "key"], "left").withColumn("left", F.when(hit, left)).withColumn("right", F.when(hit, right))
           .withColumn("ok", hit & ((F.col("kind") > SPAN) | (F.col("left") + F.col("right") + K >= SPAN)))
           .withColumn("end", F.when(F.col("kind") > SPAN, F.col("at") + F.col("kind") - SPAN).otherwise(F.col("at") + K + F.col("right"))))
    span = F.when(F.col("ok"), F.struct((F.col("at") - F.col("left")).alias("start"), "end"))
    return (met.groupBy("id", "tkey").agg(F.max("n_words").alias("n_words"), F.count(F.when(F.col("kind") == 0, 1)).alias("rows"),
                                          F.collect_set(span).alias("spans"), F.collect_set(F.when(F.col("ok"), F.col("item"))).alias("items"))
            .select("id", "tkey", "n_words", "spans", F.array_sort("items").alias("items"), F.explode(F.array_repeat(F.lit(1), F.col("rows").cast("int"))))
            .drop("col"))


def _n_hit() -> Column:
    places = F.transform("spans", lambda s: F.sequence(s["start"], s["end"] - 1))
    return F.size(F.array_distinct(F.flatten(places))).cast("bigint")


def drop_contaminated(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` without any word of a benchmark window, with their columns."""
    mine, key = spare(docs, "text_hash"), spare(docs, "hit_id")
    out = overlaps(docs, items, id_column, text_column).filter(F.size("spans") > 0)
    out = out.select(F.col("id").alias(key), F.col("tkey").alias(mine + "_")).distinct()
    return (docs.withColumn(mine, F.coalesce(F.xxhash64(text_column), F.lit(0)))
            .join(out, F.col(id_column).eqNullSafe(F.col(key)) & (F.col(mine) == F.col(mine + "_")), "left_anti").drop(mine))


def op10_winnowing(docs: DataFrame, items: DataFrame) -> DataFrame:
    return overlaps(docs, items).select(F.col("id").alias("doc_id"), "n_words", _n_hit().alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
                                        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


ORACLE = """
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                         '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
s AS (SELECT item_id, w, least(len(w), 10) AS m, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS g FROM s),
ms AS (SELECT DISTINCT m FROM iw),
p AS (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, ms WHERE len(w) >= m),
dg AS (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS g FROM p),
hits AS (SELECT doc_id, i, m, item_id FROM dg JOIN iw USING (m, g)),
covered AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS x FROM hits) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(t, ',' ORDER BY t)) AS h
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS t FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(h, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered ON d.doc_id = covered.doc_id LEFT JOIN n ON d.doc_id = n.doc_id
"""
