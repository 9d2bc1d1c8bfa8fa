"""Importance resampling of documents towards a target distribution.

Texts are bags of hashed one- and two-word features. The gain of a bucket is the log ratio of its share in the target
and in the documents; the weight of a document is the mean gain of its features, and the documents of the highest weight
plus a Gumbel draw of their id are kept: a sample without replacement in proportion to the exponentiated weights.

Features are hashed by CRC-32 with numpy: the distinct features of a slice of texts are grouped by their length in bytes,
each group is a matrix of bytes, and the checksums of a whole group advance by one column at a time. The
buckets are then scattered back to the places where the features stand.

Two passes over the documents: bucket counts (at most ``BUCKETS`` rows per task), then weights. Only the counts
of the buckets reach the driver, a fixed number of integers. Ranks come from a range partitioning by score: the place
within a sorted partition plus the sizes of those before it, so no task sees more than its range.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from lookthru.llm.shared import spare, stored
from lookthru.llm.text import LOWER, NOT_WORD, Words, slices

BUCKETS = 10_000
SEED = 7
LEAST_WORDS = 20
SHARE = 25          # of a hundred documents with enough words
SLICE_BYTES = 2 << 20
LONG = 1024         # longer features, of which a slice has few, are hashed one by one
_BLANKS = bytes(0x20 if NOT_WORD[b] else LOWER[b] for b in range(256))


def _crc_table() -> np.ndarray:
    crc = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        crc = np.where(crc & 1, (crc >> 1) ^ np.uint32(0xEDB88320), crc >> 1).astype(np.uint32)
    return crc


_TABLE = _crc_table()


def crc32s(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRC-32 of each part ``data[start:start + size]``, length by length."""
    out = np.zeros(len(starts), np.uint32)
    order = np.argsort(sizes, kind="stable")
    cuts = [*np.flatnonzero(np.diff(sizes[order], prepend=-1)).tolist(), len(order)]
    for a, b in zip(cuts, cuts[1:]):
        rows = order[a:b]
        size = int(sizes[rows[0]])
        if size > LONG:
            out[rows] = [zlib.crc32(data[s:s + size]) for s in starts[rows].tolist()]
            continue
        matrix = data[np.arange(size)[:, None] + starts[rows]]  # one line per column of the group
        crc = np.full(len(rows), 0xFFFFFFFF, np.uint32)
        for column in matrix:
            crc = _TABLE[(crc ^ column) & np.uint32(0xFF)] ^ (crc >> np.uint32(8))
        out[rows] = ~crc
    return out


def feature_buckets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words of each text, bucket of each feature, text of each feature): single words first, then pairs."""
    words = Words(texts, NOT_WORD, lower=True)
    n, doc = len(words), words.doc()
    if not n:
        return words.counts, np.zeros(0, np.int64), np.zeros(0, np.int64)
    listed = words.raw.translate(_BLANKS).split()
    sizes = words.ends - words.starts
    ends = np.cumsum(sizes)
    codes = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(np.concatenate(([0], ends)).astype(np.int64)),
                                                         pa.py_buffer(b"".join(listed))]).dictionary_encode().indices.to_numpy()
    data = np.frombuffer(b" ".join(listed), np.uint8)
    starts = ends - sizes + np.arange(n)
    _, first, word = np.unique(codes, return_index=True, return_inverse=True)
    left = np.flatnonzero(doc[:-1] == doc[1:])
    _, pair_first, pair = np.unique(codes[left].astype(np.int64) * n + codes[left + 1], return_index=True, return_inverse=True)
    at = left[pair_first]
    crcs = crc32s(data, np.concatenate((starts[first], starts[at])), np.concatenate((sizes[first], starts[at + 1] + sizes[at + 1] - starts[at])))
    bucket = (crcs % np.uint32(BUCKETS)).astype(np.int64)
    return words.counts, np.concatenate((bucket[word], bucket[len(first) + pair])), np.concatenate((doc, doc[left]))


def bucket_counts(rows: DataFrame, text_column: str = "text") -> DataFrame:
    """(bucket, n): how often the features of all texts fall into each bucket; buckets without any are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for part in slices(batches, "text", SLICE_BYTES):
            total += np.bincount(feature_buckets(part.column("text"))[1], minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    return (rows.select(F.col(text_column).alias("text")).mapInArrow(run, "bucket bigint, n bigint")
            .groupBy("bucket").agg(F.sum("n").alias("n")))


def gains(source: DataFrame, target: DataFrame) -> np.ndarray:
    """The gain of every bucket in thousandths, from two tables of ``bucket_counts``."""
    counts = []
    for table in (source, target):
        n = [0] * BUCKETS
        for bucket, count in table.collect():  # at most BUCKETS rows
            n[bucket] = count
        counts.append(n)
    s_all, t_all = (float(sum(n) + BUCKETS) for n in counts)
    return np.array([math.floor(1000 * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all))) for s, t in zip(*counts)], np.int64)


def weights(docs: DataFrame, gain: np.ndarray, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, tkey, n_words, n_features, weight) of every row of ``docs``; tkey is a hash of the text."""
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SLICE_BYTES):
            n_words, bucket, doc = feature_buckets(part.column("text"))
            n = np.bincount(doc, minlength=len(n_words))
            total = np.zeros(len(n_words), np.int64)
            np.add.at(total, doc, gain[bucket])
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("tkey"), pa.array(n_words.astype(np.int64)), pa.array(n),
                                              pa.array(total // np.maximum(n, 1))], ["id", "tkey", "n_words", "n_features", "weight"])

    given = docs.select(F.col(id_column).alias("id"), F.xxhash64(text_column).alias("tkey"), F.col(text_column).alias("text"))
    return given.mapInArrow(run, f"id {kind}, tkey bigint, n_words bigint, n_features bigint, weight bigint")


def _gumbel(id_: Column, seed: int) -> Column:
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, id_column: str = "doc_id", text_column: str = "text", target_text: str = "text",
             share: int = SHARE, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """One row per row of ``docs``: id, tkey, n_words, n_features, weight, score, rank.

    Of the N rows with at least ``least_words`` words, the floor(share * N / 100) highest scores are drawn and ranked from 1,
    ties by id (a null id first); the others have a null rank. Words are runs of letters, digits and
    characters beyond ASCII, A-Z lower-cased. Null and empty texts have no words, no features and weight 0. A
    null id draws as an empty one. Repeated rows each give a row, with ranks next to each other. Without target texts every target
    count is 0; an empty table gives an empty table. Other columns of ``docs`` are not looked at.
    """
    gain = gains(bucket_counts(docs, text_column), bucket_counts(target, target_text))
    scored = weights(docs, gain, id_column, text_column).withColumn("score", F.col("weight") + _gumbel(F.col("id"), seed))
    enough = F.col("n_words") >= least_words
    order = [F.col("score").desc(), F.col("id").asc(), F.col("weight"), F.col("n_features"), F.col("tkey")]
    scored = stored(scored)
    placed = stored(scored.filter(enough).repartitionByRange(*order).sortWithinPartitions(*order)
                    .withColumn("place", F.monotonically_increasing_id()))
    part = F.shiftright("place", 33)
    sizes = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"))  # a row per partition
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"),
                          F.sum("n").over(Window.partitionBy()).alias("all"))
    rank = F.col("before") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    ranked = (placed.withColumn("part", part).join(before, "part")
              .withColumn("rank", F.when(rank <= F.expr(f"all * {share} div 100"), rank)).select(*scored.columns, "rank"))
    return ranked.unionByName(scored.filter(~enough).withColumn("rank", F.lit(None).cast("bigint")))


def keep_drawn(docs: DataFrame, target: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """The drawn rows of ``docs`` with their columns. Rows that repeat an id and a text stay or go together."""
    mine, key = spare(docs, "text_hash"), spare(docs, "drawn_id")
    drawn = resample(docs, target, id_column, text_column, **options).filter("rank is not null")
    drawn = drawn.select(F.col("id").alias(key), F.col("tkey").alias(mine + "_"))
    return (docs.withColumn(mine, F.xxhash64(text_column))
            .join(drawn, F.col(id_column).eqNullSafe(F.col(key)) & (F.col(mine) == F.col(mine + "_")), "left_semi").drop(mine))


def op12_resampling(docs: DataFrame, target: DataFrame) -> DataFrame:
    return resample(docs, target).select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


ORACLE = """
WITH RECURSIVE step AS (SELECT CAST(b AS BIGINT) AS b, list_reduce(list_prepend(CAST(b AS BIGINT), CAST(range(8) AS BIGINT[])),
        lambda c, i: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)) AS v FROM range(256) t(b)),
words AS (SELECT 1 AS side, row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
    UNION ALL SELECT 2, row_number() OVER (), NULL, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') FROM benchmark),
feats AS MATERIALIZED (SELECT side, r, f, count(*) AS n FROM (
    SELECT side, r, unnest(w) AS f FROM words
    UNION ALL SELECT side, r, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM words) GROUP BY ALL),
crc(f, h, i, c) AS (SELECT f, hex(encode(f)), 0, 4294967295 FROM (SELECT DISTINCT f FROM feats)
    UNION ALL SELECT f, h, i + 1, xor(c >> 8, v) FROM crc JOIN step
        ON b = xor(c & 255, CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT)) WHERE 2 * i < len(h)),
bucket AS MATERIALIZED (SELECT f, xor(c, 4294967295) % 10000 AS k FROM crc WHERE 2 * i = len(h)),
held AS (SELECT k, sum(CASE WHEN side = 1 THEN n ELSE 0 END) AS s, sum(CASE WHEN side = 2 THEN n ELSE 0 END) AS t FROM feats JOIN bucket USING (f) GROUP BY k),
gain AS (SELECT k, CAST(floor(1000 * ln(CAST(t + 1 AS DOUBLE) * CAST((SELECT sum(s) FROM held) + 10000 AS DOUBLE)
    / (CAST(s + 1 AS DOUBLE) * CAST((SELECT sum(t) FROM held) + 10000 AS DOUBLE)))) AS BIGINT) AS g FROM held),
weight AS (SELECT r, sum(n) AS n, CAST(floor(sum(n * g) / sum(n)) AS BIGINT) AS weight FROM feats JOIN bucket USING (f) JOIN gain USING (k) WHERE side = 1 GROUP BY r),
score AS (SELECT doc_id, len(w) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0)
    + CAST(floor(-1000 * ln(-ln((CAST('0x' || sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), ''))[1:8] AS BIGINT) + 0.5) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score
    FROM words LEFT JOIN weight USING (r) WHERE side = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place FROM score)
SELECT doc_id, n_features, weight, score,
       CASE WHEN n_words >= 20 AND place <= (SELECT count(*) FROM score WHERE n_words >= 20) * 25 // 100 THEN place END AS rank FROM ranked
"""
