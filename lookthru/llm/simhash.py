"""SimHash near duplicates by deletion-variant signatures.

A fingerprint of 64 bits is cut into two segments of 32. If two fingerprints differ in at most two bits,
one of their segments differs in at most one. Each distinct segment value is indexed under its 32
one-wildcard variants; values that meet under a variant differ in exactly the wildcard bit, so a variant
never holds more than two values however often they occur. Fingerprints of equal or met values are then
compared in full.

A value shared by many different fingerprints would still give all their pairs. Where both values of a
pair hold over ``crowd`` fingerprints, those fingerprints meet instead under the 65 variants of the whole
fingerprint with one bit or none changed: two within two bits always share one, a variant holds at
most 65 fingerprints, and each is tied to the smallest. No link is lost on either way.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from lookthru.llm.shared import components, spare, stored
from lookthru.llm.text import LOWER, slices

SHINGLE = 3
BITS = 2
CROWD = 64
_LANES = np.uint64(0x0101010101010101)


def bit_majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each run of ``counts`` hashes, the bits set in over half of them; an empty run gives zero.

    Eight bits at a time are summed in the eight bytes of a word, over blocks of at most 255."""
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    sizes = counts[full]
    blocks = -(-sizes // 255)
    first = np.cumsum(blocks) - blocks
    starts = np.repeat(np.cumsum(sizes) - sizes, blocks) + 255 * (np.arange(blocks.sum()) - np.repeat(first, blocks))
    result = np.zeros(len(full), np.uint64)
    for shift in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(shift)) & _LANES, starts)
        sums = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
        for byte in range(8):
            result |= (2 * sums[:, byte] > sizes).astype(np.uint64) << np.uint64(8 * byte + shift)
    out[full] = result
    return out


def _shingle_hashes(text: str | None, width: int) -> list[int]:
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return []
    if len(words) < width:
        return [xxhash.xxh64_intdigest(b" ".join(words), 42)]
    return list(map(xxhash.xxh64_intdigest, map(b" ".join, zip(*(words[i:] for i in range(width)))), repeat(42)))


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = SHINGLE) -> DataFrame:
    """(id, tkey, fp): the fingerprint of each row, and a hash of its text that tells rows of one id apart."""
    kind = docs.schema[id_column].dataType

    def run(batches):
        for part in slices(batches, "text"):
            hashes, counts = [], []
            for text in part.column("text").to_pylist():
                got = _shingle_hashes(text, width)
                hashes += got
                counts.append(len(got))
            fp = bit_majority(np.array(hashes, np.uint64), np.array(counts, np.int64))
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("tkey"), pa.array(fp.view(np.int64))],
                                             ["id", "tkey", "fp"])

    given = docs.select(F.col(id_column).alias("id"), F.xxhash64(F.col(text_column)).alias("tkey"), F.col(text_column).alias("text"))
    return given.mapInArrow(run, f"id {kind.simpleString()}, tkey bigint, fp bigint")


def _segment(fp: Column, s: int) -> Column:
    return fp.bitwiseAND(F.lit(0xFFFFFFFF)) if s == 0 else F.shiftrightunsigned(fp, 32)


def _close(a: Column, b: Column, bits: int) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= bits


def _met(values: DataFrame) -> DataFrame:
    """(s, v0, v1, n0, n1): values of ``values`` (s, v, n) that differ in one bit.

    Spark sizes a table behind ``explode`` as the one before it and would broadcast 16 variants of every value where
    the values alone are small, so the join is named."""
    def variants(bit: int) -> DataFrame:
        places = F.filter(F.sequence(F.lit(0), F.lit(31)),
                          lambda p: F.call_function("getbit", F.col("v"), p) == bit)
        return (values.select("s", "v", "n", F.explode(places).alias("p"))
                .select("s", "p", F.expr(f"v ^ shiftleft({bit}L, p)").alias("rest"),
                        F.col("v").alias(f"v{bit}"), F.col("n").alias(f"n{bit}")))

    return variants(0).hint("merge").join(variants(1), ["s", "p", "rest"]).select("s", "v0", "v1", "n0", "n1")


def links(prints: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(a, b): links between the distinct fingerprints of ``prints`` (column fp) whose components are those of all
    pairs within two bits."""
    members = stored(prints.select("fp", F.explode(F.array(*(
        F.struct(F.lit(s).alias("s"), _segment(F.col("fp"), s).alias("v")) for s in (0, 1)))).alias("m"))
        .select("fp", "m.s", "m.v"))
    values = stored(members.groupBy("s", "v").agg(F.count("*").alias("n")))
    met = _met(values)
    same = values.filter("n > 1").select("s", F.col("v").alias("v0"), F.col("v").alias("v1"),
                                         F.col("n").alias("n0"), F.col("n").alias("n1"))
    met = stored(met.unionByName(same))
    crowded = (F.col("n0") > crowd) & (F.col("n1") > crowd)
    few = (met.filter(~crowded)
           .join(members.select("s", F.col("v").alias("v0"), F.col("fp").alias("a")), ["s", "v0"])
           .join(members.select("s", F.col("v").alias("v1"), F.col("fp").alias("b")), ["s", "v1"])
           .filter((F.col("a") != F.col("b")) & _close(F.col("a"), F.col("b"), BITS))
           .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    heavy = met.filter(crowded)
    heavy = heavy.select("s", F.explode(F.array("v0", "v1")).alias("v")).distinct()
    near = F.concat(F.array("fp"), F.transform(F.sequence(F.lit(0), F.lit(63)),
                                               lambda p: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), p))))
    star = (members.join(heavy, ["s", "v"], "left_semi").select("fp").distinct()
            .select("fp", F.explode(near).alias("key"))
            .select("fp", F.min("fp").over(Window.partitionBy("key")).alias("low"))
            .filter("low <> fp").select(F.col("low").alias("a"), F.col("fp").alias("b")).distinct())
    return few.unionByName(star)


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, tkey, fp, label, component): one row per row of ``docs``; component is the smallest id reachable over links
    of at most two differing bits, the row itself included; label is the smallest fingerprint of the component.

    A null or empty text has fingerprint zero and is linked like any other. Repeated rows each give a row. A null id is
    never the smallest unless all ids of its component are null. An empty table gives an empty table.
    """
    prints = stored(fingerprints(docs, id_column, text_column))
    distinct = stored(prints.groupBy("fp").agg(F.min("id").alias("least")))
    tied = components(links(distinct.select("fp")), "a", "b")
    labelled = stored(distinct.join(tied.withColumnRenamed("node", "fp"), "fp", "left"))
    labelled = labelled.withColumn("label", F.coalesce("component", "fp"))
    lows = labelled.filter("component is not null").groupBy("label").agg(F.min("least").alias("low"))
    found = (labelled.join(lows, "label", "left")
             .select("fp", "label", F.coalesce("low", "least").alias("component")))
    return prints.join(found, "fp").select("id", "tkey", "fp", "label", "component")


def keep_one(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` with one row left of each component: that of the smallest id (nulls last), then of the
    smallest text hash. Columns stay as they are."""
    found = near_duplicates(docs, id_column, text_column)
    rank = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("tkey").alias("tkey"))
    mine, key = spare(docs, "text_hash"), spare(docs, "kept_id")
    kept = (found.groupBy("label").agg(F.min(rank).alias("r"))
            .select(F.col("r.id").alias(key), F.col("r.tkey").alias(mine + "_")))
    rows = docs.withColumn(mine, F.xxhash64(F.col(text_column)))
    joined = rows.join(kept, F.col(id_column).eqNullSafe(F.col(key)) & (F.col(mine) == F.col(mine + "_")), "left_semi")
    return joined.dropDuplicates([id_column, mine]).drop(mine)


def op6_simhash(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id."""
    return near_duplicates(docs).select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                                        F.col("component").alias("component_id"))
