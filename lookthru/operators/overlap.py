"""Pairwise overlap of schemes: sum over companies of the smaller weight."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from ..schemas import EXACT

MICRO = 1_000_000
BLOCK_ROWS = 50_000          # rows of a block of schemes
UNIT_PAIRS = 20_000_000      # pairs of rows that two blocks give
STRIP_PAIRS = 1 << 21        # of these, at a time
OUT_ROWS = 1 << 16


def resolved_equity(holdings: DataFrame) -> DataFrame:
    return holdings.filter((F.col("asset_class") == "equity") & F.col("company_id").isNotNull())


def in_month(holdings: DataFrame, month: dt.date | None = None) -> DataFrame:
    """Rows of one month; by default the latest one of these rows.

    The latest month is a scalar subquery, so nothing is collected and a table
    partitioned by month is still pruned when the job runs.
    """
    if month is None:
        latest = holdings.select(F.max("disclosure_month")).scalar()
    else:
        latest = F.lit(month)
    return holdings.filter(F.col("disclosure_month") == latest)


def latest_holdings(holdings: DataFrame, month: dt.date | None = None) -> DataFrame:
    return in_month(resolved_equity(holdings), month)


def exact_weight(col: str | Column = "weight_pct") -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return c.cast(EXACT)


def scheme_company_weights(equity: DataFrame, *more_keys: str) -> DataFrame:
    """One row per scheme and company, weight as an exact count of millionths."""
    return (equity.filter(F.col("weight_pct").isNotNull())
            .groupBy("company_id", "scheme_code", *more_keys)
            .agg((F.sum(exact_weight()) * MICRO).cast("bigint").alias("w")))


def _holders(weights: DataFrame, by: list[str], salt: int) -> DataFrame:
    """Each row with its scheme's block and the blocks that hold its company (``_with``), its own among them.

    The blocks of a ``by`` group follow its rows and the pairs its companies give, so that two blocks together are a
    bounded piece of work. A company of one scheme gives no pair; its rows are dropped.
    """
    key = [*by, "company_id"]
    if salt:
        placed = weights.withColumn("_n", F.lit(int(salt)))
    else:
        held = weights.groupBy(*key).agg(F.count(F.lit(1)).alias("_c"))
        pieces = F.greatest(F.ceil(F.sum("_c") / BLOCK_ROWS), F.ceil(F.sqrt(F.sum(F.col("_c").cast("double") * F.col("_c")) / UNIT_PAIRS)))
        sizes = held.groupBy(*by).agg(pieces.cast("int").alias("_n"))
        placed = weights.join(sizes, by) if by else weights.withColumn("_n", sizes.scalar())
    placed = placed.withColumn("_b", F.pmod(F.xxhash64("scheme_code"), F.col("_n")).cast("int")).drop("_n")
    with_blocks = placed.groupBy(*key).agg(F.count(F.lit(1)).alias("_c"), F.sort_array(F.collect_set("_b")).alias("_with"))
    return placed.join(with_blocks.filter("_c > 1").drop("_c"), key)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))


def unit_pairs(scheme: np.ndarray, company: np.ndarray, w: np.ndarray, left: np.ndarray, right: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(s, t, sum of the smaller weights) of the pairs of a left and a right scheme that share a company; with one block on
    both sides each pair once. Schemes and companies are numbers; at most about ``STRIP_PAIRS`` rows are paired at a time."""
    same = bool((left & right).any())
    own, other = np.flatnonzero(left), np.flatnonzero(right)
    own, other = own[np.argsort(scheme[own], kind="stable")], other[np.argsort(company[other], kind="stable")]
    first = np.searchsorted(company[other], company[own], side="left")
    size = np.searchsorted(company[other], company[own], side="right") - first
    strip = (np.cumsum(size) - size) // STRIP_PAIRS
    cuts = np.flatnonzero(np.diff(strip)) + 1
    start = np.flatnonzero(np.append(True, np.diff(scheme[own]) != 0)) if len(own) else cuts
    cuts = np.unique(start[np.searchsorted(start, cuts, side="right") - 1]) if len(cuts) else cuts  # a scheme stays whole
    wide = int(scheme.max()) + 1 if len(scheme) else 0
    for p, q in zip(np.append(0, cuts), np.append(cuts, len(own))):
        a, b = np.repeat(own[p:q], size[p:q]), other[_ranges(first[p:q], size[p:q])]
        if same:
            once = scheme[a] < scheme[b]
            a, b = a[once], b[once]
        if not len(a):
            continue
        key, least = scheme[a].astype(np.int64) * wide + scheme[b], np.minimum(w[a], w[b])
        order = np.argsort(key)
        key = key[order]
        head = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        s, t = np.divmod(key[head], wide)
        yield np.minimum(s, t), np.maximum(s, t), np.add.reduceat(least[order], head)


def _every_pair(scheme: np.ndarray, company: np.ndarray, w: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The same for every pair of a low and a high scheme, 0 where they share nothing. Each scheme has a row of company -1."""
    held, same = company >= 0, bool((low & high).any())
    across, down = np.unique(scheme[high & ~held]), np.unique(scheme[low & ~held])
    column = np.zeros(int(scheme.max()) + 1, np.int64)
    column[across] = np.arange(len(across))
    lines = max(1, STRIP_PAIRS // max(1, len(across)))
    for at in range(0, len(down), lines):
        strip = down[at:at + lines]
        line = np.full(len(column), -1)
        line[strip] = np.arange(len(strip))
        total = np.zeros((len(strip), len(across)), np.int64)
        for s, t, least in unit_pairs(scheme, company, w, low & held & (line[scheme] >= 0), high & held):
            x, y = (s, t) if same else (np.where(line[s] >= 0, s, t), np.where(line[s] >= 0, t, s))
            total[line[x], column[y]] = least
        i, j = np.nonzero(strip[:, None] < across) if same else np.divmod(np.arange(total.size), len(across))
        s, t = strip[i], across[j]
        yield np.minimum(s, t), np.maximum(s, t), total[i, j]


def _summed(rows: DataFrame, by: list[str], pairs: Callable[..., Iterator[tuple[np.ndarray, ...]]]) -> DataFrame:
    """(by, s1, s2, overlap_pct) of the pairs of every two blocks. Rows go to each unit of their block ``_b`` with one of the
    blocks ``_with``, so the sum of a pair is made where its parts are: pairs are never shuffled."""
    other = F.col("_o")
    unit = rows.select(*by, "company_id", "scheme_code", "w", "_b", F.explode("_with").alias("_o")).select(
        *by, F.least("_b", other).alias("_lo"), F.greatest("_b", other).alias("_hi"), "_b", "company_id", "scheme_code", "w")
    out = ", ".join([*(f"{c} {rows.schema[c].dataType.simpleString()}" for c in by), "s1 string, s2 string, overlap_pct double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches)
        names = t["scheme_code"].combine_chunks().dictionary_encode()
        order = pc.sort_indices(names.dictionary)
        text, rank = names.dictionary.take(order), np.empty(len(order), np.int64)
        rank[order.to_numpy()] = np.arange(len(order))
        company = pc.fill_null(t["company_id"].combine_chunks().dictionary_encode().indices, -1).to_numpy()
        block, low, high = t["_b"].to_numpy(), t["_lo"][0].as_py(), t["_hi"][0].as_py()
        w = pc.fill_null(t["w"], 0).to_numpy()
        for s1, s2, total in pairs(rank[names.indices.to_numpy()], company, w, block == low, block == high):
            for at in range(0, len(s1), OUT_ROWS):
                part = slice(at, at + OUT_ROWS)
                same = [pa.repeat(t[c][0], len(s1[part])) for c in by]
                yield pa.RecordBatch.from_arrays([*same, text.take(pa.array(s1[part])), text.take(pa.array(s2[part])),
                                                  pa.array(total[part] / float(MICRO))], [*by, "s1", "s2", "overlap_pct"])

    return unit.groupBy(*by, "_lo", "_hi").applyInArrow(run, out)


def _pairs(weights: DataFrame, by: list[str], salt: int) -> DataFrame:
    return _summed(_holders(weights.filter(F.col("scheme_code").isNotNull()), by, salt), by, unit_pairs)


def overlap_pairs(holdings: DataFrame, month: dt.date | None = None, salt: int = 0) -> DataFrame:
    """Overlapping pairs ``s1 < s2`` of one month with their unrounded overlap.

    Rows are first reduced to one per (company, scheme). ``salt`` fixes the number of
    blocks the schemes are dealt into; by default it follows the rows and pairs of the month.
    Sums run on integers, so the result does not depend on the plan.
    """
    return _pairs(scheme_company_weights(latest_holdings(holdings, month)), [], salt)


def overlap_history(holdings: DataFrame, salt: int = 0) -> DataFrame:
    """The same for every month of the history, in one job."""
    weights = scheme_company_weights(resolved_equity(holdings), "disclosure_month")
    return _pairs(weights, ["disclosure_month"], salt)


def _rounded(col: str) -> Column:
    return F.round(F.col(col).cast(EXACT), 2).cast("double")


def overlap_full(holdings: DataFrame, schemes: DataFrame, month: dt.date | None = None) -> DataFrame:
    """Every ordered pair of the given schemes: 100 on the diagonal, 0 where disjoint.

    The result has the square of the scheme count by definition. It is made block by block from the rows of two blocks
    of schemes, a bounded strip at a time; only those rows are shuffled. ``overlap_pairs`` is the form for large scheme sets.
    """
    codes = schemes.select("scheme_code").distinct()
    weights = scheme_company_weights(latest_holdings(holdings, month)).join(codes, "scheme_code", "left_semi")
    members = codes.filter(F.col("scheme_code").isNotNull()).select(F.lit(None).cast("string").alias("company_id"), "scheme_code", F.lit(None).cast("bigint").alias("w"))
    n = members.select(F.ceil(F.count(F.lit(1)) / F.sqrt(F.lit(UNIT_PAIRS))).cast("int").alias("_n"))
    rows = (weights.unionByName(members).withColumn("_n", n.scalar())
            .withColumn("_b", F.pmod(F.xxhash64("scheme_code"), F.col("_n")).cast("int"))
            .withColumn("_with", F.sequence(F.lit(0), F.col("_n") - 1)))
    filled = _summed(rows, [], _every_pair).withColumn("overlap_pct", _rounded("overlap_pct"))
    both = filled.select(F.explode(F.array(
        F.struct(F.col("s1").alias("scheme_a"), F.col("s2").alias("scheme_b"), "overlap_pct"),
        F.struct(F.col("s2").alias("scheme_a"), F.col("s1").alias("scheme_b"), "overlap_pct"),
    )).alias("p")).select("p.*")
    diagonal = codes.select(F.col("scheme_code").alias("scheme_a"),
                            F.col("scheme_code").alias("scheme_b"),
                            F.lit(100.0).alias("overlap_pct"))
    return both.unionByName(diagonal)
