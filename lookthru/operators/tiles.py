"""Joins whose groups are cut into bounded units.

``tiled``: all pairs of the members of a key are wanted (two schemes holding one company). If a
key has n members, joining on the key alone gives one task n*n/2 pairs. Here members
are hashed into blocks and each unordered pair of blocks is one join unit, so no unit
exceeds a fixed size, however hot the key; a key below the block size is one unit and
is not copied. Every pair of members meets in exactly one unit.

``fragmented``: one side of a join has very many rows of a key (the owners of one scheme), the
other few; the many are cut and the few copied.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

BLOCK_MEMBERS = 2000
FRAGMENT_ROWS = 100_000


def tiled(df: DataFrame, key: list[str], member: str, blocks: int | None = None) -> DataFrame:
    """Copy each row into every tile its block belongs to.

    ``blocks`` fixes the number of blocks for all keys; by default it follows the
    member count of each key, measured with a map-side combined aggregate.
    """
    if blocks:
        sized = df.withColumn("_n", F.lit(int(blocks)))
    else:
        counts = df.groupBy(*key).agg(
            F.ceil(F.count(F.lit(1)) / BLOCK_MEMBERS).cast("int").alias("_n"))
        sized = df.join(counts, key)
    placed = sized.withColumn("_b", F.pmod(F.xxhash64(member), F.col("_n")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("_n") - 1))
    return (placed.withColumn("_o", other)
            .withColumn("_lo", F.least("_b", "_o"))
            .withColumn("_hi", F.greatest("_b", "_o"))
            .drop("_n", "_o"))


def pair_condition(a: str, b: str, key: list[str], member_a: str, member_b: str) -> Column:
    """Join condition over two aliases of one tiled frame: each pair once, a before b."""
    same = [F.col(f"{a}.{k}") == F.col(f"{b}.{k}") for k in [*key, "_lo", "_hi"]]
    once = ((F.col(f"{a}._lo") == F.col(f"{a}._hi"))
            | (F.col(f"{a}._b") != F.col(f"{b}._b")))
    condition = once & (F.col(f"{a}.{member_a}") < F.col(f"{b}.{member_b}"))
    for c in same:
        condition = condition & c
    return condition


def fragmented(large: DataFrame, small: DataFrame, key: list[str], spread: str,
               rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Both sides of an inner join on ``key`` with one more join column, ``_f``, so that no join unit has many more
    than ``rows`` rows of ``large`` (by default ``FRAGMENT_ROWS``), however hot a key.

    The rows of a key are counted first (an aggregate that shrinks before its shuffle). Those of ``large`` are cut into
    fragments by a hash of ``spread``; those of ``small`` are copied to each fragment of their key. A key below the bound
    is one fragment and nothing is copied. Every pair still meets exactly once; keys that ``large`` does not have are
    dropped from ``small``, as the join would do.
    """
    counts = large.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / (rows or FRAGMENT_ROWS)).cast("int").alias("_n"))
    cut = large.join(counts, key).withColumn("_f", F.pmod(F.xxhash64(spread), F.col("_n")).cast("int")).drop("_n")
    copied = small.join(counts, key).withColumn("_f", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).drop("_n")
    return cut, copied


def spread_nulls(key: Column, *by: str) -> Column:
    """Text key for a left join in which rows without a key go to many tasks.

    A NULL key matches nothing but would send all its rows to one task; in its place
    stands a hash of other columns behind a character that no real key starts with.
    """
    return F.coalesce(key, F.concat(F.lit("\u0000"), F.xxhash64(*by).cast("string")))
