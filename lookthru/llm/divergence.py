"""Source divergence audit: how far the word use of each source of a language is from that of the others.

Each text becomes an exact sparse count vector. Vectors are summed by language and source, within a task first (the sum of a
group is all that leaves it), then over all. The vocabulary of a language holds every term of at least ``MIN_DF`` of its
documents, without a limit on its size; it is a table that the sums are joined with, never an array in the driver or
a broadcast, as its size grows with the data.

Shares are integers: p = 1 + floor(UNIT * (count + ADD) / (N + ADD * V)), the same for all V terms of a group, so
terms that a group lacks all have one share z. The distance of two groups over the whole vocabulary is
then taken from their sparse vectors: V * |z_a - z_b|, what each group's own terms add to it against the other's z, and a
correction for the terms that both have.

The own terms against z need no pairs of terms: with the shares of a group in order, running counts and sums give
the part below any z. Terms of both groups meet in a self join by term, cut into tiles where a term has very many sources.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from lookthru.llm.shared import stored
from lookthru.llm.text import LOWER, slices
from lookthru.operators.tiles import pair_condition, tiled

MIN_DF = 30
UNIT = 1_000_000_000
ADD = 5
TELLING = 50
HELD = 500_000      # entries of group sums that a task holds before it hands them on
_TERMS = bytes(LOWER[b] if 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b > 0x7F else 0x20 for b in range(256))


def document_vector(text: bytes | None) -> Counter[bytes]:
    """Counts of the terms of one text: runs of letters and characters beyond ASCII, A-Z lower-cased."""
    return Counter((text or b"").translate(_TERMS).split())


def group_sums(docs: DataFrame, text_column: str = "text", lang_column: str = "lang", source_column: str = "source") -> DataFrame:
    """(lang, source, term, n, df): occurrences of each term in each group, and the number of documents with it. Every group also has
    one row with an empty term, so that groups without terms are there."""
    names = ["lang", "source", "term", "n", "df"]

    def handed(sums: dict, files: dict) -> pa.RecordBatch:
        keys = [(*group, term) for group, found in sums.items() for term in found]
        langs, sources, terms = zip(*keys)
        return pa.RecordBatch.from_arrays([
            pa.array(langs, pa.string()), pa.array(sources, pa.string()), pa.array(terms, pa.binary()),
            pa.array([n for found in sums.values() for n in found.values()], pa.int64()),
            pa.array([files[group][term] for group, found in sums.items() for term in found], pa.int64())], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, files, held = defaultdict(Counter), defaultdict(Counter), 0
        for part in slices(batches, "text"):
            for lang, source, text in zip(*(part.column(c).to_pylist() for c in ("lang", "source", "text"))):
                vector, total = document_vector(text), sums[lang, source]
                before = len(total)
                total[b""] += 0
                total.update(vector)
                files[lang, source].update(vector.keys())
                held += len(total) - before
            if held > HELD:
                yield handed(sums, files)
                sums, files, held = defaultdict(Counter), defaultdict(Counter), 0
        if sums:
            yield handed(sums, files)

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    given = docs.select(text(lang_column).alias("lang"), text(source_column).alias("source"), text(text_column).cast("binary").alias("text"))
    return (given.mapInArrow(run, "lang string, source string, term binary, n bigint, df bigint")
            .withColumn("term", F.col("term").cast("string")).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df")))


class Audit(NamedTuple):
    groups: DataFrame       # lang, source, n_tokens (of kept terms), n_terms (of the language), z (share of a term the group lacks)
    vectors: DataFrame      # lang, source, term, n, p, z: the kept terms that a group has
    vocabulary: DataFrame   # lang, term, df, n, p: the kept terms of each language, p over all its documents


def _share(n: str, total: str, terms: str) -> Column:
    return F.expr(f"1 + ({UNIT}BD * ({n} + {ADD})) div ({total} + {ADD} * {terms})")


def audit(docs: DataFrame, text_column: str = "text", lang_column: str = "lang", source_column: str = "source",
          min_df: int = MIN_DF) -> Audit:
    """Vocabulary, groups and their sparse vectors. A null text, language or source is read as ''. Repeated rows count each time; an
    empty table gives empty tables. Other columns are not looked at."""
    sums = stored(group_sums(docs, text_column, lang_column, source_column))
    terms = sums.filter("term <> ''").groupBy("lang", "term").agg(F.sum("df").alias("df"), F.sum("n").alias("n")).filter(F.col("df") >= min_df)
    terms = stored(terms)
    langs = terms.groupBy("lang").agg(F.count("*").alias("n_terms"), F.sum("n").alias("all"))
    vocabulary = terms.join(langs, "lang").select("lang", "term", "df", "n", _share("n", "all", "n_terms").alias("p"))
    counts = stored(sums.join(terms.select("lang", "term"), ["lang", "term"]).select("lang", "source", "term", "n"))
    tokens = counts.groupBy("lang", "source").agg(F.sum("n").alias("n_tokens"))
    groups = (sums.filter("term = ''").select("lang", "source").join(tokens, ["lang", "source"], "left").join(langs.drop("all"), "lang", "left")
              .withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_tokens", "n_terms")})
              .withColumn("z", F.when(F.col("n_terms") > 0, _share("0", "n_tokens", "n_terms")).otherwise(0)))
    groups = stored(groups)
    vectors = stored(counts.join(groups, ["lang", "source"]).select("lang", "source", "term", "n", _share("n", "n_tokens", "n_terms").alias("p"), "z"))
    return Audit(groups, vectors, vocabulary)


def _apart(a: str, b: str) -> Column:
    return F.abs(F.col(a) - F.col(b))


def pair_distances(found: Audit) -> DataFrame:
    """(lang, a, b, value): the summed difference of the shares of all kept terms, for each two sources a < b of a language."""
    by = tiled(found.groups, ["lang"], "source")
    pairs = stored(by.alias("x").join(by.alias("y"), pair_condition("x", "y", ["lang"], "source", "source"))
                   .select(F.col("x.lang").alias("lang"), F.col("x.source").alias("a"), F.col("y.source").alias("b"),
                           F.col("x.z").alias("z_a"), F.col("y.z").alias("z_b"), F.col("x.n_terms").alias("n_terms")))
    # what the own terms of a group add against the share z of another group
    asked = pairs.select("lang", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("other"), F.col("z_a").alias("own"), F.col("z_b").alias("z")),
                                                   F.struct(F.col("b").alias("source"), F.col("a").alias("other"), F.col("z_b").alias("own"), F.col("z_a").alias("z")))).alias("s"))
    asked = asked.select("lang", "s.source", "s.other", "s.own", F.col("s.z").alias("at"), F.lit(0).cast("bigint").alias("m"))
    shares = found.vectors.groupBy("lang", "source", F.col("p").alias("at")).agg(F.count("*").alias("m"))
    line = asked.unionByName(shares, allowMissingColumns=True)
    whole = Window.partitionBy("lang", "source")
    below = whole.orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    m, s, own = F.col("m"), F.col("m") * F.col("at"), F.abs(F.col("own") - F.col("at"))
    # of equal shares and z it doesn't matter which comes first: they add zero
    added = F.sum(s).over(whole) - F.sum(m).over(whole) * F.col("at") + 2 * (F.sum(m).over(below) * F.col("at") - F.sum(s).over(below)) - F.sum(m).over(whole) * own
    alone = (line.withColumn("added", added).filter("other is not null")
             .groupBy("lang", F.least("source", "other").alias("a"), F.greatest("source", "other").alias("b")).agg(F.sum("added").alias("added")))
    cut = tiled(found.vectors, ["lang", "term"], "source")
    gap = _apart("x.p", "y.p") - _apart("x.p", "y.z") - _apart("x.z", "y.p") + _apart("x.z", "y.z")
    both = (cut.alias("x").join(cut.alias("y"), pair_condition("x", "y", ["lang", "term"], "source", "source"))
            .groupBy(F.col("x.lang").alias("lang"), F.col("x.source").alias("a"), F.col("y.source").alias("b")).agg(F.sum(gap).alias("gap")))
    return (pairs.join(alone, ["lang", "a", "b"], "left").join(both, ["lang", "a", "b"], "left")
            .select("lang", "a", "b", (F.col("n_terms") * _apart("z_a", "z_b") + F.coalesce("added", F.lit(0)) + F.coalesce("gap", F.lit(0))).alias("value")))


def telling_terms(found: Audit, top: int = TELLING) -> DataFrame:
    """(lang, source, term, value, rank): the terms that a source uses more than its language does, largest difference first."""
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "term")
    more = (found.vectors.join(found.vocabulary.select("lang", "term", F.col("p").alias("q")), ["lang", "term"])
            .filter("p > q").select("lang", "source", "term", (F.col("p") - F.col("q")).alias("value")))
    return more.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def op11_divergence(docs: DataFrame) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank."""
    found = audit(docs)
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pairs = (pair_distances(found).select("lang", "value", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")),
                                                                            F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("s"))
             .select("lang", "s.source", F.lit("pair").alias("part"), "s.item", "value").withColumn("rank", F.row_number().over(order)))
    return pairs.unionByName(telling_terms(found).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank"))


ORACLE = """
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
v AS (SELECT r, lang, source, t, count(*) AS n FROM (SELECT r, lang, source, unnest(w) AS t FROM d) GROUP BY ALL),
kept AS (SELECT lang, t, sum(n) AS n FROM v GROUP BY lang, t HAVING count(*) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT g.lang, g.source, kept.t, coalesce(s.n, 0) AS n FROM g JOIN kept USING (lang)
      LEFT JOIN (SELECT lang, source, t, sum(n) AS n FROM v GROUP BY ALL) s ON s.lang = g.lang AND s.source = g.source AND s.t = kept.t),
p AS (SELECT lang, source, t, n, 1 + (CAST(1000000000 AS HUGEINT) * (n + 5)) // (sum(n) OVER (PARTITION BY lang, source) + 5 * count(*) OVER (PARTITION BY lang, source)) AS p FROM c),
q AS (SELECT lang, t, 1 + (CAST(1000000000 AS HUGEINT) * (n + 5)) // (sum(n) OVER (PARTITION BY lang) + 5 * count(*) OVER (PARTITION BY lang)) AS q FROM kept),
pairs AS (SELECT lang, a.source, b.source AS item FROM g a JOIN g b USING (lang) WHERE a.source <> b.source),
dist AS (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.t = y.t AND x.source <> y.source GROUP BY ALL),
found AS (SELECT lang, source, 'pair' AS part, item, coalesce(value, 0) AS value FROM pairs LEFT JOIN dist USING (lang, source, item)
          UNION ALL SELECT lang, source, 'term', t, p - q FROM p JOIN q USING (lang, t) WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""
