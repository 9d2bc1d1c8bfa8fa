"""Quality rules: robust multivariate outliers by minimum covariance determinant (MCD), per language and source.

Every text gives four transformed statistics: mean word length, share of symbols, share of repeated lines and
share of words in repeated passages, as logs of ratios with a few pseudo words and a usual share added, so that
neither short texts nor texts without any symbol or repeat are outliers by chance. Per language and source the location and scatter of
the half of the rows with the smallest determinant are found by concentration steps from two deterministic starts,
then reweighted. A text is rejected where its Mahalanobis distance exceeds a chi-square quantile.

A concentration step is one grouped aggregate over all rows: rows are counted and their moments summed per
distance bin, and the step's half is the smallest whole number of bins that holds it. So no group, however
large, is sampled, sorted or brought to one task; a task of the per-group part sees some hundred bins.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lookthru.llm.shared import spare, stored
from lookthru.llm.text import WHITE, Words, grams, mix, slices

D = 4
LEAST_ROWS = 200      # groups with fewer rows are pooled, first over the language, then over all
STEPS = 5             # concentration steps after the start
OCTAVE = 8            # distance bins per doubling of the squared distance
TAIL = 1e-9           # chance that a row of an exactly normal group is rejected
PSEUDO_WORDS = 50
USUAL = (0.01, 0.15, 0.08)           # shares of symbols, repeated lines and repeated words that are nothing special
FLOORS = (0.05, 0.25, 0.2, 0.2)      # statistics are not held more precisely than this; each alone can still pass the cut of TAIL
_SYMBOL = bytes(1 if b in b"#*$%&|<>" else 0 for b in range(256))
_LETTER = bytes(0 if WHITE[b] or b & 0xC0 == 0x80 else 1 for b in range(256))
STATS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def _per_text(words: Words, table: bytes) -> np.ndarray:
    marks = np.frombuffer(words.raw.translate(table), np.uint8)
    return np.add.reduceat(marks, words.offsets[:-1], dtype=np.int64)


def _repeat_words(words: Words) -> np.ndarray:
    """Per text, the words that lie in a window of three that occurs twice or more in it."""
    n = len(words.counts)
    doc = words.doc()
    inside = np.flatnonzero(doc[2:] == doc[:-2]) if len(doc) > 2 else np.zeros(0, np.int64)
    if not len(inside):
        return np.zeros(n, np.int64)
    keys = mix(grams(words.hashes(), 3)[inside] + mix(doc[inside].astype(np.uint64)))
    order = np.sort(keys)
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    if not len(twice):
        return np.zeros(n, np.int64)
    at = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
    inside = inside[twice[at] == keys]  # by hash; now by the words themselves
    three = [words.raw[words.starts[i]:words.ends[i]] + b" " + words.raw[words.starts[i + 1]:words.ends[i + 1]]
             + b" " + words.raw[words.starts[i + 2]:words.ends[i + 2]] for i in inside.tolist()]
    keys = list(zip(doc[inside].tolist(), three))
    seen = Counter(keys)
    groups = np.array([seen[k] for k in keys])
    marked = np.zeros(len(doc), bool)
    for k in range(3):
        marked[inside[groups > 1] + k] = True
    return np.bincount(doc[marked], minlength=n)


def text_stats(texts: pa.Array) -> dict[str, np.ndarray]:
    words = Words(texts, WHITE)
    lines, repeated = [], []
    for text in texts.to_pylist():
        own = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        lines.append(len(own))
        repeated.append(len(own) - len(set(own)))
    return {"n_words": words.counts.astype(np.int64), "word_chars": _per_text(words, _LETTER),
            "n_symbols": _per_text(words, _SYMBOL), "n_lines": np.array(lines, np.int64),
            "n_dup_lines": np.array(repeated, np.int64), "n_repeat_words": _repeat_words(words).astype(np.int64)}


def _statistics(docs: DataFrame, id_column: str, text_column: str, lang: str, source: str) -> DataFrame:
    def run(batches):
        for part in slices(batches, "text"):
            got = text_stats(part.column("text"))
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in ("id", "tkey", "lang", "source")), *(pa.array(got[c]) for c in STATS)],
                ["id", "tkey", "lang", "source", *STATS])

    kind = docs.schema[id_column].dataType.simpleString()
    given = docs.select(F.col(id_column).alias("id"), F.xxhash64(text_column).alias("tkey"),
                        F.col(lang).cast("string").alias("lang"), F.col(source).cast("string").alias("source"),
                        F.col(text_column).alias("text"))
    return given.mapInArrow(run, f"id {kind}, tkey bigint, lang string, source string, "
                            + ", ".join(f"{c} bigint" for c in STATS))


def _vector() -> list[Column]:
    words = F.col("n_words") + F.lit(float(PSEUDO_WORDS))
    shares = (F.col("n_symbols") / words, F.col("n_dup_lines") / (F.col("n_lines") + F.lit(10.0)), F.col("n_repeat_words") / words)
    return [F.log((F.col("word_chars") + F.lit(5.0 * PSEUDO_WORDS)) / words),
            *(F.log(x + F.lit(y)) for x, y in zip(shares, USUAL))]


def _chi2(q: float, dof: int) -> float:
    """Distribution function of chi-square with an even number of degrees of freedom."""
    return 1 - math.exp(-q / 2) * sum((q / 2) ** i / math.factorial(i) for i in range(dof // 2))


def quantile(p: float, dof: int = D) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if _chi2(mid, dof) < p else (low, mid)
    return low


def _factor(p: float) -> float:
    """Makes the scatter of the inner share p right for normal rows."""
    return p / _chi2(quantile(p), D + 2)


_XS = [f"x{i}" for i in range(D)]
_PAIRS = [(i, j) for i in range(D) for j in range(i, D)]
_ESTIMATE = "g string, start int, mean array<double>, inverse array<double>, logdet double"


def _estimate(g: str, start: int, mean: np.ndarray, scatter: np.ndarray) -> pd.DataFrame:
    scatter = scatter + np.diag(np.square(FLOORS))
    return pd.DataFrame({"g": [g], "start": [start], "mean": [mean.tolist()],
                         "inverse": [np.linalg.inv(scatter).ravel().tolist()], "logdet": [float(np.linalg.slogdet(scatter)[1])]})


def _moments() -> list[Column]:
    return [F.count("*").alias("n"), *(F.sum(x).alias(f"s{i}") for i, x in enumerate(_XS)),
            *(F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s{i}{j}") for i, j in _PAIRS)]


def _located(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    n = part["n"].sum()
    mean = np.array([part[f"s{i}"].sum() / n for i in range(D)])
    scatter = np.zeros((D, D))
    for i, j in _PAIRS:
        scatter[i, j] = scatter[j, i] = part[f"s{i}{j}"].sum() / n - mean[i] * mean[j]
    return mean, scatter


def _distance() -> Column:
    """Squared Mahalanobis distance of x0.. from mean and inverse."""
    d = [F.col(x) - F.col("mean")[i] for i, x in enumerate(_XS)]
    total = F.lit(0.0)
    for i in range(D):
        for j in range(D):
            total = total + d[i] * d[j] * F.col("inverse")[i * D + j]
    return total


def _concentrate(rows: DataFrame, estimates: DataFrame, share: float | None) -> DataFrame:
    """New estimates from the rows nearest to the old ones: the inner ``share`` of each group, or, if None, those within
    the 97.5 % quantile."""
    inner = quantile(0.975)
    bins = (rows.join(estimates, "g").withColumn("d", _distance())
            .withColumn("bin", F.floor(F.log2(F.col("d") + F.lit(1e-6)) * OCTAVE)))
    if share is None:
        bins = bins.withColumn("bin", F.when(F.col("d") <= inner, 0).otherwise(1).cast("bigint"))

    def step(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("bin")
        if share is None:
            own = part[part["bin"] == 0]
            own = own if own["n"].sum() > D + 1 else part
            kept = 0.975
        else:
            cut = int((part["n"].cumsum() >= share * part["n"].sum()).to_numpy().argmax())
            own = part.iloc[:cut + 1]
            kept = own["n"].sum() / part["n"].sum()
        mean, scatter = _located(own)
        return _estimate(key[0], int(key[1]), mean, scatter * _factor(min(max(kept, 0.01), 0.999)))

    return stored(bins.groupBy("g", "start", "bin").agg(*_moments())
                  .groupBy("g", "start").applyInPandas(step, _ESTIMATE))


def mcd(rows: DataFrame) -> DataFrame:
    """(g, mean, inverse): reweighted MCD estimates of x0.. per group g."""
    middle = rows.groupBy("g").agg(*(F.percentile_approx(x, 0.5, 1000).alias(f"m{i}") for i, x in enumerate(_XS)))
    spread = (rows.join(stored(middle), "g").groupBy("g").agg(
        *(F.first(f"m{i}").alias(f"m{i}") for i in range(D)),
        *(F.percentile_approx(F.abs(F.col(x) - F.col(f"m{i}")), 0.5, 1000).alias(f"a{i}") for i, x in enumerate(_XS))))
    spread = stored(spread.select("g", *(f"m{i}" for i in range(D)),
                                  *(F.greatest(1.4826 * F.col(f"a{i}"), F.lit(FLOORS[i])).alias(f"a{i}") for i in range(D))))
    squashed = rows.join(spread, "g").select("g", *(F.tanh((F.col(x) - F.col(f"m{i}")) / F.col(f"a{i}")).alias(x)
                                                    for i, x in enumerate(_XS)))
    both = spread.join(squashed.groupBy("g").agg(*_moments()), "g")

    def begin(part: pd.DataFrame) -> pd.DataFrame:
        out = []
        for g, own in part.groupby("g"):
            mean = np.array([own[f"m{i}"].iloc[0] for i in range(D)])
            scale = np.array([own[f"a{i}"].iloc[0] for i in range(D)])
            out.append(_estimate(g, 0, mean, np.diag(scale ** 2)))
            scatter = _located(own)[1] + 1e-6 * np.eye(D)
            norm = np.sqrt(np.diag(scatter))
            out.append(_estimate(g, 1, mean, scatter / np.outer(norm, norm) * np.outer(scale, scale)))
        return pd.concat(out) if out else pd.DataFrame(columns=["g", "start", "mean", "inverse", "logdet"])

    estimates = stored(both.groupBy("g").applyInPandas(begin, _ESTIMATE))
    for _ in range(STEPS):
        estimates = _concentrate(rows, estimates, 0.5)
    best = estimates.groupBy("g").agg(F.min_by(F.struct("start", "mean", "inverse", "logdet"),
                                               F.struct("logdet", "start")).alias("b")).select("g", "b.*")
    return _concentrate(rows, stored(best), None).select("g", "mean", "inverse")


def judge(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang: str = "lang",
          source: str = "source", tail: float = TAIL) -> DataFrame:
    """One row per row of ``docs``: id, tkey, the statistics, base_failed, distance (squared; null where no estimate
    applies) and kept.

    base_failed: under 50 words, or over half of the words in repeated windows of three. Other texts are kept unless
    their distance exceeds the chi-square quantile of ``tail``. Null texts count as empty. Null languages and
    sources are groups of their own. Sources with few rows are pooled over their language, languages with
    few over all; if even that pool has under ``LEAST_ROWS`` rows, its texts are kept. Repeated rows each count
    and each give a row; an empty table gives an empty table.
    """
    stats = _statistics(docs, id_column, text_column, lang, source)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    stats = stored(stats.withColumn("base_failed", failed)
                   .withColumns(dict(zip(_XS, _vector()))))
    good = stats.filter(~F.col("base_failed"))
    sizes = good.groupBy("lang", "source").agg(F.count("*").alias("n"))
    named = sizes.withColumn("g", F.when(F.col("n") >= LEAST_ROWS, F.to_json(F.struct(F.lit(1).alias("k"), "lang", "source"))))
    small = named.filter("g is null").groupBy("lang").agg(F.sum("n").alias("rest"))
    named = (named.join(small.withColumnRenamed("lang", "small_lang"), F.col("lang").eqNullSafe(F.col("small_lang")), "left")
             .withColumn("g", F.coalesce("g", F.when(F.col("rest") >= LEAST_ROWS, F.to_json(F.struct(F.lit(2).alias("k"), "lang"))),
                                         F.lit("all"))))
    named = stored(named.select(F.col("lang").alias("l"), F.col("source").alias("s"), "g", "n"))
    pool = named.groupBy("g").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_ROWS).select("g")
    same = F.col("lang").eqNullSafe(F.col("l")) & F.col("source").eqNullSafe(F.col("s"))
    rows = stored(good.join(named, same).join(stored(pool), "g", "left_semi").select("g", *_XS))
    found = mcd(rows)
    cut = quantile(1 - tail)
    return (stats.join(named, same, "left").join(found, "g", "left")
            .withColumn("distance", F.when(~F.col("base_failed"), _distance()))
            .withColumn("kept", ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= cut))
            .select("id", "tkey", *STATS, "base_failed", "distance", "kept"))


def keep_good(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang: str = "lang",
              source: str = "source") -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with their columns. Rejected rows are found by id and text together."""
    mine, key = spare(docs, "text_hash"), spare(docs, "judged_id")
    out = judge(docs, id_column, text_column, lang, source).filter(~F.col("kept"))
    out = out.select(F.col("id").alias(key), F.col("tkey").alias(mine + "_")).distinct()
    return (docs.withColumn(mine, F.xxhash64(text_column))
            .join(out, F.col(id_column).eqNullSafe(F.col(key)) & (F.col(mine) == F.col(mine + "_")), "left_anti").drop(mine))


def op1_quality(docs: DataFrame) -> DataFrame:
    return judge(docs).select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                              "base_failed", "kept", F.round("distance", 6).alias("distance"))
