"""Quality gates. Each gate is one aggregate row; the report unions them."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from .marts import rounded
from .overlap import exact_weight

NATURAL_KEY = ("scheme_code", "disclosure_month", "company_id", "instrument_name_raw")
TOLERANCE_PCT = 0.5
MIN_RESOLUTION = 0.95
MIN_RECONCILED = 0.99
MAX_AGE_DAYS = 75


class QualityFailure(RuntimeError):
    """Raised in strict mode with the names of the failing gates."""


def dq_weights(holdings: DataFrame, tol: float = TOLERANCE_PCT, *more: Column) -> DataFrame:
    """Sum of weights per scheme-month and whether it is within tolerance of 100; and more aggregates, if given."""
    g = (holdings.groupBy("scheme_code", "disclosure_month")
         .agg(F.coalesce(F.sum(exact_weight()), F.lit(0)).cast("decimal(28,6)").alias("t"), *more))
    off = F.abs(F.col("t") - 100)
    return g.select("scheme_code", "disclosure_month",
                    F.col("t").cast("double").alias("total_weight"),
                    off.cast("double").alias("deviation"),
                    (off <= F.lit(tol).cast("decimal(10,6)")).alias("passed"), *g.columns[3:])


def _row(metric: str, value: Column, threshold: float, passed: Column,
         unresolved: Column | None = None) -> list[Column]:
    return [F.lit(metric).alias("metric"), value.cast("double").alias("value"),
            F.lit(float(threshold)).alias("threshold"), passed.alias("passed"),
            (F.lit(0) if unresolved is None else unresolved).cast("bigint")
            .alias("unresolved_rows")]


def _share(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(1.0))


def gate_weights(holdings: DataFrame, tol: float = TOLERANCE_PCT) -> DataFrame:
    g = dq_weights(holdings, tol).agg(F.count(F.when(F.col("passed"), 1)).alias("ok"),
                                      F.count(F.lit(1)).alias("n"))
    rate = _share(F.col("ok"), F.col("n"))
    return g.select(*_row("scheme_month_weight_reconciliation", rounded(rate, 4),
                          MIN_RECONCILED, rate >= MIN_RECONCILED))


def dq_resolution(holdings: DataFrame, min_rate: float = MIN_RESOLUTION) -> DataFrame:
    g = holdings.filter(F.col("asset_class") == "equity").agg(
        F.count("company_id").alias("ok"), F.count(F.lit(1)).alias("n"))
    rate = _share(F.col("ok"), F.col("n"))
    return g.select(*_row("equity_isin_resolution_rate", rounded(rate, 4), min_rate,
                          rate >= min_rate, F.col("n") - F.col("ok")))


def dq_duplicates(holdings: DataFrame) -> DataFrame:
    """Rows beyond the first per natural key; NULL keys compare equal."""
    g = (holdings.groupBy(*NATURAL_KEY).agg((F.count(F.lit(1)) - 1).alias("extra"))
         .agg(F.coalesce(F.sum("extra"), F.lit(0)).alias("extra")))
    return g.select(*_row("duplicate_holdings", F.col("extra"), 0, F.col("extra") == 0))


def dq_freshness(holdings: DataFrame, as_of: dt.date, max_age: int = MAX_AGE_DAYS) -> DataFrame:
    g = holdings.agg(F.max("disclosure_month").alias("m"))
    age = F.datediff(F.lit(as_of), F.col("m"))
    return g.select(*_row("disclosure_age_days", age, max_age,
                          F.coalesce(age <= max_age, F.lit(False))))


def dq_free_float(dtl: DataFrame | None, holdings: DataFrame | None = None) -> DataFrame:
    """Companies of which funds would own more than the whole free float."""
    if dtl is None:
        if holdings is None:
            raise ValueError("need dtl or holdings")
        return holdings.agg(F.lit(0).alias("x")).select(
            *_row("mf_ownership_within_free_float", F.lit(0), 0, F.lit(True)))
    g = dtl.agg(F.count(F.when(F.col("mf_pct_of_free_float") > 100, 1)).alias("x"))
    return g.select(*_row("mf_ownership_within_free_float", F.col("x"), 0, F.col("x") == 0))


def _holding_gates(holdings: DataFrame, as_of: dt.date) -> DataFrame:
    """The four gates over holdings from one scan: natural keys are counted and summed first,
    then scheme-months, then all."""
    equity = F.col("asset_class") == "equity"
    keys = holdings.groupBy(*NATURAL_KEY).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(exact_weight()).alias("w"), F.count(F.when(equity, 1)).alias("equity"),
        F.count(F.when(equity, F.col("company_id"))).alias("resolved"))
    months = keys.groupBy("scheme_code", "disclosure_month").agg(
        F.coalesce(F.sum("w"), F.lit(0)).cast("decimal(28,6)").alias("t"), F.sum(F.col("rows") - 1).alias("extra"),
        F.sum("equity").alias("equity"), F.sum("resolved").alias("resolved"))
    fits = F.abs(F.col("t") - 100) <= F.lit(TOLERANCE_PCT).cast("decimal(10,6)")
    zero = F.lit(0)
    one = months.agg(F.count(F.when(fits, 1)).alias("ok"), F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("extra"), zero).alias("extra"),
                     F.coalesce(F.sum("equity"), zero).alias("equity"), F.coalesce(F.sum("resolved"), zero).alias("resolved"),
                     F.max("disclosure_month").alias("m"))
    reconciled, resolved = _share(F.col("ok"), F.col("n")), _share(F.col("resolved"), F.col("equity"))
    age = F.datediff(F.lit(as_of), F.col("m"))
    gates = [_row("scheme_month_weight_reconciliation", rounded(reconciled, 4), MIN_RECONCILED, reconciled >= MIN_RECONCILED),
             _row("equity_isin_resolution_rate", rounded(resolved, 4), MIN_RESOLUTION, resolved >= MIN_RESOLUTION,
                  F.col("equity") - F.col("resolved")),
             _row("duplicate_holdings", F.col("extra"), 0, F.col("extra") == 0),
             _row("disclosure_age_days", age, MAX_AGE_DAYS, F.coalesce(age <= MAX_AGE_DAYS, F.lit(False)))]
    return one.select(F.inline(F.array(*[F.struct(*g) for g in gates])))


def dq_report(holdings: DataFrame, dtl: DataFrame | None, as_of: dt.date,
              strict: bool = False) -> DataFrame:
    """Five gates as five rows. Strict mode runs the job and raises if one fails."""
    report = _holding_gates(holdings, as_of).unionByName(dq_free_float(dtl, holdings))
    if strict:
        failed = [r.metric for r in report.filter(~F.col("passed")).select("metric").collect()]
        if failed:
            raise QualityFailure(f"quality gates failed: {sorted(failed)}")
    return report


def gate_counts(holdings: DataFrame, tol: float = TOLERANCE_PCT) -> DataFrame:
    """Rows of every scheme-month on each side of ``promotable``, in one pass over the holdings.

    A scheme-month without code or month is on neither side.
    """
    judged = dq_weights(holdings, tol, F.count(F.lit(1)).alias("rows"))
    return judged.filter("scheme_code is not null and disclosure_month is not null and passed is not null").select(
        "scheme_code", "disclosure_month", F.when(F.col("passed"), "publish").otherwise("quarantine").alias("gate"), "rows")


def promotable(holdings: DataFrame, tol: float = TOLERANCE_PCT) -> tuple[DataFrame, DataFrame]:
    """Split off the rows of scheme-months that fail reconciliation: (publish, quarantine)."""
    keys = ["scheme_code", "disclosure_month"]
    judged = dq_weights(holdings, tol)
    good = judged.filter("passed").select(*keys)
    bad = judged.filter(~F.col("passed")).select(*keys, "total_weight", "deviation")
    return holdings.join(good, keys, "left_semi"), holdings.join(bad, keys)
