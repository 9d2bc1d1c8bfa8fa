"""Scheme and company marts over the silver holdings."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..schemas import EXACT
from .overlap import exact_weight, in_month, latest_holdings, resolved_equity

CLOSET_BELOW = 40.0
PARTICIPATION = 0.20
CRORE = 1e7
BUCKETS = ("large", "mid", "small")


def rounded(col: Column, digits: int) -> Column:
    """Half-up on the exact decimal, never on a double, so ties do not depend on an engine."""
    return F.round(col.cast(EXACT), digits).cast("double")


def active_share(holdings: DataFrame, benchmark: DataFrame, schemes: DataFrame,
                 month: dt.date | None = None, flag_below: float = CLOSET_BELOW) -> DataFrame:
    """Half the summed absolute weight difference to the benchmark, per scheme.

    A full outer join per scheme would repeat the benchmark for every scheme. Instead:
    sum|f-b| = sum(b) + sum over held companies of (|f-b| - b), an inner-size join.
    """
    fund = (latest_holdings(holdings, month).groupBy("scheme_code", "company_id")
            .agg(F.sum(exact_weight()).alias("f")))
    bench = (benchmark.groupBy(F.col("isin").alias("company_id"))
             .agg(F.sum(exact_weight()).cast(EXACT).alias("b")))
    b = F.coalesce(F.col("b"), F.lit(0).cast(EXACT))
    total = bench.select(F.coalesce(F.sum("b"), F.lit(0))).scalar()
    share = ((total + F.sum(F.abs(F.coalesce(F.col("f"), F.lit(0).cast(EXACT)) - b) - b))
             / 2).cast(EXACT)
    scored = (fund.join(bench, "company_id", "left").groupBy("scheme_code")
              .agg(share.alias("exact")))
    info = schemes.select("scheme_code", "scheme_name", "category", "benchmark",
                          "ter_regular_pct", "ter_direct_pct")
    return scored.join(info, "scheme_code").select(
        "scheme_code", "scheme_name", "category", "benchmark",
        rounded(F.col("exact"), 2).alias("active_share_pct"),
        "ter_regular_pct", "ter_direct_pct",
        (F.col("exact") < flag_below).alias("closet_index_flag"))


def dated_caps(caps: DataFrame) -> DataFrame:
    """Validity interval of each effective-dated classification row."""
    w = Window.partitionBy("isin").orderBy("effective_from")
    return caps.withColumn("valid_to", F.lead("effective_from").over(w))


def style_drift(holdings: DataFrame, caps: DataFrame, effective_dated: bool = False) -> DataFrame:
    """Large, mid and small share of the classified equity, per scheme-month.

    With ``effective_dated`` the list in force in each month is used. Weights are
    summed per company first, so the look-up sees one row per scheme-month-company.
    """
    w = (resolved_equity(holdings).groupBy("scheme_code", "disclosure_month", "company_id")
         .agg(F.sum(exact_weight()).alias("w")))
    if effective_dated:
        c = dated_caps(caps.select("isin", "cap_bucket", "effective_from"))
        on = ((w["company_id"] == c["isin"])
              & (c["effective_from"] <= w["disclosure_month"])
              & (c["valid_to"].isNull() | (w["disclosure_month"] < c["valid_to"])))
    else:
        c = caps.select("isin", "cap_bucket")
        on = w["company_id"] == c["isin"]
    # Rows without a bucket add nothing to any of the three, so an inner join is enough.
    joined = w.join(c.filter(F.col("cap_bucket").isin(*BUCKETS)), on)
    zero = F.lit(0).cast("decimal(28,6)")
    g = joined.groupBy("scheme_code", "disclosure_month").agg(
        F.sum("w").alias("total"),
        *[F.sum(F.when(F.col("cap_bucket") == b, F.col("w")).otherwise(zero)).alias(b)
          for b in BUCKETS])
    return g.filter(F.col("total") != 0).select(
        "scheme_code", "disclosure_month",
        *[rounded(F.try_divide(F.col(b).cast("double") * 100, F.col("total").cast("double")), 2)
          .alias(f"{b}_pct") for b in BUCKETS])


def turnover_lag(holdings: DataFrame) -> DataFrame:
    """Annualised half weight change over rows whose (scheme, company) has an earlier row."""
    w = Window.partitionBy("scheme_code", "company_id").orderBy("disclosure_month")
    # One row per month after this sum, so a window is as long as the history of months.
    monthly = (resolved_equity(holdings)
               .groupBy("scheme_code", "company_id", "disclosure_month")
               .agg(F.sum(exact_weight()).cast(EXACT).alias("w")))
    delta = monthly.withColumn("d", F.abs(F.col("w") - F.lag("w").over(w)))
    return (delta.filter(F.col("d").isNotNull()).groupBy("scheme_code", "disclosure_month")
            .agg(rounded(F.sum("d") * 6, 2).alias("inferred_turnover_pct")))


def turnover_full(holdings: DataFrame) -> DataFrame:
    """As above, but entries and exits count against zero in the previous filed month."""
    monthly = (resolved_equity(holdings)
               .groupBy("scheme_code", "disclosure_month", "company_id")
               .agg(F.sum(exact_weight()).cast(EXACT).alias("w")))
    months = (resolved_equity(holdings).select("scheme_code", "disclosure_month").distinct()
              .withColumn("next_month", F.lead("disclosure_month").over(
                  Window.partitionBy("scheme_code").orderBy("disclosure_month")))
              .withColumn("first_month", F.min("disclosure_month").over(
                  Window.partitionBy("scheme_code"))))
    dated = monthly.join(months, ["scheme_code", "disclosure_month"])
    # Each weight is +w in its own month and -w in the next one the scheme filed.
    signed = dated.select(
        "scheme_code", "company_id", "first_month", F.explode(F.array(
            F.struct(F.col("disclosure_month").alias("m"), F.col("w").alias("d")),
            F.struct(F.col("next_month").alias("m"), (-F.col("w")).alias("d")))).alias("s"))
    return (signed.filter(F.col("s.m") > F.col("first_month"))
            .groupBy("scheme_code", F.col("s.m").alias("disclosure_month"), "company_id")
            .agg(F.sum("s.d").alias("d"))
            .groupBy("scheme_code", "disclosure_month")
            .agg(rounded(F.sum(F.abs("d")) * 6, 2).alias("inferred_turnover_pct")))


def crowding(holdings: DataFrame, schemes: DataFrame, companies: DataFrame,
             month: dt.date | None = None) -> DataFrame:
    """Rupees (crore) the industry holds of each listed company; unrounded value kept."""
    w = (in_month(holdings.filter(F.col("asset_class") == "equity"), month)
         .groupBy("scheme_code", "company_id").agg(F.sum(exact_weight()).cast(EXACT).alias("w")))
    aum = schemes.select("scheme_code", F.col("aum_cr").cast("decimal(18,2)").alias("aum"))
    value = F.col("w") * F.coalesce("aum", F.lit(0).cast("decimal(18,2)"))
    held = (w.join(aum, "scheme_code", "left").groupBy("company_id")
            .agg((F.sum(value).cast("decimal(30,8)") / 100).cast("decimal(28,10)").alias("v")))
    info = companies.select("isin", "company_name", "cap_bucket", "free_float_shares_cr")
    return held.join(info, F.col("company_id") == F.col("isin")).select(
        "company_id", "isin", "company_name", "cap_bucket", "free_float_shares_cr",
        F.col("v").cast("double").alias("value_cr"),
        F.round("v", 1).cast("double").alias("mf_holding_cr"))


def days_to_liquidate(crowd: DataFrame, prices: DataFrame, participation: float = PARTICIPATION,
                      round_first: bool = False) -> DataFrame:
    """Sessions the industry needs to sell out at a share of the daily volume."""
    p = prices.select("isin", "close", "adv_shares_30d", "nse_symbol")
    holding = F.col("mf_holding_cr" if round_first else "value_cr")
    j = crowd.join(p, "isin").withColumn("mf_shares", F.try_divide(holding * CRORE, F.col("close")))
    days = F.try_divide(F.col("mf_shares"), F.lit(participation) * F.col("adv_shares_30d"))
    of_float = F.try_divide(F.col("mf_shares"), F.col("free_float_shares_cr") * CRORE) * 100
    return j.select(
        "isin", "company_name", "nse_symbol", "cap_bucket", "mf_holding_cr",
        F.round(of_float.cast("decimal(24,6)"), 2).cast("double").alias("mf_pct_of_free_float"), "adv_shares_30d",
        F.round(days.cast("decimal(24,6)"), 1).cast("double").alias("days_to_liquidate"),
        F.lit(participation).alias("participation_assumption"))


def top_by(df: DataFrame, column: str, limit: int, tie: str) -> DataFrame:
    """Largest rows first, NULLs last; a per-task top-k merged on the driver side."""
    return df.orderBy(F.col(column).desc_nulls_last(), F.col(tie)).limit(limit)


def fee_drag_grid(schemes: DataFrame, scenarios: list[tuple[float, int, float]]) -> DataFrame:
    """Terminal value of monthly contributions under two expense ratios.

    ``scenarios`` are (monthly contribution, years, gross return %), a short list of
    assumptions, so it is exploded as a literal next to each scheme.
    """
    grid = F.array(*[F.struct(F.lit(float(c)).alias("contribution"), F.lit(int(y)).alias("years"),
                              F.lit(float(g)).alias("gross")) for c, y, g in scenarios])
    s = schemes.select("scheme_code", "ter_direct_pct", "ter_regular_pct",
                       F.explode(grid).alias("x"))
    c, n = F.col("x.contribution"), F.col("x.years") * 12

    def future_value(ter: str) -> Column:
        r = (F.col("x.gross") - F.col(ter)) / 100.0 / 12.0
        grown = c * F.try_divide(F.pow(1 + r, n) - 1, r)
        return F.when(r == 0, c * n).otherwise(grown)

    out = s.select("scheme_code", F.col("x.contribution").alias("contribution"),
                   F.col("x.years").alias("years"), F.col("x.gross").alias("gross_return_pct"),
                   (c * n).alias("invested"), "ter_direct_pct", "ter_regular_pct",
                   future_value("ter_direct_pct").alias("a"),
                   future_value("ter_regular_pct").alias("b"))
    return out.select("scheme_code", "contribution", "years", "gross_return_pct", "invested",
                      "ter_direct_pct", "ter_regular_pct",
                      F.round(F.col("a").cast("decimal(24,6)"), 2).cast("double").alias("terminal_value_direct"),
                      F.round(F.col("b").cast("decimal(24,6)"), 2).cast("double").alias("terminal_value_regular"),
                      F.round((F.col("a") - F.col("b")).cast("decimal(24,6)"), 2).cast("double").alias("difference"))


def key_skew(holdings: DataFrame, key: str = "company_id", limit: int = 5) -> DataFrame:
    return top_by(holdings.groupBy(key).agg(F.count(F.lit(1)).alias("rows")), "rows", limit, key)
