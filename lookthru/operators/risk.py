"""Risk of price series. All series of a table are handled in one job.

Ordered steps run per (series, month) with carried values, so one very long series is
spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .marts import rounded
from .ordered import with_previous, with_previous_and_max, with_running_max

TRADING_DAYS = 252
MIN_RETURNS = 20
MIN_PAIRS = 30


def _bars(candles: DataFrame) -> DataFrame:
    return candles.select("isin", "timestamp", F.col("close").cast("double").alias("close"),
                          F.trunc(F.col("timestamp").cast("date"), "month").alias("_chunk"))


def _return() -> Column:
    return F.when((F.col("close") > 0) & (F.col("prev") > 0), F.ln(F.col("close") / F.col("prev")))


def _returns(candles: DataFrame) -> DataFrame:
    """A row per bar; r is NULL where there is no return."""
    b = with_previous(_bars(candles), ["isin"], "_chunk", ["timestamp"], "close", "prev")
    return b.select("isin", "timestamp", _return().alias("r"))


def log_returns(candles: DataFrame) -> DataFrame:
    return _returns(candles).filter(F.col("r").isNotNull())


def _volatility() -> Column:
    return F.when(F.count("r") >= MIN_RETURNS, F.stddev_samp("r") * F.sqrt(F.lit(float(TRADING_DAYS))) * 100).alias("volatility_pct")


def _drawdown() -> Column:
    return F.when(F.count("close") >= 2, F.min(F.col("close") / F.col("peak") - 1) * 100).alias("max_drawdown_pct")


def adv(candles: DataFrame, sessions: int = 30) -> DataFrame:
    """Mean volume of the last sessions. The row_number limit is applied before the shuffle."""
    w = Window.partitionBy("isin").orderBy(F.col("timestamp").desc())
    last = (candles.select("isin", "timestamp", "volume")
            .withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= sessions))
    volume = F.sum(F.col("volume").cast("decimal(28,4)"))
    return last.groupBy("isin").agg(
        (volume.cast("double") / F.count("volume")).alias("adv_shares_30d"))


def price_table(candles: DataFrame, instruments: DataFrame, sessions: int = 30) -> DataFrame:
    """Last close and ADV per instrument that has bars."""
    last = candles.groupBy("isin").agg(F.max_by("close", "timestamp").alias("close"))
    return (instruments.filter(F.col("smartapi_token").isNotNull()).join(last, "isin")
            .join(adv(candles, sessions), "isin")
            .select("isin", "nse_symbol", "smartapi_token", "close", "adv_shares_30d",
                    F.lit("candles").alias("source")))


def realised_volatility(candles: DataFrame) -> DataFrame:
    """Annualised sample deviation of log returns in percent; NULL below 20 returns."""
    return _returns(candles).groupBy("isin").agg(_volatility())


def beta(candles: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Covariance with the benchmark over its variance, returns matched by time stamp."""
    a = _returns(candles).withColumnRenamed("r", "a")
    b = log_returns(benchmark).select("timestamp", F.col("r").alias("r_b"))
    both = a.join(b, "timestamp", "left").withColumn("b", F.when(F.col("a").isNotNull(), F.col("r_b")))
    return both.groupBy("isin").agg(F.when(F.count("b") >= MIN_PAIRS, F.try_divide(
        F.covar_samp("a", "b"), F.var_samp("b"))).alias("beta"))


def max_drawdown(candles: DataFrame) -> DataFrame:
    """Deepest fall from a running peak in percent; NULL below two bars."""
    b = with_running_max(_bars(candles), ["isin"], "_chunk", ["timestamp"], "close", "peak")
    return b.groupBy("isin").agg(_drawdown())


def constituent_risk(candles: DataFrame, benchmark: DataFrame | None = None) -> DataFrame:
    """Volatility, drawdown and beta per instrument; the first two from one pass over the bars."""
    b = with_previous_and_max(_bars(candles), ["isin"], "_chunk", ["timestamp"], "close", "prev", "peak")
    out = b.withColumn("r", _return()).groupBy("isin").agg(_volatility(), _drawdown())
    if benchmark is None:
        return out.withColumn("beta", F.lit(None).cast("double"))
    return out.join(beta(candles, benchmark), "isin")


def portfolio_risk(weights: DataFrame, risk: DataFrame) -> DataFrame:
    """Weight-blended risk per portfolio over the constituents that have a volatility.

    ``weights``: portfolio_id, isin, weight. Beta is blended over its own non-null
    weights. Correlations are ignored, so volatility is an upper bound.
    """
    w = F.col("weight").cast("decimal(18,10)")
    j = weights.join(risk, "isin", "left")
    priced = F.col("volatility_pct").isNotNull()
    with_beta = priced & F.col("beta").isNotNull()

    def blend(col: str, cond):
        num = F.sum(F.when(cond, (w * F.col(col).cast("decimal(18,8)")).cast("decimal(38,12)")))
        den = F.sum(F.when(cond, w))
        return F.try_divide(num.cast("double"), den.cast("double"))

    g = j.groupBy("portfolio_id").agg(
        F.sum(w).alias("all"), F.sum(F.when(priced, w)).alias("tw"),
        F.count(F.when(priced, 1)).alias("constituents_priced"),
        blend("volatility_pct", priced).alias("v"), blend("max_drawdown_pct", priced).alias("m"),
        blend("beta", with_beta).alias("b"))
    covered = F.try_divide(F.col("tw").cast("double") * 100, F.col("all").cast("double"))
    return g.select(
        "portfolio_id", F.coalesce(rounded(covered, 2), F.lit(0.0)).alias("coverage_pct"),
        rounded(F.col("v"), 2).alias("weighted_volatility_pct"),
        rounded(F.col("m"), 2).alias("weighted_max_drawdown_pct"),
        rounded(F.col("b"), 3).alias("weighted_beta"), "constituents_priced")
