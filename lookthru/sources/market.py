"""Landed market data: instrument master and price bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

INSTRUMENT_JSON = ("token STRING, symbol STRING, name STRING, exch_seg STRING, "
                   "lotsize STRING, tick_size STRING")
# The exchange segment and symbol ending of listed shares.
EXCHANGE, SHARE_SUFFIX = "NSE", "-EQ"
CANDLE_FIELDS = ("timestamp", "open", "high", "low", "close", "volume")


def read_instruments(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INSTRUMENT_JSON).json(path)


def listed_shares(instruments: DataFrame) -> DataFrame:
    share = (F.col("exch_seg") == EXCHANGE) & F.col("symbol").endswith(SHARE_SUFFIX)
    return instruments.filter(share).select(
        F.col("token").alias("smartapi_token"),
        F.replace("symbol", F.lit(SHARE_SUFFIX), F.lit("")).alias("nse_symbol"),
        "name", "exch_seg", "lotsize", "tick_size")


def instrument_dim(instruments: DataFrame, companies: DataFrame) -> DataFrame:
    """Every company with its token; NULL where the exchange lists no such symbol."""
    tokens = listed_shares(instruments).groupBy("nse_symbol").agg(
        F.min("smartapi_token").alias("smartapi_token"))
    return companies.select("isin", "nse_symbol", "company_name").join(tokens, "nse_symbol", "left").select(
        "isin", "nse_symbol", "company_name", "smartapi_token")


def conform_candles(landed: DataFrame) -> DataFrame:
    """(isin, json) with json an array of [time, o, h, l, c, volume] to typed bars.

    A number that cannot be read becomes NULL; the bar is kept.
    """
    bars = F.explode(F.from_json("json", "array<array<string>>")).alias("b")
    return landed.select("isin", bars).select(
        "isin", F.get("b", 0).try_cast("timestamp").alias("timestamp"),
        *[F.get("b", i).try_cast("double").alias(c)
          for i, c in enumerate(CANDLE_FIELDS) if i > 0])
