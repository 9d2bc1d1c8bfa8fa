"""The domain tables, derived from the given TPC-H-like tables.

Each view covers its whole input. Mapping: suppliers are schemes, (brand, type) of a
part is a company, line items are positions by ship month, orders give portfolios.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

MONEY = "decimal(18,2)"
AS_OF = dt.date(2001, 12, 1)
TASK_ROWS = 250_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, rows: DataFrame, *keys: str) -> DataFrame:
    """``df`` by a hash of its keys over so many tasks that one gets about ``TASK_ROWS`` of ``rows``, a table read from files.

    Tasks cut by bytes hold several millions of small rows, and each aggregate over them keeps a table of its groups.
    """
    n = max(df.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // TASK_ROWS))
    return df.repartition(n, *keys)


def code(prefix: str, key: str | Column) -> Column:
    c = F.col(key) if isinstance(key, str) else key
    return F.concat(F.lit(prefix), F.lpad(c.cast("string"), 10, "0"))


def company_key() -> Column:
    return F.concat_ws("/", "p_brand", "p_type")


def _trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
        F.col("l_shipdate").cast("date").alias("ship_date"))
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    return item.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        code("S", "l_suppkey").alias("scheme_code"), company_key().alias("company_id"),
        "p_brand", "p_type", "ship_date", "l_orderkey",
        F.col("l_extendedprice").cast(MONEY).alias("price"),
        F.col("l_quantity").cast(MONEY).alias("qty"))


def asset_class() -> Column:
    return (F.when(F.col("p_type") == "PROMO", "cash")
            .when(F.col("p_type") == "ECONOMY", "debt").otherwise("equity"))


def holdings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly positions of every scheme, weights summing to 100 per scheme-month."""
    trades = _trades(spark, sf_dir).withColumn("disclosure_month", F.trunc("ship_date", "month"))
    grouped = (spread(trades, table(spark, sf_dir, "lineitem"), "scheme_code", "disclosure_month")
               .groupBy("scheme_code", "disclosure_month", "company_id", "p_brand", "p_type")
               .agg(F.sum("price").alias("mv"), F.sum("qty").alias("qty")))
    # Rows are one per (scheme, month, company) by now, so this window is at most as
    # long as the list of companies.
    total = F.sum("mv").over(Window.partitionBy("scheme_code", "disclosure_month"))
    weight = (F.lit(100.0) * F.col("mv").cast("double") / total.cast("double"))
    return grouped.select(
        "scheme_code", "disclosure_month", "company_id",
        F.concat_ws(" ", "p_type", "p_brand").alias("instrument_name_raw"),
        asset_class().alias("asset_class"),
        F.col("qty").cast("double").alias("quantity"),
        F.col("mv").cast("double").alias("market_value"),
        weight.cast("decimal(18,6)").alias("weight_pct"))


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (table(spark, sf_dir, "part").groupBy("p_brand", "p_type")
            .agg(F.sum(F.col("p_size").cast("bigint")).cast("double")
                 .alias("free_float_shares_cr"))
            .select(company_key().alias("isin"),
                    F.concat_ws(" ", "p_type", "p_brand").alias("company_name"),
                    F.upper(F.concat_ws("_", "p_brand", "p_type")).alias("nse_symbol"),
                    F.when(F.col("p_type") == "LARGE", "large")
                    .when(F.col("p_type") == "MEDIUM", "mid")
                    .when(F.col("p_type") == "SMALL", "small").alias("cap_bucket"),
                    F.col("p_brand").alias("sector"), "free_float_shares_cr"))


def schemes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    return (table(spark, sf_dir, "supplier")
            .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
            .select(code("S", "s_suppkey").alias("scheme_code"),
                    F.col("s_name").alias("scheme_name"), F.col("n_name").alias("amc_name"),
                    F.concat(F.lit("CATEGORY_"), F.col("n_regionkey").cast("string"))
                    .alias("category"),
                    F.lit("LARGE EQUAL WEIGHT").alias("benchmark"),
                    ((F.col("s_suppkey") % 150 + 100) / 100.0).alias("ter_regular_pct"),
                    ((F.col("s_suppkey") % 150 + 40) / 100.0).alias("ter_direct_pct"),
                    F.greatest(F.col("s_acctbal"), F.lit(0.0)).alias("aum_cr")))


def candles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One bar per company and ship date."""
    price = F.col("price").cast("double") / F.col("qty").cast("double")
    return (_trades(spark, sf_dir).groupBy(F.col("company_id").alias("isin"), "ship_date")
            .agg(F.min(price).alias("low"), F.max(price).alias("high"),
                 (F.sum("price").cast("double") / F.sum("qty").cast("double")).alias("close"),
                 F.sum("qty").cast("double").alias("volume"))
            .select("isin", F.col("ship_date").cast("timestamp").alias("timestamp"),
                    F.col("close").alias("open"), "high", "low", "close", "volume"))


def benchmark_candles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole market per ship date, as the index series."""
    return (_trades(spark, sf_dir).groupBy("ship_date")
            .agg((F.sum("price").cast("double") / F.sum("qty").cast("double")).alias("close"),
                 F.sum("qty").cast("double").alias("volume"))
            .select(F.lit("INDEX").alias("isin"),
                    F.col("ship_date").cast("timestamp").alias("timestamp"), "close", "volume"))


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (_trades(spark, sf_dir)
            .groupBy(F.col("company_id").alias("isin"), "p_brand", "p_type", "ship_date")
            .agg(F.sum("price").alias("price"), F.sum("qty").alias("qty"))
            .groupBy("isin", "p_brand", "p_type")
            .agg((F.sum("price").cast("double") / F.sum("qty").cast("double")).alias("close"),
                 (F.sum("qty").cast("double") / F.count(F.lit(1))).alias("adv_shares_30d"))
            .select("isin", F.upper(F.concat_ws("_", "p_brand", "p_type")).alias("nse_symbol"),
                    "close", "adv_shares_30d"))


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rupee value of every customer in every scheme."""
    order = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    item = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_suppkey", F.col("l_extendedprice").cast(MONEY).alias("price"))
    bought = item.join(order, F.col("l_orderkey") == F.col("o_orderkey")).select(
        code("P", "o_custkey").alias("portfolio_id"), code("S", "l_suppkey").alias("scheme_code"), "price")
    return (spread(bought, item, "portfolio_id", "scheme_code").groupBy("portfolio_id", "scheme_code")
            .agg(F.sum("price").cast("double").alias("value")))


def direct_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares each customer holds directly, with the last traded price."""
    order = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    trade = _trades(spark, sf_dir)
    unit = F.col("price").cast("double") / F.col("qty").cast("double")
    return (trade.join(order, F.col("l_orderkey") == F.col("o_orderkey"))
            .groupBy(code("P", "o_custkey").alias("portfolio_id"),
                     F.col("company_id").alias("isin"), "p_type", "p_brand")
            .agg(F.sum("qty").alias("q"), F.sum("price").alias("cost"),
                 F.max(F.round(unit.cast("decimal(18,6)"), 2).cast(MONEY)).alias("ltp"))
            .select("portfolio_id", "isin", F.concat_ws(" ", "p_type", "p_brand").alias("symbol"),
                    F.col("q").cast("double").alias("quantity"),
                    (F.col("cost").cast("double") / F.col("q").cast("double"))
                    .alias("average_price"),
                    F.col("ltp").cast("double").alias("ltp")))


def benchmark_weights(companies_df: DataFrame) -> DataFrame:
    """Equal weight over the large companies."""
    large = companies_df.filter(F.col("cap_bucket") == "large").select("isin", "company_name")
    n = large.select(F.count(F.lit(1))).scalar()
    return large.withColumn("weight_pct", F.lit(100.0) / n)
