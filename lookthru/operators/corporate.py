"""Corporate actions: restate share counts and follow mergers."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..schemas import CORP_ACTION
from .tiles import spread_nulls


def read_actions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CORP_ACTION).csv(path, header=True, dateFormat="yyyy-MM-dd")


def cumulative_factors(actions: DataFrame, as_of: dt.date) -> DataFrame:
    """Product of this and all later ratios of the identifier, up to ``as_of``."""
    w = Window.partitionBy("isin").orderBy("ex_date", "action_type", "ratio")
    return (actions.filter(F.col("ex_date") <= F.lit(as_of))
            .select("isin", "ex_date", "action_type", "ratio",
                    F.product("ratio").over(w.rowsBetween(0, Window.unboundedFollowing))
                    .alias("cumulative_factor")))


def _span_factors(actions: DataFrame, as_of: dt.date) -> DataFrame:
    """Per identifier, disjoint date spans with the factor of a date inside them.

    The factor of a date d is the product of the ratios with ex_date > d. Actions of
    one day are merged first, so a date falls into exactly one span.
    """
    daily = (actions.filter(F.col("ex_date") <= F.lit(as_of)).groupBy("isin", "ex_date")
             .agg(F.product("ratio").alias("ratio")))
    w = Window.partitionBy("isin").orderBy("ex_date")
    return daily.select(
        F.col("isin").alias("_isin"), F.col("ex_date").alias("_to"),
        F.lag("ex_date").over(w).alias("_from"),
        F.product("ratio").over(w.rowsBetween(0, Window.unboundedFollowing)).alias("_factor"))


def adjust_holdings(holdings: DataFrame, actions: DataFrame, as_of: dt.date,
                    date_col: str = "disclosure_month",
                    isin_col: str = "company_id") -> DataFrame:
    """Quantities on the basis of ``as_of`` and identifiers of successors.

    Each row meets at most one span, so no row is multiplied by the join. Weights stay.
    """
    spans = _span_factors(actions, as_of)
    day = F.col(date_col)
    on = ((F.col("_key") == F.col("_isin")) & (day < F.col("_to"))
          & (F.col("_from").isNull() | (F.col("_from") <= day)))
    remap = (actions.filter(F.col("action_type").isin("merger", "demerger")
                            & F.col("new_isin").isNotNull() & (F.col("ex_date") <= F.lit(as_of)))
             .groupBy(F.col("isin").alias("_old")).agg(
        F.max_by("new_isin", F.struct("ex_date", "new_isin")).alias("_new")))
    factor = F.coalesce("_factor", F.lit(1.0))
    renamed: list[Column] = [
        F.coalesce("_new", isin_col).alias(isin_col) if c == isin_col else F.col(c)
        for c in holdings.columns]
    # Cash rows have no identifier; they must not all meet in one task.
    keyed = holdings.withColumn("_key", spread_nulls(F.col(isin_col), *holdings.columns))
    j = keyed.join(spans, on, "left").join(remap, F.col("_key") == F.col("_old"), "left")
    out = [*renamed, F.col(isin_col).alias(f"{isin_col}_original"),
           factor.alias("qty_adjustment_factor")]
    if "quantity" in holdings.columns:
        out.append((F.col("quantity").cast("double") * factor).alias("quantity_adjusted"))
    return j.select(*out)
