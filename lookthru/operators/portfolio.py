"""Portfolio lenses. Every function handles all portfolios of a table in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..schemas import EXACT
from .marts import rounded
from .overlap import MICRO, exact_weight, in_month, resolved_equity, scheme_company_weights
from .tiles import fragmented, pair_condition, tiled

MONEY = "decimal(18,2)"
TOP_ROWS = 15


def money(col: str) -> Column:
    return F.col(col).cast(MONEY)


def valid_positions(positions: DataFrame, holdings: DataFrame) -> DataFrame:
    """Positive positions in schemes that have holdings, one row per portfolio and scheme."""
    known = holdings.select("scheme_code").distinct()
    return (positions.filter(F.col("value") > 0).groupBy("portfolio_id", "scheme_code")
            .agg(F.sum(money("value")).cast(MONEY).alias("value"))
            .join(known, "scheme_code", "left_semi"))


def portfolio_status(positions: DataFrame, holdings: DataFrame) -> DataFrame:
    """All portfolios with total and fund count; those without a valid scheme are flagged."""
    ids = positions.select("portfolio_id").distinct()
    totals = (valid_positions(positions, holdings).groupBy("portfolio_id")
              .agg(F.sum("value").alias("total"), F.count(F.lit(1)).alias("fund_count")))
    return ids.join(totals, "portfolio_id", "left").select(
        "portfolio_id", F.coalesce(F.col("total").cast("double"), F.lit(0.0)).alias("total_value"),
        F.coalesce("fund_count", F.lit(0).cast("bigint")).alias("fund_count"),
        F.col("fund_count").isNotNull().alias("valid"))


def look_through(positions: DataFrame, holdings: DataFrame, month=None) -> DataFrame:
    """True weight and value of each company in each portfolio.

    Positions in schemes without holdings add nothing but stay in the total.
    """
    owned = (positions.groupBy("portfolio_id", "scheme_code")
             .agg(F.sum(money("value")).cast(MONEY).alias("v")))
    total = owned.groupBy("portfolio_id").agg(F.sum("v").cast(MONEY).alias("total"))
    held = (in_month(holdings, month)
            .withColumn("company_id", F.coalesce("company_id", "instrument_name_raw"))
            .groupBy("scheme_code", "company_id", "asset_class")
            .agg(F.sum(exact_weight()).cast(EXACT).alias("w"),
                 F.min("instrument_name_raw").alias("name")))
    # A scheme that very many portfolios own is cut by its owners.
    owners, parts = fragmented(owned, held, ["scheme_code"], "portfolio_id")
    # v * w stays an exact decimal until the one division per output row.
    rupees = (owners.join(parts, ["scheme_code", "_f"])
              .groupBy("portfolio_id", "company_id", "asset_class")
              .agg(F.sum((F.col("v") * F.col("w")).cast("decimal(32,8)")).alias("vw"),
                   F.min("name").alias("instrument_name_raw")))
    value = F.col("vw").cast("double") / 100.0
    return rupees.join(total.filter(F.col("total") > 0), "portfolio_id").select(
        "portfolio_id", "company_id", "asset_class", "instrument_name_raw",
        F.try_divide(F.col("vw").cast("double"), F.col("total").cast("double"))
        .alias("weight_pct"), value.alias("value"))


def _ranked(look_through_df: DataFrame, limit: int) -> DataFrame:
    # A row_number filter is pushed below the shuffle as a per-task group limit, so a
    # long portfolio never travels whole.
    w = Window.partitionBy("portfolio_id").orderBy(
        F.col("weight_pct").desc(), F.col("company_id"))
    return (look_through_df.filter(F.col("asset_class") == "equity")
            .withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit))


def top_holdings(look_through_df: DataFrame, limit: int = TOP_ROWS) -> DataFrame:
    return _ranked(look_through_df, limit).select(
        "portfolio_id", "rank", "company_id", "instrument_name_raw",
        rounded(F.col("weight_pct"), 2).alias("weight_pct"),
        F.round(F.col("value").cast(EXACT), 0).cast("double").alias("value"))


def concentration(look_through_df: DataFrame) -> DataFrame:
    """Top name, top shares, distinct companies and HHI per portfolio, equity only."""
    w = F.col("weight_pct").cast("decimal(18,10)")
    top = _ranked(look_through_df, 10).groupBy("portfolio_id").agg(
        F.max(F.when(F.col("rank") == 1, F.col("instrument_name_raw"))).alias("top_holding"),
        F.sum(F.when(F.col("rank") == 1, w)).alias("t1"),
        F.sum(F.when(F.col("rank") <= 5, w)).alias("t5"), F.sum(w).alias("t10"))
    is_equity = F.col("asset_class") == "equity"
    square = (w.cast("decimal(14,8)") * w.cast("decimal(14,8)")).cast("decimal(24,10)")
    spread = look_through_df.groupBy("portfolio_id").agg(
        F.count(F.when(is_equity, 1)).alias("unique_companies"), F.sum(F.when(is_equity, square)).alias("hhi"))
    zero = F.lit(0.0)
    return (spread.join(top, "portfolio_id", "left").select(
        "portfolio_id", "top_holding",
        F.coalesce(rounded(F.col("t1"), 2), zero).alias("top_holding_pct"),
        F.coalesce(rounded(F.col("t5"), 2), zero).alias("top_5_pct"),
        F.coalesce(rounded(F.col("t10"), 2), zero).alias("top_10_pct"),
        "unique_companies",
        F.coalesce(F.round("hhi", 1).cast("double"), zero).alias("hhi")))


def group_split(weights: DataFrame, companies: DataFrame) -> DataFrame:
    """Equity weight by sector and by cap bucket in one pass; NULL groups dropped."""
    info = companies.select("isin", "sector", "cap_bucket")
    j = (weights.filter(F.col("asset_class") == "equity")
         .join(info, F.col("company_id") == F.col("isin")))
    tagged = j.select("portfolio_id", "weight_pct", F.explode(F.array(
        F.struct(F.lit("sector").alias("kind"), F.col("sector").alias("name")),
        F.struct(F.lit("cap_bucket").alias("kind"), F.col("cap_bucket").alias("name"))))
        .alias("g"))
    return (tagged.filter(F.col("g.name").isNotNull())
            .groupBy("portfolio_id", F.col("g.kind").alias("kind"), F.col("g.name").alias("name"))
            .agg(rounded(F.sum(F.col("weight_pct").cast("decimal(18,10)")), 2)
                 .alias("weight_pct")))


def portfolio_overlaps(positions: DataFrame, weights: DataFrame, schemes: DataFrame) -> DataFrame:
    """Overlap of each pair of schemes a portfolio holds, with names; 0 where disjoint.

    ``weights`` has a row per scheme and company (``scheme_company_weights``). Each position takes its scheme's name and
    weights along, so a pair is worked out where it is made and only positions are shuffled. The positions of a portfolio
    are cut into tiles so that a portfolio of very many schemes is spread over tasks.
    """
    owned = positions.filter(F.col("value") > 0).select("portfolio_id", "scheme_code").distinct()
    held = weights.groupBy("scheme_code").agg(F.map_from_entries(F.collect_list(F.struct("company_id", "w"))).alias("held"))
    info = (schemes.select("scheme_code", "scheme_name").join(held, "scheme_code", "full"))
    t = tiled(owned, ["portfolio_id"], "scheme_code").join(info, "scheme_code", "left")
    pairs = t.alias("a").join(t.alias("b"), pair_condition(
        "a", "b", ["portfolio_id"], "scheme_code", "scheme_code"))
    a, b = F.col("a.held"), F.col("b.held")

    def smaller(entry: Column) -> Column:
        other = F.try_element_at(b, entry["key"])
        return F.when(other.isNotNull(), F.least(entry["value"], other)).otherwise(0)

    total = F.aggregate(F.map_entries(a), F.lit(0).cast("bigint"), lambda n, entry: n + smaller(entry))
    share = rounded(total / F.lit(float(MICRO)), 2)
    return pairs.select(
        F.col("a.portfolio_id").alias("portfolio_id"), F.col("a.scheme_code").alias("scheme_a"),
        F.col("b.scheme_code").alias("scheme_b"),
        F.when(a.isNotNull() & b.isNotNull(), share).otherwise(0.0).alias("overlap_pct"),
        F.col("a.scheme_name").alias("scheme_a_name"), F.col("b.scheme_name").alias("scheme_b_name"))


def weighted_ter(positions: DataFrame, schemes: DataFrame) -> DataFrame:
    """Value-weighted expense ratios and the yearly fee they mean."""
    owned = (positions.groupBy("portfolio_id", "scheme_code")
             .agg(F.sum(money("value")).cast(MONEY).alias("v")))
    ters = schemes.select("scheme_code", F.col("ter_regular_pct").cast("decimal(9,4)").alias("tr"),
                          F.col("ter_direct_pct").cast("decimal(9,4)").alias("td"))
    zero = F.lit(0).cast("decimal(9,4)")
    g = owned.join(ters, "scheme_code", "left").groupBy("portfolio_id").agg(
        F.sum("v").alias("total"),
        F.sum((F.col("v") * F.coalesce("tr", zero)).cast("decimal(28,6)")).alias("r"),
        F.sum((F.col("v") * F.coalesce("td", zero)).cast("decimal(28,6)")).alias("d"))
    total = F.col("total").cast("double")

    def ratio(c: str) -> Column:
        return F.round(F.try_divide(F.col(c).cast("double"), total).cast("decimal(18,10)"),
                       3).cast("double")

    return g.select(
        "portfolio_id", total.alias("total_value"),
        ratio("r").alias("weighted_ter_regular_pct"), ratio("d").alias("weighted_ter_direct_pct"),
        F.round((F.col("r") / 100).cast("decimal(28,8)"), 0).cast("double")
        .alias("annual_fee_regular"),
        F.round((F.col("d") / 100).cast("decimal(28,8)"), 0).cast("double")
        .alias("annual_fee_direct"))


def xray(positions: DataFrame, holdings: DataFrame, schemes: DataFrame, companies: DataFrame,
         overlap: DataFrame | None = None, month=None) -> dict[str, DataFrame]:
    """All portfolio tables at once; each is lazy and covers every portfolio. ``overlap`` is not read: the overlaps of a
    portfolio are worked out from the holdings of the month."""
    current = in_month(holdings, month)
    owned = valid_positions(positions, current)
    lt = look_through(owned, current)
    return {
        "portfolios": portfolio_status(positions, current),
        "summary": concentration(lt),
        "top_holdings": top_holdings(lt),
        "split": group_split(lt, companies),
        "overlaps": portfolio_overlaps(owned, scheme_company_weights(resolved_equity(current)), schemes),
        "fees": weighted_ter(owned, schemes),
    }


def direct_holdings(direct: DataFrame) -> DataFrame:
    """Value, cost and gain of directly held shares; NULL numbers count as zero."""
    def n(c: str) -> Column:
        return F.coalesce(F.col(c).cast("double"), F.lit(0.0))

    value = F.round((n("quantity").cast(MONEY) * n("ltp").cast(MONEY)), 2).cast(MONEY)
    cost = F.round((n("quantity").cast(MONEY) * n("average_price").cast(EXACT)), 2).cast(MONEY)
    return direct.select("portfolio_id", "isin", "symbol", value.alias("v"), cost.alias("cost"))


def direct_totals(direct: DataFrame) -> DataFrame:
    g = direct_holdings(direct).groupBy("portfolio_id").agg(
        F.sum("v").alias("v"), F.sum("cost").alias("c"))
    return g.select(
        "portfolio_id", F.col("v").cast("double").alias("total_value"),
        F.col("c").cast("double").alias("total_invested"),
        (F.col("v") - F.col("c")).cast("double").alias("total_pnl"),
        rounded(F.try_divide((F.col("v") - F.col("c")).cast("double") * 100,
                             F.col("c").cast("double")), 2).alias("total_pnl_pct"))


def direct_weights(direct: DataFrame) -> DataFrame:
    """Directly held shares as a look-through table: the position is the exposure."""
    h = direct_holdings(direct)
    total = h.groupBy("portfolio_id").agg(F.sum("v").alias("total"))
    return h.join(total.filter(F.col("total") > 0), "portfolio_id").select(
        "portfolio_id", F.col("isin").alias("company_id"), F.lit("equity").alias("asset_class"),
        F.col("symbol").alias("instrument_name_raw"),
        (F.col("v").cast("double") / F.col("total").cast("double") * 100).alias("weight_pct"),
        F.col("v").cast("double").alias("value"))


def direct_xray(direct: DataFrame, companies: DataFrame, dtl: DataFrame) -> dict[str, DataFrame]:
    w = direct_weights(direct)
    risk = dtl.select("isin", "company_name", "days_to_liquidate", "mf_pct_of_free_float")
    return {
        "holdings": w, "totals": direct_totals(direct), "summary": concentration(w),
        "split": group_split(w, companies),
        "crowding": w.select("portfolio_id", F.col("company_id").alias("isin")).distinct()
        .join(risk, "isin"),
    }
