"""Raw feeds (sheets, NAV lines, ticks, statements), written by Spark from the given tables.

They give the parsers whole-table inputs of known content.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.cells import CRORE_RUPEES, LAKH_RUPEES
from ..sources.generate import isin_from
from .views import MONEY, code, companies, holdings, table

RUN_ID = "run-1"
PARSED_AT = dt.datetime(2001, 11, 15, 3, 0, 0)
TYPES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")
# File name stem and value unit of each layout; the last one is not a disclosure.
LAYOUTS = (("bluewater", "(Rs. in Lakhs)", LAKH_RUPEES), ("northstar", "", 1.0),
           ("meridian", "", 1.0), ("kaveri", "(Rs. in Crores)", CRORE_RUPEES),
           ("sentinel", "", 1.0), ("zenith", "(Rs Lakhs)", LAKH_RUPEES), ("harbour", "", 1.0),
           ("memo", "", 1.0))


def brand_no(brand: str = "p_brand") -> Column:
    return F.regexp_extract(brand, r"(\d+)$", 1).cast("int")


def type_no(kind: str = "p_type") -> Column:
    return F.array_position(F.array(*[F.lit(t) for t in TYPES]), F.col(kind))


def listed_isin(brand: str = "p_brand", kind: str = "p_type") -> Column:
    """A valid identifier for a (brand, type) company."""
    number = brand_no(brand) * 10 + type_no(kind)
    return isin_from(F.concat(F.lit("INE"), F.lpad(number.cast("string"), 6, "0"), F.lit("01")))


def split_key(df: DataFrame) -> DataFrame:
    """Brand and type of a company key."""
    return df.withColumn("p_brand", F.split_part("company_id", F.lit("/"), F.lit(1))).withColumn(
        "p_type", F.split_part("company_id", F.lit("/"), F.lit(2)))


def company_isins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifier and brand number of every company key; worked out once per company, not per row."""
    return (split_key(companies(spark, sf_dir).select(F.col("isin").alias("company_id")))
            .select("company_id", listed_isin().alias("isin"), brand_no().alias("brand")))


def listed_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Companies under valid identifiers; promo and economy ones are not listed."""
    c = companies(spark, sf_dir).withColumnRenamed("isin", "company_id")
    return (split_key(c).filter(~F.col("p_type").isin("PROMO", "ECONOMY"))
            .join(company_isins(spark, sf_dir), "company_id").select(
        "isin", "company_name", "nse_symbol", "cap_bucket", "sector", "free_float_shares_cr"))


def bronze(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holdings as filed: spelling variants, blank and unlisted identifiers, refiled rows."""
    h = holdings(spark, sf_dir).join(company_isins(spark, sf_dir), "company_id").withColumn(
        "_turn", (scheme_number() + F.month("disclosure_month") + F.col("brand")) % 7)
    turn = F.col("_turn")
    name = F.col("instrument_name_raw")
    spelled = (F.when(turn == 0, F.concat(name, F.lit(" Ltd.")))
               .when(turn == 1, F.upper(F.concat(name, F.lit(" Limited"))))
               .when(turn == 2, F.concat(F.substring(name, 1, 1), F.substring(name, 3, 40)))
               .when(turn == 3, F.concat(name, F.lit("x - equity shares")))
               .otherwise(name))
    isin = (F.when(turn >= 5, F.col("isin"))
            .when(turn == 4, F.concat(F.lit(" "), F.lower("isin")))
            .when(turn == 3, F.lit("INE000000000")).otherwise(F.lit("-")))
    filed = h.select(
        F.concat(F.lit("Scheme "), "scheme_code", F.lit(" Fund")).alias("scheme_name"),
        spelled.alias("instrument_name_raw"), isin.alias("isin"), "quantity", "market_value",
        F.col("weight_pct").cast("double").alias("weight_pct"),
        F.when(F.col("asset_class") == "debt", "equity").otherwise(F.col("asset_class"))
        .alias("asset_class"),
        F.concat("scheme_code", F.lit(".csv")).alias("source_file"), F.lit("GENERIC").alias("amc_code"),
        F.lit("generic-tabular").alias("adapter"), "disclosure_month", "_turn")
    copies = F.when(F.col("_turn") == 6, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    again = filed.withColumn("_copy", F.explode(copies))
    return again.select(
        *[c for c in filed.columns if c != "_turn"],
        F.concat(F.lit("run-"), F.col("_copy").cast("string")).alias("ingestion_run_id"),
        F.to_timestamp(F.concat(F.lit("2001-12-0"), F.col("_copy").cast("string"),
                                F.lit(" 03:00:00"))).alias("parsed_at"))


def _layout(key: Column, part: int) -> Column:
    return F.element_at(F.array(*[F.lit(x[part]) for x in LAYOUTS]), (key % 8 + 1).cast("int"))


def scheme_number() -> Column:
    return F.substring("scheme_code", 2, 10).cast("int")


def sheet_name() -> Column:
    """Name of the sheet of a scheme and month."""
    return F.concat(_layout(scheme_number(), 0), F.lit("_"), "scheme_code", F.lit("_"),
                    F.date_format("disclosure_month", "yyyyMM"), F.lit(".csv"))


def sheet_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One delimited sheet per scheme and month in eight layouts, as (source_file, row_idx, line).

    Every sheet has a first line, up to twelve pages of legal text, a title, a date, a header, holdings, a total and a footnote.
    Northstar stacks two schemes, each under its own title and header; kaveri and zenith have no title; sentinel has an
    industry in place of the identifier; zenith has its columns in another order; memo is no disclosure.
    """
    h = holdings(spark, sf_dir).join(company_isins(spark, sf_dir), "company_id")
    rows = h.withColumn("key", scheme_number()).withColumn("source_file", sheet_name())
    kind, pages = F.col("key") % 8, F.floor(F.col("key") / 8).cast("int") % 13
    # A sheet has at most one row per company. Its first row brings the lines around the holdings along; texts are made behind
    # the places, so that who asks for places alone gets no texts made.
    sheet = Window.partitionBy("scheme_code", "disclosure_month")
    rows = rows.withColumns({"r": F.row_number().over(sheet.orderBy("company_id")), "n": F.count(F.lit(1)).over(sheet).cast("int"),
                             "pages": F.floor(F.col("key") / 8).cast("int") % 13})
    kind, pages, n, i = F.col("key") % 8, F.col("pages"), F.col("n"), F.col("row_idx")
    upper = F.ceil(n / 2).cast("int")  # holdings of the first scheme of a stacked sheet
    stacked = (kind == 1) & (n > upper)
    end = pages + 4 + n + F.when(stacked, 2).otherwise(0)
    frame = F.concat(F.sequence(F.lit(0), pages + 3), F.array(end, end + 1),
                     F.when(stacked, F.array(pages + 4 + upper, pages + 5 + upper)).otherwise(F.array().cast("array<int>")))
    rows = rows.withColumns({"own": pages + 3 + F.col("r") + F.when(stacked & (F.col("r") > upper), 2).otherwise(0), "end": end})
    own = F.array("own")
    rows = rows.withColumn("row_idx", F.explode(F.when(F.col("r") == 1, F.concat(frame, own)).otherwise(own)))
    holding = i == F.col("own")
    unit = F.concat(F.lit("Market Value "), _layout(F.col("key"), 1))
    text = {"name": (F.col("instrument_name_raw"), F.when(kind == 5, "Security Name").otherwise("Name of the Instrument")),
            "isin": (F.when(kind == 4, F.lit("")).otherwise(F.col("isin")), F.when(kind == 4, "Industry").when(kind == 5, "ISIN Code").otherwise("ISIN")),
            "quantity": (F.format_string('"%,.0f"', F.col("quantity")), F.lit("Quantity")),
            "value": (F.col("market_value").cast(MONEY).cast("string"), unit),
            "weight": (F.concat(F.col("weight_pct").cast("string"), F.when(kind == 2, "%").otherwise("")), F.lit("% to NAV"))}
    rows = rows.withColumns({f"_{c}": F.when(holding, own).otherwise(head) for c, (own, head) in text.items()})
    line = F.when(kind == 5, F.concat_ws(",", "_weight", "_name", "_isin", "_value", "_quantity")).otherwise(
        F.concat_ws(",", "_name", "_isin", "_quantity", "_value", "_weight"))
    title = F.concat(F.lit("Scheme "), "scheme_code", F.when(i > pages + 3, " B").otherwise(""), F.lit("  Fund,,,,"))
    around = (F.when(i == 0, "Monthly portfolio statement").when(i <= pages, F.concat(F.lit("Legal text page "), i.cast("string")))
              .when(i == F.col("end"), "Grand Total,,,1.00,100.0").when(i == F.col("end") + 1, "Notes: figures are rounded,,,,")
              .when(i == pages + 2, "As on month end").when((i == pages + 1) & kind.isin(3, 5), "Position list")
              .when((i == pages + 1) | (i == pages + 4 + upper), title).when(kind == 7, "hello,world"))  # else it is a header
    return rows.select("source_file", "row_idx", F.coalesce(F.when(~holding, around), line).alias("line"))


def nav_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One NAV feed: type headers, AMC headers and four plans per supplier."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")
    big = F.lit(1_000_000_000_000)

    def order(step: Column) -> Column:
        return (F.col("n_regionkey") * 100 + F.col("n_nationkey") + 1) * big + step

    types = (table(spark, sf_dir, "region").select(
        (F.col("r_regionkey") * 100 * big).alias("line_no"),
        F.concat(F.lit("Open Ended Schemes(Equity Scheme - "), "r_name", F.lit(")")).alias("line")))
    amcs = nation.select(order(F.lit(0)).alias("line_no"),
                         F.concat("n_name", F.lit(" Mutual Fund")).alias("line"))
    plans = F.array(*[F.lit(p) for p in (" Fund - Direct Plan - Growth", " Fund - Regular Plan - Growth",
                                         " Fund - Direct Plan - IDCW", " Fund - Regular - Dividend")])
    s = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        "*", F.posexplode(plans).alias("i", "plan"))
    k = F.col("s_suppkey")
    nav = (F.when((k + F.col("i")) % 11 == 0, "N.A.").when((k + F.col("i")) % 13 == 0, "")
           .otherwise(F.greatest(F.col("s_acctbal"), F.lit(1.0)).cast(MONEY).cast("string")))
    isin = F.when(k % 5 == 0, "-").when(k % 5 == 1, "INVALIDISIN").otherwise(
        isin_from(F.concat(F.lit("INF"), F.lpad((k % 1000000).cast("string"), 6, "0"), F.lit("01"))))
    day = F.when(k % 17 == 0, "31-Foo-2001").otherwise("20-Jul-2001")
    full = F.concat_ws(";", (k * 4 + F.col("i")).cast("string"), isin, F.lit("-"),
                       F.concat("s_name", "plan"), nav, day)
    data = s.select(order((k * 4 + F.col("i") + 1).cast("bigint")).alias("line_no"),
                    F.when(k % 19 == 0, F.concat_ws(";", k.cast("string"), "s_name"))
                    .otherwise(full).alias("line"))
    lines = types.unionByName(amcs).unionByName(data)
    return lines.select(F.lit("navall.txt").alias("source_file"),
                        F.floor(F.col("line_no") / 100_000).alias("block"), "line_no", "line")


def tick_company(user: str | Column) -> Column:
    u = F.col(user) if isinstance(user, str) else user
    kind = F.element_at(F.array(*[F.lit(t) for t in TYPES]), (u % 6 + 1).cast("int"))
    return F.concat(F.lit("Brand#"), (u % 25 + 1).cast("string"), F.lit("/"), kind)


def base_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a tick."""
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("E"), F.col("event_id").cast("string")).alias("event_id"),
        tick_company("user_id").alias("isin"), F.col("user_id").cast("string").alias("token"),
        F.col("value").alias("ltp"), (F.col("event_id") % 1_000_000_000).cast("int").alias("seq"),
        F.col("ts").cast("timestamp").alias("event_time"))


def tick_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks as JSON lines: every 20th twice, every 50th with an unreadable line besides."""
    t = base_ticks(spark, sf_dir)
    own = F.to_json(F.struct(
        "event_id", "isin", "token", "ltp", "seq",
        F.date_format("event_time", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("event_time")))
    bad = F.to_json(F.struct("isin", F.lit("NOT_A_NUMBER").alias("ltp"), "seq"))
    lines = F.array(own, F.when(F.col("seq") % 20 == 0, own), F.when(F.col("seq") % 50 == 0, bad))
    return t.select(F.explode(F.array_compact(lines)).alias("json"))


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Splits, bonuses and mergers of the companies, some of them after the as-of day."""
    c = split_key(companies(spark, sf_dir).select(F.col("isin").alias("company_id")))
    b = brand_no()

    def act(cond: Column, day: str, kind: str, ratio: float, new: Column | None = None) -> Column:
        to = F.lit(None).cast("string") if new is None else new
        return F.when(cond, F.struct(
            F.date_add(F.lit(day).cast("date"), b).alias("ex_date"), F.lit(kind).alias("action_type"),
            F.lit(ratio).alias("ratio"), to.alias("new_isin")))

    successor = F.concat("p_brand", F.lit("/MEDIUM"))
    every = F.array_compact(F.array(
        act(b % 3 == 0, "1997-06-15", "split", 2.0), act(b % 4 == 0, "1999-03-10", "bonus", 4.0),
        act((b % 5 == 0) & (F.col("p_type") == "SMALL"), "2000-01-20", "merger", 1.0, successor),
        act(b % 6 == 0, "2005-01-01", "split", 8.0)))
    return c.select(F.col("company_id").alias("isin"), F.explode(every).alias("a")).select(
        "isin", "a.*", F.lit("").alias("note"))


def cap_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two classification lists; the later one moves large companies of even brands to mid."""
    c = companies(spark, sf_dir).filter(F.col("cap_bucket").isNotNull())
    even = F.regexp_extract("sector", r"(\d+)$", 1).cast("int") % 2 == 0
    later = F.when(even & (F.col("cap_bucket") == "large"), "mid").otherwise(F.col("cap_bucket"))
    return c.select("isin", F.explode(F.array(
        F.struct(F.lit(dt.date(1990, 1, 1)).alias("effective_from"), F.col("cap_bucket")),
        F.struct(F.lit(dt.date(1998, 7, 1)).alias("effective_from"), later.alias("cap_bucket")),
    )).alias("l")).select("isin", "l.*")


def candle_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line item as a landed one-bar series of texts; some volumes are unreadable."""
    item = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity")
    volume = F.when(F.col("l_orderkey") % 10 == 0, "n/a").otherwise(
        F.col("l_quantity").cast(MONEY).cast("string"))
    price = F.col("l_extendedprice").cast(MONEY).cast("string")
    bar = F.array(F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss"), price, price, price, price, volume)
    return item.select(code("S", "l_suppkey").alias("isin"), F.to_json(F.array(bar)).alias("json"))


def instrument_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The instrument master as landed records: shares, and every third part a derivative."""
    p = table(spark, sf_dir, "part")
    symbol = F.upper(F.concat_ws("_", "p_brand", "p_type"))
    other = F.col("p_partkey") % 3 == 0
    return p.select(
        F.col("p_partkey").cast("string").alias("token"),
        F.concat(symbol, F.when(other, "-FUT").otherwise("-EQ")).alias("symbol"),
        F.col("p_name").alias("name"), F.when(F.col("p_partkey") % 7 == 0, "BSE").otherwise("NSE")
        .alias("exch_seg"), F.lit("1").alias("lotsize"), F.lit("5.0").alias("tick_size"))


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statement pages: two holding lines of one scheme each, the NAV by line, between personal details."""
    item = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice")
    order = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    j = item.join(order, F.col("l_orderkey") == F.col("o_orderkey"))
    nav = F.lit(10.0) + F.col("l_linenumber")

    def line(units: Column, nav: Column, value: Column) -> Column:
        return F.concat(
            F.lit("\nIN"), F.lpad((F.col("l_suppkey") % 10_000_000_000).cast("string"), 10, "0"), F.lit(" - Scheme "),
            F.col("l_suppkey").cast("string"), F.lit(" Growth   "), F.format_string("%,.3f", units), F.lit("  "),
            F.format_string("%.4f", nav), F.lit("  "), F.format_string("%,.2f", value))

    text = F.concat(
        F.lit("Investor ABCDE1234F me.too@mail.example Folio No: 12/34"),
        line(F.col("l_quantity"), nav, F.col("l_extendedprice")),
        line(F.lit(1.0), nav + 0.5, F.lit(100.0)), F.lit("\nend of page"))
    return j.select(code("P", "o_custkey").alias("statement_id"),
                    (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("page"), text.alias("text"))


def disclosure_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scheme names as disclosures spell them."""
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    name = (F.when(k % 4 == 0, F.concat("s_name", F.lit(" Fund - Direct Plan - Growth")))
            .when(k % 4 == 1, F.concat(F.substring("s_name", 1, 4), F.substring("s_name", 6, 40), F.lit(" Fnd")))
            .when(k % 4 == 2, F.concat(F.lit("Fund "), "s_name", F.lit(" (Regular)")))
            .otherwise(F.concat(F.lit("Zzz Unknown "), k.cast("string"))))
    return s.select(name.alias("scheme_name"))


def filed_holdings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holdings with faults for the gates: unresolved companies and doubled scheme-months."""
    h = holdings(spark, sf_dir)
    turn = (F.substring("scheme_code", 2, 10).cast("int") + F.month("disclosure_month")) % 9
    copies = F.when(turn == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    lost = F.col("instrument_name_raw") == "LARGE Brand#7"
    return h.withColumn("company_id", F.when(~lost, F.col("company_id"))).withColumn(
        "_copy", F.explode(copies)).drop("_copy")


def mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proposed column mappings of every sheet, one of them made up and one empty."""
    sheets = holdings(spark, sf_dir).select("scheme_code", "disclosure_month").distinct().select(sheet_name().alias("source_file"))
    return sheets.select("source_file", F.explode(F.array(
        *[F.struct(F.lit(f).alias("field"), F.lit(c).cast("string").alias("column"))
          for f, c in (("instrument_name", "Name of the Instrument"), ("isin", "ISIN"),
                       ("quantity", "Units Held"), ("market_value", None))])).alias("m")).select(
        "source_file", "m.*")


def customer_isins(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey")
    k = F.col("c_custkey")
    country = F.when(k % 3 == 0, "USA").otherwise("INE")
    body = F.concat(country, F.lpad(k.cast("string"), 8, "0"), (k % 10).cast("string"))
    raw = (F.when(k % 7 == 0, F.lit("N.A.")).when(k % 5 == 0, F.lower(F.concat(
        F.substring(body, 1, 3), F.lit("-"), F.substring(body, 4, 20)))).otherwise(body))
    return c.select("c_custkey", raw.alias("raw"))


def customer_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    k = F.col("c_custkey") % 4
    raw = (F.when(k == 0, F.concat(F.lit("The "), "c_mktsegment", F.lit(" & "), "c_name", F.lit(" Co. Ltd.")))
           .when(k == 1, F.concat("c_name", F.lit("  Private LIMITED - Equity Shares")))
           .when(k == 2, F.concat(F.lit("Holdings of "), "c_mktsegment", F.lit(" Corp, Unlisted")))
           .otherwise(F.col("c_name")))
    return c.select("c_custkey", raw.alias("raw"))


def number_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    k = (F.col("l_orderkey") + F.col("l_linenumber")) % 6
    p = F.col("l_extendedprice").cast(MONEY).cast("string")
    raw = (F.when(k == 0, F.concat(F.lit("₹ "), p)).when(k == 1, F.concat(p, F.lit("%")))
           .when(k == 2, F.concat(F.lit("("), p, F.lit(")"))).when(k == 3, F.lit("--"))
           .when(k == 4, F.format_string("%,.2f", F.col("l_extendedprice"))).otherwise(F.concat(F.lit("x"), p)))
    return item.select("l_orderkey", "l_linenumber", raw.alias("raw"))


def instrument_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    k = F.col("p_partkey") % 8
    tail = (F.when(k == 0, " 7% Bond").when(k == 1, " TREPS").when(k == 2, " Index Future")
            .when(k == 3, " Net Receivables").when(k == 4, " G-Sec").otherwise(""))
    isin = F.when(k == 5, "INE002A01018").when(k == 6, "IN0020200001")
    quantity = F.when(F.col("p_size") > 10, F.col("p_size").cast("double"))
    return p.select("p_partkey", F.concat("p_name", tail).alias("name"), isin.alias("isin"),
                    quantity.alias("quantity"))


def documents_with_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole document texts, some with a tax id and a folio number at the end."""
    k = F.col("doc_id") % 3
    tail = (F.when(k == 0, "\nPAN ABCDE1234F, Folio No: 55/7 ").when(k == 1, "\nmail a.b+c@d-e.example!")
            .otherwise(""))
    return table(spark, sf_dir, "documents").select("doc_id", F.concat("text", tail).alias("text"))


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders as a table with one snapshot per year, the fourth of which replaced all before."""
    o = table(spark, sf_dir, "orders")
    first = o.select(F.min(F.year("o_orderdate"))).scalar()
    rows = o.select("o_orderkey", "o_custkey", (F.year("o_orderdate") - first + 1).alias("snapshot_id"))
    log = rows.groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("added_records")).select(
        "snapshot_id", F.when(F.col("snapshot_id") == 4, "overwrite").otherwise("append")
        .alias("operation"), "added_records")
    return rows, log


