"""Whole-pipeline jobs: monthly ingest, backfill, gold marts, publication."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.identifiers import month_start
from ..operators import marts, overlap, quality, resolve
from ..operators.corporate import adjust_holdings, read_actions
from ..operators.disclosure import ADAPTERS, Adapter, parse_disclosures
from ..sources import sinks
from ..sources.grid import cell_grid
from ..sources.market import instrument_dim, read_instruments

WAREHOUSE = ("silver_holdings", "dim_scheme", "dim_company", "fact_price")


OUTSIDE = "outside the asked months"


class NothingParsed(RuntimeError):
    """No file, or no row in any file, could be read."""


def silver_of(bronze: DataFrame, companies: DataFrame, actions: DataFrame | None = None,
              as_of: dt.date | None = None) -> DataFrame:
    """Silver of all given bronze rows, of however many runs: the latest parse per key.

    With actions, quantities are restated to ``as_of``.
    """
    silver = resolve.build_silver(bronze, companies)
    return silver if actions is None else adjust_holdings(silver, actions, as_of or dt.date.today())


def ingest(grid: DataFrame, companies: DataFrame, months: DataFrame, run_id: str,
           parsed_at: dt.datetime, actions: DataFrame | None = None, as_of: dt.date | None = None,
           adapters: tuple[Adapter, ...] = ADAPTERS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(bronze, silver, file status) of any number of files and months in one plan.

    ``months`` gives the disclosure month of each source_file, and may give a reason why a
    file is left out. A file that is left out or has no month gives no rows, and its
    status says so.
    """
    bronze, status = parse_disclosures(grid, dt.date(1970, 1, 1), run_id, parsed_at, adapters)
    cols = bronze.columns
    if "left_out" not in months.columns:
        months = months.withColumn("left_out", F.lit(None).cast("string"))
    months = months.select("source_file", "disclosure_month", F.coalesce(
        "left_out", F.when(F.col("disclosure_month").isNull(), "no month")).alias("left_out"))
    dated = (bronze.drop("disclosure_month").join(
        months.filter("left_out is null").select("source_file", "disclosure_month"), "source_file").select(*cols))
    told = status.join(months, "source_file", "left").withColumn(
        "left_out", F.when(F.col("disclosure_month").isNull(), F.coalesce("left_out", F.lit("no month")))
        .otherwise(F.col("left_out")))
    told = told.select(
        *[c for c in status.columns if c not in ("status", "reason")],
        F.when(F.col("left_out") == OUTSIDE, "skipped").when(F.col("left_out").isNotNull(), "quarantined")
        .otherwise(F.col("status")).alias("status"), F.coalesce("left_out", "reason").alias("reason"), "disclosure_month")
    return dated, silver_of(dated, companies, actions, as_of), told


def month_of_file(grid: DataFrame, month: dt.date | None = None, start: dt.date | None = None,
                  end: dt.date | None = None) -> DataFrame:
    """Month of each file, the given one or the yyyymm or yyyy-mm in its name, and why it is left out
    (no month, or outside of ``start`` to ``end``)."""
    files = grid.select("source_file").distinct()
    named = F.try_to_date(F.concat(F.regexp_extract("source_file", r"(\d{6})(?=\D*$)", 1), F.lit("01")),
                          "yyyyMMdd")
    named = F.coalesce(named, month_start(F.regexp_extract("source_file", r"(\d{4}-\d{2})(?=\D*$)", 1)))
    out = files.select("source_file", (named if month is None else F.lit(month)).alias("disclosure_month"))
    m = F.col("disclosure_month")
    outside = (m < F.lit(start) if start is not None else F.lit(False)) | (
        m > F.lit(end) if end is not None else F.lit(False))
    return out.withColumn("left_out", F.when(m.isNull(), "no month").when(outside, OUTSIDE))


def run_files(spark: SparkSession, src: str, out: str, companies: DataFrame, run_id: str,
              parsed_at: dt.datetime, month: dt.date | None = None,
              start: dt.date | None = None, end: dt.date | None = None, strict: bool = True,
              actions: DataFrame | str | None = None, as_of: dt.date | None = None) -> dict[str, int]:
    """Ingest a folder: one month, or with no month all months found in the file names.

    Bronze and file status are kept by month and run, so a run adds to what others left and
    only replaces itself: months that a repeated run no longer has lose its old rows. Silver of
    the touched months is then built from all their bronze rows: a refiled scheme replaces its
    own rows and leaves all others.

    The newest filing of a scheme-month counts, even if it fails a gate: its rows go to
    the quarantine, kept by month and judging run, and silver has no older rows in their place. Others
    aren't held up, and a month of which nothing passes has no silver folder.

    ``actions`` may be a table or the path of a delimited file. If no file can be read, file status is written, which says
    why, but neither bronze nor silver is touched.
    """
    by_run = ("disclosure_month", "ingestion_run_id")
    if isinstance(actions, str):
        actions = read_actions(spark, actions)
    grid = cell_grid(spark, src)
    months = month_of_file(grid, month, start, end)
    bronze, _, status = ingest(grid, companies, months, run_id, parsed_at)
    told_at, bronze_at, silver_at = f"{out}/file_status", f"{out}/bronze_holdings", f"{out}/silver_holdings"
    _, stale = sinks.rewrite_by(status, told_at, ("disclosure_month", "run_id"), {"run_id": {run_id}})
    sinks.drop_folders(spark, stale)
    told = spark.read.schema(status.schema).parquet(told_at).filter(F.col("run_id") == run_id)
    if told.filter(F.col("status") == "parsed").isEmpty():
        raise NothingParsed(f"no file parsed from {src}")
    # Silver is read back from the written bronze, so files are parsed once.
    written, stale = sinks.rewrite_by(bronze, bronze_at, by_run, {"ingestion_run_id": {run_id}})
    if not written:
        raise NothingParsed(f"no rows parsed from {src}")
    sinks.drop_folders(spark, stale)
    touched = {values[0] for values in [*written, *stale]}
    every = spark.read.schema(bronze.schema).parquet(bronze_at)
    here = every.filter(F.col("disclosure_month").isin([dt.date.fromisoformat(m) for m in touched]))
    silver = silver_of(here, companies, actions, as_of)
    good, bad = quality.promotable(silver) if strict else (silver, None)
    _, stale = sinks.rewrite_by(good, silver_at, ("disclosure_month",), {"disclosure_month": touched})
    sinks.drop_folders(spark, stale)
    counts = {"files": told.count(), "silver_rows": spark.read.schema(good.schema).parquet(silver_at).filter(
        F.col("ingestion_run_id") == run_id).count()}
    if bad is not None:
        judged = bad.withColumn("judged_by", F.lit(run_id))
        bad_at, by_judge = f"{out}/quarantine_holdings", ("disclosure_month", "judged_by")
        _, stale = sinks.rewrite_by(judged, bad_at, by_judge, {"judged_by": {run_id}})
        sinks.drop_folders(spark, stale)
        counts["quarantined_rows"] = spark.read.schema(judged.schema).parquet(bad_at).filter(F.col("judged_by") == run_id).count()
    return counts


def published_order() -> dict[str, tuple]:
    """The order of the published tables: a reader of one scheme or of the first rows opens few row groups."""
    return {"schemes": ("scheme_name", "scheme_code"), "holdings": ("scheme_code", "company_id"),
            "holdings_history": ("disclosure_month", "scheme_code", "company_id"),
            "active_share": ("active_share_pct", "scheme_code"), "style_drift": ("scheme_code", "disclosure_month"),
            "turnover": ("scheme_code", "disclosure_month"), "overlap": ("s1", "s2"),
            "crowding": (F.col("value_cr").desc_nulls_last(), F.col("isin")),
            "dtl": (F.col("days_to_liquidate").desc_nulls_last(), F.col("isin"))}


def gold(holdings: DataFrame, schemes: DataFrame, companies: DataFrame, prices: DataFrame,
         benchmark: DataFrame, as_of: dt.date, caps: DataFrame | None = None) -> dict[str, DataFrame]:
    """The thirteen published tables as lazy DataFrames. Overlap is the sparse table of pairs that share a company; the
    square matrix is made for the schemes one asks for (``overlap.overlap_full``)."""
    crowd = marts.crowding(holdings, schemes, companies)
    dtl = marts.days_to_liquidate(crowd, prices)
    return {
        "holdings": overlap.in_month(holdings), "holdings_history": holdings, "schemes": schemes,
        "companies": companies, "prices": prices, "overlap": overlap.overlap_pairs(holdings),
        "active_share": marts.active_share(holdings, benchmark, schemes),
        "style_drift": marts.style_drift(holdings, companies if caps is None else caps,
                                         effective_dated=caps is not None),
        "turnover": marts.turnover_full(holdings), "crowding": crowd, "dtl": dtl,
        "quality": quality.dq_report(holdings, dtl, as_of),
        "meta": holdings.agg(F.max("disclosure_month").alias("disclosure_month")).select(
            "disclosure_month", F.lit(as_of).alias("built_at"),
            F.lit(marts.PARTICIPATION).alias("participation_rate")),
    }


def publish_gold(spark: SparkSession, warehouse: str, out: str, benchmark: DataFrame,
                 as_of: dt.date, instruments: str | None = None) -> dict[str, int]:
    """Open the warehouse, build every mart and write it; returns row counts. With the path of an exchange's instrument records
    a table of the companies' tokens is published too."""
    t = sinks.required_tables(spark, warehouse, list(WAREHOUSE))
    tokens = {} if instruments is None else {"instruments": instrument_dim(read_instruments(spark, instruments), t["dim_company"])}
    return sinks.publish(tokens | gold(t["silver_holdings"], t["dim_scheme"], t["dim_company"],
                              t["fact_price"], benchmark, as_of), out, order=published_order())
