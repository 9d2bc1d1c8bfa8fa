"""NAV feed: semicolon lines with interleaved section headers."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.identifiers import isin_valid
from ..operators.ordered import fill_forward
from ..schemas import FACT_NAV, conform

FIELDS = ("scheme_code", "isin_growth", "isin_reinvest", "scheme_name", "nav", "nav_date")
# Texts that mark a scheme-type line, the header line and missing values.
SCHEME_TYPE_MARK = r"Schemes\(|Scheme\(s\)\(|Schemes \("
HEADER_MARK = "Scheme Code"
NO_ISIN = ("-", "")
NO_NAV = ("N.A.", "")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files with an order, read in parallel even within one file.

    The order inside a file is (start of the file split, row id): row ids grow along a
    split, because one task reads it from front to back.
    """
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("source_file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line_no"), F.col("value").alias("line"))


def parse_nav(lines: DataFrame, ingested_at: dt.datetime) -> tuple[DataFrame, DataFrame]:
    """(clean, quarantine). Every data line lands in exactly one of the two.

    Quarantine keeps the line as read with its reason: too few fields, or no readable
    NAV or date.
    """
    text = F.trim(F.regexp_replace("line", r"(?U)^\s+|\s+$", ""))
    body = lines.withColumn("line", text).filter(
        (F.col("line") != "") & ~F.col("line").startswith(HEADER_MARK))
    bare = ~F.col("line").contains(";")
    is_type = F.col("line").rlike(SCHEME_TYPE_MARK)
    marked = body.select(
        "source_file", "block", "line_no", "line",
        F.when(bare & is_type, F.col("line")).alias("_type"),
        F.when(bare & ~is_type, F.col("line")).alias("_amc"))
    data = fill_forward(marked, ["source_file"], "block", ["line_no"],
                        {"scheme_type": "_type", "amc_name": "_amc"}).filter(~bare)
    parts = F.split("line", ";")
    typed = data.select(
        "source_file", "line", F.size(parts).alias("_fields"), "amc_name", "scheme_type",
        *[F.get(parts, i).alias(f) for i, f in enumerate(FIELDS)])

    def isin(c: str) -> Column:
        return F.when(~F.col(c).isin(*NO_ISIN), F.col(c))

    nav = F.when(~F.col("nav").isin(*NO_NAV), F.trim("nav")).try_cast("double")
    day = F.try_to_date(F.trim("nav_date"), "dd-MMM-yyyy")
    name = F.lower(F.coalesce("scheme_name", F.lit("")))
    last_group = F.regexp_extract("scheme_type", r"\(([^()]*)\)[^()]*$", 1)
    full = typed.select(
        "source_file", "line", "_fields", "scheme_code", isin("isin_growth").alias("isin_growth"),
        isin("isin_reinvest").alias("isin_reinvest"), "scheme_name", nav.alias("nav"),
        day.alias("nav_date"), "amc_name", "scheme_type",
        isin_valid(isin("isin_growth")).alias("isin_growth_valid"),
        isin_valid(isin("isin_reinvest")).alias("isin_reinvest_valid"),
        F.when(name.rlike(r"(?U)\bdirect\b"), "direct").otherwise("regular").alias("plan_type"),
        name.contains("growth").alias("is_growth"),
        F.when(F.col("scheme_type").contains("("), F.trim(last_group)).alias("category"))
    reason = (F.when(F.col("_fields") < len(FIELDS), "fewer than 6 fields")
              .when(F.col("nav").isNull(), "no NAV")
              .when(F.col("nav_date").isNull(), "no date"))
    judged = full.withColumn("reason", reason)
    clean = judged.filter(F.col("reason").isNull()).withColumn("ingested_at", F.lit(ingested_at))
    quarantine = judged.filter(F.col("reason").isNotNull()).select(
        "source_file", "line", "amc_name", "scheme_type", "reason")
    return conform(clean, FACT_NAV), quarantine
