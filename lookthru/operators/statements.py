"""Account statements: personal details out, holdings merged."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.cells import grouped_num
from ..functions.privacy import holding_lines, redact


def redacted(df: DataFrame, col: str) -> DataFrame:
    return df.withColumn(col, redact(F.col(col)))


def statement_holdings(pages: DataFrame, col: str = "text") -> DataFrame:
    """Holdings per (statement_id, isin) from statement pages (statement_id, page, text).

    Texts are redacted before anything is read from them. The same scheme in several
    folios is summed; name and NAV are those of its last line.
    """
    lines = redacted(pages, col).select("statement_id", "page", F.posexplode(
        holding_lines(F.col(col))).alias("at", "h"))
    typed = lines.select(
        "statement_id", F.struct("page", "at").alias("at"), F.col("h.isin").alias("isin"),
        F.col("h.scheme").alias("scheme_name"),
        grouped_num(F.col("h.units")).cast("decimal(24,6)").alias("units"),
        grouped_num(F.col("h.nav")).alias("nav"),
        grouped_num(F.col("h.value")).cast("decimal(24,2)").alias("value"))
    return typed.filter(F.col("value") > 0).groupBy("statement_id", "isin").agg(
        F.max_by("scheme_name", "at").alias("scheme_name"),
        F.sum("units").cast("double").alias("units"), F.max_by("nav", "at").alias("nav"),
        F.sum("value").cast("double").alias("value"))
