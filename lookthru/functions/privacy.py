"""Redaction and extraction over statement texts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .similarity import let

# What is hidden, in this order, and by what. Word boundaries cost most, so they are looked at behind letters
# that few places have.
TAX_ID = (r"(?U)[A-Z]{5}(?<=\b[A-Z]{5})\d{4}[A-Z]\b", "[PAN REDACTED]")
EMAIL = (r"(?U)\b[\w.+-]++@[\w-]+\.[\w.]+\b", "[EMAIL REDACTED]")
FOLIO = (r"(?iU)Folio No(?<=\bFolio No)[:.]?\s*([\w/\- ]+)", "Folio No: [REDACTED]")
# Fixed value: one holding line of a statement (isin, scheme, units, nav, value).
HOLDING_LINE = (r"(?U)(IN[A-Z0-9]{10})\s*[-–]\s*(.+?)\s+([\d,]+\.\d+)\s+([\d,]+\.\d+)\s+"
                r"([\d,]+\.\d{2})")


def redact(text: Column) -> Column:
    for pattern, shown in (TAX_ID, EMAIL, FOLIO):
        text = F.regexp_replace(text, pattern, shown)
    return text


def holding_lines(text: Column) -> Column:
    """Array of structs, one per holding line found anywhere in the text.

    The long text is searched once; the parts of a found line are cut from it.
    """
    def cut(line: Column) -> Column:
        plain = F.regexp_replace(line, r"(?U)\s+", " ")  # a split by a pattern would compile it for every line
        words = F.split(F.ltrim(F.substr(F.ltrim(F.substr(plain, F.lit(13))), F.lit(2))), " ")
        return let(words, lambda w: F.struct(
            F.substring(line, 1, 12).alias("isin"),
            F.array_join(F.slice(w, 1, F.size(w) - 3), " ").alias("scheme"),
            F.element_at(w, -3).alias("units"), F.element_at(w, -2).alias("nav"),
            F.element_at(w, -1).alias("value")))

    return F.transform(F.regexp_extract_all(text, F.lit(HOLDING_LINE), F.lit(0)), cut)
