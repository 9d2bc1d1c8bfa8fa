"""Identifier and name expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .similarity import let

# Texts that stand for "no identifier" once punctuation is gone.
NO_IDENTIFIER = ("", "NAN", "NONE", "NA", "NIL", "NULL")
# Words that carry no identity in a company name.
NAME_NOISE = r"(?U)\b(equity|shares?|holdings? of|listed|unlisted)\b"
LEGAL_FORMS = ("limited", "ltd", "private", "pvt", "public", "plc", "corporation", "corp",
               "company", "co", "incorporated", "inc", "the")
# Plan and option words, removed from scheme names in this order.
PLAN_WORDS = ("direct plan", "regular plan", "direct", "regular", "growth option", "growth",
              "idcw", "dividend", "payout", "reinvestment", "bonus option", "daily", "weekly",
              "monthly", "quarterly", "option", "plan")

BLOCK_CHARS = 4


def isin_normalise(raw: Column) -> Column:
    """Letters and digits only, upper case; NULL when nothing identifying is left."""
    s = F.upper(F.regexp_replace(raw.cast("string"), "[^A-Za-z0-9]", ""))
    return F.when(~s.isin(*NO_IDENTIFIER), s)


def _check_sum(isin: Column) -> Column:
    # Letters widen to two digits (A=10 ... Z=35), so the parity of a position is
    # known only after widening; hence one pass over the widened digits from the right.
    widened = F.array_join(F.transform(F.split(isin, ""), lambda c: F.when(
        c >= "A", (F.ascii(c) - 55).cast("string")).otherwise(c)), "")

    def contribution(d: Column, i: Column) -> Column:
        v = F.when(d == "", 0).otherwise(d.try_cast("int")) * (1 + i % 2)
        return F.when(v > 9, v - 9).otherwise(v)

    return F.aggregate(F.transform(F.split(F.reverse(widened), ""), contribution), F.lit(0),
                       lambda a, v: a + v)


def valid_isin(raw: Column) -> Column:
    """The normalised identifier if it is well formed and its check digit fits, else NULL."""
    return let(F.upper(F.regexp_replace(raw.cast("string"), "[^A-Za-z0-9]", "")), lambda s: F.when(
        s.rlike("^[A-Z]{2}[A-Z0-9]{9}[0-9]$") & (_check_sum(s) % 10 == 0), s))


def isin_valid(raw: Column) -> Column:
    return valid_isin(raw).isNotNull()


def isin_is_equity(raw: Column) -> Column:
    return F.coalesce(valid_isin(raw).startswith("INE"), F.lit(False))


def squash(text: Column) -> Column:
    """Collapse runs of white space and trim."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def normalise_name(raw: Column) -> Column:
    s = F.lower(F.coalesce(raw.cast("string"), F.lit("")))
    s = F.regexp_replace(s, NAME_NOISE, " ")
    s = F.regexp_replace(s, r"(?U)[^\w\s]", " ")
    words = F.filter(F.split(s, r"(?U)\s+"), lambda w: (w != "") & ~w.isin(*LEGAL_FORMS))
    return F.array_join(words, " ")


def blocking_key(raw: Column) -> Column:
    return F.substring(normalise_name(raw), 1, BLOCK_CHARS)


def canonical_scheme_name(raw: Column) -> Column:
    s = normalise_name(raw)
    for word in PLAN_WORDS:
        s = F.replace(s, F.lit(word), F.lit(" "))
    return squash(s)


def scheme_surrogate(name: Column) -> Column:
    """Stable surrogate key of a scheme name."""
    digest = F.sha1(F.lower(F.trim(name)).cast("binary"))
    return F.concat(F.lit("S"), F.upper(F.substring(digest, 1, 9)))


def month_start(text: Column) -> Column:
    """'2026-06' to the first day of that month; NULL for other texts."""
    return F.try_to_date(F.concat(text, F.lit("-01")), "yyyy-MM-dd")
