"""Declared table schemas and conformance to them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

_S, _D, _I, _B = T.StringType(), T.DoubleType(), T.IntegerType(), T.BooleanType()
_DATE, _TS = T.DateType(), T.TimestampType()


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


CELL_GRID = _struct(("source_file", _S), ("table_no", _I), ("row_idx", _I),
                    ("cells", T.ArrayType(_S)))

RAW_HOLDING = _struct(
    ("scheme_name", _S), ("instrument_name_raw", _S), ("isin", _S), ("quantity", _D),
    ("market_value", _D), ("weight_pct", _D), ("asset_class", _S), ("source_file", _S))

BRONZE_HOLDING = T.StructType(RAW_HOLDING.fields + _struct(
    ("amc_code", _S), ("adapter", _S), ("disclosure_month", _DATE),
    ("ingestion_run_id", _S), ("parsed_at", _TS)).fields)

SILVER_HOLDING = T.StructType(BRONZE_HOLDING.fields + _struct(
    ("scheme_code", _S), ("company_id", _S), ("resolution_method", _S),
    ("resolution_confidence", _D)).fields)

DIM_SCHEME = _struct(
    ("scheme_code", _S), ("scheme_name", _S), ("amc_code", _S), ("amc_name", _S),
    ("category", _S), ("benchmark", _S), ("ter_regular_pct", _D), ("ter_direct_pct", _D),
    ("aum_cr", _D))

DIM_COMPANY = _struct(
    ("company_name", _S), ("isin", _S), ("nse_symbol", _S), ("smartapi_token", _S),
    ("cap_bucket", _S), ("sector", _S), ("free_float_shares_cr", _D))

CAP_CLASSIFICATION = _struct(("isin", _S), ("cap_bucket", _S), ("effective_from", _DATE))

FACT_NAV = _struct(
    ("scheme_code", _S), ("isin_growth", _S), ("isin_reinvest", _S), ("scheme_name", _S),
    ("nav", _D), ("nav_date", _DATE), ("amc_name", _S), ("scheme_type", _S),
    ("isin_growth_valid", _B), ("isin_reinvest_valid", _B), ("plan_type", _S),
    ("is_growth", _B), ("category", _S), ("ingested_at", _TS))

FACT_PRICE = _struct(
    ("isin", _S), ("nse_symbol", _S), ("smartapi_token", _S), ("close", _D),
    ("adv_shares_30d", _D), ("source", _S))

DIM_INSTRUMENT = _struct(("isin", _S), ("nse_symbol", _S), ("company_name", _S),
                         ("smartapi_token", _S))

CORP_ACTION = _struct(("isin", _S), ("ex_date", _DATE), ("action_type", _S), ("ratio", _D),
                      ("new_isin", _S), ("note", _S))

CANDLE = _struct(("isin", _S), ("timestamp", _TS), ("open", _D), ("high", _D), ("low", _D),
                 ("close", _D), ("volume", _D))

TICK = _struct(("event_id", _S), ("isin", _S), ("token", _S), ("ltp", _D), ("seq", _I),
               ("event_time", _TS))

ASSET_CLASSES = ("equity", "debt", "cash", "derivative", "reit", "other")
WEIGHT_RANGE = (-100.0, 110.0)

# Weights and money are summed exactly, in this type; doubles only leave at the end.
EXACT = T.DecimalType(18, 6)
# Void columns with these name endings become double, all others string (fixed values).
NUMERIC_SUFFIXES = ("_value", "_pct", "quantity", "confidence")


def conform(df: DataFrame, schema: T.StructType | None = None) -> DataFrame:
    """Cast to ``schema``, adding missing columns as typed NULLs.

    Without a schema: give VOID columns a concrete type by name ending and turn
    zone-less timestamps into TIMESTAMP, so that every reader can open the result.
    """
    if schema is not None:
        have = set(df.columns)
        return df.select(*[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields])
    out = []
    for f in df.schema.fields:
        col = F.col(f.name)
        if isinstance(f.dataType, T.NullType):
            col = col.cast("double" if f.name.endswith(NUMERIC_SUFFIXES) else "string")
        elif isinstance(f.dataType, T.TimestampNTZType):
            col = col.cast("timestamp")
        out.append(col.alias(f.name))
    return df.select(*out)


class UnreadableTypes(ValueError):
    """A column has a type that not every reader of the lake can open."""


def assert_readable(df: DataFrame) -> DataFrame:
    bad = [f"{f.name}: {f.dataType.simpleString()}" for f in df.schema.fields
           if isinstance(f.dataType, (T.NullType, T.TimestampNTZType))]
    if bad:
        raise UnreadableTypes("; ".join(bad))
    return df


def violations(holdings: DataFrame) -> DataFrame:
    """Rows breaking the record contract: weight range or unknown asset class."""
    low, high = WEIGHT_RANGE
    return holdings.filter(
        ~F.col("weight_pct").between(low, high)
        | ~F.col("asset_class").isin(*ASSET_CLASSES))
