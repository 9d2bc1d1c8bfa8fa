"""Entity resolution: raw instrument rows to stable company identities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import identifiers as idf
from .names import best_choices
from .quality import NATURAL_KEY
from .tiles import spread_nulls

COMPANY_THRESHOLD = 88.0
SCHEME_THRESHOLD = 82.0
ANY_BLOCK = "*"


def best_match(names: DataFrame, choices: DataFrame, threshold: float,
               blocked: bool = False) -> DataFrame:
    """Best choice at or above the threshold for each name, exactly (see ``names.best_choices``).

    A hair is taken off the threshold, so that float error loses nothing at it.
    """
    return best_choices(names, choices, (threshold - 1e-9) / 100, blocked).drop("scored")


def resolve_names(names: DataFrame, companies: DataFrame,
                  threshold: float = COMPANY_THRESHOLD) -> DataFrame:
    """Match distinct normalised names: inside the block of their first letters, or
    against every company if no company is in that block."""
    block = F.substring("n", 1, idf.BLOCK_CHARS)
    choices = (companies.select(idf.normalise_name(F.col("company_name")).alias("n"), "isin")
               .filter(F.col("n") != "").groupBy("n").agg(F.min("isin").alias("isin")))
    # Each choice stands in its own block and in the common one for names without a block.
    placed = choices.select("n", F.explode(F.array(block, F.lit(ANY_BLOCK))).alias("block"))
    known = placed.select("block").distinct().withColumn("_known", F.lit(True))
    mine = (names.select("n", block.alias("block")).join(known, "block", "left")
            .select("n", F.when(F.col("_known"), F.col("block")).otherwise(ANY_BLOCK).alias("block")))
    return (best_match(mine, placed, threshold, blocked=True)
            .join(choices.withColumnRenamed("n", "match"), "match")
            .select("n", F.col("isin").alias("fuzzy_isin"), "score"))


def resolve_entities(bronze: DataFrame, companies: DataFrame,
                     threshold: float = COMPANY_THRESHOLD) -> DataFrame:
    """Add company_id, resolution_method and resolution_confidence.

    Ladder: listed ISIN 1.0, valid but unlisted ISIN 0.9, name match by its score,
    otherwise unresolved 0.0. An identifier and a name as they are spelled are checked, normalised and matched
    once, however many rows have them; the rows only look them up.
    """
    isin, name = F.col("isin").cast("string"), F.col("instrument_name_raw").cast("string")
    told = F.coalesce(isin.rlike("[A-Za-z0-9]"), F.lit(False)) | F.coalesce(name.rlike(r"(?U)\w"), F.lit(False))

    def key(text: Column) -> Column:
        return F.coalesce(F.concat(F.lit("="), text), F.lit(""))

    keys = (key(isin).alias("_isin_key"),
            spread_nulls(F.when(told, key(name)), "source_file", "instrument_name_raw").alias("_name_key"))
    spelled = bronze.select(isin.alias("isin"), name.alias("name")).distinct()
    cleaned = spelled.select(key(F.col("isin")).alias("_isin_key"), key(F.col("name")).alias("_name_key"),
                             idf.valid_isin(F.col("isin")).alias("_isin"), idf.normalise_name(F.col("name")).alias("_n"))
    asked = F.when(F.col("_isin").isNull() & (F.col("_n") != ""), F.col("_n"))
    names = cleaned.select(asked.alias("n")).filter("n is not null").distinct()
    matched = resolve_names(names, companies, threshold).withColumnRenamed("n", "_asked")
    listed = companies.select(F.col("isin").alias("_listed")).distinct()
    # Many spellings may have no valid identifier, or no name to ask for.
    known = (cleaned.withColumns({"_own": spread_nulls(F.col("_isin"), "_name_key"), "_asked": spread_nulls(asked, "_isin_key", "_name_key")})
             .join(listed, F.col("_own") == F.col("_listed"), "left").join(matched, "_asked", "left"))
    method = (F.when(F.col("_listed").isNotNull(), "isin")
              .when(F.col("_isin").isNotNull(), "isin_unmapped")
              .when(F.col("fuzzy_isin").isNotNull(), "fuzzy_name"))
    confidence = (F.when(F.col("_listed").isNotNull(), F.lit(1.0))
                  .when(F.col("_isin").isNotNull(), F.lit(0.9)).otherwise(F.col("score")))
    known = known.select("_isin_key", "_name_key", F.coalesce("_isin", "fuzzy_isin").alias("_company"),
                         method.alias("_method"), confidence.alias("_confidence")).filter("_method is not null")
    return bronze.select("*", *keys).join(known, ["_isin_key", "_name_key"], "left").select(
        *bronze.columns, F.col("_company").alias("company_id"),
        F.coalesce("_method", F.lit("unresolved")).alias("resolution_method"),
        F.coalesce("_confidence", F.lit(0.0)).alias("resolution_confidence"))


def demote_unresolved(df: DataFrame, companies: DataFrame | None = None) -> DataFrame:
    """Equity candidates that are not a listed company become 'other'.

    Rows of ``resolve_entities`` tell it by their method; for others the companies are given.
    """
    if companies is None:
        cls = F.when((F.col("asset_class") == "equity") & ~F.col("resolution_method").isin("isin", "fuzzy_name"), "other").otherwise(F.col("asset_class"))
        return df.withColumn("asset_class", cls)
    listed = companies.select(F.col("isin").alias("company_id"),
                              F.lit(True).alias("_ok")).distinct()
    cls = (F.when((F.col("asset_class") == "equity") & F.col("_ok").isNull(), "other")
           .otherwise(F.col("asset_class")))
    cols = [cls.alias("asset_class") if c == "asset_class" else F.col(c) for c in df.columns]
    key = spread_nulls(F.col("company_id"), *df.columns)
    return (df.withColumn("_key", key).join(
        listed.withColumnRenamed("company_id", "_key"), "_key", "left").select(*cols))


def dedup_latest(df: DataFrame, key: tuple[str, ...] = NATURAL_KEY) -> DataFrame:
    """Latest parsed row per natural key, ties by file and run.

    An aggregate rather than a window: copies are dropped before the shuffle, so a key
    with very many copies costs one row per task.
    """
    rest = [c for c in df.columns if c not in key]
    rank = F.struct("parsed_at", "source_file", "ingestion_run_id", F.xxhash64(*rest))
    return (df.groupBy(*key).agg(F.max_by(F.struct(*rest), rank).alias("_r"))
            .select(*key, "_r.*").select(*df.columns))


def build_silver(bronze: DataFrame, companies: DataFrame,
                 threshold: float = COMPANY_THRESHOLD) -> DataFrame:
    keyed = bronze.withColumn("scheme_code", idf.scheme_surrogate(F.col("scheme_name")))
    resolved = resolve_entities(keyed, companies, threshold)
    return dedup_latest(demote_unresolved(resolved))


def scheme_master(nav: DataFrame) -> DataFrame:
    """One row per underlying scheme; a growth plan gives the identity.

    Identity columns each take their first non-null value in the order growth first,
    then scheme code.
    """
    named = nav.select("*", idf.canonical_scheme_name(F.col("scheme_name")).alias("canonical_name"))
    rank = F.struct((~F.coalesce("is_growth", F.lit(False))).alias("r"),
                    F.col("scheme_code").alias("c"), F.col("scheme_name").alias("s"))

    def first(col: str) -> Column:
        return F.min_by(col, F.when(F.col(col).isNotNull(), rank)).alias(col)

    return named.groupBy("canonical_name").agg(
        first("scheme_code"), first("scheme_name"), first("amc_name"), first("category"),
        F.count("scheme_code").alias("plans"))


def match_schemes(names: DataFrame, master: DataFrame, threshold: float = SCHEME_THRESHOLD) -> DataFrame:
    """Match disclosure scheme names (column ``scheme_name``) to the scheme master.

    Every name is kept with its best score over all master rows, 0 if there is nothing to compare. A
    name below the threshold has a score, but no match.
    """
    raw = names.select(F.col("scheme_name").alias("disclosure_scheme_name")).distinct().withColumn(
        "n", idf.canonical_scheme_name(F.col("disclosure_scheme_name")))
    choices = master.select(F.col("canonical_name").alias("n")).filter(F.col("n") != "").distinct()
    best = best_choices(raw.select("n").filter(F.col("n") != "").distinct(), choices)
    hits = best.select("n", "score", F.when(F.col("score") * 100 >= threshold - 1e-9, F.col("match")).alias("match"))
    info = master.select(F.col("canonical_name").alias("match"), "scheme_code",
                         F.col("scheme_name").alias("matched_name"), "amc_name", "category")
    out = raw.join(hits, "n", "left").join(info, "match", "left")
    return out.select("disclosure_scheme_name", F.col("n").alias("canonical_name"),
                      "scheme_code", "matched_name", "amc_name", "category",
                      F.coalesce("score", F.lit(0.0)).alias("match_score"), F.col("match").isNotNull().alias("matched"))


def ingest_stats(silver: DataFrame) -> DataFrame:
    """One row of counts per ingestion run."""
    equity = F.col("asset_class") == "equity"
    return silver.groupBy("ingestion_run_id").agg(
        F.countDistinct("source_file").alias("files_parsed"),
        F.countDistinct("scheme_code").alias("schemes"),
        F.count(F.lit(1)).alias("silver_rows"),
        F.count(F.when(equity, 1)).alias("equity_rows"),
        F.coalesce(F.round(F.try_divide(
            F.count(F.when(equity, F.col("company_id"))).cast("double"),
            F.count(F.when(equity, 1))).cast("decimal(18,10)"), 4).cast("double"),
            F.lit(0.0)).alias("resolution_rate"))


def method_counts(silver: DataFrame) -> DataFrame:
    return silver.groupBy("ingestion_run_id", "resolution_method").agg(
        F.count(F.lit(1)).alias("rows"))
