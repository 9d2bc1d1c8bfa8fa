"""Links to disclosure files and manifests of landed ones."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Fixed value: links to files that can hold a disclosure.
FILE_LINK = r"""(?i)href=["']([^"']+\.(?:xlsx|xls|csv|zip|pdf))["']"""
ANY_LINK = r"""(?i)href=["']([^"']+)["']"""


def absolute_url(base: Column, link: Column) -> Column:
    """Join a link to the address of its page, resolving '.' and '..' steps."""
    bare = F.regexp_replace(base, r"[?#].*$", "")
    site = F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/]*)", 1)
    scheme = F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    path = F.substring(bare, F.length(site) + 1, F.length(bare))
    folder = F.regexp_replace(path, r"[^/]*$", "")
    tail = F.regexp_extract(link, r"([?#].*)$", 1)
    target = F.regexp_replace(link, r"[?#].*$", "")
    steps = F.split(F.when(target.startswith("/"), target).otherwise(
        F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), target)), "/")

    def walk(done: Column, step: Column) -> Column:
        up = F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1)))
        return (F.when(step == ".", done).when(step == "..", up)
                .otherwise(F.concat(done, F.array(step))))

    start = F.array().cast("array<string>")
    ends_dir = F.when(F.element_at(steps, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(start)
    walked = F.array_join(F.concat(F.aggregate(steps, start, walk), ends_dir), "/")
    return (F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), link)
            .when(link.startswith("//"), F.concat(scheme, link))
            .when(link.startswith("#"), F.concat(F.regexp_replace(base, r"#.*$", ""), link))
            .when(link.startswith("?"), F.concat(bare, link))
            .otherwise(F.concat(site, walked, tail)))


def page_links(pages: DataFrame, pattern: str = FILE_LINK) -> DataFrame:
    """Distinct absolute links per page (columns url, html), matched in the whole page."""
    found = pages.select("page_id", "url", F.explode(
        F.array_distinct(F.regexp_extract_all("html", F.lit(pattern), F.lit(1)))).alias("href"))
    return found.select("page_id", absolute_url(F.col("url"), F.col("href")).alias("link")).distinct()


def content_manifest(contents: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """One row per content (columns file, content): name, bytes, content hash, number of equal contents.

    With ``expected`` (column file) missing files are rows with status 'failed'. Contents are
    hashed where they are; only the digests are shuffled.
    """
    landed = contents.select("file", F.octet_length("content").cast("bigint").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    copies = landed.groupBy("sha256").agg(F.count(F.lit(1)).alias("copies"))
    found = landed.join(copies, "sha256").select(
        "file", F.lit("landed").alias("status"), "sha256", "bytes", "copies")
    if expected is None:
        return found
    missing = expected.select("file").join(landed, "file", "left_anti").select(
        "file", F.lit("failed").alias("status"), F.lit(None).cast("string").alias("sha256"),
        F.lit(0).cast("bigint").alias("bytes"), F.lit(0).cast("bigint").alias("copies"))
    return found.unionByName(missing)


def file_manifest(spark: SparkSession, path: str, expected: DataFrame | None = None) -> DataFrame:
    """The manifest of the files below a folder; a file may have up to 2 GB."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return content_manifest(read.select(F.url_decode(F.element_at(F.split("path", "/"), -1)).alias("file"), "content"), expected)


def manifest_totals(manifest: DataFrame, *keys: str) -> DataFrame:
    """Landed, failed and total bytes per key, for example per month."""
    return manifest.groupBy(*keys).agg(
        F.count(F.when(F.col("status") == "landed", 1)).alias("landed"),
        F.count(F.when(F.col("status") == "failed", 1)).alias("failed"),
        F.sum("bytes").alias("total_bytes"))


def month_spine(spark: SparkSession, start: dt.date, end: dt.date) -> DataFrame:
    """First day of every month from start to end, both included."""
    return spans_to_months(spark.range(1).select(
        F.lit(start).alias("start"), F.lit(end).alias("end")))


def spans_to_months(spans: DataFrame) -> DataFrame:
    months = F.sequence(F.trunc("start", "month"), F.trunc("end", "month"),
                        F.expr("interval 1 month"))
    keep = [c for c in spans.columns if c not in ("start", "end")]
    return spans.select(*keep, F.explode(months).alias("month"))
