"""Writers: partitioned tables without stale folders, ordered tables, marts with counts, compaction by size."""

from __future__ import annotations

from itertools import product
from urllib.parse import unquote

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window, functions as F

from ..schemas import assert_readable, conform


#: How Spark names the folder of a null (fixed value).
NULL_FOLDER = "__HIVE_DEFAULT_PARTITION__"


def _metrics(seen: Observation) -> dict:
    """What was observed during a write that has ended; nothing if its rows turned out to be none while it was planned."""
    try:
        return seen.get
    except Py4JJavaError:
        return {}


def write_by(df: DataFrame, path: str, *keys: str) -> None:
    """Write one folder per value of ``keys``; folders of values not in ``df`` stay as they are.

    Rebalance rather than repartition: rows of a folder come together, but one far
    larger than the rest is split over several tasks and files.
    """
    (assert_readable(conform(df)).hint("rebalance", *keys).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path))


def write_by_month(df: DataFrame, path: str, month: str = "disclosure_month") -> None:
    write_by(df, path, month)


def folders(spark: SparkSession, path: str, keys: tuple[str, ...],
            within: dict[str, set[str | None]] | None = None) -> dict[tuple[str | None, ...], tuple[str, frozenset[str]]]:
    """Folder and files of each partition of a table, by the values of ``keys`` as text; with ``within`` only of those whose named keys
    have one of the given values, and only they are listed. Nothing if there is no table."""
    jvm = spark._jvm
    root, escape = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    system, within = root.getFileSystem(spark._jsc.hadoopConfiguration()), within or {}
    choices = [[NULL_FOLDER if v is None else escape(v) for v in sorted(within[k], key=str)] if k in within else ["*"] for k in keys]
    found: dict[tuple[str | None, ...], tuple[str, set[str]]] = {}
    for parts in product(*choices):
        pattern = "/".join(f"{k}={part}" for k, part in zip(keys, parts))
        for status in system.globStatus(jvm.org.apache.hadoop.fs.Path(root, pattern + "/*")) or []:
            folder, _, name = status.getPath().toString().rpartition("/")
            values = [unquote(x.split("=", 1)[1]) for x in folder.split("/")[-len(keys):]]
            found.setdefault(tuple(None if v == NULL_FOLDER else v for v in values), (folder, set()))[1].add(name)
    return {values: (folder, frozenset(names)) for values, (folder, names) in found.items()}


def rewrite_by(df: DataFrame, path: str, keys: tuple[str, ...],
               within: dict[str, set[str | None]]) -> tuple[set[tuple[str | None, ...]], dict[tuple[str | None, ...], str]]:
    """``write_by``, for a write that is to replace all partitions whose ``within`` keys have one of the given values.

    A dynamic overwrite leaves a partition alone that has become empty. Returned are the values written, and values and folders of
    the partitions within the range that the write left as they were: exactly those whose files are still the same, for
    ``drop_folders`` to remove.
    """
    spark = df.sparkSession
    before = folders(spark, path, keys, within)
    write_by(df, path, *keys)
    after = folders(spark, path, keys, within)
    stale = {values: folder for values, (folder, names) in after.items() if before.get(values, (folder, None))[1] == names}
    return set(after) - set(stale), stale


def drop_folders(spark: SparkSession, stale: dict[tuple[str | None, ...], str]) -> None:
    """Remove partition folders; repeating it after a crash does no harm."""
    for folder in stale.values():
        target = spark._jvm.org.apache.hadoop.fs.Path(folder)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def write_ordered(df: DataFrame, path: str, *order: str | Column) -> int:
    """Write the rows in order: each file holds a range of its own, sorted within, so the order survives the
    write and a filter on the leading column skips files and row groups. Returns the row count.

    The ranges come from a sample of the rows, so a value that is very frequent takes a file of its own
    but isn't split; later columns of ``order`` split it.
    """
    seen = Observation()
    # Counted behind the shuffle: the sample reads the rows before it once more.
    (assert_readable(conform(df)).repartitionByRange(*order).sortWithinPartitions(*order)
     .observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(path))
    return int(_metrics(seen).get("n") or 0)


def write_counted(df: DataFrame, path: str, fmt: str = "parquet") -> int:
    """Write and return the row count, observed during the write itself."""
    seen = Observation()
    (assert_readable(conform(df)).observe(seen, F.count(F.lit(1)).alias("n"))
     .write.mode("overwrite").format(fmt).save(path))
    return int(_metrics(seen).get("n") or 0)


def publish(tables: dict[str, DataFrame], out_dir: str, fmt: str = "parquet",
            order: dict[str, tuple] | None = None) -> dict[str, int]:
    """Write every table, those named in ``order`` in that order; returns row counts."""
    order = order or {}
    return {name: write_ordered(df, f"{out_dir}/{name}", *order[name]) if name in order
            else write_counted(df, f"{out_dir}/{name}", fmt) for name, df in tables.items()}


def read_months(spark: SparkSession, *paths: str) -> DataFrame:
    """Union of monthly tables whose columns may differ."""
    return spark.read.option("mergeSchema", "true").parquet(*paths)


def required_tables(spark: SparkSession, root: str, names: list[str]) -> dict[str, DataFrame]:
    """Open all tables of a warehouse; name every missing one in a single error."""
    found, missing = {}, []
    for name in names:
        try:
            found[name] = spark.read.parquet(f"{root}/{name}")
        except AnalysisException:
            missing.append(name)
    if missing:
        raise FileNotFoundError(f"missing warehouse tables: {missing}")
    return found


def compact(spark: SparkSession, path: str, out: str, target_files: int,
            fmt: str = "parquet") -> None:
    """Rewrite a table of many small files as ``target_files`` files elsewhere, without a
    shuffle. The source is left alone, so a lost job loses nothing."""
    spark.read.format(fmt).load(path).coalesce(target_files).write.mode("overwrite").format(
        fmt).save(out)


class RowsLost(RuntimeError):
    """A rewritten table has not the rows of its source."""


def packing(spark: SparkSession, path: str, target_bytes: int) -> DataFrame:
    """(file, folder, start, bytes, width, bins, first): which part of its folder's bytes each file is, how wide a bin is,
    how many bins the folder has and the number of the first of them, counted over the whole table.

    The files are listed without reading them. A folder of b bytes gets round(b / target) bins of equal width, at least
    one, so every bin is between two thirds and one and a half times the target, unless a folder is smaller.
    """
    listed = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
              .select(F.col("path").alias("file"), F.col("length").alias("bytes")))
    sized = listed.withColumn("folder", F.regexp_replace("file", "/[^/]*$", ""))
    per = sized.groupBy("folder").agg(F.sum("bytes").alias("all"))
    bins = F.greatest(F.lit(1), F.round(F.col("all") / target_bytes)).cast("bigint")
    # One row per folder: its number is the sum of the bins of those before it.
    every = Window.orderBy("folder").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("bins", bins).withColumn("first", F.coalesce(F.sum("bins").over(every), F.lit(0)))
    before = Window.partitionBy("folder").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    return sized.join(per, "folder").select(
        "file", "folder", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("start"), "bytes",
        (F.col("all") / F.col("bins")).alias("width"), "bins", "first")


def compact_by_size(spark: SparkSession, path: str, out: str, target_bytes: int = 128 << 20, *keys: str) -> int:
    """Rewrite a Parquet table elsewhere with files of about ``target_bytes``, keeping its partition folders ``keys``.

    Files are packed into bins by their listed sizes; one larger than a bin is spread over several by the numbers of
    its rows, which don't change when a task is repeated. Each bin is one task and one file. The rows of the copy are counted folder by
    folder against the source before the number of bins is returned; RowsLost is raised if they differ. The source is
    left alone: swapping the folders is the caller's step.
    """
    plan = packing(spark, path, target_bytes)
    total = plan.agg(F.max(F.col("first") + F.col("bins"))).first()[0]
    if total is None:
        return 0
    table = spark.read.parquet(path)
    spread = F.pmod(F.xxhash64(F.col("_metadata.row_index")), F.lit(1 << 20)) / float(1 << 20)
    rows = table.select("*", F.col("_metadata.file_path").alias("_file"), spread.alias("_at"))
    placed = rows.join(plan.withColumnRenamed("file", "_file"), "_file")
    bin_ = F.least(F.floor((F.col("start") + F.col("_at") * F.col("bytes")) / F.col("width")), F.col("bins") - 1) + F.col("first")
    packed = placed.withColumn("_bin", bin_.cast("int")).repartitionById(int(total), F.col("_bin")).select(*table.columns)
    writer = packed.write.mode("overwrite")
    (writer.partitionBy(*keys) if keys else writer).parquet(out)

    def counts(at: str) -> DataFrame:
        return spark.read.parquet(at).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))

    source, copy = counts(path), counts(out)
    if not source.exceptAll(copy).isEmpty() or not copy.exceptAll(source).isEmpty():
        raise RowsLost(f"{out} has not the rows of {path}")
    return int(total)
