"""Tick feed: decode, dead letters, bounded de-duplication, live marks.

``split_ticks``, ``dedup_ticks`` and ``live_mark`` serve batch and stream alike.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

# The fields of a tick and the name of its topic.
TICK_JSON = ("event_id STRING, isin STRING, token STRING, ltp DOUBLE, seq INT, "
             "event_time TIMESTAMP")
TOPIC = "marketdata.ticks"
LIVE_BUCKETS = 256    # folders of a look-through table that is read for live marks


@dataclass(frozen=True)
class StreamOptions:
    """watermark: how late a tick may come. interval: time between batches; None runs to the end once."""

    watermark: str = "1 minute"
    interval: str | None = "2 seconds"


def folder_lines(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Streaming lines (column json) of the text files that land in a folder."""
    options = {} if files_per_batch is None else {"maxFilesPerTrigger": files_per_batch}
    return spark.readStream.options(**options).text(path).toDF("json")


def topic_lines(spark: SparkSession, servers: str, topic: str = TOPIC) -> DataFrame:
    """Streaming lines (column json) of a topic, from its first message on."""
    options = {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": "earliest"}
    messages = spark.readStream.format("kafka").options(**options).load()
    return messages.select(F.decode("value", "UTF-8").alias("json"))


def split_ticks(raw: DataFrame, require_time: bool | None = None) -> tuple[DataFrame, DataFrame]:
    """(good ticks, dead letters as read).

    A tick without an event time has a usable price, but would stay in the state of a stream's
    de-duplication for ever: a stream sends it to the dead letters unless told otherwise,
    a batch keeps it.
    """
    timed = raw.isStreaming if require_time is None else require_time
    needed = ["event_id", "ltp", *(["event_time"] if timed else [])]
    parsed = raw.select("json", F.from_json("json", TICK_JSON).alias("t"))
    whole = F.col("t").isNotNull()
    for name in needed:
        whole = whole & F.col(f"t.{name}").isNotNull()
    return parsed.filter(whole).select("t.*"), parsed.filter(~whole).select("json")


def dedup_ticks(good: DataFrame, watermark: str = "1 minute", by_id_only: bool = False) -> DataFrame:
    """Drop copies. On a stream the watermark bounds the state and drops what is later.

    The same id at another time is another event, unless ``by_id_only``.
    """
    if not good.isStreaming:
        return good.dropDuplicates(["event_id"] if by_id_only else ["event_id", "event_time"])
    marked = good.withWatermark("event_time", watermark)
    if by_id_only:
        return marked.dropDuplicatesWithinWatermark(["event_id"])
    return marked.dropDuplicates(["event_id", "event_time"])


def land(df: DataFrame, path: str, checkpoint: str, interval: str | None) -> StreamingQuery:
    """Append a stream to a folder; the checkpoint makes a restart go on where it stopped."""
    trigger = {"availableNow": True} if interval is None else {"processingTime": interval}
    return df.writeStream.trigger(**trigger).option("checkpointLocation", checkpoint).start(path, format="parquet")


def start_ticks(raw: DataFrame, out: str, dead: str, checkpoint: str, options: StreamOptions = StreamOptions(),
                require_time: bool | None = None) -> tuple[StreamingQuery, StreamingQuery]:
    """Land the de-duplicated ticks of a stream of lines and its dead letters."""
    good, bad = split_ticks(raw, require_time)
    return (land(dedup_ticks(good, options.watermark), out, f"{checkpoint}/ticks", options.interval),
            land(bad, dead, f"{checkpoint}/dead", options.interval))


class LateRows(StreamingQueryListener):
    """Counts, per query, all rows that the watermark has dropped since the listener was added."""

    def __init__(self) -> None:
        self.dropped: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:
        self.dropped.setdefault(str(event.id), 0)

    def onQueryProgress(self, event) -> None:
        key, states = str(event.progress.id), event.progress.stateOperators
        self.dropped[key] = self.dropped.get(key, 0) + sum(s.numRowsDroppedByWatermark for s in states)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def latest_prices(ticks: DataFrame) -> DataFrame:
    """Newest price per instrument; an aggregate, so only one row per key and task moves."""
    return newest_ticks(ticks).select("isin", "ltp")


def live_mark(ticks: DataFrame, look_through: DataFrame, prices: DataFrame) -> DataFrame:
    """Look-through rows revalued at the newest tick; rows without a tick keep their value.

    The marts themselves are never written to.
    """
    ratio = (prices.select("isin", "close").join(latest_prices(ticks), "isin")
             .select(F.col("isin").alias("company_id"), "ltp",
                     F.try_divide(F.col("ltp"), F.col("close")).alias("_ratio")))
    value = F.col("value") * F.coalesce("_ratio", F.lit(1.0))
    return look_through.join(ratio, "company_id", "left").select(
        "portfolio_id", "company_id", "asset_class", "value", "ltp", value.alias("live_value"))


def publish_live_mart(look_through: DataFrame, path: str, buckets: int = LIVE_BUCKETS) -> None:
    """Write a look-through table for live marks: a folder per bucket of companies, sorted by company within.

    A batch of ticks then opens the folders of the ticked companies alone. A company is in one bucket,
    but the rows of a very common one are spread over several files of it.
    """
    keyed = look_through.withColumn("company_bucket", company_bucket(F.col("company_id"), buckets))
    (keyed.hint("rebalance", "company_bucket").sortWithinPartitions("company_bucket", "company_id")
     .write.mode("overwrite").partitionBy("company_bucket").parquet(path))


def company_bucket(company: Column, buckets: int = LIVE_BUCKETS) -> Column:
    return F.pmod(F.xxhash64(company), F.lit(buckets)).cast("int")


def newest_ticks(ticks: DataFrame) -> DataFrame:
    """Newest tick of each instrument (isin, ltp, event_time, seq, event_id).

    On a stream this is a keyed state: one row per instrument, kept across batches and restarts, so a tick that comes
    in a later batch but is older than the state changes nothing. Copies of a tick change nothing either.
    """
    tick = F.struct("event_time", "seq", "event_id", "ltp")
    return (ticks.filter("isin is not null").groupBy("isin").agg(F.max(tick).alias("t"))
            .select("isin", "t.ltp", "t.event_time", "t.seq", "t.event_id"))


def touched_rows(look_through: DataFrame, newest: DataFrame, buckets: int = LIVE_BUCKETS) -> DataFrame:
    """The look-through rows of the companies in ``newest``. Of a table in buckets only their folders are read; their
    numbers are collected, at most ``buckets``."""
    company = newest.select(F.col("isin").alias("company_id")).distinct()
    if "company_bucket" in look_through.columns:
        hit = [r[0] for r in company.select(company_bucket(F.col("company_id"), buckets)).distinct().collect()]
        look_through = look_through.filter(F.col("company_bucket").isin(hit))
    return look_through.join(company, "company_id", "left_semi")


def start_live_marks(ticks: DataFrame, look_through: str, prices: str, out: str, checkpoint: str,
                     interval: str | None = "2 seconds", buckets: int = LIVE_BUCKETS) -> StreamingQuery:
    """Per micro-batch, write the marks of the instruments that ticked, by batch id, at their newest price so far.

    ``look_through`` and ``prices`` are the paths of published tables (``publish_live_mart`` writes the first one in buckets).
    The newest tick of every instrument is the state of the query, so marks never go back to an older tick. A
    repeated batch replaces its own folder.
    """

    def mark(batch: DataFrame, batch_id: int) -> None:
        read = batch.sparkSession.read
        # Kept, as each use would go through the state again; dealt anew, as the order of a state can't be kept.
        newest = batch.repartition("isin").persist()
        try:
            held = touched_rows(read.parquet(look_through), newest, buckets)
            live_mark(newest, held, read.parquet(prices)).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")
        finally:
            newest.unpersist()

    trigger = {"availableNow": True} if interval is None else {"processingTime": interval}
    return (newest_ticks(ticks).writeStream.outputMode("update").trigger(**trigger)
            .option("checkpointLocation", checkpoint).foreachBatch(mark).start())


def current_marks(marks: DataFrame) -> DataFrame:
    """The last mark of each row that ever ticked, from all batches that ``start_live_marks`` has written."""
    keys, rest = ["portfolio_id", "company_id", "asset_class"], ["value", "ltp", "live_value"]
    return (marks.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("m")).select(*keys, "m.*"))


def recovery_diff(expected: DataFrame, delivered: DataFrame, dead: DataFrame) -> DataFrame:
    """One row: rows, distinct ids, copies, lost and unexpected ids, dead letters."""
    want = expected.select("event_id").distinct().withColumn("_want", F.lit(1))
    got = delivered.groupBy("event_id").agg(F.count(F.lit(1)).alias("_n"))
    g = want.join(got, "event_id", "full_outer").agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("total_rows"),
        F.count("_n").alias("distinct_ids"), F.count("_want").alias("expected_ids"),
        F.count(F.when(F.col("_n").isNull(), 1)).alias("missing"),
        F.count(F.when(F.col("_want").isNull(), 1)).alias("unexpected"))
    letters = dead.select(F.count(F.lit(1))).scalar()
    return g.select("total_rows", "distinct_ids", "expected_ids",
                    (F.col("total_rows") - F.col("distinct_ids")).alias("duplicates"),
                    "missing", "unexpected", letters.alias("dead_letters"))
