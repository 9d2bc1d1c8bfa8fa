"""Live marks: newest prices as state across batches, pruned reads; a stream whose process is killed."""

import datetime as dt
import json
import os
import signal
import subprocess
import sys
import time

from pyspark.sql import functions as F

from lookthru.sources import generate
from lookthru.streaming import ticks

AT = dt.datetime(2026, 6, 1, 10)


def tick(n, isin, ltp, second, seq=1):
    return (str(n), isin, "t", float(ltp), seq, AT + dt.timedelta(seconds=second))


def land(spark, path, rows):
    spark.createDataFrame(rows, ticks.TICK_JSON).coalesce(1).write.mode("append").parquet(path)


def look_through(spark):
    rows = [(f"P{p}", f"C{c}", "equity", 100.0 * p + c) for p in range(1, 5) for c in range(40)]
    return spark.createDataFrame(rows, "portfolio_id string, company_id string, asset_class string, value double")


def test_an_older_tick_in_a_later_batch_changes_nothing(spark, tmp_path):
    src, out, held, closes, cp = (str(tmp_path / n) for n in ("in", "out", "held", "closes", "cp"))
    lt = look_through(spark)
    prices = spark.createDataFrame([(f"C{c}", 10.0) for c in range(40)], "isin string, close double")
    ticks.publish_live_mart(lt, held, 16), prices.write.parquet(closes)
    every = []

    def batch(*rows):
        land(spark, src, list(rows))
        every.extend(rows)
        stream = spark.readStream.schema(ticks.TICK_JSON).parquet(src)
        q = ticks.start_live_marks(stream, held, closes, out, cp, interval=None, buckets=16)
        q.awaitTermination()
        assert q.exception() is None
        now = {(r.portfolio_id, r.company_id): r.live_value for r in ticks.current_marks(spark.read.parquet(out)).collect()}
        twin = ticks.live_mark(spark.createDataFrame(every, ticks.TICK_JSON), lt, prices).filter("ltp is not null")
        assert now == {(r.portfolio_id, r.company_id): r.live_value for r in twin.collect()}
        return now

    first = batch(tick(1, "C1", 11, 0), tick(2, "C1", 12, 5), tick(3, "C7", 20, 3))
    assert first["P1", "C1"] == 101 * 1.2 and len(first) == 8
    late = batch(tick(4, "C1", 5, 1), tick(5, "C9", 10, 9))                  # older than the state of C1
    assert late["P1", "C1"] == 101 * 1.2 and late["P1", "C9"] == 109.0 and len(late) == 12
    again = batch(tick(2, "C1", 12, 5), tick(6, "C7", 30, 3, seq=2), tick(7, None, 1, 1), tick(8, "unknown", 1, 1))
    assert again["P1", "C7"] == 107 * 3.0 and len(again) == 12               # same time, later sequence number
    assert batch(tick(9, "C1", 13, 60))["P2", "C1"] == 201 * 1.3
    folders = {r.batch_id for r in spark.read.parquet(out).select("batch_id").distinct().collect()}
    assert folders == {0, 1, 2, 3}


def test_a_batch_reads_only_touched_folders(spark, tmp_path, explain):
    held = str(tmp_path / "held")
    ticks.publish_live_mart(look_through(spark), held, 16)
    newest = spark.createDataFrame([tick(1, "C1", 11, 0), tick(2, "C2", 1, 0)], ticks.TICK_JSON)
    table = spark.read.parquet(held)
    rows = ticks.touched_rows(table, newest, 16)
    assert {r.company_id for r in rows.collect()} == {"C1", "C2"} and rows.count() == 8
    buckets = {r[0] for r in newest.select(ticks.company_bucket(F.col("isin"), 16)).collect()}
    plan = explain(rows)
    assert "PartitionFilters" in plan and "company_bucket" in plan.split("PartitionFilters")[1].split("\n")[0]
    named = ticks.touched_rows(table.select("*", F.col("_metadata.file_path").alias("f")), newest, 16)
    read = {r.f for r in named.select("f").distinct().collect()}
    assert all(any(f"company_bucket={b}/" in f for b in buckets) for f in read)
    assert table.inputFiles() and len(read) <= len(buckets) < len(table.inputFiles())


CHILD = """
import os, sys
from lookthru.session import build_session
from lookthru.streaming import ticks
src, out, dlq, cp, home = sys.argv[1:]
spark = build_session("child", "local[2]", 2, **{"spark.sql.warehouse.dir": home, "spark.sql.streaming.noDataMicroBatches.enabled": "false"})
for q in ticks.start_ticks(ticks.folder_lines(spark, src, 1), out, dlq, cp, ticks.StreamOptions("2 minutes", None)):
    q.awaitTermination()
print("ended", flush=True)
"""


def run_child(args, home):
    env = {**os.environ, "PYTHONPATH": os.pathsep.join([os.path.dirname(os.path.dirname(os.path.abspath(__file__))), os.environ.get("PYTHONPATH", "")])}
    return subprocess.Popen([sys.executable, "-c", CHILD, *args, home], env=env, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL,
                            start_new_session=True)


def test_a_killed_stream_goes_on_where_it_was(spark, tmp_path):
    """A process is killed between its batches, another goes on with the same checkpoint: nothing lost, doubled or made up."""
    src, out, dlq, cp = (str(tmp_path / n) for n in ("in", "out", "dlq", "cp"))
    base = generate.walk_ticks(generate.sample_companies(spark, 10), AT, 40)
    lines = generate.replay_lines(base).cache()
    lines.select("json").repartition(24).write.text(src)
    child = run_child((src, out, dlq, cp), str(tmp_path / "w1"))
    try:
        commits, deadline = tmp_path / "cp" / "ticks" / "commits", time.time() + 120
        while time.time() < deadline and child.poll() is None:
            if commits.exists() and len([f for f in commits.iterdir() if f.name.isdigit()]) >= 3:
                break
            time.sleep(0.05)
    finally:
        os.killpg(child.pid, signal.SIGKILL)  # the group of this child: itself and the JVM it started
        child.wait()
    done = len([f for f in commits.iterdir() if f.name.isdigit()])
    assert 3 <= done < 24, "killed with work left"
    partial = spark.read.parquet(out).count()
    second = run_child((src, out, dlq, cp), str(tmp_path / "w2"))
    assert b"ended" in second.communicate(timeout=180)[0]
    got, dead = spark.read.parquet(out), spark.read.parquet(dlq)
    kinds = {r.kind: r["count"] for r in lines.groupBy("kind").count().collect()}
    row = ticks.recovery_diff(lines.filter("event_id is not null").select("event_id"), got, dead).first()
    assert (row.duplicates, row.missing, row.unexpected, row.dead_letters) == (0, 0, 0, kinds["malformed"])
    assert partial < got.count() == row.expected_ids
    offsets = [json.loads((tmp_path / "cp" / "ticks" / "offsets" / str(i)).read_text().split("\n")[2])["logOffset"] for i in range(done)]
    assert offsets == sorted(set(offsets))
