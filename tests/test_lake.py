"""Tables on disk: folders that become empty, ordered files, compaction by size."""

import datetime as dt
import json
import os

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lookthru.operators import marts
from lookthru.plans import pipeline
from lookthru.sources import generate, sinks

from test_ingest import company_rows, sheet

DAY = lambda d: dt.datetime(2026, 7, d)


def rows_of(spark, path, *cols):
    return sorted(map(tuple, spark.read.parquet(path).select(*cols).collect()))


def test_a_failing_refile_leaves_no_old_silver_rows(spark, tmp_path):
    companies = generate.sample_companies(spark)
    (n1, i1), (n2, i2) = company_rows(spark, 2)
    out = str(tmp_path / "lake")
    runs = [tmp_path / str(i) for i in range(5)]
    for r in runs:
        r.mkdir()
    sheet(runs[0], "alpha_202605.csv", [(n1, i1, 60), (n2, i2, 40)], ["Alpha Fund"])
    sheet(runs[0], "beta_202604.csv", [(n1, i1, 100)], ["Beta Fund"])
    sheet(runs[0], "gamma_202604.csv", [(n1, i1, 100)], ["Gamma Fund"])
    pipeline.run_files(spark, str(runs[0]), out, companies, "r1", DAY(1))
    assert len(rows_of(spark, f"{out}/silver_holdings", "scheme_name")) == 4
    # the only scheme of May fails: its folder goes; of the two of April one stays
    sheet(runs[1], "alpha_202605.csv", [(n1, i1, 30), (n2, i2, 40)], ["Alpha Fund"])
    sheet(runs[1], "beta_202604.csv", [(n1, i1, 70)], ["Beta Fund"])
    got = pipeline.run_files(spark, str(runs[1]), out, companies, "r2", DAY(2))
    assert got == {"files": 2, "silver_rows": 0, "quarantined_rows": 3}
    assert rows_of(spark, f"{out}/silver_holdings", "scheme_name") == [("Gamma Fund",)]
    assert not os.path.exists(f"{out}/silver_holdings/disclosure_month=2026-05-01")
    # filed once more and right: back in silver, the quarantine keeps what the run before judged
    sheet(runs[2], "alpha_202605.csv", [(n1, i1, 55), (n2, i2, 45)], ["Alpha Fund"])
    pipeline.run_files(spark, str(runs[2]), out, companies, "r3", DAY(3))
    assert rows_of(spark, f"{out}/silver_holdings", "scheme_name", "weight_pct") == [
        ("Alpha Fund", 45.0), ("Alpha Fund", 55.0), ("Gamma Fund", 100.0)]
    assert {r[0] for r in rows_of(spark, f"{out}/quarantine_holdings", "judged_by")} == {"r2"}
    # run 002 again, without April: its own rows of April go, run 001 counts there again
    sheet(runs[3], "alpha_202605.csv", [(n1, i1, 100)], ["Alpha Fund"])
    pipeline.run_files(spark, str(runs[3]), out, companies, "r2", DAY(4))
    assert {r for r in rows_of(spark, f"{out}/bronze_holdings", "disclosure_month", "ingestion_run_id") if r[1] == "r2"} == {(dt.date(2026, 5, 1), "r2")}
    assert rows_of(spark, f"{out}/file_status", "run_id").count(("r2",)) == 1
    april = spark.read.parquet(f"{out}/silver_holdings").filter("disclosure_month = '2026-04-01'")
    assert {(r.scheme_name, r.weight_pct) for r in april.collect()} == {("Beta Fund", 100.0), ("Gamma Fund", 100.0)}
    # nothing readable: nothing but the status is touched
    before = rows_of(spark, f"{out}/silver_holdings", "scheme_name"), rows_of(spark, f"{out}/bronze_holdings", "ingestion_run_id")
    (runs[4] / "x_202604.csv").write_text("hello,world\n1,2")
    with pytest.raises(pipeline.NothingParsed):
        pipeline.run_files(spark, str(runs[4]), out, companies, "r4", DAY(5))
    assert before == (rows_of(spark, f"{out}/silver_holdings", "scheme_name"), rows_of(spark, f"{out}/bronze_holdings", "ingestion_run_id"))
    assert ("r4",) in rows_of(spark, f"{out}/file_status", "run_id")


def test_actions_from_a_file(spark, tmp_path):
    companies = generate.sample_companies(spark)
    (n1, i1), = company_rows(spark, 1)
    (tmp_path / "in").mkdir()
    sheet(tmp_path / "in", "alpha_2026-05.csv", [(n1, i1, 100)], ["Alpha Fund"])
    sheet(tmp_path / "in", "beta_2026-13.csv", [(n1, i1, 100)], ["Beta Fund"])
    (tmp_path / "actions.csv").write_text(f"isin,ex_date,action_type,ratio,new_isin,note\n{i1},2026-06-01,split,3,,")
    pipeline.run_files(spark, str(tmp_path / "in"), str(tmp_path / "out"), companies, "1", DAY(1),
                       actions=str(tmp_path / "actions.csv"), as_of=dt.date(2026, 7, 1))
    assert rows_of(spark, str(tmp_path / "out/silver_holdings"), "disclosure_month", "quantity_adjusted") == [(dt.date(2026, 5, 1), 30.0)]
    assert ("quarantined", "no month") in rows_of(spark, str(tmp_path / "out/file_status"), "status", "reason")


def test_only_the_asked_folders_are_dropped(spark, tmp_path):
    p = str(tmp_path / "t")
    df = spark.createDataFrame([(1, "a b", "x"), (2, "a b", "x"), (3, None, "x"), (4, "c=d", "y/z")], "n int, k string, r string")
    keys = ("k", "r")
    assert sinks.rewrite_by(df, p, keys, {"r": {"x", "y/z"}}) == ({("a b", "x"), (None, "x"), ("c=d", "y/z")}, {})
    assert set(sinks.folders(spark, p, keys)) == {("a b", "x"), (None, "x"), ("c=d", "y/z")}
    written, stale = sinks.rewrite_by(df.filter("n = 1"), p, keys, {"r": {"x"}})
    assert written == {("a b", "x")} and set(stale) == {(None, "x")}
    sinks.drop_folders(spark, stale)
    sinks.drop_folders(spark, stale)
    assert {r.n for r in spark.read.parquet(p).collect()} == {1, 4}
    written, stale = sinks.rewrite_by(df.limit(0), p, keys, {"r": {"x", "y/z"}})
    assert written == set() and set(stale) == {("a b", "x"), ("c=d", "y/z")}
    assert set(sinks.folders(spark, p, keys, {"k": {"a b", None}})) == {("a b", "x")}
    assert sinks.folders(spark, str(tmp_path / "none"), ("k",)) == {}


def test_ordered_files_hold_ranges_of_their_own(spark, tmp_path):
    p = str(tmp_path / "o")
    df = spark.range(20_000).select((F.xxhash64("id") % 1000).alias("k"), "id").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows are one file
    try:
        assert sinks.write_ordered(df, p, "k", "id") == 20_000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spans = sorted((t.column("k").to_pylist()[0], t.column("k").to_pylist()[-1], t.num_rows) for t in map(pq.read_table, map(str, (tmp_path / "o").glob("*.parquet"))))
    assert len(spans) > 1 and all(a[1] <= b[0] for a, b in zip(spans, spans[1:])) and sum(s[2] for s in spans) == 20_000
    hit = [s for s in spans if s[0] <= 17 <= s[1]]
    assert len(hit) <= 2  # a filter on one key opens the files of its range alone
    down = str(tmp_path / "d")
    sinks.write_ordered(df, down, F.col("k").desc(), F.col("id"))
    assert spark.read.parquet(down).count() == 20_000
    assert sinks.write_ordered(df.limit(0), str(tmp_path / "e"), "k") == 0


def test_published_tables_are_in_order(spark, tmp_path):
    w, out = str(tmp_path / "w"), str(tmp_path / "gold")
    companies, schemes = generate.sample_companies(spark), generate.sample_schemes(spark)
    sinks.publish({"dim_company": companies, "dim_scheme": schemes, "fact_price": generate.sample_prices(companies),
                   "silver_holdings": generate.sample_holdings(schemes, companies, dt.date(2026, 6, 1), "r", DAY(1), months=3)}, w)
    large = companies.filter("cap_bucket = 'large'").select("isin", F.lit(100.0 / 32).alias("weight_pct"))
    first = companies.orderBy("isin").first()
    (tmp_path / "tokens.json").write_text("\n".join(json.dumps({"token": t, "symbol": s, "name": "n", "exch_seg": "NSE", "lotsize": "1", "tick_size": "5"})
                                                  for t, s in (("7", f"{first.nse_symbol}-EQ"), ("8", "NOBODY-EQ"))))
    counts = pipeline.publish_gold(spark, w, out, large, dt.date(2026, 7, 12), str(tmp_path / "tokens.json"))
    tokens = {r.isin: r.smartapi_token for r in spark.read.parquet(f"{out}/instruments").collect()}
    assert tokens[first.isin] == "7" and len(tokens) == companies.count() and set(tokens.values()) == {"7", None}
    files = sorted((tmp_path / "gold" / "dtl").glob("*.parquet"))
    days = [v for f in files for v in pq.read_table(str(f)).column("days_to_liquidate").to_pylist()]
    assert len(days) == counts["dtl"] and days == sorted(days, key=lambda v: (v is None, -(v or 0)))
    top = marts.top_by(spark.read.parquet(f"{out}/dtl"), "days_to_liquidate", 5, "isin").collect()
    assert [r.days_to_liquidate for r in top] == days[:5]
    names = [v for f in sorted((tmp_path / "gold" / "schemes").glob("*.parquet")) for v in pq.read_table(str(f)).column("scheme_name").to_pylist()]
    assert names == sorted(names)


def sizes(root):
    out = {}
    for f in root.rglob("*.parquet"):
        out.setdefault(f.parent.name, []).append(f.stat().st_size)
    return out


def test_compaction_by_size(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    noise = F.sha2(F.col("id").cast("string"), 512)
    many = spark.range(6000).select(F.lit("many").alias("k"), noise.alias("v")).repartition(60)
    one = spark.range(12_000).select(F.lit("one").alias("k"), noise.alias("v")).coalesce(1)
    tiny = spark.range(5).select(F.lit("tiny").alias("k"), noise.alias("v"))
    for df in (many, one, tiny):
        df.write.mode("append").partitionBy("k").parquet(src)
    target = 200_000
    n = sinks.compact_by_size(spark, src, out, target, "k")
    got = sizes(tmp_path / "out")
    assert sum(map(len, got.values())) == n and len(got["k=tiny"]) == 1
    assert all(target / 2 <= s <= 2 * target for k in ("k=many", "k=one") for s in got[k]), got
    assert len(sizes(tmp_path / "src")["k=many"]) == 60  # the source is as it was
    assert spark.read.parquet(src).exceptAll(spark.read.parquet(out).select("v", "k")).isEmpty()
    empty = str(tmp_path / "none")
    (tmp_path / "none").mkdir()
    assert sinks.compact_by_size(spark, empty, str(tmp_path / "o2")) == 0
