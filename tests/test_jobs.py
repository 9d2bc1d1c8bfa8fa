import datetime as dt
import json
import math
import time

import pytest
from pyspark.sql import functions as F

from lookthru import schemas
from lookthru.operators import overlap, quality, risk
from lookthru.plans import pipeline
from lookthru.sources import files, generate, market, sinks
from lookthru.streaming import ticks

MONTH = dt.date(2026, 6, 1)


def candles(spark, isin, closes, start=dt.datetime(2026, 1, 1)):
    return spark.createDataFrame(
        [(isin, start + dt.timedelta(days=i), float(c), float(i)) for i, c in enumerate(closes)],
        "isin string, timestamp timestamp, close double, volume double")


def only(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


@pytest.mark.parametrize("bars,known", [(20, False), (21, True)])
def test_volatility_needs_twenty_returns(spark, bars, known):
    closes = [100 + (i % 3) for i in range(bars)]
    got = only(risk.realised_volatility(candles(spark, "X", closes))).volatility_pct
    assert (got is not None) == known
    if known:
        r = [math.log(b / a) for a, b in zip(closes, closes[1:])]
        m = sum(r) / len(r)
        want = math.sqrt(sum((x - m) ** 2 for x in r) / (len(r) - 1)) * math.sqrt(252) * 100
        assert got == pytest.approx(want)


@pytest.mark.parametrize("bars,known", [(30, False), (31, True)])
def test_beta_needs_thirty_pairs(spark, bars, known):
    closes = [100 * math.exp(0.02 * (i % 5)) for i in range(bars)]
    b = only(risk.beta(candles(spark, "X", [c * c for c in closes]), candles(spark, "I", closes))).beta
    assert (b == pytest.approx(2.0)) if known else b is None


def test_beta_of_flat_benchmark_is_null(spark):
    assert only(risk.beta(candles(spark, "X", range(1, 50)), candles(spark, "I", [5] * 49))).beta is None


def test_drawdown_and_single_bar(spark):
    assert only(risk.max_drawdown(candles(spark, "X", [100, 120, 60, 90] + [80] * 60))).max_drawdown_pct == -50.0
    assert only(risk.max_drawdown(candles(spark, "X", [100]))).max_drawdown_pct is None


def test_adv_takes_the_last_sessions_in_any_input_order(spark):
    c = candles(spark, "X", range(1, 51)).orderBy(F.rand(1))
    assert only(risk.adv(c)).adv_shares_30d == sum(range(20, 50)) / 30


def test_portfolio_risk_blend(spark):
    r = spark.createDataFrame([("X", 10.0, -5.0, 1.0), ("Y", 20.0, -10.0, None)],
                              "isin string, volatility_pct double, max_drawdown_pct double, beta double")
    w = spark.createDataFrame([("P", "X", 60.0), ("P", "Y", 20.0), ("P", "Z", 20.0)],
                              "portfolio_id string, isin string, weight double")
    got = only(risk.portfolio_risk(w, r))
    assert (got.coverage_pct, got.weighted_volatility_pct, got.weighted_max_drawdown_pct, got.weighted_beta,
            got.constituents_priced) == (80.0, 12.5, -6.25, 1.0, 2)


def gate_rows(spark, rows):
    return spark.createDataFrame(rows, "scheme_code string, disclosure_month date, company_id string, "
                                 "instrument_name_raw string, asset_class string, weight_pct double")


def test_gates(spark):
    h = gate_rows(spark, [("A", MONTH, "X", "x", "equity", 60.0), ("A", MONTH, None, "c", "cash", 40.2),
                          ("B", MONTH, None, "x", "equity", 50.0), ("B", MONTH, None, "x", "equity", 50.0),
                          ("C", MONTH, "X", "x", "equity", 90.0)])
    got = {r.metric: r for r in quality.dq_report(h, None, dt.date(2026, 8, 15)).collect()}
    assert got["scheme_month_weight_reconciliation"].value == 0.6667
    assert got["equity_isin_resolution_rate"].value == 0.5
    assert got["equity_isin_resolution_rate"].unresolved_rows == 2
    assert got["duplicate_holdings"].value == 1.0
    assert got["disclosure_age_days"].passed and got["mf_ownership_within_free_float"].passed
    with pytest.raises(quality.QualityFailure, match="duplicate_holdings"):
        quality.dq_report(h, None, dt.date(2026, 8, 15), strict=True)
    good, bad = quality.promotable(h)
    assert {r.scheme_code for r in good.collect()} == {"A", "B"}
    assert {r.scheme_code for r in bad.collect()} == {"C"}


def test_gates_on_nothing(spark):
    got = {r.metric: r.passed for r in quality.dq_report(gate_rows(spark, []), None, MONTH).collect()}
    assert got == {"scheme_month_weight_reconciliation": True, "equity_isin_resolution_rate": True,
                   "duplicate_holdings": True, "disclosure_age_days": False, "mf_ownership_within_free_float": True}


def test_free_float_breach(spark):
    d = spark.createDataFrame([(120.0,), (99.0,), (None,)], "mf_pct_of_free_float double")
    row = only(quality.dq_free_float(d))
    assert row.value == 1.0 and not row.passed


def test_conform_and_guard(spark):
    df = spark.sql("select 1 as a, null as gap_pct, null as note, timestamp_ntz'2026-01-01 00:00:00' as t")
    with pytest.raises(schemas.UnreadableTypes):
        schemas.assert_readable(df)
    fixed = schemas.assert_readable(schemas.conform(df))
    assert dict(fixed.dtypes) == {"a": "int", "gap_pct": "double", "note": "string", "t": "timestamp"}
    assert schemas.conform(df, schemas.FACT_PRICE).columns == schemas.FACT_PRICE.names
    bad = gate_rows(spark, [("A", MONTH, "X", "x", "equity", 111.0), ("A", MONTH, "X", "x", "bond", 1.0)])
    assert schemas.violations(bad).count() == 2


def test_month_sink_leaves_other_months(spark, tmp_path):
    p = str(tmp_path / "m")
    df = generate.scale_holdings(spark, 10, 3, 5)
    sinks.write_by_month(df, p)
    one = df.filter("disclosure_month = '2016-02-01'").limit(1)
    sinks.write_by_month(one, p)
    got = {r.disclosure_month: r["count"] for r in spark.read.parquet(p).groupBy("disclosure_month").count().collect()}
    assert got[dt.date(2016, 2, 1)] == 1 and got[dt.date(2016, 1, 1)] == 50


def test_latest_month_prunes_partitions(spark, tmp_path, explain):
    p = str(tmp_path / "m")
    sinks.write_by_month(generate.scale_holdings(spark, 10, 3, 5), p)
    h = spark.read.parquet(p)
    plan = explain(overlap.overlap_pairs(h, dt.date(2016, 2, 1)))
    assert "PartitionFilters: [isnotnull(disclosure_month" in plan and "2016-02-01" in plan
    assert "market_value" not in plan.split("ReadSchema")[1].split("\n")[0]
    assert "PartitionFilters" in explain(overlap.overlap_pairs(h))
    assert overlap.overlap_pairs(h).count() == overlap.overlap_pairs(h, dt.date(2016, 3, 1)).count()


def test_compaction_and_counts(spark, tmp_path):
    p = str(tmp_path)
    assert sinks.write_counted(spark.range(100).repartition(20), f"{p}/small") == 100
    sinks.compact(spark, f"{p}/small", f"{p}/few", 2)
    assert len(list((tmp_path / "few").glob("*.parquet"))) == 2 and spark.read.parquet(f"{p}/few").count() == 100
    with pytest.raises(FileNotFoundError, match="nope"):
        sinks.required_tables(spark, p, ["small", "nope"])


def test_sample_warehouse_to_published_marts(spark, tmp_path):
    w, out = str(tmp_path / "w"), str(tmp_path / "gold")
    companies, schemes = generate.sample_companies(spark), generate.sample_schemes(spark)
    at = dt.datetime(2026, 7, 12)
    h = generate.sample_holdings(schemes, companies, MONTH, "r", at, months=4)
    sinks.publish({"dim_company": companies, "dim_scheme": schemes, "silver_holdings": h,
                   "fact_price": generate.sample_prices(companies)}, w)
    stored = spark.read.parquet(f"{w}/silver_holdings")
    sums = stored.groupBy("scheme_code", "disclosure_month").agg(F.sum("weight_pct").alias("s")).collect()
    assert len(sums) == 14 * 4 and all(abs(r.s - 100) < 0.01 for r in sums)
    large = companies.filter("cap_bucket = 'large'").select("isin", F.lit(100.0 / 32).alias("weight_pct"))
    counts = pipeline.publish_gold(spark, w, out, large, dt.date(2026, 7, 12))
    assert len(counts) == 13 and 0 < counts["overlap"] <= 91 and counts["quality"] == 5 and counts["turnover"] == 14 * 3
    assert all(n > 0 for n in counts.values())


def test_skewed_generator_is_skewed_and_repeatable(spark):
    df = generate.scale_holdings(spark, 60, 4, 100)
    head = df.groupBy("company_id").count().orderBy(F.desc("count")).limit(20).agg(F.sum("count")).first()[0]
    assert 0.3 < head / 24000 < 0.5
    digest = lambda x: x.agg(F.sum(F.xxhash64(*x.columns) % 1000)).first()[0]
    assert digest(df) == digest(generate.scale_holdings(spark, 60, 4, 100).repartition(7))


def test_candles_keep_bars_with_unreadable_numbers(spark):
    raw = spark.createDataFrame([("X", json.dumps([["2026-01-01 00:00:00", "1", "2", "0.5", "1.5", "n/a"]]))],
                                "isin string, json string")
    row = only(market.conform_candles(raw))
    assert row.close == 1.5 and row.volume is None and row.timestamp == dt.datetime(2026, 1, 1)


def test_instruments(spark):
    inst = spark.createDataFrame([("1", "AAA-EQ", "a", "NSE", "1", "5"), ("2", "BBB-EQ", "b", "BSE", "1", "5"),
                                  ("3", "CCC-BE", "c", "NSE", "1", "5")], market.INSTRUMENT_JSON)
    comp = spark.createDataFrame([("I1", "AAA", "A"), ("I2", "BBB", "B")],
                                 "isin string, nse_symbol string, company_name string")
    assert {(r.isin, r.smartapi_token) for r in market.instrument_dim(inst, comp).collect()} == {("I1", "1"), ("I2", None)}


def test_manifest_finds_copies_and_missing_files(spark, tmp_path):
    for name, text in (("a 1.csv", "x"), ("b.csv", "x"), ("c.csv", "yy")):
        (tmp_path / name).write_text(text)
    want = spark.createDataFrame([("a 1.csv",), ("gone.csv",)], "file string")
    m = files.file_manifest(spark, str(tmp_path), want)
    got = {r.file: (r.status, r.bytes, r.copies) for r in m.collect()}
    assert got == {"a 1.csv": ("landed", 1, 2), "b.csv": ("landed", 1, 2), "c.csv": ("landed", 2, 1),
                   "gone.csv": ("failed", 0, 0)}
    row = only(files.manifest_totals(m.withColumn("month", F.lit("2026-06")), "month"))
    assert (row.landed, row.failed, row.total_bytes) == (3, 1, 4)


def test_month_spine(spark):
    got = [r.month for r in files.month_spine(spark, dt.date(2025, 11, 20), dt.date(2026, 2, 1)).collect()]
    assert got == [dt.date(2025, 11, 1), dt.date(2025, 12, 1), dt.date(2026, 1, 1), dt.date(2026, 2, 1)]


def test_rows_without_a_key_are_spread(spark):
    from lookthru.operators.tiles import spread_nulls
    df = spark.range(1000).select(F.when(F.col("id") < 3, F.lit("k")).alias("k"), "id")
    keys = df.select(spread_nulls(F.col("k"), "id").alias("s")).groupBy("s").count().collect()
    assert len(keys) == 998 and {r["count"] for r in keys if r.s == "k"} == {3}


def stop_clean(*queries):
    for q in queries:
        q.awaitTermination()
        assert q.exception() is None


def test_stream_restart_loses_and_doubles_nothing(spark, tmp_path):
    src, out, dlq, cp = (str(tmp_path / n) for n in ("in", "out", "dlq", "cp"))
    base = generate.walk_ticks(generate.sample_companies(spark, 20), dt.datetime(2026, 6, 1, 10), 50)
    lines = generate.replay_lines(base).cache()
    generate.write_replay(lines, src)

    def once():
        stop_clean(*ticks.start_ticks(ticks.folder_lines(spark, src, 2), out, dlq, cp, ticks.StreamOptions("2 minutes", None)))
        return spark.read.parquet(out)

    first = once()
    kinds = {r.kind: r["count"] for r in lines.groupBy("kind").count().collect()}
    assert set(kinds) == {"tick", "copy", "late", "malformed"}
    n1 = first.count()
    more = spark.createDataFrame([("tick", "T-1", '{"event_id":"T-1","isin":"I","ltp":1.5,"seq":1,"event_time":"2026-06-01 10:00:30"}'),
                                  ("x", None, "garbage"), ("x", None, '{"event_id":null,"ltp":1}'),
                                  ("x", None, '{"event_id":"Q","ltp":"NaNsense"}')], "kind string, event_id string, json string")
    again = lines.limit(50).select("kind", "event_id", "json").unionByName(more)
    again.select("json").coalesce(1).write.mode("append").text(src)  # copies of earlier events and new ones
    second = once()
    expected = lines.filter("event_id is not null").select("event_id").unionByName(
        more.filter("event_id is not null").select("event_id"))
    row = only(ticks.recovery_diff(expected, second, spark.read.parquet(dlq)))
    assert (row.duplicates, row.missing, row.unexpected) == (0, 0, 0)
    assert second.count() == n1 + 1 and row.dead_letters >= kinds["malformed"] + 3


def test_stream_drops_what_is_behind_the_watermark(spark, tmp_path):
    src, out, dlq, cp = (str(tmp_path / n) for n in ("in", "out", "dlq", "cp"))
    t = "2026-06-01 10:%s"

    def land(i, *rows):
        text = "\n".join(json.dumps({"event_id": e, "isin": "I", "ltp": 1.0, "seq": i, "event_time": at}) for e, at in rows)
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{i}.json").write_text(text)
        stop_clean(*ticks.start_ticks(ticks.folder_lines(spark, src), out, dlq, cp, ticks.StreamOptions(interval=None)))

    late = ticks.LateRows()
    spark.streams.addListener(late)
    land(0, ("a", t % "00:00"), ("b", t % "05:00"))
    land(1, ("c", t % "04:30"), ("e", None))
    # The watermark of a batch counts for late rows from the batch after the next one.
    land(2, ("f", t % "06:00"), ("d", t % "01:00"))
    for _ in range(100):  # progress is told a little later
        if sum(late.dropped.values()):
            break
        time.sleep(0.1)
    spark.streams.removeListener(late)
    got = {r.event_id for r in spark.read.parquet(out).collect()}
    assert got == {"a", "b", "c", "f"} and sum(late.dropped.values()) >= 1
    assert "\"e\"" in spark.read.parquet(dlq).first().json


def test_live_marks(spark, tmp_path):
    good = spark.createDataFrame([("1", "X", "t", 110.0, 1, dt.datetime(2026, 6, 1, 10)),
                                  ("2", "X", "t", 120.0, 2, dt.datetime(2026, 6, 1, 10))], ticks.TICK_JSON)
    lt = spark.createDataFrame([("P", "X", "equity", 1000.0), ("P", "Y", "equity", 50.0)],
                               "portfolio_id string, company_id string, asset_class string, value double")
    prices = spark.createDataFrame([("X", 100.0), ("Y", 1.0)], "isin string, close double")
    got = {r.company_id: r.live_value for r in ticks.live_mark(good, lt, prices).collect()}
    assert got == {"X": 1200.0, "Y": 50.0}
    src, out, held, closes = (str(tmp_path / n) for n in ("in", "out", "held", "closes"))
    good.write.parquet(src)
    lt.write.parquet(held), prices.write.parquet(closes)
    stream = spark.readStream.schema(good.schema).parquet(src)
    stop_clean(ticks.start_live_marks(stream, held, closes, out, str(tmp_path / "cp"), interval=None))
    assert [(r.company_id, r.live_value) for r in spark.read.parquet(out).collect()] == [("X", 1200.0)]


def test_tasks_of_the_views_follow_the_rows(spark, data, explain, monkeypatch):
    """Aggregates over holdings and positions run in tasks of a bounded number of rows, and the window of holdings needs no second shuffle."""
    from lookthru.plans import views
    rows = {name: sorted(map(tuple, getattr(views, name)(spark, data).collect())) for name in ("holdings", "positions")}
    monkeypatch.setattr(views, "TASK_ROWS", 100)
    n = -(-views.table(spark, data, "lineitem").count() // 100)
    for name in rows:
        df = getattr(views, name)(spark, data)
        plan = explain(df)
        assert f", {n})" in plan and "REPARTITION_BY_NUM" in plan
        assert sorted(map(tuple, df.collect())) == rows[name]
    assert "ENSURE_REQUIREMENTS" not in explain(views.holdings(spark, data)).split("REPARTITION_BY_NUM")[-1]


def test_mappings_name_every_sheet_without_its_lines(spark, data, explain):
    from lookthru.plans import feeds
    found = feeds.mappings(spark, data)
    assert {r.source_file for r in found.collect()} == {r.source_file for r in feeds.sheet_lines(spark, data).select("source_file").distinct().collect()}
    plan = explain(found)
    assert "Union" not in plan and "Window" not in plan
