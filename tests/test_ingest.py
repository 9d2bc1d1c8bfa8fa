import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from lookthru.operators import corporate, disclosure, resolve
from lookthru.operators.ordered import fill_forward, with_previous, with_running_max
from lookthru.plans import pipeline
from lookthru.schemas import CELL_GRID
from lookthru.sources import files, generate, grid, nav, sinks

MONTH, AT = dt.date(2026, 6, 1), dt.datetime(2026, 7, 12)


def company_rows(spark, n=12):
    return [(r.company_name, r.isin) for r in generate.sample_companies(spark).orderBy("isin").limit(n).collect()]


def shares(n, total):
    """n falling weights in hundredths that add up to ``total``."""
    parts = [round(total * 2 * (n - k) / (n * (n + 1)), 2) for k in range(n)]
    return [round(parts[0] + total - sum(parts), 2), *parts[1:]]


def write_files(spark, root):
    """One sheet per quirk: deep header, stacked schemes, text numbers, buried header, no identifier column, reordered columns."""
    names = company_rows(spark)

    def put(name, lines):
        with open(os.path.join(root, name), "w", encoding="utf-8") as f:
            f.write("\n".join(lines))

    deep = [f"{n},{i},{5000 + 7 * k},{w * 31:.1f},{w}" for k, ((n, i), w) in enumerate(zip(names, shares(12, 98)))]
    put("bluewater_202606.csv", ["Half-page of legal text", "Tranquil Lake Equity Fund", "Position list", "", "Name of the Instrument,ISIN,Quantity,Market Value (Rs. in Lakhs),% to NAV",
                                 *deep, "Cash at bank,,,62.0,2.0", "Total,,,3100.0,100.0"])
    stacked = []
    for title, part in (("Polar Night Savings Fund", names[:5]), ("Polar Day Growth Plan", names[5:12])):
        stacked += [title, "Name of the Instrument,ISIN,Quantity,Market value,% to Net Assets"]
        stacked += [f"{n},{i},{900 + k},{w * 2e6:.0f},{w}" for k, ((n, i), w) in enumerate(zip(part, shares(len(part), 99)))]
        stacked += ["Cash margin with exchange,,,11.0,1.0", ""]
    put("northstar_202606.csv", stacked)
    texts = [f'{n},{i},"{12 + k},0{k % 10}5","{1000 * w:,.1f}", {w} %' for k, ((n, i), w) in enumerate(zip(names[:9], shares(9, 95.5)))]
    put("meridian_202606.csv", ["Noon Line Balanced Scheme", "Name of Instrument,ISIN,Qty,Market Value,% to NAV", *texts,
                                'Net payable,-,NIL,"4,500.0",4.5%', "Note: figures are not audited", "2. See the web page", "* provisional"])
    buried = [f"{n},{i},{60 + k},{w / 4:.4f},{w}" for k, ((n, i), w) in enumerate(zip(names, shares(12, 97)))]
    put("kaveri_202606.csv", [f"Circular {k}, page {k + 1}" for k in range(47)] + ["Name of the Instrument,ISIN,No. of Shares,Market Value (Rs. in Crores),% to NAV", *buried, "Repo,,,0.75,3.0"])
    blind = [f"{n},Trade,{400 - k},{w * 500:.0f},{w}" for k, ((n, _), w) in enumerate(zip(names[2:], shares(10, 96)))]
    put("sentinel_202606.csv", ["Watchtower Opportunities Fund", "Name of the Instrument,Industry,Quantity,Market Value,% to NAV", *blind, "Other receivables,,,2000,4.0"])
    spelled = (lambda n: n.replace(" Ltd", " Limited"), str.lower, str.upper)
    mixed = [f"{w},{spelled[k % 3](n)},{i if k % 2 else ''},{w * 40:.2f},{70 + k}" for k, ((n, i), w) in enumerate(zip(names[:11], shares(11, 94)))]
    put("zenith_202606.csv", ["% to NAV,Security Name,ISIN Code,Market Value (Rs Lakhs),Quantity", *mixed, "6.0,Net current asset,,240.0,"])
    put("shopping_list_202606.csv", ["item,price", "apples,3", "pears,4"])


@pytest.fixture(scope="module")
def src(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("files")
    write_files(spark, root)
    return str(root)


@pytest.fixture(scope="module")
def parsed(spark, src):
    bronze, status = disclosure.parse_disclosures(grid.cell_grid(spark, src), MONTH, "r1", AT)
    return bronze.cache(), {r.source_file.split("_202606")[0]: r for r in status.collect()}


def test_files_and_quarantine(parsed):
    bronze, status = parsed
    for name in ("bluewater", "northstar", "meridian", "kaveri", "sentinel", "zenith"):
        assert status[name].adapter == name and status[name].status == "parsed"
    assert status["shopping_list"].status == "quarantined"
    assert bronze.filter("source_file like 'shopping%'").count() == 0
    schemes = {(r.source_file.split("_")[0], r.scheme_name): r.n for r in bronze.groupBy("source_file", "scheme_name").agg(F.count("*").alias("n")).collect()}
    assert schemes == {
        ("bluewater", "Tranquil Lake Equity Fund"): 13, ("northstar", "Polar Night Savings Fund"): 6,
        ("northstar", "Polar Day Growth Plan"): 8, ("meridian", "Noon Line Balanced Scheme"): 10,
        ("kaveri", "kaveri_202606"): 13, ("sentinel", "Watchtower Opportunities Fund"): 11, ("zenith", "zenith_202606"): 12}


def test_weights_units_and_excluded_rows(parsed):
    bronze, _ = parsed
    sums = bronze.groupBy("scheme_name").agg(F.sum("weight_pct").alias("w")).collect()
    assert all(abs(r.w - 100) < 0.01 for r in sums)
    names = [r[0].lower() for r in bronze.select("instrument_name_raw").collect()]
    assert not any("total" in n or n.startswith(("note", "2.", "*")) for n in names)
    value = {r[0].split("_")[0]: r[1] for r in bronze.filter("asset_class = 'equity'").groupBy("source_file")
             .agg(F.sum("market_value")).collect()}
    assert value["kaveri"] == pytest.approx(97 / 4 * 1e7, rel=1e-3) and value["bluewater"] == pytest.approx(98 * 31 * 1e5, rel=1e-3)
    assert value["meridian"] == pytest.approx(95500) and value["zenith"] == pytest.approx(94 * 40 * 1e5)


def test_every_equity_row_resolves(spark, parsed):
    silver = resolve.build_silver(parsed[0], generate.sample_companies(spark)).cache()
    equity = silver.filter("asset_class = 'equity'")
    assert equity.filter("company_id is null").count() == 0
    m = {r.resolution_method: r["rows"] for r in resolve.method_counts(equity).collect()}
    assert m == {"isin": 12 + 12 + 9 + 12 + 5, "fuzzy_name": 10 + 6}


def sheet(root, name, rows, preamble=("Acme Growth Fund",)):
    lines = [*preamble, "Name of Instrument,ISIN,Qty,Market Value,% to NAV", *(f"{n},{i},10,{w}00,{w}" for n, i, w in rows)]
    with open(os.path.join(root, name), "w", encoding="utf-8") as f:
        f.write("\n".join(lines))


def runs_of(spark, path):
    return spark.read.parquet(path)


def test_runs_add_up_and_lose_nothing(spark, tmp_path):
    companies = generate.sample_companies(spark)
    (n1, i1), (n2, i2) = company_rows(spark, 2)
    first, second, out = tmp_path / "a", tmp_path / "b", str(tmp_path / "lake")
    first.mkdir(), second.mkdir()
    sheet(first, "alpha_202605.csv", [(n1, i1, 60), (n2, i2, 40)], ["Alpha Fund"])
    sheet(first, "beta_202605.csv", [(n1, i1, 100)], ["Beta Fund"])
    sheet(first, "gamma_202605.csv", [(n1, i1, 30)], ["Gamma Fund"])           # does not add up
    sheet(first, "delta_202604.csv", [(n1, i1, 100)], ["Delta Fund"])
    sheet(first, "nameless.csv", [(n1, i1, 100)], ["Nameless Fund"])           # no month
    sheet(first, "old_201001.csv", [(n1, i1, 100)], ["Old Fund"])              # outside
    when = lambda d: dt.datetime(2026, 7, d)
    counts = pipeline.run_files(spark, str(first), out, companies, "001", when(1), start=dt.date(2026, 1, 1))
    assert counts == {"files": 6, "silver_rows": 4, "quarantined_rows": 1}
    status = {r.source_file: (r.status, r.reason) for r in runs_of(spark, f"{out}/file_status").collect()}
    assert status["nameless.csv"] == ("quarantined", "no month") and status["old_201001.csv"][0] == "skipped"
    assert status["alpha_202605.csv"] == ("parsed", None)
    sheet(second, "alpha_202605.csv", [(n1, i1, 70), (n2, i2, 30)], ["Alpha Fund"])
    actions = spark.createDataFrame([(i1, dt.date(2026, 6, 1), "split", 2.0, None, None)],
                                    "isin string, ex_date date, action_type string, ratio double, new_isin string, note string")
    counts = pipeline.run_files(spark, str(second), out, companies, "002", when(2), actions=actions, as_of=dt.date(2026, 7, 2))
    assert counts["files"] == 1 and counts["silver_rows"] == 2
    silver = {(r.scheme_name, r.company_id): r for r in sinks.read_months(spark, f"{out}/silver_holdings").collect()}
    assert {k: r.weight_pct for k, r in silver.items()} == {
        ("Alpha Fund", i1): 70.0, ("Alpha Fund", i2): 30.0, ("Beta Fund", i1): 100.0, ("Delta Fund", i1): 100.0}
    assert silver["Beta Fund", i1].quantity_adjusted == 20.0 and silver["Alpha Fund", i2].quantity_adjusted == 10.0
    assert runs_of(spark, f"{out}/file_status").count() == 7
    assert runs_of(spark, f"{out}/bronze_holdings").count() == 7
    bad = runs_of(spark, f"{out}/quarantine_holdings")
    assert {r.scheme_name for r in bad.collect()} == {"Gamma Fund"} and bad.select("judged_by").distinct().count() == 2
    pipeline.run_files(spark, str(second), out, companies, "002", when(3))       # a run replaces itself
    assert runs_of(spark, f"{out}/file_status").count() == 7 and runs_of(spark, f"{out}/bronze_holdings").count() == 7
    empty = tmp_path / "c"
    empty.mkdir()
    sheet(empty, "x.csv", [], ["hello"])
    with pytest.raises(pipeline.NothingParsed):
        pipeline.run_files(spark, str(empty), out, companies, "003", when(4))


def test_quoted_cells_stay_whole(spark, tmp_path):
    (tmp_path / "q.csv").write_text('a,"b, c","d ""e"""\r\n\r\n"long\nname",x,\n  \n,,\nlast', newline="")
    got = [(r.row_idx, r.cells) for r in grid.cell_grid(spark, str(tmp_path)).orderBy("row_idx").collect()]
    assert got == [(0, ["a", "b, c", 'd "e"']), (1, ["long\nname", "x", ""]), (2, ["", "", ""]), (3, ["last"])]


def test_headers_far_down_and_in_later_tables(spark):
    head = ["Name of Instrument", "ISIN", "Qty", "Market Value", "% to NAV"]
    rows = [("a_202601.csv", 0, i, [f"preamble {i}"]) for i in range(75)]
    rows += [("a_202601.csv", 0, 20, ["Far Above Fund"]), ("a_202601.csv", 0, 75, head), ("a_202601.csv", 0, 76, ["Acme", "", "1", "1", "1"])]
    rows = [r for r in rows if r[3] != ["preamble 20"]]
    rows += [("b_202601.csv", 0, 0, ["cover"]), ("b_202601.csv", 1, 0, head), ("b_202601.csv", 1, 1, ["Acme", "", "1", "1", "1"])]
    grid_ = spark.createDataFrame(rows, CELL_GRID)
    bronze, status = disclosure.parse_disclosures(grid_, MONTH, "r", AT)
    assert {r.source_file: r.status for r in status.collect()} == {"a_202601.csv": "parsed", "b_202601.csv": "parsed"}
    assert {r.source_file: r.scheme_name for r in bronze.collect()} == {"a_202601.csv": "Far Above Fund", "b_202601.csv": "b_202601"}
    assert disclosure.block_titles(grid_, reach=7).count() == 0


def test_headers_flow_across_chunks_and_tables(spark, monkeypatch):
    monkeypatch.setattr(disclosure, "CHUNK_ROWS", 4)
    head = ["Name of Instrument", "ISIN", "Qty", "Market Value", "% to NAV"]
    rows = [("generic.csv", 0, 0, ["Some Fund"]), ("generic.csv", 0, 1, head)]
    rows += [("generic.csv", 0, i, [f"Acme {i}", "", "1", "1", "1"]) for i in range(2, 30)]
    rows += [("generic.csv", 1, i, [f"Next {i}", "", "1", "1", "1"]) for i in range(3)]   # same width: continues
    rows += [("generic.csv", 2, i, ["a", "b"]) for i in range(3)]                          # other width: skipped
    bronze, _ = disclosure.parse_disclosures(spark.createDataFrame(rows, CELL_GRID), MONTH, "r", AT)
    got = bronze.collect()
    assert len(got) == 31 and {r.scheme_name for r in got} == {"Some Fund"}


def test_mapping_check(spark):
    g = spark.createDataFrame([("f.csv", 0, 0, ["Name of Instrument", "% to NAV"])], CELL_GRID)
    m = spark.createDataFrame([("f.csv", "name", "Name of Instrument"), ("f.csv", "isin", "Made Up"),
                               ("f.csv", "qty", None)], "source_file string, field string, column string")
    got = {r.field: r.kept for r in disclosure.validated_mapping(m, g).collect()}
    assert got == {"name": True, "isin": False, "qty": True}


NAV = """Scheme Code;ISIN Growth;ISIN Reinvestment;Scheme Name;Net Asset Value;Date

Open Ended Schemes(Debt Scheme - Banking Fund)

First Mutual Fund

1;INE002A01018;-;First Debt Fund - Direct Plan - Growth;106.5;20-Jul-2026
2;-;BAD;First Debt Fund - Regular - IDCW;N.A.;20-Jul-2026
Open Ended Scheme(s)(Equity Scheme - Large Cap)
Second Mutual Fund
3;-;-;Second Fund - Regular Plan - Growth;12.5;99-Jul-2026
4;-;-;Indirect Fund - Growth;1.25;01-Jan-2017
5;broken;line"""


def test_nav_feed(spark, tmp_path):
    (tmp_path / "nav.txt").write_text(NAV)
    clean, bad = nav.parse_nav(nav.read_lines(spark, str(tmp_path)), AT)
    got = {r.scheme_code: r for r in clean.collect()}
    assert set(got) == {"1", "4"}
    assert got["1"].category == "Debt Scheme - Banking Fund" and got["1"].amc_name == "First Mutual Fund"
    assert got["1"].isin_growth_valid and got["1"].isin_reinvest is None and got["1"].plan_type == "direct"
    assert got["4"].category == "Equity Scheme - Large Cap" and got["4"].plan_type == "regular"
    assert sorted(r.reason for r in bad.collect()) == ["fewer than 6 fields", "no NAV", "no date"]


def test_nav_headers_cross_file_splits(spark, tmp_path):
    lines = ["Open Ended Schemes(Cat)", "Only Mutual Fund"]
    lines += [f"{i};-;-;Fund {i} - Growth;1.0;20-Jul-2026" for i in range(20000)]
    (tmp_path / "nav.txt").write_text("\n".join(lines))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        raw = nav.read_lines(spark, str(tmp_path))
        assert raw.select("block").distinct().count() > 3
        clean, _ = nav.parse_nav(raw, AT)
        assert clean.filter("amc_name = 'Only Mutual Fund' and category = 'Cat'").count() == 20000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_scheme_master_and_match(spark):
    rows = [("2", "Alpha Fund - Regular - IDCW", False), ("1", "Alpha Fund - Direct Plan - Growth", True),
            ("3", "Beta Mid Cap Fund - Growth", True)]
    n = spark.createDataFrame(rows, "scheme_code string, scheme_name string, is_growth boolean").selectExpr(
        "*", "'A' as amc_name", "'C' as category")
    master = resolve.scheme_master(n)
    assert {(r.canonical_name, r.scheme_code, r.plans) for r in master.collect()} == {
        ("alpha fund", "1", 2), ("beta mid cap fund", "3", 1)}
    asked = spark.createDataFrame([("Beta Mid Capp Fund",), ("Gamma",)], "scheme_name string")
    got = {r.disclosure_scheme_name: r for r in resolve.match_schemes(asked, master).collect()}
    assert got["Beta Mid Capp Fund"].scheme_code == "3" and got["Beta Mid Capp Fund"].matched
    assert not got["Gamma"].matched and 0 < got["Gamma"].match_score < 0.82
    assert got["Gamma"].scheme_code is None
    nothing = resolve.match_schemes(asked, master.limit(0)).collect()
    assert {(r.match_score, r.matched) for r in nothing} == {(0.0, False)}


def test_dedup_keeps_the_latest_parse_also_for_null_keys(spark):
    rows = [("S", MONTH, None, "N", 1.0, dt.datetime(2026, 7, d), f"f{d}", f"r{d}") for d in (1, 3, 2)]
    df = spark.createDataFrame(rows, "scheme_code string, disclosure_month date, company_id string, "
                               "instrument_name_raw string, weight_pct double, parsed_at timestamp, "
                               "source_file string, ingestion_run_id string")
    assert [r.source_file for r in resolve.dedup_latest(df).collect()] == ["f3"]


ACT = "isin string, ex_date date, action_type string, ratio double, new_isin string, note string"


def test_corporate_actions(spark):
    acts = spark.createDataFrame([
        ("X", dt.date(2024, 3, 1), "split", 5.0, None, ""), ("X", dt.date(2025, 3, 1), "bonus", 2.0, None, ""),
        ("X", dt.date(2030, 1, 1), "split", 7.0, None, ""), ("Y", dt.date(2025, 6, 1), "merger", 1.0, "Z", "")], ACT)
    as_of = dt.date(2026, 1, 1)
    f = {r.ex_date.year: r.cumulative_factor for r in corporate.cumulative_factors(acts, as_of).collect() if r.isin == "X"}
    assert f == {2024: 10.0, 2025: 2.0}
    h = spark.createDataFrame([("X", dt.date(2024, 1, 1), 1000), ("X", dt.date(2024, 6, 1), 5000),
                               ("X", dt.date(2025, 6, 1), 10000), ("Y", dt.date(2024, 1, 1), 10)],
                              "company_id string, disclosure_month date, quantity bigint")
    got = corporate.adjust_holdings(h, acts, as_of).collect()
    assert {r.quantity_adjusted for r in got if r.company_id == "X"} == {10000.0} and len(got) == 4
    assert [(r.company_id, r.company_id_original) for r in got if r.quantity == 10] == [("Z", "Y")]
    none = corporate.adjust_holdings(h, acts.limit(0), as_of).collect()
    assert {r.qty_adjustment_factor for r in none} == {1.0}


def test_links(spark):
    html = "<a href='/a/../f.xlsx?x=1'>1</a><a HREF=\"g.CSV\">2</a><a href='//h.org/z.pdf'>3</a><a href='n.html'>4</a>"
    p = spark.createDataFrame([(1, "https://e.org/d/page?q=2#top", html)], "page_id int, url string, html string")
    assert {r.link for r in files.page_links(p).collect()} == {
        "https://e.org/d/g.CSV", "https://h.org/z.pdf"}


def test_chunked_scans_equal_plain_windows(spark):
    df = spark.range(500).selectExpr("id % 3 as k", "id as o", "int(id / 17) as c",
                                     "if(id % 5 = 0, id, null) as v", "double((id * 37) % 101) as x")
    got = fill_forward(df, ["k"], "c", ["o"], {"f": "v"})
    got = with_previous(got, ["k"], "c", ["o"], "x", "p")
    got = with_running_max(got, ["k"], "c", ["o"], "x", "m")
    plain = df.selectExpr("o", "last(v, true) over (partition by k order by o) as f",
                          "lag(x) over (partition by k order by o) as p", "max(x) over (partition by k order by o) as m")
    assert sorted(map(tuple, got.select("o", "f", "p", "m").collect())) == sorted(map(tuple, plain.collect()))
