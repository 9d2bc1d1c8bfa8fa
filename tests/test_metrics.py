import datetime as dt
import re

import numpy as np
import pytest

from lookthru.operators import marts, overlap, portfolio
from lookthru.operators.tiles import fragmented, tiled

M1, M2, M3 = dt.date(2026, 1, 1), dt.date(2026, 2, 1), dt.date(2026, 4, 1)
H = "scheme_code string, company_id string, weight_pct double, disclosure_month date"


def holdings(spark, rows, month=M1):
    rows = [r if len(r) == 4 else (*r, month) for r in rows]
    df = spark.createDataFrame(rows, H)
    return df.selectExpr("*", "company_id as instrument_name_raw", "'equity' as asset_class")


def pairs(df):
    return {(r.s1, r.s2): r.overlap_pct for r in df.collect()}


def test_overlap_identical_disjoint_partial(spark):
    h = holdings(spark, [("A", "X", 60.0), ("A", "Y", 40.0), ("B", "X", 60.0), ("B", "Y", 40.0),
                         ("C", "X", 30.0), ("C", "Z", 70.0), ("D", "Q", 100.0)])
    assert pairs(overlap.overlap_pairs(h)) == {("A", "B"): 100.0, ("A", "C"): 30.0, ("B", "C"): 30.0}


def test_overlap_sums_repeated_rows_and_skips_null_weights(spark):
    h = holdings(spark, [("A", "X", 20.0), ("A", "X", 30.0), ("B", "X", 40.0), ("C", "X", None)])
    assert pairs(overlap.overlap_pairs(h)) == {("A", "B"): 40.0}


def test_overlap_does_not_depend_on_blocks(spark, monkeypatch):
    rows = [(f"S{i:03d}", f"C{c}", float((i * 7 + c * 3) % 11)) for i in range(40) for c in range(5)]
    h = holdings(spark, rows)
    plain = pairs(overlap.overlap_pairs(h))
    assert len(plain) == 40 * 39 // 2
    for salt in (2, 5, 8):
        assert pairs(overlap.overlap_pairs(h, salt=salt)) == plain
    monkeypatch.setattr("lookthru.operators.tiles.BLOCK_MEMBERS", 7)
    assert pairs(overlap.overlap_pairs(h)) == plain
    by_hand = {}
    for i in range(40):
        for j in range(i + 1, 40):
            by_hand[f"S{i:03d}", f"S{j:03d}"] = sum(
                min((i * 7 + c * 3) % 11, (j * 7 + c * 3) % 11) for c in range(5))
    assert plain == by_hand

def test_overlap_pairs_are_summed_where_they_are_made(spark, explain, monkeypatch):
    rows = [(f"S{i:03d}", f"C{c}", float((i * 7 + c * 3) % 11)) for i in range(30) for c in range(i % 5)]
    h = holdings(spark, rows)
    plan = explain(overlap.overlap_pairs(h))
    assert "s1" in plan and not re.search(r"hashpartitioning\([^)]*s1", plan)
    plain = pairs(overlap.overlap_pairs(h))
    full = {(r.scheme_a, r.scheme_b): r.overlap_pct
            for r in overlap.overlap_full(h, scheme_rows(spark, *[f"S{i:03d}" for i in range(33)])).collect()}
    for block, unit in ((7, 40), (9, 100), (50_000, 20_000_000)):
        monkeypatch.setattr(overlap, "BLOCK_ROWS", block)
        monkeypatch.setattr(overlap, "UNIT_PAIRS", unit)
        assert pairs(overlap.overlap_pairs(h)) == plain
        again = overlap.overlap_full(h, scheme_rows(spark, *[f"S{i:03d}" for i in range(33)]))
        assert not re.search(r"hashpartitioning\([^)]*s1", explain(again))
        got = again.collect()
        assert len(got) == 33 * 33 and {(r.scheme_a, r.scheme_b): r.overlap_pct for r in got} == full


def test_strips_of_a_unit_do_not_change_its_pairs(monkeypatch):
    draw = np.random.default_rng(3)
    cells = np.array(sorted({(int(s), int(c)) for s, c in draw.integers(0, 12, (70, 2))}))
    scheme, company, w = cells[:, 0], cells[:, 1], draw.integers(0, 9, len(cells))
    for left, right in ((scheme >= 0, scheme >= 0), (scheme % 2 == 0, scheme % 2 == 1)):
        want = {}
        for i in np.flatnonzero(left):
            for j in np.flatnonzero(right):
                if company[i] == company[j] and scheme[i] != scheme[j] and (left is not right and left[j] == 0 or scheme[i] < scheme[j]):
                    key = min(scheme[i], scheme[j]), max(scheme[i], scheme[j])
                    want[key] = want.get(key, 0) + min(w[i], w[j])
        for strip in (1, 4, 17, 1 << 21):
            monkeypatch.setattr(overlap, "STRIP_PAIRS", strip)
            found = [x for part in overlap.unit_pairs(scheme, company, w, left, right) for x in zip(*part)]
            assert len(found) == len(want) and {(s, t): n for s, t, n in found} == want
            member = np.unique(scheme)
            more = (np.append(scheme, member), np.append(company, np.full(len(member), -1)), np.append(w, 0 * member))
            low, high = (np.append(side, np.isin(member, scheme[side])) for side in (left, right))
            every = [x for part in overlap._every_pair(*more, low, high) for x in zip(*part)]
            a, b = int(np.sum(low[len(w):])), int(np.sum(high[len(w):]))
            assert len(every) == (a * (a - 1) // 2 if left is right or (left == right).all() else a * b)
            assert {(s, t): n for s, t, n in every if n} == {k: n for k, n in want.items() if n}


def test_tiles_bound_a_hot_key(spark, monkeypatch):
    monkeypatch.setattr("lookthru.operators.tiles.BLOCK_MEMBERS", 50)
    df = spark.range(1000).selectExpr("'hot' as k", "id as m").unionByName(
        spark.range(10).selectExpr("concat('c', id) as k", "id as m"))
    sizes = tiled(df, ["k"], "m").groupBy("k", "_lo", "_hi").count().collect()
    assert max(r["count"] for r in sizes if r.k == "hot") < 200
    assert all(r["count"] == 1 for r in sizes if r.k != "hot")


def test_a_hot_key_is_cut_on_one_side(spark, monkeypatch):
    monkeypatch.setattr("lookthru.operators.tiles.FRAGMENT_ROWS", 50)
    owners = spark.range(2000).selectExpr("'hot' as k", "id as o").unionByName(spark.range(30).selectExpr("concat('c', id) as k", "id as o"))
    held = spark.range(7).selectExpr("'hot' as k", "id as c").unionByName(spark.range(30).selectExpr("concat('c', id) as k", "id as c"))
    held = held.unionByName(spark.createDataFrame([("nobody", 1), (None, 1)], "k string, c long"))
    large, small = fragmented(owners, held, ["k"], "o")
    sizes = large.groupBy("k", "_f").count().collect()
    assert max(r["count"] for r in sizes) < 100 and len([r for r in sizes if r.k == "hot"]) == 40
    assert small.filter("k = 'hot'").count() == 7 * 40 and small.filter("k <> 'hot'").count() == 30
    met = sorted(map(tuple, large.join(small, ["k", "_f"]).select("k", "o", "c").collect()))
    assert met == sorted(map(tuple, owners.join(held, "k").select("k", "o", "c").collect()))


def test_look_through_of_a_scheme_that_all_own(spark, monkeypatch):
    h = holdings(spark, [("A", f"X{i}", 10.0) for i in range(10)] + [("B", "X0", 100.0)])
    p = spark.range(300).selectExpr("concat('P', id) as portfolio_id", "'A' as scheme_code", "double(id + 1) as value")
    p = p.unionByName(p.filter("value < 5").selectExpr("portfolio_id", "'B' as scheme_code", "value"))
    whole = sorted(map(tuple, portfolio.look_through(p, h).collect()))
    monkeypatch.setattr("lookthru.operators.tiles.FRAGMENT_ROWS", 8)
    assert sorted(map(tuple, portfolio.look_through(p, h).collect())) == whole and len(whole) == 3000


def test_overlap_full_has_every_ordered_pair(spark):
    h = holdings(spark, [("A", "X", 60.0), ("B", "X", 12.345)])
    schemes = spark.createDataFrame([("A",), ("B",), ("C",)], "scheme_code string")
    got = {(r.scheme_a, r.scheme_b): r.overlap_pct for r in overlap.overlap_full(h, schemes).collect()}
    assert len(got) == 9
    assert got["A", "A"] == got["C", "C"] == 100.0
    assert got["A", "B"] == got["B", "A"] == 12.35
    assert got["C", "A"] == 0.0


def test_latest_month_is_that_of_resolved_equity(spark):
    h = holdings(spark, [("A", "X", 50.0, M1), ("A", None, 50.0, M2)])
    assert [r.disclosure_month for r in overlap.latest_holdings(h).collect()] == [M1]


def scheme_rows(spark, *codes):
    return spark.createDataFrame(
        [(c, c, "cat", "idx", 1.0, 0.5, 100.0) for c in codes],
        "scheme_code string, scheme_name string, category string, benchmark string, "
        "ter_regular_pct double, ter_direct_pct double, aum_cr double")


def test_active_share_clone_disjoint_and_flag(spark):
    bench = spark.createDataFrame([("X", 50.0), ("Y", 50.0)], "isin string, weight_pct double")
    h = holdings(spark, [("A", "X", 50.0), ("A", "Y", 50.0), ("B", "Z", 100.0), ("C", "X", 90.0)])
    got = {r.scheme_code: (r.active_share_pct, r.closet_index_flag) for r in
           marts.active_share(h, bench, scheme_rows(spark, "A", "B", "C")).collect()}
    assert got == {"A": (0.0, True), "B": (100.0, False), "C": (45.0, False)}


def test_style_drift_shares_and_unmapped_months(spark):
    caps = spark.createDataFrame([("X", "large"), ("Y", "mid"), ("N", None)],
                                 "isin string, cap_bucket string")
    h = holdings(spark, [("A", "X", 30.0), ("A", "Y", 10.0), ("A", "N", 60.0), ("B", "N", 5.0)])
    got = marts.style_drift(h, caps).collect()
    assert [(r.scheme_code, r.large_pct, r.mid_pct, r.small_pct) for r in got] == [("A", 75.0, 25.0, 0.0)]


def test_style_drift_uses_the_list_in_force(spark):
    caps = spark.createDataFrame([("X", "small", dt.date(2020, 1, 1)), ("X", "large", M2)],
                                 "isin string, cap_bucket string, effective_from date")
    h = holdings(spark, [("A", "X", 10.0, M1), ("A", "X", 10.0, M2)])
    got = {r.disclosure_month: r.large_pct for r in marts.style_drift(h, caps, True).collect()}
    assert got == {M1: 0.0, M2: 100.0}


def test_turnover_counts_entries_and_exits(spark):
    h = holdings(spark, [("A", "X", 50.0, M1), ("A", "Y", 50.0, M1), ("A", "X", 60.0, M2),
                         ("A", "Z", 40.0, M2), ("A", "X", 60.0, M3), ("A", "Z", 40.0, M3)])
    full = {r.disclosure_month: r.inferred_turnover_pct for r in marts.turnover_full(h).collect()}
    assert full == {M2: (10 + 50 + 40) * 6.0, M3: 0.0}
    lag = {r.disclosure_month: r.inferred_turnover_pct for r in marts.turnover_lag(h).collect()}
    assert lag == {M2: 60.0, M3: 0.0}


def test_turnover_single_month_gives_nothing(spark):
    assert marts.turnover_full(holdings(spark, [("A", "X", 50.0)])).count() == 0


def test_crowding_and_days_to_liquidate(spark):
    h = holdings(spark, [("A", "X", 10.0), ("B", "X", 5.0), ("A", "U", 50.0)])
    companies = spark.createDataFrame([("X", "Xco", "large", 1.0)],
                                      "isin string, company_name string, cap_bucket string, "
                                      "free_float_shares_cr double")
    prices = spark.createDataFrame([("X", 100.0, 50000.0, "XX")],
                                   "isin string, close double, adv_shares_30d double, nse_symbol string")
    crowd = marts.crowding(h, scheme_rows(spark, "A"), companies)
    row = crowd.collect()[0]  # scheme B has no size on record and counts as zero
    assert (row.isin, row.value_cr, row.mf_holding_cr) == ("X", 10.0, 10.0)
    d = marts.days_to_liquidate(crowd, prices).collect()[0]
    assert d.days_to_liquidate == 100.0 and d.mf_pct_of_free_float == 10.0
    zero = prices.selectExpr("isin", "close", "0.0D as adv_shares_30d", "nse_symbol")
    assert marts.days_to_liquidate(crowd, zero).collect()[0].days_to_liquidate is None


def test_fee_drag_bounds_and_zero_rate(spark):
    s = spark.createDataFrame([("A", 0.5, 1.5), ("Z", 12.0, 12.0)],
                              "scheme_code string, ter_direct_pct double, ter_regular_pct double")
    got = {r.scheme_code: r for r in marts.fee_drag_grid(s, [(10000, 20, 12.0)]).collect()}
    a = got["A"]
    assert 90e5 < a.terminal_value_direct < 94e5 and 79e5 < a.terminal_value_regular < 83e5
    assert 9e5 < a.difference < 13e5
    assert got["Z"].terminal_value_direct == got["Z"].invested == 2_400_000.0


def positions(spark, rows):
    return spark.createDataFrame(rows, "portfolio_id string, scheme_code string, value double")


def test_look_through_weights_and_missing_scheme(spark):
    h = holdings(spark, [("A", "X", 100.0), ("B", "X", 50.0), ("B", "Y", 50.0)])
    p = positions(spark, [("P", "A", 750000.0), ("P", "B", 250000.0), ("Q", "A", 50.0), ("Q", "NONE", 50.0)])
    got = {(r.portfolio_id, r.company_id): (r.weight_pct, r.value)
           for r in portfolio.look_through(p, h).collect()}
    assert got == {("P", "X"): (87.5, 875000.0), ("P", "Y"): (12.5, 125000.0), ("Q", "X"): (50.0, 50.0)}


def test_concentration_hhi(spark):
    one = holdings(spark, [("A", "X", 100.0)])
    ten = holdings(spark, [("B", f"C{i}", 10.0) for i in range(10)])
    lt = portfolio.look_through(positions(spark, [("P", "A", 1.0), ("Q", "B", 1.0)]), one.unionByName(ten))
    got = {r.portfolio_id: r for r in portfolio.concentration(lt).collect()}
    assert got["P"].hhi == 10000.0 and got["Q"].hhi == 1000.0
    assert got["Q"].top_5_pct == 50.0 and got["Q"].unique_companies == 10
    assert got["P"].top_holding == "X"


def test_portfolio_status_flags_invalid(spark):
    h = holdings(spark, [("A", "X", 100.0)])
    p = positions(spark, [("P", "A", 10.0), ("P", "A", 5.0), ("Q", "B", 10.0), ("R", "A", -1.0)])
    got = {r.portfolio_id: (r.total_value, r.fund_count, r.valid)
           for r in portfolio.portfolio_status(p, h).collect()}
    assert got == {"P": (15.0, 1, True), "Q": (0.0, 0, False), "R": (0.0, 0, False)}


def test_xray_returns_all_tables(spark):
    h = holdings(spark, [("A", "X", 100.0), ("B", "X", 40.0)])
    companies = spark.createDataFrame([("X", "Tech", "large")], "isin string, sector string, cap_bucket string")
    p = positions(spark, [("P", "A", 10.0), ("P", "B", 30.0)])
    out = portfolio.xray(p, h, scheme_rows(spark, "A", "B"), companies, overlap.overlap_pairs(h))
    got = {k: v.collect() for k, v in out.items()}
    assert got["overlaps"][0].overlap_pct == 40.0 and got["overlaps"][0].scheme_b_name == "B"
    assert got["fees"][0].weighted_ter_regular_pct == 1.0
    assert {(r.kind, r["name"], r.weight_pct) for r in got["split"]} == {
        ("sector", "Tech", 55.0), ("cap_bucket", "large", 55.0)}
    assert got["top_holdings"][0]["rank"] == 1


def test_pairs_of_a_portfolio_are_not_shuffled(spark, explain, monkeypatch):
    h = holdings(spark, [("A", "X", 60.0), ("A", "Y", -5.0), ("B", "X", 40.0), ("B", "Y", 3.0), ("C", "Z", 9.0), ("C", "Y", 1.004)])
    p = positions(spark, [(who, s, 1.0) for who in "PQ" for s in "ABCD"])
    weights = overlap.scheme_company_weights(overlap.latest_holdings(h))
    want = {("A", "B"): 35.0, ("A", "C"): -5.0, ("A", "D"): 0.0, ("B", "C"): 1.0, ("B", "D"): 0.0, ("C", "D"): 0.0}
    for block in (2000, 2):
        monkeypatch.setattr("lookthru.operators.tiles.BLOCK_MEMBERS", block)
        df = portfolio.portfolio_overlaps(p, weights, scheme_rows(spark, "A", "B", "C"))
        assert not re.search(r"hashpartitioning\([^)]*(s1|scheme_a)", explain(df))
        rows = df.collect()
        assert len(rows) == 12 and all({(r.scheme_a, r.scheme_b): r.overlap_pct for r in rows if r.portfolio_id == x} == want for x in "PQ")
        assert {r.scheme_b_name for r in rows} == {"B", "C", None}


def test_direct_lens(spark):
    d = spark.createDataFrame([("P", "X", "XX", 10.0, 5.0, 8.0), ("P", "Y", "YY", 5.0, 4.0, 4.0)],
                              "portfolio_id string, isin string, symbol string, quantity double, "
                              "average_price double, ltp double")
    t = portfolio.direct_totals(d).collect()[0]
    assert (t.total_value, t.total_invested, t.total_pnl, t.total_pnl_pct) == (100.0, 70.0, 30.0, 42.86)
    w = {r.company_id: r.weight_pct for r in portfolio.direct_weights(d).collect()}
    assert w == {"X": 80.0, "Y": 20.0}


@pytest.mark.parametrize("value,rounded", [(1.005, 1.01), (2.675, 2.68), (-1.005, -1.01)])
def test_rounding_is_half_up_on_decimals(spark, value, rounded):
    from pyspark.sql import functions as F
    got = spark.range(1).select(marts.rounded(F.lit(value), 2).alias("r")).first().r
    assert got == rounded
