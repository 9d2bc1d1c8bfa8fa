"""The gate of every scheme-month, counted in one pass."""

from lookthru.operators import quality
from lookthru.plans import feeds
from lookthru.plans.catalog import QUERIES

SCHEMA = "scheme_code string, disclosure_month date, weight_pct double"


def test_gate_counts_are_the_rows_of_both_sides(spark, data):
    h = feeds.filed_holdings(spark, data)
    good, bad = quality.promotable(h)
    told = {(r.scheme_code, r.disclosure_month, r.gate): r.rows for r in quality.gate_counts(h).collect()}
    for side, gate in ((good, "publish"), (bad, "quarantine")):
        want = {(r.scheme_code, r.disclosure_month, gate): r["count"] for r in side.groupBy("scheme_code", "disclosure_month").count().collect()}
        assert want and {k: n for k, n in told.items() if k[2] == gate} == want


def test_gate_counts_of_rows_without_a_key_or_weight(spark):
    h = spark.sql("""SELECT * FROM VALUES ('A', DATE'2001-01-01', 60D), ('A', DATE'2001-01-01', 40D), ('B', DATE'2001-01-01', CAST(NULL AS DOUBLE)),
        (NULL, DATE'2001-01-01', 100D), ('A', NULL, 100D) AS t(scheme_code, disclosure_month, weight_pct)""")
    assert sorted((r.scheme_code, r.gate, r.rows) for r in quality.gate_counts(h).collect()) == [("A", "publish", 2), ("B", "quarantine", 1)]


def test_gate_reads_the_line_items_once(spark, data, explain):
    """A join of the verdicts back to the holdings would work them out again."""
    plan = explain(QUERIES["promotion_gate"](spark, data))
    tree = plan.split("\n\n\n")[0]
    assert "SortMergeJoin" not in tree and tree.count("Window") == 1
