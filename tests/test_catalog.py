"""Every query against its SQL twin on the smallest data set."""

import re

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()
QUICK = ("overlap_pairs", "overlap_salted", "active_share", "style_drift", "turnover_full", "crowding",
         "dtl", "look_through", "concentration", "xray_sectors", "portfolio_risk", "dq_report",
         "nav_parse", "scheme_match", "silver_dedup", "corp_adjust", "isin_validate", "pii_redact",
         "tick_dedup", "snapshot_read", "file_manifest")


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return c


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_its_sql(spark, data, con, name):
    df = queries()[name](spark, data)
    cur = con.execute(oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(cols)
    assert canonical(df.columns, map(tuple, df.collect())) == canonical(cols, cur.fetchall())


def test_every_sql_has_a_query_and_entry_runs(spark):
    assert set(oracle_sql()) <= set(queries())
    plain = {n for n in queries() if n != "pipeline" and not re.match(r"op\d+_", n)}
    assert plain <= set(oracle_sql())
    assert entry(spark).count() > 0


def test_no_cross_join_in_the_heavy_plans(spark, data, explain):
    for name in ("overlap_pairs", "look_through", "scheme_match", "silver_resolve", "corp_adjust", "style_drift_asof"):
        plan = explain(queries()[name](spark, data))
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan, name
