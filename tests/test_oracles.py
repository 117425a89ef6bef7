"""Every query with an oracle, on the smallest tables; those of a subpackage come by themselves if it is there."""

from __future__ import annotations

import math
import os

import pytest

import __spark_entry__ as driver

DATA = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "null"
    if isinstance(value, float):
        return f"{value + 0.0:.6g}"
    return str(value)


@pytest.mark.parametrize("name", sorted(driver.oracle_sql()))
def test_query_matches_its_oracle(spark, name):
    con = duckdb.connect()
    for file in os.listdir(DATA):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{DATA}/{file}'")
    made = driver.queries()[name](spark, DATA)
    columns = sorted(made.columns)
    found = con.execute(driver.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    expected = sorted(tuple(plain(r[k]) for k in order) for r in found.fetchall())
    assert sorted(tuple(plain(r[c]) for c in columns) for r in made.collect()) == expected


def test_entry_runs(spark):
    assert driver.entry(spark).count() > 0


def test_slot_queries_agree_with_each_other(spark):
    q = driver.queries()
    trades, curve, stats = (q[n](spark, DATA).toPandas() for n in ("slot_sim", "equity_curve", "portfolio_stats"))
    assert stats.trades[0] == len(trades) and curve.open_positions.max() <= 15
    assert math.isclose(stats.total_return_net[0], curve.sort_values("date").equity.iloc[-1] / 1e6 - 1, abs_tol=1e-6)
