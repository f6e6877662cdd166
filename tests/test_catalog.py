"""Every query of the catalogue against DuckDB on the same files."""

import math
import os
from decimal import Decimal

import duckdb
import pytest

from vintara.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, (float, Decimal)):
        return None if isinstance(v, float) and math.isnan(v) else f"{float(v):.9g}"
    return v if v is None or isinstance(v, bool) else str(v)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted([tuple(plain(r[k]) for k in order) for r in data], key=str)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    result = duck.execute(catalog.SQL[name])
    names = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, df.collect()) == rows(names, result.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_query_without_sql_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_flagship_values(spark):
    want = {"0.001": (4306, 1233, 6000, 2948, 385, 426, 5, 620, 579, 34), "0.01": (42891, 12074, 60000, 29431, 3876, 4050, 99, 5867, 5875, 332)}
    for sf, values in want.items():
        r = catalog.QUERIES["contamination_tally"](spark, f"/root/testdata/sf{sf}").first()
        names = ("facts", "restated_facts", "rows_total", "reported_once", "sign_flips", "zero_endpoint", "undefined_change", "revised_up", "revised_down", "returned")
        assert tuple(r[n] for n in names) == values
        assert r["revised_up"] + r["revised_down"] + r["returned"] == r["restated_facts"]


@pytest.mark.parametrize("name", ["asof_facts", "fact_revisions", "quantile_sides", "survival_split", "panel_asof_pick"])
def test_results_do_not_depend_on_partitioning(spark, name):
    first = rows([], [[]]) and rows(catalog.QUERIES[name](spark, SF).columns, catalog.QUERIES[name](spark, SF).collect())
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "13")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        again = catalog.QUERIES[name](spark, SF)
        assert rows(again.columns, again.collect()) == first
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_key_filters_reach_the_scan_and_dates_stay_above_the_window(spark):
    from datetime import date

    from vintara.operators.asof import AsOf

    view = AsOf(catalog.tables(spark, SF), date(2000, 6, 30))
    plan = view.first_reported(taxonomy="F", cik=7)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(l_partkey,7)" in plan and "EqualTo(l_linestatus,F)" in plan


def test_entry_points():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(catalog.QUERIES) <= set(e.queries())
    assert os.path.exists(SF)
