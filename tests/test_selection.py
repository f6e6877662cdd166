"""Exact quantiles by selection, against sorting."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vintara.operators import corpus, selection
from vintara.plans import catalog
from vintara.sources import projection


def sorted_quantile(values, q):
    values = sorted(values)
    at = q * (len(values) - 1)
    low, high = values[int(at)], values[-(-int(at * 10**9) // 10**9) if at % 1 else int(at)]
    return low + (high - low) * (at - int(at))


QS = (0.0, 0.25, 0.5, 0.9, 0.99, 1.0)


@pytest.mark.parametrize("kind", ["spread", "ties", "two values", "hot value"])
def test_large_columns_are_narrowed(spark, monkeypatch, kind):
    monkeypatch.setattr(selection, "SMALL", 16)
    monkeypatch.setattr(selection, "ACCURACY", 50)
    rng = random.Random(kind)
    one = {"spread": lambda: rng.lognormvariate(0, 3) - 1, "ties": lambda: float(rng.randrange(30)), "two values": lambda: float(rng.random() < 0.3), "hot value": lambda: 2.0 if rng.random() < 0.6 else rng.random() * 4}[kind]
    rows = [(one(), one() if k % 3 else None) for k in range(5000)]
    df = spark.createDataFrame(rows, "a double, b double").repartition(5)
    got = selection.exact_quantiles(df, {"a": F.col("a"), "b": F.col("b"), "negative": -F.col("a"), "none": F.lit(None)}, QS)
    for name, values in (("a", [r[0] for r in rows]), ("b", [r[1] for r in rows if r[1] is not None]), ("negative", [-r[0] for r in rows])):
        assert got[name] == pytest.approx([sorted_quantile(values, q) for q in QS])
    assert got["none"] == [None] * len(QS)


@settings(max_examples=8, deadline=None)
@given(values=st.lists(st.one_of(st.none(), st.floats(allow_nan=False, width=32)), max_size=60))
def test_small_columns(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    known = [v for v in values if v is not None]
    assert selection.exact_quantiles(df, {"v": F.col("v")}, [0.0, 1.0])["v"] == ([min(known), max(known)] if known else [None, None])


def test_no_percentile_over_all_rows(spark, monkeypatch):
    """The plans of the rounds hold partial counts and sketches; what is collected is bounded."""
    seen = []
    order_statistics = selection.order_statistics

    def spied(rows, ranks, sizes):
        class Spy:
            def agg(self, *columns):
                out = rows.agg(*columns)
                seen.append(out._jdf.queryExecution().toString())
                return out

        return order_statistics(Spy(), ranks, sizes)

    monkeypatch.setattr(selection, "SMALL", 8)
    monkeypatch.setattr(selection, "order_statistics", spied)
    facts = projection.facts(spark, "/root/testdata/sf0.001")
    assert corpus.change_quantiles(facts).count() == len(corpus.QUANTILES) and corpus.by_unit_class(facts).count() == 3
    plans = "\n".join(seen)
    assert len(seen) >= 4 and "percentile(" not in plans and "percentile_approx" in plans.lower().replace("approx_percentile", "percentile_approx")


def test_quantile_queries_against_their_sql(spark):
    import duckdb

    d = "/root/testdata/sf0.001"
    db = duckdb.connect()
    for name in ("lineitem", "orders"):
        db.sql(f"CREATE VIEW {name} AS SELECT * FROM '{d}/{name}.parquet'")
    for name in ("contamination_quantiles", "unit_class"):
        got = catalog.QUERIES[name](spark, d)
        want = db.sql(catalog.SQL[name])
        assert sorted(map(tuple, got.select(*want.columns).collect()), key=str) == sorted(want.fetchall(), key=str)
