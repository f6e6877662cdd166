"""The readers of landed files parse a body once, and a row's texts once."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from vintara.functions import scalars
from vintara.plans import catalog, landed  # noqa: F401  (landed registers its queries)

D = "/root/testdata/sf0.001"


def plan(df):
    session = df.sparkSession
    session.conf.set("spark.sql.maxPlanStringLength", "10000000")
    try:
        return df._jdf.queryExecution().executedPlan().toString()
    finally:
        session.conf.unset("spark.sql.maxPlanStringLength")


@pytest.mark.parametrize("name", ["read_company_facts", "read_submissions", "read_tickers", "read_macro_observations", "read_vintage_dates"])
def test_bodies_are_parsed_once(spark, name):
    assert plan(catalog.QUERIES[name](spark, D)).count("from_json(") == 1


def test_values_are_parsed_once_and_a_company_is_shuffled_once(spark):
    text = plan(catalog.QUERIES["read_company_facts"](spark, D))
    dates = text.count("gettimestamp(")
    assert dates == 3, "start, end and filed, not again in the filter"
    assert text.count("Exchange hashpartitioning(cik") == 1


def test_no_cast_of_texts_without_exponent(spark):
    """try_cast of an empty text throws inside for each row."""
    texts = ["5.0000000000", "0E-10", "1.5e3", "-2E+27", "1e28", "1E-11", "1.50e-9", "", " 7 ", "x", None, "1.12345678901", "+3.10000000000000"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", scalars.parse_decimal(F.col("t")).alias("v"))
    assert "try_cast(regexp_extract" not in plan(df) and "TRY_CAST(regexp_extract" not in plan(df)
    d = Decimal
    want = [d(5), d(0), d(1500), d(-2) * 10**27, None, None, d("1.5E-9"), None, d(7), None, None, None, d("3.1")]
    assert [r["v"] for r in df.collect()] == want
