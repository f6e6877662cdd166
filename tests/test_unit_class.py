"""Unit classes: facts are grouped once, and chains end where sorting ends them."""

from datetime import date
from decimal import Decimal

from vintara.operators import corpus, selection, staging

SCHEMA = "cik long, taxonomy string, concept string, unit string, period_start date, period_end date, value decimal(38,10), accn string, knowledge_date date"


def facts(spark):
    row = lambda cik, unit, value, accn, day: (cik, "t", "c", unit, None, date(2024, 3, 31), None if value is None else Decimal(value), accn, day and date(2024, 1, day))
    rows = [
        row(1, "USD/shares", 4, "a", 2), row(1, "USD/shares", 2, "b", 1),  # up: 2, then 4
        row(2, "USD/shares", 4, "a", 1), row(2, "USD/shares", 1, "b", 1),  # down: the filing breaks the tie
        row(3, "USD", 7, "a", 1), row(3, "USD", 8, "a", 1), row(3, "USD", 6, "z", None),  # a report without a day is first: 6, then 8
        row(4, "USD", 5, "a", 1),
        row(5, "USD", None, "a", 1), row(5, "USD", 3, "b", 2),  # a first report without a value: one value, not restated
    ]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def plan(df):
    return df._jdf.queryExecution().toString()


def test_facts_are_grouped_once(spark, monkeypatch):
    calls = []
    for module in (corpus, selection):
        monkeypatch.setattr(module, "staged", lambda rows: calls.append(plan(rows)) or staging.staged(rows), raising=False)
    out = corpus.by_unit_class(facts(spark))
    assert "period_end" not in plan(out), "the counts do not group the facts again"
    assert len(calls) == 1 and "Aggregate" in calls[0]
    assert "min_by" not in calls[0] and "max_by" not in calls[0], "a report is not kept beside its own order"
    got = {r["unit_class"]: tuple(r)[1:] for r in out.collect()}
    assert got == {"per-share": (2, 2, 1, 1, 0.625, 0.5), "other": (3, 1, 1, 0, 0.25, 0.0)}


def test_no_facts(spark):
    assert corpus.by_unit_class(facts(spark).limit(0)).collect() == []


def test_first_and_latest_report(spark):
    got = {r["cik"]: (r["n_reports"], r["restated"], r["first_value"], r["latest_value"]) for r in corpus.per_fact(facts(spark)).collect()}
    assert got == {1: (2, True, 2, 4), 2: (2, True, 4, 1), 3: (3, True, 6, 8), 4: (1, False, 5, 5), 5: (2, False, None, 3)}
