"""Operators against literal cases."""

import ast
from datetime import date, datetime, timezone
from decimal import Decimal
from pathlib import Path

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from vintara import schemas
from vintara.errors import AmbiguousPeriod, InsufficientData
from vintara.functions import hashing, scalars
from vintara.operators import asof, backtest, corpus, features, forensics, panel, store, views
from vintara.operators.asof import INSTANT, AsOf
from vintara.operators.joins import asof_backward, asof_forward
from vintara.plans import service

FACTS = "cik long, taxonomy string, concept string, unit string, period_start date, period_end date, value decimal(38,10), accn string, form string, filed_at date, knowledge_date date"


def d(text):
    return date.fromisoformat(text)


def facts(spark, rows):
    """rows: (cik, concept, unit, start or None, end, value, accn, filed, known or None)."""
    full = [(c, "us-gaap", k, u, s and d(s), d(e), Decimal(str(v)), a, "10-K", d(f), d(n or f)) for c, k, u, s, e, v, a, f, n in rows]
    return spark.createDataFrame(full, FACTS)


def view(spark, rows, day, **more):
    return AsOf({"facts": facts(spark, rows), **more}, d(day))


EPS = "EarningsPerShareDiluted"
RESTATED = [
    (320193, EPS, "USD/shares", "2007-09-30", "2008-09-27", "5.36", "0001193125-09-214859", "2009-10-27", None),
    (320193, EPS, "USD/shares", "2007-09-30", "2008-09-27", "6.78", "0001193125-10-012091", "2010-01-25", None),
]


@pytest.mark.parametrize(("day", "value"), [("2009-10-27", "5.36"), ("2009-12-01", "5.36"), ("2010-01-24", "5.36"), ("2010-01-25", "6.78"), ("2010-06-01", "6.78")])
def test_restatement_by_date(spark, day, value):
    assert view(spark, RESTATED, day).value(320193, EPS) == Decimal(value)


def test_nothing_before_the_first_report(spark):
    with pytest.raises(InsufficientData):
        view(spark, RESTATED, "2009-10-26").fact(320193, EPS)


def test_revision(spark):
    r = view(spark, RESTATED, "2010-06-01").revisions(320193).collect()
    assert len(r) == 1 and r[0]["relative_change"] == pytest.approx(0.2649, abs=1e-4) and r[0]["days_between"] == 90
    assert not view(spark, RESTATED, "2010-01-24").revisions(320193).count()


YEAR_QUARTER = [
    (1, "NetIncomeLoss", "USD", "2014-09-28", "2015-09-26", "53394000000", "0001193125-15-356351", "2015-10-28", None),
    (1, "NetIncomeLoss", "USD", "2015-06-28", "2015-09-26", "11124000000", "0001193125-15-356351", "2015-10-28", None),
]


def test_ambiguous_period_and_pins(spark):
    v = view(spark, YEAR_QUARTER, "2016-01-01")
    with pytest.raises(AmbiguousPeriod, match="363d.*90d"):
        v.fact(1, "NetIncomeLoss")
    assert v.value(1, "NetIncomeLoss", period_start=d("2014-09-28")) == 53394000000
    assert v.value(1, "NetIncomeLoss", period_start=d("2015-06-28")) == 11124000000
    with pytest.raises(InsufficientData):
        v.fact(1, "NetIncomeLoss", period_start=INSTANT)
    assert asof.ambiguous_ends(v.tables["facts"]).first()["starts"] == 2


BACK = [(1750, "AccruedLiabilitiesCurrent", "USD", None, "2021-05-31", v, f"0000001750-2{k}-000001", f, None) for k, (v, f) in enumerate([(174200000, "2021-07-21"), (174200000, "2021-09-23"), (148300000, "2021-12-21"), (148300000, "2022-03-22"), (174200000, "2022-07-21")])]


def test_revised_and_back(spark):
    rows = views.facts_pit(facts(spark, BACK)).orderBy("report_seq").collect()
    assert [r["report_seq"] for r in rows] == [1, 2, 3, 4, 5]
    assert [r["differs_from_first_report"] for r in rows] == [False, False, True, True, False]
    assert {r["period_distinct_values"] for r in rows} == {2}
    t = corpus.tally(facts(spark, BACK)).first()
    assert (t["facts"], t["restated_facts"], t["returned"]) == (1, 1, 1)
    story = lambda day: asof.narrative(asof.vintage_triples(facts(spark, BACK), d(day))).first()
    assert story("2022-01-01")["story"] == "revised and back" and not story("2022-01-01")["known_is_current"]


def test_represented_is_not_revised(spark):
    rows = [(1750, "ProfitLoss", "USD", "2018-06-01", "2018-11-30", 22100000, a, f, None) for a, f in (("0000001750-18-000001", "2018-12-19"), ("0000001750-19-000001", "2019-12-20"))]
    t = asof.narrative(asof.vintage_triples(facts(spark, rows), d("2019-01-01"))).first()
    assert t["is_restated"] and not t["value_changed"] and t["story"] == "re-presented"


def test_late_dissemination_orders_the_chain(spark):
    rows = [(1234567, EPS, "USD/shares", "2024-10-01", "2025-09-30", "5.36", "a", "2026-01-12", "2026-06-30"), (1234567, EPS, "USD/shares", "2024-10-01", "2025-09-30", "6.78", "b", "2026-03-10", None)]
    first = views.facts_pit(facts(spark, rows)).where("report_seq = 1").first()
    assert first["value"] == Decimal("6.78")
    assert not view(spark, rows, "2026-06-29").revisions().count()
    assert view(spark, rows, "2026-06-30").revisions().first()["value"] == Decimal("5.36")


def test_intermediate_value(spark):
    rows = [(1, "OtherAssetsCurrent", "USD", None, "2009-09-26", v, f"a{k}", f, None) for k, (v, f) in enumerate([("6.884e9", "2009-10-27"), ("3.140e9", "2010-01-25"), ("1.444e9", "2010-07-21"), ("1.444e9", "2010-10-27")])]
    stories = [asof.narrative(asof.vintage_triples(facts(spark, rows), d(day))).first()["story"] for day in ("2009-12-01", "2010-03-01", "2010-08-01")]
    assert stories == ["restated later", "restated, intermediate shown", "restated, current shown"]


def test_zero_base(spark):
    same = [(1, "X", "USD", None, "2020-01-01", 0, "a", "2020-02-01", None), (1, "X", "USD", None, "2020-01-01", 0, "b", "2020-03-01", None)]
    moved = [(2, "X", "USD", None, "2020-01-01", 0, "a", "2020-02-01", None), (2, "X", "USD", None, "2020-01-01", 5, "b", "2020-03-01", None)]
    v = view(spark, same + moved, "2021-01-01")
    assert [r["cik"] for r in v.revisions(min_relative_change=1e9).collect()] == [2]
    drift = asof.vintage_triples(v.tables["facts"], d("2021-01-01")).collect()
    assert [r["relative_drift"] for r in drift] == [None, None]


def test_row_and_fact_grain(spark):
    rows = [(1, "X", "USD", None, "2020-01-01", v, f"a{k}", f"2020-0{k + 2}-01", None) for k, v in enumerate((100, 110, 120, 130))]
    t, r = corpus.tally(facts(spark, rows)).first(), corpus.restated_rows(facts(spark, rows)).first()
    assert (t["facts"], t["restated_facts"], r["rows_total"], r["restated_rows"], r["restated_row_share"]) == (1, 1, 4, 3, 0.75)


def test_guard_fires_for_any_projection_and_stays_quiet(spark):
    df = facts(spark, RESTATED)
    for read in (lambda x: x.count(), lambda x: x.select("cik").collect()):
        with pytest.raises(PySparkException, match="reached a read"):
            read(asof.guard(df, d("2009-12-01")))
        read(asof.guard(df, d("2010-12-01")))


def test_opposing_cohorts(spark):
    rows = []
    def report(cik, concept, values, year):  # noqa: E306
        for k, v in enumerate(values):
            rows.append((cik, concept, "USD", None, "2010-12-31", v, f"{cik}{concept}{k}", f"{year + k}-02-01", None))
    for c in "AB":
        report(1, c, (100, 150), 2023)
        report(2, c, (100, 150), 2011)
    for c in "CD":
        report(1, c, (100, 100), 2023)
    for c in "EF":
        report(1, c, (100,), 2023)
    report(2, "C", (100, 100), 2011)
    for c in "DEFG":
        report(2, c, (100,), 2011)
    s = corpus.survival_split(facts(spark, rows), ["2020-01-01"]).first()
    assert (s["active_facts"], s["active_restatable"], s["active_restated"]) == (6, 4, 2)
    assert (s["dormant_facts"], s["dormant_restatable"], s["dormant_restated"]) == (7, 3, 2)
    assert s["gap"] is None


# Filings


def test_late_filing(spark):
    f = spark.createDataFrame([("0001213900-25-081198", 1, "10-K", d("2025-08-27"), d("2026-07-24")), ("x", 1, "10-K", d("2025-01-01"), None)], "accn string, cik long, form string, filed_at date, disseminated_at date")
    r = {x["accn"]: x for x in views.filings_pit(f).collect()}
    late, plain = r["0001213900-25-081198"], r["x"]
    assert (late["knowledge_date"], late["was_disseminated_late"], late["dissemination_lag_days"]) == (d("2026-07-24"), True, 331)
    assert (plain["knowledge_date"], plain["was_disseminated_late"], plain["dissemination_lag_days"]) == (d("2025-01-01"), False, 0)


@pytest.mark.parametrize(("priors", "lag", "flagged"), [((40, 41, 39, 40, 42), 106, True), ((40, 41, 39, 40, 42), 41, False), ((85, 86, 84, 85, 87), 86, False), ((40, 40, 40), 106, False), ((40, 40, 40, 40), 46, True), ((40, 40, 40, 40), 45, False)])
def test_filing_lag_habit(spark, priors, lag, flagged):
    rows = [(f"a{k}", 1, "10-Q", date.fromordinal(d("2020-01-01").toordinal() + 91 * k), x) for k, x in enumerate((*priors, lag))]
    df = spark.createDataFrame(rows, "accn string, cik long, form string, period_of_report date, lag int").withColumn("knowledge_date", F.expr("date_add(period_of_report, lag)")).withColumn("items", F.array().cast("array<string>"))
    got = forensics.flags(df).where(F.col("accn") == f"a{len(priors)}").first()
    assert got["unusual_lag"] is flagged and got["flags"] == (["UNUSUAL_FILING_LAG"] if flagged else [])


@pytest.mark.parametrize(
    ("form", "items", "score", "band"),
    [("8-K", ["4.02", "5.02"], 6.0, "CONFESSED"), ("8-K", ["4.01"], 3.0, "STRONG"), ("NT 10-K", [], 2.0, "MODERATE"), ("10-K/A", [], 1.0, "WEAK"), ("8-K", ["5.02"], 0.0, "NONE"), ("10-K/A", ["5.02(b)"], 2.0, "STRONG"), ("8-K", None, 0.0, "NONE")],
)
def test_bands(spark, form, items, score, band):
    df = spark.createDataFrame([("a", 1, form, items, d("2020-01-01"), d("2020-02-01"))], "accn string, cik long, form string, items array<string>, period_of_report date, knowledge_date date")
    r = forensics.flags(df).first()
    assert (r["score"], r["confidence"]) == (score, band)


# Macro and prices


def test_macro_vintages(spark):
    steps = [("17205.822", "2020-07-30"), ("17282.188", "2020-08-27"), ("17302.511", "2020-09-30"), ("17258.205", "2021-07-29"), ("17378.712", "2022-09-29"), ("19034.830", "2023-09-28"), ("19056.617", "2024-09-26"), ("19077.992", "2025-09-25")]
    df = spark.createDataFrame([("GDPC1", d("2020-04-01"), d(s), float(v)) for v, s in steps], "series_id string, obs_date date, realtime_start date, value double")
    at = lambda day: AsOf({"macro": df}, d(day)).macro("GDPC1", d("2020-04-01"))
    assert (at("2020-07-30"), at("2020-08-26"), at("2020-12-31"), at("2024-01-01"), at("2030-01-01")) == (17205.822, 17205.822, 17302.511, 19034.83, 19077.992)
    with pytest.raises(InsufficientData):
        at("2020-07-29")
    empty = df.unionByName(spark.createDataFrame([("GDPC1", d("2020-04-01"), d("2026-01-01"), None)], df.schema))
    with pytest.raises(InsufficientData):
        AsOf({"macro": empty}, d("2026-02-01")).macro("GDPC1", d("2020-04-01"))


@pytest.mark.parametrize(("values", "n"), [((1.0, 1.0), 1), ((1.0, 2.0), 2), ((1.0, 2.0, 1.0), 3), ((None, None), 1), ((None, 1.0, None), 3)])
def test_merge_runs(spark, values, n):
    rows = [("s", d("2020-01-01"), date(2020, 2, k + 1), date(2020, 3, k + 1), v) for k, v in enumerate(values)]
    df = spark.createDataFrame(rows, "series_id string, obs_date date, realtime_start date, realtime_end date, value double")
    got = store.merge_unrevised_runs(df).collect()
    assert len(got) == n and got[0]["realtime_start"] == date(2020, 2, 1) and got[-1]["realtime_end"] == date(2020, 3, len(values))


def test_prices(spark):
    bars = [("AAPL", date(2024, 1, k), 185.0, 186.0, 184.0, 185.5, 184.9, 1e6) for k in (2, 3, 4, 5)]
    df = spark.createDataFrame(bars, "symbol string, bar_date date, open double, high double, low double, close double, adj_close double, volume double")
    got = AsOf({"prices": df}, d("2024-01-03")).prices("AAPL", execution_lag_days=1).orderBy("bar_date").collect()
    assert [(r["bar_date"], r["tradable_from"]) for r in got] == [(date(2024, 1, 2), date(2024, 1, 3)), (date(2024, 1, 3), date(2024, 1, 4))]
    with pytest.raises(ValueError):
        AsOf({"prices": df}, d("2024-01-03")).prices("AAPL", execution_lag_days=-1)


# Features, panel, backtest

SPEC = features.AccrualsSpec()
CFO = SPEC.cash_flow


def fy2009(cash=CFO):
    one, two = ("0001193125-09-214859", "2009-10-27"), ("0001193125-10-012091", "2010-01-25")
    year = ("2008-09-28", "2009-09-26")
    rows = [(1, "NetIncomeLoss", "USD", "2007-09-30", "2008-09-27", 4834000000, "0001193125-08-224958", "2008-11-05", None)]
    rows += [(1, "NetIncomeLoss", "USD", *year, v, *r, None) for v, r in ((5704000000, one), (8235000000, two))]
    rows += [(1, cash, "USD", *year, 10159000000, *r, None) for r in (one, two)]
    rows += [(1, "Assets", "USD", None, "2009-09-26", v, *r, None) for v, r in ((53851000000, one), (47501000000, two))]
    rows += [(1, "Assets", "USD", None, "2008-09-27", 39572000000, "0001193125-09-153165", "2009-07-22", None), (1, "Assets", "USD", None, "2008-09-27", 36171000000, *two, None)]
    return rows


@pytest.mark.parametrize("cash", [CFO, SPEC.cash_flow_fallback])
def test_accruals_by_arm(spark, cash):
    got = {r["arm"]: r for r in features.accruals(facts(spark, fy2009(cash))).where("period_end = '2009-09-26'").collect()}
    honest = (5704 - 10159) / ((53851 + 39572) / 2)
    restated = (8235 - 10159) / ((47501 + 36171) / 2)
    assert got["first_reported"]["value"] == pytest.approx(honest) and got["restated_values"]["value"] == pytest.approx(restated) == got["naive_vendor"]["value"]
    assert got["first_reported"]["knowledge_date"] == d("2009-10-27") == got["restated_values"]["knowledge_date"]
    assert got["naive_vendor"]["knowledge_date"] == d("2009-09-26")
    assert [got[a]["uses_restated_input"] for a in features.ARMS] == [False, True, True]
    first_year = features.accruals(facts(spark, fy2009())).where("period_end = '2008-09-27'").collect()
    assert {r["drop_reason"] for r in first_year} == {"NO_PRIOR_YEAR"}


def test_timing_channel(spark):
    rows = []
    ends = {2013: ("2013-01-01", 80000), 2014: ("2014-01-01", 90000), 2015: ("2015-01-01", 100000), 2016: ("2016-01-01", 110000)}
    filed = {2013: "2014-02-20", 2014: "2015-02-20", 2015: "2016-02-19", 2016: "2017-02-17"}
    flows = {2013: (100, 100), 2014: (500, 2000), 2015: (1000, 5000), 2016: (9000, 1000)}
    for y, (start, assets) in ends.items():
        end = f"{y}-12-31"
        for c, v in (("NetIncomeLoss", flows[y][0]), (CFO, flows[y][1])):
            rows.append((1, c, "USD", start, end, v, f"a{y}", filed[y], None))
        rows.append((1, "Assets", "USD", None, end, assets, f"a{y}", filed[y], None))
    f = features.accruals(facts(spark, rows))
    got = {(r["arm"], str(r["formation_date"])): r["period_end"].year for r in panel.pick_freshest(f, ["2016-01-31", "2016-03-31"]).collect()}
    assert got["first_reported", "2016-01-31"] == 2014 and got["naive_vendor", "2016-01-31"] == 2015
    assert got["first_reported", "2016-03-31"] == 2015 == got["naive_vendor", "2016-03-31"]
    assert panel.same_universe(panel.common_universe(panel.pick_freshest(f, ["2016-01-31"]), 3))


def years(cik, first, n, assets, restated=None):
    """n years with income, cash flow and assets; restated: year to a later value of its assets."""
    rows = []
    for y in range(first, first + n):
        for c, v in (("NetIncomeLoss", 10 * y), (CFO, 3 * y)):
            rows.append((cik, c, "USD", f"{y}-01-01", f"{y}-12-31", v, f"{cik}-{y}", f"{y + 1}-02-20", None))
        rows.append((cik, "Assets", "USD", None, f"{y}-12-31", assets, f"{cik}-{y}", f"{y + 1}-02-20", None))
        if restated and y in restated:
            rows.append((cik, "Assets", "USD", None, f"{y}-12-31", restated[y], f"{cik}-{y}r", f"{y + 3}-02-20", None))
    return rows


def test_a_year_short_in_one_arm_is_short_in_all(spark):
    rows = years(1, 2017, 4, 1000, {2020: -5000}) + years(2, 2017, 4, 1000) + years(3, 2018, 2, 1000, {2019: -5000}) + years(4, 2019, 1, 1000)
    f = features.accruals(facts(spark, rows))
    of = {(r["cik"], r["arm"], r["period_end"].year): r["drop_reason"] for r in f.collect()}
    assert of[1, "first_reported", 2020] is None and of[1, "restated_values", 2020] == "NON_POSITIVE_ASSETS"
    picked = panel.pick_freshest(f, ["2019-06-30", "2021-06-30"])
    got = {(r["cik"], r["arm"], r["formation_date"].year): r["period_end"] and r["period_end"].year for r in picked.collect()}
    assert {got[1, a, 2021] for a in features.ARMS} == {2019} and {got[2, a, 2021] for a in features.ARMS} == {2020}
    assert not {k for k in got if k[0] in (3, 4)}
    common = panel.common_universe(picked, 3)
    assert {(r["cik"], r["formation_date"].year) for r in common.collect()} == {(1, 2019), (2, 2019), (1, 2021), (2, 2021)} and panel.same_universe(common)
    late = panel.pick_freshest(f, ["2018-06-30", "2019-01-31"])
    reasons = {r["reason"]: r["n"] for r in panel.drop_reasons(f, late, 3).collect()}
    # In January 2019 the vendor knows the year 2018, the other arms do not.
    assert reasons == {"NON_POSITIVE_ASSETS": 2, "NO_PRIOR_YEAR": 1, "NO_ANNUAL_PERIOD": 1, "NOT_YET_FILED": 4}


def test_a_panel_is_one_scan_of_the_facts(spark):
    from vintara.plans import catalog

    for name in ("panel_common_universe", "panel_asof_pick", "panel_sizes"):
        plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        base = catalog.p.facts(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") == base.count("FileScan"), name
        assert plan.count("Exchange hashpartitioning") - base.count("Exchange hashpartitioning") <= 4, name


DRIFT = {"AAA": 0.30, "BBB": 0.25, "CCC": 0.15, "DDD": 0.05, "EEE": 0.0, "FFF": -0.05}
SIGNAL = {"AAA": -0.30, "BBB": -0.20, "CCC": -0.05, "DDD": 0.05, "EEE": 0.20, "FFF": 0.30}


@pytest.fixture(scope="module")
def market(spark):
    start = d("2015-01-01").toordinal()
    bars = []
    for s, g in DRIFT.items():
        for k in range(800):
            day = date.fromordinal(start + k)
            if day.weekday() < 5:
                price = 100 * (1 + g) ** (k / 365)
                bars.append((s, day, price, price * 1.005, price * 0.995, price, None, 1e6))
    prices = spark.createDataFrame(bars, "symbol string, bar_date date, open double, high double, low double, close double, adj_close double, volume double").cache()
    signals = spark.createDataFrame([(s, d(f), v, d(f)) for s, v in SIGNAL.items() for f in ("2016-01-04", "2017-01-04")], "symbol string, formation_date date, value double, knowledge_date date")
    return signals, prices


def test_quantile_sort(spark, market):
    plan = backtest.Plan(quantiles=2)
    held = backtest.positions(backtest.quotes(*market, plan), plan)
    got = {r["symbol"]: r for r in held.collect()}
    assert {s for s, r in got.items() if r["weight"] > 0} == {"AAA", "BBB", "CCC"} and sum(r["weight"] for r in got.values()) == pytest.approx(0)
    assert all(r["entry_date"] == date(2016, 1, 5) and r["exit_date"] == date(2017, 1, 5) for r in got.values())
    one = backtest.periods(held).first()
    assert one["gross_return"] > 0.2 and one["net_return"] < one["gross_return"] and one["turnover"] == pytest.approx(4)
    for r in got.values():
        sign = 1 if r["weight"] > 0 else -1
        assert r["net_return"] == pytest.approx(r["gross_return"] - sign * r["cost"])
    thin = backtest.positions(backtest.quotes(market[0].where("symbol < 'D'"), market[1], plan), plan)
    assert not thin.count()


def test_thin_formations_are_periods_too(spark, market):
    signals, prices = market
    plan = backtest.Plan(quantiles=2)
    thin = signals.where("symbol < 'D' or formation_date > '2016-06-01'").unionByName(spark.createDataFrame([("AAA", d("2016-07-04"), 0.1, d("2016-07-01")), ("ZZZ", d("2016-07-04"), 0.1, d("2016-07-01"))], signals.schema))
    every = backtest.positions(backtest.quotes(thin, prices, plan), plan, every=True)
    got = {str(r["formation_date"]): r for r in backtest.periods(every).collect()}
    assert set(got) == {"2016-01-04", "2016-07-04"}
    one = got["2016-07-04"]
    assert (one["n_positions"], one["n_ranked"], one["n_excluded"], one["exclusion_rate"]) == (0, 1, 1, 0.5)
    assert one["entry_date"] == date(2016, 7, 4) and one["exit_date"] == date(2017, 1, 4) and one["net_return"] == one["turnover"] == 0
    summary = backtest.arm_summary(backtest.periods(every), 2.0).first()
    assert summary["n_periods"] == 2 == summary["n_thin"] and summary["net_mean"] == 0 and summary["n_excluded"] == 1
    with pytest.raises(PySparkException, match="without periods"):
        backtest.arm_summary(backtest.periods(every.where("false")), 2.0).collect()


@pytest.mark.parametrize("value", [float("nan"), float("inf"), None])
def test_a_signal_that_is_no_number_is_refused(spark, market, value):
    signals, prices = market
    bad = signals.withColumn("value", F.when(F.col("symbol") == "AAA", F.lit(value).cast("double")).otherwise(F.col("value")))
    with pytest.raises(PySparkException, match="no finite number"):
        backtest.quotes(bad, prices).count()


def test_future_signal_is_refused(spark, market):
    signals, prices = market
    leaky = signals.withColumn("knowledge_date", F.date_add("formation_date", 1))
    with pytest.raises(PySparkException, match="knowable after"):
        backtest.quotes(leaky, prices).count()


def test_trade_without_length_is_refused(spark, market):
    """Bars only in January 2017: entry and exit would both be the first of them, as the next formation is a day away."""
    _, prices = market
    signals = spark.createDataFrame([(s, d(f), v, d("2016-01-01")) for s, v in SIGNAL.items() for f in ("2016-12-30", "2017-01-02")], "symbol string, formation_date date, value double, knowledge_date date")
    gap = prices.where("bar_date <= '2016-12-30' or bar_date = '2017-01-02' or bar_date > '2017-01-20'")
    assert backtest.quotes(signals, gap, backtest.Plan(quantiles=2)).where("exclusion is null").count() == 6
    same = backtest.quotes(signals, gap.where("bar_date <= '2017-01-02'"), backtest.Plan(quantiles=2))
    assert {r["exclusion"] for r in same.collect()} == {"NO_EXIT_BAR"}


def test_exclusions_in_order(spark, market):
    signals, prices = market
    short = prices.where("symbol != 'AAA' and (symbol != 'BBB' or bar_date >= '2015-12-20') and (symbol != 'CCC' or bar_date <= '2016-01-04') and (symbol != 'DDD' or bar_date <= '2016-06-01')")
    zero = short.withColumn("close", F.when((F.col("symbol") == "EEE") & (F.col("bar_date") == "2016-01-05"), 0.0).otherwise(F.col("close")))
    got = {r["symbol"]: r["exclusion"] for r in backtest.quotes(signals, zero, backtest.Plan(quantiles=2)).collect()}
    assert got == {"AAA": "NO_PRICE_HISTORY", "BBB": "INSUFFICIENT_HISTORY", "CCC": "NO_ENTRY_BAR", "DDD": "NO_EXIT_BAR", "EEE": "NON_POSITIVE_PRICE", "FFF": None}


@pytest.mark.parametrize("spread", [0.0, 0.005, 0.02])
def test_spread_recovers_what_was_imposed(spark, spread):
    import numpy as np

    rng = np.random.default_rng(20260727)
    path = np.cumsum(rng.normal(0, 0.02 / 8, (2000, 64)).ravel()).reshape(2000, 64)
    price = np.exp(path)  # the day's high trades at the ask, its low at the bid
    days = [(date.fromordinal(730000 + k), float(price[k].max() * (1 + spread / 2)), float(price[k].min() * (1 - spread / 2)), float(price[k][-1])) for k in range(2000)]
    df = spark.createDataFrame([("S", a, b, c, e, None, 1e6) for a, b, c, e in days], "symbol string, bar_date date, high double, low double, close double, adj_close double, volume double")
    r = backtest.corwin_schultz(df).first()
    if spread:
        assert spread * 0.5 < r["spread"] < spread * 1.5
    else:
        assert r["spread"] < 0.002 and r["n_pairs_negative"] > 2000 / 3
    assert r["n_pairs_used"] == 1999


def test_asof_joins(spark):
    left = spark.createDataFrame([("a", 5), ("a", 1), ("b", 3), ("a", 9)], "k string, t int")
    right = spark.createDataFrame([("a", 2, "x"), ("a", 5, None), ("a", 7, "z"), ("c", 1, "q")], "k string, s int, v string")
    back = {(r["k"], r["t"]): (r["s"], r["v"]) for r in asof_backward(left, right, ["k"], "t", "s", ["v"]).collect()}
    assert back == {("a", 5): (5, None), ("a", 1): (None, None), ("b", 3): (None, None), ("a", 9): (7, "z")}
    forth = {(r["k"], r["t"]): (r["s"], r["v"]) for r in asof_forward(left, right, ["k"], "t", "s", ["v"]).collect()}
    assert forth == {("a", 5): (5, None), ("a", 1): (2, "x"), ("b", 3): (None, None), ("a", 9): (None, None)}


# Values and hashes


@pytest.mark.parametrize(("text", "ok"), [("2563579586000000000", True), ("9" * 28, True), ("1" + "0" * 28, False), ("1.00000000001", False), ("-0.5", True), ("1.50000000000", True), ("1.2345678901234567e+19", True), ("1.5e0", True), ("9e27", True), ("9e28", False), ("1.00000000001E0", False), ("0E-10", True), ("-2.5e-3", True), ("1.50E-9", True), ("1.5E-10", False), ("abc", False), ("NaN", False), ("", False)])
def test_exact_decimals(spark, text, ok):
    df = spark.createDataFrame([(text, "x")], "t string, w string")
    got = df.select(scalars.parse_decimal(F.col("t"))).first()[0]
    assert (got == Decimal(text)) if ok else got is None
    exact = df.select(scalars.exact_decimal(F.col("t"), F.col("w")))
    if ok:
        exact.collect()
    else:
        with pytest.raises(PySparkException):
            exact.collect()


def test_scalars(spark):
    one = lambda e: spark.range(1).select(e).first()[0]
    lit = F.lit
    assert one(scalars.parse_date(lit("2020-02-30"))) is None and one(scalars.parse_date(lit(""))) is None and one(scalars.parse_date(lit("2020-02-29"))) == d("2020-02-29")
    assert one(scalars.parse_compact_date(lit("20240131"))) == d("2024-01-31") and one(scalars.parse_compact_date(lit("2024013"))) is None
    assert one(scalars.parse_items(lit(" 2.02, ,9.01"))) == ["2.02", "9.01"] and one(scalars.parse_items(lit(None).cast("string"))) == []
    assert one(scalars.dashed_accession(lit("000119312509214859"))) == "0001193125-09-214859" and one(scalars.dashed_accession(lit("12"))) is None
    assert one(scalars.padded_cik(lit(320193))) == "0000320193" and one(scalars.path_stem(lit("edgar/data/1/0001-09-2.txt"))) == "0001-09-2"
    assert one(scalars.plain_number(lit(Decimal("5.3600000000")))) == "5.36" and one(scalars.plain_number(lit(Decimal("100.0000000000")))) == "100"
    assert one(scalars.abbreviated(lit(Decimal("53394000000")))) == "53.394B" and one(scalars.abbreviated(lit(Decimal("-1500000")))) == "-1.500M"
    assert one(scalars.redact_uri(lit("http://x/?a=1&ApiKey=secret&b=2"))) == "http://x/?a=1&ApiKey=***&b=2"
    assert one(scalars.percent(lit(0.00001))) == "<0.01%" and one(scalars.percent(lit(0.05016662))) == "5.02%"
    assert one(scalars.is_throttle_page(lit(403), lit("Request Rate Threshold exceeded"))) and not one(scalars.is_throttle_page(lit(200), lit("request rate threshold")))
    assert one(F.size(scalars.month_ends(lit("2020-01-15").cast("date"), lit("2020-04-02").cast("date")))) == 4
    assert one(scalars.period_label(lit(None).cast("date"), lit("2020-01-31").cast("date"))) == "instant, 2020-01-31"
    assert [one(scalars.is_financial(lit(s))) for s in ("6021", "5999", "", "6x")] == [True, False, False, False]
    assert [one(scalars.is_utility(lit(s))) for s in ("4911", "4950", "49")] == [True, False, False]


def test_links_changes_and_the_code_stamp(spark):
    import vintara

    one = lambda c: spark.range(1).select(c).first()[0]
    lit = F.lit
    assert one(scalars.document_url(lit(320193), lit("0000320193-24-000001"))) == "https://www.sec.gov/Archives/edgar/data/320193/000032019324000001/0000320193-24-000001-index.htm"
    assert [one(scalars.percent_change(lit(x))) for x in (0.1234, -0.5, 0.0)] == ["+12.34%", "-50.00%", "0.00%"]
    assert one(scalars.percent_change(lit(None).cast("double"))) is None
    for bad in (float("nan"), float("inf")):
        with pytest.raises(PySparkException, match="no finite number"):
            one(scalars.percent_change(lit(bad)))
    assert len(vintara.code_version()) == 12 and set(vintara.code_version()) <= set("0123456789abcdef")


def test_canonical_hash():
    value = {"b": Decimal("1.50"), "a": [d("2020-01-01"), datetime(2020, 1, 1, tzinfo=timezone.utc)], "c": {3, 1}}
    assert hashing.canonical_json(value) == '{"a":["d:2020-01-01","T:2020-01-01T00:00:00+00:00"],"b":"D:1.5","c":["1","3"]}'
    # Members of a set stand as their own texts, in order of these.
    assert hashing.canonical_json({"x", "y", 2}) == '["\\"x\\"","\\"y\\"","2"]' and hashing.canonical_json(Decimal("-0")) == '"D:-0"'
    for bad in (1.5, datetime(2020, 1, 1), {1: 2}, Decimal("NaN")):
        with pytest.raises((TypeError, ValueError)):
            hashing.canonical_hash(bad)


def test_fact_key_is_the_hash_of_the_identity(spark):
    import hashlib
    import json

    r = facts(spark, RESTATED[:1] + BACK[:1]).withColumn("k", hashing.fact_key()).collect()
    for x in r:
        identity = [x["cik"], x["taxonomy"], x["concept"], x["unit"], str(x["period_start"]) if x["period_start"] else None, str(x["period_end"]), x["accn"]]
        assert x["k"] == hashlib.sha256(json.dumps(identity, separators=(",", ":")).encode()).hexdigest()


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=st.lists(st.integers(-3, 3), min_size=1, max_size=8))
def test_chain_invariants(spark, values):
    rows = [(1, "X", "USD", None, "2020-01-01", v, f"a{k}", f"2020-{k + 2:02d}-01", None) for k, v in enumerate(values)]
    df = facts(spark, rows)
    t = corpus.tally(df).first()
    assert t["restated_facts"] == int(len(set(values)) > 1) == t["revised_up"] + t["revised_down"] + t["returned"]
    assert t["restated_facts"] <= t["restatable"] <= t["facts"] and t["rows_total"] == len(values)
    for k, v in enumerate(values):  # what is visible at a date does not depend on what comes later
        assert AsOf({"facts": df}, date(2020, k + 2, 1)).value(1, "X") == v


# Boundaries


def test_features_never_import_the_corpus():
    root = Path(__file__).resolve().parents[1] / "vintara"
    guarded = ["operators/features.py", "operators/panel.py", "operators/backtest.py"]
    for name in guarded:
        tree = ast.parse((root / name).read_text())
        names = {a.name for n in ast.walk(tree) if isinstance(n, ast.Import) for a in n.names} | {f"{n.module}.{a.name}" for n in ast.walk(tree) if isinstance(n, ast.ImportFrom) for a in n.names}
        assert not [x for x in names if "corpus" in x or "store" in x], name
    for path in root.rglob("*.py"):
        if "llm" not in path.parts:
            assert "vintara.llm" not in path.read_text(), path


def test_schema_checksums():
    assert len({schemas.checksum(t) for t in schemas.DDL}) == len(schemas.DDL) and set(schemas.KEYS) == set(schemas.DDL)


def test_freshness():
    assert service.freshness(None, d("2020-01-01")) == "broken" == service.freshness(d("2020-01-02"), d("2020-01-01"))
    assert service.freshness(d("2020-01-01"), d("2020-01-06")) == "stale" and service.freshness(d("2020-01-01"), d("2020-01-05"), 1) == "partial"
    assert service.freshness(d("2020-01-01"), d("2020-01-05")) == "fresh"


def test_first_break_of_a_chain(spark):
    from hashlib import sha256

    from vintara.functions import hashing

    rows = []
    for log, n in (("a", 6), ("b", 6), ("c", 1), ("d", 6), ("e", 6)):
        head = hashing.GENESIS
        for k in range(n):
            head = sha256(f"{head}body {log} {k}".encode()).hexdigest()
            rows.append([log, k, f"body {log} {k}", head])
    by = {(r[0], r[1]): r for r in rows}
    by["b", 3][2] = "changed"
    rows.remove(by["d", 2])
    by["e", 1][1], by["e", 4][1] = 4, 1
    got = {r["log"]: (r["entries"], r["first_break"]) for r in hashing.chain_breaks(spark.createDataFrame(rows, "log string, seq int, body string, head string"), "log", "seq").collect()}
    assert got == {"a": (6, -1), "b": (6, 3), "c": (1, -1), "d": (5, 2), "e": (6, 1)}


def test_tallies_scan_the_facts_once(spark):
    from vintara.plans import catalog

    sf = "/root/testdata/sf0.001"
    plans = {n: catalog.QUERIES[n](spark, sf)._jdf.queryExecution().executedPlan().toString() for n in ("survival_split", "survival_bands", "corpus_stats_right_wrong_key", "contamination_tally")}
    base = catalog.p.facts(spark, sf)._jdf.queryExecution().executedPlan().toString().count("FileScan")
    for name, plan in plans.items():
        assert plan.count("FileScan") <= base and "collect_set" not in plan, name
