"""Archive windows as one, questions that several periods answer, universes compared as sets, files of the wrong shape."""

import random
from datetime import date, timedelta

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tests.test_sources import put
from vintara.operators import panel, statistics
from vintara.operators.asof import INSTANT, AsOf
from vintara.operators.store import Warehouse, merge_unrevised_runs
from vintara.plans.ingest import Ingestor
from vintara.sources import landing

OBSERVED = "source_uri string, series_id string, obs_date date, realtime_start date, realtime_end date, value double"


def day(k):
    return date(2000, 1, 1) + timedelta(days=int(k))


def parsed(spark, rows):
    df = spark.createDataFrame(rows, OBSERVED)
    return landing.Parsed(df, spark.createDataFrame([], "source_uri string, reason string"))


@pytest.mark.parametrize("n_windows", [1, 2, 7])
def test_many_windows_give_the_rows_of_one(spark, n_windows):
    rng = random.Random(n_windows)
    vintages = sorted(rng.sample(range(1, 600), 40))
    whole = []
    for obs in range(12):
        starts = sorted(rng.sample(vintages, rng.randrange(1, 9)))
        for a, b in zip(starts, [*starts[1:], None]):
            whole.append((f"w{obs}", "S", day(1000 + obs), a, vintages[-1] if b is None else b - 1, float(rng.randrange(2))))
    size = -(-len(vintages) // n_windows)
    parts = []
    for k in range(0, len(vintages), size):
        low, high = vintages[k], vintages[min(k + size, len(vintages)) - 1]
        parts += [(f"file{k}", s, o, day(max(a, low)), day(min(b, high)), v) for _, s, o, a, b, v in whole if a <= high and b >= low]
    rng.shuffle(parts)
    found = landing.union_windows(parsed(spark, parts), spark.createDataFrame([(day(v),) for v in vintages], "vintage_date date"))
    want = merge_unrevised_runs(spark.createDataFrame([(s, o, day(a), day(b), v) for _, s, o, a, b, v in whole], OBSERVED.replace("source_uri string, ", "")))
    columns = ["series_id", "obs_date", "realtime_start", "realtime_end", "value"]
    # What came in windows ends where the last window with it ends; a change of value begins a row in both.
    assert sorted(map(tuple, found.rows.select(*columns[:3], "value").collect())) == sorted(map(tuple, want.select(*columns[:3], "value").collect()))
    if n_windows == 1:
        assert sorted(map(tuple, found.rows.select(*columns).collect())) == sorted(map(tuple, want.select(*columns).collect()))
    assert found.rejects.count() == 0


def test_gaps_and_overlaps_are_rejects(spark):
    rows = [
        ("a", "S", day(0), day(10), day(20), 1.0), ("b", "S", day(0), day(31), day(40), 1.0),  # vintage 25 is in neither
        ("a", "S", day(1), day(10), day(20), 1.0), ("b", "S", day(1), day(15), day(40), 2.0),  # both claim day 15
        ("a", "S", day(2), day(10), day(20), 3.0), ("b", "S", day(2), day(15), day(40), 3.0),  # repeated
        ("a", "S", day(3), day(10), day(20), None), ("b", "S", day(3), day(24), day(40), None),  # nothing in between
    ]
    vintages = spark.createDataFrame([(day(v),) for v in (10, 24, 25, 31)], "vintage_date date")
    found = landing.union_windows(parsed(spark, rows), vintages)
    assert sorted(map(tuple, found.rejects.collect())) == [("b", "gap between windows"), ("b", "windows overlap")]
    got = {(r["obs_date"], r["realtime_start"], r["realtime_end"], r["value"]) for r in found.rows.collect()}
    assert got == {(day(0), day(10), day(20), 1.0), (day(0), day(31), day(40), 1.0), (day(1), day(10), day(20), 1.0), (day(2), day(10), day(40), 3.0), (day(3), day(10), day(40), None)}
    # Without the archive's list only overlaps can be told.
    assert {r["reason"] for r in landing.union_windows(parsed(spark, rows)).rejects.collect()} == {"windows overlap"}
    empty = landing.union_windows(parsed(spark, []), vintages)
    assert not empty.rows.count() and not empty.rejects.count()


def test_windows_of_files_reach_the_warehouse(spark, tmp_path):
    w = Warehouse(spark, f"file://{tmp_path}/w")
    o = lambda a, b, v: {"date": "2020-04-01", "realtime_start": a, "realtime_end": b, "value": v}
    put(tmp_path / "m", "1.json", {"count": 2, "observations": [o("2020-07-30", "2020-08-26", "1.5"), o("2020-08-27", "2020-09-29", "2")]})
    put(tmp_path / "m", "2.json", {"count": 1, "observations": [o("2020-09-30", "9999-12-31", "2")]})
    put(tmp_path / "m", "3.json", "[]")
    put(tmp_path / "m", "4.json", {"count": 9, "observations": [o("2020-07-30", "2020-08-26", "1.5")]})
    done = Ingestor(spark, w).macro(str(tmp_path / "m"), "GDP")
    assert done.written["macro_observations"] == 2 and done.skipped == {"unexpected shape": 1, "cut off at the source": 1}
    rows = [(r["realtime_start"], r["realtime_end"], r["value"]) for r in w.read("macro_observations").orderBy("realtime_start").collect()]
    assert rows == [(date(2020, 7, 30), date(2020, 8, 26), 1.5), (date(2020, 8, 27), date(9999, 12, 31), 2.0)]


def test_files_of_the_wrong_shape_are_rejects_of_their_batch(spark, tmp_path):
    w = Warehouse(spark, f"file://{tmp_path}/w")
    job = Ingestor(spark, w)
    put(tmp_path / "d", "1.json", [{"symbol": "X"}, {"symbol": " "}])
    put(tmp_path / "d", "2.json", {"Error": "limit"})
    done = job.delistings(str(tmp_path / "d"), "2024-01-01", "v")
    assert done.written["delistings"] == 1 and done.skipped == {"no symbol": 1, "no list of symbols": 1}
    bar = {"date": "2024-01-02", "open": 1, "high": 1, "low": 1, "close": 1, "volume": 1}
    put(tmp_path / "r", "1.json", [bar])
    put(tmp_path / "r", "2.json", {"Error": "limit"})
    done = job.prices(str(tmp_path / "r"), put(tmp_path / "a", "1.json", []), "AAPL", "v")
    assert done.written["prices"] == 1 and done.skipped == {"no list of bars": 1}


FACTS = "cik long, taxonomy string, concept string, unit string, period_start date, period_end date, value decimal(38,10), accn string, form string, filed_at date, knowledge_date date"


def facts(spark, spans):
    from decimal import Decimal

    rows = [(1, "us-gaap", "Income", u, a, date(2015, 9, 26), Decimal(v), f"a{k}", "10-K", date(2015, 11, 1 + k), date(2015, 11, 1 + k)) for k, (a, v, u) in enumerate(spans)]
    return {"facts": spark.createDataFrame(rows, FACTS)}


YEAR, QUARTER = (date(2014, 9, 28), 53394, "USD"), (date(2015, 6, 28), 11124, "USD")


@pytest.mark.parametrize("spans", [(YEAR, QUARTER), (YEAR, (None, 5, "USD")), (YEAR, (date(2015, 6, 28), 9, "EUR"))])
def test_one_end_and_several_periods_raise(spark, spans):
    view = AsOf(facts(spark, spans), date(2016, 1, 1))
    for read in (view.first_reported, view.unsafe_latest_restated):
        with pytest.raises(PySparkException, match="several periods end together"):
            read(1, "Income", period_end=date(2015, 9, 26)).select("accn").collect()
        assert len(read(1, "Income", period_end=date(2015, 9, 26), period_start=YEAR[0]).collect()) == 1
        assert len(read(1, "Income").collect()) == 2  # a list of facts, each with its own period
    assert len(view.first_reported(1, "Income", period_end=date(2015, 9, 26), period_start=INSTANT).collect()) == (spans[1][0] is None)


def test_restatements_of_one_period_do_not_raise_and_later_ones_are_not_seen(spark):
    view = AsOf(facts(spark, (YEAR, (YEAR[0], 50000, "USD"))), date(2015, 11, 1))
    assert view.first_reported(1, "Income", period_end=date(2015, 9, 26)).first()["value"] == 53394
    assert view.unsafe_latest_restated(1, "Income", period_end=date(2015, 9, 26)).first()["value"] == 50000
    # A quarter that becomes known later does not make the answer of the day ambiguous.
    assert AsOf(facts(spark, (YEAR, QUARTER)), date(2015, 11, 1)).first_reported(1, "Income", period_end=date(2015, 9, 26)).count() == 1


def test_the_guard_costs_no_further_exchange_and_filters_reach_the_scan(spark, tmp_path):
    facts(spark, (YEAR, QUARTER))["facts"].write.parquet(str(tmp_path / "f"))
    view = AsOf({"facts": spark.read.parquet(str(tmp_path / "f"))}, date(2016, 1, 1))
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    for read in (view.first_reported, view.unsafe_latest_restated):
        plan = read(1, "Income", period_end=date(2015, 9, 26))._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "EqualTo(cik,1)" in plan and "EqualTo(concept,Income)" in plan and "EqualTo(period_end,2015-09-26)" in plan


def test_universes_are_compared_as_sets(spark):
    make = lambda rows: spark.createDataFrame(rows, "arm string, cik long, formation_date date")
    same = [(a, c, day(c % 2)) for a in "xyz" for c in range(50)]
    assert panel.same_universe(make(same)) and panel.same_universe(make(same + same[:3])) and panel.same_universe(make(same).limit(0))
    # Equal counts of names and of arms by name, other names.
    assert not panel.same_universe(make([("x", 1, day(0)), ("y", 2, day(0))]))
    assert not panel.same_universe(make(same[:-1])) and not panel.same_universe(make([*same[:-1], ("z", 49, day(0))]))
    assert panel.universe_digests(make(same)).select("digest", "total").distinct().count() == 1


def test_roles_meet_each_observation_in_its_row(spark):
    rows = spark.range(12).selectExpr("id as k", "id * 10 as v")
    got = statistics.split_roles(rows, "k", 12, 4, 2, horizon=1)
    assert got.columns == ["k", "v", "split", "role"] and got.count() == 72
    assert got.where(F.col("v") != F.col("k") * 10).count() == 0 and "Join" not in got._jdf.queryExecution().executedPlan().toString()
