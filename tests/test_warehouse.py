"""The warehouse as a log: pruned writes, deltas that are as large as the day, compaction, migrations."""

from datetime import date
from decimal import Decimal

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tests.test_sources import PROVENANCE, with_provenance
from vintara import schemas
from vintara.operators import store
from vintara.operators.store import Warehouse
from vintara.plans import ingest



def tickers(spark, ids):
    rows = spark.createDataFrame([(i,) for i in ids], "cik long")
    return with_provenance(rows.selectExpr("cik", "'T' as ticker", "'N' as exchange", "date'2020-01-01' as observed_at"))


def filings(spark, rows):
    """rows: (accn, filed day, disseminated day or None)"""
    made = [(a, int(a[:2]), "10-K", date(2020, 1, f), date(2020, 1, s) if s else None, [a]) for a, f, s in rows]
    return with_provenance(spark.createDataFrame(made, "accn string, cik long, form string, filed_at date, disseminated_at date, items array<string>"))


def folders(tmp_path, table):
    return {p.parent.relative_to(tmp_path / "w" / table).as_posix() for p in (tmp_path / "w" / table).rglob("*.parquet")}


def test_an_insert_reads_and_writes_only_the_buckets_of_its_keys(spark, tmp_path, monkeypatch):
    w = Warehouse(spark, f"file://{tmp_path}/w", buckets=32)
    assert w.insert("entity_identifiers", tickers(spark, range(3000))) == 3000
    before = folders(tmp_path, "entity_identifiers")
    assert len(before) == 32
    read = []
    merged = Warehouse._merged

    def spied(self, *args):
        read.append(merged(self, *args))
        return read[-1]

    monkeypatch.setattr(Warehouse, "_merged", spied)
    batch = tickers(spark, [5, 6, 5001])
    assert w.insert("entity_identifiers", batch) == 1
    touched = w._touched("entity_identifiers", batch)
    scanned = read[0]._jdf.queryExecution().executedPlan().toString()
    assert len(touched) <= 3 and "PartitionFilters: [bucket" in scanned
    added = folders(tmp_path, "entity_identifiers") - before
    assert len(added) == 1 and int(next(iter(added)).split("bucket=")[1]) in touched
    # Known keys of any number add neither a segment nor files.
    commits = len(w._commits("entity_identifiers"))
    assert w.insert("entity_identifiers", tickers(spark, range(100))) == 0 and len(w._commits("entity_identifiers")) == commits
    assert folders(tmp_path, "entity_identifiers") == before | added
    assert w.count("entity_identifiers") == 3001


def test_a_day_is_a_delta_and_reads_as_if_the_table_were_rewritten(spark, tmp_path):
    w = Warehouse(spark, f"file://{tmp_path}/w", buckets=8)
    old = filings(spark, [(f"{k:02d}-a", 1 + k % 9, 5 if k % 3 else None) for k in range(60)])
    w.insert("filings", old)
    seen = filings(spark, [("07-a", 9, 3), ("10-a", 9, 9), ("61-b", 2, 4), ("61-b", 2, 3), ("12-a", 9, 7)]).select("accn", "cik", "form", "filed_at", "disseminated_at")
    extra = lambda df: df.withColumns({c: F.coalesce(c, F.lit(v).cast("timestamp") if c == "retrieved_at" else F.lit(v)) for c, v in PROVENANCE.items()})
    assert w.merge("filings", seen, lambda a, b: extra(store.record_dissemination(a, b))) == 1
    want = extra(store.record_dissemination(schemas.conform(old, "filings"), seen))
    got = w.read("filings")
    assert got.exceptAll(want.select(got.columns)).count() == 0 and got.count() == want.count() == 61
    delta = w._segments("filings")[1]
    written = spark.read.parquet(f"{w.root}/filings/segment={delta.segment}")
    # 10-a was known earlier already: what does not change is not written.
    assert {r["accn"] for r in written.collect()} == {"07-a", "12-a", "61-b"}
    assert w.merge("filings", seen, lambda a, b: extra(store.record_dissemination(a, b))) == 0 and len(w._segments("filings")) == 2

    before = sorted(map(str, got.collect()))
    w.compact("filings", buckets=4)
    (base,) = w._segments("filings")
    assert (base.kind, base.buckets) == ("base", 4) and sorted(map(str, w.read("filings").collect())) == before
    assert sorted(map(str, got.collect())) == before  # the segments before are there for those who read them
    w.compact("filings")
    assert len(w._commits("filings")) == 2
    assert w.merge("filings", seen.limit(0), lambda a, b: extra(store.record_dissemination(a, b))) == 0
    with pytest.raises(ValueError):
        w.merge("facts", seen, lambda a, b: a)


def test_a_segment_without_its_commit_does_not_count(spark, tmp_path):
    w = Warehouse(spark, f"file://{tmp_path}/w")
    w.insert("entity_identifiers", tickers(spark, [1]))
    last = w._segments("entity_identifiers")[-1]
    w.insert("entity_identifiers", tickers(spark, [2]))
    crashed = w._segments("entity_identifiers")[-1]
    w._delete(f"_commits/entity_identifiers/{crashed.name}")
    assert w.count("entity_identifiers") == 1 and w._segments("entity_identifiers") == [last]
    assert w.insert("entity_identifiers", tickers(spark, [2])) == 1 and w.count("entity_identifiers") == 2


def older(spark, root, steps):
    """A warehouse with the schemas of the first steps: filings without a day of dissemination, no links."""
    w = Warehouse(spark, root, migrations=schemas.MIGRATIONS[:steps])
    rows = filings(spark, [("01-a", 1, None), ("02-b", 2, None)]).withColumn("accn", F.concat(F.lpad(F.col("cik").cast("string"), 10, "0"), F.lit("-20-000001")))
    if steps == 1:
        w._write("filings", "base", schemas.conform(rows, "filings").drop("disseminated_at"), checksum="0" * 16)
    else:
        w.insert("filings", rows)
    return w


@pytest.mark.parametrize("steps", [1, 2])
def test_older_tables_are_read_after_migration(spark, tmp_path, steps):
    root = f"file://{tmp_path}/w"
    old = older(spark, root, steps)
    if steps == 1:
        with pytest.raises(ValueError, match="another schema"):
            old.read("filings")
    with pytest.raises(ValueError, match="lacks the steps"):
        Warehouse(spark, root, read_only=True)
    w = Warehouse(spark, root)
    assert w.read("filings").select("cik", "disseminated_at").orderBy("cik").collect() == [(1, None), (2, None)]
    assert [tuple(r) for r in w.read("filing_filers").select("cik", "is_primary").orderBy("cik").collect()] == [(1, True), (2, True)]
    assert w.migrate() == [] and Warehouse(spark, root, read_only=True).count("filings") == 2
    edited = (*schemas.MIGRATIONS[:-1], schemas.Migration(3, "filers", {"filing_filers": "SELECT 1"}))
    with pytest.raises(ValueError, match="edited"):
        Warehouse(spark, root, migrations=edited)


def test_values_that_would_change_are_refused(spark):
    columns = "cik long, taxonomy string, concept string, unit string, period_start date, period_end date, value {}, accn string, filed_at date, retrieved_at timestamp"
    make = lambda v, kind: spark.createDataFrame([(1, "t", "X", "USD", None, date(2020, 1, 1), v, "a", date(2020, 2, 1), None)], columns.format(kind))
    for good, kind in (("1.5000000000000", "string"), (Decimal("2.500000000000"), "decimal(30,12)"), (3.25, "double"), (7, "long"), ("1e5", "string")):
        assert store.prepare_facts(make(good, kind)).first()["value"] == Decimal(str(good))
    for bad, kind in (("1.00000000001", "string"), (Decimal("0.000000000001"), "decimal(30,12)"), ("NaN", "string"), (float("inf"), "double"), ("1e30", "string")):
        with pytest.raises(PySparkException, match="out of range or scale"):
            store.prepare_facts(make(bad, kind)).collect()


def test_a_sample_leaves_no_rows_of_other_companies(spark, tmp_path):
    from tests.test_sources import ENTRIES, put, submissions

    w = Warehouse(spark, f"file://{tmp_path}/w")
    land = tmp_path / "land"
    for cik in (320193, 9):
        own = submissions() | {"accessionNumber": [a.replace("0000320193", f"{cik:010d}") for a in submissions()["accessionNumber"]]}
        subs = put(land / "subs", f"CIK{cik:010d}.json", {"cik": str(cik), "name": "Co", "filings": {"recent": own}})
        facts = put(land / "facts", f"CIK{cik:010d}.json", {"cik": cik, "facts": {"us-gaap": {"Eps": {"units": {"USD/shares": ENTRIES}}}}})
    spark.createDataFrame([(320193, 5.0), (9, 0.5)], "cik long, val double").write.parquet(str(land / "frames"))
    job = ingest.Ingestor(spark, w)
    job.universe(5, 1.0, 7, str(land / "frames"), subs, facts)
    for table in ("filings", "filing_filers", "entities", "facts"):
        assert {r["cik"] for r in w.read(table).select("cik").collect()} == {320193}, table
