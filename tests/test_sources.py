"""Landing files, the warehouse, ledgers and the stream."""

import json
from decimal import Decimal

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from datetime import date

from vintara.operators import store
from vintara.plans import ledgers, service, studies
from vintara.sources import landing
from vintara.streaming import feed

PROVENANCE = {"source_uri": "u", "retrieved_at": "2026-07-27 12:00:00", "content_sha256": "h", "ingest_run_id": "run-test-0001"}


def with_provenance(df):
    return df.withColumns({k: F.lit(v).cast("timestamp") if k == "retrieved_at" else F.lit(v) for k, v in PROVENANCE.items()})


def put(folder, name, body):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(body if isinstance(body, str) else json.dumps(body))
    return str(folder)


def test_tickers(spark, tmp_path):
    docs = landing.documents(spark, put(tmp_path, "t.json", {"0": {"cik_str": 320193, "ticker": " aapl ", "title": "Apple"}, "1": {"cik_str": 5, "ticker": "", "title": "x"}}))
    p = landing.company_tickers(docs, "2026-01-01")
    assert [(r["cik"], r["ticker"]) for r in p.rows.collect()] == [(320193, "AAPL")]
    assert [tuple(r) for r in p.skip_counts().collect()] == [("no ticker", 1)]
    with pytest.raises(PySparkException):
        landing.company_tickers(landing.documents(spark, put(tmp_path / "b", "t.json", "[]")), "2026-01-01").rows.collect()


def submissions(n=3, ragged=False):
    arrays = {"accessionNumber": ["0000320193-24-000001", "000032019324000002", "bad"], "filingDate": ["2024-01-02", "", "2024-01-03"], "reportDate": ["2023-12-31", "", ""], "acceptanceDateTime": ["2024-01-02T10:00:00.000Z", "", ""], "form": ["10-K", "8-K", "8-K"], "items": ["", "2.02, 9.01", ""], "isXBRL": [1, 0, 0], "primaryDocument": ["a.htm", "", ""]}
    if ragged:
        arrays["form"] = arrays["form"][:2]
    return arrays


def test_submissions(spark, tmp_path):
    docs = landing.documents(spark, put(tmp_path / "a", "CIK0000320193.json", {"cik": "320193", "filings": {"recent": submissions()}}))
    p = landing.submissions(docs)
    (row,) = p.rows.collect()
    assert (row["accn"], row["form"], row["filed_at"], row["items"], row["is_xbrl"]) == ("0000320193-24-000001", "10-K", date(2024, 1, 2), [], True)
    assert {r["reason"]: r["n"] for r in p.skip_counts().collect()} == {"no filing date": 1, "bad accession": 1}
    older = landing.documents(spark, put(tmp_path / "h", "CIK0000320193-submissions-001.json", submissions()))
    assert landing.submissions(docs, older).rows.select("cik").distinct().count() == 1 and landing.submissions(docs, older).rows.count() == 2
    with pytest.raises(PySparkException, match="unequal"):
        landing.submissions(landing.documents(spark, put(tmp_path / "r", "x.json", {"cik": "1", "filings": {"recent": submissions(ragged=True)}}))).rows.collect()


ENTRIES = [
    {"start": "2007-09-30", "end": "2008-09-27", "val": 5.36, "accn": "0001193125-09-214859", "fy": 2009, "fp": "FY", "form": "10-K", "filed": "2009-10-27"},
    {"end": "2008-09-27", "val": 12345678901234567890.5, "accn": "0001193125-09-214859", "fy": 2009, "fp": "FY", "form": "10-K", "filed": "2009-10-27"},
    {"end": "2008-09-27", "val": 1, "accn": "nope", "fy": 2009, "fp": "FY", "form": "10-K", "filed": "2009-10-27"},
]


def test_company_facts_and_concept(spark, tmp_path):
    body = json.dumps({"cik": 320193, "facts": {"us-gaap": {"Eps": {"units": {"USD/shares": ENTRIES}}}, "srt": {"X": {"units": {"USD": ENTRIES[:1]}}}}}).replace("1.2345678901234567e+19", "12345678901234567890.5")
    p = landing.company_facts(landing.documents(spark, put(tmp_path / "f", "f.json", body)))
    got = {r["period_start"]: r["value"] for r in p.rows.collect()}
    assert got == {date(2007, 9, 30): Decimal("5.36"), None: Decimal("12345678901234567890.5")}
    assert sorted(tuple(r) for r in p.skip_counts().collect()) == [("bad accession", 1), ("taxonomy out of scope: srt", 1)]
    bare = {"cik": 1, "facts": {"us-gaap": {"Eps": {"label": "x"}, "Cash": {"units": {"USD": ENTRIES[:1]}}}}}
    q = landing.company_facts(landing.documents(spark, put(tmp_path / "g", "g.json", bare)))
    assert q.rows.count() == 1 and [tuple(r) for r in q.skip_counts().collect()] == [("concept without units", 1)]
    c = landing.company_concept(landing.documents(spark, put(tmp_path / "c", "c.json", {"cik": 1, "taxonomy": "us-gaap", "tag": "Eps", "units": {"USD/shares": ENTRIES[:1]}})))
    assert c.rows.first()["concept"] == "Eps"


def test_a_bad_file_is_one_reject_of_its_batch(spark, tmp_path):
    put(tmp_path / "s", "CIK0000000001.json", "not json")
    put(tmp_path / "s", "CIK0000000002.json", {"cik": "2", "filings": {"recent": submissions(ragged=True)}})
    folder = put(tmp_path / "s", "CIK0000000003.json", {"cik": "3", "filings": {"recent": submissions()}})
    p = landing.submissions(landing.documents(spark, folder), strict=False)
    assert [r["cik"] for r in p.rows.collect()] == [3]
    assert {r["reason"]: r["n"] for r in p.skip_counts().collect()} == {"unexpected shape": 1, "arrays of unequal length": 1, "no filing date": 1, "bad accession": 1}
    put(tmp_path / "f", "a.json", "[]")
    facts = landing.documents(spark, put(tmp_path / "f", "b.json", {"cik": 1, "facts": {"us-gaap": {"Eps": {"units": {"USD/shares": ENTRIES[:1]}}}}}))
    q = landing.company_facts(facts, strict=False)
    assert q.rows.count() == 1 and [tuple(r) for r in q.skip_counts().collect()] == [("unexpected shape", 1)]
    t = landing.company_tickers(landing.documents(spark, put(tmp_path / "t", "t.json", "[]")), "2026-01-01", strict=False)
    assert not t.rows.count() and t.skip_counts().first()["n"] == 1


def test_submissions_without_some_arrays(spark, tmp_path):
    arrays = {k: v for k, v in submissions().items() if k not in ("isXBRL", "items", "reportDate")}
    p = landing.submissions(landing.documents(spark, put(tmp_path, "CIK0000320193.json", {"cik": "320193", "filings": {"recent": arrays}})))
    (row,) = p.rows.collect()
    assert row["form"] == "10-K" and not row["items"] and row["period_of_report"] is None and not row["is_xbrl"]


def test_entities_of_submissions(spark, tmp_path):
    put(tmp_path, "a.json", {"cik": "7", "name": " Seven ", "entityType": "operating", "sic": "3571", "stateOfIncorporation": "", "filings": {}})
    docs = landing.documents(spark, put(tmp_path, "b.json", {"cik": "8", "name": ""}))
    p = landing.entities(docs, "2024-01-02")
    (r,) = p.rows.collect()
    assert (r["cik"], r["name"], r["sic"], r["state_of_incorp"], r["first_observed"]) == (7, "Seven", "3571", None, date(2024, 1, 2))
    assert p.skip_counts().first()["reason"] == "no name"


def test_vintage_dates(spark, tmp_path):
    docs = landing.documents(spark, put(tmp_path / "v", "v.json", {"count": 4, "vintage_dates": ["2020-02-01", "2020-01-01", "2020-01-01", "2020-13-01"]}))
    p = landing.vintage_dates(docs)
    assert [r["vintage_date"] for r in p.rows.collect()] == [date(2020, 1, 1), date(2020, 2, 1)] and p.skip_counts().first()["reason"] == "bad date"
    with pytest.raises(PySparkException, match="cut off"):
        landing.vintage_dates(landing.documents(spark, put(tmp_path / "w", "v.json", {"count": 9, "vintage_dates": ["2020-02-01"]}))).rows.collect()
    assert spark.range(1).select(landing.quarter_of(F.lit("2024-05-31").cast("date"))).first()[0] == 2


def test_index_names_with_quotes_and_odd_lines(spark, tmp_path):
    (tmp_path / "i").mkdir()
    lines = ['5|"QUOTED" & CO|10-K|20240102|edgar/data/5/0000000005-24-000001.txt', '6|"OPEN|8-K|20240102|edgar/data/6/0000000006-24-000001.txt', "7|short|8-K", "8|X|8-K|20240102|edgar/data/8/nonsense.txt", "9|X|8-K|never|edgar/data/9/0000000009-24-000001.txt"]
    (tmp_path / "i" / "company.20240103.idx").write_text(INDEX.format(320193, 1) + "\n".join(lines) + "\n", encoding="latin-1")
    p = landing.daily_index_parsed(spark, str(tmp_path / "i"), "2024-01-03")
    assert {r["cik"]: r["name"] for r in p.rows.collect()} == {320193: "Société", 5: '"QUOTED" & CO', 6: '"OPEN'}
    assert {r["reason"]: r["n"] for r in p.skip_counts().collect()} == {"not five fields": 1, "bad accession": 1, "no filing date": 1}


INDEX = "Description: daily\n\nCIK|Company Name|Form Type|Date Filed|File Name\n-----\n{}|Société|10-K|20240102|edgar/data/1/0000320193-24-{:06d}.txt\n"


def test_daily_index(spark, tmp_path):
    (tmp_path / "i").mkdir()
    (tmp_path / "i" / "company.20240103.idx").write_bytes(INDEX.format(320193, 1).encode("latin-1"))
    (r,) = landing.daily_index(spark, str(tmp_path / "i"), "2024-01-03").collect()
    assert (r["accn"], r["cik"], r["name"], r["filed_at"], r["disseminated_at"]) == ("0000320193-24-000001", 320193, "Société", date(2024, 1, 2), date(2024, 1, 3))


def test_macro(spark, tmp_path):
    o = [{"date": "2020-04-01", "realtime_start": "2020-07-30", "realtime_end": "2020-08-26", "value": v} for v in ("17205.822", ".", "x")]
    p = landing.macro_observations(landing.documents(spark, put(tmp_path / "m", "m.json", {"count": 3, "observations": o})), "GDPC1")
    assert sorted((r["value"] for r in p.rows.collect()), key=str) == [17205.822, None] and p.skip_counts().first()["reason"] == "bad value"
    with pytest.raises(PySparkException, match="cut off"):
        landing.macro_observations(landing.documents(spark, put(tmp_path / "n", "m.json", {"count": 9, "observations": o})), "GDPC1").rows.collect()
    assert [len(w) for w in landing.vintage_windows(["v"] * 3200)] == [1500, 1500, 200] and len(landing.vintage_windows(["v"] * 2000)) == 1


def test_bars_and_delistings(spark, tmp_path):
    raw = [{"date": "2024-01-02", "open": 185, "high": 186, "low": 184, "close": 185.5, "volume": 1e6}, {"date": "2024-01-03", "open": 1, "high": 0.5, "low": 0.4, "close": 1, "volume": 1}]
    docs = lambda n, b: landing.documents(spark, put(tmp_path / n, "x.json", b))
    p = landing.daily_bars(docs("r", raw), docs("a", [{"date": "2024-01-02", "adjClose": 184.9}]), "AAPL", "v")
    assert [(r["bar_date"], r["adj_close"]) for r in p.rows.collect()] == [(date(2024, 1, 2), 184.9)] and p.skip_counts().first()["reason"] == "impossible bar"
    with pytest.raises(PySparkException, match="no list"):
        landing.daily_bars(docs("e", {"Error": "limit"}), docs("a", []), "AAPL", "v").rows.collect()
    assert landing.delisted(docs("d", [{"symbol": "X", "ipoDate": "", "delistedDate": "2020-01-01"}, {"symbol": ""}]), "2026-01-01", "v").rows.count() == 1


# Warehouse


def test_insert_is_idempotent_and_replace_swaps(spark, tmp_path):
    w = store.Warehouse(spark, f"file://{tmp_path}/w")
    rows = with_provenance(spark.createDataFrame([(1, "AAPL", "N", date(2020, 1, 1)), (1, "AAPL", "Z", date(2020, 1, 1)), (2, "B", None, date(2020, 1, 2))], "cik long, ticker string, exchange string, observed_at date"))
    assert w.insert("entity_identifiers", rows, "exchange") == 2
    assert w.insert("entity_identifiers", rows, "exchange") == 0
    assert {r["exchange"] for r in w.read("entity_identifiers").collect()} == {"N", None} and w.count("entity_identifiers") == 2
    w.replace("entity_identifiers", w.read("entity_identifiers").where("cik = 2"))
    assert w.count("entity_identifiers") == 1
    with pytest.raises(ValueError):
        w.count("no_such_table")


def test_facts_keep_their_identity(spark):
    rows = spark.createDataFrame([(1, "us-gaap", "X", "USD", None, date(2020, 1, 1), Decimal(v), "a", date(2020, 2, k), None) for k, v in ((2, "2"), (1, "1"))], "cik long, taxonomy string, concept string, unit string, period_start date, period_end date, value decimal(38,10), accn string, filed_at date, retrieved_at timestamp")
    (r,) = store.prepare_facts(rows).collect()
    assert r["value"] == 1 and len(r["fact_key"]) == 64


def test_versions_of_a_table(spark, tmp_path):
    w = store.Warehouse(spark, f"file://{tmp_path}/w")
    make = lambda n: with_provenance(spark.range(n).selectExpr("id as cik", "'T' as ticker", "'N' as exchange", "date'2020-01-01' as observed_at"))
    w.insert("entity_identifiers", make(3))
    first = w.read("entity_identifiers")
    w.replace("entity_identifiers", w.read("entity_identifiers").where("cik > 0"))
    assert first.count() == 3 and w.count("entity_identifiers") == 2  # who reads the old version still can
    assert w.insert("entity_identifiers", make(4)) == 2
    w.replace("entity_identifiers", make(1))
    assert w.count("entity_identifiers") == 1 and len(w._versions("entity_identifiers")) == 2
    # A version that was written but never made current does not count.
    make(9).write.parquet(f"file://{tmp_path}/w/entity_identifiers/vunfinished")
    assert w.count("entity_identifiers") == 1
    reader = store.Warehouse(spark, w.root, read_only=True)
    assert reader.count("entity_identifiers") == 1
    with pytest.raises(PermissionError):
        reader.insert("entity_identifiers", make(1))


def test_payloads_are_stored_and_verified(spark, tmp_path):
    import gzip

    for k in range(4):
        put(tmp_path / "in", f"{k}.json", {"k": k % 3})
    raw = spark.read.format("binaryFile").load(str(tmp_path / "in")).select("path", "content")
    folder = f"file://{tmp_path}/store"
    ledger = spark.createDataFrame(store.write_payloads(raw, folder).collect())
    assert ledger.count() == 4 and ledger.select("stored_path").distinct().count() == 3
    places = sorted({r["stored_path"] for r in ledger.collect()})
    assert {gzip.decompress((tmp_path / "store" / x).read_bytes()) for x in places} == {json.dumps({"k": k}).encode() for k in range(3)}
    assert not store.verify_payloads(ledger, folder).count() and store.write_payloads(raw, folder).count() == 4
    (tmp_path / "store" / places[0]).unlink()
    (tmp_path / "store" / places[1]).write_bytes(gzip.compress(b"other"))
    (tmp_path / "store" / places[2]).write_bytes(b"no gzip")
    assert sorted(r["reason"] for r in store.verify_payloads(ledger, folder).collect()) == ["another content", "missing", "unreadable"]


def test_dissemination(spark):
    schema = "accn string, cik long, form string, filed_at date, items array<string>, disseminated_at date"
    old = spark.createDataFrame([("a", 1, "10-K", date(2020, 1, 1), ["x"], date(2020, 1, 5)), ("b", 1, "8-K", date(2020, 1, 1), [], None)], schema)
    seen = spark.createDataFrame([("a", 1, "10-K", date(2020, 1, 1), None, date(2020, 1, 7)), ("b", 1, "8-K", date(2020, 1, 1), None, date(2020, 1, 3)), ("c", 2, "8-K", date(2020, 1, 2), None, date(2020, 1, 4)), ("c", 2, "8-K", date(2020, 1, 2), None, date(2020, 1, 3))], schema)
    got = {r["accn"]: (r["disseminated_at"].day, r["items"]) for r in store.record_dissemination(old, seen.drop("items")).collect()}
    assert got == {"a": (5, ["x"]), "b": (3, []), "c": (3, [])}


def test_runs_and_breaker(spark):
    log = spark.createDataFrame([("r", "running", 1, 0), ("r", "ok", 2, 5), ("s", "running", 1, 0)], "run_id string, status string, ts long, rows_written long")
    got = {r["run_id"]: r["status"] for r in store.interrupted(store.run_states(log)).collect()}
    assert got == {"r": "ok", "s": "interrupted"}
    outcomes = ["ok", "failed", "failed", "gap", "failed", "failed", "failed", "failed", "failed", "ok", "ok"]
    df = spark.createDataFrame([("p", k, o) for k, o in enumerate(outcomes)], "source string, seq int, outcome string")
    assert store.broken_after(df).agg(F.max("seq")).first()[0] == 8
    assert store.broken_after(df.where("seq < 8")).count() == 8


def test_payloads(spark, tmp_path):
    put(tmp_path, "a.json", "x")
    df = store.prepare_payloads(spark.read.format("binaryFile").load(str(tmp_path)))
    r = df.first()
    assert r["stored_path"].startswith(f"{r['content_sha256'][:2]}/{r['content_sha256'][2:4]}/") and r["byte_len"] == 1


# Ledgers and studies


def test_book(tmp_path):
    book = ledgers.PaperBook(tmp_path / "book.jsonl")
    first = book.record(date(2026, 1, 1), Decimal("100"), [("A", Decimal("2"), Decimal("10")), ("B", Decimal("-1"), Decimal("5"))])
    assert (first["nav"], first["gross"], first["net"]) == ("115", "25", "15")
    book.record(date(2026, 1, 2), Decimal("100"), [])
    with pytest.raises(ValueError):
        book.record(date(2026, 1, 2), Decimal("1"), [])
    with pytest.raises(TypeError):
        book.record(date(2026, 1, 3), 1.0, [])
    assert book.verify() == -1
    lines = book.path.read_text().splitlines()
    for damage, at in (([lines[1]], 0), ([lines[1], lines[0]], 0), ([lines[0], lines[1].replace('"nav": "100"', '"nav": "101"')], 1)):
        book.path.write_text("\n".join(damage))
        assert book.verify() == at


def test_trials(spark, tmp_path):
    t = ledgers.TrialLedger(tmp_path / "t.jsonl")
    head = t.register("f", {"q": 5})
    t.register("f", {"q": 5})
    t.register("g", {"q": 10})
    t.record_outcome("f", head, "kept")
    assert (t.count(), t.count("f"), t.configurations("f"), t.verify()) == (3, 2, 1, -1)
    assert t.frame(spark, "kind STRING, family STRING").groupBy("kind").count().count() == 2


def test_card_and_study(spark, tmp_path):
    from tests.test_engine import BACK, RESTATED, facts

    df = facts(spark, RESTATED + BACK)
    ledger = ledgers.TrialLedger(tmp_path / "t.jsonl")
    card = studies.restatement_study(df, facts(spark, RESTATED), (1, 1), ledger, "c0ffee", tmp_path / "cards")
    assert card.findings["restated_facts"] == 2 and card.trials == 1
    again = ledgers.EvidenceCard(**{**card.__dict__, "generated_at": "later"})
    assert again.repro_hash == card.repro_hash
    with pytest.raises(AssertionError):
        studies.restatement_study(df, df, (1, 1), ledger, "c0ffee", tmp_path / "cards")
    put(tmp_path / "cards", "broken.json", "{")
    assert [r["study_id"] for r in service.evidence_index(spark, f"{tmp_path}/cards/*.json").collect()] == ["restatement"]
    assert ledgers.fixed(0.123456785) == "0.12345678" and ledgers.Comparison("x", 2, 0).relative is None


def test_service(spark):
    from tests.test_engine import RESTATED, facts

    tables = {
        "facts": facts(spark, RESTATED),
        "filings": spark.createDataFrame([("a", 1, "8-K", date(2020, 1, 1), date(2019, 12, 31), ["4.02"], None), ("b", 1, "8-K", date(2020, 1, 1), date(2019, 12, 31), [], None)], "accn string, cik long, form string, filed_at date, period_of_report date, items array<string>, disseminated_at date"),
        "filers": spark.createDataFrame([("a", 1, True), ("a", 2, False), ("b", 1, True)], "accn string, cik long, is_primary boolean"),
        "entities": spark.createDataFrame([(1, "Ring Co", ""), (320193, "Apple", "3571")], "cik long, name string, sic string"),
        "identifiers": spark.createDataFrame([(1, "AB", date(2020, 1, 1)), (320193, "A", date(2020, 1, 1)), (1, "a", date(2021, 1, 1))], "cik long, ticker string, observed_at date"),
    }
    assert service.resolve(tables, "a") == 1
    assert [r["ticker"] for r in service.search(tables, "a").collect()] == ["A", "a", "AB"]
    card = service.asof_card(tables, 320193, "EarningsPerShareDiluted", date(2009, 12, 1))
    assert card["as_known"] == Decimal("5.36") and card["as_it_stands_today"] == Decimal("6.78") and card["story"] == "restated later" and card["relative_drift"] == pytest.approx(0.2649, abs=1e-4)
    n, top = service.feed(tables, date(2020, 1, 1))
    assert n == 3 and [(r["accn"], r["cik"]) for r in top.collect()] == [("a", 1), ("a", 2)]
    assert service.revisions(tables, 320193, date(2011, 1, 1))[0] == 1
    assert service.quality(tables, date(2020, 1, 3))["freshness"] == "fresh"


# Stream


def test_stream_equals_batch(spark, tmp_path):
    land, out, mark = (str(tmp_path / x) for x in ("land", "out", "mark"))
    for k, day in enumerate(("20240103", "20240104", "20240105")):
        put(tmp_path / "land", f"company.{day}.idx", INDEX.format(320193, 1) + INDEX.format(7, k + 2))
    for _ in range(2):  # a second run finds nothing new
        feed.run_available(feed.index_stream(spark, land, files_per_batch=1), out, mark).awaitTermination()
    got = {r["accn"]: (r["cik"], str(r["disseminated_at"])) for r in feed.seen(spark, out).collect()}
    assert got == {"0000320193-24-000001": (320193, "2024-01-03"), "0000320193-24-000002": (7, "2024-01-03"), "0000320193-24-000003": (7, "2024-01-04"), "0000320193-24-000004": (7, "2024-01-05")}
