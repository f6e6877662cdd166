"""Landed files to answers, through the warehouse and the command line."""

import json
from datetime import date
from decimal import Decimal

import pytest

from tests.test_sources import ENTRIES, INDEX, put, submissions
from vintara.__main__ import main
from vintara.operators.asof import AsOf
from vintara.operators.store import Warehouse
from vintara.plans.ingest import Ingestor, tables


def test_ingest_then_read(spark, tmp_path, capsys):
    root = f"file://{tmp_path}/w"
    w, base = Warehouse(spark, root), tmp_path / "land"
    job = Ingestor(spark, w)
    facts = put(base / "facts", "CIK0000320193.json", {"cik": 320193, "facts": {"us-gaap": {"Eps": {"units": {"USD/shares": ENTRIES}}}}})
    tick = put(base / "tick", "t.json", {"0": {"cik_str": 320193, "ticker": "AAPL", "title": "A"}})
    subs = put(base / "subs", "CIK0000320193.json", {"cik": "320193", "name": "A Company", "filings": {"recent": submissions()}})
    assert job.tickers(tick, "2024-01-01").written["entity_identifiers"] == 1
    done = job.facts(facts)
    assert done.written["facts"] == 2 and done.skipped == {"bad accession": 1} and done.written["raw_payloads"] == 1
    assert job.facts(facts).written == {"raw_payloads": 0, "facts": 0}
    assert job.filings(subs).written["filing_filers"] == 1
    (base / "idx").mkdir()
    (base / "idx" / "company.20240103.idx").write_bytes((INDEX.format(320193, 1) + INDEX.format(7, 9)).encode("latin-1"))
    daily = job.daily(str(base / "idx"), "2024-01-03")
    assert daily.written == {"filings": 1, "filing_filers": 1}
    with pytest.raises(ValueError):
        (base / "none").mkdir()
        (base / "none" / "x.idx").write_text("nothing here\n")
        job.daily(str(base / "none"), "2024-01-04")
    assert {r["status"] for r in w.read("ingest_runs").collect()} == {"ok", "failed"} and job.reconcile() == 0
    assert job.backfill_links() == 0
    o = [{"date": "2020-04-01", "realtime_start": f"2020-0{m}-01", "realtime_end": f"2020-0{m}-28", "value": v} for m, v in ((7, "1"), (8, "1"), (9, "2"))]
    macro = put(base / "m", "m.json", {"count": 3, "observations": o})
    assert job.macro(macro, "GDP").written["macro_observations"] == 2
    bars = put(base / "raw", "b.json", [{"date": "2024-01-02", "open": 185, "high": 186, "low": 184, "close": 185.5, "volume": 1e6}])
    adj = put(base / "adj", "b.json", [{"date": "2024-01-02", "adjClose": 184.9}])
    assert job.prices(bars, adj, "AAPL", "v").written["prices"] == 1
    assert job.delistings(put(base / "d", "d.json", [{"symbol": "X"}]), "2024-01-01", "v").written["delistings"] == 1

    t = tables(w)
    assert AsOf(t, date(2010, 1, 1)).value(320193, "Eps", period_start=date(2007, 9, 30)) == Decimal("5.36")
    assert AsOf(t, date(2024, 2, 1)).filings(7).first()["knowledge_date"] == date(2024, 1, 3)
    assert AsOf(t, date(2021, 1, 1)).macro("GDP", date(2020, 4, 1)) == 2.0
    assert job.companies_without_facts(spark.createDataFrame([(320193,), (7,)], "cik long")).first()["cik"] == 7

    assert main(["--warehouse", root, "status"]) == 0 and "facts" in capsys.readouterr().out
    assert main(["--warehouse", root, "asof", "aapl", "--concept", "Eps", "--on", "2010-01-01"]) == 0
    assert "5.36" in capsys.readouterr().out
    assert main(["--warehouse", root, "revisions", "aapl", "--on", "2010-01-01"]) == 0
    assert "0 revisions" in capsys.readouterr().out
    put(base / "subs", "CIK0000000009.json", "broken")
    put(base / "frames", "x", "")
    spark.createDataFrame([(320193, 5.0), (9, 7.0)], "cik long, val double").write.mode("overwrite").parquet(str(base / "frames"))
    assert main(["--warehouse", root, "ingest", "universe", "5", "1.0", "7", str(base / "frames"), subs, facts]) == 0
    assert "unexpected shape" in capsys.readouterr().out
    assert main(["--warehouse", root, "search", "AAPL"]) == 0 and "A Company" in capsys.readouterr().out
    assert main(["--warehouse", root, "ingest", "company", "320193", subs, facts]) == 0
    assert w.count("entities") == 1 and not job.damaged_payloads().count()
    capsys.readouterr()
    assert job.many_prices([(bars, adj, "AAPL", ), (str(base / "none"), adj, "X"), (str(base / "nowhere"), adj, "Y"), (bars, adj, "Z")], "v", limit=2)["Z"] == "skipped"
    assert main(["--warehouse", root, "ingest", "tickers", tick, "2024-01-02"]) == 0
    assert "entity_identifiers" in capsys.readouterr().out


def test_new_documents(spark, tmp_path):
    from vintara.sources import landing

    w = Warehouse(spark, f"file://{tmp_path}/w")
    path = put(tmp_path / "t", "t.json", {"0": {"cik_str": 1, "ticker": "A", "title": "A"}})
    job = Ingestor(spark, w)
    assert job.new_documents(landing.documents(spark, path)).count() == 1
    job.tickers(path, "2024-01-01")
    assert job.new_documents(landing.documents(spark, path)).count() == 0
    assert json.loads(w.read("ingest_runs").first()["params_json"])["table"] == "entity_identifiers"
