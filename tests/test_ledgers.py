"""Logs that are appended by their tails and verified by ranges; the ledger of payloads against what is stored."""

import json
import random
from datetime import date, datetime, timezone
from decimal import Decimal

import pytest

from tests.test_sources import put
from vintara.functions.hashing import GENESIS
from vintara.operators import store
from vintara.operators.store import Warehouse
from vintara.plans import ledgers
from vintara.plans.ingest import Ingestor


def log(tmp_path, n, name="log.jsonl", seed=1):
    rng, out = random.Random(seed), ledgers.ChainedLog(tmp_path / name)
    for k in range(n):
        out.append({"body": "x" * rng.randrange(400) + str(k), "Ü": "é"})
    return out


def test_appends_read_the_tail_only(tmp_path, monkeypatch):
    one = log(tmp_path, 60)
    monkeypatch.setattr(ledgers.ChainedLog, "read", None)  # never the whole file
    seen = []
    found = ledgers._line_before

    def spied(f, at):
        seen.append(at)
        return found(f, at)

    monkeypatch.setattr(ledgers, "_line_before", spied)
    for k in range(60, 70):
        one.append({"body": str(k)})
        assert len(one) == k + 1 and one.last()["entry"]["body"] == str(k)
    assert all(at >= 60 * 100 for at in seen)
    seen.clear()
    assert [one.entry(k)["sequence"] for k in range(1, 71)] == list(range(1, 71)) and one.entry(0) is None and one.entry(71) is None
    assert len(seen) < 70 * 9
    empty = ledgers.ChainedLog(tmp_path / "none.jsonl")
    assert empty.head() == GENESIS and len(empty) == 0 and empty.entry(1) is None


@pytest.mark.parametrize("range_bytes", [150, 1000, 1 << 20])
def test_ranges_verify_like_one_pass(spark, tmp_path, range_bytes):
    one = log(tmp_path, 40)
    lines = one.path.read_text().splitlines()
    damaged = {
        "whole": (lines, -1), "changed": (lines[:7] + [lines[7].replace("\"body\": \"", "\"body\": \"z", 1)] + lines[8:], 7), "removed": (lines[:20] + lines[21:], 20),
        "first": (lines[1:], 0), "moved": (lines[:3] + [lines[4], lines[3]] + lines[5:], 3), "last": (lines[:-1] + [lines[-1].replace("x", "y", 1) if "x" in lines[-1] else "{}"], 39),
        "broken": (lines[:11] + ["no json"] + lines[12:], 11), "blank": (lines[:5] + ["", "  "] + lines[5:], -1),
    }
    for name, (text, _) in damaged.items():
        (tmp_path / f"{name}.jsonl").write_text("\n".join(text) + "\n")
    got = {r["path"].rpartition("/")[2][:-6]: (r["entries"], r["first_break"]) for r in ledgers.verified(spark, f"{tmp_path}/*.jsonl", range_bytes).collect()}
    for name, (text, broken) in damaged.items():
        assert got[name] == (len([x for x in text if x.strip()]), broken), name
    for name in ("whole", "changed", "removed", "moved"):
        assert ledgers.ChainedLog(tmp_path / f"{name}.jsonl").verify() == damaged[name][1]


def test_trials_have_numbers_and_outcomes_bodies(spark, tmp_path):
    t = ledgers.TrialLedger(tmp_path / "t.jsonl")
    head = t.register("f", {"q": 5}, hypothesis="high beats low", registered_at="2026-01-01T00:00:00+00:00")
    t.register("f", {"q": 10})
    t.register("g", {"q": 5})
    t.record_outcome("f", 1, {"sharpe": "0.2", "kept": False})
    t.record_outcome("g", 3, "failed")
    last = t.entry(4)
    assert last["hypothesis"] == "[outcome of trial 1] high beats low" and last["config"] == {"amends": 1} and last["outcome"] == {"sharpe": "0.2", "kept": False}
    assert last["registered_at"] == t.entry(1)["registered_at"] == "2026-01-01T00:00:00+00:00" and t.record_outcome("f", head, "again")
    for wrong in (9, 4, 3):
        with pytest.raises(KeyError):
            t.record_outcome("f", wrong, "no")
    assert t.verify() == -1 and t.count("f") == 2
    got = {r["family"]: (r["trials"], r["configurations"], r["outcomes"]) for r in t.by_family(spark).collect()}
    assert got == {"f": (2, 2, 2), "g": (1, 1, 1)}


def test_marks_say_when_they_were_recorded(tmp_path):
    make = lambda name: ledgers.PaperBook(tmp_path / name)
    for book in (make("a"), make("b")):
        book.record(date(2026, 1, 1), Decimal("100"), [("A", Decimal("2"), Decimal("10"))], recorded_at=datetime(2026, 1, 2, tzinfo=timezone.utc))
    assert make("a").head() == make("b").head() and make("a").last()["entry"]["recorded_at"] == "2026-01-02T00:00:00+00:00"


def test_ledger_and_store_are_compared_both_ways(spark, tmp_path):
    w = Warehouse(spark, f"file://{tmp_path}/w")
    job = Ingestor(spark, w)
    for k in range(3):
        put(tmp_path / "t", f"{k}.json", {"0": {"cik_str": k + 1, "ticker": f"T{k}", "title": "A"}})
    assert job.payload_coverage().first().asDict() == {"indexed": 0, "on_disk": 0, "stored_bytes": 0, "missing": 0, "not_indexed": 0, "unfinished": 0}
    job.tickers(str(tmp_path / "t"), "2024-01-01")
    assert job.quality(date(2024, 1, 2))["payload_ledger"]["note"] == "complete"
    stored = tmp_path / "w" / "_payloads"
    places = sorted(p.relative_to(stored).as_posix() for p in stored.rglob("*.gz"))
    (stored / places[0]).unlink()
    (stored / "other.json.gz").write_bytes(b"1234")
    (stored / "x.part").write_bytes(b"1")
    found = store.payload_differences(w.read("raw_payloads"), store.stored_payloads(spark, job.payload_folder))
    assert {tuple(r) for r in found.collect()} == {(places[0], "missing"), ("other.json.gz", "not indexed"), ("x.part", "unfinished")}
    scan = store.stored_payloads(spark, job.payload_folder)._jdf.queryExecution().executedPlan().toString()
    assert "content" not in scan.split("ReadSchema")[1].split("\n")[0]
    page = job.quality(date(2024, 1, 2))
    assert page["payload_ledger"]["missing"] == 1 and page["payload_ledger"]["note"] != "complete"
    assert page["gaps"] == ["facts: 0 rows", "filings: 0 rows", "entities: 0 rows"] or set(page["gaps"]) == {"facts: 0 rows", "filings: 0 rows", "entities: 0 rows"}
    assert page["ingest_runs"][0]["source"] == "tickers" and page["ingest_runs"][0]["runs"] == 1 and json.dumps(page, default=str)


def test_cards_hash_all_they_state_but_the_time():
    from dataclasses import replace

    card = ledgers.EvidenceCard(
        "s", "Title", "2024-01-01", "c0ffee", 3, {"share": 0.123456789}, ("small",), "now", "high beats low", "it does not", "family", {"universe": "sample", "from": date(2020, 1, 1)},
        ({"label": "a", "sharpe": 0.5},), (ledgers.Comparison("a - b", 2.0, 1.0),), {"pbo": 0.25, "infinite": float("inf")},
    )
    body = card.body()
    assert body["comparisons"] == [{"label": "a - b", "left": "2.00000000", "right": "1.00000000", "difference": "1.00000000", "relative": "1.00000000"}]
    assert body["statistics"] == {"pbo": "0.25000000", "infinite": None} and body["provenance"]["from"] == "2020-01-01"
    assert replace(card, generated_at="later").repro_hash == card.repro_hash
    for other in ({"verdict": "it does"}, {"arms": ({"label": "a", "sharpe": 0.6},)}, {"comparisons": ()}, {"trial_family": "other"}, {"provenance": {}}):
        assert replace(card, **other).repro_hash != card.repro_hash
    text = card.to_markdown()
    assert "high beats low" in text and "a - b" in text and json.loads(card.to_json())["hypothesis"] == "high beats low"
