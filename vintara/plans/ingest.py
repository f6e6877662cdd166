"""Batch ingest: landed files through readers into the warehouse, each run with an entry that says how it ended.

Every write is insert-if-absent on the table's key, so a run that is repeated adds nothing. Files that were indexed
before can be left out by their content hash. Rejected rows are counted by reason, never lost silently, and a file of the
wrong shape is one reject: it never ends the batch that it is in. Contents are stored, packed, under their hashes.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from datetime import date, datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import vintara
from vintara import schemas
from vintara.functions.hashing import canonical_hash, canonical_json
from vintara.operators import store
from vintara.operators.store import Warehouse
from vintara.plans import service
from vintara.sources import landing


STATUSES = ("running", "ok", "failed", "interrupted")


@dataclass(frozen=True)
class Outcome:
    run_id: str
    written: dict[str, int]
    skipped: dict[str, int]


class Ingestor:
    def __init__(self, spark: SparkSession, warehouse: Warehouse, code_version: str | None = None, clock: Callable[[], datetime] = lambda: datetime.now(timezone.utc)):
        self.spark, self.warehouse, self.code_version, self.clock = spark, warehouse, code_version or vintara.code_version(), clock

    # Runs

    def _run(self, source: str, params: dict, work: Callable[[str], tuple[dict[str, int], dict[str, int]]]) -> Outcome:
        run_id = f"run-{uuid.uuid4().hex[:12]}"
        start = self.clock()
        row = {"run_id": run_id, "source": source, "params_hash": canonical_hash(params), "params_json": canonical_json(params), "started_at": start, "finished_at": None, "status": "running", "rows_written": 0, "bytes_fetched": 0, "code_version": self.code_version, "error": None}
        self._write_run(row)
        try:
            written, skipped = work(run_id)
        except Exception as error:
            self._write_run(row | {"status": "failed", "finished_at": self.clock(), "error": str(error)[:500]})
            raise
        self._write_run(row | {"status": "ok", "finished_at": self.clock(), "rows_written": sum(written.values())})
        return Outcome(run_id, written, skipped)

    def _write_run(self, row: dict) -> None:
        """Append a state; the table's readers see each run's last."""
        if row["status"] not in STATUSES:
            raise ValueError(f"a run is {', '.join(STATUSES)}, not {row['status']}")
        one = self.spark.createDataFrame([tuple(row[f.name] for f in schemas.schema("ingest_runs"))], schemas.schema("ingest_runs"))
        self.warehouse.append("ingest_runs", one)

    def reconcile(self) -> int:
        """Runs that a vanished process left running."""
        left = self.warehouse.read("ingest_runs").where("status = 'running'")
        n = left.count()
        if n:
            self.warehouse.append("ingest_runs", store.interrupted(left).withColumn("finished_at", F.lit(self.clock())))
        return n

    # Tables

    def _provenance(self, rows: DataFrame, docs: DataFrame, run_id: str) -> DataFrame:
        known = docs.select("source_uri", "content_sha256").distinct()
        rows = rows.join(known, "source_uri")
        return rows.withColumns({"retrieved_at": F.lit(self.clock()), "ingest_run_id": F.lit(run_id)})

    @property
    def payload_folder(self) -> str:
        return f"{self.warehouse.root}/_payloads"

    def _index(self, path: str, source: str, run_id: str) -> int:
        """Store the files' bytes under their hashes and enter them in the ledger."""
        raw = self.spark.read.format("binaryFile").load(path).select("path", "content")
        rows = store.write_payloads(raw, self.payload_folder).withColumnRenamed("path", "source_uri")
        rows = rows.withColumns({"source": F.lit(source), "retrieved_at": F.lit(self.clock()), "ingest_run_id": F.lit(run_id)})
        return self.warehouse.insert("raw_payloads", rows, "source_uri")

    def damaged_payloads(self) -> DataFrame:
        """Ledger entries whose stored content is missing or another one."""
        return store.verify_payloads(self.warehouse.read("raw_payloads"), self.payload_folder)

    def payload_coverage(self) -> DataFrame:
        """One row: how the ledger and what is stored agree, both ways."""
        return store.payload_coverage(self.warehouse.read("raw_payloads"), store.stored_payloads(self.spark, self.payload_folder))

    def quality(self, today: date) -> dict:
        """The quality page of this warehouse."""
        return service.quality(tables(self.warehouse), today, self.warehouse.read("ingest_runs"), self.payload_coverage())

    def new_documents(self, docs: DataFrame) -> DataFrame:
        """Those whose content no run has indexed."""
        return store.absent(docs, self.warehouse.read("raw_payloads"), ["content_sha256"])

    def _ingest(self, source: str, table: str, path: str, parse: Callable[[DataFrame], landing.Parsed], order: list[str], prepare=lambda rows: rows, then=None, params: dict | None = None) -> Outcome:
        def work(run_id):
            docs = landing.documents(self.spark, path).cache()
            try:
                parsed = parse(docs)
                written = {"raw_payloads": self._index(path, source, run_id)}
                rows = prepare(self._provenance(parsed.rows, docs, run_id))
                written[table] = self.warehouse.insert(table, rows, *order)
                if then:
                    written |= then(run_id, rows, docs)
                skipped = {r["reason"]: r["n"] for r in parsed.skip_counts().collect()}
            finally:
                docs.unpersist()
            return written, skipped

        return self._run(source, {"path": path, "table": table} | (params or {}), work)

    def tickers(self, path: str, observed_at: str) -> Outcome:
        return self._ingest("tickers", "entity_identifiers", path, lambda docs: landing.company_tickers(docs, observed_at, strict=False), ["source_uri"])

    def filings(self, path: str, history: str | None = None, observed_at: str | None = None, wanted: DataFrame | None = None) -> Outcome:
        """Submissions files: their companies, filings and links; of ``wanted`` (cik) companies only, if given."""

        def of(rows):
            return rows if wanted is None else rows.join(wanted.select("cik").distinct(), "cik", "left_semi")

        def parse(docs):
            return landing.submissions(docs, landing.documents(self.spark, history) if history else None, strict=False)

        def more(run_id, rows, docs):
            links = store.submission_links(rows).withColumns({"source_uri": F.lit(path), "retrieved_at": F.lit(self.clock()), "ingest_run_id": F.lit(run_id)})
            day = observed_at or self.clock().date().isoformat()
            return {"filing_filers": self.warehouse.insert("filing_filers", links), "entities": self._upsert_entities(of(self._provenance(landing.entities(docs, day).rows, docs, run_id)))}

        return self._ingest("submissions", "filings", path, parse, ["filed_at"], prepare=of, then=more)

    def _upsert_entities(self, seen: DataFrame) -> int:
        """The number of companies that were not known before."""
        attributes = [f.name for f in schemas.schema("entities") if f.name not in ("cik", "first_observed", "last_observed")]
        new = schemas.conform(store.first_wins(seen, ["cik"], "source_uri"), "entities")
        return self.warehouse.merge("entities", new, lambda old, new: store.upsert_entities(schemas.conform(old, "entities"), new, attributes))

    def facts(self, path: str, wanted: DataFrame | None = None) -> Outcome:
        """Company-facts files; of ``wanted`` (cik) companies only, if given."""

        def prepare(rows):
            return store.prepare_facts(rows if wanted is None else rows.join(wanted.select("cik").distinct(), "cik", "left_semi"))

        return self._ingest("facts", "facts", path, lambda docs: landing.company_facts(docs, strict=False), ["filed_at", "source_uri"], prepare=prepare)

    def company(self, cik: int, submissions: str, facts: str) -> dict[str, Outcome]:
        """One company's landed files: CIK and ten digits in their names."""
        own = f"CIK{int(cik):010d}*.json"
        return {"filings": self.filings(f"{submissions}/{own}"), "facts": self.facts(f"{facts}/{own}")}

    def universe(self, size: int, floor: float, seed: int, frames: str, submissions: str, facts: str) -> dict[str, Outcome]:
        """The sampled companies of ``frames`` (Parquet: cik, val): their filings, and the facts of those that have none yet, so an
        interrupted ingest goes on where it was. Files of other companies leave no rows.

        All companies are one batch; a file of the wrong shape is a reject of it.
        """
        sample = landing.sampled_universe(self.spark.read.parquet(frames), floor, size, seed).cache()
        wanted = self.companies_without_facts(sample).cache()
        try:
            done = {"filings": self.filings(submissions, wanted=sample)}
            if not wanted.isEmpty():
                done["facts"] = self.facts(facts, wanted)
            return done
        finally:
            wanted.unpersist()
            sample.unpersist()

    def macro(self, path: str, series_id: str, vintages: DataFrame | None = None) -> Outcome:
        """Observation files of one series, one for each window of its archive; ``vintages`` (vintage_date) shows what no window covers."""

        def parse(docs):
            return landing.union_windows(landing.macro_observations(docs, series_id, strict=False), vintages)

        return self._ingest("macro", "macro_observations", path, parse, ["realtime_end"], params={"series": series_id})

    def prices(self, raw: str, adjusted: str, symbol: str, source: str) -> Outcome:
        return self._ingest(source, "prices", raw, lambda docs: landing.daily_bars(docs, landing.documents(self.spark, adjusted), symbol, source, strict=False), ["source_uri"], params={"symbol": symbol})

    def many_prices(self, batches: list[tuple[str, str, str]], source: str, limit: int = 5) -> dict[str, str]:
        """Several symbols (raw, adjusted, symbol), one after the other: what became of each. One that fails ends none of the
        others, but after ``limit`` failures in a row the source counts as down and the rest is skipped."""
        out, failures = {}, 0
        for raw, adjusted, symbol in batches:
            if failures >= limit:
                out[symbol] = "skipped"
                continue
            try:
                done = self.prices(raw, adjusted, symbol, source)
                if "no list of bars" in done.skipped:  # an answer, but not to the question: a spent quota looks like that
                    raise ValueError("no list of bars")
                out[symbol], failures = "ok", 0
            except Exception as error:  # the run's entry says what it was
                out[symbol], failures = f"failed: {str(error)[:200]}", failures + 1
        return out

    def delistings(self, path: str, observed_at: str, source: str) -> Outcome:
        return self._ingest(source, "delistings", path, lambda docs: landing.delisted(docs, observed_at, source, strict=False), ["source_uri"])

    def daily(self, path: str, day: str) -> Outcome:
        """A day's index: stubs for new filings, the earliest public date for known ones, a link for each company. An empty index raises."""

        def work(run_id):
            parsed = landing.daily_index_parsed(self.spark, path, day)
            seen = parsed.rows.drop("source_uri").cache()
            try:
                if not seen.count():
                    raise ValueError(f"the index of {day} has no entries")
                extra = {"source_uri": F.lit(path), "retrieved_at": F.lit(self.clock()), "content_sha256": F.lit(""), "ingest_run_id": F.lit(run_id)}

                def recorded(old, seen):
                    return store.record_dissemination(old, seen).withColumns({c: F.coalesce(c, v) for c, v in extra.items()})

                added = self.warehouse.merge("filings", seen, recorded)
                links = seen.select("accn", "cik").withColumn("is_primary", F.col("accn").startswith(F.lpad(F.col("cik").cast("string"), 10, "0"))).withColumns({k: v for k, v in extra.items() if k != "content_sha256"})
                return {"filings": added, "filing_filers": self.warehouse.insert("filing_filers", links)}, {r["reason"]: r["n"] for r in parsed.skip_counts().collect()}
            finally:
                seen.unpersist()

        return self._run("daily-index", {"day": day}, work)

    def backfill_links(self) -> int:
        rows = store.missing_links(self.warehouse.read("filings"), self.warehouse.read("filing_filers"))
        return self.warehouse.insert("filing_filers", rows.withColumns({"source_uri": F.lit("backfill"), "retrieved_at": F.lit(self.clock()), "ingest_run_id": F.lit("backfill")}))

    def companies_without_facts(self, wanted: DataFrame) -> DataFrame:
        """Of the wanted companies (cik) those that have none yet: where an interrupted ingest goes on."""
        return store.absent(wanted.select("cik").distinct(), self.warehouse.read("facts"), ["cik"])


def tables(warehouse: Warehouse) -> dict[str, DataFrame]:
    """The warehouse as the tables that as-of reads take; facts carry their knowledge date."""
    from vintara.operators.views import with_knowledge_date

    filings = warehouse.read("filings")
    return {
        "facts": with_knowledge_date(warehouse.read("facts"), filings),
        "filings": filings,
        "filers": warehouse.read("filing_filers").select("accn", "cik", "is_primary"),
        "entities": warehouse.read("entities"),
        "identifiers": warehouse.read("entity_identifiers"),
        "macro": warehouse.read("macro_observations"),
        "prices": warehouse.read("prices"),
    }
