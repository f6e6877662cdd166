"""The read surface as functions: search, as-of card, revisions, day feed, quality, evidence. HTTP is left to the caller."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vintara.errors import InsufficientData
from vintara.operators import asof, corpus, forensics, views
from vintara.operators.asof import AsOf

LIMITS = (1, 50)
#: Days after which the newest filing counts as old.
STALE_DAYS = 4
SEVERITY = ("fresh", "partial", "stale", "broken")


def search(tables: dict[str, DataFrame], prefix: str, name_part: str | None = None, limit: int = 10) -> DataFrame:
    """Tickers with the prefix, or companies with the text in their name; the shortest tickers first. % and _ stand for themselves."""
    limit = max(LIMITS[0], min(LIMITS[1], limit))
    rows = tables["identifiers"].join(tables["entities"].select("cik", "name"), "cik")
    hit = F.upper("ticker").startswith(prefix.upper()) | F.upper("name").contains((name_part or prefix).upper())
    return rows.where(hit).select("ticker", "cik", "name").distinct().orderBy(F.length("ticker"), "ticker", "cik").limit(limit)


def resolve(tables: dict[str, DataFrame], ticker: str) -> int:
    row = tables["identifiers"].where(F.upper("ticker") == ticker.upper()).orderBy(F.desc("observed_at"), "cik").first()
    if row is None:
        raise InsufficientData(f"no company has the ticker {ticker}")
    return row["cik"]


def data_vintage(tables: dict[str, DataFrame]) -> date | None:
    return tables["filings"].agg(F.max("filed_at")).first()[0]


def asof_card(tables: dict[str, DataFrame], cik: int, concept: str, day: date, *, period_end=None, period_start=None, taxonomy: str = asof.DEFAULT_TAXONOMY) -> dict:
    """The fact as known on a day, pinned to its own period for the comparison with its first and its current report."""
    known = AsOf(tables, day).fact(cik, concept, period_end=period_end, period_start=period_start, taxonomy=taxonomy)
    same = tables["facts"]
    for c in ("cik", "taxonomy", "concept", "unit", "period_end"):
        same = same.where(F.col(c) == F.lit(known[c]))
    same = same.where(F.col("period_start").eqNullSafe(F.lit(known["period_start"]).cast("date")))
    return asof.narrative(asof.vintage_triples(same, day)).first().asDict()


def revisions(tables: dict[str, DataFrame], cik: int, day: date, *, concept=None, min_change: float = 0.05, limit: int = 50, taxonomy: str = asof.DEFAULT_TAXONOMY) -> tuple[int, DataFrame]:
    """The number of revisions, and the newest of them."""
    rows = AsOf(tables, day).revisions(cik, concept=concept, taxonomy=taxonomy, min_relative_change=min_change)
    return rows.count(), rows.orderBy(F.desc("knowledge_date"), "cik", "concept", "period_end").limit(limit)


def feed(tables: dict[str, DataFrame], day: date, limit: int = 100) -> tuple[int, DataFrame]:
    """The number of company filings of a day, and its flagged ones in order of score."""
    flagged = forensics.day_feed(views.company_filings(tables["filings"], tables["filers"]), day)
    return flagged.count(), forensics.ranked(flagged).limit(limit)


def freshness(newest: date | None, today: date, gaps: int = 0) -> str:
    """broken for none or a date in the future, stale beyond STALE_DAYS, partial with gaps, else fresh."""
    if newest is None or (today - newest).days < 0:
        return "broken"
    if (today - newest).days > STALE_DAYS:
        return "stale"
    return "partial" if gaps else "fresh"


#: Tables whose absence is a gap; prices and macro data may be out of reach for good reasons.
LOAD_BEARING = ("entities", "identifiers", "filings", "facts")


def runs_by_source(runs: DataFrame) -> DataFrame:
    """By source the number of runs, how many did not end well, and the last start."""
    bad = F.count_if(F.col("status").isin("failed", "interrupted")).alias("not_well")
    return runs.groupBy("source").agg(F.count("*").alias("runs"), bad, F.max("started_at").alias("last_started"))


def quality(tables: dict[str, DataFrame], today: date, runs: DataFrame | None = None, coverage: DataFrame | None = None) -> dict:
    """Coverage and lineage: rows, facts and revised ones, freshness with its gaps, and, given ``runs`` (a row for each) and ``coverage``
    (of :func:`vintara.operators.store.payload_coverage`), the runs of each source and how ledger and store agree.

    A ledger that lists less than is stored is reported, and is no gap: the contents are there under their hashes.
    """
    keys = {r["key"]: r for r in corpus.right_and_wrong_key(tables["facts"]).collect()}
    newest = data_vintage(tables)
    counts = {name: df.count() for name, df in tables.items()}
    gaps = [f"{name}: 0 rows" for name in LOAD_BEARING if counts.get(name) == 0]
    page = {
        "rows": counts,
        "facts": keys["grain"]["facts"],
        "revised_facts": keys["grain"]["revised"],
        "data_vintage": newest,
        "gaps": gaps,
        "freshness": freshness(newest, today, len(gaps)),
    }
    if runs is not None:
        page["ingest_runs"] = [r.asDict() for r in runs_by_source(runs).orderBy("source").collect()]
    if coverage is not None:
        page["payload_ledger"] = coverage.first().asDict()
        page["payload_ledger"]["note"] = "complete" if not (page["payload_ledger"]["not_indexed"] or page["payload_ledger"]["missing"]) else "store and ledger differ"
    return page


def evidence_index(spark: SparkSession, folder: str) -> DataFrame:
    """Cards in a folder, newest first; files that are no cards are left out."""
    schema = "study_id STRING, title STRING, generated_at STRING, repro_hash STRING"
    files = spark.read.format("binaryFile").load(folder).select(F.from_json(F.decode("content", "UTF-8"), schema).alias("c"))
    return files.select("c.*").where("study_id is not null").orderBy(F.desc("generated_at"), "study_id")
