"""Declared table schemas. Nothing is inferred: every reader and writer takes its StructType from here."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

#: What makes two reports reports of the same fact. A null period_start is an instant and a group of its own.
GRAIN = ["cik", "taxonomy", "concept", "unit", "period_start", "period_end"]
#: Order of a fact's reports; the value breaks ties of two reports in one filing.
CHAIN_ORDER = ["knowledge_date", "accn", "value"]

_PROVENANCE = ", source_uri STRING NOT NULL, retrieved_at TIMESTAMP NOT NULL, content_sha256 STRING NOT NULL, ingest_run_id STRING NOT NULL"
DDL: dict[str, str] = {
    "ingest_runs": "run_id STRING NOT NULL, source STRING NOT NULL, params_hash STRING, params_json STRING, started_at TIMESTAMP NOT NULL, finished_at TIMESTAMP, status STRING NOT NULL, rows_written BIGINT, bytes_fetched BIGINT, code_version STRING, error STRING",
    "raw_payloads": "content_sha256 STRING NOT NULL, source STRING NOT NULL, source_uri STRING NOT NULL, retrieved_at TIMESTAMP NOT NULL, byte_len BIGINT NOT NULL, http_status INT, stored_path STRING NOT NULL, ingest_run_id STRING NOT NULL",
    "entities": "cik BIGINT NOT NULL, name STRING NOT NULL, entity_type STRING, sic STRING, sic_description STRING, fiscal_year_end STRING, state_of_incorp STRING, first_observed DATE NOT NULL, last_observed DATE NOT NULL" + _PROVENANCE,
    "entity_identifiers": "cik BIGINT NOT NULL, ticker STRING NOT NULL, exchange STRING, observed_at DATE NOT NULL" + _PROVENANCE,
    "filings": "accn STRING NOT NULL, cik BIGINT NOT NULL, form STRING NOT NULL, filed_at DATE NOT NULL, accepted_at TIMESTAMP, period_of_report DATE, primary_document STRING, items ARRAY<STRING>, is_xbrl BOOLEAN, disseminated_at DATE" + _PROVENANCE,
    "filing_filers": "accn STRING NOT NULL, cik BIGINT NOT NULL, is_primary BOOLEAN NOT NULL, source_uri STRING NOT NULL, retrieved_at TIMESTAMP NOT NULL, ingest_run_id STRING NOT NULL",
    "facts": "fact_key STRING NOT NULL, cik BIGINT NOT NULL, taxonomy STRING NOT NULL, concept STRING NOT NULL, unit STRING NOT NULL, period_start DATE, period_end DATE NOT NULL, value DECIMAL(38,10) NOT NULL, accn STRING NOT NULL, form STRING, filed_at DATE NOT NULL, fy INT, fp STRING, frame STRING" + _PROVENANCE,
    "macro_observations": "series_id STRING NOT NULL, obs_date DATE NOT NULL, realtime_start DATE NOT NULL, realtime_end DATE NOT NULL, value DOUBLE" + _PROVENANCE,
    "prices": "symbol STRING NOT NULL, bar_date DATE NOT NULL, open DOUBLE NOT NULL, high DOUBLE NOT NULL, low DOUBLE NOT NULL, close DOUBLE NOT NULL, adj_close DOUBLE, volume DOUBLE NOT NULL, source STRING NOT NULL" + _PROVENANCE,
    "delistings": "symbol STRING NOT NULL, exchange STRING, company_name STRING, ipo_date DATE, delisted_date DATE, observed_at DATE NOT NULL, source STRING NOT NULL" + _PROVENANCE,
}
#: Tables that are logs of states: reading gives the latest state of each key, by this column, null first.
LOGS = {"ingest_runs": "finished_at"}
KEYS: dict[str, list[str]] = {
    "ingest_runs": ["run_id"],
    "raw_payloads": ["content_sha256"],
    "entities": ["cik"],
    "entity_identifiers": ["cik", "ticker", "observed_at"],
    "filings": ["accn"],
    "filing_filers": ["accn", "cik"],
    "facts": ["fact_key"],
    "macro_observations": ["series_id", "obs_date", "realtime_start"],
    "prices": ["symbol", "bar_date", "source"],
    "delistings": ["symbol", "observed_at", "source"],
}


#: Tables whose rows change: reading gives the row of each key that was written last.
CHANGING = {"entities", "filings"}


@dataclass(frozen=True)
class Migration:
    """A step from one schema to the next: for each table that it makes or remakes, a query over the tables before it, named in braces.

    A step that was ever applied must not be edited: its checksum stands in the warehouse. Write another one instead.
    """

    number: int
    name: str
    tables: dict[str, str]

    @property
    def checksum(self) -> str:
        told = repr((self.number, self.name, sorted(self.tables.items())))
        return hashlib.sha256(told.encode()).hexdigest()[:16]


MIGRATIONS = (
    Migration(1, "initial", {}),
    Migration(2, "dissemination", {"filings": "SELECT *, CAST(NULL AS DATE) AS disseminated_at FROM {filings}"}),
    Migration(3, "filers", {"filing_filers": "SELECT accn, cik, startswith(accn, lpad(CAST(cik AS STRING), 10, '0')) AS is_primary, source_uri, retrieved_at, ingest_run_id FROM {filings}"}),
)


def schema(table: str) -> StructType:
    return StructType.fromDDL(DDL[table])


def checksum(table: str) -> str:
    """Stored with whatever is written to a table; a reader that finds another one refuses the data."""
    return hashlib.sha256(DDL[table].encode()).hexdigest()


def conform(df: DataFrame, table: str) -> DataFrame:
    """The table's columns in order, each cast to its type; a missing nullable column becomes null."""
    from pyspark.sql import functions as F

    columns = []
    for field in schema(table):
        if field.name in df.columns:
            columns.append(F.col(field.name).cast(field.dataType).alias(field.name))
        elif field.nullable:
            columns.append(F.lit(None).cast(field.dataType).alias(field.name))
        else:
            raise ValueError(f"{table} needs the column {field.name}")
    return df.select(*columns)
