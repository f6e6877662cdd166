"""Writes without MERGE: first-wins dedupe, insert-if-absent, upserts and repairs as DataFrames, and a Parquet warehouse.

The DataFrame functions return what a table holds after the write; the warehouse adds a segment with what the write changes
and then its commit, so no path is overwritten while it is read and no moment is without a table.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vintara import schemas
from vintara.functions.hashing import fact_key
from vintara.functions.scalars import fitted, padded_cik
from vintara.operators.staging import staged


def first_wins(batch: DataFrame, keys: list[str], *order: str | Column) -> DataFrame:
    """One row per key, the first in ``order``: a rank limit, cut down before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return batch.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def absent(new: DataFrame, old: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``new`` whose key ``old`` does not have; null keys compare equal."""
    known = old.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    match = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return new.join(known, match, "left_anti")


def upsert_entities(old: DataFrame, new: DataFrame, attributes: list[str]) -> DataFrame:
    """By cik the newest attributes, the least first_observed and the greatest last_observed; ``new`` wins over ``old``."""
    rows = old.withColumn("_age", F.lit(0)).unionByName(new.withColumn("_age", F.lit(1)))
    at = F.struct("_age", "last_observed")
    return rows.groupBy("cik").agg(*[F.max_by(F.struct(a), at)[a].alias(a) for a in attributes], F.min("first_observed").alias("first_observed"), F.max("last_observed").alias("last_observed"))


def record_dissemination(filings: DataFrame, seen: DataFrame) -> DataFrame:
    """``filings`` after the daily index ``seen`` (accn, cik, form, filed_at, disseminated_at): stubs for new filings, the earliest date for known ones."""
    first = first_wins(seen, ["accn"], F.col("disseminated_at").asc_nulls_last(), "cik").select("accn", *[F.col(c).alias(f"_{c}") for c in ("cik", "form", "filed_at", "disseminated_at")])
    both = filings.join(first, "accn", "full_outer")
    columns = []
    for c in filings.columns:
        if c == "disseminated_at":
            columns.append(F.least("disseminated_at", "_disseminated_at").alias(c))
        elif c in ("cik", "form", "filed_at"):
            columns.append(F.coalesce(c, f"_{c}").alias(c))
        elif c == "items":
            columns.append(F.coalesce("items", F.array().cast("array<string>")).alias(c))
        else:
            columns.append(F.col(c))
    return both.select(*columns)


def submission_links(filings: DataFrame) -> DataFrame:
    """The mandatory link of each filing to the company that submitted it; primary if the accession starts with its number."""
    return filings.select("accn", "cik", F.col("accn").startswith(padded_cik(F.col("cik"))).alias("is_primary"))


def missing_links(filings: DataFrame, links: DataFrame) -> DataFrame:
    """Links that should exist and do not."""
    return absent(submission_links(filings), links, ["accn", "cik"])


def merge_unrevised_runs(vintages: DataFrame) -> DataFrame:
    """Vintages with equal consecutive values become one, from its first start to its last end; A, B, A stays three."""
    w = Window.partitionBy("series_id", "obs_date").orderBy("realtime_start")
    changed = F.when(F.row_number().over(w) == 1, 1).when(~F.lag("value").over(w).eqNullSafe(F.col("value")), 1).otherwise(0)
    rows = vintages.withColumn("_c", changed).withColumn("_run", F.sum("_c").over(w))
    out = rows.groupBy("series_id", "obs_date", "_run").agg(F.min("realtime_start").alias("realtime_start"), F.max("realtime_end").alias("realtime_end"), F.first("value").alias("value"))
    return out.drop("_run").orderBy("series_id", "obs_date", "realtime_start")


def interrupted(runs: DataFrame) -> DataFrame:
    """Runs left running by a process that is gone."""
    return runs.withColumn("status", F.when(F.col("status") == "running", "interrupted").otherwise(F.col("status")))


def run_states(log: DataFrame) -> DataFrame:
    """The latest state of each run of an append-only log (run_id, status, ts, rows_written)."""
    return log.groupBy("run_id").agg(F.max_by("status", "ts").alias("status"), F.max("rows_written").alias("rows_written"))


def broken_after(outcomes: DataFrame, limit: int = 5) -> DataFrame:
    """Ordered outcomes (source, seq, outcome) up to where a source's circuit opens: ``limit`` failures in a row, gaps in entitlement and successes reset."""
    w = Window.partitionBy("source").orderBy("seq")
    rows = outcomes.withColumn("_g", F.sum(F.when(F.col("outcome") == "failed", 0).otherwise(1)).over(w))
    island = Window.partitionBy("source", "_g").orderBy("seq")
    rows = rows.withColumn("failures_in_row", F.sum(F.when(F.col("outcome") == "failed", 1).otherwise(0)).over(island))
    opened = F.min(F.when(F.col("failures_in_row") >= limit, F.col("seq"))).over(Window.partitionBy("source"))
    return rows.withColumn("_open", opened).where("_open is null or seq <= _open").drop("_g", "_open")


def prepare_facts(facts: DataFrame) -> DataFrame:
    """Facts of one batch with their key, each fact once; a value that decimal(38,10) would change raises."""
    kind = facts.schema["value"].dataType
    if not (isinstance(kind, T.DecimalType) and (kind.precision, kind.scale) == (38, 10)):
        what = F.concat_ws(" ", "concept", F.lit("of"), F.col("cik").cast("string"), F.lit("ending"), F.col("period_end").cast("string"))
        facts = facts.withColumn("value", fitted(F.col("value"), what))
    return first_wins(facts.withColumn("fact_key", fact_key()), ["fact_key"], "filed_at", "retrieved_at")


def prepare_payloads(payloads: DataFrame) -> DataFrame:
    """Binary files (path, content) as rows of the payload ledger: name by content hash, folders by its first bytes."""
    sha = F.sha2("content", 256)
    place = F.concat_ws("/", F.substring(sha, 1, 2), F.substring(sha, 3, 2), F.concat(sha, F.lit(".json.gz")))
    return payloads.select("path", sha.alias("content_sha256"), F.octet_length("content").cast("long").alias("byte_len"), place.alias("stored_path"))


def open_shared(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path that all tasks see, and the path in it."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))


def write_payloads(payloads: DataFrame, folder: str) -> DataFrame:
    """Store the contents of binary files (path, content), packed, below ``folder`` under their hashes; the rows of :func:`prepare_payloads`.

    A content that is there already is not written again; a file appears under its name only when it is whole, so attempts
    that fail or run twice do no harm.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place, content in zip(batch.column("stored_path"), batch.column("content")):
                system, path = open_shared(f"{folder}/{place.as_py()}")
                if system.get_file_info(path).type == fs.FileType.NotFound:
                    part = f"{path}.{uuid.uuid4().hex}.part"
                    system.create_dir(path.rpartition("/")[0], recursive=True)
                    with system.open_output_stream(part, compression=None) as out:
                        out.write(gzip.compress(content.as_py(), mtime=0))
                    system.move(part, path)
            yield batch.drop_columns(["content"])

    sha = F.sha2("content", 256)
    place = F.concat_ws("/", F.substring(sha, 1, 2), F.substring(sha, 3, 2), F.concat(sha, F.lit(".json.gz")))
    rows = payloads.select("path", sha.alias("content_sha256"), F.octet_length("content").cast("long").alias("byte_len"), place.alias("stored_path"), "content")
    return rows.mapInArrow(write, "path string, content_sha256 string, byte_len bigint, stored_path string")


def verify_payloads(ledger: DataFrame, folder: str) -> DataFrame:
    """The rows (content_sha256, stored_path) of the ledger whose stored content is missing or another one, with the reason."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reasons = []
            for sha, place in zip(batch.column("content_sha256"), batch.column("stored_path")):
                system, path = open_shared(f"{folder}/{place.as_py()}")
                if system.get_file_info(path).type == fs.FileType.NotFound:
                    reasons.append("missing")
                    continue
                try:
                    with system.open_input_stream(path, compression=None) as f:
                        content = gzip.decompress(f.read())
                    reasons.append(None if hashlib.sha256(content).hexdigest() == sha.as_py() else "another content")
                except (OSError, EOFError, zlib.error):
                    reasons.append("unreadable")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(reasons, pa.string())], ["content_sha256", "stored_path", "reason"])

    rows = ledger.select("content_sha256", "stored_path").distinct()
    return rows.mapInArrow(check, "content_sha256 string, stored_path string, reason string").where("reason is not null")


def stored_payloads(spark: SparkSession, folder: str) -> DataFrame:
    """What lies below ``folder`` as (stored_path, stored_bytes), from listings alone: no content is read. Files without a byte are not listed."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    system = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(at):
        return spark.createDataFrame([], "stored_path string, stored_bytes long")
    root = re.sub(r"^([a-z0-9]+):/+", r"\1:/", system.makeQualified(at).toString()).rstrip("/")
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length")
    own = F.regexp_replace("path", r"^([a-z0-9]+):/+", "$1:/")
    return listed.select(F.substring(own, len(root) + 2, 1 << 30).alias("stored_path"), F.col("length").alias("stored_bytes"))


def payload_differences(ledger: DataFrame, stored: DataFrame) -> DataFrame:
    """Where ledger (stored_path) and store (stored_path, stored_bytes) differ: (stored_path, difference), both ways.

    missing: in the ledger only; not indexed: stored only; unfinished: what a broken write left. Several entries of one content are one place.
    """
    known = ledger.groupBy(F.col("stored_path").alias("_p")).agg(F.lit(True).alias("_known"))
    both = stored.join(known, F.col("stored_path") == F.col("_p"), "full_outer")
    difference = F.when(F.col("stored_path").isNull(), "missing").when(F.col("stored_path").endswith(".part"), "unfinished").when(F.col("_known").isNull(), "not indexed")
    return both.select(F.coalesce("stored_path", "_p").alias("stored_path"), difference.alias("difference")).where("difference is not null")


def payload_coverage(ledger: DataFrame, stored: DataFrame) -> DataFrame:
    """One row: indexed places, stored files, their bytes, and how many of each difference there are."""
    counts = payload_differences(ledger, stored).agg(*[F.count_if(F.col("difference") == d).alias(n) for d, n in (("missing", "missing"), ("not indexed", "not_indexed"), ("unfinished", "unfinished"))])
    # Single rows, side by side.
    one = F.lit(1).alias("_one")
    sizes = stored.agg(F.count("*").alias("on_disk"), F.coalesce(F.sum("stored_bytes"), F.lit(0)).alias("stored_bytes"), one)
    return ledger.agg(F.countDistinct("stored_path").alias("indexed"), one).join(sizes, "_one").join(counts.withColumn("_one", F.lit(1)), "_one").drop("_one")


@dataclass(frozen=True)
class Commit:
    """A segment of a table that counts; its name, a marker file, holds all there is to know."""

    number: int
    kind: str
    buckets: int
    checksum: str
    segment: str

    @property
    def name(self) -> str:
        return f"{self.number:010d}-{self.kind}-{self.buckets}-{self.checksum}-{self.segment}"

    @staticmethod
    def of(name: str) -> Commit:
        number, kind, buckets, checksum, segment = name.split("-")
        return Commit(int(number), kind, int(buckets), checksum, segment)


@dataclass(frozen=True)
class Warehouse:
    """Tables as logs of Parquet segments under ``root``: a base and the deltas written since.

    A segment is a folder of partitions, one for each bucket of the hash of a row's key. A write adds a segment of its own rows and
    then its commit, an empty marker file, so a crash leaves nothing that counts, and a day's write is as large as the day. It reads
    the buckets that its keys fall into, not the table. Rows that change (``schemas.CHANGING``) are written anew; reading takes each
    key's row of the last segment. :meth:`compact` makes one base of all segments; the base before it and its deltas stay
    for those who still read them. One writer at a time.

    Opening for writing brings older tables to the current schemas, step by step (``migrations``); opening for reading refuses a
    warehouse that lacks a step. Both refuse steps that were edited after they had been applied. ``buckets`` is for
    tables without a base; as rows grow, ``compact(table, buckets)`` deals them out anew.
    """

    spark: SparkSession
    root: str
    read_only: bool = False
    buckets: int = 16
    migrations: tuple[schemas.Migration, ...] = schemas.MIGRATIONS

    def __post_init__(self) -> None:
        pending = self._pending()
        if self.read_only and pending:
            raise ValueError(f"{self.root} lacks the steps {', '.join(m.name for m in pending)}; open it for writing once")
        if pending:
            self.migrate()

    # Files

    def _at(self, path: str):
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        at, system = self._at(f"{self.root}/{folder}")
        return sorted(f.getPath().getName() for f in system.listStatus(at)) if system.exists(at) else []

    def _touch(self, path: str) -> None:
        at, system = self._at(f"{self.root}/{path}")
        system.create(at, False).close()

    def _delete(self, path: str) -> None:
        at, system = self._at(f"{self.root}/{path}")
        system.delete(at, True)

    def _writable(self) -> None:
        if self.read_only:
            raise PermissionError(f"{self.root} was opened for reading")

    # Schema steps

    def _pending(self) -> list[schemas.Migration]:
        """Steps that were not applied yet; raises if one that was has changed since."""
        applied = {int(n.split("-")[0]): n.split("-")[1] for n in self._names("_migrations")}
        for m in self.migrations:
            if applied.get(m.number, m.checksum) != m.checksum:
                raise ValueError(f"step {m.number} ({m.name}) was edited after it had been applied to {self.root}; add another step instead")
        return [m for m in self.migrations if m.number not in applied]

    def migrate(self) -> list[str]:
        """Apply the steps that are pending, in order; their names. Each table that a step remakes gets a new base; a step counts when
        all its tables are there, so one that was interrupted is applied again, to the bases it left."""
        self._writable()
        done = []
        for m in sorted(self._pending(), key=lambda m: m.number):
            tables = {t: self._merged(t, self._segments(t)) for t in schemas.DDL if self._segments(t)}
            for table, query in m.tables.items():
                if all(f"{{{t}}}" not in query or t in tables for t in schemas.DDL):
                    rows = self.spark.sql(query, **{t: df for t, df in tables.items() if f"{{{t}}}" in query})
                    fields = set(rows.columns) >= {f.name for f in schemas.schema(table)}
                    rows = schemas.conform(rows, table) if fields else rows
                    self._write(table, "base", rows, checksum=schemas.checksum(table)[:16] if fields else m.checksum)
            self._touch(f"_migrations/{m.number:03d}-{m.checksum}")
            done.append(m.name)
        return done

    # Segments

    def _commits(self, table: str) -> list[Commit]:
        return [Commit.of(n) for n in self._names(f"_commits/{table}")]

    def _versions(self, table: str) -> list[Commit]:
        """The table's bases that are still there, oldest first."""
        return [c for c in self._commits(table) if c.kind == "base"]

    def _segments(self, table: str) -> list[Commit]:
        """What the table consists of now: the last base and its deltas."""
        commits = self._commits(table)
        bases = [k for k, c in enumerate(commits) if c.kind == "base"]
        return commits[bases[-1] :] if bases else commits

    def _bucket(self, table: str, buckets: int) -> Column:
        kinds = {f.name: f.dataType for f in schemas.schema(table)}
        return F.pmod(F.xxhash64(*[F.col(k).cast(kinds[k]) for k in schemas.KEYS[table]]), F.lit(buckets)).cast("int")

    def _write(self, table: str, kind: str, rows: DataFrame, buckets: int | None = None, checksum: str | None = None) -> int:
        """Add a segment; the number of its rows. Nothing is added for a delta without rows. Large buckets are split into files by Spark."""
        live = self._commits(table)
        buckets = buckets or (live[-1].buckets if live else self.buckets)
        commit = Commit(live[-1].number + 1 if live else 1, kind if live else "base", buckets, checksum or schemas.checksum(table)[:16], uuid.uuid4().hex[:12])
        path = f"{self.root}/{table}/segment={commit.segment}"
        dealt = rows.withColumn("bucket", self._bucket(table, buckets)).hint("rebalance", F.col("bucket"))
        dealt.write.partitionBy("bucket").parquet(path)
        n = self.spark.read.schema(rows.schema).parquet(path).count()
        if n or kind == "base":
            self._touch(f"_commits/{table}/{commit.name}")
        else:
            self._delete(f"{table}/segment={commit.segment}")
        return n

    def _scan(self, table: str, segments: list[Commit], fields: T.StructType | None = None) -> DataFrame:
        """Their rows with segment and bucket, by which files are left out before they are opened."""
        base = f"{self.root}/{table}"
        reader = self.spark.read.option("basePath", base)
        if fields is not None:
            reader = reader.schema(T.StructType([*fields, T.StructField("segment", T.StringType()), T.StructField("bucket", T.IntegerType())]))
        return reader.parquet(*[f"{base}/segment={c.segment}" for c in segments])

    def _merged(self, table: str, segments: list[Commit], fields: T.StructType | None = None, touched: list[int] | None = None) -> DataFrame:
        """The table made of these segments, or its rows in the buckets ``touched``."""
        rows = self._scan(table, segments, fields)
        if touched is not None:
            rows = rows.where(F.col("bucket").isin(touched))
        if table in schemas.CHANGING and len(segments) > 1:
            age = F.lit(None).cast("int")
            for k, c in enumerate(segments):
                age = F.when(F.col("segment") == c.segment, k).otherwise(age)
            last = Window.partitionBy(*schemas.KEYS[table]).orderBy(age.desc())
            rows = rows.withColumn("_r", F.row_number().over(last)).where("_r = 1").drop("_r")
        return rows.drop("segment", "bucket")

    def _all(self, table: str, touched: list[int] | None = None) -> DataFrame:
        segments = self._segments(table)
        fields = schemas.schema(table)
        if not segments:
            return self.spark.createDataFrame([], fields)
        if {c.checksum for c in segments} != {schemas.checksum(table)[:16]}:
            raise ValueError(f"{table} was written with another schema")
        return self._merged(table, segments, fields, touched)

    def _touched(self, table: str, batch: DataFrame) -> list[int] | None:
        """The buckets of the batch's keys; None for an empty table."""
        segments = self._segments(table)
        if not segments:
            return None
        return sorted(r[0] for r in batch.select(self._bucket(table, segments[-1].buckets)).distinct().collect())

    # Tables

    def read(self, table: str) -> DataFrame:
        rows, state = self._all(table), schemas.LOGS.get(table)
        if state is None:
            return rows
        latest = Window.partitionBy(*schemas.KEYS[table]).orderBy(F.col(state).desc_nulls_last())
        return rows.withColumn("_r", F.row_number().over(latest)).where("_r = 1").drop("_r")

    def read_matching(self, table: str, keys: DataFrame) -> DataFrame:
        """The rows whose keys are among ``keys``, from those buckets only."""
        names = schemas.KEYS[table]
        return self._all(table, self._touched(table, keys)).join(keys.select(*names).distinct(), names, "left_semi")

    def count(self, table: str) -> int:
        if table not in schemas.DDL:
            raise ValueError(f"no table {table}")
        return self.read(table).count()

    def append(self, table: str, rows: DataFrame) -> int:
        """Add rows as they are: states of a log, or rows whose keys are known to be new."""
        self._writable()
        return self._write(table, "delta", schemas.conform(rows, table))

    def insert(self, table: str, batch: DataFrame, *order: str) -> int:
        """Append the batch's rows with new keys, the first of equal keys; the number of them. Known keys are looked for in the batch's buckets."""
        self._writable()
        keys = schemas.KEYS[table]
        rows = schemas.conform(batch, table)
        known = self._all(table, self._touched(table, rows))
        return self._write(table, "delta", absent(first_wins(rows, keys, *(order or keys)), known, keys))

    def merge(self, table: str, batch: DataFrame, combine: Callable[[DataFrame, DataFrame], DataFrame]) -> int:
        """Write what ``combine`` makes of the table's rows with the batch's keys and of the batch; the number of new keys.

        Only for tables that are read by last row. Rows that stay as they are are not written again.
        """
        self._writable()
        if table not in schemas.CHANGING:
            raise ValueError(f"rows of {table} do not change")
        with staged(self.read_matching(table, batch)) as old:
            new = schemas.conform(combine(old, batch), table)
            with staged(new.exceptAll(schemas.conform(old, table))) as changed:
                n = absent(changed, old, schemas.KEYS[table]).count()
                self._write(table, "delta", changed)
        return n

    def replace(self, table: str, rows: DataFrame, buckets: int | None = None) -> None:
        """Write a new base, then make it count. ``rows`` may come from the table itself. What came before the last base is deleted."""
        self._writable()
        before = self._commits(table)
        keep = self._segments(table)
        self._write(table, "base", schemas.conform(rows, table), buckets)
        for c in before[: len(before) - len(keep)]:
            self._delete(f"_commits/{table}/{c.name}")
            self._delete(f"{table}/segment={c.segment}")

    def compact(self, table: str, buckets: int | None = None) -> None:
        """One base of all segments, with another number of buckets if given."""
        self.replace(table, self._all(table), buckets)
