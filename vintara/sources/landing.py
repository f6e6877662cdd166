"""Landing files to typed rows: tickers, submissions, facts, daily index, macro vintages, bars, delistings.

Every reader has an explicit schema. Rows that cannot be used are not dropped silently: readers return rows and rejects,
the latter with a reason, so that counts can be reported. A file whose shape is not the agreed one raises at execution, or,
with ``strict=False``, is one reject, so that it does not abort the batch that it is in.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vintara.functions import scalars as s

TAXONOMIES = ("us-gaap", "ifrs-full", "dei")
_ENTRY = "STRUCT<start: STRING, end: STRING, val: STRING, accn: STRING, fy: INT, fp: STRING, form: STRING, filed: STRING, frame: STRING>"
#: Most rows of one answer; a longer one has been cut off by the source.
MOST_OBSERVATIONS = 100_000


class Parsed(NamedTuple):
    """Usable rows, and rejects as (source_uri, reason)."""

    rows: DataFrame
    rejects: DataFrame

    def skip_counts(self) -> DataFrame:
        return self.rejects.groupBy("reason").agg(F.count("*").alias("n"))


def documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as (source_uri, body, content_sha256)."""
    raw = spark.read.format("binaryFile").load(path)
    return raw.select(F.col("path").alias("source_uri"), F.decode("content", "UTF-8").alias("body"), F.sha2("content", 256).alias("content_sha256"))


def _shaped(docs: DataFrame, ddl: str, required: str) -> DataFrame:
    """Bodies parsed as ``ddl``; a body without the required field raises."""
    return _good(_parsed(docs, ddl), F.col(f"json.{required}").isNotNull(), "unexpected shape")


def _once(rows: DataFrame, made: Column, name: str) -> DataFrame:
    """``rows`` with a column that is made once a row. No filter passes a generator, so filters on the column do not make it again."""
    return rows.select("*", F.explode(F.array(made)).alias(name))


def _parsed(docs: DataFrame, ddl: str) -> DataFrame:
    return _once(docs, F.from_json("body", ddl), "json")


def _good(parsed: DataFrame, fine: Column, reason: str, strict: bool = True, kept: str = "json") -> DataFrame:
    """The rows that are fine; the others raise or, where they are rejected elsewhere, are left out.

    What is read on is the checked column ``kept``, made anew: a filter that Spark derives from a later explode cannot drop a row before it raises.
    """
    if not strict:
        return parsed.where(F.coalesce(fine, F.lit(False)))
    wrong = F.concat(F.lit(f"{reason} in "), F.col("source_uri"))
    checked = F.when(fine, F.col(kept)).otherwise(F.raise_error(wrong))
    return _once(parsed, checked, "_checked").drop(kept).withColumnRenamed("_checked", kept)


def _bad(parsed: DataFrame, fine: Column, reason: str) -> DataFrame:
    return parsed.where(~F.coalesce(fine, F.lit(False))).select("source_uri", F.lit(reason).alias("reason"))


def _with_rejects(parsed: Parsed, *rejects: DataFrame) -> Parsed:
    return Parsed(parsed.rows, reduce(DataFrame.unionByName, rejects, parsed.rejects))


def _split(tagged: DataFrame, columns: list[str]) -> Parsed:
    """Rows without a reason, and the others' reasons; what is parsed to find a reason is not parsed again for the row."""
    made = _once(tagged, F.struct(*tagged.columns), "_row").select("_row.*")
    return Parsed(made.where("reason is null").select("source_uri", *[c for c in columns if c != "source_uri"]), made.where("reason is not null").select("source_uri", "reason"))


def company_tickers(docs: DataFrame, observed_at: str, strict: bool = True) -> Parsed:
    """An object of numbered entries {cik_str, ticker, title}; tickers are trimmed and upper-cased, empty ones rejected."""
    entry = "MAP<STRING, STRUCT<cik_str: BIGINT, ticker: STRING, title: STRING>>"
    parsed, fine = _parsed(docs, entry), F.size("json") > 0
    rows = _good(parsed, fine, "unexpected shape", strict).select("source_uri", F.explode("json").alias("k", "e")).select(
        "source_uri", F.col("e.cik_str").alias("cik"), F.upper(F.trim("e.ticker")).alias("ticker"), F.col("e.title").alias("name"), F.lit(observed_at).cast("date").alias("observed_at")
    )
    reason = F.when(F.coalesce(F.col("ticker"), F.lit("")) == "", "no ticker").when(~((F.col("cik") > 0) & (F.col("cik") < 10**10)), "bad cik")
    out = _split(rows.withColumn("reason", reason), ["cik", "ticker", "name", "observed_at"])
    return out if strict else _with_rejects(out, _bad(parsed, fine, "unexpected shape"))


_ARRAYS = ["accessionNumber", "filingDate", "reportDate", "acceptanceDateTime", "form", "items", "isXBRL", "primaryDocument"]


def submissions(docs: DataFrame, history: DataFrame | None = None, strict: bool = True) -> Parsed:
    """Parallel arrays of recent filings, and history files with the same arrays at their top, to one row per filing.

    Arrays of unequal length raise (or are one reject): their rows cannot be told apart. An array that the file does not
    have is a column of absent values.
    """
    arrays = ", ".join(f"{n}: ARRAY<{'INT' if n == 'isXBRL' else 'STRING'}>" for n in _ARRAYS)
    recent = _parsed(docs, f"STRUCT<cik: STRING, filings: STRUCT<recent: STRUCT<{arrays}>>>")
    parts = recent.select("source_uri", F.col("json.cik").cast("bigint").alias("cik"), F.col("json.filings.recent").alias("a"))
    if history is not None:
        older = _good(_parsed(history, f"STRUCT<{arrays}>"), F.col("json.accessionNumber").isNotNull(), "unexpected shape", strict)
        number = F.regexp_extract("source_uri", r"CIK(\d{10})", 1).cast("bigint")
        parts = parts.unionByName(older.select("source_uri", number.alias("cik"), F.col("json").alias("a")))
    even = F.lit(True)
    for n in _ARRAYS[1:]:
        even = even & (F.col(f"a.{n}").isNull() | (F.size(f"a.{n}") == F.size("a.accessionNumber")))
    shaped = F.col("a").isNotNull()
    rejects = [_bad(parts, shaped, "unexpected shape"), _bad(parts.where(shaped), even, "arrays of unequal length")]
    parts = _good(_good(parts, shaped, "unexpected shape", strict, "a"), even, "arrays of unequal length", strict, "a")
    absent = lambda n: F.array_repeat(F.lit(None).cast("int" if n == "isXBRL" else "string"), F.size("a.accessionNumber"))
    zipped = F.explode(F.arrays_zip(*[F.coalesce(F.col(f"a.{n}"), absent(n)).alias(n) for n in _ARRAYS])).alias("f")
    rows = parts.select("source_uri", "cik", zipped).select(
        "source_uri", s.dashed_accession(F.col("f.accessionNumber")).alias("accn"), "cik", F.col("f.form").alias("form"),
        s.parse_date(F.col("f.filingDate")).alias("filed_at"), s.parse_instant(F.col("f.acceptanceDateTime")).alias("accepted_at"),
        s.parse_date(F.col("f.reportDate")).alias("period_of_report"), F.nullif(F.col("f.primaryDocument"), F.lit("")).alias("primary_document"),
        s.parse_items(F.col("f.items")).alias("items"), (F.col("f.isXBRL") == 1).alias("is_xbrl"),
    )
    reason = F.when(F.col("accn").isNull(), "bad accession").when(F.col("filed_at").isNull(), "no filing date")
    out = _split(rows.withColumn("reason", reason), ["accn", "cik", "form", "filed_at", "accepted_at", "period_of_report", "primary_document", "items", "is_xbrl"])
    return out if strict else _with_rejects(out, *rejects)


def entities(docs: DataFrame, observed_at: str) -> Parsed:
    """The companies that submissions files describe; empty texts are absent."""
    fields = {"entityType": "entity_type", "sic": "sic", "sicDescription": "sic_description", "fiscalYearEnd": "fiscal_year_end", "stateOfIncorporation": "state_of_incorp"}
    parsed = _parsed(docs, f"STRUCT<cik: STRING, name: STRING, {', '.join(f'{f}: STRING' for f in fields)}>")
    day = F.lit(observed_at).cast("date")
    rows = parsed.select(
        "source_uri", F.col("json.cik").try_cast("bigint").alias("cik"), F.nullif(F.trim("json.name"), F.lit("")).alias("name"),
        *[F.nullif(F.trim(f"json.{f}"), F.lit("")).alias(c) for f, c in fields.items()], day.alias("first_observed"), day.alias("last_observed"),
    )
    reason = F.when(F.col("cik").isNull() | (F.col("cik") <= 0), "bad cik").when(F.col("name").isNull(), "no name")
    return _split(rows.withColumn("reason", reason), [c for c in rows.columns if c != "source_uri"])


def _fact_rows(entries: DataFrame) -> Parsed:
    """(source_uri, cik, taxonomy, concept, unit, e) to facts. Values stay texts until they are decimals: no double touches them."""
    e = F.col("e")
    rows = entries.select(
        "source_uri", "cik", "taxonomy", "concept", "unit", s.parse_date(e["start"]).alias("period_start"), s.parse_date(e["end"]).alias("period_end"),
        s.parse_decimal(e["val"]).alias("value"), s.dashed_accession(e["accn"]).alias("accn"), e["form"].alias("form"), s.parse_date(e["filed"]).alias("filed_at"),
        e["fy"].alias("fy"), e["fp"].alias("fp"), e["frame"].alias("frame"),
    )
    reason = F.when(F.col("period_end").isNull(), "no period end").when(F.col("value").isNull(), "no exact value").when(F.col("accn").isNull(), "bad accession").when(F.col("filed_at").isNull(), "no filing date")
    return _split(rows.withColumn("reason", reason), [c for c in rows.columns if c != "source_uri"])


def _quoted_values(docs: DataFrame) -> DataFrame:
    """Numbers of ``val`` as texts: the JSON parser would make doubles of those with a fraction."""
    return docs.withColumn("body", F.regexp_replace("body", r'("val"\s*:\s*)(-?[0-9][0-9.eE+-]*)', '$1"$2"'))


def company_facts(docs: DataFrame, taxonomies: tuple[str, ...] = TAXONOMIES, strict: bool = True) -> Parsed:
    """The tree taxonomy, concept, unit, entries. Taxonomies that are out of scope and concepts without units are rejects, one each."""
    tree, fine = _parsed(_quoted_values(docs), f"STRUCT<cik: BIGINT, facts: MAP<STRING, MAP<STRING, STRUCT<units: MAP<STRING, ARRAY<{_ENTRY}>>>>>>"), F.col("json.facts").isNotNull()
    of = _good(tree, fine, "unexpected shape", strict).select("source_uri", F.col("json.cik").alias("cik"), F.explode("json.facts").alias("taxonomy", "c"))
    in_scope = F.col("taxonomy").isin(list(taxonomies))
    rejects = [of.where(~in_scope).select("source_uri", F.concat(F.lit("taxonomy out of scope: "), F.col("taxonomy")).alias("reason"))]
    concepts = of.where(in_scope).select("source_uri", "cik", "taxonomy", F.explode("c").alias("concept", "u"))
    rejects.append(_bad(concepts, F.col("u.units").isNotNull(), "concept without units"))
    rows = concepts.select("*", F.explode("u.units").alias("unit", "list"))
    out = _fact_rows(rows.select("source_uri", "cik", "taxonomy", "concept", "unit", F.explode("list").alias("e")))
    return _with_rejects(out, *rejects, *([] if strict else [_bad(tree, fine, "unexpected shape")]))


def company_concept(docs: DataFrame) -> Parsed:
    """One concept's history."""
    one = _shaped(_quoted_values(docs), f"STRUCT<cik: BIGINT, taxonomy: STRING, tag: STRING, units: MAP<STRING, ARRAY<{_ENTRY}>>>", "units")
    rows = one.select("source_uri", "json.cik", "json.taxonomy", F.col("json.tag").alias("concept"), F.explode("json.units").alias("unit", "list"))
    return _fact_rows(rows.select("source_uri", "cik", "taxonomy", "concept", "unit", F.explode("list").alias("e")))


#: A quote sign is a character like any other: names begin with one.
INDEX_FORMAT = {"sep": "|", "encoding": "ISO-8859-1", "quote": "", "mode": "PERMISSIVE"}
INDEX_LINE = "cik STRING, name STRING, form STRING, filed STRING, file STRING, more STRING"


def index_lines(lines: DataFrame, day: Column) -> Parsed:
    """Lines of five fields with a number first; lines without a number first are heading, others that cannot be used are rejects."""
    rows = lines.where(F.col("cik").rlike(r"^\d+$")).select(
        F.col("_metadata.file_path").alias("source_uri"), s.dashed_accession(s.path_stem(F.col("file"))).alias("accn"), F.col("cik").cast("bigint").alias("cik"), "name", "form",
        F.coalesce(s.parse_date(F.col("filed")), s.parse_compact_date(F.col("filed"))).alias("filed_at"), day.alias("disseminated_at"),
        (F.col("file").isNull() | F.col("more").isNotNull()).alias("odd"),
    )
    reason = F.when(F.col("odd"), "not five fields").when(F.col("accn").isNull(), "bad accession").when(F.col("filed_at").isNull(), "no filing date")
    return _split(rows.withColumn("reason", reason), ["accn", "cik", "name", "form", "filed_at", "disseminated_at"])


def daily_index_parsed(spark: SparkSession, path: str, day: str) -> Parsed:
    """A day's index, in Latin-1."""
    return index_lines(spark.read.options(**INDEX_FORMAT).schema(INDEX_LINE).csv(path), F.lit(day).cast("date"))


def daily_index(spark: SparkSession, path: str, day: str) -> DataFrame:
    """The usable rows of a day's index."""
    return daily_index_parsed(spark, path, day).rows.drop("source_uri")


def quarter_of(day: Column) -> Column:
    """The quarter (1 to 4) under which an archive keeps a day's index."""
    return F.quarter(day)


def vintage_dates(docs: DataFrame) -> Parsed:
    """An archive's list of vintage dates, ascending and each once; dates that do not exist are rejects."""
    listed = _shaped(docs, "STRUCT<count: BIGINT, vintage_dates: ARRAY<STRING>>", "vintage_dates")
    cut = F.coalesce(F.col("json.count"), F.size("json.vintage_dates").cast("bigint")) <= F.size("json.vintage_dates")
    rows = _good(listed, cut, "cut off at the source").select("source_uri", F.explode("json.vintage_dates").alias("text"))
    rows = rows.select("source_uri", s.parse_date(F.col("text")).alias("vintage_date"))
    out = _split(rows.withColumn("reason", F.when(F.col("vintage_date").isNull(), "bad date")), ["vintage_date"])
    return Parsed(out.rows.groupBy("vintage_date").agg(F.min("source_uri").alias("source_uri")).select("source_uri", "vintage_date").orderBy("vintage_date"), out.rejects)


def macro_observations(docs: DataFrame, series_id: str, strict: bool = True) -> Parsed:
    """Observations with their real-time span; '.', empty and null values are kept as absent."""
    tree, fine = _parsed(docs, "STRUCT<count: BIGINT, observations: ARRAY<STRUCT<date: STRING, realtime_start: STRING, realtime_end: STRING, value: STRING>>>"), F.col("json.observations").isNotNull()
    whole = (F.size("json.observations") < MOST_OBSERVATIONS) & (F.coalesce(F.col("json.count"), F.size("json.observations").cast("bigint")) <= F.size("json.observations"))
    shaped = _good(tree, fine, "unexpected shape", strict)
    rows = _good(shaped, whole, "cut off at the source", strict)
    wrong = [] if strict else [_bad(tree, fine, "unexpected shape"), _bad(tree.where(fine), whole, "cut off at the source")]
    o = F.col("o")
    rows = rows.select("source_uri", F.explode("json.observations").alias("o")).select(
        "source_uri", F.lit(series_id).alias("series_id"), s.parse_date(o["date"]).alias("obs_date"), s.parse_date(o["realtime_start"]).alias("realtime_start"), s.parse_date(o["realtime_end"]).alias("realtime_end"),
        F.when(~o["value"].isin("", "."), o["value"].try_cast("double")).alias("value"), (~o["value"].isin("", ".") & o["value"].try_cast("double").isNull()).alias("odd"),
    )
    reason = F.when(F.col("obs_date").isNull() | F.col("realtime_start").isNull() | F.col("realtime_end").isNull(), "bad date").when(F.col("odd"), "bad value")
    return _with_rejects(_split(rows.withColumn("reason", reason), ["series_id", "obs_date", "realtime_start", "realtime_end", "value"]), *wrong)


def union_windows(windows: Parsed, vintages: DataFrame | None = None) -> Parsed:
    """Observations of several archive windows as if they had come in one.

    An archive clips each value's span to the window that was asked for, so a value that was in force over a border comes in parts.
    Spans of an observation that follow each other with the same value become one span. A span that begins before the one before it
    has ended is a reject, unless it repeats its value, and so is, given the archive's ``vintages`` (vintage_date), a border with
    vintages that neither side covers: its two spans stay apart. One shuffle by observation.
    """
    rows = windows.rows
    own = Window.partitionBy("series_id", "obs_date").orderBy("realtime_start", "realtime_end", "source_uri")
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    last = F.last("value").over(before)
    again = F.count("*").over(before).cast("int") > 0
    same = again & last.eqNullSafe(F.col("value"))
    rows = rows.withColumns({"_until": F.max("realtime_end").over(before), "_same": same})
    overlap = F.coalesce(F.col("realtime_start") <= F.col("_until"), F.lit(False)) & ~F.col("_same")
    gap = F.lit(False)
    if vintages is not None:
        # A list of days, as long as the calendar at most.
        days = F.array(*[F.lit(r[0]) for r in vintages.select("vintage_date").distinct().orderBy("vintage_date").collect()]).cast("array<date>")
        gap = F.coalesce((F.datediff("realtime_start", "_until") > 1) & F.exists(days, lambda v: (v > F.col("_until")) & (v < F.col("realtime_start"))), F.lit(False))
    rows = rows.withColumns({"_overlap": overlap, "_gap": gap})
    rejects = rows.where("_overlap or _gap").select("source_uri", F.when(F.col("_overlap"), "windows overlap").otherwise("gap between windows").alias("reason"))
    fresh = rows.where("not _overlap")
    change = F.when(F.coalesce(F.lag("value").over(own).eqNullSafe(F.col("value")), F.lit(False)) & (F.row_number().over(own) > 1) & ~F.col("_gap"), 0).otherwise(1)
    fresh = fresh.withColumn("_c", change).withColumn("_run", F.sum("_c").over(own))
    merged = fresh.groupBy("series_id", "obs_date", "_run").agg(
        F.min_by("source_uri", "realtime_start").alias("source_uri"), F.min("realtime_start").alias("realtime_start"), F.max("realtime_end").alias("realtime_end"), F.first("value").alias("value")
    )
    return Parsed(merged.select("source_uri", "series_id", "obs_date", "realtime_start", "realtime_end", "value"), windows.rejects.unionByName(rejects))


def vintage_windows(vintages: list[str], most: int = 2000, size: int = 1500) -> list[list[str]]:
    """An archive's vintage dates in windows that one request may ask for."""
    return [vintages] if len(vintages) <= most else [vintages[k : k + size] for k in range(0, len(vintages), size)]


def daily_bars(raw: DataFrame, adjusted: DataFrame, symbol: str, source: str, strict: bool = True) -> Parsed:
    """As-traded bars with the adjusted close of the same day; impossible bars are rejected, an object as body raises."""
    bars = "ARRAY<STRUCT<date: STRING, open: DOUBLE, high: DOUBLE, low: DOUBLE, close: DOUBLE, volume: DOUBLE>>"
    is_list = F.ltrim("body").startswith("[")
    listed = lambda docs, ddl: _good(docs, is_list, "no list of bars", strict, "body").select("source_uri", F.explode(F.from_json("body", ddl)).alias("b"))
    wrong = [] if strict else [_bad(d, is_list, "no list of bars") for d in (raw, adjusted)]
    a = listed(adjusted, "ARRAY<STRUCT<date: STRING, adjClose: DOUBLE>>").select(F.col("b.date").alias("_d"), F.col("b.adjClose").alias("adj_close")).dropDuplicates(["_d"])
    rows = listed(raw, bars).select("source_uri", "b.*").join(a, F.col("date") == F.col("_d"), "left")
    rows = rows.select("source_uri", F.lit(symbol).alias("symbol"), s.parse_date(F.col("date")).alias("bar_date"), "open", "high", "low", "close", "adj_close", "volume", F.lit(source).alias("source"))
    fine = (F.col("low") > 0) & (F.col("high") >= F.greatest("open", "close", "low")) & (F.col("low") <= F.least("open", "close")) & (F.col("volume") >= 0)
    reason = F.when(F.col("bar_date").isNull(), "bad date").when(~F.coalesce(fine, F.lit(False)), "impossible bar")
    return _with_rejects(_split(rows.withColumn("reason", reason), [c for c in rows.columns if c != "source_uri"]), *wrong)


def delisted(docs: DataFrame, observed_at: str, source: str, strict: bool = True) -> Parsed:
    """A list of delisted symbols; entries without a symbol are rejects, a body that is no list raises."""
    is_list = F.ltrim("body").startswith("[")
    wrong = [] if strict else [_bad(docs, is_list, "no list of symbols")]
    rows = _good(docs, is_list, "no list of symbols", strict, "body").select("source_uri", F.explode(F.from_json("body", "ARRAY<STRUCT<symbol: STRING, exchange: STRING, companyName: STRING, ipoDate: STRING, delistedDate: STRING>>")).alias("d"))
    rows = rows.select(
        "source_uri", F.nullif(F.trim("d.symbol"), F.lit("")).alias("symbol"), F.col("d.exchange").alias("exchange"), F.col("d.companyName").alias("company_name"),
        s.parse_date(F.col("d.ipoDate")).alias("ipo_date"), s.parse_date(F.col("d.delistedDate")).alias("delisted_date"), F.lit(observed_at).cast("date").alias("observed_at"), F.lit(source).alias("source"),
    )
    return _with_rejects(_split(rows.withColumn("reason", F.when(F.col("symbol").isNull(), "no symbol")), [c for c in rows.columns if c != "source_uri"]), *wrong)


def sampled_universe(frames: DataFrame, floor: int, size: int, seed: int) -> DataFrame:
    """``size`` companies with a value of at least ``floor``: the smallest digests of seed and number, the same on every run."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("cik").cast("string")), 256)
    return frames.where(F.col("val") >= floor).select("cik").distinct().orderBy(digest, "cik").limit(size).orderBy("cik")
