"""The readers of landed files over documents that Spark makes of whole tables: what is written as JSON has to come back as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vintara.functions import scalars
from vintara.operators import store
from vintara.plans.catalog import query
from vintara.sources import landing
from vintara.sources import projection as p


def _documents(bodies: DataFrame, uri: str, body: Column) -> DataFrame:
    """One document a row: named by column ``uri``, ``body`` as JSON."""
    text = F.to_json(body)
    return bodies.select(F.col(uri).cast("string").alias("source_uri"), text.alias("body"), F.sha2(text, 256).alias("content_sha256"))


def _map(key: str, value: Column) -> Column:
    return F.map_from_entries(F.collect_list(F.struct(F.col(key).cast("string"), value)))


_DASHED = "substr(lpad(accn, 18, '0'), 1, 10) || '-' || substr(lpad(accn, 18, '0'), 11, 2) || '-' || substr(lpad(accn, 18, '0'), 13)"


@query(f"SELECT cik, CASE WHEN taxonomy = 'F' THEN 'us-gaap' ELSE 'dei' END AS taxonomy, concept, unit, period_start, period_end, value, {_DASHED} AS accn, form, filed_at FROM facts", "facts")
def read_company_facts(spark, d):
    """Trees of taxonomy, concept and unit, one for each company; numbers are never doubles. A company's facts meet in one exchange, which all levels of its tree keep."""
    e = F.struct(F.col("period_start").alias("start"), F.col("period_end").alias("end"), F.col("value").alias("val"), F.lpad("accn", 18, "0").alias("accn"), "form", F.col("filed_at").alias("filed"))
    rows = p.facts(spark, d).withColumn("taxonomy", F.when(F.col("taxonomy") == "F", "us-gaap").otherwise("dei")).repartition("cik")
    units = rows.groupBy("cik", "taxonomy", "concept", "unit").agg(F.collect_list(e).alias("list"))
    concepts = units.groupBy("cik", "taxonomy", "concept").agg(_map("unit", F.col("list")).alias("units"))
    taxonomies = concepts.groupBy("cik", "taxonomy").agg(_map("concept", F.struct("units")).alias("concepts"))
    trees = taxonomies.groupBy("cik").agg(_map("taxonomy", F.col("concepts")).alias("facts"))
    found = landing.company_facts(_documents(trees, "cik", F.struct("cik", "facts"))).rows
    return found.select("cik", "taxonomy", "concept", "unit", "period_start", "period_end", "value", "accn", "form", "filed_at")


@query(f"SELECT {_DASHED} AS accn, cik, form, filed_at, period_of_report, array_to_string(items, '|') AS items, form = '10-K' AS is_xbrl FROM filings", "filings")
def read_submissions(spark, d):
    """Parallel arrays, one file for each company."""
    text = lambda c: F.col(c).cast("string")
    row = F.struct(
        F.lpad("accn", 18, "0").alias("accessionNumber"), text("filed_at").alias("filingDate"), text("period_of_report").alias("reportDate"), F.concat(text("filed_at"), F.lit("T10:00:00.000Z")).alias("acceptanceDateTime"),
        "form", F.array_join("items", ", ").alias("items"), (F.col("form") == "10-K").cast("int").alias("isXBRL"), F.lit("").alias("primaryDocument"),
    )
    files = p.filings(spark, d).groupBy("cik").agg(F.collect_list(row).alias("f"))
    arrays = F.struct(*[F.col(f"f.{n}").alias(n) for n in landing._ARRAYS])
    found = landing.submissions(_documents(files, "cik", F.struct(F.col("cik").cast("string").alias("cik"), F.struct(arrays.alias("recent")).alias("filings")))).rows
    return found.select("accn", "cik", "form", "filed_at", "period_of_report", F.array_join("items", "|").alias("items"), "is_xbrl")


_TICKERS = "SELECT DISTINCT cik, CASE WHEN cik % 7 = 3 THEN ' ' ELSE lower(ticker) || ' ' END AS t FROM identifiers"


@query(f"SELECT cik, upper(trim(t)) AS ticker, DATE '2024-01-02' AS observed_at FROM ({_TICKERS}) WHERE trim(t) <> '' AND cik > 0", "identifiers")
def read_tickers(spark, d):
    return _tickers(spark, d).rows.select("cik", "ticker", "observed_at")


@query(f"SELECT CASE WHEN trim(t) = '' THEN 'no ticker' ELSE 'bad cik' END AS reason, count(*) AS n FROM ({_TICKERS}) WHERE trim(t) = '' OR cik <= 0 GROUP BY 1", "identifiers")
def read_ticker_rejects(spark, d):
    return _tickers(spark, d).skip_counts()


def _tickers(spark, d) -> landing.Parsed:
    rows = p.identifiers(spark, d).select("cik", F.when(F.col("cik") % 7 == 3, " ").otherwise(F.concat(F.lower("ticker"), F.lit(" "))).alias("ticker")).distinct()
    entry = F.struct(F.col("cik").alias("cik_str"), "ticker", F.lit("x").alias("title"))
    keyed = rows.select("*", F.concat_ws(":", "cik", "ticker").alias("number"), F.pmod(F.xxhash64("cik"), F.lit(64)).alias("file"))
    files = keyed.groupBy("file").agg(_map("number", entry).alias("m"))
    return landing.company_tickers(_documents(files, "file", F.col("m")), "2024-01-02")


@query("SELECT series_id, obs_date, realtime_start, realtime_start + 5 AS realtime_end, value FROM macro", "macro")
def read_macro_observations(spark, d):
    """One file for each series; a point stands for an absent value."""
    text = lambda c: F.col(c).cast("string")
    o = F.struct(text("obs_date").alias("date"), text("realtime_start").alias("realtime_start"), F.date_add("realtime_start", 5).cast("string").alias("realtime_end"), F.coalesce(text("value"), F.lit(".")).alias("value"))
    files = p.macro(spark, d).groupBy("series_id").agg(F.collect_list(o).alias("observations"))
    found = landing.macro_observations(_documents(files, "series_id", F.struct(F.size("observations").alias("count"), "observations")), "of its file").rows
    return found.select(F.col("source_uri").alias("series_id"), "obs_date", "realtime_start", "realtime_end", "value")


@query("SELECT DISTINCT realtime_start AS vintage_date FROM macro", "macro")
def read_vintage_dates(spark, d):
    files = p.macro(spark, d).groupBy("series_id").agg(F.collect_list(F.col("realtime_start").cast("string")).alias("vintage_dates"))
    return landing.vintage_dates(_documents(files, "series_id", F.struct(F.size("vintage_dates").alias("count"), "vintage_dates"))).rows.select("vintage_date")


@query("""SELECT 'S' || s_suppkey AS symbol, s_name AS company_name, DATE '2000-01-01' + CAST(s_suppkey % 900 AS INTEGER) AS ipo_date,
                 CASE WHEN s_suppkey % 3 = 0 THEN DATE '2020-02-03' END AS delisted_date, DATE '2024-01-02' AS observed_at FROM supplier WHERE s_suppkey % 13 <> 0""")  # fmt: skip
def read_delistings(spark, d):
    """Lists of symbols, one for each nation; those without a symbol are rejects."""
    s = spark.read.parquet(f"{d}/supplier.parquet")
    symbol = F.when(F.col("s_suppkey") % 13 != 0, F.concat(F.lit("S"), F.col("s_suppkey").cast("string"))).otherwise(" ")
    ipo = F.date_add(F.lit("2000-01-01").cast("date"), (F.col("s_suppkey") % 900).cast("int")).cast("string")
    row = F.struct(symbol.alias("symbol"), F.lit("N").alias("exchange"), F.col("s_name").alias("companyName"), ipo.alias("ipoDate"), F.when(F.col("s_suppkey") % 3 == 0, "2020-02-03").otherwise("").alias("delistedDate"))
    files = s.groupBy("s_nationkey").agg(F.collect_list(row).alias("list"))
    found = landing.delisted(_documents(files, "s_nationkey", F.col("list")), "2024-01-02", "v").rows
    return found.select("symbol", "company_name", "ipo_date", "delisted_date", "observed_at")


@query("SELECT DISTINCT 3 * c_custkey AS cik FROM customer WHERE 3 * c_custkey NOT IN (SELECT cik FROM facts)", "facts")
def companies_without_facts(spark, d):
    """Where an interrupted ingest goes on."""
    wanted = spark.read.parquet(f"{d}/customer.parquet").select((3 * F.col("c_custkey")).alias("cik")).distinct()
    return store.absent(wanted, p.facts(spark, d), ["cik"])


@query("""SELECT o_orderkey, CAST(o_orderdate AS DATE) AS compact, CAST(o_orderdate AS DATE) AS instant_day, CAST(o_orderkey || '.' || lpad(CAST(o_custkey % 1000 AS VARCHAR), 3, '0') AS DECIMAL(38,10)) AS exact,
                 CAST(o_orderkey AS VARCHAR) AS stem, greatest(1, CAST(round((o_orderkey % 400) / 30.44) AS INTEGER)) AS months,
                 'https://www.sec.gov/Archives/edgar/data/' || o_custkey || '/' || lpad(CAST(o_orderkey AS VARCHAR), 18, '0') || '/' || substr(lpad(CAST(o_orderkey AS VARCHAR), 18, '0'), 1, 10) || '-' || substr(lpad(CAST(o_orderkey AS VARCHAR), 18, '0'), 11, 2) || '-' || substr(lpad(CAST(o_orderkey AS VARCHAR), 18, '0'), 13) || '-index.htm' AS url,
                 CASE WHEN o_custkey % 100 = 0 THEN '0.00%' ELSE printf('%.2f', (o_custkey % 100)::DOUBLE) || '%' END AS share, CASE WHEN o_custkey % 100 > 50 THEN '+' ELSE '' END || printf('%.2f', (o_custkey % 100 - 50)::DOUBLE) || '%' AS change,
                 o_orderkey % 3 = 0 AND o_custkey % 2 = 0 AS throttled FROM orders""")  # fmt: skip
def landed_scalars(spark, d):
    """Texts of landed files to values, and values to the texts of a page, each over all orders."""
    o = spark.read.parquet(f"{d}/orders.parquet")
    key, cust, day = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderdate").cast("date")
    digits = F.lpad(key.cast("string"), 18, "0")
    status = F.when(key % 3 == 0, 403).otherwise(200)
    body = F.when(cust % 2 == 0, "<p>Request Rate Threshold exceeded</p>").otherwise("<p>Forbidden</p>")
    return o.select(
        "o_orderkey",
        scalars.parse_compact_date(F.date_format(day, "yyyyMMdd")).alias("compact"),
        scalars.parse_instant(F.concat(day.cast("string"), F.lit("T10:00:00.000Z"))).cast("date").alias("instant_day"),
        scalars.parse_decimal(F.concat(key.cast("string"), F.lit("."), F.lpad((cust % 1000).cast("string"), 3, "0"))).alias("exact"),
        scalars.path_stem(F.concat(F.lit("edgar/data/"), key.cast("string"), F.lit(".txt"))).alias("stem"),
        scalars.months_between_days(key % 400).alias("months"),
        scalars.document_url(cust, scalars.dashed_accession(digits)).alias("url"),
        scalars.percent((cust % 100).cast("double") / 100).alias("share"),
        scalars.percent_change((cust % 100 - 50).cast("double") / 100).alias("change"),
        scalars.is_throttle_page(status, body).alias("throttled"),
    )
