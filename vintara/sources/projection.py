"""The engine's tables as projections of star-schema tables, and the same projections in SQL.

One row of ``lineitem`` is one reported fact, one order one filing, ``events`` give macro vintages and daily bars.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def accession(key):
    return F.lpad(key.cast("string"), 12, "0")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, orders = _read(spark, sf_dir, "lineitem"), _read(spark, sf_dir, "orders")
    step = F.floor((F.col("l_linenumber") + 1) / 2)
    filed = F.col("o_orderdate").cast("date")
    sign = F.when(F.col("l_tax") >= 0.06, -1).otherwise(1)
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left").select(
        F.col("l_partkey").alias("cik"),
        F.col("l_linestatus").alias("taxonomy"),
        F.col("l_returnflag").alias("concept"),
        F.when(F.col("l_partkey") % 4 == 0, "USD/shares").when(F.col("l_partkey") % 4 == 1, "shares").otherwise("USD").alias("unit"),
        F.when(F.col("l_linenumber") % 2 == 1, F.make_date(F.lit(1994), (step + 1).cast("int"), F.lit(1))).alias("period_start"),
        F.make_date(F.lit(1994), (step + 3).cast("int"), F.lit(28)).alias("period_end"),
        (sign * F.floor(F.col("l_quantity") / 10)).cast("decimal(38,10)").alias("value"),
        accession(F.col("l_orderkey")).alias("accn"),
        F.col("o_orderpriority").alias("form"),
        filed.alias("filed_at"),
        F.greatest(filed, F.col("l_shipdate").cast("date")).alias("knowledge_date"),
    )


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, lines = _read(spark, sf_dir, "orders"), _read(spark, sf_dir, "lineitem")
    shown = lines.where("l_linenumber <= 2").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max(F.col("l_shipdate").cast("date")).alias("disseminated_at"))
    first = F.substring("o_orderpriority", 1, 1)
    form = F.when(first == "1", "10-K").when(first == "2", "10-Q").when(first == "3", "8-K").when(first == "4", "NT 10-K").otherwise("10-K/A")
    status = F.col("o_orderstatus")
    items = F.when(status == "F", F.array(F.lit("4.02"), F.lit("5.02"))).when(status == "O", F.array(F.lit("2.02"), F.lit("9.01"))).otherwise(F.array(F.lit("4.01")))
    filed = F.col("o_orderdate").cast("date")
    return orders.join(shown, "o_orderkey", "left").select(
        accession(F.col("o_orderkey")).alias("accn"),
        F.col("o_custkey").alias("cik"),
        form.alias("form"),
        filed.alias("filed_at"),
        F.date_sub(filed, (F.col("o_orderkey") % 90).cast("int")).alias("period_of_report"),
        F.when(form == "8-K", items).otherwise(F.array().cast("array<string>")).alias("items"),
        "disseminated_at",
    )


def filing_filers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every filing's own company, and for each eleventh filing a second one."""
    f = filings(spark, sf_dir).select("accn", "cik")
    second = f.where(F.col("accn").cast("long") % 11 == 0).select("accn", (F.col("cik") + 1).alias("cik"), F.lit(False).alias("is_primary"))
    return f.withColumn("is_primary", F.lit(True)).unionByName(second)


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _read(spark, sf_dir, "part")
    sic = F.lpad((F.col("p_size") * 140 + F.col("p_partkey") % 50).cast("string"), 4, "0")
    return part.select(F.col("p_partkey").alias("cik"), F.col("p_name").alias("name"), F.when(F.col("p_partkey") % 17 != 0, sic).otherwise("").alias("sic"))


def identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n = _read(spark, sf_dir, "customer"), _read(spark, sf_dir, "nation")
    ticker = F.concat(F.substring(F.col("c_mktsegment"), F.lit(1), (F.col("c_custkey") % 4 + 1).cast("int")), (F.col("c_custkey") % 97).cast("string"))
    rows = c.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select((F.col("c_custkey") % 500).alias("cik"), ticker.alias("ticker"), F.col("n_name").alias("exchange"), F.date_add(F.lit("2020-01-01").cast("date"), (F.col("c_custkey") % 30).cast("int")).alias("observed_at"))


def macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events")
    value = F.when(F.col("value") >= 20, F.floor(F.col("value") / 100).cast("double"))
    keys = [F.col("event_type").alias("series_id"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("user_id") % 10).cast("int")).alias("obs_date"), F.col("ts").cast("date").alias("realtime_start")]
    return e.groupBy(*keys).agg(F.max_by(value, F.col("event_id")).alias("value"))


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events")
    keys = [F.concat(F.lit("S"), (F.col("user_id") % 20).cast("string")).alias("symbol"), F.col("ts").cast("date").alias("bar_date")]
    bars = e.groupBy(*keys).agg(
        F.min_by("value", "event_id").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"),
        F.max_by("value", "event_id").alias("close"), (F.count("*") * 1000.0).alias("volume"),
    )
    return bars.withColumn("adj_close", F.when(F.dayofmonth("bar_date") % 3 != 0, F.col("close") * 0.5))


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _read(spark, sf_dir, "documents")
    return d.select("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("content_sha256"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("byte_len"))


SQL: dict[str, str] = {
    "facts": """
      SELECT l_partkey AS cik, l_linestatus AS taxonomy, l_returnflag AS concept,
             CASE WHEN l_partkey % 4 = 0 THEN 'USD/shares' WHEN l_partkey % 4 = 1 THEN 'shares' ELSE 'USD' END AS unit,
             CASE WHEN l_linenumber % 2 = 1 THEN make_date(1994, CAST(floor((l_linenumber + 1) / 2) + 1 AS INTEGER), 1) END AS period_start,
             make_date(1994, CAST(floor((l_linenumber + 1) / 2) + 3 AS INTEGER), 28) AS period_end,
             CAST(CASE WHEN l_tax >= 0.06 THEN -1 ELSE 1 END * floor(l_quantity / 10) AS DECIMAL(38,10)) AS value,
             lpad(CAST(l_orderkey AS VARCHAR), 12, '0') AS accn, o_orderpriority AS form, CAST(o_orderdate AS DATE) AS filed_at,
             greatest(CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS knowledge_date
      FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey""",
    "filings": """
      SELECT lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS accn, o_custkey AS cik,
             CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN '10-K' WHEN '2' THEN '10-Q' WHEN '3' THEN '8-K' WHEN '4' THEN 'NT 10-K' ELSE '10-K/A' END AS form,
             CAST(o_orderdate AS DATE) AS filed_at, CAST(o_orderdate AS DATE) - CAST(o_orderkey % 90 AS INTEGER) AS period_of_report,
             CASE WHEN substr(o_orderpriority, 1, 1) <> '3' THEN CAST([] AS VARCHAR[]) WHEN o_orderstatus = 'F' THEN ['4.02', '5.02']
                  WHEN o_orderstatus = 'O' THEN ['2.02', '9.01'] ELSE ['4.01'] END AS items,
             disseminated_at
      FROM orders LEFT JOIN (SELECT l_orderkey, max(CAST(l_shipdate AS DATE)) AS disseminated_at FROM lineitem WHERE l_linenumber <= 2 GROUP BY 1)
        ON o_orderkey = l_orderkey""",
    "filing_filers": """
      SELECT accn, cik, true AS is_primary FROM filings
      UNION ALL SELECT accn, cik + 1, false FROM filings WHERE CAST(accn AS BIGINT) % 11 = 0""",
    "entities": """
      SELECT p_partkey AS cik, p_name AS name,
             CASE WHEN p_partkey % 17 <> 0 THEN lpad(CAST(p_size * 140 + p_partkey % 50 AS VARCHAR), 4, '0') ELSE '' END AS sic FROM part""",
    "identifiers": """
      SELECT c_custkey % 500 AS cik, substr(c_mktsegment, 1, CAST(c_custkey % 4 + 1 AS INTEGER)) || CAST(c_custkey % 97 AS VARCHAR) AS ticker,
             n_name AS exchange, DATE '2020-01-01' + CAST(c_custkey % 30 AS INTEGER) AS observed_at
      FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "macro": """
      SELECT event_type AS series_id, DATE '2024-01-01' + CAST(user_id % 10 AS INTEGER) AS obs_date, CAST(ts AS DATE) AS realtime_start,
             arg_max_null(CASE WHEN value >= 20 THEN CAST(floor(value / 100) AS DOUBLE) END, event_id) AS value
      FROM events GROUP BY 1, 2, 3""",
    "prices": """
      SELECT *, CASE WHEN day(bar_date) % 3 <> 0 THEN close * 0.5 END AS adj_close FROM (
        SELECT 'S' || CAST(user_id % 20 AS VARCHAR) AS symbol, CAST(ts AS DATE) AS bar_date, arg_min(value, event_id) AS open, max(value) AS high,
               min(value) AS low, arg_max(value, event_id) AS close, count(*) * 1000.0::DOUBLE AS volume FROM events GROUP BY 1, 2)""",
    "payloads": """
      SELECT doc_id, sha256(coalesce(text, '')) AS content_sha256, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS byte_len FROM documents""",
}
