"""The engine's queries over the projected tables, and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from vintara.functions import hashing, scalars
from vintara.operators import asof, backtest, corpus, features, forensics, panel, statistics, store, views
from vintara.operators.asof import AsOf
from vintara.operators.joins import asof_backward, asof_forward
from vintara.plans.oracle import GRAIN, sql
from vintara.sources import projection as p

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
DAY, LATE_DAY = date(2000, 6, 30), date(2001, 3, 31)
SPEC = features.AccrualsSpec(income="A", cash_flow="N", cash_flow_fallback="NONE", assets="R", span=(60, 120), gap=(20, 40))
FORMATIONS = ("1996-12-31", "1998-06-30", "2000-06-30", "2001-12-31")
PLAN = backtest.Plan(quantiles=4, lag_days=1, least_bars=6)
TRADES = ("2024-01-08", "2024-01-14", "2024-01-20", "2024-01-26")


def query(oracle: str | None = None, *names: str):
    """Registers a query under its function's name; doubles are rounded to six decimals, as in its SQL."""

    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            return df.withColumns({c.name: F.round(c.name, 6) for c in df.schema if isinstance(c.dataType, DoubleType)})

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if oracle:
            SQL[f.__name__] = sql(oracle, *names)
        return run

    return register


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {
        "facts": p.facts(spark, sf_dir),
        "filings": p.filings(spark, sf_dir),
        "filers": p.filing_filers(spark, sf_dir),
        "entities": p.entities(spark, sf_dir),
        "identifiers": p.identifiers(spark, sf_dir),
        "macro": p.macro(spark, sf_dir),
        "prices": p.prices(spark, sf_dir),
    }


def _filings(spark, d):
    return views.company_filings(p.filings(spark, d), p.filing_filers(spark, d))


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A signal panel from the events before each date, known the day before it."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    days = F.explode(F.array(*[F.lit(x).cast("date") for x in TRADES])).alias("formation_date")
    rows = e.select(F.concat(F.lit("S"), (F.col("user_id") % 20).cast("string")).alias("symbol"), "event_id", F.col("ts").cast("date").alias("day"), days)
    rows = rows.where("day < formation_date").groupBy("symbol", "formation_date")
    value = (F.sum(F.col("event_id") * 7919 % 101) % 1000).cast("double") / 1000
    return rows.agg(value.alias("value")).withColumn("knowledge_date", F.date_sub("formation_date", 1))


def returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A matrix of returns: ten strategies, forty observations."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    ret = F.sum(F.round(F.col("l_extendedprice") * 100).cast("long") % 2001 - 1000) / F.lit(1000000.0)
    return li.groupBy((F.col("l_suppkey") % 10).cast("int").alias("strategy"), (F.col("l_partkey") % 40).alias("obs")).agg(ret.alias("ret"))


# Knowledge dates and chains


@query("SELECT accn, cik, form, filed_at, knowledge_date, was_disseminated_late, dissemination_lag_days FROM filings_pit", "filings_pit")
def filings_knowledge_date(spark, d):
    return views.filings_pit(p.filings(spark, d)).select("accn", "cik", "form", "filed_at", "knowledge_date", "was_disseminated_late", "dissemination_lag_days")


@query("SELECT form, count(*) AS n, max(dissemination_lag_days) AS longest FROM filings_pit WHERE was_disseminated_late GROUP BY 1", "filings_pit")
def late_filings(spark, d):
    return views.filings_pit(p.filings(spark, d)).where("was_disseminated_late").groupBy("form").agg(F.count("*").alias("n"), F.max("dissemination_lag_days").alias("longest"))


@query("SELECT accn, cik, is_primary, form, knowledge_date FROM company_filings", "company_filings")
def company_filings(spark, d):
    return _filings(spark, d).select("accn", "cik", "is_primary", "form", "knowledge_date")


@query("""SELECT f.accn, f.cik, f.concept, f.period_end, f.value, greatest(f.filed_at, coalesce(g.disseminated_at, f.filed_at)) AS knowledge_date
          FROM facts f LEFT JOIN filings g ON f.accn = g.accn""", "facts", "filings")  # fmt: skip
def facts_knowledge_join(spark, d):
    return views.with_knowledge_date(p.facts(spark, d), p.filings(spark, d)).select("accn", "cik", "concept", "period_end", "value", "knowledge_date")


@query(f"SELECT {GRAIN}, accn, value, knowledge_date, report_seq, differs_from_first_report, period_distinct_values FROM facts_pit", "facts_pit")
def facts_pit_chain(spark, d):
    return views.facts_pit(p.facts(spark, d)).select(*GRAIN.split(", "), "accn", "value", "knowledge_date", "report_seq", "differs_from_first_report", "period_distinct_values")


@query(f"SELECT {GRAIN}, accn, value, report_seq, prior_value, prior_knowledge_date, prior_filed_at, prior_accn FROM fact_revisions", "fact_revisions")
def fact_revisions(spark, d):
    return views.fact_revisions(p.facts(spark, d)).select(*GRAIN.split(", "), "accn", "value", "report_seq", "prior_value", "prior_knowledge_date", "prior_filed_at", "prior_accn")


# As-of reads

_LATEST = f"SELECT {GRAIN}, value, accn, knowledge_date FROM (SELECT *, row_number() OVER (PARTITION BY {GRAIN} ORDER BY knowledge_date DESC, accn DESC, value DESC) AS r FROM facts WHERE {{}}) WHERE r = 1"
_FACT = [*GRAIN.split(", "), "value", "accn", "knowledge_date"]


@query(_LATEST.format("knowledge_date <= DATE '2000-06-30'"), "facts")
def asof_facts(spark, d):
    return AsOf(tables(spark, d), DAY).facts(taxonomy=None).select(*_FACT)


@query(_LATEST.format("knowledge_date <= DATE '2000-06-30' AND taxonomy = 'F' AND concept = 'A' AND period_end = DATE '1994-05-28' AND period_start = DATE '1994-03-01'"), "facts")
def asof_facts_period(spark, d):
    return AsOf(tables(spark, d), DAY).facts(concept="A", taxonomy="F", period_end=date(1994, 5, 28), period_start=date(1994, 3, 1)).select(*_FACT)


@query(_LATEST.format("knowledge_date <= DATE '2000-06-30' AND taxonomy = 'F' AND concept = 'A' AND period_start IS NULL"), "facts")
def asof_instant_pin(spark, d):
    return AsOf(tables(spark, d), DAY).facts(concept="A", taxonomy="F", period_start=asof.INSTANT).select(*_FACT)


@query(_LATEST.format("knowledge_date <= DATE '2001-03-31' AND taxonomy = 'F'") + " ORDER BY period_end DESC, unit, period_start NULLS FIRST, cik, concept LIMIT 20", "facts")
def asof_facts_top(spark, d):
    """The newest facts of a taxonomy: a report of a fixed length."""
    rows = AsOf(tables(spark, d), LATE_DAY).facts(taxonomy="F")
    return rows.orderBy(F.desc("period_end"), "unit", F.col("period_start").asc_nulls_first(), "cik", "concept").limit(20).select(*_FACT)


@query(f"SELECT {GRAIN}, value, accn, knowledge_date FROM facts_pit WHERE report_seq = 1 AND knowledge_date <= DATE '2000-06-30'", "facts_pit")
def first_reported(spark, d):
    return AsOf(tables(spark, d), DAY).first_reported(taxonomy=None).select(*_FACT)


@query(f"""SELECT {GRAIN}, value, accn, knowledge_date, report_seq, report_seq = 1 AS is_first_report, period_distinct_values > 1 AS value_ever_changed, date_diff('day', period_end, knowledge_date) AS age_days,
            coalesce(CAST(period_start AS VARCHAR), 'instant') AS pin, CASE WHEN differs_from_first_report THEN 'restated' WHEN report_seq = 1 THEN '' ELSE 're-presented' END AS mark
          FROM (SELECT *, row_number() OVER (PARTITION BY {GRAIN} ORDER BY knowledge_date DESC, accn DESC, value DESC) AS r FROM facts_pit WHERE knowledge_date <= DATE '2000-06-30') WHERE r = 1""", "facts_pit")  # fmt: skip
def asof_marks(spark, d):
    rows = AsOf(tables(spark, d), DAY).marked_facts(taxonomy=None)
    return rows.select(*_FACT, "report_seq", "is_first_report", "value_ever_changed", "age_days", "pin", "mark")


@query(_LATEST.format("true"), "facts")
def latest_restated(spark, d):
    return AsOf(tables(spark, d), DAY).unsafe_latest_restated(taxonomy=None).select(*_FACT)


@query(f"SELECT {GRAIN}, value, accn, knowledge_date FROM facts_pit WHERE report_seq = 1 AND knowledge_date <= DATE '2000-06-30' AND taxonomy = 'F' AND period_end = DATE '1994-05-28' AND period_start = DATE '1994-03-01'", "facts_pit")
def first_reported_pinned(spark, d):
    """A period end that an instant shares: the pin says which is meant."""
    return AsOf(tables(spark, d), DAY).first_reported(taxonomy="F", period_end=date(1994, 5, 28), period_start=date(1994, 3, 1)).select(*_FACT)


@query(f"SELECT {GRAIN}, value, accn, knowledge_date FROM facts_pit WHERE report_seq = 1 AND knowledge_date <= DATE '2000-06-30' AND period_end = DATE '1994-07-28'", "facts_pit")
def first_reported_of_one_period(spark, d):
    """A period end that no other period shares needs no pin; the guard is in the plan and lets all pass."""
    return AsOf(tables(spark, d), DAY).first_reported(taxonomy=None, period_end=date(1994, 7, 28)).select(*_FACT)


@query(_LATEST.format("period_end = DATE '1994-07-28'"), "facts")
def latest_restated_of_one_period(spark, d):
    return AsOf(tables(spark, d), DAY).unsafe_latest_restated(taxonomy=None, period_end=date(1994, 7, 28)).select(*_FACT)


_REVISION = f"SELECT {GRAIN}, value, prior_value, accn, prior_accn, knowledge_date, round(relative_change, 6) AS relative_change, absolute_change, days_between FROM measured_revisions WHERE knowledge_date <= DATE '2000-06-30'"
_REVISED = [*GRAIN.split(", "), "value", "prior_value", "accn", "prior_accn", "knowledge_date", "relative_change", "absolute_change", "days_between"]


@query(_REVISION, "measured_revisions")
def revisions_all(spark, d):
    return AsOf(tables(spark, d), DAY).revisions(taxonomy=None).select(*_REVISED)


@query(_REVISION + " AND (abs(relative_change) >= 0.5 OR (prior_value = 0 AND value <> 0))", "measured_revisions")
def revisions_min_change(spark, d):
    return AsOf(tables(spark, d), DAY).revisions(taxonomy=None, min_relative_change=0.5).select(*_REVISED)


@query("SELECT concept, count(*) AS n, round(avg(days_between), 6) AS mean_days, max(days_between) AS longest FROM measured_revisions WHERE knowledge_date <= DATE '2000-06-30' GROUP BY 1", "measured_revisions")
def revision_lags(spark, d):
    return AsOf(tables(spark, d), DAY).revisions(taxonomy=None).groupBy("concept").agg(F.count("*").alias("n"), F.avg("days_between").alias("mean_days"), F.max("days_between").alias("longest"))


@query("SELECT cik, taxonomy, concept, unit, period_end, count(DISTINCT coalesce(CAST(period_start AS VARCHAR), '')) AS starts FROM facts GROUP BY ALL HAVING count(DISTINCT coalesce(CAST(period_start AS VARCHAR), '')) > 1", "facts")
def ambiguous_periods(spark, d):
    return asof.ambiguous_ends(p.facts(spark, d))


_TRIPLE = f"""SELECT *, CASE WHEN value_changed AND NOT already_restated_by_then THEN 'restated later' WHEN value_changed AND known_is_current THEN 'restated, current shown'
         WHEN value_changed THEN 'restated, intermediate shown' WHEN value_ever_changed THEN 'revised and back' WHEN is_restated THEN 're-presented' ELSE 'never' END AS story
  FROM (SELECT {GRAIN}, k.v AS as_known, f.v AS as_first_reported, t.v AS as_it_stands_today,
               round(CASE WHEN f.v <> 0 THEN (CAST(t.v AS DOUBLE) - CAST(f.v AS DOUBLE)) / abs(CAST(f.v AS DOUBLE)) END, 6) AS relative_drift,
               t.a <> k.a AS is_restated, t.v <> f.v AS value_changed, k.v <> f.v AS already_restated_by_then, k.v = t.v AS known_is_current, n > 1 AS value_ever_changed
        FROM (SELECT {GRAIN}, max({{'d': knowledge_date, 'a': accn, 'v': value}}) FILTER (WHERE knowledge_date <= DATE '2000-06-30') AS k,
                     min({{'d': knowledge_date, 'a': accn, 'v': value}}) AS f, max({{'d': knowledge_date, 'a': accn, 'v': value}}) AS t, count(DISTINCT value) AS n
              FROM facts GROUP BY ALL) WHERE k IS NOT NULL)"""


@query(_TRIPLE, "facts")
def asof_triple(spark, d):
    return asof.narrative(asof.vintage_triples(p.facts(spark, d), DAY))


@query(f"SELECT story, count(*) AS n FROM ({_TRIPLE}) GROUP BY 1", "facts")
def asof_narrative(spark, d):
    return asof.narrative(asof.vintage_triples(p.facts(spark, d), DAY)).groupBy("story").agg(F.count("*").alias("n"))


_MACRO = "SELECT series_id, obs_date, value, realtime_start FROM (SELECT series_id, obs_date, arg_max_null(value, realtime_start) AS value, max(realtime_start) AS realtime_start FROM macro WHERE realtime_start <= DATE '2024-01-15'{} GROUP BY 1, 2) WHERE value IS NOT NULL"


@query(_MACRO.format(""), "macro")
def macro_asof(spark, d):
    return AsOf(tables(spark, d), date(2024, 1, 15)).macro_series()


@query(_MACRO.format(" AND series_id = 'view' AND obs_date BETWEEN DATE '2024-01-02' AND DATE '2024-01-08'"), "macro")
def macro_series(spark, d):
    return AsOf(tables(spark, d), date(2024, 1, 15)).macro_series("view", start=date(2024, 1, 2), end=date(2024, 1, 8))


@query("""SELECT series_id, obs_date, min(realtime_start) AS realtime_start, max(realtime_end) AS realtime_end, any_value(value) AS value
          FROM (SELECT *, sum(c) OVER (PARTITION BY series_id, obs_date ORDER BY realtime_start) AS run
                FROM (SELECT *, realtime_start + 1 AS realtime_end, CASE WHEN row_number() OVER w = 1 OR lag(value) OVER w IS DISTINCT FROM value THEN 1 ELSE 0 END AS c
                      FROM macro WINDOW w AS (PARTITION BY series_id, obs_date ORDER BY realtime_start)))
          GROUP BY series_id, obs_date, run""", "macro")  # fmt: skip
def macro_merge_runs(spark, d):
    return store.merge_unrevised_runs(p.macro(spark, d).withColumn("realtime_end", F.date_add("realtime_start", 1)))


@query("SELECT symbol, bar_date, close, adj_close, bar_date + 2 AS tradable_from FROM prices WHERE bar_date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'", "prices")
def prices_tradable(spark, d):
    return AsOf(tables(spark, d), date(2024, 1, 20)).prices(execution_lag_days=2, start=date(2024, 1, 5), end=date(2024, 1, 31)).select("symbol", "bar_date", "close", "adj_close", "tradable_from")


@query("""SELECT s.symbol, s.formation_date, min(b.bar_date) AS bar_date, arg_min(b.close, b.bar_date) AS close
          FROM signals s LEFT JOIN prices b ON s.symbol = b.symbol AND b.bar_date >= s.formation_date + 1 GROUP BY 1, 2""", "signals", "prices")  # fmt: skip
def first_tradable_bar(spark, d):
    anchors = signals(spark, d).select("symbol", "formation_date", F.date_add("formation_date", 1).alias("from_day"))
    return asof_forward(anchors, p.prices(spark, d), ["symbol"], "from_day", "bar_date", ["close"]).select("symbol", "formation_date", "bar_date", "close")


@query("""SELECT s.symbol, s.formation_date, max(b.bar_date) AS bar_date, arg_max(b.close, b.bar_date) AS close
          FROM signals s LEFT JOIN prices b ON s.symbol = b.symbol AND b.bar_date <= s.formation_date GROUP BY 1, 2""", "signals", "prices")  # fmt: skip
def last_known_bar(spark, d):
    return asof_backward(signals(spark, d).select("symbol", "formation_date"), p.prices(spark, d), ["symbol"], "formation_date", "bar_date", ["close"])


# Corpus statistics

_TALLY = """SELECT count(*) AS facts, count(*) FILTER (WHERE restated) AS restated_facts, count(*) FILTER (WHERE n_reports = 1) AS reported_once,
       count(*) FILTER (WHERE n_reports > 1) AS restatable, count(*) FILTER (WHERE restated AND is_sign_flip) AS sign_flips,
       count(*) FILTER (WHERE restated AND (first_value = 0) <> (latest_value = 0)) AS zero_endpoint, count(*) FILTER (WHERE restated AND relative_change IS NULL) AS undefined_change,
       count(*) FILTER (WHERE restated AND latest_value > first_value) AS revised_up, count(*) FILTER (WHERE restated AND latest_value < first_value) AS revised_down,
       count(*) FILTER (WHERE restated AND latest_value = first_value) AS returned, CAST(coalesce(sum(n_reports), 0) AS BIGINT) AS rows_total,
       round(CASE WHEN count(*) = 0 THEN 0.0 ELSE count(*) FILTER (WHERE restated) / count(*) END, 6) AS restated_share,
       round(CASE WHEN count(*) FILTER (WHERE n_reports > 1) = 0 THEN 0.0 ELSE count(*) FILTER (WHERE restated) / count(*) FILTER (WHERE n_reports > 1) END, 6) AS restated_share_of_restatable
FROM per_fact"""


@query(_TALLY, "per_fact")
def contamination_tally(spark, d):
    return corpus.tally(p.facts(spark, d))


@query(_TALLY + " WHERE taxonomy = 'F' AND concept = 'A'", "per_fact")
def contamination_slice(spark, d):
    return corpus.tally(p.facts(spark, d).where("taxonomy = 'F' and concept = 'A'"))


@query(" UNION ALL ".join(f"SELECT {q}::DOUBLE AS quantile, round(quantile_cont(relative_change, {q}), 6) AS change, round(quantile_cont(relative_change, {q}) FILTER (WHERE NOT is_sign_flip), 6) AS change_same_sign FROM per_fact WHERE restated" for q in corpus.QUANTILES), "per_fact")
def contamination_quantiles(spark, d):
    return corpus.change_quantiles(p.facts(spark, d))


@query(" UNION ALL ".join(f"SELECT {t}::DOUBLE AS threshold, count(*) FILTER (WHERE relative_change > {t}) AS facts, count(*) FILTER (WHERE relative_change > {t} AND NOT is_sign_flip) AS facts_same_sign FROM per_fact WHERE restated" for t in corpus.THRESHOLDS), "per_fact")
def contamination_thresholds(spark, d):
    return corpus.change_thresholds(p.facts(spark, d))


@query("SELECT count(*) AS rows_total, count(*) FILTER (WHERE differs_from_first_report) AS restated_rows, round(count(*) FILTER (WHERE differs_from_first_report) / count(*), 6) AS restated_row_share FROM facts_pit", "facts_pit")
def contamination_rows(spark, d):
    return corpus.restated_rows(p.facts(spark, d))


@query("""SELECT *, round(CASE WHEN restated_facts = 0 THEN 0.0 ELSE revised_down / restated_facts END, 6) AS downward_share
          FROM (SELECT CASE WHEN unit LIKE '%/shares%' THEN 'per-share' WHEN unit = 'shares' THEN 'share count' ELSE 'other' END AS unit_class, count(*) AS facts,
                       count(*) FILTER (WHERE restated) AS restated_facts, count(*) FILTER (WHERE restated AND latest_value > first_value) AS revised_up,
                       count(*) FILTER (WHERE restated AND latest_value < first_value) AS revised_down, round(quantile_cont(relative_change, 0.5) FILTER (WHERE restated), 6) AS median_change
                FROM per_fact GROUP BY 1)""", "per_fact")  # fmt: skip
def unit_class(spark, d):
    return corpus.by_unit_class(p.facts(spark, d))


@query("""SELECT count(*) AS triples, count(*) FILTER (WHERE u > 1) AS multi_unit, count(*) FILTER (WHERE t > 1) AS multi_taxonomy
          FROM (SELECT count(DISTINCT unit) AS u, count(DISTINCT taxonomy) AS t FROM facts GROUP BY cik, concept, period_start, period_end)""", "facts")  # fmt: skip
def cross_grain(spark, d):
    return corpus.cross_grain(p.facts(spark, d))


def _survival(select: str, condition: str, group: str) -> str:
    counts = ", ".join(f"count(*) FILTER (WHERE {c}{x}) AS {n}_{m}" for n, c in (("active", f"NOT {condition}"), ("dormant", condition)) for m, x in (("facts", ""), ("restatable", " AND n_reports >= 2"), ("restated", " AND restated")))
    share = lambda a, b: f"CASE WHEN {b} = 0 THEN 0.0 ELSE {a} / {b} END"
    s = {n: share(f"{n}_restated", f"{n}_facts") for n in ("active", "dormant")} | {f"{n}_if": share(f"{n}_restated", f"{n}_restatable") for n in ("active", "dormant")}
    pooled = share("(active_restated + dormant_restated)", "(active_facts + dormant_facts)")
    gap = lambda a, b: f"round(CASE WHEN active_facts >= 1000 AND dormant_facts >= 1000 THEN ({a}) - ({b}) END, 6)"
    return f"""SELECT *, round({s['active']}, 6) AS active_share, round({s['dormant']}, 6) AS dormant_share, round({pooled}, 6) AS pooled_share,
      {gap(s['dormant'], s['active'])} AS gap, {gap(s['dormant_if'], s['active_if'])} AS conditional_gap, {gap(s['active'], pooled)} AS active_only_bias
      FROM (SELECT {select}, {counts} FROM (SELECT p.*, last_filed_at FROM per_fact p JOIN last_filed l ON p.cik = l.cik) {group})"""


@query(" UNION ALL ".join(_survival(f"'{c}' AS cutoff", f"last_filed_at < DATE '{c}'", "") for c in corpus.CUTOFFS), "per_fact", "last_filed")
def survival_split(spark, d):
    return corpus.survival_split(p.facts(spark, d))


@query(_survival("CASE WHEN period_end <= DATE '1994-04-30' THEN 'through April 1994' WHEN period_end <= DATE '1994-05-31' THEN 'May 1994' ELSE 'later' END AS band", f"last_filed_at < DATE '{corpus.CUTOFFS[2]}'", "GROUP BY 1"), "per_fact", "last_filed")
def survival_bands(spark, d):
    return corpus.survival_bands(p.facts(spark, d))


@query(" UNION ALL ".join(f"SELECT '{n}' AS key, count(*) AS facts, count(*) FILTER (WHERE v > 1) AS revised FROM (SELECT count(DISTINCT value) AS v FROM facts GROUP BY {g})" for n, g in (("grain", GRAIN), ("without_start", GRAIN.replace("period_start, ", "")))), "facts")
def corpus_stats_right_wrong_key(spark, d):
    return corpus.right_and_wrong_key(p.facts(spark, d))


@query("SELECT count(*) AS rows_total, count(DISTINCT cik) AS filers, count(DISTINCT accn) AS filings, min(filed_at) AS first_filed, max(filed_at) AS data_vintage FROM facts", "facts")
def quality_counts(spark, d):
    return p.facts(spark, d).agg(F.count("*").alias("rows_total"), F.countDistinct("cik").alias("filers"), F.countDistinct("accn").alias("filings"), F.min("filed_at").alias("first_filed"), F.max("filed_at").alias("data_vintage"))


@query("SELECT CAST(sum(n) AS BIGINT) AS payloads, count(*) AS distinct_payloads, CAST(sum((n - 1) * b) AS BIGINT) AS bytes_saved FROM (SELECT count(*) AS n, any_value(byte_len) AS b FROM payloads GROUP BY content_sha256)", "payloads")
def payload_dedupe(spark, d):
    return corpus.payload_coverage(p.payloads(spark, d))


@query("""SELECT coalesce(k.content_sha256, s.content_sha256) AS stored_path, CASE WHEN s.content_sha256 IS NULL THEN 'missing' ELSE 'not indexed' END AS difference
          FROM (SELECT DISTINCT p.content_sha256 FROM payloads p JOIN documents d ON p.doc_id = d.doc_id WHERE lang <> 'de') k
          FULL OUTER JOIN (SELECT DISTINCT content_sha256 FROM payloads WHERE byte_len > 400) s ON k.content_sha256 = s.content_sha256
          WHERE k.content_sha256 IS NULL OR s.content_sha256 IS NULL""", "payloads")  # fmt: skip
def payload_differences(spark, d):
    """A ledger of some documents against a store of others: what each has alone."""
    rows = p.payloads(spark, d).withColumnRenamed("content_sha256", "stored_path")
    some = spark.read.parquet(f"{d}/documents.parquet").where("lang <> 'de'").select("doc_id")
    stored = rows.where("byte_len > 400").groupBy("stored_path").agg(F.max("byte_len").alias("stored_bytes"))
    return store.payload_differences(rows.join(some, "doc_id", "left_semi"), stored)


@query("""SELECT series_id, obs_date, min(realtime_start) AS realtime_start, max(realtime_end) AS realtime_end, any_value(value) AS value
          FROM (SELECT *, sum(c) OVER (PARTITION BY series_id, obs_date ORDER BY realtime_start) AS run
                FROM (SELECT series_id, obs_date, realtime_start, value, coalesce(lead(realtime_start) OVER w - 1, DATE '2024-12-31') AS realtime_end,
                             CASE WHEN row_number() OVER w = 1 OR lag(value) OVER w IS DISTINCT FROM value THEN 1 ELSE 0 END AS c
                      FROM macro WINDOW w AS (PARTITION BY series_id, obs_date ORDER BY realtime_start)))
          GROUP BY series_id, obs_date, run""", "macro")  # fmt: skip
def macro_windows(spark, d):
    """Vintages cut at two days, as three windows of an archive would have them, and put together again."""
    from pyspark.sql import Window

    from vintara.sources import landing

    day = lambda x: F.lit(x).cast("date")
    w = Window.partitionBy("series_id", "obs_date").orderBy("realtime_start")
    whole = p.macro(spark, d).withColumn("realtime_end", F.coalesce(F.date_sub(F.lead("realtime_start").over(w), 1), day("2024-12-31")))
    low, high = [F.array(*map(day, x)) for x in (("1900-01-01", "2024-01-11", "2024-01-21"), ("2024-01-10", "2024-01-20", "2024-12-31"))]
    rows = whole.select("*", F.posexplode(F.arrays_zip(low.alias("a"), high.alias("b"))).alias("k", "w")).where("realtime_start <= w.b and realtime_end >= w.a")
    rows = rows.withColumns({"source_uri": F.col("k").cast("string"), "realtime_start": F.greatest("realtime_start", "w.a"), "realtime_end": F.least("realtime_end", "w.b")})
    none = rows.select("source_uri", F.lit("").alias("reason")).where("false")
    return landing.union_windows(landing.Parsed(rows, none)).rows.drop("source_uri")


# Surveillance


@query("SELECT accn, cik, form, n_flags, round(score, 6) AS score, confidence FROM flagged", "flagged")
def forensic_flags(spark, d):
    return forensics.flags(_filings(spark, d)).select("accn", "cik", "form", F.size("flags").alias("n_flags"), "score", "confidence")


@query("SELECT accn, cik, round(score, 6) AS score, confidence, row_number() OVER (ORDER BY score DESC, accn, cik) AS place FROM flagged WHERE n_flags > 0 ORDER BY place LIMIT 50", "flagged")
def forensic_score_rank(spark, d):
    """The fifty filings with the highest scores: a report of a fixed length."""
    from pyspark.sql import Window

    top = forensics.ranked(forensics.flags(_filings(spark, d))).limit(50)
    return top.select("accn", "cik", "score", "confidence", F.row_number().over(Window.orderBy(F.desc("score"), "accn", "cik")).alias("place"))


@query("SELECT accn, cik, form, lag_days, n_priors, round(mean_lag, 6) AS mean_lag, round(sd_lag, 6) AS sd_lag, unusual_lag FROM flagged", "flagged")
def unusual_lag(spark, d):
    return forensics.filing_lags(_filings(spark, d)).select("accn", "cik", "form", "lag_days", "n_priors", "mean_lag", "sd_lag", "unusual_lag")


@query("SELECT accn, cik, form, round(score, 6) AS score, confidence FROM flagged WHERE knowledge_date = DATE '2000-06-30'", "flagged")
def day_feed(spark, d):
    return forensics.day_feed(_filings(spark, d), DAY).select("accn", "cik", "form", "score", "confidence")


# Identifiers and entities


@query("SELECT DISTINCT ticker, i.cik, name FROM identifiers i JOIN entities e ON i.cik = e.cik WHERE upper(ticker) LIKE 'A%' OR upper(name) LIKE '%RING%' ORDER BY length(ticker), ticker, i.cik LIMIT 25", "identifiers", "entities")
def search_entities(spark, d):
    """Tickers that start with a text or whose company's name contains one; the shortest 25."""
    from vintara.plans.service import search

    return search(tables(spark, d), "a", "ring", 25)


@query("SELECT upper(ticker) AS ticker, max({'at': observed_at, 'cik': -cik}).at AS observed_at, -max({'at': observed_at, 'cik': -cik}).cik AS cik FROM identifiers GROUP BY 1", "identifiers")
def resolve_latest_identifier(spark, d):
    """Each ticker's company at its latest observation, the smallest number of equal ones."""
    latest = F.max(F.struct(F.col("observed_at").alias("at"), (-F.col("cik")).alias("c"))).alias("m")
    return p.identifiers(spark, d).groupBy(F.upper("ticker").alias("ticker")).agg(latest).select("ticker", F.col("m.at").alias("observed_at"), (-F.col("m.c")).alias("cik"))


@query("""SELECT e.cik, name, sic, symbol, CASE WHEN coalesce(regexp_matches(sic, '^[0-9]{2}') AND TRY_CAST(substr(sic, 1, 2) AS INTEGER) BETWEEN 60 AND 67, false)
              OR coalesce(regexp_matches(sic, '^[0-9]{4}$') AND TRY_CAST(sic AS INTEGER) BETWEEN 4900 AND 4949, false) THEN 'SECTOR' WHEN symbol IS NULL THEN 'NO_TICKER' END AS drop_reason
          FROM entities e LEFT JOIN (SELECT cik, arg_min(ticker, row(length(ticker), ticker)) AS symbol FROM identifiers GROUP BY 1) i ON e.cik = i.cik""", "entities", "identifiers")  # fmt: skip
def sector_screen(spark, d):
    return panel.universe(p.entities(spark, d), p.identifiers(spark, d))


@query("SELECT cik, arg_min(ticker, row(length(ticker), ticker)) AS symbol, count(DISTINCT ticker) AS tickers FROM identifiers GROUP BY 1", "identifiers")
def shortest_symbol(spark, d):
    return p.identifiers(spark, d).groupBy("cik").agg(F.min_by("ticker", F.struct(F.length("ticker"), "ticker")).alias("symbol"), F.countDistinct("ticker").alias("tickers"))


# Writes


@query("SELECT accn, cik, form FROM filings WHERE form = '10-K' OR filed_at < DATE '2000-01-01' EXCEPT SELECT accn, cik, form FROM filings WHERE filed_at < DATE '2000-01-01'", "filings")
def insert_if_absent(spark, d):
    """The new rows of a delivery of annual reports and of all filings up to 1999, where the latter are known already."""
    f, columns = p.filings(spark, d), ["accn", "cik", "form"]
    old = "filed_at < date '2000-01-01'"
    return store.absent(f.where(f"form = '10-K' or {old}").select(*columns), f.where(old).select(*columns), ["accn"])


@query("SELECT content_sha256, min(doc_id) AS doc_id, arg_min(byte_len, doc_id) AS byte_len FROM payloads GROUP BY 1", "payloads")
def first_wins_dedupe(spark, d):
    return store.first_wins(p.payloads(spark, d), ["content_sha256"], "doc_id")


@query("""SELECT cik, arg_max(name, row(age, last_observed)) AS name, min(first_observed) AS first_observed, max(last_observed) AS last_observed
          FROM (SELECT cik, name, 0 AS age, DATE '2020-01-01' AS first_observed, DATE '2020-06-01' AS last_observed FROM entities
                UNION ALL SELECT cik, upper(name), 1, DATE '2019-01-01', DATE '2020-03-01' FROM entities WHERE sic <> '') GROUP BY 1""", "entities")  # fmt: skip
def upsert_entity(spark, d):
    day = lambda x: F.lit(x).cast("date")
    e = p.entities(spark, d)
    old = e.select("cik", "name", day("2020-01-01").alias("first_observed"), day("2020-06-01").alias("last_observed"))
    new = e.where("sic <> ''").select("cik", F.upper("name").alias("name"), day("2019-01-01").alias("first_observed"), day("2020-03-01").alias("last_observed"))
    return store.upsert_entities(old, new, ["name"])


@query("SELECT accn, cik, starts_with(accn, lpad(CAST(cik AS VARCHAR), 10, '0')) AS is_primary FROM filings f WHERE NOT EXISTS (SELECT 1 FROM filing_filers l JOIN filings g ON l.accn = g.accn WHERE l.accn = f.accn AND l.cik = f.cik AND g.filed_at < DATE '1998-07-01')", "filings", "filing_filers")
def backfill_links(spark, d):
    """Links as they were delivered until the middle of 1998, filings of all years: those filed later have none yet."""
    filings, links = p.filings(spark, d), p.filing_filers(spark, d)
    delivered = links.join(filings.where("filed_at < '1998-07-01'").select("accn"), "accn", "left_semi")
    return store.missing_links(filings, delivered)


@query("SELECT accn, cik, starts_with(accn, lpad(CAST(cik AS VARCHAR), 10, '0')) AS is_primary FROM filings f WHERE NOT EXISTS (SELECT 1 FROM filing_filers l WHERE l.accn = f.accn AND l.cik = f.cik AND NOT l.is_primary)", "filings", "filing_filers")
def backfill_links_of_joint_filings(spark, d):
    """Against the links of co-registrants alone: a joint filing has a link, and lacks that of the company that submitted it."""
    return store.missing_links(p.filings(spark, d), p.filing_filers(spark, d).where("not is_primary"))


@query("""SELECT accn, coalesce(a.cik, b.cik) AS cik, coalesce(a.form, b.form) AS form, least(a.disseminated_at, b.disseminated_at) AS disseminated_at
          FROM (SELECT * FROM filings WHERE filed_at < DATE '1997-01-01') a FULL OUTER JOIN (SELECT accn, cik, form, filed_at + 3 AS disseminated_at FROM filings) b USING (accn)""", "filings")  # fmt: skip
def dissemination_least(spark, d):
    f = p.filings(spark, d)
    seen = f.withColumn("disseminated_at", F.date_add("filed_at", 3))
    return store.record_dissemination(f.where("filed_at < '1997-01-01'"), seen).select("accn", "cik", "form", "disseminated_at")


# Features and panels


@query("SELECT DISTINCT cik, taxonomy, period_start, period_end FROM facts WHERE concept = 'A' AND unit = 'USD' AND date_diff('day', period_start, period_end) BETWEEN 60 AND 120", "facts")
def annual_periods(spark, d):
    return features.annual_periods(p.facts(spark, d), SPEC)


def _accruals(arm: str):
    @query(f"SELECT cik, taxonomy, period_start, period_end, round(value, 6) AS value, knowledge_date, uses_restated_input, drop_reason FROM features WHERE arm = '{arm}'", "features")
    def run(spark, d):
        return features.accruals(p.facts(spark, d), SPEC).where(F.col("arm") == arm).drop("arm", "in_all_arms")

    return run


for _arm, _name in (("first_reported", "accruals_first"), ("restated_values", "accruals_restated"), ("naive_vendor", "accruals_naive")):
    _run = _accruals(_arm)
    QUERIES[_name], SQL[_name] = QUERIES.pop("run"), SQL.pop("run")


@query(f"SELECT arm, {GRAIN}, value, knowledge_date, is_restated FROM arms", "arms")
def vintage_arms(spark, d):
    return features.vintage_arms(p.facts(spark, d))


@query("""SELECT a.cik, a.taxonomy, a.period_end, round(a.value - b.value, 6) AS gap FROM features a JOIN features b
          ON a.arm = 'restated_values' AND b.arm = 'first_reported' AND a.cik = b.cik AND a.taxonomy = b.taxonomy AND a.period_start = b.period_start AND a.period_end = b.period_end
          WHERE a.value IS NOT NULL AND b.value IS NOT NULL""", "features")  # fmt: skip
def accrual_vintage_gap(spark, d):
    rows = features.accruals(p.facts(spark, d), SPEC).groupBy("cik", "taxonomy", "period_start", "period_end")
    of = lambda arm: F.max(F.when(F.col("arm") == arm, F.col("value")))
    return rows.agg((of("restated_values") - of("first_reported")).alias("gap")).where("gap is not null").select("cik", "taxonomy", "period_end", "gap")


_KEYS = ("cik", "taxonomy")


@query("SELECT arm, cik, taxonomy, formation_date, round(p[3], 6) AS value, p[1] AS knowledge_date, p[2] AS period_end FROM picked", "picked")
def panel_asof_pick(spark, d):
    return panel.pick_freshest(features.accruals(p.facts(spark, d), SPEC), FORMATIONS, _KEYS)


@query("""SELECT arm, cik, taxonomy, formation_date, round(p[3], 6) AS value FROM (SELECT *, count(*) FILTER (WHERE p[3] IS NOT NULL) OVER (PARTITION BY cik, taxonomy, formation_date) AS n FROM picked) WHERE n = 3""", "picked")
def panel_common_universe(spark, d):
    picked = panel.pick_freshest(features.accruals(p.facts(spark, d), SPEC), FORMATIONS, _KEYS)
    return panel.common_universe(picked, 3, _KEYS).select("arm", "cik", "taxonomy", "formation_date", "value")


@query("""SELECT reason, count(*) AS n FROM (
            SELECT reason FROM company_years WHERE n >= 2 AND NOT in_all_arms AND reason <> 'NO_PRIOR_YEAR'
            UNION ALL SELECT DISTINCT ON (cik, taxonomy) CASE WHEN n < 2 THEN 'NO_ANNUAL_PERIOD' ELSE 'NO_PRIOR_YEAR' END FROM company_years WHERE n < 2 OR n_full = 0) GROUP BY 1
          UNION ALL SELECT 'NOT_YET_FILED', count(*) FROM (SELECT 1 FROM picked GROUP BY cik, taxonomy, formation_date HAVING count(p[3]) < 3)""", "company_years", "picked")  # fmt: skip
def drop_reasons(spark, d):
    rows = features.accruals(p.facts(spark, d), SPEC)
    return panel.drop_reasons(rows, panel.pick_freshest(rows, FORMATIONS, _KEYS), 3, _KEYS)


# Backtest


def _quotes(spark, d):
    return backtest.quotes(signals(spark, d), p.prices(spark, d), PLAN)


@query("SELECT symbol, formation_date, round(value, 6) AS value, rank, n_ranked, bucket, side FROM sides", "sides")
def quantile_sides(spark, d):
    return backtest.sides(_quotes(spark, d), PLAN).select("symbol", "formation_date", "value", "rank", "n_ranked", "bucket", "side")


@query("SELECT formation_date, symbol, round(weight, 6) AS weight, entry.day AS entry_date, exit.day AS exit_date, round(gross_return, 6) AS gross_return, round(cost, 6) AS cost, round(net_return, 6) AS net_return, round(participation_rate, 6) AS participation_rate FROM positions", "positions")
def position_returns(spark, d):
    return backtest.positions(_quotes(spark, d), PLAN).select("formation_date", "symbol", "weight", "entry_date", "exit_date", "gross_return", "cost", "net_return", "participation_rate")


@query("SELECT formation_date, entry_date, exit_date, n_positions, n_ranked, round(gross_return, 6) AS gross_return, round(net_return, 6) AS net_return, round(cost, 6) AS cost, round(turnover, 6) AS turnover, n_excluded, round(exclusion_rate, 6) AS exclusion_rate FROM periods", "periods")
def period_returns(spark, d):
    return backtest.periods(backtest.positions(_quotes(spark, d), PLAN, every=True))


@query("SELECT exclusion, count(*) AS n FROM listed_quotes WHERE exclusion IS NOT NULL GROUP BY 1", "listed_quotes")
def exclusions(spark, d):
    """With bars of listed days only: some symbols are listed late, some are delisted early, one is not traded for a week."""
    day = F.col("bar_date")
    listed = F.when(F.col("symbol").isin("S3", "S8"), day < "2024-01-15").when(F.col("symbol").isin("S5", "S11", "S17"), day >= "2024-01-11").otherwise(True)
    prices = p.prices(spark, d).where(listed & ((F.col("symbol") != "S2") | ~day.between("2024-01-09", "2024-01-14")))
    return backtest.exclusions(backtest.quotes(signals(spark, d), prices, PLAN))


@query("""SELECT n AS n_periods, round(CASE WHEN g <= 0 THEN -1.0 ELSE pow(g, 12.0 / n) - 1 END, 6) AS gross_annualised, round(CASE WHEN h <= 0 THEN -1.0 ELSE pow(h, 12.0 / n) - 1 END, 6) AS net_annualised,
            round(m, 6) AS net_mean, round(sd, 6) AS net_stdev, round(t, 6) AS mean_turnover, round(c, 6) AS mean_cost, n_thin, n_excluded,
            round(CASE WHEN sd = 0 THEN 0.0 ELSE m / sd END, 6) AS sharpe_per_period, round(CASE WHEN sd = 0 THEN 0.0 ELSE m / sd END * sqrt(12.0), 6) AS annualised_sharpe
          FROM (SELECT count(*) AS n, product(1 + gross_return) AS g, product(1 + net_return) AS h, avg(net_return) AS m, coalesce(stddev_samp(net_return), 0.0) AS sd, avg(turnover) AS t, avg(cost) AS c,
                count(*) FILTER (WHERE n_positions = 0) AS n_thin, CAST(sum(n_excluded) AS BIGINT) AS n_excluded FROM periods)""", "periods")  # fmt: skip
def annualised(spark, d):
    return backtest.arm_summary(backtest.periods(backtest.positions(_quotes(spark, d), PLAN, every=True)), 12.0)


@query("""SELECT symbol, count(*) AS n_bars, round(coalesce(greatest(0.0, avg(pair_spread)), 0.0), 6) AS spread, round(coalesce(avg(pair_spread), 0.0), 6) AS raw_mean_spread, count(pair_spread) AS n_pairs_used,
            count(*) FILTER (WHERE pair_spread < 0) AS n_pairs_negative, count(*) FILTER (WHERE is_pair AND pair_spread IS NULL) AS n_pairs_unusable,
            round(CASE WHEN count(log_return) >= 2 THEN stddev_samp(log_return) ELSE 0.0 END, 6) AS daily_volatility, round(coalesce(quantile_cont(mark * volume, 0.5) FILTER (WHERE volume > 0), 0.0), 6) AS dollar_volume
          FROM pairs GROUP BY 1""", "pairs")  # fmt: skip
def corwin_schultz(spark, d):
    return backtest.corwin_schultz(p.prices(spark, d))


# Statistics

#: Fixed values, not taken from the library: the normal quantile of 0.95, and what the best of ten standard normal ratios is expected to reach,
#: (1 - c) z(0.9) + c z(1 - 1 / (10 e)) with c = 0.5772156649 (Euler), z(0.9) = 1.2815515655, z(0.9632120559) = 1.7892417646.
_Z95, _BEST_OF_TEN = "1.644853626951", "1.574598301346"


@query("""SELECT strategy, n, round(m / sd, 6) AS sharpe, round(g1 * sqrt(n * (n - 1)) / (n - 2), 6) AS skewness, round((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6) + 3, 6) AS kurtosis,
            round(1 - (g1 * sqrt(n * (n - 1)) / (n - 2)) * (m / sd) + ((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6) + 2) / 4 * pow(m / sd, 2), 6) AS variance_factor
          FROM (SELECT strategy, count(*) AS n, any_value(mu) AS m, stddev_samp(ret) AS sd, avg(pow(ret - mu, 3)) / pow(stddev_pop(ret), 3) AS g1, avg(pow(ret - mu, 4)) / pow(stddev_pop(ret), 4) - 3 AS g2
                FROM (SELECT *, avg(ret) OVER (PARTITION BY strategy) AS mu FROM returns) GROUP BY 1)""", "returns")  # fmt: skip
def sharpe_moments(spark, d):
    return statistics.sharpe_moments(returns(spark, d), "strategy")


@query("""SELECT strategy, obs AS test, round(p, 6) AS p, round(least(p * m, 1.0), 6) AS bonferroni,
            round(least(max(p * (m - k + 1)) OVER (PARTITION BY strategy ORDER BY k), 1.0), 6) AS holm, round(least(min(p * m * c / k) OVER (PARTITION BY strategy ORDER BY k DESC), 1.0), 6) AS bhy
          FROM (SELECT *, sum(1.0::DOUBLE / k) OVER (PARTITION BY strategy) AS c
                FROM (SELECT *, count(*) OVER (PARTITION BY strategy) AS m, row_number() OVER (PARTITION BY strategy ORDER BY p, obs) AS k
                      FROM (SELECT strategy, obs, (abs(CAST(round(ret * 1000000) AS BIGINT)) % 997) / 997.0::DOUBLE AS p FROM returns)))""", "returns")  # fmt: skip
def bonferroni_holm_bhy(spark, d):
    pv = (F.abs(F.round(F.col("ret") * 1000000).cast("long")) % 997) / F.lit(997.0)
    return statistics.adjusted_pvalues(returns(spark, d).select("strategy", F.col("obs").alias("test"), pv.alias("p")), "strategy")


@query("SELECT strategy, obs, CASE WHEN obs < 4 * 7 THEN obs // 7 ELSE 4 + (obs - 28) // 6 END AS block FROM returns", "returns")
def block_index(spark, d):
    return returns(spark, d).select("strategy", "obs", statistics.block_of(F.col("obs"), 40, 6).cast("long").alias("block"))


@query("""SELECT CAST(split AS INTEGER) AS split, strategy AS winner, round(rank / (n + 1.0::DOUBLE), 6) AS oos_rank, round(ln((rank / (n + 1.0::DOUBLE)) / (1 - rank / (n + 1.0::DOUBLE))), 6) AS logit, round(o - i, 6) AS degradation
          FROM (SELECT *, row_number() OVER (PARTITION BY split ORDER BY i DESC, strategy) AS place
                FROM (SELECT *, row_number() OVER (PARTITION BY split ORDER BY o, strategy) AS rank, count(*) OVER (PARTITION BY split) AS n
                      FROM (SELECT split, strategy, max(score) FILTER (WHERE inside) AS i, max(score) FILTER (WHERE NOT inside) AS o
                            FROM (SELECT split, strategy, list_contains(chosen, obs // 4) AS inside, avg(ret) / stddev_samp(ret) AS score
                                  FROM returns, (SELECT row_number() OVER (ORDER BY chosen) - 1 AS split, chosen
                                                 FROM (SELECT list_filter(range(10), lambda b: (m >> b) & 1 = 1) AS chosen FROM (SELECT unnest(range(1024)) AS m)) WHERE len(chosen) = 5) GROUP BY ALL) GROUP BY 1, 2))) WHERE place = 1""", "returns")  # fmt: skip
def backtest_overfitting(spark, d):
    return statistics.backtest_overfitting(returns(spark, d))


_CDF = "0.5 + sign(z) * exp(-z * z / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(200), lambda k: exp((2 * k + 1) * ln(abs(z)) - lgamma(2 * k + 2.0) + k * ln(2.0) + lgamma(k + 1.0))))"


@query(f"""SELECT strategy, n, round(sharpe, 6) AS sharpe, round(skewness, 6) AS skewness, round(kurtosis, 6) AS kurtosis, round(vf, 6) AS variance_factor,
             round(CASE WHEN sharpe > 0 THEN 1 + vf * pow({_Z95} / sharpe, 2) ELSE 'inf'::DOUBLE END, 6) AS min_track_record,
             round({_CDF}, 6) AS deflated_sharpe, round(bar, 6) AS expected_max_sharpe, {_CDF} > 0.95 AS survives
           FROM (SELECT *, (sharpe - bar) * sqrt(n - 1) / sqrt(vf) AS z
                 FROM (SELECT *, sqrt(var_samp(sharpe) OVER ()) * {_BEST_OF_TEN} AS bar, 1 - skewness * sharpe + (kurtosis - 1) / 4 * pow(sharpe, 2) AS vf
                       FROM (SELECT strategy, n, m / sd AS sharpe, g1 * sqrt(n * (n - 1)) / (n - 2) AS skewness, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6) + 3 AS kurtosis
                             FROM (SELECT strategy, count(*) AS n, any_value(mu) AS m, stddev_samp(ret) AS sd, avg(pow(ret - mu, 3)) / pow(stddev_pop(ret), 3) AS g1, avg(pow(ret - mu, 4)) / pow(stddev_pop(ret), 4) - 3 AS g2
                                   FROM (SELECT *, avg(ret) OVER (PARTITION BY strategy) AS mu FROM returns) GROUP BY 1))))""", "returns")  # fmt: skip
def deflated_sharpe(spark, d):
    """Against the luck of ten trials, as many as the table has strategies."""
    return statistics.deflated_sharpe(statistics.minimum_track_record(statistics.sharpe_moments(returns(spark, d), "strategy")))


@query("""SELECT strategy, split, role, count(*) AS n, CAST(sum(CAST(round(ret * 1000000) AS BIGINT)) AS BIGINT) AS total FROM (
            SELECT strategy, ret, s AS split, CASE WHEN obs // 8 = s THEN 'test' WHEN obs >= s * 8 - 2 AND obs < s * 8 + 10 THEN 'purged' WHEN obs > s * 8 AND obs < s * 8 + 13 THEN 'embargoed' ELSE 'train' END AS role
            FROM returns, (SELECT unnest(range(5)) AS s)) GROUP BY 1, 2, 3""", "returns")  # fmt: skip
def purged_kfold(spark, d):
    """Summed returns (in millionths) by role: the splits are a small table made of the parameters."""
    splits = statistics.purged_splits(spark, 40, 5, 1, horizon=2, embargo=5)
    rows = returns(spark, d).join(F.broadcast(splits), "obs")
    return rows.groupBy("strategy", F.col("split").cast("long").alias("split"), "role").agg(F.count("*").alias("n"), F.sum(F.round(F.col("ret") * 1000000).cast("long")).alias("total"))


# Hashes and texts


@query("""SELECT accn, concept, value, sha256('[' || CAST(cik AS VARCHAR) || ',"' || taxonomy || '","' || concept || '","' || unit || '",' || coalesce('"' || CAST(period_start AS VARCHAR) || '"', 'null') || ',"' || CAST(period_end AS VARCHAR) || '","' || accn || '"]') AS fact_key
          FROM facts""", "facts")  # fmt: skip
def fact_key_sha256(spark, d):
    return p.facts(spark, d).select("accn", "concept", "value", hashing.fact_key().alias("fact_key"))


@query("SELECT doc_id, content_sha256, byte_len FROM payloads", "payloads")
def content_hash(spark, d):
    return p.payloads(spark, d)


@query("SELECT page_id, regexp_replace(url || '?apikey=' || CAST(page_id AS VARCHAR) || '&q=1', '([?&](apikey|api_key|token|key|access_token)=)[^&#]*', '\\1***', 'gi') AS uri FROM pages")
def redact_uri(spark, d):
    pages = spark.read.parquet(f"{d}/pages.parquet")
    return pages.select("page_id", scalars.redact_uri(F.concat("url", F.lit("?apikey="), F.col("page_id").cast("string"), F.lit("&q=1"))).alias("uri"))


@query("SELECT o_orderkey, array_to_string(list_filter(list_transform(str_split(o_orderpriority || ' , ,' || o_orderstatus, ','), lambda x: trim(x)), lambda x: x <> ''), '|') AS items FROM orders")
def parse_items(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    return o.select("o_orderkey", F.array_join(scalars.parse_items(F.concat("o_orderpriority", F.lit(" , ,"), "o_orderstatus")), "|").alias("items"))


@query(f"""WITH RECURSIVE entries AS (SELECT *, row_number() OVER (PARTITION BY log ORDER BY line, body, changed) AS k FROM (SELECT l_orderkey AS log, l_linenumber AS line,
                 '{{"l_partkey":' || CAST(l_partkey AS VARCHAR) || ',"l_suppkey":' || CAST(l_suppkey AS VARCHAR) || '}}' AS body, l_quantity = 50 AS changed FROM lineitem)),
           chain AS (SELECT log, k, sha256('{hashing.GENESIS}' || body) AS head FROM entries WHERE k = 1
                     UNION ALL SELECT e.log, e.k, sha256(c.head || e.body) FROM chain c JOIN entries e ON e.log = c.log AND e.k = c.k + 1),
           stored AS (SELECT e.log, e.k, CASE WHEN changed THEN replace(body, 'partkey', 'part') ELSE body END AS body, head, lag(head) OVER (PARTITION BY e.log ORDER BY e.k) AS before
                      FROM entries e JOIN chain c ON e.log = c.log AND e.k = c.k)
           SELECT log, count(*) AS entries, CAST(coalesce(min(CASE WHEN sha256(coalesce(before, '{hashing.GENESIS}') || body) <> head THEN k - 1 END), -1) AS BIGINT) AS first_break FROM stored GROUP BY 1""")  # fmt: skip
def chain_fold_verify(spark, d):
    """A hash chain over each order's lines, of which some were changed after their heads were recorded: the first that does not follow."""
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    body = F.to_json(F.struct("l_partkey", "l_suppkey")).alias("body")
    logs = li.groupBy(F.col("l_orderkey").alias("log")).agg(F.sort_array(F.collect_list(F.struct("l_linenumber", body, (F.col("l_quantity") == 50).alias("changed")))).alias("e"))
    recorded = logs.select("log", F.posexplode(F.arrays_zip("e", hashing.chain_heads(F.col("e.body")).alias("head"))).alias("line", "r"))
    changed = F.when(F.col("r.e.changed"), F.replace(F.col("r.e.body"), F.lit("partkey"), F.lit("part"))).otherwise(F.col("r.e.body"))
    stored = recorded.select("log", "line", changed.alias("body"), "r.head")
    return hashing.chain_breaks(stored, "log", "line").withColumn("first_break", F.col("first_break").cast("long"))


@query("SELECT period_end, CASE WHEN period_start IS NULL THEN 'instant, ' || CAST(period_end AS VARCHAR) ELSE CAST(period_start AS VARCHAR) || ' to ' || CAST(period_end AS VARCHAR) || ' (' || CAST(date_diff('day', period_start, period_end) AS VARCHAR) || 'd)' END AS label, count(*) AS n FROM facts GROUP BY 1, 2", "facts")
def period_labels(spark, d):
    return p.facts(spark, d).groupBy("period_end", scalars.period_label(F.col("period_start"), F.col("period_end")).alias("label")).agg(F.count("*").alias("n"))


# Smaller reads and rules


@query("SELECT accn, cik, form, knowledge_date FROM company_filings WHERE knowledge_date <= DATE '2000-06-30' AND knowledge_date >= DATE '1999-01-01' AND form IN ('10-K', '10-Q')", "company_filings")
def asof_filings(spark, d):
    return AsOf(tables(spark, d), DAY).filings(forms=["10-K", "10-Q"], since=date(1999, 1, 1)).select("accn", "cik", "form", "knowledge_date")


@query("""SELECT accn, cik, form, round(mean_lag, 6) AS mean_lag FROM habits WHERE n_priors >= 4 AND knowledge_date <= DATE '2000-06-30' AND
          list_contains(items, '4.02') = false AND form = '10-Q'""", "habits")  # fmt: skip
def filing_habits(spark, d):
    rows = forensics.filing_lags(_filings(spark, d)).where((F.col("n_priors") >= 4) & ~scalars.has_item(F.col("items"), "4.02") & (F.col("form") == "10-Q"))
    return rows.where("knowledge_date <= '2000-06-30'").select("accn", "cik", "form", "mean_lag")


@query("SELECT cik, name, nullif(sic, '') AS sic FROM entities WHERE cik = 17", "entities")
def entity_lookup(spark, d):
    return AsOf(tables(spark, d), DAY).entity(17)


@query("SELECT DISTINCT ticker FROM identifiers WHERE cik = 7", "identifiers")
def entity_tickers(spark, d):
    return AsOf(tables(spark, d), DAY).tickers(7)


@query("SELECT max(filed_at) AS data_vintage FROM filings", "filings")
def data_vintage(spark, d):
    return p.filings(spark, d).agg(F.max("filed_at").alias("data_vintage"))


@query("SELECT concept, count(*) AS facts, count(*) FILTER (WHERE restated) AS revised, round(count(*) FILTER (WHERE restated) / count(*), 6) AS share FROM per_fact GROUP BY 1", "per_fact")
def revision_coverage(spark, d):
    rows = corpus.per_fact(p.facts(spark, d)).groupBy("concept").agg(F.count("*").alias("facts"), F.count_if("restated").alias("revised"))
    return rows.withColumn("share", corpus.share(F.col("revised"), F.col("facts")))


@query("SELECT event_type AS source, count(*) AS runs, max(ts) AS last_started FROM events GROUP BY 1")
def runs_by_source(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.groupBy(F.col("event_type").alias("source")).agg(F.count("*").alias("runs"), F.max("ts").alias("last_started"))


def _run_log(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "signup", "running").otherwise("ok")
    return e.select((F.col("event_id") % 1000).cast("string").alias("run_id"), status.alias("status"), F.col("event_id").alias("ts"), (F.col("event_id") % 17).alias("rows_written"))


@query("""SELECT run_id, CASE WHEN s = 'running' THEN 'interrupted' ELSE s END AS status, rows_written
          FROM (SELECT CAST(event_id % 1000 AS VARCHAR) AS run_id, arg_max(CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'running' ELSE 'ok' END, event_id) AS s, max(event_id % 17) AS rows_written
                FROM events GROUP BY 1)""")  # fmt: skip
def run_states(spark, d):
    return store.interrupted(store.run_states(_run_log(spark, d)))


@query("""WITH o AS (SELECT 'S' || CAST(user_id % 40 AS VARCHAR) AS source, event_id AS seq, CASE WHEN value < 60 THEN 'failed' ELSE 'ok' END AS outcome FROM events),
          g AS (SELECT *, sum(CASE WHEN outcome = 'failed' THEN 0 ELSE 1 END) OVER (PARTITION BY source ORDER BY seq) AS g FROM o),
          c AS (SELECT *, CAST(sum(CASE WHEN outcome = 'failed' THEN 1 ELSE 0 END) OVER (PARTITION BY source, g ORDER BY seq) AS BIGINT) AS failures_in_row FROM g),
          m AS (SELECT *, min(CASE WHEN failures_in_row >= 5 THEN seq END) OVER (PARTITION BY source) AS opened FROM c)
          SELECT source, seq, outcome, failures_in_row FROM m WHERE opened IS NULL OR seq <= opened""")  # fmt: skip
def circuit_breaker(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    outcome = F.when(F.col("value") < 60, "failed").otherwise("ok")
    return store.broken_after(e.select(F.concat(F.lit("S"), (F.col("user_id") % 40).cast("string")).alias("source"), F.col("event_id").alias("seq"), outcome.alias("outcome")))


@query("SELECT symbol, round(0.1 * CASE WHEN count(log_return) >= 2 THEN stddev_samp(log_return) ELSE 0.0 END * sqrt(0.04), 6) AS impact FROM pairs GROUP BY 1", "pairs")
def impact_cost(spark, d):
    rows = backtest.corwin_schultz(p.prices(spark, d))
    return rows.select("symbol", backtest.impact_cost(F.lit(0.04), F.col("daily_volatility")).alias("impact"))


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, CAST(TRY_CAST(strftime(o_orderdate, '%Y-%m-') || CAST(20 + o_orderkey % 15 AS VARCHAR) AS DATE) AS DATE) AS parsed FROM orders")
def parse_dates(spark, d):
    """Dates as texts, some of which do not exist."""
    o = spark.read.parquet(f"{d}/orders.parquet")
    text = F.concat(F.date_format("o_orderdate", "yyyy-MM-"), (20 + F.col("o_orderkey") % 15).cast("string"))
    return o.select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"), scalars.parse_date(text).alias("parsed"))


@query("""SELECT CAST(last_day(CAST(o_orderdate AS DATE) + to_months(CAST(k AS INTEGER))) AS DATE) AS month_end, count(*) AS n FROM orders, (SELECT unnest(range(4)) AS k)
          WHERE last_day(CAST(o_orderdate AS DATE) + to_months(CAST(k AS INTEGER))) <= last_day(CAST(o_orderdate AS DATE) + 75) GROUP BY 1""")  # fmt: skip
def month_ends(spark, d):
    """The month ends that the 75 days after each order touch."""
    o = spark.read.parquet(f"{d}/orders.parquet")
    first = F.col("o_orderdate").cast("date")
    return o.select(F.explode(scalars.month_ends(first, F.date_add(first, 75))).alias("month_end")).groupBy("month_end").agg(F.count("*").alias("n"))


@query("SELECT cik FROM (SELECT p_partkey AS cik, p_retailprice AS val FROM part) WHERE val >= 905 ORDER BY sha256('7:' || CAST(cik AS VARCHAR)), cik LIMIT 30")
def universe_sample(spark, d):
    """A sampling operator: thirty companies by the digest of a seed and their number."""
    from vintara.sources.landing import sampled_universe

    part = spark.read.parquet(f"{d}/part.parquet")
    return sampled_universe(part.select(F.col("p_partkey").alias("cik"), F.col("p_retailprice").alias("val")), 905, 30, 7)


@query("""SELECT split, strategy, role, count(*) AS n, round(sum(ret), 6) AS total_return FROM (
            SELECT r.strategy, r.ret, s.split, CASE WHEN o // 5 IN (s.a, s.b) THEN 'test' WHEN (o >= s.a * 5 - 1 AND o < s.a * 5 + 6) OR (o >= s.b * 5 - 1 AND o < s.b * 5 + 6) THEN 'purged'
                   WHEN (o > s.a * 5 AND o < s.a * 5 + 7) OR (o > s.b * 5 AND o < s.b * 5 + 7) THEN 'embargoed' ELSE 'train' END AS role
            FROM (SELECT strategy, ret, obs AS o FROM returns) r, (SELECT row_number() OVER (ORDER BY x.a, y.b) - 1 AS split, x.a, y.b FROM (SELECT unnest(range(8)) AS a) x, (SELECT unnest(range(8)) AS b) y WHERE x.a < y.b) s)
          GROUP BY 1, 2, 3""", "returns")  # fmt: skip
def combinatorial_purged_splits(spark, d):
    """Each strategy's return in and out of sample over all splits with two test groups of eight; no join, each observation meets its splits in its row."""
    rows = statistics.split_roles(returns(spark, d), "obs", 40, 8, 2, horizon=1, embargo=2)
    return rows.groupBy(F.col("split").cast("long").alias("split"), "strategy", "role").agg(F.count("*").alias("n"), F.sum("ret").alias("total_return"))


@query("SELECT accn, cik, starts_with(accn, lpad(CAST(cik AS VARCHAR), 10, '0')) AS is_primary FROM filings", "filings")
def submission_links(spark, d):
    return store.submission_links(p.filings(spark, d))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN f = CAST(f AS BIGINT) THEN CAST(CAST(f AS BIGINT) AS VARCHAR) ELSE CAST(f AS VARCHAR) END AS text FROM (SELECT l_orderkey, l_linenumber, l_discount * 100 AS d, round(l_quantity / 4, 2) AS f FROM lineitem)")
def plain_numbers(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    return li.select("l_orderkey", "l_linenumber", scalars.plain_number(F.round(F.col("l_quantity") / 4, 2).cast("decimal(38,10)")).alias("text"))


@query("""SELECT arm, count(*) AS n, bit_xor(h) AS digest, CAST(sum(h) AS VARCHAR) AS total
          FROM (SELECT DISTINCT arm, CAST('0x' || substr(md5(cik || '|' || taxonomy || '|' || formation_date), 1, 15) AS BIGINT) AS h
                FROM (SELECT *, count(*) FILTER (WHERE p[3] IS NOT NULL) OVER (PARTITION BY cik, taxonomy, formation_date) AS k FROM picked) WHERE k = 3) GROUP BY 1""", "picked")  # fmt: skip
def universe_digests(spark, d):
    """One digest of the names of each arm; the arms of a common universe have the same."""
    picked = panel.pick_freshest(features.accruals(p.facts(spark, d), SPEC), FORMATIONS, _KEYS)
    return panel.universe_digests(panel.common_universe(picked, 3, _KEYS), _KEYS)


@query("""SELECT a.arm, a.formation_date, count(*) AS n FROM (SELECT * FROM picked WHERE p[3] IS NOT NULL) a
          JOIN (SELECT cik, taxonomy, formation_date FROM picked WHERE p[3] IS NOT NULL GROUP BY ALL HAVING count(DISTINCT arm) = 3) f
            ON a.cik = f.cik AND a.taxonomy = f.taxonomy AND a.formation_date = f.formation_date GROUP BY 1, 2""", "picked")  # fmt: skip
def panel_sizes(spark, d):
    """The same number of names in every arm."""
    picked = panel.pick_freshest(features.accruals(p.facts(spark, d), SPEC), FORMATIONS, _KEYS)
    return panel.common_universe(picked, 3, _KEYS).groupBy("arm", "formation_date").agg(F.count("*").alias("n"))


from vintara.plans import landed  # noqa: E402, F401  its queries register themselves here
