"""As-of reads: what was knowable on a date, and nothing later.

Every read filters on the knowledge date and carries a guard that raises on a row beyond it. The guard is a filter, so
no pruning of columns can drop it.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date
from typing import Any

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from vintara.errors import AmbiguousPeriod, InsufficientData
from vintara.operators.views import company_filings, fact_revisions, facts_pit
from vintara.schemas import GRAIN


class _Instant:
    def __repr__(self) -> str:
        return "INSTANT"


#: As a period start: only facts of an instant. None does not filter, a date filters by equality.
INSTANT: Any = _Instant()
DEFAULT_TAXONOMY = "us-gaap"


def _date(day: date) -> Column:
    return F.lit(day.isoformat()).cast("date")


def guard(df: DataFrame, day: date, column: str = "knowledge_date") -> DataFrame:
    """Raises at execution if a row became knowable after ``day``."""
    message = F.concat(F.lit(f"a row known on "), F.col(column).cast("string"), F.lit(f" reached a read as of {day}"))
    return df.where(F.when(F.col(column) <= _date(day), F.lit(True)).otherwise(F.raise_error(message).cast("boolean")))


def pin_start(start: Any) -> Column:
    if start is None:
        return F.lit(True)
    return F.col("period_start").isNull() if start is INSTANT else F.col("period_start") == _date(start)


def ambiguous_ends(facts: DataFrame) -> DataFrame:
    """Ends of periods that several periods share: (cik, taxonomy, concept, unit, period_end, starts); an instant is one of them."""
    starts = F.countDistinct(F.struct("period_start"))
    return facts.groupBy("cik", "taxonomy", "concept", "unit", "period_end").agg(starts.alias("starts")).where("starts > 1")


#: Facts that share these answer the same question, unless their periods begin on different days.
QUESTION = ["cik", "taxonomy", "concept", "period_end"]


def one_period(rows: DataFrame) -> DataFrame:
    """Raises at execution where several periods share an end: a year and its last quarter, or a period and an instant.

    Least and greatest start by window; the check is a filter, so no pruning of columns drops it.
    """
    same = Window.partitionBy(*QUESTION)
    start = F.coalesce(F.col("period_start"), F.lit("0001-01-01").cast("date"))
    message = F.concat(F.col("concept"), F.lit(" of "), F.col("cik").cast("string"), F.lit(" ending "), F.col("period_end").cast("string"), F.lit(": several periods end together; pin period_start"))
    rows = rows.withColumns({"_least": F.min(start).over(same), "_greatest": F.max(start).over(same)})
    return rows.where(F.when(F.col("_least") == F.col("_greatest"), F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))).drop("_least", "_greatest")


def latest_per_grain(facts: DataFrame) -> DataFrame:
    """The last report of each fact; a limit of one row per window group, so it is cut down before the shuffle."""
    last = Window.partitionBy(*GRAIN).orderBy(F.desc("knowledge_date"), F.desc("accn"), F.desc("value"))
    return facts.withColumn("_r", F.row_number().over(last)).where("_r = 1").drop("_r")


@dataclass(frozen=True)
class AsOf:
    """The world as known on ``as_of``; the tables are facts with knowledge_date, filings, filers, entities, identifiers, macro, prices."""

    tables: dict[str, DataFrame]
    as_of: date

    def _known(self, facts: DataFrame) -> DataFrame:
        """filed_at is never after the knowledge date; its filter reaches the scan's row groups."""
        return facts.where((F.col("filed_at") <= _date(self.as_of)) & (F.col("knowledge_date") <= _date(self.as_of)))

    def _pick(self, facts: DataFrame, cik, concept, period_end, period_start, taxonomy, unit) -> DataFrame:
        for column, value in (("cik", cik), ("concept", concept), ("taxonomy", taxonomy), ("unit", unit)):
            if value is not None:
                facts = facts.where(F.col(column) == value)
        if period_end is not None:
            facts = facts.where(F.col("period_end") == _date(period_end))
        return facts.where(pin_start(period_start))

    def facts(self, cik=None, concept=None, *, period_end=None, period_start=None, taxonomy=DEFAULT_TAXONOMY, unit=None, limit=None) -> DataFrame:
        """The latest knowable report of each fact."""
        out = guard(latest_per_grain(self._known(self._pick(self.tables["facts"], cik, concept, period_end, period_start, taxonomy, unit))), self.as_of)
        if limit is None:
            return out
        return out.orderBy(F.desc("period_end"), "unit", "period_start").limit(limit)

    def marked_facts(self, cik=None, concept=None, *, period_end=None, period_start=None, taxonomy=DEFAULT_TAXONOMY, unit=None) -> DataFrame:
        """The rows of :meth:`facts` with what a reader wants to know of each, see :func:`with_fact_properties`. One exchange serves both windows."""
        chain = facts_pit(self._pick(self.tables["facts"], cik, concept, period_end, period_start, taxonomy, unit))
        return with_fact_properties(guard(latest_per_grain(self._known(chain)), self.as_of))

    def fact(self, cik, concept, *, period_end=None, period_start=None, taxonomy=DEFAULT_TAXONOMY, unit=None) -> Row:
        """The newest period's fact; raises if there is none, or if several periods share its end."""
        rows = self.facts(cik, concept, period_end=period_end, period_start=period_start, taxonomy=taxonomy, unit=unit)
        return _one(rows.orderBy(F.desc("period_end"), "unit", "period_start"), f"{concept} of {cik} as of {self.as_of}")

    def value(self, cik, concept, **pins):
        return self.fact(cik, concept, **pins)["value"]

    def first_reported(self, cik=None, concept=None, *, period_end=None, period_start=None, taxonomy=DEFAULT_TAXONOMY, unit=None) -> DataFrame:
        """First reports, if knowable; the chain is numbered over all reports, which later ones cannot change.

        With an end and no start it is asked for one period: raises where several of them end together, see :func:`one_period`.
        """
        rows, asked = self._asked(cik, concept, period_end, period_start, taxonomy, unit)
        rows = guard(self._known(facts_pit(rows).where("report_seq = 1")), self.as_of).drop("period_distinct_values")
        return one_period(rows) if asked else rows

    def _asked(self, cik, concept, period_end, period_start, taxonomy, unit) -> tuple[DataFrame, bool]:
        """The facts in question, and whether one period is asked for without saying where it begins.

        If so they are dealt out by question, which serves the windows over chains too: one exchange for both.
        """
        rows, asked = self._pick(self.tables["facts"], cik, concept, period_end, period_start, taxonomy, unit), period_end is not None and period_start is None
        return (rows.repartition(*QUESTION) if asked else rows), asked

    def unsafe_latest_restated(self, cik=None, concept=None, *, period_end=None, period_start=None, taxonomy=DEFAULT_TAXONOMY, unit=None) -> DataFrame:
        """Today's values, whatever the date: for comparison only. Raises like :meth:`first_reported` where several periods end together."""
        rows, asked = self._asked(cik, concept, period_end, period_start, taxonomy, unit)
        return one_period(latest_per_grain(rows)) if asked else latest_per_grain(rows)

    def revisions(self, cik=None, *, concept=None, taxonomy=DEFAULT_TAXONOMY, min_relative_change=None) -> DataFrame:
        """Pairs of consecutive reports with different values; from a base of zero every change is large enough."""
        rows = fact_revisions(self._pick(self.tables["facts"], cik, concept, None, None, taxonomy, None))
        rows = guard(self._known(rows.where(F.col("value") != F.col("prior_value"))), self.as_of)
        rows = with_revision_measures(rows)
        if min_relative_change is not None:
            rows = rows.where((F.abs("relative_change") >= min_relative_change) | ((F.col("prior_value") == 0) & (F.col("value") != 0)))
        return rows

    def filings(self, cik=None, *, forms=None, since=None, limit=None) -> DataFrame:
        rows = company_filings(self.tables["filings"], self.tables["filers"])
        rows = rows.where((F.col("filed_at") <= _date(self.as_of)) & (F.col("knowledge_date") <= _date(self.as_of)))
        if cik is not None:
            rows = rows.where(F.col("cik") == cik)
        if forms is not None:
            rows = rows.where(F.col("form").isin(list(forms)))
        if since is not None:
            rows = rows.where(F.col("knowledge_date") >= _date(since))
        rows = guard(rows, self.as_of)
        return rows if limit is None else rows.orderBy(F.desc("knowledge_date"), "accn", "cik").limit(limit)

    def entity(self, cik) -> DataFrame:
        """Not point in time: names and codes are today's. An empty code is null."""
        return self.tables["entities"].where(F.col("cik") == cik).withColumn("sic", F.nullif("sic", F.lit("")))

    def tickers(self, cik) -> DataFrame:
        """Not point in time."""
        return self.tables["identifiers"].where(F.col("cik") == cik).select("ticker").distinct().orderBy("ticker")

    def macro_series(self, series_id=None, *, start=None, end=None) -> DataFrame:
        """Each observation's latest vintage, then without those whose latest vintage is empty."""
        rows = self.tables["macro"].where(F.col("realtime_start") <= _date(self.as_of))
        if series_id is not None:
            rows = rows.where(F.col("series_id") == series_id)
        if start is not None:
            rows = rows.where(F.col("obs_date") >= _date(start))
        if end is not None:
            rows = rows.where(F.col("obs_date") <= _date(end))
        last = rows.groupBy("series_id", "obs_date").agg(F.max_by("value", "realtime_start").alias("value"), F.max("realtime_start").alias("realtime_start"))
        return guard(last.where("value is not null"), self.as_of, "realtime_start")

    def macro(self, series_id, obs_date) -> float:
        row = self.macro_series(series_id, start=obs_date, end=obs_date).first()
        if row is None:
            raise InsufficientData(f"{series_id} at {obs_date} was not published by {self.as_of}")
        return row["value"]

    def prices(self, symbol=None, *, execution_lag_days: int, start=None, end=None) -> DataFrame:
        """Bars up to the date, with the day from which they can be acted on."""
        if execution_lag_days < 0:
            raise ValueError("a lag is not negative")
        stop = min(end or self.as_of, self.as_of)
        rows = self.tables["prices"].where(F.col("bar_date") <= _date(stop))
        if symbol is not None:
            rows = rows.where(F.col("symbol") == symbol)
        if start is not None:
            rows = rows.where(F.col("bar_date") >= _date(start))
        return guard(rows.withColumn("tradable_from", F.date_add("bar_date", execution_lag_days)), self.as_of, "bar_date")


def _one(rows: DataFrame, what: str) -> Row:
    """Of the first row's end and unit there may be one period only. A read for one company: at most a few rows arrive."""
    first = rows.first()
    if first is None:
        raise InsufficientData(f"nothing published for {what}")
    same = rows.where((F.col("period_end") == F.lit(first["period_end"])) & (F.col("unit") == first["unit"]))
    spans = same.groupBy("period_start").agg(F.first("period_end").alias("period_end")).orderBy(F.col("period_start").asc_nulls_last()).collect()
    if len(spans) > 1:
        told = ", ".join(f"{s['period_start']} to {s['period_end']} ({(s['period_end'] - s['period_start']).days}d)" if s["period_start"] else f"instant, {s['period_end']}" for s in spans)
        raise AmbiguousPeriod(f"{what}: several periods end together: {told}; pin period_start")
    return first


def with_fact_properties(chain: DataFrame) -> DataFrame:
    """Rows of a chain with is_first_report, value_ever_changed, age_days (from the period's end to its becoming known), pin and mark.

    pin says how to ask for this very period; mark is restated where the value differs from the first report, re-presented where a later
    filing repeats it, empty for first reports: the place in the chain alone restates nothing.
    """
    first = F.col("report_seq") == 1
    mark = F.when(F.col("differs_from_first_report"), "restated").when(first, "").otherwise("re-presented")
    return chain.withColumns(
        {
            "is_first_report": first,
            "value_ever_changed": F.col("period_distinct_values") > 1,
            "age_days": F.datediff("knowledge_date", "period_end").cast("long"),
            "pin": F.coalesce(F.col("period_start").cast("string"), F.lit("instant")),
            "mark": mark,
        }
    )


def with_revision_measures(revisions: DataFrame) -> DataFrame:
    """relative_change (null from a zero base), absolute_change, days_between, in double where the reference value may be divided."""
    old, new = F.col("prior_value").cast("double"), F.col("value").cast("double")
    return revisions.withColumns(
        {
            "relative_change": F.try_divide(new - old, F.nullif(old, F.lit(0.0))),
            "absolute_change": new - old,
            "days_between": F.datediff("knowledge_date", "prior_knowledge_date").cast("long"),
        }
    )


def vintage_triples(facts: DataFrame, day: date) -> DataFrame:
    """For each fact known by ``day``: as known, as first reported, as it stands today, and five separate questions.

    One aggregation over the chain. "Superseded" compares documents, the others values: none follows from another.
    """
    order = F.struct("knowledge_date", "accn", "value")
    known = F.col("knowledge_date") <= _date(day)
    out = facts.groupBy(*GRAIN).agg(
        F.max(F.when(known, order)).alias("known"),
        F.min(order).alias("first"),
        F.max(order).alias("today"),
        (F.min("value") != F.max("value")).alias("value_ever_changed"),
    )
    out = out.where(F.col("known").isNotNull())
    first, today, then = F.col("first.value"), F.col("today.value"), F.col("known.value")
    return out.select(
        *GRAIN,
        then.alias("as_known"),
        first.alias("as_first_reported"),
        today.alias("as_it_stands_today"),
        F.try_divide(today.cast("double") - first.cast("double"), F.nullif(F.abs(first.cast("double")), F.lit(0.0))).alias("relative_drift"),
        (F.col("today.accn") != F.col("known.accn")).alias("is_restated"),
        (today != first).alias("value_changed"),
        (then != first).alias("already_restated_by_then"),
        (then == today).alias("known_is_current"),
        "value_ever_changed",
    )


def narrative(triples: DataFrame) -> DataFrame:
    """Which of the stories a triple tells: restated (before, current, intermediate), back again, re-presented, never."""
    story = (
        F.when(F.col("value_changed") & ~F.col("already_restated_by_then"), "restated later")
        .when(F.col("value_changed") & F.col("known_is_current"), "restated, current shown")
        .when(F.col("value_changed"), "restated, intermediate shown")
        .when(F.col("value_ever_changed"), "revised and back")
        .when(F.col("is_restated"), "re-presented")
        .otherwise("never")
    )
    return triples.withColumn("story", story)
