"""Triage of filings: flags, scores, confidence bands and the ranking of a day's filings."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vintara.functions.scalars import has_item

WEIGHTS = {
    "NON_RELIANCE": 5.0,
    "AUDITOR_CHANGE": 3.0,
    "LATE_NOTIFICATION": 2.0,
    "UNUSUAL_FILING_LAG": 1.5,
    "AMENDED_PERIODIC": 1.0,
    "DEPARTURE_ALONGSIDE": 1.0,
}
PERIODIC = ["10-K", "10-Q", "20-F"]
#: Earlier filings that a habit needs, and the days by which a filing exceeds a habit without spread.
LEAST_PRIORS, FLAT_DAYS, SIGMAS = 4, 5, 2.0


def filing_lags(filings: DataFrame) -> DataFrame:
    """Company filings (knowledge_date) with lag_days and the habit of the same company and form on strictly earlier days.

    A range window on the day number: no self-join, and filings of one day do not see each other.
    """
    lag = F.datediff("knowledge_date", "period_of_report").cast("double")
    day = F.datediff("knowledge_date", F.lit("1970-01-01").cast("date"))
    before = Window.partitionBy("cik", "form").orderBy("_day").rangeBetween(Window.unboundedPreceding, -1)
    rows = filings.withColumns({"lag_days": lag, "_day": day})
    rows = rows.withColumns({"n_priors": F.count("lag_days").over(before), "mean_lag": F.avg("lag_days").over(before), "sd_lag": F.stddev_samp("lag_days").over(before)})
    spread = F.when(F.col("sd_lag") > 0, F.col("lag_days") > F.col("mean_lag") + SIGMAS * F.col("sd_lag")).otherwise(F.col("lag_days") > F.col("mean_lag") + FLAT_DAYS)
    unusual = F.col("form").isin(PERIODIC) & (F.col("n_priors") >= LEAST_PRIORS) & spread
    return rows.withColumn("unusual_lag", F.coalesce(unusual, F.lit(False))).drop("_day")


def flags(filings: DataFrame) -> DataFrame:
    """Company filings with their flags, score and band."""
    rows = filing_lags(filings)
    items, form = F.col("items"), F.col("form")
    rules = {
        "NON_RELIANCE": has_item(items, "4.02"),
        "AUDITOR_CHANGE": has_item(items, "4.01"),
        "LATE_NOTIFICATION": form.isin("NT 10-K", "NT 10-Q", "NT 20-F"),
        "AMENDED_PERIODIC": form.isin([f"{x}/A" for x in PERIODIC]),
        "UNUSUAL_FILING_LAG": F.col("unusual_lag"),
    }
    found = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]))
    rows = rows.withColumn("flags", found)
    departure = has_item(items, "5.02") & (F.size("flags") > 0)
    rows = rows.withColumn("flags", F.when(departure, F.array_append("flags", F.lit("DEPARTURE_ALONGSIDE"))).otherwise(F.col("flags")))
    weight = F.create_map(*[x for n, w in WEIGHTS.items() for x in (F.lit(n), F.lit(w))])
    rows = rows.withColumn("score", F.aggregate("flags", F.lit(0.0), lambda total, f: total + F.element_at(weight, f)))
    band = (
        F.when(F.array_contains("flags", "NON_RELIANCE"), "CONFESSED")
        .when((F.size("flags") > 1) | (F.col("score") >= 3.0), "STRONG")
        .when(F.col("score") >= 2.0, "MODERATE")
        .when(F.col("score") > 0, "WEAK")
        .otherwise("NONE")
    )
    return rows.withColumn("confidence", band)


def ranked(flagged: DataFrame) -> DataFrame:
    """Flagged filings, the highest score first; a joint filing's companies stand in order."""
    return flagged.where(F.size("flags") > 0).orderBy(F.desc("score"), "accn", "cik")


def day_feed(filings: DataFrame, day: date) -> DataFrame:
    """The filings that became public on ``day``, with flags; later filings do not enter their habits."""
    known = filings.where(F.col("knowledge_date") <= F.lit(day.isoformat()).cast("date"))
    same = known.where(F.col("knowledge_date") == F.lit(day.isoformat()).cast("date"))
    # Only companies of that day need their history.
    history = known.join(same.select("cik", "form").distinct(), ["cik", "form"], "left_semi")
    return flags(history).where(F.col("knowledge_date") == F.lit(day.isoformat()).cast("date"))
