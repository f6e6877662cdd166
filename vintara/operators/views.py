"""Derived views: knowledge dates, company filings, fact chains and revisions. All are lazy functions of DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vintara.schemas import CHAIN_ORDER, GRAIN


def filings_pit(filings: DataFrame) -> DataFrame:
    """Adds knowledge_date, was_disseminated_late, dissemination_lag_days (0 if the date is unknown)."""
    shown = F.coalesce("disseminated_at", "filed_at")
    late = F.coalesce(F.col("disseminated_at") > F.col("filed_at"), F.lit(False))
    return filings.withColumns(
        {
            "knowledge_date": F.greatest("filed_at", shown),
            "was_disseminated_late": late,
            "dissemination_lag_days": F.coalesce(F.datediff("disseminated_at", "filed_at"), F.lit(0)).cast("long"),
        }
    )


def company_filings(filings: DataFrame, filers: DataFrame) -> DataFrame:
    """One row per company and filing: a joint filing stands once for each of its companies."""
    links = filers.select("accn", F.col("cik").alias("filer"), "is_primary")
    return filings_pit(filings).drop("cik").join(links, "accn").withColumnRenamed("filer", "cik")


def with_knowledge_date(facts: DataFrame, filings: DataFrame) -> DataFrame:
    """Facts with the date on which their filing became public; a fact without a filing has its own filing date."""
    shown = filings.select("accn", F.greatest("filed_at", F.coalesce("disseminated_at", "filed_at")).alias("_known"))
    joined = facts.drop("knowledge_date").join(shown, "accn", "left")
    return joined.withColumn("knowledge_date", F.greatest("filed_at", F.coalesce("_known", "filed_at"))).drop("_known")


def facts_pit(facts: DataFrame) -> DataFrame:
    """Facts (with knowledge_date) with their place in the chain of reports of the same fact.

    One exchange and one sort serve all windows. ``period_distinct_values`` counts over the whole chain, later reports
    included: it belongs to corpus statistics, not into features.
    """
    chain = Window.partitionBy(*GRAIN)
    ordered = chain.orderBy(*CHAIN_ORDER)
    return facts.withColumns(
        {
            "report_seq": F.row_number().over(ordered),
            "differs_from_first_report": ~F.first("value").over(ordered).eqNullSafe(F.col("value")),
            "period_distinct_values": F.size(F.collect_set("value").over(chain)),
        }
    )


def fact_revisions(facts: DataFrame) -> DataFrame:
    """Facts with the report before them in the chain: prior_value, prior_knowledge_date, prior_filed_at, prior_accn."""
    ordered = Window.partitionBy(*GRAIN).orderBy(*CHAIN_ORDER)
    prior = {f"prior_{c}": F.lag(c).over(ordered) for c in ("value", "knowledge_date", "filed_at", "accn")}
    return facts_pit(facts).withColumns(prior)
