"""Vintage arms and the accruals feature.

The same figure can enter a study as first reported (honest), at its restated value but dated as first reported, or as a
vendor without vintages would have it: the latest value, dated at the period's end. The arms are rows, not copies of a table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vintara.schemas import CHAIN_ORDER, GRAIN

ARMS = ("first_reported", "restated_values", "naive_vendor")


@dataclass(frozen=True)
class AccrualsSpec:
    """Which concepts are read, and which spans of days count as a year."""

    income: str = "NetIncomeLoss"
    cash_flow: str = "NetCashProvidedByUsedInOperatingActivities"
    cash_flow_fallback: str = "NetCashProvidedByUsedInOperatingActivitiesContinuingOperations"
    assets: str = "Assets"
    unit: str = "USD"
    span: tuple[int, int] = (300, 430)
    gap: tuple[int, int] = (300, 430)


def _ends(facts: DataFrame) -> DataFrame:
    """One row per fact with its first and its last report."""
    order = F.struct(*CHAIN_ORDER)
    return facts.groupBy(*GRAIN).agg(F.min(order).alias("first"), F.max(order).alias("last"))


def _arm(arm: str, of: Column) -> dict[str, Column]:
    """value, knowledge_date (but for the vendor's) and is_restated of a fact's struct (first, last) under an arm."""
    value = of["first"]["value"] if arm == "first_reported" else of["last"]["value"]
    restated = F.lit(False) if arm == "first_reported" else of["last"]["value"] != of["first"]["value"]
    return {"value": value, "knowledge_date": of["first"]["knowledge_date"], "is_restated": restated}


def vintage_arms(facts: DataFrame) -> DataFrame:
    """One row per fact and arm: arm, GRAIN, value, knowledge_date, is_restated (the value differs from the first)."""
    fields = []
    for arm in ARMS:
        own = _arm(arm, F.struct("first", "last")) | ({"knowledge_date": F.col("period_end")} if arm == "naive_vendor" else {})
        fields.append(F.struct(F.lit(arm).alias("arm"), *[c.alias(n) for n, c in own.items()]))
    return _ends(facts).select(F.explode(F.array(*fields)).alias("x"), *GRAIN).select("x.arm", *GRAIN, "x.value", "x.knowledge_date", "x.is_restated")


def annual_periods(facts: DataFrame, spec: AccrualsSpec = AccrualsSpec()) -> DataFrame:
    """Distinct periods (cik, taxonomy, period_start, period_end) of a year's length for which income was reported."""
    days = F.datediff("period_end", "period_start")
    rows = facts.where((F.col("concept") == spec.income) & (F.col("unit") == spec.unit) & days.between(*spec.span))
    return rows.select("cik", "taxonomy", "period_start", "period_end").distinct()


def accruals(facts: DataFrame, spec: AccrualsSpec = AccrualsSpec()) -> DataFrame:
    """(income - cash flow) / average assets by arm, company and year; and why a year has none.

    Columns: arm, cik, taxonomy, period_start, period_end, value, knowledge_date (of the last input), uses_restated_input,
    drop_reason, in_all_arms (every arm has a value for this year). Years that cannot be computed keep their row with a
    reason, the first that applies.

    One scan of the facts. Which inputs a year has is the same for every arm, so a year is put together once, from the
    first and last report of its inputs, and the arms are made of it at the end. Both windows run over one exchange by
    company: instants stand before the periods that end with them and are carried along, and the opening balance is the
    balance of the year before.
    """
    who = ["cik", "taxonomy"]
    wanted = facts.where((F.col("unit") == spec.unit) & F.col("concept").isin(spec.income, spec.cash_flow, spec.cash_flow_fallback, spec.assets))
    instant = F.col("period_start").isNull()
    span = F.datediff("period_end", "period_start").between(*spec.span)
    wanted = wanted.where((instant & (F.col("concept") == spec.assets)) | (span & (F.col("concept") != spec.assets)))
    of = lambda c: F.max(F.when(F.col("concept") == c, F.struct("first", "last")))
    by_period = _ends(wanted).groupBy(*who, "period_end", "period_start").agg(
        of(spec.income).alias("income"), F.coalesce(of(spec.cash_flow), of(spec.cash_flow_fallback)).alias("cash"), of(spec.assets).alias("assets")
    )
    company = Window.partitionBy(*who).orderBy("period_end", F.col("period_start").asc_nulls_first())
    at = F.last(F.when(F.col("assets").isNotNull(), F.struct("period_end", "assets")), ignorenulls=True).over(company)
    years = by_period.withColumn("at", at).where("income is not null")
    years = years.withColumn("a1", F.when(F.col("at.period_end") == F.col("period_end"), F.col("at.assets")))
    years = years.withColumns({"opening": F.lag("period_end").over(company), "a0": F.lag("a1").over(company)})
    parts = [F.col(c) for c in ("income", "cash", "a1", "a0")]
    common = (
        F.when(F.col("opening").isNull(), "NO_PRIOR_YEAR")
        .when(~F.datediff("period_end", "opening").between(*spec.gap), "GAP")
        .when(F.col("cash").isNull() | F.col("a1").isNull() | F.col("a0").isNull(), "MISSING_INPUT")
    )
    fields, reasons = [], []
    for arm in ARMS:
        inputs = [_arm(arm, c) for c in parts]
        income, cash, a1, a0 = (x["value"].cast("double") for x in inputs)
        average = (a1 + a0) / 2
        reason = F.coalesce(common, F.when(average <= 0, "NON_POSITIVE_ASSETS"))
        reasons.append(reason)
        # The vendor dates figures at the end of their period, the opening balance at its own.
        known = F.greatest("period_end", "opening") if arm == "naive_vendor" else F.greatest(*[x["knowledge_date"] for x in inputs])
        fields.append(F.struct(
            F.lit(arm).alias("arm"),
            F.when(reason.isNull(), F.try_divide(income - cash, average)).alias("value"),
            F.when(reason.isNull(), known).alias("knowledge_date"),
            F.when(reason.isNull(), inputs[0]["is_restated"] | inputs[1]["is_restated"] | inputs[2]["is_restated"] | inputs[3]["is_restated"]).alias("uses_restated_input"),
            reason.alias("drop_reason"),
        ))
    full = F.coalesce(*reasons).isNull().alias("in_all_arms")
    out = years.select(*who, "period_start", "period_end", full, F.explode(F.array(*fields)).alias("x"))
    return out.select("x.arm", *who, "period_start", "period_end", "x.value", "x.knowledge_date", "x.uses_restated_input", "x.drop_reason", "in_all_arms")
