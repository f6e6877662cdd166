"""Restatement statistics over all facts. For studies of the corpus only: they see later reports, features must not."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vintara.functions.scalars import relative_change, unit_class
from vintara.operators.selection import exact_quantiles, quantiles_of
from vintara.operators.staging import staged
from vintara.operators.views import facts_pit
from vintara.schemas import CHAIN_ORDER, GRAIN

QUANTILES = (0.5, 0.75, 0.9, 0.95, 0.99)
THRESHOLDS = (0.01, 0.05, 0.1)
CUTOFFS = ("1996-12-31", "1998-12-31", "1999-12-31", "2000-12-31", "2001-06-30")
BANDS = (("through April 1994", None, "1994-04-30"), ("May 1994", "1994-04-30", "1994-05-31"), ("later", "1994-05-31", None))
#: A cohort with fewer facts has no gap.
LEAST_COHORT = 1000


def per_fact(facts: DataFrame) -> DataFrame:
    """One row per fact: how often reported, whether with several values, the first and the latest one, and the change between them."""
    return _with_changes(facts.groupBy(*GRAIN).agg(*_per_fact_columns()))


def _per_fact_columns() -> list[Column]:
    """Whether a fact has two values its smallest and largest say; no set of values is kept.

    The first and the latest report are the least and the largest struct of the chain's order, which has the value in it.
    """
    order = F.struct(*CHAIN_ORDER)
    return [
        F.count("*").alias("n_reports"),
        F.coalesce(F.min("value") != F.max("value"), F.lit(False)).alias("restated"),
        F.min(order)["value"].alias("first_value"),
        F.max(order)["value"].alias("latest_value"),
    ]


def _with_changes(rows: DataFrame) -> DataFrame:
    a, b = F.col("first_value"), F.col("latest_value")
    flip = (F.signum(a) != F.signum(b)) & (a != 0) & (b != 0)
    return rows.withColumns({"relative_change": relative_change(a, b), "is_sign_flip": flip})


def _tally_columns() -> list[Column]:
    a, b, restated = F.col("first_value"), F.col("latest_value"), F.col("restated")
    counts = {
        "facts": F.lit(True),
        "restated_facts": restated,
        "reported_once": F.col("n_reports") == 1,
        "restatable": F.col("n_reports") > 1,
        "sign_flips": restated & F.col("is_sign_flip"),
        "zero_endpoint": restated & ((a == 0) != (b == 0)),
        "undefined_change": restated & F.col("relative_change").isNull(),
        "revised_up": restated & (b > a),
        "revised_down": restated & (b < a),
        "returned": restated & (b == a),
    }
    return [F.count_if(c).alias(n) for n, c in counts.items()] + [F.coalesce(F.sum("n_reports"), F.lit(0)).alias("rows_total")]


def share(part: Column, whole: Column) -> Column:
    """Eight decimals; 0 of nothing is 0."""
    return F.when(whole == 0, 0.0).otherwise(F.bround(F.try_divide(part.cast("double"), whole.cast("double")), 8))


def tally(facts: DataFrame) -> DataFrame:
    """One row: facts, restated ones, reports, and where the values went; all in one aggregation."""
    out = per_fact(facts).agg(*_tally_columns())
    return out.withColumns({"restated_share": share(F.col("restated_facts"), F.col("facts")), "restated_share_of_restatable": share(F.col("restated_facts"), F.col("restatable"))})


def change_quantiles(facts: DataFrame, quantiles: Sequence[float] = QUANTILES) -> DataFrame:
    """Exact, interpolated quantiles of the change of restated facts, with and without sign flips; ranks are selected, no task sorts all changes."""
    change = F.col("relative_change")
    found = exact_quantiles(per_fact(facts).where("restated"), {"all": change, "same_sign": F.when(~F.col("is_sign_flip"), change)}, quantiles)
    rows = list(zip(map(float, quantiles), found["all"], found["same_sign"]))
    return facts.sparkSession.createDataFrame(rows, "quantile double, change double, change_same_sign double")


def change_thresholds(facts: DataFrame, thresholds: Sequence[float] = THRESHOLDS) -> DataFrame:
    """Restated facts whose change is larger than each threshold, with and without sign flips."""
    rows = per_fact(facts).where("restated")
    over = [F.count_if(F.col("relative_change") > t).alias(f"a{k}") for k, t in enumerate(thresholds)]
    over += [F.count_if((F.col("relative_change") > t) & ~F.col("is_sign_flip")).alias(f"s{k}") for k, t in enumerate(thresholds)]
    each = F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"a{k}").alias("facts"), F.col(f"s{k}").alias("facts_same_sign")) for k, t in enumerate(thresholds)])
    return rows.agg(*over).select(F.inline(each))


def restated_rows(facts: DataFrame) -> DataFrame:
    """By report instead of by fact: how many differ from their first report."""
    out = facts_pit(facts).agg(F.count("*").alias("rows_total"), F.count_if("differs_from_first_report").alias("restated_rows"))
    return out.withColumn("restated_row_share", share(F.col("restated_rows"), F.col("rows_total")))


#: The classes of :func:`unit_class`, in their order on a report.
UNIT_CLASSES = ("per-share", "share count", "other")


def by_unit_class(facts: DataFrame) -> DataFrame:
    """Counts and the exact median change of restated facts by class of unit; the medians are selected, see :mod:`selection`.

    Facts are grouped once: their class, direction and change are written, and counts and medians read from there.
    """
    restated, a, b = F.col("restated"), F.col("first_value"), F.col("latest_value")
    columns = [unit_class(F.col("unit")).alias("unit_class"), "restated", (restated & (b > a)).alias("up"), (restated & (b < a)).alias("down"), F.when(restated, F.col("relative_change")).alias("change")]
    with staged(per_fact(facts).select(*columns)) as rows:
        counts = rows.groupBy("unit_class").agg(F.count("*").alias("facts"), F.count_if("restated").alias("restated_facts"), F.count_if("up").alias("revised_up"), F.count_if("down").alias("revised_down"))
        found, schema = counts.collect(), counts.schema  # a row a class
        medians = quantiles_of(rows, {c: F.when(F.col("unit_class") == c, F.col("change")) for c in UNIT_CLASSES}, [0.5])
    out = facts.sparkSession.createDataFrame(found, schema)
    median, rank = F.lit(None).cast("double"), F.lit(None).cast("int")
    for k, c in enumerate(UNIT_CLASSES):
        median, rank = F.when(F.col("unit_class") == c, F.lit(medians[c][0]).cast("double")).otherwise(median), F.when(F.col("unit_class") == c, k).otherwise(rank)
    return out.withColumn("median_change", median).withColumn("downward_share", share(F.col("revised_down"), F.col("restated_facts"))).orderBy(rank)


def cross_grain(facts: DataFrame) -> DataFrame:
    """What the grain keeps apart: figures reported in several units or taxonomies."""
    rows = facts.groupBy("cik", "concept", "period_start", "period_end").agg(F.countDistinct("unit").alias("u"), F.countDistinct("taxonomy").alias("t"))
    return rows.agg(F.count("*").alias("triples"), F.count_if(F.col("u") > 1).alias("multi_unit"), F.count_if(F.col("t") > 1).alias("multi_taxonomy"))


def _with_last_filed(facts: DataFrame) -> DataFrame:
    """Facts with their company's last filing date, taken from the facts in the same scan, so that none falls out."""
    rows = facts.groupBy(*GRAIN).agg(*_per_fact_columns(), F.max("filed_at").alias("last_report"))
    return _with_changes(rows.withColumn("last_filed_at", F.max("last_report").over(Window.partitionBy("cik"))))


def _cohorts(dormant: Column, suffix: str) -> list[Column]:
    out = []
    for name, cohort in (("active", ~dormant), ("dormant", dormant)):
        out += [
            F.count_if(cohort).alias(f"{name}_facts{suffix}"),
            F.count_if(cohort & (F.col("n_reports") >= 2)).alias(f"{name}_restatable{suffix}"),
            F.count_if(cohort & F.col("restated")).alias(f"{name}_restated{suffix}"),
        ]
    return out


_COUNTS = [f"{a}_{b}" for a in ("active", "dormant") for b in ("facts", "restatable", "restated")]


def with_survival_shares(rows: DataFrame, least: int = LEAST_COHORT) -> DataFrame:
    """Shares, their gap (dormant minus active) by fact and by restatable fact, pooled share; no gap for small cohorts."""
    c = F.col
    active, dormant = share(c("active_restated"), c("active_facts")), share(c("dormant_restated"), c("dormant_facts"))
    active_if, dormant_if = share(c("active_restated"), c("active_restatable")), share(c("dormant_restated"), c("dormant_restatable"))
    enough = (c("active_facts") >= least) & (c("dormant_facts") >= least)
    pooled = share(c("active_restated") + c("dormant_restated"), c("active_facts") + c("dormant_facts"))
    return rows.withColumns(
        {
            "active_share": active,
            "dormant_share": dormant,
            "pooled_share": pooled,
            "gap": F.when(enough, F.bround(dormant - active, 8)),
            "conditional_gap": F.when(enough, F.bround(dormant_if - active_if, 8)),
            "active_only_bias": F.when(enough, F.bround(active - pooled, 8)),
        }
    )


def survival_split(facts: DataFrame, cutoffs: Sequence[str] = CUTOFFS) -> DataFrame:
    """Facts of companies that still file and of those that stopped before each cutoff: one pass for all cutoffs."""
    dormant = lambda d: F.col("last_filed_at") < F.lit(d).cast("date")
    sums = reduce(list.__add__, [_cohorts(dormant(d), f"_{k}") for k, d in enumerate(cutoffs)])
    each = F.array(*[F.struct(F.lit(d).alias("cutoff"), *[F.col(f"{n}_{k}").alias(n) for n in _COUNTS]) for k, d in enumerate(cutoffs)])
    return with_survival_shares(_with_last_filed(facts).agg(*sums).select(F.inline(each)))


def survival_bands(facts: DataFrame, cutoff: str = CUTOFFS[2], bands: Sequence[tuple] = BANDS) -> DataFrame:
    """The split by the period that a fact describes: bands (label, after, through)."""
    end, label = F.col("period_end"), F.lit(None).cast("string")
    for name, after, through in bands:
        inside = F.lit(True)
        if after:
            inside = inside & (end > F.lit(after).cast("date"))
        if through:
            inside = inside & (end <= F.lit(through).cast("date"))
        label = F.when(inside, F.lit(name)).otherwise(label)
    rows = _with_last_filed(facts).withColumn("band", label).where("band is not null")
    return with_survival_shares(rows.groupBy("band").agg(*_cohorts(F.col("last_filed_at") < F.lit(cutoff).cast("date"), "")))


def right_and_wrong_key(facts: DataFrame) -> DataFrame:
    """Distinct facts and those with several values, with the grain and without the period's start in it.

    One scan: the shorter key's groups are made of the longer key's.
    """
    shorter = [c for c in GRAIN if c != "period_start"]
    ends = facts.groupBy(*GRAIN).agg(F.min("value").alias("a"), F.max("value").alias("b"))
    several = F.count_if(F.col("a") != F.col("b"))
    groups = ends.groupBy(*shorter).agg(F.count("*").alias("n"), several.alias("revised"), (F.min("a") != F.max("b")).alias("moved"))
    sums = groups.agg(
        F.struct(F.coalesce(F.sum("n"), F.lit(0)).alias("facts"), F.coalesce(F.sum("revised"), F.lit(0)).alias("revised"), F.lit("grain").alias("key")).alias("right"),
        F.struct(F.count("*").alias("facts"), F.count_if("moved").alias("revised"), F.lit("without_start").alias("key")).alias("wrong"),
    )
    return sums.select(F.inline(F.array("right", "wrong")))


def payload_coverage(payloads: DataFrame) -> DataFrame:
    """Payloads, distinct contents, and bytes that the content addressing saves."""
    once = payloads.groupBy("content_sha256").agg(F.count("*").alias("n"), F.first("byte_len").alias("bytes"))
    return once.agg(F.sum("n").alias("payloads"), F.count("*").alias("distinct_payloads"), F.sum((F.col("n") - 1) * F.col("bytes")).alias("bytes_saved"))
