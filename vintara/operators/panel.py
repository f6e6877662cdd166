"""Signal panels: universe, and the freshest feature per arm, company and formation date, on one universe for all arms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vintara.functions.scalars import is_financial, is_utility


def universe(entities: DataFrame, identifiers: DataFrame) -> DataFrame:
    """Companies with their symbol (the shortest ticker, then the first), and why one is not in: SECTOR, NO_TICKER."""
    symbol = identifiers.groupBy(F.col("cik").alias("_cik")).agg(F.min_by("ticker", F.struct(F.length("ticker"), "ticker")).alias("symbol"))
    rows = entities.join(symbol, F.col("cik") == F.col("_cik"), "left")
    sector = is_financial(F.col("sic")) | is_utility(F.col("sic"))
    reason = F.when(sector, "SECTOR").when(F.col("symbol").isNull(), "NO_TICKER")
    return rows.select("cik", "name", "sic", "symbol", reason.alias("drop_reason"))


def pick_freshest(features: DataFrame, formations: Sequence[str], keys: Sequence[str] = ("cik",)) -> DataFrame:
    """By formation date, arm and key the feature with the latest knowledge date at or before it, of equal ones the latest period.

    Columns: arm, keys, formation_date, value, knowledge_date, period_end; null values where nothing is known yet. A year
    that one arm cannot compute stands in no arm: another set of years would not be comparable. A feature is the freshest
    from its knowledge date up to the next one's, so each row is dealt out to the formation dates in between: one window,
    no join.
    """
    who = ["arm", *keys]
    known = features.where("value is not null and in_all_arms")
    own = Window.partitionBy(*who).orderBy("knowledge_date", "period_end", "value")
    rows = known.withColumns({"until": F.lead("knowledge_date").over(own), "first": F.row_number().over(own) == 1})
    dates = F.array(*[F.lit(d).cast("date") for d in formations])
    fresh = F.filter(dates, lambda d: (d >= F.col("knowledge_date")) & (F.col("until").isNull() | (d < F.col("until"))))
    early = F.when(F.col("first"), F.filter(dates, lambda d: d < F.col("knowledge_date"))).otherwise(F.array().cast("array<date>"))
    dealt = F.concat(F.transform(fresh, lambda d: F.struct(d.alias("date"), F.lit(True).alias("known"))), F.transform(early, lambda d: F.struct(d.alias("date"), F.lit(False).alias("known"))))
    out = rows.select(*who, "value", "knowledge_date", "period_end", F.explode(dealt).alias("f"))
    return out.select(*who, F.col("f.date").alias("formation_date"), *[F.when(F.col("f.known"), F.col(c)).alias(c) for c in ("knowledge_date", "period_end", "value")])


def common_universe(picked: DataFrame, n_arms: int, keys: Sequence[str] = ("cik",)) -> DataFrame:
    """Only those (key, formation date) for which every arm has a value: the arms differ in values, never in names."""
    arms = F.count("value").over(Window.partitionBy(*keys, "formation_date"))
    return picked.withColumn("n_arms", arms).where(F.col("n_arms") == n_arms).drop("n_arms")


def drop_reasons(features: DataFrame, picked: DataFrame, n_arms: int, keys: Sequence[str] = ("cik",)) -> DataFrame:
    """Counts by reason, in the order in which they apply.

    NO_ANNUAL_PERIOD: companies with fewer than two annual periods. GAP, MISSING_INPUT, NON_POSITIVE_ASSETS: of the others,
    years that some arm cannot compute, counted once. NO_PRIOR_YEAR: companies left without any year. NOT_YET_FILED:
    companies and formation dates at which some arm knows nothing yet.
    """
    year = features.groupBy(*keys, "period_start", "period_end").agg(F.min("in_all_arms").alias("full"), F.min("drop_reason").alias("reason"))
    firm = Window.partitionBy(*keys)
    year = year.withColumns({"n": F.count("*").over(firm), "n_full": F.count_if("full").over(firm), "k": F.row_number().over(firm.orderBy("period_end", "period_start"))})
    short = F.when(~F.col("full") & (F.col("reason") != "NO_PRIOR_YEAR"), F.col("reason"))
    firms = F.when(F.col("k") == 1, F.when(F.col("n") < 2, "NO_ANNUAL_PERIOD").when(F.col("n_full") == 0, "NO_PRIOR_YEAR"))
    said = F.explode(F.array_compact(F.array(F.when(F.col("n") >= 2, short), firms))).alias("reason")
    years = year.select(said).groupBy("reason").agg(F.count("*").alias("n"))
    late = picked.groupBy(*keys, "formation_date").agg(F.count("value").alias("v")).where(F.col("v") < n_arms)
    return years.unionByName(late.agg(F.count("*").alias("n")).select(F.lit("NOT_YET_FILED").alias("reason"), "n"))


def universe_digests(panel: DataFrame, keys: Sequence[str] = ("cik",)) -> DataFrame:
    """By arm the number of (keys, formation date), and two digests of their set, whatever its order: xor and sum of 60 bits of each one's md5.

    Equal sets have equal digests; sets that differ have the same three values by chance only.
    """
    names = panel.groupBy("arm", *keys, "formation_date").agg(F.lit(1).alias("_one"))
    told = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in (*keys, "formation_date")]).cast("binary"))
    h = F.conv(F.substring(told, 1, 15), 16, 10).cast("bigint")
    return names.groupBy("arm").agg(F.count("*").alias("n"), F.bit_xor(h).alias("digest"), F.sum(h.cast("decimal(38,0)")).cast("string").alias("total"))


def same_universe(panel: DataFrame, keys: Sequence[str] = ("cik",)) -> bool:
    """Whether all arms hold the same set of (keys, formation date), told by its digests."""
    return universe_digests(panel, keys).select("n", "digest", "total").distinct().count() <= 1
