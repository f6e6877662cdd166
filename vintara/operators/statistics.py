"""Performance statistics that account for how many configurations were tried.

Moments, block statistics and ranks are DataFrame aggregations by strategy; the normal distribution, which Spark does
not have, is applied to the few aggregated numbers.
"""

from __future__ import annotations

import math
from itertools import combinations
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_NORMAL = NormalDist()
EULER = 0.5772156649015329


@F.pandas_udf(DoubleType())
def normal_cdf(x: pd.Series) -> pd.Series:
    return x.map(lambda v: None if v is None or v != v else 0.5 * math.erfc(-v / math.sqrt(2)))


def sharpe_moments(returns: DataFrame, *keys: str) -> DataFrame:
    """By key of rows (keys, ret): n, Sharpe ratio, bias-corrected skewness and Pearson kurtosis, and the variance factor.

    Spark's moments are those of the population, its kurtosis in excess. Series that are too short, constant or hold
    NaN get null statistics.
    """
    n = F.count("ret").cast("double")
    m = returns.groupBy(*keys).agg(
        F.count("ret").alias("n"), F.avg("ret").alias("mean"), F.stddev_samp("ret").alias("sd"), F.skewness("ret").alias("g1"), F.kurtosis("ret").alias("g2")
    )
    n = F.col("n").cast("double")
    fine = (F.col("n") >= 4) & (F.col("sd") > 0) & ~F.isnan("mean")
    skew = F.when(fine, F.col("g1") * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0)))
    kurt = F.when(fine, (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0.0)) * ((n + 1) * F.col("g2") + 6) + 3)
    m = m.withColumns({"sharpe": F.when(fine, F.col("mean") / F.col("sd")), "skewness": skew, "kurtosis": kurt})
    factor = 1 - F.col("skewness") * F.col("sharpe") + (F.col("kurtosis") - 1) / 4 * F.pow("sharpe", F.lit(2.0))
    return m.withColumn("variance_factor", factor).drop("g1", "g2", "mean", "sd")


def probabilistic_sharpe(moments: DataFrame, benchmark: float | Column = 0.0) -> DataFrame:
    """Adds psr: the probability that the true ratio exceeds the benchmark; null where the variance is not positive."""
    bar = benchmark if isinstance(benchmark, Column) else F.lit(benchmark)
    z = F.when(F.col("variance_factor") > 0, (F.col("sharpe") - bar) * F.sqrt(F.col("n") - 1) / F.sqrt("variance_factor"))
    return moments.withColumn("psr", normal_cdf(z))


def quantile(probability: float) -> float:
    return _NORMAL.inv_cdf(probability)


def expected_max_sharpe(variance: float, trials: int) -> float:
    """What the best of so many ratios reaches by luck alone."""
    if trials < 2 or variance < 0:
        raise ValueError("needs two trials and a variance")
    q = _NORMAL.inv_cdf
    return math.sqrt(variance) * ((1 - EULER) * q(1 - 1 / trials) + EULER * q(1 - 1 / (trials * math.e)))


def deflated_sharpe(moments: DataFrame, trials: int | None = None) -> DataFrame:
    """Adds psr against the expected maximum of the ratios' own spread, and survives (> 0.95)."""
    spread = moments.agg(F.var_samp("sharpe").alias("v"), F.count("sharpe").alias("n")).first()
    bar = expected_max_sharpe(spread["v"], trials or spread["n"])
    out = probabilistic_sharpe(moments, bar).withColumn("expected_max_sharpe", F.lit(bar))
    return out.withColumnRenamed("psr", "deflated_sharpe").withColumn("survives", F.col("deflated_sharpe") > 0.95)


def minimum_track_record(moments: DataFrame, benchmark: float = 0.0, confidence: float = 0.95) -> DataFrame:
    """Adds min_track_record: observations needed for significance, infinite without an excess."""
    z = _NORMAL.inv_cdf(confidence)
    excess = F.col("sharpe") - benchmark
    needed = 1 + F.col("variance_factor") * F.pow(z / F.nullif(excess, F.lit(0.0)), F.lit(2.0))
    return moments.withColumn("min_track_record", F.when(excess > 0, needed).when(excess <= 0, F.lit(float("inf"))))


def block_of(position: Column, n: int, blocks: int) -> Column:
    """Contiguous blocks of 0..n-1, the first n % blocks of them one longer."""
    q, r = divmod(n, blocks)
    long = r * (q + 1)
    return F.when(position < long, F.floor(position / (q + 1))).otherwise(F.floor((position - long) / max(q, 1)) + r).cast("int")


def backtest_overfitting(returns: DataFrame, blocks: int = 10, performance: str = "sharpe") -> DataFrame:
    """By split of the blocks into halves: the winner in sample, its rank and logit out of sample, its loss of performance.

    Rows (obs 0.., strategy, ret). Only counts, sums and squares by block and strategy meet the splits; values are
    centred by strategy first, so the squares do not cancel. Splits in which a strategy has no variance are left out.
    """
    if blocks % 2 or performance not in ("sharpe", "mean"):
        raise ValueError("an even number of blocks, and sharpe or mean")
    spark = returns.sparkSession
    n = returns.agg(F.max("obs")).first()[0] + 1
    if n < 2 * blocks:
        raise ValueError(f"{blocks} blocks need {2 * blocks} observations")
    strategy = Window.partitionBy("strategy")
    rows = returns.withColumn("mu", F.avg("ret").over(strategy)).withColumn("x", F.col("ret") - F.col("mu"))
    stats = rows.groupBy("strategy", block_of(F.col("obs"), n, blocks).alias("block")).agg(
        F.count("*").alias("c"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("ss"), F.first("mu").alias("mu")
    )
    halves = [(k, b, b in chosen) for k, chosen in enumerate(combinations(range(blocks), blocks // 2)) for b in range(blocks)]
    splits = spark.createDataFrame(halves, "split int, block int, inside boolean")
    both = stats.join(F.broadcast(splits), "block").groupBy("split", "strategy", "inside").agg(
        F.sum("c").alias("c"), F.sum("s").alias("s"), F.sum("ss").alias("ss"), F.first("mu").alias("mu")
    )
    mean = F.col("mu") + F.col("s") / F.col("c")
    variance = (F.col("ss") - F.col("s") * F.col("s") / F.col("c")) / (F.col("c") - 1)
    score = mean if performance == "mean" else F.when(variance > 0, mean / F.sqrt(F.greatest(variance, F.lit(0.0))))
    scored = both.withColumn("score", score).groupBy("split", "strategy").agg(F.max(F.when(F.col("inside"), F.col("score"))).alias("i"), F.max(F.when(~F.col("inside"), F.col("score"))).alias("o"))
    split = Window.partitionBy("split")
    ranked = scored.withColumns({"rank": F.row_number().over(split.orderBy("o", "strategy")), "n": F.count("*").over(split), "bad": F.count_if(F.col("i").isNull() | F.col("o").isNull()).over(split)})
    best = ranked.where("bad = 0").groupBy("split").agg(F.max_by(F.struct("strategy", "rank", "n", "i", "o"), F.struct("i", -F.col("strategy"))).alias("w"))
    relative = F.col("w.rank") / (F.col("w.n") + 1)
    return best.select("split", F.col("w.strategy").alias("winner"), relative.alias("oos_rank"), F.ln(relative / (1 - relative)).alias("logit"), (F.col("w.o") - F.col("w.i")).alias("degradation"))


def overfitting_summary(splits: DataFrame) -> DataFrame:
    return splits.agg(
        F.avg((F.col("logit") < 0).cast("double")).alias("pbo"), F.count("*").alias("n_splits"),
        F.percentile("oos_rank", 0.5).alias("median_oos_rank"), F.avg("degradation").alias("performance_degradation"),
    )


def n_splits(groups: int, test_groups: int) -> int:
    """How many combinations of test groups there are, and paths through them."""
    return math.comb(groups, test_groups)


def purged_splits(spark: SparkSession, n: int, groups: int, test_groups: int = 1, horizon: int = 0, embargo: int = 0) -> DataFrame:
    """Rows (split, obs, role) for the positions 0 to n - 1, see :func:`split_roles`."""
    return split_roles(spark.range(n).withColumnRenamed("id", "obs"), "obs", n, groups, test_groups, horizon, embargo).select("split", "obs", "role")


def split_roles(rows: DataFrame, position: str, n: int, groups: int, test_groups: int = 1, horizon: int = 0, embargo: int = 0) -> DataFrame:
    """``rows``, once for each split, with ``split`` and ``role``: test, train, purged (within ``horizon`` of a test position), embargoed (after one, for that alone).

    ``position`` is a row's place among n observations, from 0 on. With one test group this is purged k-fold, with more every combination of them.
    """
    if not 2 <= groups <= n:
        raise ValueError("between two groups and as many as there are observations")
    if not 1 <= test_groups < groups:
        raise ValueError("at least one test group, and one that is none")
    if horizon < 0 or embargo < 0:
        raise ValueError("horizon and embargo are not negative")
    q, r = divmod(n, groups)
    starts = [k * q + min(k, r) for k in range(groups + 1)]
    chosen = list(combinations(range(groups), test_groups))
    tests = F.array(*[F.struct(F.lit(k).alias("split"), F.array(*[F.struct(F.lit(starts[b]).alias("a"), F.lit(starts[b + 1]).alias("b")) for b in c]).alias("blocks")) for k, c in enumerate(chosen)])
    o = F.col(position)
    inside = F.exists("_x.blocks", lambda b: (o >= b["a"]) & (o < b["b"]))
    near = F.exists("_x.blocks", lambda b: (o >= b["a"] - horizon) & (o < b["b"] + horizon))
    after = F.exists("_x.blocks", lambda b: (o > b["a"]) & (o < b["b"] + embargo))
    role = F.when(inside, "test").when(near, "purged").when(after, "embargoed").otherwise("train")
    return rows.withColumn("_x", F.explode(tests)).select(*rows.columns, F.col("_x.split").alias("split"), role.alias("role"))


def adjusted_pvalues(tests: DataFrame, *family: str) -> DataFrame:
    """Rows (family, test, p) with bonferroni, holm and bhy adjusted values, each capped at 1."""
    whole = Window.partitionBy(*family)
    up = whole.orderBy("p", "test")
    rows = tests.withColumns({"m": F.count("*").over(whole), "k": F.row_number().over(up)})
    harmonic = F.sum(1 / F.col("k")).over(whole)
    rows = rows.withColumn("c", harmonic)
    holm = F.max(F.col("p") * (F.col("m") - F.col("k") + 1)).over(up.rowsBetween(Window.unboundedPreceding, 0))
    down = whole.orderBy(F.desc("p"), F.desc("test")).rowsBetween(Window.unboundedPreceding, 0)
    bhy = F.min(F.col("p") * F.col("m") * F.col("c") / F.col("k")).over(down)
    one = F.lit(1.0)
    return rows.withColumns({"bonferroni": F.least(F.col("p") * F.col("m"), one), "holm": F.least(holm, one), "bhy": F.least(bhy, one)}).drop("m", "k", "c")


def sharpe_haircut(spark: SparkSession, sharpe: float, n: int, trials: int, method: str = "bhy", others: list[float] | None = None) -> dict:
    """The ratio that is left after the correction for ``trials`` tests; unknown other tests count as evenly spread p-values."""
    if trials < 1 or n < 2:
        raise ValueError("needs a test and two observations")
    t = abs(sharpe) * math.sqrt(n)
    p = math.erfc(t / math.sqrt(2))
    rest = others if others is not None else [(k + 0.5) / trials for k in range(1, trials)]
    rows = spark.createDataFrame(list(enumerate([p, *rest])), "test int, p double")
    adjusted = adjusted_pvalues(rows).where("test = 0").first()[method]
    left = max(0.0, _NORMAL.inv_cdf(1 - adjusted / 2) / math.sqrt(n)) if adjusted > 0 else abs(sharpe)
    return {"observed_sharpe": sharpe, "adjusted_sharpe": left, "observed_pvalue": p, "adjusted_pvalue": adjusted, "n_tests": len(rest) + 1, "survives": adjusted < 0.05, "haircut": None if sharpe == 0 else 1 - left / abs(sharpe)}
