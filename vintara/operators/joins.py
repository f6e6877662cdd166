"""As-of joins without range blow-up."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_backward(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, payload: list[str], tie_break: list[str] | None = None) -> DataFrame:
    """``left`` with the payload of the last ``right`` row at or before its time, null if there is none.

    Both sides go into one table, and a running last over it carries the payload: one shuffle, no row is multiplied.
    Right rows come first at equal times, so the bound is inclusive.
    """
    fields = [right_time, *[c for c in payload if c != right_time]]
    r = right.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.col(right_time).alias("t"), F.lit(0).alias("side"), F.struct(*fields).alias("p"), F.struct(*[F.col(c) for c in (tie_break or [right_time])]).alias("tie"))
    l = left.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.col(left_time).alias("t"), F.lit(1).alias("side"), F.struct(*left.columns).alias("row"))  # noqa: E741
    both = r.unionByName(l, allowMissingColumns=True)
    w = Window.partitionBy(*[f"k{i}" for i in range(len(keys))]).orderBy("t", "side", "tie").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("p", F.last("p", ignorenulls=True).over(w)).where("side = 1")
    taken = [F.col(f"p.{c}").alias(c if c not in left.columns else f"right_{c}") for c in fields]
    return out.select("row.*", *taken)


def asof_forward(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, payload: list[str]) -> DataFrame:
    """``left`` with the payload of the first ``right`` row at or after its time: the backward join in reversed time."""
    fields = [right_time, *[c for c in payload if c != right_time]]
    r = right.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.col(right_time).alias("t"), F.lit(0).alias("side"), F.struct(*fields).alias("p"))
    l = left.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.col(left_time).alias("t"), F.lit(1).alias("side"), F.struct(*left.columns).alias("row"))  # noqa: E741
    both = r.unionByName(l, allowMissingColumns=True)
    w = Window.partitionBy(*[f"k{i}" for i in range(len(keys))]).orderBy(F.desc("t"), "side").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("p", F.last("p", ignorenulls=True).over(w)).where("side = 1")
    taken = [F.col(f"p.{c}").alias(c if c not in left.columns else f"right_{c}") for c in fields]
    return out.select("row.*", *taken)
