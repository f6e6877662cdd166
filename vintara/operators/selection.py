"""Exact order statistics of a distributed column: ranks are narrowed by counts, no task sees all values.

A rank lies in an interval of values of which is known how many rows come before it and how many are inside. A mergeable
sketch of the interval gives values of it around each rank; exact counts below, at and between them, one aggregation for all
ranks of all columns, say where the ranks are. Each round leaves a few ten-thousandths of an interval, so two or three
rounds take any table to intervals of ``SMALL`` rows, and only those are collected and sorted. A value that repeats is met by a
count of its own, so no number of ties keeps an interval large.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vintara.operators.staging import staged

#: Rows of an interval that are collected, and the accuracy of the sketches that narrow larger ones.
SMALL, ACCURACY = 4096, 10_000


@dataclass(frozen=True)
class _Interval:
    """The rows of a column strictly between two values, None being open; ``before`` rows are below."""

    column: str
    low: float | None
    high: float | None
    before: int
    inside: int

    def value(self) -> Column:
        """The column's value if it is inside, else null."""
        x, inside = F.col(self.column), F.lit(True)
        if self.low is not None:
            inside = inside & (x > F.lit(self.low))
        if self.high is not None:
            inside = inside & (x < F.lit(self.high))
        return F.when(inside, x)


def _points(rows: DataFrame, ranks: Mapping[_Interval, set[int]]) -> dict[_Interval, list[float]]:
    """For each interval some of its values around its ranks."""
    asked = []
    for k, (one, wanted) in enumerate(ranks.items()):
        at = {min(1.0, max(0.0, (r - one.before + d * one.inside / ACCURACY) / one.inside)) for r in wanted for d in (-2, 0, 2)}
        asked.append(F.percentile_approx(one.value(), sorted(at), ACCURACY).alias(f"p{k}"))
    found = rows.agg(*asked).first()
    return {one: sorted(set(found[f"p{k}"])) for k, one in enumerate(ranks)}


def _narrowed(rows: DataFrame, ranks: Mapping[_Interval, set[int]], known: dict) -> dict[_Interval, set[int]]:
    """Each rank's smaller interval; ranks that fall on a counted value are entered in ``known`` instead."""
    points = _points(rows, ranks)
    counts = []
    for k, (one, values) in enumerate(points.items()):
        x = one.value()
        counts += [F.count_if(c).alias(f"{n}{k}_{j}") for j, v in enumerate(values) for n, c in (("below", x < F.lit(v)), ("at", x == F.lit(v)))]
    found = rows.agg(*counts).first()
    out: dict[_Interval, set[int]] = {}
    for k, (one, values) in enumerate(points.items()):
        for rank in ranks[one]:
            low, before = one.low, one.before
            for j, v in enumerate(values):
                below = one.before + found[f"below{k}_{j}"]
                if rank < below:
                    out.setdefault(_Interval(one.column, low, v, before, below - before), set()).add(rank)
                    break
                low, before = v, below + found[f"at{k}_{j}"]
                if rank < before:
                    known[one.column, rank] = v
                    break
            else:
                out.setdefault(_Interval(one.column, low, one.high, before, one.before + one.inside - before), set()).add(rank)
    return out


def order_statistics(rows: DataFrame, ranks: Mapping[str, Sequence[int]], sizes: Mapping[str, int]) -> dict[tuple[str, int], float]:
    """By (column, rank) the value that has ``rank`` non-null values of its double column before it in ascending order; sizes: how many there are."""
    known: dict[tuple[str, int], float] = {}
    left = {_Interval(c, None, None, 0, sizes[c]): set(wanted) for c, wanted in ranks.items() if wanted}
    while large := {one: wanted for one, wanted in left.items() if one.inside > SMALL}:
        left = {one: wanted for one, wanted in left.items() if one.inside <= SMALL} | _narrowed(rows, large, known)
    if left:
        found = rows.agg(*[F.sort_array(F.collect_list(one.value())).alias(f"v{k}") for k, one in enumerate(left)]).first()
        for k, (one, wanted) in enumerate(left.items()):
            known |= {(one.column, r): found[f"v{k}"][r - one.before] for r in wanted}
    return known


def exact_quantiles(rows: DataFrame, columns: Mapping[str, Column], quantiles: Sequence[float]) -> dict[str, list[float | None]]:
    """Each named column's quantiles, interpolated between the two values that a quantile lies between; None without values.

    Nulls are no values. The columns are written once and read in every round.
    """
    with staged(rows.select(*[c.cast("double").alias(n) for n, c in columns.items()])) as values:
        return quantiles_of(values, {n: F.col(n) for n in columns}, quantiles)


def quantiles_of(rows: DataFrame, columns: Mapping[str, Column], quantiles: Sequence[float]) -> dict[str, list[float | None]]:
    """:func:`exact_quantiles` of rows that are written already, or as cheap to read again: they are read in every round."""
    values = rows.select(*[c.cast("double").alias(n) for n, c in columns.items()])
    found = values.agg(*[F.count(n).alias(n) for n in columns]).first()
    sizes = {n: found[n] for n in columns}
    places = {n: [q * (size - 1) for q in quantiles] for n, size in sizes.items() if size}
    ranks = {n: sorted({f(x) for x in at for f in (math.floor, math.ceil)}) for n, at in places.items()}
    known = order_statistics(values, ranks, sizes)
    out: dict[str, list[float | None]] = {n: [None] * len(quantiles) for n in columns}
    for n, at in places.items():
        out[n] = []
        for x in at:
            low, high = known[n, math.floor(x)], known[n, math.ceil(x)]
            out[n].append(low if low == high else low + (high - low) * (x - math.floor(x)))
    return out
