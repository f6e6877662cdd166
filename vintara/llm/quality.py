"""Quality rules with risk-controlled thresholds.

Each rule compares one measure of a text with a cutoff. The cutoffs are not chosen by eye: labelled documents are dealt, by
a digest of their id, into a part for tuning and a holdout. For each stratum (a class of text length) the tuning part says
which rules tell bad documents from good ones, and gives a fixed sequence of levels, each a cutoff for every such rule,
ever less strict. On the holdout an exact binomial test asks of each level whether all its rules together reject at most a
share ``risk`` of the stratum's good documents; levels are tested in sequence up to the first failure, which needs no
correction, and of the proven ones that is taken which catches most of the bad. Over the strata the error probability is
divided (Bonferroni), among those that have enough good documents for any proof: that depends on their number alone, not
on how they fare. So with probability 1 - ``error`` no stratum loses more than ``risk`` of its good documents.

A stratum with too few good documents gets no cutoff: nothing is rejected there. With the given risk and error, four strata
need 145 good documents each in the holdout, two thirds of the labelled; one stratum alone 99.

Measuring is one narrow pass over the texts. The labels enter as counts by stratum, rule and grid step, whose number is
fixed by the parameters, so all labelled documents count and little reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import exp, lgamma, log, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

WINDOW = 8
SYMBOLS = b"#*$%&|<>"
SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long"
#: Texts of at least so many words form the next stratum.
STRATA = (50, 200, 1000)
STEPS = 200
#: Share of good documents that all rules together may reject in a stratum, and the probability that any stratum exceeds it.
RISK, ERROR = 0.03, 0.05
#: One labelled document in so many is for tuning; shares of good tuning documents that a rule rejects at each level at most.
TUNING = 3
LEVELS = (0.0, 0.001, 0.0025, 0.005, 0.01)
#: A rule is used in a stratum if some cutoff rejects so much more of the bad tuning documents than of the good ones.
LEAST_LIFT = 0.05
#: A rule's measure, scaled so that 0 is harmless and 1 the worst.
RULES = {
    "symbols": "n_symbols / word_chars",
    "dup_lines": "n_dup_lines / n_lines",
    "repeat_words": "n_repeat_words / n_words",
    "upper": "n_upper / word_chars",
    "long_words": "1 - least(1, 4 * n_words / word_chars)",
    "short_words": "1 - least(1, word_chars / (4 * n_words))",
}


def measure_text(text: str | None) -> tuple[int, ...]:
    """The values of MEASURES; words are runs of characters other than ASCII white space."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    chars = len(text or "") - (len(raw) - len(raw.translate(None, SPACE)))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    repeated = _repeated_words(words)
    upper = sum(map(str.isupper, text or ""))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    return n, chars, symbols, len(lines) - len(set(lines)), repeated, len(lines), upper


def _repeated_words(words: list[bytes]) -> int:
    """Words inside windows of WINDOW words that are found twice or more.

    Windows are named exactly, in arrays: words by number, then pairs of neighbouring names by number, up to WINDOW words.
    """
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    names = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    span = 1
    while span < WINDOW:
        _, names = np.unique(names[:-span] * (len(words) + 1) + names[span:], return_inverse=True)
        span *= 2
    again = np.flatnonzero(np.bincount(names)[names] > 1)
    steps = np.zeros(len(words) + 1, np.int64)
    steps[again] += 1
    steps[again + WINDOW] -= 1
    return int(np.count_nonzero(np.cumsum(steps)))


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in MEASURES.split(", ")]
    for batch in batches:
        rows = [measure_text(x.as_py()) for x in batch.column("text")]
        columns = [pa.array([r[k] for r in rows], pa.int64()) for k in range(len(names))]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("digest"), *columns], ["id", "digest", *names])


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, digest, MEASURES), one per row of ``docs``, digest being the text's; null counts as empty."""
    digest = F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("digest")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), digest)
    return rows.mapInArrow(_measured, f"id {rows.schema['id'].dataType.simpleString()}, digest string, {MEASURES}")


def binomial_cdf(k: int, n: int, p: float) -> float:
    """Probability of at most ``k`` successes of ``n``; terms are summed from the largest down, none of weight is left."""
    if k >= n:
        return 1.0
    mode = min(k, int((n + 1) * p))
    log_pmf = lgamma(n + 1) - lgamma(mode + 1) - lgamma(n - mode + 1) + mode * log(p) + (n - mode) * log1p(-p)
    total, term, j = 1.0, 1.0, mode
    while j > 0 and term > 1e-17 * total:
        term *= j / (n - j + 1) * (1 - p) / p
        total, j = total + term, j - 1
    term, j = 1.0, mode
    while j < k and term > 1e-17 * total:
        term *= (n - j) / (j + 1) * p / (1 - p)
        total, j = total + term, j + 1
    return min(1.0, exp(log_pmf) * total)


def best_cutoff(good: dict[int, int], bad: dict[int, int], risk: float, error: float, steps: int = STEPS) -> int | None:
    """The grid step from which on documents are rejected, or None.

    good, bad: labelled documents by grid step of their measure. Rejecting from a step on is proven when seeing so few
    good ones rejected would have at most the probability ``error`` if their true share were above ``risk``. Steps are
    tested from the worst measure down to the first that fails; of the proven ones that is taken which rejects most of
    the bad beyond what it rejects of the good, the most lenient of equal ones.
    """
    n, m = sum(good.values()), sum(bad.values())
    rejected, caught, best, gain = 0, 0, None, 0.0
    for step in range(steps, 0, -1):
        rejected, caught = rejected + good.get(step, 0), caught + bad.get(step, 0)
        if binomial_cdf(rejected, n, risk) > error:
            break
        if m and caught / m - rejected / n > gain + 1e-12:
            best, gain = step, caught / m - rejected / n
    return best


def _stratum() -> Column:
    return reduce(lambda c, x: c + (F.col("n_words") >= x).cast("int"), STRATA, F.lit(0))


def _step(rule: str) -> Column:
    """Grid step of a rule's measure: 0 harmless, STEPS the worst; texts without words are harmless."""
    return F.when(F.col("n_words") > 0, F.least(F.lit(STEPS), F.ceil(F.expr(RULES[rule]) * STEPS))).otherwise(0).cast("int")


def _levels(good: dict[str, dict[int, int]], bad: dict[str, dict[int, int]]) -> list[dict[str, int]]:
    """Cutoffs by rule for each of LEVELS, from one stratum's tuning documents by rule and grid step."""
    out: list[dict[str, int]] = [{} for _ in LEVELS]
    for rule in RULES:
        g, b = (np.bincount(list(x.get(rule, {})), list(x.get(rule, {}).values()), STEPS + 2) for x in (good, bad))
        if not g.sum() or not b.sum():
            continue
        tails = [x[::-1].cumsum()[::-1] / x.sum() for x in (g, b)]  # share of documents at each step or beyond
        if (tails[1] - tails[0])[1:].max() < LEAST_LIFT:
            continue
        for level, share in zip(out, LEVELS):
            level[rule] = 1 + int(np.argmax(tails[0][1:] <= share + 1e-12))
    return out


def risk_controlled_cutoffs(measured: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR) -> dict[tuple[int, str], int]:
    """Cutoff by (stratum, rule) from the measured documents that ``labels`` (id, good) calls good or bad.

    A document with contradicting labels counts as good. For the bound documents have to be independent draws, so each id counts
    once, with the text of the least digest, and of equal texts one does, under the least of their ids: good if any of them is.
    The driver gets at most strata x rules x steps x 2 rows of counts.
    """
    known = labels.where("good is not null").groupBy("id").agg(F.max("good").alias("good"))
    # 1: for tuning, 0: holdout.
    tuning = (F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit("tuning")), F.lit(TUNING)) == 0).alias("tuning")
    steps = [_step(r).alias(r) for r in RULES]
    told = measured.join(known, "id").select("id", "digest", "good", F.struct(_stratum().alias("stratum"), *steps).alias("x"))
    each = told.groupBy("id").agg(F.first("good").alias("good"), F.min(F.struct("digest", "x")).alias("m"))
    once = each.groupBy("m.digest").agg(F.min("id").alias("id"), F.max("good").alias("good"), F.first("m.x").alias("x"))
    held = materialize(once.select("good", tuning, "x.*"), "held")

    each = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("step")) for r in RULES])).alias("x")
    counts: dict[tuple[int, bool], dict[str, dict[int, int]]] = {}
    for r in held.where("tuning").select("good", "stratum", each).groupBy("stratum", "good", "x.rule", "x.step").count().collect():
        counts.setdefault((r["stratum"], r["good"]), {}).setdefault(r["rule"], {})[r["step"]] = r["count"]
    levels = {s: _levels(counts.get((s, True), {}), counts.get((s, False), {})) for s in range(len(STRATA) + 1)}

    # The strictest level at which a document is rejected comes out as the largest number; 0: at none.
    place = F.lit(0)
    for s, path in levels.items():
        for k, cutoffs in reversed(list(enumerate(path))):
            for rule, cut in cutoffs.items():
                place = F.when((F.col("stratum") == s) & (F.col(rule) >= cut), len(LEVELS) - k).otherwise(place)
    found: dict[int, dict[bool, dict[int, int]]] = {s: {True: {}, False: {}} for s in levels}
    for r in held.where("not tuning").groupBy("stratum", "good", place.alias("place")).count().collect():
        found[r["stratum"]][r["good"]][r["place"]] = r["count"]
    sizes = {s: sum(c[True].values()) for s, c in found.items()}
    tested = [s for s in levels if any(levels[s])]
    while any(binomial_cdf(0, sizes[s], risk) > error / len(tested) for s in tested):
        tested = [s for s in tested if binomial_cdf(0, sizes[s], risk) <= error / len(tested)]
    out = {}
    for s in tested:
        best = best_cutoff(found[s][True], found[s][False], risk, error / len(tested), len(LEVELS))
        if best:
            out |= {(s, rule): cut for rule, cut in levels[s][len(LEVELS) - best].items() if cut <= STEPS}
    return out


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", good_col: str = "quality", risk: float = RISK, error: float = ERROR) -> DataFrame:
    """One row per row of ``docs``: the id, MEASURES, base_failed, rejected_by (array of rules), kept.

    base_failed: fewer than 20 words, or more than 30% of them in 8-word windows that the text has twice or more. kept:
    neither base_failed nor beyond a cutoff of its stratum; where no cutoff can be proven, kept is ``not base_failed``. Null and empty texts have no words and fail the base rule.
    Labels without a document, with nulls and repeated ones do no harm; without labels there are no cutoffs. Rows that
    repeat are judged alike. Other columns are ignored. Empty tables give no rows.
    """
    measured = materialize(measure(docs, id_col, text_col), "measures")
    good = labels.select(F.col(id_col).alias("id"), (F.col(good_col) == 1).alias("good"))
    cutoffs = risk_controlled_cutoffs(measured, good, risk, error)
    beyond = [F.when((_stratum() == s) & (_step(r) >= c), F.lit(r)) for (s, r), c in sorted(cutoffs.items())]
    rejected = F.array_compact(F.array(*beyond)) if beyond else F.array().cast("array<string>")
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    out = measured.withColumn("base_failed", base).withColumn("rejected_by", rejected)
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0)).drop("digest").withColumnRenamed("id", id_col)
