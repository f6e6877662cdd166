"""Mixing sources to target weights along a time-varying curriculum (DataFrame functions only).

Every source gets a target of words and a weight schedule over the training time 0..1, a piecewise linear shape. The
schedule's integral, scaled to the target, is the source's cumulative token demand. The source's documents stand in a
fixed pseudo-random order; the words before a document, over all its passes, are matched with the demand, and the
demand's inverse gives the document's training position. Documents are range-sorted by position at the end.

The prefix sums never put a source into one task: documents are dealt into buckets by a digest of their id and text, so
many that a bucket has about ``BUCKET_ROWS`` rows at most; bucket sums are accumulated by a window, and a second window
runs inside each bucket. Targets are computed from one row per source, in windows over all of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize, n_words, quoted, whole_row

#: Relative weight schedules as (time, weight) knots, given to sources in turn: constant, rising, falling.
SCHEDULES = (((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (1.0, 1.5)), ((0.0, 1.5), (1.0, 0.5)))
WEIGHTS = (1, 2, 3)
MAX_REPEATS = 3
BUCKET_ROWS = 20_000


def _at_share(share: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """The time at which the schedule has used up ``share`` (0..1) of its integral."""
    segments = list(zip(knots, knots[1:]))
    areas = [(t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in segments]
    used = share * F.lit(sum(areas))
    times = []
    for k, ((t0, w0), (t1, w1)) in enumerate(segments):
        x = used - F.lit(sum(areas[:k]))
        root = F.sqrt(F.greatest(F.lit(w0 * w0) + F.lit(2 * (w1 - w0) / (t1 - t0)) * x, F.lit(0.0)))
        times.append(F.lit(t0) + F.when(x > 0, F.lit(2.0) * x / (F.lit(w0) + root)).otherwise(0.0))
    out = times[-1]
    for k in reversed(range(len(times) - 1)):
        out = F.when(used <= F.lit(sum(areas[: k + 1])), times[k]).otherwise(out)
    return out


def _position(share: Column, schedules: Sequence, schedule: Column) -> Column:
    out = F.lit(None).cast("double")
    for k, knots in enumerate(schedules):
        out = F.when(schedule == k, _at_share(share, knots)).otherwise(out)
    return F.round(out, 6)


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, max_repeats: int = MAX_REPEATS, n_schedules: int = len(SCHEDULES)) -> DataFrame:
    """Rows (source, source_size, target, schedule) for rows (source, size): targets in words.

    Sources in code-point order, null last, take the weights in turn and share the sum of all sizes. A target stops at
    ``max_repeats`` times its source's size; what is over is shared by weight among the others until none is above. In
    order of size over weight the stopped sources come first, so one pass over running sums finds where they end.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.row_number().over(by_name) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")).cast("long")
    sources = sources.withColumn("place", place).withColumn("w", weight).withColumn("cap", F.col("source_size") * max_repeats)
    tight = Window.orderBy(F.col("cap") / F.col("w"), "place")
    everything = Window.partitionBy()
    left = F.sum("source_size").over(everything) - F.sum("cap").over(tight) + F.col("cap")
    share = F.sum("w").over(everything) - F.sum("w").over(tight) + F.col("w")
    sources = sources.withColumn("level", left / share).withColumn("k", F.row_number().over(tight))
    first = F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.col("k"))).over(everything)
    sources = sources.withColumn("first", first)
    level = F.max(F.when(F.col("k") == F.col("first"), F.col("level"))).over(everything)
    target = F.when(F.col("k") < F.col("first"), F.col("cap").cast("double")).otherwise(level * F.col("w"))
    return sources.select("source", "source_size", F.coalesce(target, F.col("cap").cast("double")).alias("target"), (F.col("place") % n_schedules).alias("schedule"))


def _decided(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: Sequence[int], max_repeats: int, schedules: Sequence, bucket_rows: int, number: tuple[str, ...] = ()) -> DataFrame:
    """Rows of ``docs`` as (id, digest, size, source_size, target, taken, start, quota, schedule) and ``number``, which tells rows apart that are equal in all of that."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col)).alias("size"), _digest(id_col, text_col).alias("digest"), *number)
    rows = materialize(rows, "sizes")
    digits = 1
    while 16**digits * bucket_rows < rows.count():
        digits += 1
    rows = rows.withColumn("bucket", F.substring("digest", 1, digits))
    buckets = materialize(rows.groupBy("source", "bucket").agg(F.sum("size").alias("size")), "buckets")
    running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = buckets.select("source", F.col("bucket").alias("b"), F.coalesce(F.sum("size").over(running), F.lit(0)).alias("offset"))
    targets = source_targets(buckets, weights, max_repeats, len(schedules)).withColumnRenamed("source", "s")
    plan = materialize(offsets.join(targets, F.col("source").eqNullSafe(F.col("s"))).drop("source"), "plan")

    inside = Window.partitionBy("source", "bucket").orderBy("digest", "id", "size", *number).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.join(plan, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    rows = rows.withColumn("start", F.col("offset") + F.col("before")).withColumn("quota", F.round("target").cast("long"))
    rows = rows.withColumn("passes", F.when(F.col("source_size") > 0, F.expr("quota div source_size")).otherwise(0))
    part = F.least(F.col("size"), F.col("quota") - F.col("passes") * F.col("source_size") - F.col("start"))
    taken = F.col("passes") * F.col("size") + F.greatest(F.lit(0), part)
    return rows.select("id", "digest", "size", "source_size", "target", taken.cast("long").alias("taken"), "start", "quota", "schedule", *number)


def _digest(id_col: str, text_col: str) -> Column:
    """Of id and text: rows with null or repeated ids are told apart, and fall into different buckets."""
    text = F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    return F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), text).cast("binary"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = WEIGHTS, max_repeats: int = MAX_REPEATS, schedules: Sequence = SCHEDULES, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row per row of ``docs``, range-sorted by position: id, size, source_size, target, taken, position.

    size is the number of words (0 for null or empty texts), taken the words that the mix takes of this document over
    all passes: the passes that the target holds in full, and in the last pass the documents before the point where the
    target is met, the document at that point with as many of its words as are left. A source's taken words sum up to its
    rounded target. position is the training time 0..1 of the first use, rounded to 6 digits, null if nothing is taken.
    Null is a source like any other; rows that repeat are counted as often as they stand; other columns are ignored. An
    empty table gives no rows. The order comes from the md5 digest of id and text, so reruns agree.
    """
    rows = _decided(docs, id_col, text_col, source_col, weights, max_repeats, schedules, bucket_rows)
    position = F.when(F.col("taken") > 0, _position(F.col("start") / F.col("quota"), schedules, F.col("schedule")))
    out = rows.select(F.col("id").alias(id_col), "size", "source_size", "target", "taken", position.alias("position"))
    return out.orderBy(F.col("position").asc_nulls_last(), id_col)


def training_stream(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = WEIGHTS, max_repeats: int = MAX_REPEATS, schedules: Sequence = SCHEDULES, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """The mixed documents: the columns of ``docs``, a row for each use of a document, range-sorted by training position.

    A document taken twice stands twice. Documents are used whole: the one at its source's target, which the mix takes
    in part, has one more use if that part is at least half of it, so a source's words differ from its target by at most
    half a document. Documents without a use have no row. Null is a source like any other. Rows are numbered first, so those that
    repeat an id or a text, in one source or several, have uses of their own. Columns may have any names; an empty table gives no rows.
    """
    numbered = _placed(docs)
    inside = [F.col(f"row.{quoted(c)}").alias(n) for c, n in ((id_col, "id"), (text_col, "text"), (source_col, "source"))]
    rows = _decided(numbered.select(*inside, *PLACE), "id", "text", "source", weights, max_repeats, schedules, bucket_rows, PLACE).where("taken > 0")
    rows = rows.withColumn("uses", F.round(F.col("taken") / F.col("size")).cast("int")).where("uses > 0")
    own = [F.col(c).alias(f"own_{c}") for c in PLACE]
    rows = materialize(rows.select(*own, "digest", "start", "uses", "source_size", "quota", "schedule"), "decided").hint("merge")
    out = numbered.join(rows, [F.col(c) == F.col(f"own_{c}") for c in PLACE]).withColumn("use", F.explode(F.sequence(F.lit(0), F.col("uses") - 1)))
    share = (F.col("start") + F.col("use") * F.col("source_size")) / F.col("quota")
    position = _position(F.least(share, F.lit(1.0)), schedules, F.col("schedule"))
    return out.withColumn("position", position).orderBy("position", "digest", *PLACE, "use").select("row.*")


#: What tells rows apart that are equal in everything else: the file they stand in, and their place there.
PLACE = ("in_file", "at_row")


def _placed(docs: DataFrame) -> DataFrame:
    """Rows (row, PLACE) for the rows of ``docs``.

    Parquet files give each row's place themselves. Other frames are written first, so that what is read again has the same places.
    """
    try:
        at = docs.metadataColumn("_metadata")
        return docs.select(whole_row(docs), at["file_path"].alias(PLACE[0]), at["row_index"].alias(PLACE[1]))
    except AnalysisException:
        return materialize(docs.select(whole_row(docs), F.lit("").alias(PLACE[0]), F.monotonically_increasing_id().alias(PLACE[1])), "numbered")



SQL = f"""
WITH rows AS (
  SELECT doc_id AS id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS digest
  FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS place
  FROM rows GROUP BY source
), weighed AS (
  SELECT *, place % 3 + 1 AS w, 3 * source_size AS cap FROM sources
), levels AS (
  SELECT *, row_number() OVER tight AS k,
         CAST(sum(source_size) OVER () - sum(cap) OVER tight + cap AS DOUBLE)
           / CAST(sum(w) OVER () - sum(w) OVER tight + w AS DOUBLE) AS level
  FROM weighed WINDOW tight AS (ORDER BY CAST(cap AS DOUBLE) / CAST(w AS DOUBLE), place)
), firsts AS (
  SELECT *, min(CASE WHEN level * w <= cap THEN k END) OVER () AS first FROM levels
), targets AS (
  SELECT source, source_size, place, coalesce(CASE WHEN k < first THEN CAST(cap AS DOUBLE)
         ELSE max(CASE WHEN k = first THEN level END) OVER () * w END, CAST(cap AS DOUBLE)) AS target
  FROM firsts
), placed AS (
  SELECT r.id, r.size, t.source_size, t.target, t.place, CAST(round(t.target) AS BIGINT) AS quota,
         CAST(coalesce(sum(r.size) OVER (PARTITION BY r.source ORDER BY r.digest, r.id, r.size
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM rows r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source
), taken AS (
  SELECT *, CASE WHEN source_size > 0 THEN quota // source_size ELSE 0 END AS passes FROM placed
), shares AS (
  SELECT *, CAST(passes * size + greatest(0, least(size, quota - passes * source_size - start)) AS BIGINT) AS taken,
         CASE WHEN quota > 0 THEN CAST(start AS DOUBLE) / CAST(quota AS DOUBLE) END AS share
  FROM taken
)
SELECT id AS doc_id, CAST(size AS BIGINT) AS size, source_size, target, taken,
       CASE WHEN taken > 0 THEN round(CASE place % 3
         WHEN 0 THEN share
         WHEN 1 THEN CASE WHEN share > 0 THEN 2.0 * share / (0.5 + sqrt(greatest(0.25 + 2.0 * share, 0.0))) ELSE 0.0 END
         ELSE CASE WHEN share > 0 THEN 2.0 * share / (1.5 + sqrt(greatest(2.25 - 2.0 * share, 0.0))) ELSE 0.0 END
       END, 6) END AS position
FROM shares
"""
