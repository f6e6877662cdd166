"""Importance resampling towards a target distribution: hashed n-gram counts by DuckDB inside each task, the rest by Spark.

A task hands its texts to an embedded DuckDB, piece by piece, none larger than ``PIECE_BYTES`` or one text. One statement cuts
the words (unnest), forms runs of consecutive words (windows), counts them by text and puts each distinct one into a bucket
by zlib's CRC-32, a function registered for it. What comes out, a list of buckets and counts for each text, is spilled to Parquet
in the shared folder; it is all that is read later, texts are read once. Spark sums the buckets of all documents and of the target,
weighs each document by its buckets' gains, adds Gumbel noise that hangs on the id alone, and ranks by sorted ranges.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, materialize, numbered

#: A word is a maximal run of ASCII digits and lower-case letters and of characters outside ASCII, after lower-casing A-Z.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
MAX_N, BUCKETS, MIN_WORDS, PERCENT, SEED = 1, 10_000, 20, 10, 2024
PIECE_BYTES = 4 << 20
#: What an embedded database may take at most; it has no folder to spill to.
DUCKDB = {"threads": 1, "memory_limit": "600MB", "temp_directory": ""}


def _statement(max_n: int, buckets: int) -> str:
    runs = ["SELECT row, word AS gram FROM words"]
    for n in range(2, max_n + 1):
        following = [f"lead(word, {k}) OVER w" for k in range(1, n)]
        runs.append(f"SELECT row, concat_ws(' ', word, {', '.join(following)}) FROM words WINDOW w AS (PARTITION BY row ORDER BY place) QUALIFY {following[-1]} IS NOT NULL")
    return f"""
WITH cut AS MATERIALIZED (SELECT row, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM texts),
words AS MATERIALIZED (SELECT row, unnest(w) AS word, generate_subscripts(w, 1) AS place FROM cut),
counted AS MATERIALIZED (SELECT row, gram, count(*) AS n FROM ({" UNION ALL ".join(runs)}) GROUP BY row, gram),
placed AS MATERIALIZED (SELECT gram, crc32(gram) % {buckets} AS bucket FROM (SELECT DISTINCT gram FROM counted)),
summed AS (SELECT row, bucket, sum(n) AS n FROM counted JOIN placed USING (gram) GROUP BY row, bucket),
listed AS (SELECT row, list(bucket ORDER BY bucket) AS buckets, list(n ORDER BY bucket) AS counts, sum(n) AS n_features FROM summed GROUP BY row)
SELECT len(w)::BIGINT AS n_words, coalesce(n_features, 0)::BIGINT AS n_features,
       coalesce(buckets, [])::INTEGER[] AS buckets, coalesce(counts, [])::BIGINT[] AS counts
FROM cut LEFT JOIN listed USING (row) ORDER BY row"""


def _crc32(grams: pa.ChunkedArray) -> pa.Array:
    return pa.array(map(zlib.crc32, grams.cast(pa.binary()).to_pylist()), pa.int64())


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of the batch with about PIECE_BYTES of text, one text at least."""
    first, size = 0, 0
    for k, n in enumerate(pc.binary_length(batch.column("text")).to_pylist()):
        if k > first and size + (n or 0) > PIECE_BYTES:
            yield batch.slice(first, k - first)
            first, size = k, 0
        size += n or 0
    if first < len(batch):
        yield batch.slice(first)


def bucket_counts(docs: DataFrame, id_col: str | None = "doc_id", text_col: str = "text", max_n: int = MAX_N, buckets: int = BUCKETS) -> DataFrame:
    """Rows (id, n_words, n_features, buckets, counts), one per row of ``docs``: its runs of 1 to ``max_n`` words by bucket."""
    statement = _statement(max_n, buckets)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        with duckdb.connect(":memory:", config=DUCKDB) as db:
            db.create_function("crc32", _crc32, ["VARCHAR"], "BIGINT", type="arrow")
            for batch in batches:
                for piece in _pieces(batch):
                    db.register("texts", pa.table({"row": pa.array(range(len(piece)), pa.int32()), "text": piece.column("text").fill_null("")}))
                    found = db.sql(statement).to_arrow_table().combine_chunks()
                    db.unregister("texts")
                    lists = [found[c].combine_chunks() for c in ("n_words", "n_features", "buckets", "counts")]
                    yield pa.RecordBatch.from_arrays([piece.column("id"), *lists], ["id", "n_words", "n_features", "buckets", "counts"])

    key = F.col(id_col) if id_col else F.lit(None).cast("int")
    rows = docs.select(key.alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(counted, f"id {kind}, n_words long, n_features long, buckets array<int>, counts array<long>")


def bucket_gains(counts: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Rows (bucket, s, t, gain) for the buckets of ``counts``: how much likelier a feature of the bucket is in the target, in thousandths of a nat."""
    each = lambda df, n: df.select(F.inline(F.arrays_zip("buckets", "counts"))).groupBy(F.col("buckets").alias("bucket")).agg(F.sum("counts").alias(n))
    s, t = each(counts, "s"), each(target, "t")
    features = lambda df: df.agg(F.coalesce(F.sum("n_features"), F.lit(0))).first()[0]
    all_s, all_t = features(counts), features(target)
    double = lambda x: x.cast("double")
    t_n = F.coalesce("t", F.lit(0))
    ratio = double(t_n + 1) * double(F.lit(all_s + buckets)) / (double(F.col("s") + 1) * double(F.lit(all_t + buckets)))
    return s.join(t, "bucket", "left").select("bucket", "s", t_n.alias("t"), F.floor(1000 * F.log(ratio)).alias("gain"))


def _weight(gains: dict[int, int], buckets: int) -> Column:
    """The sum of gains over a row's features. The gains are one constant array with an entry for each bucket."""
    constant = F.split(F.lit(",".join(str(gains.get(b, 0)) for b in range(buckets))), ",").cast("array<bigint>")
    each = F.zip_with("buckets", "counts", lambda b, n: F.get(constant, b) * n)
    return F.aggregate(each, F.lit(0).cast("bigint"), lambda total, x: total + x)


def noise(id_col: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, from the id alone: reruns and other partitions give the same."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))


def resample(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text_col: str = "text",
    max_n: int = MAX_N,
    buckets: int = BUCKETS,
    min_words: int = MIN_WORDS,
    percent: int = PERCENT,
    seed: int = SEED,
) -> DataFrame:
    """One row per row of ``docs``: the id, n_features, weight, score, rank.

    weight is the sum of the gains of the document's features, score the weight with Gumbel noise, so that the highest scores
    are a draw without replacement in proportion to exp(weight / 1000). Of the documents with ``min_words`` words or more
    ``percent`` per cent (rounded down) are drawn; rank numbers them from 1, null for all others. Ties go to the smaller
    id, a null id comes last. A null or empty text has no features, weight 0 and no rank; an empty target makes rare
    buckets likelier, no special case. Rows that repeat count, and are drawn, as often as they stand. ``buckets`` bounds
    what the driver sees: one gain for each. Other columns are ignored; an empty table gives no rows.
    """
    counts = materialize(bucket_counts(docs, id_col, text_col, max_n, buckets), "bucket-counts")
    wanted = materialize(bucket_counts(target, None, target_text_col, max_n, buckets), "target-counts")
    gains = {r["bucket"]: r["gain"] for r in bucket_gains(counts, wanted, buckets).select("bucket", "gain").collect()}
    weighed = counts.select("id", "n_words", "n_features", _weight(gains, buckets).alias("weight"))
    scored = materialize(weighed.withColumn("score", F.col("weight") + noise(F.col("id"), seed)), "scored")

    able = scored.where(F.col("n_words") >= min_words)
    drawn = able.count() * percent // 100
    rank = F.when(F.col("number") <= drawn, F.col("number"))
    ranked = numbered(able, F.desc("score"), F.col("id").asc_nulls_last(), name="ranked").withColumn("rank", rank).drop("number")
    out = ranked.unionByName(scored.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long")))
    return out.select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")


#: CRC-32 by its table of 256 entries, which the first statement makes from the polynomial; bytes come from the hexadecimal text.
SQL = f"""
WITH crc AS (
  SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, i:
           CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b)) AS entries
), texts AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents
), places AS (
  SELECT word, xor(list_reduce(list_transform(range(octet_length(encode(word))), lambda i: CAST('0x' || substr(hex(encode(word)), 2 * i + 1, 2) AS BIGINT)),
           lambda c, b: xor(c >> 8, entries[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT unnest(w) AS word FROM texts UNION SELECT DISTINCT unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}')) FROM benchmark), crc
), numbered_texts AS (
  SELECT row_number() OVER () AS rowid, doc_id, w FROM texts
), features AS (
  SELECT row, bucket FROM (SELECT rowid AS row, unnest(w) AS word FROM numbered_texts) JOIN places USING (word)
), s AS (SELECT bucket, count(*) AS s FROM features GROUP BY bucket),
t AS (
  SELECT bucket, count(*) AS t
  FROM (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}')) AS word FROM benchmark) JOIN places USING (word)
  GROUP BY bucket
), totals AS (SELECT (SELECT coalesce(sum(s), 0) FROM s) AS all_s, (SELECT coalesce(sum(t), 0) FROM t) AS all_t),
gains AS (
  SELECT bucket, CAST(floor(1000 * ln(CAST(coalesce(t, 0) + 1 AS DOUBLE) * CAST(all_s + 10000 AS DOUBLE) / (CAST(s + 1 AS DOUBLE) * CAST(all_t + 10000 AS DOUBLE)))) AS BIGINT) AS gain
  FROM s LEFT JOIN t USING (bucket), totals
), weights AS (SELECT row, sum(gain) AS weight FROM features JOIN gains USING (bucket) GROUP BY row),
scores AS (
  SELECT rowid, doc_id, len(w) AS n, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
         CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5) / 4294967296.0))) AS BIGINT) AS score
  FROM numbered_texts LEFT JOIN weights ON rowid = row
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n >= 20 ORDER BY score DESC, doc_id ASC NULLS LAST) AS place, count(*) OVER (PARTITION BY n >= 20) AS able FROM scores
)
SELECT doc_id, CAST(n AS BIGINT) AS n_features, weight, score, CASE WHEN n >= 20 AND place <= 10 * able // 100 THEN place END AS rank
FROM ranked
"""
