"""Collocations: frequent phrases and how much more often their words stand together than apart, by pivot partitioning.

1. Texts become shards of about ``SHARD_BYTES``, one row for each shard and language: the distinct words with their counts, and the
   text as a row of word places, with marks between pieces. Shards are written once; later steps read them, never the texts.
2. Word counts are summed over shards. Words with fewer than ``least`` occurrences are in no frequent phrase; the others are
   numbered by falling frequency. Each shard gets the numbers of its own words back by a join, so nobody holds a table of all.
3. Every occurrence of a word is a pivot. The words around it within the phrase length are its fragment, rewritten: it ends at
   piece marks, at infrequent words and at words rarer than the pivot, to the left also at the pivot's own word, so that a phrase
   in which its rarest word stands twice belongs to the first. Fragments go to their pivot's bucket.
4. A bucket counts the phrases that hold the pivot of their fragment. As all fragments of a pivot are in one bucket, the counts are
   exact there, and rare phrases end there. Pivots with more than ``SHARE`` occurrences are dealt out over several buckets, whose counts
   are added up. The number of buckets follows the number of words, so a bucket has about ``FRAGMENTS`` fragments at any size.
5. Cuts look up their two sides among the frequent phrases and words, which hold them all; longer phrases are told to those inside them.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, materialize, numbered

MAX_WORDS, LEAST, COVERED_PERCENT, TOP = 3, 10, 50, 2000
UNKNOWN = "und"
#: Characters that end a piece; words inside it are separated by spaces and tabs.
ENDS = ".,;:!?\n\v\f\r"
SHARD_BYTES, FRAGMENTS, SHARE = 8 << 20, 1 << 18, 1 << 17
#: Fragments that a task keeps before it deals them out.
KEPT_FRAGMENTS = 2 << 20
BROADCAST_LANGUAGES = 10_000
#: A byte that is in no UTF-8 text stands for a piece's end.
_MARK = b"\xff"
_TABLE = bytes.maketrans((UPPER + ENDS).encode(), LOWER.encode() + _MARK * len(ENDS))
SHARD = "shard long, lang string, n_words long, words array<string>, counts array<long>, stream binary"


class _Shard:
    """The texts of one language in a shard: word places in order of their first occurrence from 1 on, 0 for a mark."""

    def __init__(self):
        self.places: defaultdict[bytes, int] = defaultdict(count().__next__)
        self.places[_MARK]
        self.stream: list[np.ndarray] = []

    def add(self, text: bytes) -> None:
        words = (_MARK + text.translate(_TABLE)).replace(_MARK, b" " + _MARK + b" ").split()
        self.stream.append(np.fromiter(map(self.places.__getitem__, words), np.uint32, len(words)))

    def row(self, shard: int, lang: str) -> pa.RecordBatch:
        stream = np.concatenate(self.stream)
        counts = np.bincount(stream, minlength=len(self.places))[1:]
        words = pa.array(list(self.places)[1:], pa.binary()).cast(pa.string())
        whole = [0, len(counts)]
        columns = [
            pa.array([shard], pa.int64()), pa.array([lang], pa.string()), pa.array([int(counts.sum())], pa.int64()), pa.ListArray.from_arrays(whole, words),
            pa.ListArray.from_arrays(whole, pa.array(counts, pa.int64())), pa.array([stream.astype("<u4").tobytes()], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in SHARD.split(", ")])


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number, size, open_shards = TaskContext.get().partitionId() << 32, 0, defaultdict(_Shard)
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary())):
            text = text.as_py() or b""
            open_shards[lang].add(text)
            size += len(text)
            if size >= SHARD_BYTES:
                for lang, shard in open_shards.items():
                    yield shard.row(number, lang)
                    number += 1
                size, open_shards = 0, defaultdict(_Shard)
    for lang, shard in open_shards.items():
        yield shard.row(number, lang)
        number += 1


def _pack(rows: np.ndarray) -> bytes:
    """Rows of unsigned 32-bit numbers: column by column, byte by byte, packed."""
    return zstandard.compress(np.ascontiguousarray(rows.astype("<u4").T).view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _unpack(data: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(width, -1).T


def fragments(stream: np.ndarray, max_words: int = MAX_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Rewritten fragments of a row of word numbers (0: no word of a phrase): the places of their pivots, and rows of 2 * max_words - 1
    numbers with the pivot in the middle, 0 from where a side ends. Pivots with nothing beside them have none."""
    reach = max_words - 1
    padded = np.zeros(len(stream) + 2 * reach, np.uint32)
    padded[reach : reach + len(stream)] = stream
    at = np.flatnonzero(stream)
    pivot = stream[at]
    out = np.zeros((len(at), 2 * reach + 1), np.uint32)
    out[:, reach] = pivot
    for side in (-1, 1):
        going = np.ones(len(at), bool)
        for k in range(1, reach + 1):
            word = padded[at + reach + side * k]
            going &= (word > 0) & (word < pivot if side < 0 else word <= pivot)
            out[going, reach + side * k] = word[going]
    keep = (out[:, reach - 1] > 0) | (out[:, reach + 1] > 0) if reach else np.zeros(len(at), bool)
    return at[keep], out[keep]


def _dealt(rows: np.ndarray, salts: np.ndarray, n_buckets: int) -> np.ndarray:
    """The bucket of each fragment, by pivot; those of pivots with several salts, by pivot and salt, are numbered from ``n_buckets`` on."""
    pivot = rows[:, rows.shape[1] // 2].astype(np.uint64)
    salt = (np.arange(len(rows)) % salts).astype(np.uint64)
    mixed = (pivot * np.uint64(0x9E3779B97F4A7C15)) ^ (salt * np.uint64(0xC2B2AE3D27D4EB4F))
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((mixed >> np.uint64(32)) % np.uint64(n_buckets)).astype(np.int64) + np.where(salts > 1, n_buckets, 0)


def _routed(max_words: int, n_buckets: int):
    def batch_of(rows: np.ndarray, salts: np.ndarray) -> pa.RecordBatch:
        bucket = _dealt(rows, salts, n_buckets)
        order = np.argsort(bucket, kind="stable")
        bucket, rows = bucket[order], rows[order]
        cuts = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1))
        parts = [_pack(rows[a:b]) for a, b in zip(cuts, cuts[1:])]
        return pa.RecordBatch.from_arrays([pa.array(bucket[cuts[:-1]], pa.int64()), pa.array(parts, pa.binary())], ["bucket", "rows"])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, n = [], 0
        for batch in batches:
            for k in range(len(batch)):
                stream = np.frombuffer(batch.column("stream")[k].as_py(), "<u4")
                known = batch.column("known")[k].values
                place, number, salts = (known.field(f).to_numpy() for f in ("place", "number", "salts"))
                numbers, dealt = np.zeros(int(stream.max()) + 1, np.uint32), np.ones(int(stream.max()) + 1, np.int64)
                numbers[place], dealt[place] = number, salts
                at, rows = fragments(numbers[stream], max_words)
                kept.append((rows, dealt[stream[at]]))
                n += len(rows)
                if n >= KEPT_FRAGMENTS:
                    yield batch_of(*map(np.concatenate, zip(*kept)))
                    kept, n = [], 0
        if n:
            yield batch_of(*map(np.concatenate, zip(*kept)))

    return route


def count_phrases(rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """By length from 2 on the phrases that hold their fragment's pivot, as rows of numbers, and their counts."""
    middle = rows.shape[1] // 2
    bits = max(1, int(rows.max()).bit_length())
    for length in range(2, middle + 2):
        found = []
        for first in range(middle - length + 1, middle + 1):
            if first >= 0 and first + length <= rows.shape[1]:
                words = rows[:, first : first + length]
                found.append(words[(words[:, [0, -1]] > 0).all(1)])
        words = np.concatenate(found).astype(np.uint64)
        if length * bits <= 64:
            keys, counts = np.unique(_joined(words, bits), return_counts=True)
            shifts = np.arange((length - 1) * bits, -1, -bits).astype(np.uint64)
            yield ((keys[:, None] >> shifts) & np.uint64((1 << bits) - 1)).astype(np.int64), counts
        else:  # prefixes get numbers of their own, word by word
            keys = words[:, 0]
            for k in range(1, length):
                keys, inverse, counts = np.unique(_joined(np.stack([keys, words[:, k]], 1), 32), return_inverse=True, return_counts=True)
                keys = inverse.astype(np.uint64)
            some = np.zeros(len(counts), np.int64)
            some[inverse] = np.arange(len(words))
            yield words[some].astype(np.int64), counts


def _joined(words: np.ndarray, bits: int) -> np.ndarray:
    out = words[:, 0].copy()
    for k in range(1, words.shape[1]):
        out = (out << np.uint64(bits)) | words[:, k]
    return out


def _mined(max_words: int, n_buckets: int, least: int):
    def mine(group: pa.Table) -> pa.Table:
        whole = group.column("bucket")[0].as_py() < n_buckets
        rows = np.concatenate([_unpack(x.as_py(), 2 * max_words - 1) for x in group.column("rows")])
        phrases, totals = [], []
        for words, counts in count_phrases(rows):
            keep = counts >= (least if whole else 1)
            words, counts = words[keep], counts[keep]
            phrases.append(pa.ListArray.from_arrays(pa.array(np.arange(len(words) + 1) * words.shape[1], pa.int32()), pa.array(words.ravel(), pa.int64())))
            totals.append(pa.array(counts, pa.int64()))
        n = sum(map(len, totals))
        return pa.table({"phrase": pa.chunked_array(phrases, pa.list_(pa.int64())), "a": pa.chunked_array(totals, pa.int64()), "whole": pa.array([whole] * n, pa.bool_())})

    return mine


def frequent_phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", max_words: int = MAX_WORDS, least: int = LEAST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Frequent phrases (phrase, a), with words as numbers; frequent words (lang, word, f, number); sizes (lang, n)."""
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang")
    shards = materialize(docs.select(lang, F.col(text_col).alias("text")).mapInArrow(_shards, SHARD), "shards")
    words = shards.select("shard", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("place", "w"))
    words = words.select("shard", "lang", (F.col("place") + 1).alias("place"), F.col("w.words").alias("word"), F.col("w.counts").alias("n"))
    vocabulary = words.groupBy("lang", "word").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    frequent = materialize(numbered(materialize(vocabulary, "vocabulary"), F.desc("f"), F.col("lang"), F.col("word"), name="by-frequency"), "frequent")
    stated = frequent.agg(F.count("*").alias("n"), F.coalesce(F.sum("f"), F.lit(0)).alias("f")).first()
    if stated["n"] >= 1 << 32:
        raise ValueError("word numbers have 32 bits")
    n_buckets = 1 + stated["f"] // FRAGMENTS

    salts = F.ceil(F.col("f") / SHARE).alias("salts")
    numbers = words.select("shard", "lang", "place", "word").join(frequent.select("lang", "word", "number", salts), ["lang", "word"])
    known = numbers.groupBy("shard").agg(F.collect_list(F.struct("place", "number", "salts")).alias("known"))
    routed = shards.select("shard", "stream").join(known, "shard").select("stream", "known").mapInArrow(_routed(max_words, n_buckets), "bucket long, rows binary")
    mined = materialize(routed.groupBy("bucket").applyInArrow(_mined(max_words, n_buckets, least), "phrase array<long>, a long, whole boolean"), "mined")
    added = mined.where("not whole").groupBy("phrase").agg(F.sum("a").alias("a")).where(F.col("a") >= least)
    phrases = materialize(mined.where("whole").select("phrase", "a").unionByName(added), "phrases")
    return phrases, frequent, shards.groupBy("lang").agg(F.sum("n_words").alias("n"))


def _score(a: str, left: str, right: str) -> Column:
    """floor(1,000,000 a a / (l r)) in whole numbers of up to 38 digits."""
    wide = lambda x: f"cast({x} as decimal(15, 0))"
    return F.expr(f"{wide(a)} * {wide(a)} * 1000000 div ({wide(left)} * {wide(right)})")


def collocations(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", max_words: int = MAX_WORDS, least: int = LEAST, covered_percent: int = COVERED_PERCENT, top: int = TOP
) -> DataFrame:
    """The first ``top`` phrases of each language (null: ``und``): lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z only) and cut into pieces and words; a phrase is 2 to ``max_words`` words next to each other in
    a piece and occurs a >= ``least`` times, overlaps included. Cutting it after its first words gives l and r, the counts of both
    sides, and floor(1,000,000 a a / (l r)); its lowest cut counts, of equal ones the first. Phrases inside a longer one that has
    ``covered_percent`` per cent of their occurrences are left out. Ties go to larger a, then to the smaller phrase by bytes.
    Null and empty texts have no words; rows that repeat count as often as they stand; other columns are ignored; an empty
    table, or one without frequent phrases, gives no rows.
    """
    phrases, frequent, sizes = frequent_phrases(docs, text_col, lang_col, max_words, least)
    known = phrases.unionByName(frequent.select(F.array("number").alias("phrase"), F.col("f").alias("a")))
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("phrase") - 1)))
    cuts = cuts.withColumns({"left": F.slice("phrase", F.lit(1), F.col("k")), "right": F.slice("phrase", F.col("k") + 1, F.size("phrase") - F.col("k"))})
    cuts = cuts.join(known.select(F.col("phrase").alias("left"), F.col("a").alias("l")), "left").join(known.select(F.col("phrase").alias("right"), F.col("a").alias("r")), "right")
    lowest = F.min(F.struct(_score("a", "l", "r").alias("score"), "k", "l", "r")).alias("cut")
    scored = cuts.groupBy("phrase", "a").agg(lowest).select("phrase", "a", "cut.l", "cut.r", "cut.score")

    inside = F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.size("phrase") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.size("phrase") - n + 1), lambda at: F.slice("phrase", at, n)))))
    longer = phrases.where(F.size("phrase") > 2).select("a", inside.alias("part")).groupBy(F.col("part").alias("phrase")).agg(F.max("a").alias("most"))
    scored = scored.join(longer, "phrase", "left").where("most is null or 100 * most < %d * a" % covered_percent).drop("most")

    spelled = scored.select("*", F.posexplode("phrase").alias("at", "number")).join(frequent.select("number", "lang", "word"), "number")
    spelled = spelled.groupBy("phrase", "a", "l", "r", "score").agg(F.first("lang").alias("lang"), F.sort_array(F.collect_list(F.struct("at", "word"))).alias("words"))
    spelled = materialize(spelled.select("lang", F.array_join("words.word", " ").alias("phrase"), "a", "l", "r", "score"), "spelled")

    ranked = numbered(spelled, F.col("lang"), F.desc("score"), F.desc("a"), F.col("phrase"), name="ranked")
    first = materialize(ranked.groupBy("lang").agg(F.min("number").alias("first")).join(sizes, "lang"), "languages")
    # A row for each language; of more than could be broadcast safely, rows meet by language, and Spark splits large ones.
    first = F.broadcast(first) if first.count() <= BROADCAST_LANGUAGES else first
    ranked = ranked.join(first, "lang").withColumn("rank", F.col("number") - F.col("first") + 1).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


SQL = rf"""
WITH pieces AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w
  FROM (SELECT coalesce(lang, '{UNKNOWN}') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)
), runs AS (
  SELECT lang, 1 AS m, unnest(w) AS phrase FROM pieces
  UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM pieces
  UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM pieces
), f AS MATERIALIZED (
  SELECT lang, m, phrase, count(*) AS a FROM runs GROUP BY lang, m, phrase HAVING count(*) >= {LEAST} OR m = 1
), cuts AS (
  SELECT lang, m, phrase, a, unnest(range(1, m)) AS k, string_split(phrase, ' ') AS w FROM f WHERE m > 1
), valued AS (
  SELECT c.lang, c.phrase, c.m, c.a, c.k, l.a AS l, r.a AS r,
         CAST(1000000::HUGEINT * c.a * c.a // (l.a::HUGEINT * r.a) AS BIGINT) AS score
  FROM cuts c
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[:c.k], ' ')
  JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[c.k + 1:], ' ')
), lowest AS (
  SELECT * FROM valued QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), covered AS (
  SELECT lang, part, max(a) AS most
  FROM (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS part
        FROM (SELECT lang, a, string_split(phrase, ' ') AS w FROM f WHERE m = 3))
  GROUP BY lang, part
), sizes AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE m = 1 GROUP BY lang),
ranked AS (
  SELECT o.lang, row_number() OVER (PARTITION BY o.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
  FROM lowest o JOIN sizes USING (lang) LEFT JOIN covered c ON c.lang = o.lang AND c.part = o.phrase
  WHERE most IS NULL OR 100 * most < {COVERED_PERCENT} * a
)
SELECT * FROM ranked WHERE rank <= {TOP}
"""
