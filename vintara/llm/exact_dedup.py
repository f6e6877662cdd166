"""Exact deduplication by deterministic block naming (DataFrame functions only).

A text is cut into blocks of a fixed number of characters. The distinct blocks are sorted and numbered, so that each
block gets an integer name that no other block has; then the distinct pairs of adjacent names are sorted and numbered,
and so on, until every document has one name left. Names are handed out by counting in sorted order, not by hashing:
two documents of one length share their last name exactly when their texts are equal.

A document needs names only as long as another one could still equal it. Documents that are alone with their length
and first characters are done after the first step, and documents no longer than these characters as well; on the
usual corpus that leaves the copies and near copies. The rest move through three shuffles per level, each of them
on a key that Spark may split when it is hot (joins) or sum up before the shuffle (distinct, max, count).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, fold_ascii, materialize, whole_row


#: Bits of the digest that make a range, in which names are handed out.
RANGES = 10


def _named(keys: DataFrame, name: str) -> DataFrame:
    """Distinct rows of ``keys``, sorted, each with its place in sorted order, from 1 on, as its integer ``name``.

    The order is that of a 64-bit digest, then of the rows themselves. Rows are sorted and counted within ``1 << RANGES``
    fixed ranges of the digest, which are even whatever the blocks have in common, and each range goes on where the one
    before it ended; so the same rows get the same names on every run. Names count rows, so equal digests do no harm.
    Written at once: all readers see the same names, also after an executor is lost.
    """
    digest = F.xxhash64(*keys.columns)
    rows = keys.distinct().withColumn("digest", digest).withColumn("range", F.shiftrightunsigned("digest", 64 - RANGES))
    rows = materialize(rows, f"{name}_sorted")
    earlier = Window.orderBy("of").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(F.col("range").alias("of")).agg(F.count("*").alias("n"))
    # At most as many rows as there are ranges.
    starts = F.broadcast(counts.select("of", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start")))
    place = F.row_number().over(Window.partitionBy("range").orderBy("digest", *keys.columns))
    named = rows.withColumn("place", place).join(starts, F.col("range") == F.col("of"))
    return materialize(named.select(*keys.columns, (F.col("start") + F.col("place")).alias("name")), name)


def block_identities(texts: DataFrame) -> DataFrame:
    """Rows (row, n, name) for rows (row, n, blocks): equal (n, name) means equal text. ``blocks`` is not empty."""
    current = texts.select("row", "n", F.size("blocks").alias("left"), F.posexplode("blocks").alias("i", "l"))
    names = _named(current.select("l"), "block_names")
    current = current.join(names, "l").select("row", "n", "left", "i", "name")
    longest = texts.agg(F.max(F.size("blocks"))).first()[0] or 0
    done = []
    while True:
        current = materialize(current, "named")
        done.append(current.where("left = 1").select("row", "n", "name"))
        if longest <= 1:
            return reduce(DataFrame.unionByName, done)
        half = lambda k: F.max(F.when(F.col("i") % 2 == k, F.col("name")))
        pairs = (
            current.where("left > 1")
            .groupBy("row", "n", F.ceil(F.col("left") / 2).cast("int").alias("left"), F.shiftright("i", 1).alias("i"))
            .agg(half(0).alias("l"), F.coalesce(half(1), F.lit(0)).alias("r"))
        )
        names = _named(pairs.select("l", "r"), "pair_names")
        current = pairs.join(names, ["l", "r"]).select("row", "n", "left", "i", "name")
        longest = -(-longest // 2)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = 4096, head_chars: int = 64) -> DataFrame:
    """One row per row of ``docs``: the id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical after lower-casing A-Z; null counts as empty. Of equal texts the row with
    the largest id stays (a null id only if no other has the text); of rows that repeat both id and text exactly one is
    kept. Other columns are ignored, whatever their names. An empty table gives no rows.
    """
    plain = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    head = fold_ascii(F.substring("t", 1, head_chars)).alias("head")
    folded = fold_ascii(F.col("t"))
    first = materialize(plain.select("id", F.length("t").alias("n"), head, F.sha2(folded.cast("binary"), 256).alias("sha")), "heads")
    sharing = first.groupBy("n", "head").agg(F.count("*").alias("c")).where("c > 1").select("n", "head")
    sharing = materialize(sharing, "sharing")
    is_long = F.col("n") > head_chars
    alone = first.join(sharing, ["n", "head"], "left_anti").select(
        "id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha"
    )
    short = first.where(~is_long).join(sharing, ["n", "head"], "left_semi").select("id", "n", F.col("head").alias("key"), "sha")
    blocks = F.regexp_extract_all("t", F.lit(f"(?s).{{1,{block_chars}}}"), F.lit(0))
    # Shuffled at every size, so that a small table shows what a large one takes; this is the only shuffle of whole texts.
    rest = (
        plain.select("id", "t", F.length("t").alias("n"), head)
        .where(is_long)
        .join(sharing.hint("merge"), ["n", "head"], "left_semi")
        .select("id", "n", folded.alias("t"))
        .select(F.monotonically_increasing_id().alias("row"), "id", "n", F.sha2(F.col("t").cast("binary"), 256).alias("sha"), blocks.alias("blocks"))
    )
    rest = materialize(rest, "rest")
    identity = block_identities(rest.select("row", "n", "blocks"))
    long = rest.select("row", "id", "sha").join(identity, "row").select("id", "n", F.col("name").cast("string").alias("key"), "sha")
    # n tells the two kinds of key apart.
    rows = materialize(short.unionByName(long), "identities")
    groups = materialize(rows.groupBy("n", "key").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size")), "groups")
    # Only rows that repeat an id within a group need an order among them.
    same = Window.partitionBy("n", "key", "id").orderBy("sha")
    stays = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("k") == 1)
    judged = rows.withColumn("k", F.row_number().over(same)).join(groups, ["n", "key"])
    out = alone.unionByName(judged.select("id", "keep_id", "group_size", stays.alias("kept"), "sha"))
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"))


def keep_one_of_equals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that :func:`exact_dedup` keeps: one of each group of equal texts.

    Null and empty texts are equal to each other, a null id stays only if no other row has the text, of rows that repeat
    id and text one stays. Columns may have any names; an empty table gives no rows.
    """
    kept = exact_dedup(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id", "text").where("kept")
    kept = materialize(kept.select(F.col("id").alias("kept_id"), F.col("text_sha256").alias("kept_sha")), "kept").hint("merge")
    sha = F.sha2(fold_ascii(F.col(text_col)).cast("binary"), 256)
    rows = docs.select(whole_row(docs), F.col(id_col).alias("id"), sha.alias("sha"))
    rows = rows.join(kept, F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("sha") == F.col("kept_sha")))
    same = Window.partitionBy("sha", "id").orderBy("kept_sha")
    return rows.withColumn("k", F.row_number().over(same)).where("k = 1").select("row.*")


SQL = f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d
"""
