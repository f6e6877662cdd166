"""SimHash near-duplicates with covering locality-sensitive hashing.

Each of the 64 bits gets a non-zero vector of radius + 1 bits, and each non-zero vector v of that length is a table:
its mask keeps the bits whose vector has an odd number of ones in common with v. The vectors of at most ``radius``
differing bits span less than the whole space, so some v is orthogonal to all of them: its mask keeps none of the
differing bits, and the pair has one key in that table. With radius 4 these are 31 tables, and no pair is missed.

Only distinct fingerprints enter the tables. Buckets are compared inside tasks in numpy blocks, and a bucket of g
fingerprints gives at most g - 1 links, a spanning forest of its true links; large buckets are first split by the masks
again, on the bits that they do not share yet. Components follow from the forests.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import LOWER, UPPER, materialize, partitions, quoted, whole_row
from .components import components

WORDS, SEED, RADIUS, BITS = 4, 42, 4, 64
_FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())
#: A bucket of more fingerprints is split before it is compared.
LARGE = 512


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """Bit k is 1 if it is set in over half the hashes of the text's word shingles; 0 for a text without words."""
    tokens = (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()
    if not tokens:
        return 0
    plain = b" ".join(tokens)
    if len(tokens) <= words:
        return xxh64_intdigest(plain, SEED)
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(tokens) - words + 1].tolist()
    ends = ends[words - 1 :].tolist()
    hashes = np.array([xxh64_intdigest(plain[a:b], SEED) for a, b in zip(starts, ends)], np.uint64)
    counts = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        part = hashes[k : k + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << k for k in np.flatnonzero(2 * counts > len(hashes)).tolist())


def masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """The tables' masks: any two numbers that differ in at most ``radius`` bits agree under one of them."""
    vectors = [k % ((1 << (radius + 1)) - 1) + 1 for k in range(bits)]
    return [sum(1 << k for k, w in enumerate(vectors) if (v & w).bit_count() % 2) for v in range(1, 1 << (radius + 1))]


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.array([fingerprint(x.as_py()) for x in batch.column("text")], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(prints, pa.int64())], ["id", "fp"])


def _near(values: np.ndarray, radius: int, links: list[tuple[int, int]], depth: int = 0) -> None:
    """Adds links between ``values`` (distinct) that connect all that are connected by true links.

    Compares block by block, but nothing with what is already in its own tree; large sets are dealt out by the masks
    restricted to bits in which the set differs, which keeps every pair within the radius together somewhere.
    """
    n = len(values)
    if n > LARGE and depth < 3:
        differing = int(np.bitwise_or.reduce(values ^ values[0]))
        places = [k for k in range(BITS) if differing >> k & 1]
        if len(places) > 2 * radius:
            vectors = [k % ((1 << (radius + 1)) - 1) + 1 for k in range(len(places))]
            for v in range(1, 1 << (radius + 1)):
                mask = np.uint64(sum(1 << p for p, w in zip(places, vectors) if (v & w).bit_count() % 2))
                keys = values & mask
                order = np.argsort(keys, kind="stable")
                cuts = np.flatnonzero(np.diff(keys[order])) + 1
                parts = np.split(values[order], cuts)
                if len(parts) == 1:
                    break
                for part in parts:
                    if len(part) > 1:
                        _near(part, radius, links, depth + 1)
            else:
                return
    root = np.arange(n)
    for k in range(n - 1):
        close = np.flatnonzero(np.bitwise_count(values[k + 1 :] ^ values[k]) <= radius) + k + 1
        other = close[root[close] != root[k]]
        while len(other):
            j = other[0]
            links.append((int(values[k]), int(values[j])))
            root[root == root[j]] = root[k]
            other = other[root[other] != root[k]]


def _bucket_links(radius: int):
    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One partition's rows (table, key, fp) are whole buckets; as numbers they take 24 bytes a row."""
        parts = [[batch.column(c).to_numpy(zero_copy_only=False) for c in ("table", "key", "fp")] for batch in batches]
        if not parts:
            return
        tables, keys, prints = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((prints, keys, tables))
        tables, keys, prints = tables[order], keys[order], prints[order].view(np.uint64)
        change = np.flatnonzero((np.diff(tables) != 0) | (np.diff(keys) != 0)) + 1
        starts, ends = np.concatenate(([0], change)), np.concatenate((change, [len(prints)]))
        several = np.flatnonzero(ends - starts > 1)
        pairs = several[ends[several] - starts[several] == 2]
        a, b = prints[starts[pairs]], prints[starts[pairs] + 1]
        close = np.bitwise_count(a ^ b) <= radius
        links: list[tuple[int, int]] = list(zip(a[close].tolist(), b[close].tolist()))
        for k in several[ends[several] - starts[several] > 2]:
            _near(prints[starts[k] : ends[k]], radius, links)
        found = np.unique(np.array(sorted(set(links)), np.uint64).reshape(-1, 2), axis=0).view(np.int64)
        for k in range(0, len(found), 65536):
            part = found[k : k + 65536]
            yield pa.RecordBatch.from_arrays([pa.array(part[:, 0]), pa.array(part[:, 1])], ["a", "b"])

    return linked


def near_links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Rows (a, b) of distinct fingerprints that connect all fingerprints within the radius; input: column ``fp``, distinct."""
    signed = [m - (1 << 64) if m >> 63 else m for m in masks(radius)]
    table = F.explode(F.array(*[F.struct(F.lit(k).alias("table"), F.lit(m).cast("long").alias("mask")) for k, m in enumerate(signed)])).alias("t")
    rows = prints.select("fp", table).select(F.col("t.table").alias("table"), F.col("fp").bitwiseAND(F.col("t.mask")).alias("key"), "fp")
    rows = rows.repartition(partitions(prints.sparkSession), "table", "key")
    return rows.mapInArrow(_bucket_links(radius), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row per row of ``docs``: the id, fingerprint (16 hex digits), component_id.

    Texts are lower-cased in A-Z; the shingles are runs of four words, the whole text where it has fewer. Fingerprints
    that differ in at most ``radius`` bits are linked, equal ones included; component_id is the smallest id that can be
    reached over links. Texts without words, null included, have fingerprint zero, which links like any other. Null ids
    take part without counting as smallest; a component of null ids only has a null component_id. Rows that repeat are
    returned each. Other columns are ignored; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    prints = materialize(rows.mapInArrow(_fingerprints, f"id {kind}, fp long"), "fingerprints")
    classes = _components(prints.groupBy("fp").agg(F.min("id").alias("least")), radius)
    least = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    named = classes.join(least, "component").select("fp", "component_id")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return prints.join(named, "fp").select(F.col("id").alias(id_col), hexed, "component_id")


def _components(classes: DataFrame, radius: int) -> DataFrame:
    """Rows (fp, least, component) for rows (fp, least) of distinct fingerprints."""
    classes = materialize(classes, "classes")
    links = near_links(classes.select("fp"), radius)
    found = components(links).withColumnRenamed("node", "fp")
    return materialize(classes.join(found, "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component")), "labelled")


def keep_representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row of ``docs``, all columns, of each group of near duplicates: that with the smallest id.

    A null id is smallest only if the group has no other. Rows are told apart by themselves, not by their ids: of rows in
    one group that share the smallest id that with the smallest digest of the text stays, and one of those that repeat
    both; rows of different groups never take each other's place, whatever ids they share. Null, empty and blank texts
    are near each other. Columns may have any names; an empty table gives no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.struct(F.col("id").isNull().alias("no_id"), "id", F.sha2(text.cast("binary"), 256).alias("sha"), F.col("text").isNull().alias("no_text"), "row")
    # The row's number is written with the row: what is read again has the same one.
    numbered = materialize(docs.select(whole_row(docs), F.monotonically_increasing_id().alias("number")), "numbered")
    inside = lambda c: F.col(f"row.{quoted(c)}")
    rows = numbered.select(inside(id_col).alias("id"), F.col("number").alias("row"), inside(text_col).alias("text"))
    rows = rows.select(key.alias("id"), "text")
    kind = rows.schema["id"].dataType.simpleString()
    prints = rows.mapInArrow(_fingerprints, f"id {kind}, fp long")
    classes = _components(prints.groupBy("fp").agg(F.min("id").alias("least")), radius)
    kept = classes.groupBy("component").agg(F.min("least").alias("least"))
    kept = materialize(kept.select(F.col("least.row").alias("number")), "representatives").hint("merge")
    return numbered.join(kept, "number", "left_semi").select("row.*")
