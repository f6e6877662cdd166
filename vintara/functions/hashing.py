"""Canonical JSON, content hashes and hash chains."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Mapping
from datetime import date, datetime
from decimal import Decimal
from pathlib import PurePath
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GENESIS = "0" * 64


def _plain(value: Any) -> Any:
    if value is None or isinstance(value, (bool, int, str)):
        return value
    if isinstance(value, float):
        raise TypeError("floats have no canonical form; use Decimal")
    if isinstance(value, Decimal):
        if not value.is_finite():
            raise ValueError("only finite decimals have a canonical form")
        return f"D:{format(value.normalize(), 'f')}"
    if isinstance(value, datetime):
        if value.tzinfo is None:
            raise ValueError("naive datetimes have no canonical form")
        return f"T:{value.isoformat()}"
    if isinstance(value, date):
        return f"d:{value.isoformat()}"
    if isinstance(value, PurePath):
        return f"p:{value.as_posix()}"
    if isinstance(value, Mapping):
        if not all(isinstance(k, str) for k in value):
            raise TypeError("keys are texts")
        return {k: _plain(v) for k, v in value.items()}
    if isinstance(value, (set, frozenset)):
        return sorted(canonical_json(v) for v in value)
    if isinstance(value, Iterable):
        return [_plain(v) for v in value]
    raise TypeError(f"{type(value).__name__} has no canonical form")


def canonical_json(value: Any) -> str:
    return json.dumps(_plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def canonical_hash(value: Any) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


def chain_next(head: str, entry: Any) -> str:
    return hashlib.sha256((head + canonical_json(entry)).encode()).hexdigest()


def first_break(entries: Iterable[Any], heads: Iterable[str]) -> int:
    """Index of the first entry whose recorded head does not follow, -1 if all do."""
    head = GENESIS
    for k, (entry, recorded) in enumerate(zip(entries, heads)):
        head = chain_next(head, entry)
        if head != recorded:
            return k
    return -1


def fact_key() -> Column:
    """sha256 of the JSON array of a fact's identity: the grain and the accession; the columns are taken by name."""
    texts = F.array(F.col("taxonomy"), F.col("concept"), F.col("unit"), F.col("period_start").cast("string"), F.col("period_end").cast("string"), F.col("accn"))
    return F.sha2(F.concat(F.lit("["), F.col("cik").cast("string"), F.lit(","), F.substring(F.to_json(texts), 2, 1 << 30)), 256)


def chain_breaks(log: DataFrame, key: str, seq: str, body: str = "body", head: str = "head") -> DataFrame:
    """By log (``key``): entries, and first_break, the place of the first entry whose recorded head does not follow, -1 if all do.

    An entry follows if its head hashes the recorded head before it and its body; so every entry is checked on its own,
    and logs of any length take one sort by ``seq``.
    """
    order = Window.partitionBy(key).orderBy(seq)
    expected = F.sha2(F.concat(F.coalesce(F.lag(head).over(order), F.lit(GENESIS)), F.col(body)), 256)
    rows = log.select(key, (F.row_number().over(order) - 1).alias("place"), (~F.col(head).eqNullSafe(expected)).alias("broken"))
    return rows.groupBy(key).agg(F.count("*").alias("entries"), F.coalesce(F.min(F.when(F.col("broken"), F.col("place"))), F.lit(-1)).alias("first_break"))


def chain_heads(bodies: Column) -> Column:
    """The chain's head after each body of an ordered array of texts: a fold, sequential within one log."""
    step = lambda heads, body: F.concat(heads, F.array(F.sha2(F.concat(F.element_at(heads, -1), body), 256)))
    return F.slice(F.aggregate(bodies, F.array(F.lit(GENESIS)), step), F.lit(2), F.size(bodies))
