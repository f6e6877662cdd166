"""A gate: every query has to return the same rows, whatever the cluster looks like.

``python -m vintara.plans.determinism SF_DIR [QUERY ...]`` runs each query under several numbers of partitions, with and without
adaptive execution, and with tables cut into small pieces, and compares order-free fingerprints of the results. A control that
hangs on partitions has to be told apart, else the gate itself is broken.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Settings under which results are compared.
SETTINGS: tuple[dict[str, str], ...] = (
    {"spark.sql.shuffle.partitions": "4", "spark.sql.adaptive.enabled": "true", "spark.sql.files.maxPartitionBytes": "128m"},
    {"spark.sql.shuffle.partitions": "13", "spark.sql.adaptive.enabled": "false", "spark.sql.files.maxPartitionBytes": "64k"},
    {"spark.sql.shuffle.partitions": "1", "spark.sql.adaptive.enabled": "false", "spark.sql.files.maxPartitionBytes": "1m"},
    {"spark.sql.shuffle.partitions": "29", "spark.sql.adaptive.enabled": "true", "spark.sql.files.maxPartitionBytes": "64k", "spark.sql.autoBroadcastJoinThreshold": "-1"},
)

Query = Callable[[SparkSession, str], DataFrame]


@contextmanager
def configured(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def fingerprint(rows: DataFrame) -> tuple[int, int, str]:
    """Of the multiset of rows, whatever their order: their number, and xor and sum of 60 bits of each one's digest.

    Rows are told by their columns' names and values; doubles by nine significant digits, as sums of them hang on their order.
    """
    told = []
    for f in sorted(rows.schema, key=lambda f: f.name):
        c = F.col(f"`{f.name}`")
        c = F.format_string("%.9g", c + F.lit(0.0)) if isinstance(f.dataType, T.DoubleType) else c
        told.append(c.alias(f.name))
    h = F.conv(F.substring(F.md5(F.to_json(F.struct(*told)).cast("binary")), 1, 15), 16, 10).cast("bigint")
    n, xor, total = rows.select(h.alias("h")).agg(F.count("*"), F.coalesce(F.bit_xor("h"), F.lit(0)), F.coalesce(F.sum(F.col("h").cast("decimal(38,0)")), F.lit(0)).cast("string")).first()
    return n, xor, total


def poisoned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The control: each order's line that happens to come first, a mistake as it is really made."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").repartition("l_partkey")
    return lines.groupBy("l_orderkey").agg(F.first("l_linenumber").alias("line"))


def unstable(spark: SparkSession, sf_dir: str, queries: dict[str, Query], settings: tuple[dict[str, str], ...] = SETTINGS) -> dict[str, set[tuple[int, int, str]]]:
    """The queries whose results differ between settings, with the fingerprints found."""
    found: dict[str, set[tuple[int, int, str]]] = {name: set() for name in queries}
    for one in settings:
        with configured(spark, one):
            for name, query in queries.items():
                found[name].add(fingerprint(query(spark, sf_dir)))
    return {name: prints for name, prints in found.items() if len(prints) > 1}


def main(argv: list[str]) -> int:
    from vintara.plans import catalog

    sf_dir, *names = argv
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    bad = unstable(spark, sf_dir, {n: catalog.QUERIES[n] for n in names or catalog.QUERIES})
    caught = bool(unstable(spark, sf_dir, {"poisoned": poisoned}))
    for name, prints in bad.items():
        print(f"{name}: {len(prints)} results under {len(SETTINGS)} settings")
    print(f"{len(names or catalog.QUERIES) - len(bad)} stable, {len(bad)} not; the poisoned control was {'caught' if caught else 'NOT caught'}")
    return 1 if bad or not caught else 0


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
