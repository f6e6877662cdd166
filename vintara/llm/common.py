"""What the operators of this subpackage share: word rules, written intermediates, partition counts."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid
from functools import lru_cache

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a maximal run of characters other than space, tab, newline, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_run = f"vintara-{uuid.uuid4().hex}"
_dirs: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """A folder of this run in ``spark.checkpoint.dir``, which driver and executors share, with its file system in the name.

    Where the setting is unset, a temporary folder of this machine stands in, if the master is local; executors of other
    machines would not see such a folder, so without a local master that is refused.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"spark.checkpoint.dir is not set; {master} needs a folder that driver and executors share")
        base = _own_base()
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/{_run}")
    path = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    if path not in _dirs:
        _dirs.add(path)
        atexit.register(_remove, spark, path)
    return path


@lru_cache(1)
def _own_base() -> str:
    return f"file://{tempfile.mkdtemp(prefix='vintara-')}"


def _remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, as far as the driver's JVM is still there."""
    with contextlib.suppress(Exception):
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage: whatever executors are lost later, these rows are read, not computed again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*written: DataFrame) -> None:
    """Delete what :func:`materialize` wrote for these frames, of which nothing is read any more."""
    for df in written:
        _remove(df.sparkSession, df.written_to)


def whole_row(docs: DataFrame) -> Column:
    """All columns as one struct, so that no name of theirs meets one that an operator uses; ``select("row.*")`` gives them back."""
    return F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("row")


def quoted(name: str) -> str:
    return f"`{name.replace('`', '``')}`"


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def fold_ascii(text: Column) -> Column:
    """Lower-case A-Z only; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a shared path, local or remote, and the path in it."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))


#: Totals that are summed up together on the way to running totals.
RUN = 1000


def totals_before(totals: DataFrame, at: str, n: str) -> DataFrame:
    """Rows (at, before) for rows (at, n), one for each integer ``at`` from 0 on: the sum of n over all smaller ones.

    In runs of ``RUN``: inside each run, and over the runs' sums, so a task sees a thousandth of the rows at most.
    """
    rows = totals.select(F.col(at), F.col(n), F.floor(F.col(at) / RUN).alias("_run"))
    sums = rows.groupBy("_run").agg(F.sum(n).alias("_n"))
    earlier = Window.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("_run").alias("_r"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_run").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_inside", F.coalesce(F.sum(n).over(inside), F.lit(0)))
    return rows.join(sums, F.col("_run") == F.col("_r")).select(at, (F.col("_before") + F.col("_inside")).alias("before"))


def numbered(rows: DataFrame, *order: Column, name: str = "numbered") -> DataFrame:
    """``rows`` with ``number``, 1, 2, ... along ``order``: sorted by ranges, numbered inside each range, ranges counted before.

    Rows that are equal in ``order`` may change places. A last key, the row's place in ``rows``, lets many of them fall into
    several ranges; so ``rows`` must be read from files, where places are the same if a task runs again.
    """
    place = F.monotonically_increasing_id()
    ranged = rows.withColumn("_place", place).repartitionByRange(*order, F.col("_place")).sortWithinPartitions(*order, "_place").drop("_place")
    placed = materialize(ranged.withColumn("_at", place), name)
    part = F.shiftright("_at", 33).cast("int")
    before = totals_before(placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows")), "_part", "_rows")
    inside = F.col("_at") - F.shiftleft(part.cast("long"), 33) + 1
    # One row for each range, of which there are as many as partitions.
    return placed.join(F.broadcast(before), part == F.col("_part")).withColumn("number", F.col("before") + inside).drop("_at", "_part", "before")
