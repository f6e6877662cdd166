"""The daily index as a stream: files landing in a folder become dissemination dates, exactly once per filing.

There is no watermark: a filing that turns up months late is a fact with a late knowledge date, not late data to be
dropped. Each micro-batch reduces to the earliest date per filing and is written as an own file set named by its batch,
so a batch that is run again replaces itself; readers take the minimum over all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vintara.functions import scalars as s
from vintara.sources.landing import INDEX_FORMAT, INDEX_LINE, index_lines

SEEN = "accn STRING, cik BIGINT, form STRING, filed_at DATE, disseminated_at DATE"


def index_stream(spark: SparkSession, landing: str, files_per_batch: int = 50) -> DataFrame:
    """Index lines with the day in their file's name (…YYYYMMDD….idx) as dissemination date."""
    lines = spark.readStream.schema(INDEX_LINE).options(**INDEX_FORMAT).option("maxFilesPerTrigger", files_per_batch).csv(landing)
    day = s.parse_compact_date(F.regexp_extract(F.col("_metadata.file_name"), r"(\d{8})", 1))
    return index_lines(lines, day).rows.select("accn", "cik", "form", "filed_at", "disseminated_at")


def run_available(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Process what has landed and stop."""

    def write(batch: DataFrame, number: int) -> None:
        earliest(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def earliest(rows: DataFrame) -> DataFrame:
    """One row per filing and company with the first day on which it was seen."""
    return rows.groupBy("accn", "cik").agg(F.min_by("form", "disseminated_at").alias("form"), F.min("filed_at").alias("filed_at"), F.min("disseminated_at").alias("disseminated_at"))


def seen(spark: SparkSession, out: str) -> DataFrame:
    """What all batches saw; input of :func:`vintara.operators.store.record_dissemination`."""
    return earliest(spark.read.schema(SEEN).parquet(out))
