"""Reads that keep arriving: counts by distinct read as a Structured Streaming job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strandloom.sources.reads import parse_lines


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """(read, cnt) of text files as they appear in a folder."""
    return parse_lines(spark.readStream.option("lineSep", "\n").text(path))


def count_stream(stream: DataFrame, checkpoint: str, folder: str) -> StreamingQuery:
    """Writes the counts that each batch adds, by distinct read, to a part of ``folder`` of its own. A batch that is run again
    after a failure replaces its part, so no line counts twice. The engine keeps no state between batches."""

    def write(batch: DataFrame, number: int) -> None:
        batch.groupBy("read").agg(F.sum(F.col("cnt").cast("long")).alias("cnt")).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()


def counts_so_far(spark: SparkSession, folder: str) -> DataFrame:
    """(read, len, cnt) over all parts written."""
    parts = spark.read.schema("read string, cnt long, batch long").parquet(folder)
    return parts.groupBy("read").agg(F.sum("cnt").alias("cnt")).select("read", F.length("read").alias("len"), "cnt")


def compact(spark: SparkSession, folder: str, into: str) -> None:
    """All parts summed into one new folder, as the only part of it."""
    counts_so_far(spark, folder).select("read", "cnt").write.mode("overwrite").parquet(f"{into}/batch=-1")
