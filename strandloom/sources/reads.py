"""Reads from text: one read a line, with an optional count after a tab.

Defined results: line breaks at the end are stripped; null and blank lines are skipped; the line is cut at its first tab;
the count is the integer the rest begins with (after white space), and 1 where there is none, it is below 1 or beyond 32
bits; ``"\\t5"`` is an empty read, which is kept; an empty table gives no rows; other columns are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.operators.skew import ordered_positions
from strandloom.session import partitions_for


def parse_lines(df: DataFrame, text_col: str = "value") -> DataFrame:
    """All other columns plus ``read`` and ``cnt`` (int)."""
    line = F.rtrim(F.col(text_col), F.lit("\r\n"))
    number = F.regexp_extract(F.col("__rest"), r"^[ \t\n\x0B\f\r]*([+-]?[0-9]+)", 1)
    count = number.try_cast("int")
    return (
        df.withColumn("__line", line).where("__line <> ''")
        .withColumn("__rest", F.when(F.instr("__line", "\t") > 0, F.expr("substring(__line, instr(__line, '\t') + 1)")).otherwise(F.lit("")))
        .withColumn("read", F.substring_index("__line", "\t", 1))
        .withColumn("cnt", F.when(count >= 1, count).otherwise(F.lit(1)))
        .drop("__line", "__rest", *([text_col] if text_col not in ("read", "cnt") else []))
    )


def number_lines(df: DataFrame, order: str) -> DataFrame:
    """All columns but ``order`` plus ``line_no``: the 1-based ordinal in that order, without a global window."""
    placed = ordered_positions(df.withColumn("__one", F.lit(0)), "__one", order)
    return placed.withColumn("line_no", F.col("position")).select(*[c for c in df.columns if c != order], "line_no")


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """(read, cnt, line_no) of text files; only lines that are not blank are counted.

    Raises ValueError for a missing path or one without reads.
    """
    try:
        lines = spark.read.option("lineSep", "\n").text(path)
    except Exception as error:
        raise ValueError(f"cannot open {path}") from error
    place = F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"))
    parsed = parse_lines(lines.select("value", place.alias("__place")))
    if parsed.isEmpty():
        raise ValueError(f"no reads in {path}")
    return number_lines(parsed, "__place").select("read", "cnt", "line_no")


def unique_reads(lines: DataFrame) -> DataFrame:
    """(read, len, cnt) of the distinct reads of (read, cnt, ...): counts are summed, partly before the shuffle."""
    return lines.groupBy("read").agg(F.sum(F.col("cnt").cast("long")).alias("cnt")).select("read", F.length("read").alias("len"), "cnt")


def index_reads(unique: DataFrame) -> DataFrame:
    """(idx, read, len), kept by idx. The 0-based index follows the binary order of the reads, so the smallest index of any
    set is its smallest read."""
    placed = ordered_positions(unique.select("read", "len").withColumn("__one", F.lit(0)), "__one", "read")
    indexed = placed.select((F.col("position") - 1).alias("idx"), "read", "len")
    return indexed.repartition(partitions_for(unique.sparkSession), "idx")  # a stated number: rows are few here, their grams are many
