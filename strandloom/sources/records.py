"""Loading of delimited records, with the rows that fail set apart with their reason.

Each input row holds one record. A record is split by Python's strict ``csv`` reader inside ``mapInArrow``; a structural
error becomes a reason before any typed constructor runs, so one broken record never stops the load.

Defined results
  null or blank record      neither loaded nor rejected
  broken quoting            rejected, ``quoting``
  not 1 or 2 fields         rejected, ``columns``
  read empty or not ACGTN   rejected, ``read`` (either case is accepted)
  count not 1..2147483647   rejected, ``count``; a missing second field counts as 1
  very long records         parsed whole, the reader's field limit is lifted
  empty tables              empty results with the same columns
  extra columns             carried by ``loaded_rows`` / ``rejected_rows`` only where asked for; otherwise ignored
"""

from __future__ import annotations

import csv
import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_COUNT = 2147483647
_READ = re.compile(r"[ACGTNacgtn]+")
_DIGITS = re.compile(r"[0-9]+")
# the csv reader treats line breaks inside a bare field as structure, here they are only bad characters
_BREAKS = {ord("\r"): "", ord("\n"): ""}


def split_record(record: str, delimiter: str = "\t") -> list[str]:
    """Fields of one record; ``csv.Error`` where its quoting is broken."""
    if "\r" in record or "\n" in record:
        record = record.translate(_BREAKS)
    fields = next(csv.reader([record], delimiter=delimiter, doublequote=True, strict=True), [])
    if '"' in record:  # the reader lets a quote pass inside a bare field
        at = 0
        for field in fields:
            if record.startswith('"', at):
                at += len(field) + field.count('"') + 3
            elif '"' in field:
                raise csv.Error("quote inside a bare field")
            else:
                at += len(field) + 1
    return fields


def typed_read(record: str) -> tuple[str | None, int | None, str | None]:
    """(read, count, reason); the reason is null for a good record."""
    try:
        fields = split_record(record)
    except csv.Error:
        return None, None, "quoting"
    if len(fields) not in (1, 2):
        return None, None, "columns"
    if not _READ.fullmatch(fields[0]):
        return None, None, "read"
    if len(fields) == 1:
        return fields[0], 1, None
    digits = fields[1].lstrip("0")
    if not _DIGITS.fullmatch(fields[1]) or not digits or len(digits) > 10 or int(digits) > MAX_COUNT:
        return None, None, "count"
    return fields[0], int(digits), None


def parse_records(df: DataFrame, id_col: str = "line_no", text_col: str = "raw_line") -> DataFrame:
    """One row (id, read, cnt, reason) for each record that is not blank; ``reason`` is null for loaded records.

    Only the two columns needed are read. Nothing is shuffled.
    """
    kind = df.schema[id_col].dataType.simpleString()
    source = df.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).where(F.col("__text").isNotNull())

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(sys.maxsize)
        for batch in batches:
            kept, reads, counts, reasons = [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                if text := text.rstrip("\r\n"):
                    read, count, reason = typed_read(text)
                    kept.append(i)
                    reads.append(read)
                    counts.append(count)
                    reasons.append(reason)
            ids = batch.column(0).take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(reads, pa.string()), pa.array(counts, pa.int32()), pa.array(reasons, pa.string())], [id_col, "read", "cnt", "reason"])

    return source.mapInArrow(parse, f"`{id_col}` {kind}, read string, cnt int, reason string")


def rejected_rows(df: DataFrame, id_col: str = "line_no", text_col: str = "raw_line") -> DataFrame:
    """Each failing record once: its id and reason. Only failing rows are shuffled for that."""
    return parse_records(df, id_col, text_col).where("reason is not null").select(id_col, "reason").distinct()


def loaded_rows(df: DataFrame, id_col: str = "line_no", text_col: str = "raw_line") -> DataFrame:
    """Each good record once: id, read and count; a record delivered again counts once."""
    return parse_records(df, id_col, text_col).where("reason is null").select(id_col, "read", "cnt").distinct()
