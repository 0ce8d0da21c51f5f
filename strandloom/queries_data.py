"""Queries on record loading and uneven keys, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.operators.skew import distinct_sizes, ordered_positions, size_mismatches
from strandloom.sources.records import loaded_rows, rejected_rows


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rejected_rows(table(spark, sf_dir, "raw_lines"))


def p1_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loaded_rows(table(spark, sf_dir, "raw_lines"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return size_mismatches(table(spark, sf_dir, "core_list"), table(spark, sf_dir, "core_members")).select("core_id")


def p5_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct_sizes(table(spark, sf_dir, "core_members"), "core_id", "member")


def p5_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The member at every tenth of each core by size: a per-key quantile that needs positions over whole keys."""
    members = table(spark, sf_dir, "core_members").where("member is not null").select("core_id", "member").distinct()
    placed = ordered_positions(members, "core_id", "member")
    sizes = distinct_sizes(members, "core_id", "member")
    tenth = F.expr("(position * 10) div size")
    return (
        placed.join(sizes, "core_id").withColumn("tenth", tenth)
        .where("tenth > ((position - 1) * 10) div size")
        .select("core_id", F.col("tenth").cast("int"), "member")
    )


QUERIES = {"p1_found": p1_found, "p1_loaded": p1_loaded, "p5_found": p5_found, "p5_sizes": p5_sizes, "p5_positions": p5_positions}

_FIELD = r'(?:"(?:[^"]|"")*"|[^"\t]*)'
_PARSED = rf"""
WITH lines AS (SELECT line_no, regexp_replace(raw_line, '[\r\n]+$', '') AS line FROM raw_lines),
kept AS (SELECT * FROM lines WHERE line IS NOT NULL AND line <> ''),
cut AS (SELECT line_no, line,
  regexp_full_match(line, '^{_FIELD}(?:\t{_FIELD})*$') AS whole,
  len(string_split(regexp_replace(line, '"(?:[^"]|"")*"', '', 'g'), chr(9))) AS n,
  regexp_extract(line, '^({_FIELD})', 1) AS f1,
  regexp_extract(line, '^{_FIELD}\t({_FIELD})', 1) AS f2 FROM kept),
bare AS (SELECT *,
  CASE WHEN starts_with(f1, '"') THEN replace(substr(f1, 2, length(f1) - 2), '""', '"') ELSE f1 END AS r,
  CASE WHEN starts_with(f2, '"') THEN replace(substr(f2, 2, length(f2) - 2), '""', '"') ELSE f2 END AS c FROM cut),
parsed AS (SELECT line_no, r, c, n, CASE WHEN NOT whole THEN 'quoting' WHEN n > 2 THEN 'columns'
  WHEN NOT regexp_full_match(r, '[ACGTNacgtn]+') THEN 'read'
  WHEN n = 2 AND NOT (regexp_full_match(c, '[0-9]+') AND coalesce(TRY_CAST(c AS HUGEINT) BETWEEN 1 AND 2147483647, FALSE)) THEN 'count' END AS reason FROM bare)
"""
_SIZES = "SELECT core_id, count(DISTINCT member) AS size FROM core_members WHERE core_id IS NOT NULL AND member IS NOT NULL GROUP BY core_id"

SQL = {
    "p1_found": _PARSED + "SELECT DISTINCT line_no, reason FROM parsed WHERE reason IS NOT NULL",
    "p1_loaded": _PARSED + "SELECT DISTINCT line_no, r AS read, CASE WHEN n = 2 THEN CAST(c AS INT) ELSE 1 END AS cnt FROM parsed WHERE reason IS NULL",
    "p5_found": f"""WITH rec AS (SELECT core_id, sum(s) AS recorded FROM (SELECT core_id, run_id, max(sizes) AS s FROM core_list GROUP BY 1, 2) GROUP BY 1),
        tr AS ({_SIZES})
        SELECT rec.core_id FROM rec LEFT JOIN tr ON rec.core_id = tr.core_id WHERE rec.core_id IS NOT NULL AND coalesce(recorded, 0) <> coalesce(size, 0)""",
    "p5_sizes": _SIZES,
    "p5_positions": f"""WITH m AS (SELECT DISTINCT core_id, member FROM core_members WHERE core_id IS NOT NULL AND member IS NOT NULL),
        n AS (SELECT *, row_number() OVER (PARTITION BY core_id ORDER BY member) AS position, count(*) OVER (PARTITION BY core_id) AS size FROM m)
        SELECT core_id, CAST((position * 10) // size AS INT) AS tenth, member FROM n WHERE (position * 10) // size > ((position - 1) * 10) // size""",
}
