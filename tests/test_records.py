import pytest

from strandloom.sources.records import loaded_rows, parse_records, rejected_rows, typed_read

CASES = [
    ("ACGT", "ACGT", 1, None), ("acgtN\t3", "acgtN", 3, None), ('"AC"\t"7"', "AC", 7, None), ("A\t007", "A", 7, None), ("A\t2147483647", "A", 2147483647, None),
    ('"AC', None, None, "quoting"), ('"AC"x\t1', None, None, "quoting"), ('A"C\t1', None, None, "quoting"), ('A\t1"', None, None, "quoting"), ('"A""\t1', None, None, "quoting"),
    ("A\t1\t2", None, None, "columns"), ('"A\tC"\t1\t', None, None, "columns"), ("\t5", None, None, "read"), ('""\t5', None, None, "read"), ("AXC\t0", None, None, "read"),
    ('"A\tC"\t1', None, None, "read"), ('"A""C"\t1', None, None, "read"), ("A\rC", None, None, "read"), ('"A\nC"', None, None, "read"), ("AÇ\t1", None, None, "read"),
    ("A\t0", None, None, "count"), ("A\t", None, None, "count"), ("A\t-1", None, None, "count"), ("A\t1.5", None, None, "count"), ("A\t2147483648", None, None, "count"),
    ("A\t" + "9" * 5000, None, None, "count"), ("A\t٣", None, None, "count"), ("A\t 1", None, None, "count"), ("A\t1\r2", None, None, "count"),
]


@pytest.mark.parametrize("line,read,count,reason", CASES)
def test_each_line(line, read, count, reason):
    assert typed_read(line) == (read, count, reason)


def test_blank_null_long_and_repeated_rows(spark):
    long = "ACGT" * 100_000
    rows = [(1, "A\t2\r\n", "x"), (1, "A\t2\r\n", "y"), (2, None, "x"), (3, "\r\n", "x"), (4, "", None), (5, long, "x"), (6, '"', "x"), (6, '"', "z"), (None, "A\tB", "x")]
    df = spark.createDataFrame(rows, "line_no long, raw_line string, reason string")  # a clashing extra column
    assert sorted(map(tuple, loaded_rows(df).collect())) == [(1, "A", 2), (5, long, 1)]
    assert sorted(map(tuple, rejected_rows(df).collect()), key=str) == [(6, "quoting"), (None, "count")]


def test_empty_table(spark):
    df = spark.createDataFrame([], "line_no long, raw_line string")
    assert parse_records(df).collect() == [] and rejected_rows(df).columns == ["line_no", "reason"]
