"""Scalar expressions against plain Python."""

import pathlib

from pyspark.sql import functions as F

from auditloom.functions import text as X

VALUES = ["", " a ", " x　", "/usr/bin/", "/", ".", "a/.", "//./", "/usr/bin/./", "x/.b", "..", "/" * 3000 + "x", "(null)", "a--B ", "é_ß",
          "__", "/root/.ssh", "A  \n b"]


def run(spark, column, values=VALUES):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[1] for r in sorted(df.select("i", column).collect())]


def test_strip_and_basename(spark):
    assert run(spark, X.stripped(F.col("v"))) == [v.strip() for v in VALUES]
    assert run(spark, X.basename(F.col("v"))) == [pathlib.PurePosixPath(v).name if v else "" for v in VALUES]


def test_safe_names(spark):
    assert run(spark, X.safe_name(F.col("v")), ["(null)", "null", "", "a--B ", "__", "Exec Cmd", "É1", "x__y"]) == [
        "null", "null", "missing", "a_b", "missing", "exec_cmd", "é1", "x_y"]
    assert run(spark, X.file_name(F.col("v")), [" a/b c ", "__", "r" * 200, "p.q-r"]) == ["a_b_c", "unknown", "r" * 120, "p.q-r"]


def test_hex(spark):
    values = ["6C73002D6C", "41", "20", "3000", "10", "abc", "zz", "", "C3A9", "6c73ff", "0102034142"]
    assert run(spark, X.printable_hex(F.col("v")), values) == [
        "ls -l", "A", "", "0", "10", "abc", "zz", "", "é", "ls�", "0102034142"]


def test_time_and_numbers(spark):
    values = ["1778300215.048585578", "9.5", " 7 ", "x", "", "-0.5"]
    assert run(spark, X.epoch_us(F.col("v")), values) == [1778300215048585, 9500000, 7000000, None, None, -500000]
    assert run(spark, X.seconds_text(X.epoch_us(F.col("v"))), values)[:2] == ["1778300215.048585", "9.500000"]
    assert run(spark, X.seconds_text(X.epoch_us(F.col("v"))), ["-0.5"]) == ["-0.500000"]
    assert run(spark, X.number_or(F.col("v")), ["3", "nan", "x", None]) == [3.0, 0.0, 0.0, 0.0]
    assert run(spark, X.one_line(F.col("v")), ["a \t\r\n b", "x" * 501]) == ["a b", "x" * 500 + "..."]
