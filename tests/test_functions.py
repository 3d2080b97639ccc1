import math

import pytest
from pyspark.sql import functions as F

from quarrylight.functions import numbers, times


def column(spark, values, dtype, fn):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {dtype}")
    return [r["y"] for r in rows.select("i", fn(F.col("x")).alias("y")).orderBy("i").collect()]


def test_parse_dot(spark):
    cases = {
        "2.5": 2.5, "2,5": 2.5, " 7 ": 7.0, "1_000": 1000.0, "1__0": 0.0, "1,000.5": 0.0, "1 000": 0.0, "12abc": 0.0,
        "abc": 0.0, "": 0.0, "1e3": 1000.0, ".5": 0.5, "5.": 5.0, "1d": 0.0, "0x10": 0.0, "-3": -3.0, "1e400": math.inf,
        "inf": math.inf, "-Infinity": -math.inf,
    }
    assert column(spark, list(cases), "string", numbers.parse_dot) == list(cases.values())
    assert all(math.isnan(v) for v in column(spark, ["nan", "-NaN", "+nan"], "string", numbers.parse_dot))


def test_parse_prefix(spark):
    cases = {
        "2.5": 2.5, "2,5": 25.0, "1,000.5": 1000.5, "1 000": 1000.0, "12abc": 12.0, "abc": 0.0, "": 0.0, "-3e2x": -300.0,
        "1e39": 0.0, "1e400": 0.0, "inf": math.inf, "-infinityx": -math.inf, ".5.5": 0.5, "+7": 7.0, "e5": 0.0,
    }
    assert column(spark, list(cases), "string", numbers.parse_prefix) == list(cases.values())
    assert math.isnan(column(spark, ["nanx"], "string", numbers.parse_prefix)[0])


def test_to_numeric(spark):
    cases = {"1.5": 1.5, " 2 ": 2.0, "n/a": None, "": None, "1d": None, "1_0": None, "nan": None, "-inf": -math.inf}
    assert column(spark, list(cases), "string", numbers.to_numeric) == list(cases.values())


def test_shortest_text(spark):
    cases = {
        1.0: "1.0", 0.1: "0.1", 1234567.0: "1234567.0", 1e7: "10000000.0", 12345678.9: "12345678.9", 1e15: "1000000000000000.0",
        1e16: "1e+16", 1.5e20: "1.5e+20", 1e-4: "0.0001", 1e-5: "1e-05", -2.5e-7: "-2.5e-07", 0.0: "0.0", 1e300: "1e+300",
        math.inf: "inf", -math.inf: "-inf", 0.00025: "0.00025",
    }
    assert column(spark, list(cases), "double", numbers.shortest_text) == list(cases.values())
    # Python's own text form of a float is the same.
    assert list(cases.values()) == [repr(v) for v in cases]


def test_ratios(spark):
    rows = spark.createDataFrame(
        [(995, 1000), (None, 1000), (5, None), (0, 0), (1000, 1000), (333, 1000)], "good long, total long"
    )
    good, total = F.col("good"), F.col("total")
    found = rows.select(
        numbers.error_percent(good, total).alias("raw"),
        numbers.error_percent_truncated(good, total).alias("cut"),
        numbers.guarded_ratio(good, total).alias("ratio"),
        numbers.percent_div(good, total).alias("div"),
    ).collect()
    assert [round(r["raw"], 6) for r in found] == [0.5, 0, 0, 0, 0, 66.7]
    assert [r["cut"] for r in found] == [1, 0, 0, 0, 0, 67]
    assert [r["ratio"] for r in found] == [0.995, None, 0, 0, 1, 0.333]
    assert [r["div"] for r in found] == [99, 0, 0, 0, 100, 33]


def test_leading_number(spark):
    found = column(spark, ["12.345ms", "1,234.5", "abc", "", "1.2.3"], "string", lambda c: numbers.leading_number(c, 2))
    assert found == [12.35, 1234.5, 0.0, 0.0, 1.2]


def test_probability(spark):
    found = column(spark, [[0.3], [2.0], [-1.0], [0.9, 0.1], [], [0.1, 0.2, 0.7]], "array<double>", numbers.probability_from_output)
    assert found[0] == 0.3 and found[3] == 0.1 and found[4] is None and found[5] == 0.2
    assert found[1] == pytest.approx(1 / (1 + math.exp(-2))) and found[2] == pytest.approx(1 / (1 + math.exp(1)))
    assert column(spark, [0.5, 0.50001], "double", numbers.exceeds) == [False, True]


def test_times(spark):
    row = spark.sql("SELECT TIMESTAMP_NTZ'2024-03-31 01:30:00.5' a, TIMESTAMP_NTZ'2024-03-31 03:30:00' b").select(
        times.seconds_between(F.col("a"), F.col("b")).alias("s"), times.epoch_micros(F.col("a")).alias("m")
    ).first()
    assert row["s"] == 7199.5 and row["m"] == 1711848600500000


@pytest.mark.parametrize(
    "value, decimals",
    [(2.675, 2), (0.125, 2), (0.25, 1), (0.0078125, 6), (0.045, 2), (1.005, 2), (-0.001, 2), (2.5, 0), (3.5, 0), (1e15, 2),
     (123456.785, 2), (0.5, 0), (99.995, 2), (1e-9, 6)],
)
def test_fixed_text_rounds_the_exact_binary_value(spark, value, decimals):
    row = spark.range(1).select(
        numbers.fixed_text(F.lit(value), decimals).alias("text"), numbers.rounded(F.lit(value), decimals).alias("number")
    ).first()
    assert row["text"] == f"{value:.{decimals}f}"
    assert row["number"] == round(value, decimals)


def test_hexadecimal_prefix(spark):
    row = spark.range(1).select(numbers.parse_prefix(F.lit("0x1A")).alias("a"), numbers.parse_prefix(F.lit("-0Xff z")).alias("b")).first()
    assert (row["a"], row["b"]) == (26.0, -255.0)
