"""Numbers as text, rounded as Python rounds them."""
import random

import pytest
from pyspark.sql import functions as F

from psephos.functions.text import fixed_text, percent_text


def shown(spark, values, decimals):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, v double")
    rows = df.select("id", fixed_text(F.col("v"), decimals).alias("t"), percent_text(F.col("v"), decimals).alias("p")).collect()
    return [(row.t, row.p) for row in sorted(rows)]


@pytest.mark.parametrize("decimals", [0, 1, 2, 3, 8])
def test_every_number_is_rounded_on_its_binary_value(spark, decimals):
    lots = random.Random(4)
    values = [k / 2000 for k in range(2001)] + [k / 8 for k in range(-40, 41)] + [lots.uniform(-9, 9) for _ in range(3000)]
    values += [round(lots.uniform(0, 3), 2 + i % 6) for i in range(3000)] + [0.05, 2.5, 1e-300, 5e-324, 123456.785, 0.0, 1e9 + 0.5]
    found = shown(spark, values, decimals)
    for value, (text, percent) in zip(values, found, strict=True):
        if value >= 0 or float(f"{value:.{decimals}f}") != 0:
            assert text == f"{value:.{decimals}f}", value
            assert percent == f"{value:.{decimals}%}", value


def test_ties_named_in_reports(spark):
    assert [p for _, p in shown(spark, [0.0005, 0.0015, 0.1235, 0.125, 0.0625], 1)] == ["0.1%", "0.1%", "12.3%", "12.5%", "6.2%"]


def test_null_and_nan(spark):
    df = spark.createDataFrame([(None,), (float("nan"),)], "v double")
    assert [row.t for row in df.select(percent_text(F.col("v"), 1).alias("t")).collect()][0] is None
