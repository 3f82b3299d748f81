import math
import random

import numpy as np
import pytest

from psephos.operators import profile
from psephos.operators.quantiles import edges_of, quantile_bin, quantile_edges
from psephos.operators.running import running_totals


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_frequency_breaks_ties_by_value(one_column):
    df = one_column(["b", "a", "c", "c", None, None, "d"])
    found = [tuple(row) for row in profile.frequency(df, "value", top=4).collect()]
    assert found == [(None, 2), ("c", 2), ("a", 1), ("b", 1)]


def test_profile_matches_each_column_alone(spark):
    generator = random.Random(5)
    rows = [(generator.choice("abcdefg"), generator.randrange(30)) for _ in range(500)]
    df = spark.createDataFrame(rows, "s string, n int").repartition(6)
    found = profile.profile_frequencies(df, ["s", "n"], top=5).collect()
    for name in ("s", "n"):
        single = df.selectExpr(f"cast({name} as string) as {name}")
        expected = [tuple(row) for row in profile.frequency(single, name, top=5).collect()]
        mine = sorted((row for row in found if row.variable == name), key=lambda row: row["rank"])
        assert [(row.value, row["count"]) for row in mine] == expected
        assert [row["rank"] for row in mine] == [1, 2, 3, 4, 5]


def test_positives_by_period(spark):
    rows = [
        (2014, 1, 1, "y"), (2014, 1, 0, "y"), (2018, 0, 1, "n"), (2018, 0, 0, "y"), (None, 1, 1, "y"),
        (2022, 0, 1, "y"),
    ]
    df = spark.createDataFrame(rows, "year int, a int, b int, t string")
    found = rows_of(profile.positives_by_period(df, "year", ["a", "b"], "t", "y"))
    assert found == [("2014", 2, 1, 3), ("2022", 0, 1, 1), ("TOTAL", 2, 2, 4)]
    nothing = profile.positives_by_period(df.filter("t = 'n'"), "year", ["a"], "t", "y")
    assert rows_of(nothing) == [("TOTAL", 0, 0)]


def test_weights_count_like_repeated_rows(spark):
    merged = spark.createDataFrame(
        [(1, "a", 3), (0, "a", 2), (1, "b", 1), (0, None, 4)], "hit int, kind string, n bigint"
    )
    single = merged.selectExpr("hit", "kind", "explode(sequence(1, n)) AS i").drop("i")
    for function, arguments in (
        (profile.count_by, (["kind"],)),
        (profile.category_summary, (["kind", "hit"],)),
        (profile.event_rates, (["kind", "hit"], "hit", 2)),
    ):
        assert rows_of(function(merged, *arguments, weight="n")) == rows_of(function(single, *arguments))


def test_category_summary(spark):
    values = [None, "x", "x", "x", "x", "x", "x", "y"]
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "kind string, n int")
    found = [tuple(r) for r in profile.category_summary(df, ["gone", "kind", "n"]).collect()]
    assert found[:3] == [("kind", "x", 6, 75.0), ("kind", "y", 1, 12.5), ("kind", None, 1, 12.5)]
    assert [row[1] for row in found[3:]] == [str(i) for i in range(8)]


def test_numbers_ascend_as_numbers(one_column):
    found = profile.category_summary(one_column([10, 9, 100], "int"), ["value"]).collect()
    assert [row.category for row in found] == ["9", "10", "100"]


def test_missing_report(spark):
    rows = [(1, float("nan"), "a"), (None, 1.0, None), (3, None, "b"), (4, 2.0, "c")]
    report = profile.missing_report(spark.createDataFrame(rows, "i int, d double, s string"))
    assert [tuple(r) for r in report.collect()] == [
        ("i", 4, 1, 0.25, "25.0%"), ("d", 4, 2, 0.5, "50.0%"), ("s", 4, 1, 0.25, "25.0%")
    ]


def test_event_rate_interval_and_unknown_targets(spark):
    rows = [("a", "ELEITO")] * 3 + [("a", "NÃO ELEITO")] * 9 + [("a", None), (None, "ELEITO")]
    row = profile.event_rate_by(spark.createDataFrame(rows, "k string, t string"), "k", "t").collect()
    assert len(row) == 1 and (row[0].n, row[0].n_known, row[0].rate) == (13, 12, 0.25)
    half = 1.959963984540054 * math.sqrt(0.25 * 0.75 / 12)
    assert row[0].ci_low == pytest.approx(0.25 - half)


def test_quantile_bins_of_years(one_column, by_id):
    df = one_column([2014, 2018, 2022, None], "int")
    assert by_id(quantile_bin(df, "value", 2, "bin"), "bin") == [
        "[2014.0, 2018.0]", "[2014.0, 2018.0]", "(2018.0, 2022.0]", None
    ]
    assert by_id(quantile_bin(df, "value", 3, "bin"), "bin") == ["2014", "2018", "2022", None]


def test_no_bins_for_dummies_text_and_few_values(one_column):
    assert quantile_edges(one_column([0, 1, 0, 1], "int"), "value", 1) is None
    assert quantile_edges(one_column(["a", "b"]), "value", 1) is None
    assert quantile_edges(one_column([3, 4, 3, 4], "int"), "value", 2) is None
    assert quantile_edges(one_column([None, None], "int"), "value", 2) is None


def test_equal_edges_merge(one_column):
    values = [1.0] * 50 + [2.0, 3.0, 4.0, 5.0, 6.0, 7.0]
    assert quantile_edges(one_column(values, "double"), "value", 4) == [1.0, 7.0]


@pytest.mark.parametrize("between", [2, 50, 1_000_000])
def test_edges_equal_numpy(spark, between):
    generator = np.random.default_rng(3)
    values = np.concatenate([generator.normal(size=400).round(2), np.full(200, 0.25), [np.nan] * 5])
    df = spark.createDataFrame([(float(v),) for v in values], "v double").repartition(5)
    found = quantile_edges(df, "v", 7, between=between)
    expected = np.unique(np.quantile(values[~np.isnan(values)], np.linspace(0, 1, 8)))
    assert np.allclose(found, expected, atol=1e-12) and len(found) == len(expected)


def test_approximate_edges_are_near(spark):
    df = spark.range(10_000).selectExpr("cast(id as double) AS v")
    edges = quantile_edges(df, "v", 4, approximate=0.001)
    assert np.allclose(edges, [0, 2500, 5000, 7500, 9999], atol=20)


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("rows_per_range", [9, 50, 1_000_000])
def test_running_totals_equal_a_plain_loop(spark, descending, rows_per_range):
    generator = random.Random(11)
    rows = [
        (group, key / 7, generator.randrange(5))
        for group in ("a", "b") for key in generator.sample(range(-500, 500), 150 if group == "a" else 20)
    ]
    df = spark.createDataFrame(rows, "g string, k double, n bigint").repartition(4).cache()
    found = running_totals(
        df, "k", ["n"], descending, following=True, group="g", rows_per_range=rows_per_range
    ).collect()
    expected = []
    for group in ("a", "b"):
        mine = sorted((r for r in rows if r[0] == group), key=lambda r: r[1], reverse=descending)
        for i, row in enumerate(mine):
            after = mine[i + 1][2] if i + 1 < len(mine) else None
            expected.append((*row, sum(r[2] for r in mine[: i + 1]), after))
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, expected))


def test_calibration(spark):
    rows = [(i, 1 if i >= 5 else 0, i / 10) for i in range(10)]
    found = profile.calibration_by(
        spark.createDataFrame(rows, "v int, t int, p double"), "v", "t", "p", 2
    ).orderBy("lower").collect()
    assert [(r.n, r.observed) for r in found] == [(5, 0.0), (5, 1.0)]
    assert [r.predicted for r in found] == pytest.approx([0.2, 0.7])


def test_many_small_ranges(spark):
    df = spark.range(50_000).selectExpr("CAST((id * 7919) % 50000 AS double) AS k", "id % 5 AS n").cache()
    found = running_totals(df, "k", ["n"], following=True, rows_per_range=1_000).orderBy("k").collect()
    total, expected = 0, []
    values = [row.n for row in df.orderBy("k").collect()]
    for i, n in enumerate(values):
        total += n
        expected.append((total, values[i + 1] if i + 1 < len(values) else None))
    assert [(row.cum_n, row.next_n) for row in found] == expected


def test_nothing_but_sums_is_shuffled_for_edges(spark, monkeypatch):
    """Values go to the driver from between the brackets only, and no plan sorts or repartitions them."""
    from pyspark.sql.classic.dataframe import DataFrame

    plans, read = [], []
    plain = DataFrame.collect

    def collect(self):
        plans.append(self._jdf.queryExecution().executedPlan().toString())
        rows = plain(self)
        read.append(len(rows))
        return rows

    monkeypatch.setattr(DataFrame, "collect", collect)
    df = spark.range(200_000).selectExpr("cast(hash(id) as double) v")
    values = sorted(row.v for row in df.toLocalIterator())
    found = quantile_edges(df, "v", 4, between=1_000)
    assert found == pytest.approx(np.quantile(values, [0, 0.25, 0.5, 0.75, 1]).tolist())
    assert not any("rangepartitioning" in plan or "Sort [" in plan for plan in plans)
    assert max(read) < 8 * 1_500


def test_one_variable_is_bracketed_again_among_others(spark):
    """Only ``wide`` has too many values between two brackets; the rows of ``narrow`` stay in the table."""
    df = spark.range(4_000).selectExpr("cast(hash(id) as double) AS wide", "cast(id % 9 as double) AS narrow")
    rows = df.unpivot([], ["wide", "narrow"], "variable", "value").selectExpr("variable", "value", "1L AS n")
    values = df.toPandas()
    found = edges_of(rows, 2, between=5)
    assert found == {name: pytest.approx(np.quantile(values[name], [0, 0.5, 1]).tolist()) for name in ("wide", "narrow")}
