import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from checks import queries
from psephos.operators import forest, logit
from psephos.operators.collinearity import vif
from psephos.operators.evaluate import binary_metrics
from psephos.operators.weights import balanced_weights, class_weights
from psephos.plans import config


@pytest.fixture(scope="module")
def sample():
    generator = np.random.default_rng(8)
    x = (generator.random((900, 3)) < [0.5, 0.3, 0.2]).astype(int)
    chance = 1 / (1 + np.exp(2.5 - 1.5 * x[:, 0] + x[:, 1]))
    return np.column_stack([x, generator.random(900) < chance]).astype(int)


@pytest.fixture(scope="module")
def train(spark, sample):
    rows = [tuple(map(int, row)) for row in sample]
    return spark.createDataFrame(rows, "a int, b int, c int, y int").repartition(5)


def newton(x, y, w):
    x = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        mu = 1 / (1 + np.exp(-x @ beta))
        information = x.T @ (x * (w * mu * (1 - mu))[:, None])
        beta = beta + np.linalg.solve(information, x.T @ (w * (y - mu)))
    return beta, np.sqrt(np.diag(np.linalg.inv(information)))


@pytest.mark.parametrize("merge", [True, False])
def test_logit_equals_newton_steps(train, sample, merge):
    weighted = balanced_weights(train, "y", "w")
    y = sample[:, 3]
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    beta, errors = newton(sample[:, :3], y, w)
    table = logit.logit_table(logit.fit_logit(weighted, ["a", "b", "c"], "y", "w", merge)).collect()
    assert [row.variable for row in table] == ["const", "a", "b", "c"]
    assert [row.coef for row in table] == pytest.approx(list(beta), abs=1e-8)
    assert [row.std_err for row in table] == pytest.approx(list(errors), abs=1e-8)
    for row in table:
        assert row.p_value == pytest.approx(math.erfc(abs(row.z) / math.sqrt(2)))
        assert row.odds_ratio == pytest.approx(math.exp(row.coef))
        assert row.or_low < row.odds_ratio < row.or_high


def test_logit_survives_heavy_weights(spark):
    cells = [(0, 0, 370_000_000.0), (0, 1, 1_630_000_000.0), (1, 0, 2_100_000.0), (1, 1, 17_800.0)]
    df = spark.createDataFrame(cells, "x int, y int, n double")
    for merge in (True, False):
        const, slope = logit.logit_table(logit.fit_logit(df, ["x"], "y", "n", merge)).collect()
        assert const.coef == pytest.approx(math.log(163 / 37), abs=1e-7)
        assert slope.coef == pytest.approx(math.log(17_800 / 2_100_000 * 37 / 163), abs=1e-6)
        assert slope.std_err == pytest.approx(math.sqrt(sum(1 / n for _, _, n in cells)), rel=1e-6)


def test_scores_and_odds(train):
    model = logit.fit_logit(train, ["a", "b", "c"], "y")
    table = logit.logit_table(model)
    beta = {row.variable: row.coef for row in table.collect()}
    for row in logit.logit_scores(model, train).limit(20).collect():
        eta = beta["const"] + sum(beta[name] * row[name] for name in "abc")
        assert row.score == pytest.approx(1 / (1 + math.exp(-eta)))
    effects = logit.significant_effects(table).collect()
    assert [row.variable for row in effects] == [
        row.variable for row in sorted(table.collect(), key=lambda r: r.p_value)
        if row.p_value < 0.05 and row.variable != "const"
    ]
    for row in effects:
        assert row.p_text == f"{row.p_value:.3g}" and row.odds_text.endswith(" : 1")
    ratios = [row.odds_ratio for row in logit.odds_intervals(table).collect()]
    assert ratios == sorted(ratios) and len(ratios) == 3


def test_dependent_predictors_are_an_error(spark, train):
    doubled = train.selectExpr("*", "a AS a2")
    with pytest.raises(ValueError, match="dependent"):
        logit.logit_table(logit.fit_logit(doubled, ["a", "a2"], "y"))
    with pytest.raises(ValueError, match="dependent"):
        vif(doubled, ["a", "b", "a2"])
    with pytest.raises(ValueError, match="do not vary: k"):
        vif(train.selectExpr("*", "1 AS k"), ["a", "k"])


def test_vif_equals_regressions(spark, train, sample):
    x = np.column_stack([sample[:, :3], sample[:, 0] + 2 * sample[:, 1] + sample[:, 3]]).astype(float)
    df = train.selectExpr("a", "b", "c", "a + 2 * b + y AS d")
    expected = {}
    for i, name in enumerate("abcd"):
        others = np.column_stack([np.ones(len(x)), np.delete(x, i, 1)])
        rest = x[:, i] - others @ np.linalg.lstsq(others, x[:, i], rcond=None)[0]
        expected[name] = ((x[:, i] - x[:, i].mean()) ** 2).sum() / (rest**2).sum()
    found = vif(df, list("abcd")).collect()
    assert [r.vif for r in found] == sorted((r.vif for r in found), reverse=True)
    assert {r.variable: r.vif for r in found} == pytest.approx(expected)
    merged = df.groupBy(*"abcd").count()
    assert {r.variable: r.vif for r in vif(merged, list("abcd"), "count").collect()} == pytest.approx(expected)
    orthogonal = spark.createDataFrame([(0, 0), (0, 1), (1, 0), (1, 1)], "p int, q int")
    assert [r.vif for r in vif(orthogonal, ["p", "q"]).collect()] == pytest.approx([1.0, 1.0])


def test_balanced_weights(spark):
    df = spark.createDataFrame([(1,)] * 3 + [(0,)] * 9, "y int")
    assert class_weights(df, "y") == pytest.approx({1: 2.0, 0: 12 / 18})
    sums = {r.y: r.s for r in balanced_weights(df, "y", "w").groupBy("y").agg({"w": "sum"}).toDF("y", "s").collect()}
    assert sums[0] == pytest.approx(sums[1])


def test_subset_sizes():
    assert [forest.subset_size(17, rule) for rule in ("sqrt", "log2", "all", "3", "99")] == [4, 4, 17, 3, 17]


def test_forest_separates_and_repeats(spark):
    rows = [(i % 2, i % 3, int(i % 2 == 1)) for i in range(120)]
    df = spark.createDataFrame(rows, "a int, b int, y int").repartition(4)
    params = {"trees": 5, "depth": 4, "max_features": "all", "min_leaf": 1}
    models = [forest.fit_forest(df, ["a", "b"], "y", params) for _ in range(2)]
    scored = [forest.forest_scores(model, df) for model in models]
    assert binary_metrics(scored[0], "y", "prediction").first().accuracy == 1.0
    assert sorted(map(str, scored[0].collect())) == sorted(map(str, scored[1].collect()))
    unlabelled = forest.forest_scores(models[0], df.select("a", "b"))
    assert unlabelled.columns == ["a", "b", "score", "prediction"]
    shares = forest.forest_importance(models[0]).collect()
    assert sum(r.importance for r in shares) == pytest.approx(1.0) and shares[0].feature == "a"
    with pytest.raises(ValueError, match="unknown forest parameters"):
        forest.fit_forest(df, ["a"], "y", {"min_splits": 2})
    gap = df.withColumn("a", F.when(F.col("a") == 0, F.col("a")))
    with pytest.raises(ValueError, match="missing values in a"):
        forest.fit_forest(gap, ["a", "b"], "y", params)
    scores = forest.forest_scores(models[0], gap).filter("a is null").select("score", "prediction").distinct().collect()
    assert [tuple(row) for row in scores] == [(None, None)]


def test_folds_share_out_every_class(spark):
    rows = [(i, 1 if i % 17 == 0 else 0 if i % 3 else None) for i in range(403)]
    df = spark.createDataFrame(rows, "id int, y int").repartition(7)
    folded = forest.stratified_folds(df, "y", 5).collect()
    assert sorted(r.id for r in folded) == list(range(403))
    for label in (0, 1, None):
        sizes = [sum(1 for r in folded if r.y == label and r.fold == f) for f in range(5)]
        assert max(sizes) - min(sizes) <= 1


def test_folds_of_many_classes(spark):
    df = spark.range(1500).selectExpr("id % 500 AS y", "id")
    folded = forest.stratified_folds(df, "y", 3).groupBy("y").agg({"fold": "collect_set"}).collect()
    assert len(folded) == 500 and all(sorted(row[1]) == [0, 1, 2] for row in folded)


def test_points_that_come_to_one_forest_are_fitted_once(spark, train, monkeypatch):
    fitted = []
    plain = forest._tune_in_tasks
    monkeypatch.setattr(forest, "_tune_in_tasks", lambda merged, specs, weights: fitted.extend(specs) or plain(merged, specs, weights))
    grid = {"trees": [2, 4], "depth": [2, 3], "max_features": ["sqrt", "log2", "1"], "min_leaf": [1], "min_split": [2, 30]}
    _, table = forest.tune_forest(train, ["a", "b", "c"], "y", grid, folds=2)
    rows = table.collect()
    assert len(rows) == 24 and len({(row.parameters.replace("sqrt", "1").replace("log2", "1"), row.mean_f1) for row in rows}) == 8
    assert len(fitted) == 2  # one run of trees per fold


def test_tuning_refits_the_best(spark, train):
    grid = {"trees": [3], "depth": [1, 4], "max_features": ["all"], "min_leaf": [1]}
    model, table = forest.tune_forest(train, ["a", "b", "c"], "y", grid, folds=3)
    rows = table.collect()
    assert len(rows) == 2 and [r.best for r in rows].count(True) == 1
    best = max(rows, key=lambda r: r.mean_f1)
    assert best.best and f"depth={model.settings.depth}" in best.parameters
    assert all(0 <= r.mean_f1 <= 1 for r in rows)


@pytest.mark.parametrize("merge", [True, False])
def test_null_targets_take_no_part(spark, merge):
    rows = [(float(i % 2), int((i * 7) % 10 < 3 + 4 * (i % 2)), 1.0) for i in range(200)]
    more = rows + [(1.0, None, 1.0)] * 100 + [(0.0, 1, None)] * 50 + [(0.0, 1, 0.0)] * 50
    schema = "x double, y int, w double"
    clean, gaps = (
        logit.fit_logit(spark.createDataFrame(r, schema), ["x"], "y", "w", merge_equal_rows=merge) for r in (rows, more)
    )
    left, right = (logit.logit_table(model).collect() for model in (clean, gaps))
    assert [row.coef for row in left] == pytest.approx([row.coef for row in right])
    with pytest.raises(ValueError, match="missing values in x"):
        logit.fit_logit(spark.createDataFrame([*rows, (None, 1, 1.0)], schema), ["x"], "y", "w", merge_equal_rows=merge)
    with pytest.raises(ValueError, match="known y"):
        logit.fit_logit(spark.createDataFrame([(1.0, None, 1.0)], schema), ["x"], "y", "w", merge_equal_rows=merge)


def test_registered_forests_are_the_shipped_ones(monkeypatch):
    asked = []
    monkeypatch.setattr(queries, "_features", lambda spark, folder: ("train", "test", ["a"]))
    monkeypatch.setattr(queries.profile, "count_by", lambda df, columns: None)
    monkeypatch.setattr(queries.forest, "forest_scores", lambda model, df: _Anything())
    monkeypatch.setattr(queries.forest, "forest_importance", lambda model: None)
    monkeypatch.setattr(queries.forest, "fit_forest", lambda train, features, target, params: asked.append(params))
    monkeypatch.setattr(queries.forest, "tune_forest", lambda *args, folds: asked.append((args[3], folds)) or (None, None))
    monkeypatch.setattr(queries, "half_even", lambda column, decimals: column)
    monkeypatch.setattr(queries.F, "col", lambda name: _Anything())
    for name in ("forest_scores", "forest_importance", "forest_tuning"):
        queries.QUERIES[name](None, "")
    assert asked == [config.FOREST, config.FOREST, (config.GRIDS[config.FEDERAL], config.FOLDS)]


class _Anything:
    def alias(self, name):
        return self

    def select(self, *columns):
        return self


@pytest.mark.parametrize("cells, listed", [((40, 10, 10, 40), 1), ((26, 24, 24, 26), 0)])
def test_registered_effects_are_significant(spark, monkeypatch, cells, listed):
    """At 0.05 an effect is listed if and only if |z| > 1.96."""
    a, b, c, d = cells
    z = math.log(a * d / (b * c)) / math.sqrt(sum(1 / n for n in cells))
    rows = [(1, 1)] * a + [(1, 0)] * b + [(0, 1)] * c + [(0, 0)] * d
    model = logit.fit_logit(spark.createDataFrame(rows, "long int, quality int"), ["long"], "quality")
    monkeypatch.setattr(queries, "_doc_model", lambda spark, folder: (None, model))
    assert (abs(z) > 1.96) == listed
    assert queries.QUERIES["significant_effects"](spark, "").count() == listed


def test_independent_columns_come_first_in_order(spark):
    from psephos.operators.collinearity import independent

    rows = [(float(i % 2), float(i % 3), 1.0, 1.0 - i % 2, float(i % 2 + i % 3), float(i % 5), 1 + i % 4) for i in range(60)]
    df = spark.createDataFrame(rows, "a double, b double, one double, not_a double, sum double, e double, w int")
    names = ["a", "b", "one", "not_a", "sum", "e"]
    assert independent(df, names, "w") == independent(df, names) == ["a", "b", "e"]
    assert independent(df, ["one"], "w") == independent(df, ["one"]) == []
