"""Trees on merged rows: draws, cuts of deeper trees, and both ways to grow them."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from psephos.operators import forest
from psephos.operators.trees import Rows, Settings, drawn, gains, grown, reached, scrambled

WEIGHTS = (0.8, 1.4)


def keys(n: int, seed: int = 0) -> np.ndarray:
    return scrambled(np.arange(seed * n, (seed + 1) * n, dtype=np.uint64) + np.uint64(12345))


@pytest.mark.parametrize("mean", [0, 1, 3, 17, 63, 64, 200, 40_000])
def test_draws_are_poisson(mean):
    n = 40_000
    found = drawn(np.full(n, mean), keys(n))
    if mean == 0:
        assert not found.any()
        return
    assert found.mean() == pytest.approx(mean, abs=5 * math.sqrt(mean / n))
    assert found.var() == pytest.approx(mean, rel=0.05)
    # Whole distribution: the share of draws up to each of a few numbers.
    for k in (int(mean - math.sqrt(mean)), mean, int(mean + 2 * math.sqrt(mean))):
        below = math.fsum(math.exp(j * math.log(mean) - mean - math.lgamma(j + 1)) for j in range(k + 1))
        assert (found <= k).mean() == pytest.approx(below, abs=0.012)


def test_draws_depend_on_the_key_alone():
    counts, k = np.arange(500) % 90, keys(500)
    order = np.random.default_rng(1).permutation(500)
    assert (drawn(counts, k)[order] == drawn(counts[order], k[order])).all()


def merged_rows(seed: int = 3, n: int = 300) -> Rows:
    rng = np.random.default_rng(seed)
    codes = rng.integers(0, 3, (n, 6))
    codes = np.unique(codes, axis=0)
    chance = 0.15 + 0.3 * (codes[:, 0] > 0) + 0.2 * (codes[:, 1] == 2)
    counts = rng.integers(1, 60, len(codes))
    ones = rng.binomial(counts, chance)
    both = np.concatenate([codes, codes])
    label = np.repeat([1, 0], len(codes))
    times = np.concatenate([ones, counts - ones])
    return Rows.of(both[times > 0], label[times > 0], times[times > 0])


def test_merged_rows_are_bagged_like_single_rows():
    """Mean scores over many trees agree with a forest whose every row is drawn on its own."""
    rows = merged_rows()
    single = Rows.of(np.repeat(rows.codes, rows.counts, axis=0), np.repeat(rows.label, rows.counts), np.ones(rows.counts.sum(), np.int64))
    single.keys = keys(len(single.keys), 7)
    codes, trees = np.unique(rows.codes, axis=0), 300
    settings = Settings(depth=4, tried=2, min_leaf=3)
    shares = []
    for source in (rows, single):
        made = [grown(source, t, 1, settings, 3, WEIGHTS) for t in range(trees)]
        shares.append(np.stack([tree.share[reached(tree, codes)] for tree in made]))
    error = np.sqrt(shares[0].var(axis=0) / trees + shares[1].var(axis=0) / trees) + 1e-9
    z = (shares[0].mean(axis=0) - shares[1].mean(axis=0)) / error
    assert np.abs(z).max() < 5 and np.abs(z).mean() < 1.3
    assert shares[0].std(axis=0).mean() == pytest.approx(shares[1].std(axis=0).mean(), rel=0.1)


@pytest.mark.parametrize("depth, min_split", [(3, 2), (8, 40), (2, 200), (0, 2)])
def test_a_cut_tree_is_the_smaller_tree(depth, min_split):
    rows = merged_rows()
    for t in range(10):
        large = grown(rows, t, 5, Settings(depth=12, tried=2), 3, WEIGHTS)
        small = grown(rows, t, 5, Settings(depth=depth, tried=2, min_split=min_split), 3, WEIGHTS)
        cut = large.share[reached(large, rows.codes, depth, min_split)]
        assert np.array_equal(cut, small.share[reached(small, rows.codes)])
        assert small.depth.max() <= depth and (small.rows[small.left >= 0] >= min_split).all()


def test_limits_of_leaves_and_gain():
    rows = merged_rows()
    tree = grown(rows, 0, 5, Settings(depth=12, tried=6, min_leaf=25), 3, WEIGHTS)
    assert tree.rows[tree.left < 0].min() >= 25 and len(tree.rows) > 5
    share = grown(rows, 0, 5, Settings(depth=12, tried=6, min_share=0.05), 3, WEIGHTS)
    draws = rows.draw(0, 5)
    weight = draws * np.asarray(WEIGHTS)[rows.label]
    leaf = reached(share, rows.codes)
    assert np.bincount(leaf, weight)[np.unique(leaf)].min() >= 0.05 * weight.sum() - 1e-9
    assert len(grown(rows, 0, 5, Settings(depth=12, tried=6, min_gain=0.9), 3, WEIGHTS).rows) == 1
    full = grown(rows, 0, 5, Settings(depth=12, tried=6), 3, WEIGHTS)
    assert gains([full, tree], 6).sum() == pytest.approx(1) and gains([full], 6).argmax() == 0


def test_every_split_is_the_best_of_those_tried():
    rows = merged_rows(9, 200)
    tree = grown(rows, 2, 5, Settings(depth=1, tried=6), 3, WEIGHTS)
    draws, best = rows.draw(2, 5), (0.0, 0, 0)

    def impurity(mask):
        w = [WEIGHTS[c] * draws[mask & (rows.label == c)].sum() for c in (0, 1)]
        return 2 * w[0] * w[1] / sum(w) if sum(w) else 0.0

    everything = np.ones(len(draws), bool)
    for f in range(6):
        for cut in range(2):
            left = rows.codes[:, f] <= cut
            best = max(best, (impurity(everything) - impurity(left) - impurity(~left), f, cut))
    assert (tree.feature[0], tree.cut[0]) == best[1:] and tree.gain[0] == pytest.approx(best[0])


@pytest.fixture(scope="module")
def people(spark):
    df = spark.range(3000).selectExpr(
        "cast(id % 7 as int) a", "cast((id * id) % 5 as double) b", "cast(hash(id) % 100 as double) / 10 c", "cast(id % 2 as int) d",
        "case when id % 53 = 0 then null else cast(pmod(hash(id, 3), 10) < 3 + 2 * (id % 7 div 3) as int) end y",
    )
    return df.repartition(5)


def test_both_ways_grow_the_same_trees(people, monkeypatch):
    params = {"trees": 7, "depth": 6, "min_leaf": 2, "min_split": 9, "max_features": "2", "bins": 8}
    whole = forest.fit_forest(people, list("abcd"), "y", params)
    monkeypatch.setattr(forest, "TASK_ROWS", 50)
    parts = forest.fit_forest(people, list("abcd"), "y", params)
    for one, other in zip(whole.trees, parts.trees, strict=True):
        assert all(np.array_equal(x, y) for x, y in zip(vars(one).values(), vars(other).values()))
    assert sum(len(tree.rows) for tree in whole.trees) > 100


def test_both_ways_tune_alike(people, monkeypatch):
    grid = {"trees": [2, 5], "depth": [2, 5], "max_features": ["all", "1"], "min_split": [2, 60]}
    whole = forest.tune_forest(people, list("abcd"), "y", grid, folds=3)[1].collect()
    monkeypatch.setattr(forest, "TASK_ROWS", 50)
    parts = forest.tune_forest(people, list("abcd"), "y", grid, folds=3)[1].collect()
    assert whole == parts and len({row.mean_f1 for row in whole}) > 4


def test_weights_stand_for_rows(people):
    params = {"trees": 5, "depth": 5}
    counted = people.groupBy(*"abcdy").agg(F.count(F.lit(1)).alias("times"))
    single, merged = (forest.fit_forest(df, list("abcd"), "y", params, w) for df, w in ((people, None), (counted, "times")))
    assert single.cuts[:2] == merged.cuts[:2] and single.cuts[3] == merged.cuts[3]
    few = [forest.fit_forest(df, ["a", "b", "d"], "y", params, w) for df, w in ((people, None), (counted, "times"))]
    assert all(np.array_equal(x.share, y.share) for x, y in zip(few[0].trees, few[1].trees, strict=True))


def test_scores_are_means_over_trees(people):
    model = forest.fit_forest(people, list("abcd"), "y", {"trees": 6, "depth": 5})
    rows = forest.forest_scores(model, people).collect()
    codes = np.stack([np.searchsorted(cut, [row[name] for row in rows]) for name, cut in zip("abcd", model.cuts)], 1)
    expected = np.mean([tree.share[reached(tree, codes)] for tree in model.trees], axis=0)
    assert [row.score for row in rows] == pytest.approx(expected.tolist())
    assert [row.prediction for row in rows] == (expected > 0.5).astype(int).tolist()


def test_continuous_predictors_are_cut_at_quantiles(spark):
    df = spark.range(20_000).selectExpr("id / 7.0 x", "cast(id >= 10000 as int) y")
    model = forest.fit_forest(df, ["x"], "y", {"trees": 3, "depth": 3, "bins": 16, "max_features": "all"})
    assert len(model.cuts[0]) == 15 and model.cuts[0][7] == pytest.approx(10_000 / 7, rel=0.01)
    scored = forest.forest_scores(model, df).filter("prediction <> y").count()
    assert scored < 200


def test_one_class_and_no_rows(spark):
    rows = spark.createDataFrame([(1, 1), (2, 1)], "x int, y int")
    model = forest.fit_forest(rows, ["x"], "y", {"trees": 2})
    assert {row.score for row in forest.forest_scores(model, rows).collect()} == {1.0}
    nothing = forest.fit_forest(rows.filter("y = 0"), ["x"], "y", {"trees": 2})
    assert {row.score for row in forest.forest_scores(nothing, rows).collect()} == {0.5}


def test_distinct_rows_of_wide_tables():
    rng = np.random.default_rng(2)
    for width in (3, 40):
        codes = rng.integers(0, 9, (500, width)) * (rng.random((500, width)) < 0.1)
        distinct, which = forest._distinct(codes)
        assert np.array_equal(distinct[which], codes) and len(np.unique(distinct, axis=0)) == len(distinct)
