import numpy as np
import pytest
from pyspark.sql import functions as F

from psephos.llm import rules
from psephos.llm.text import Texts, statistics
from tests.llm.cases import awkward_rows, ordered, prose, rule_counts


def test_counts_equal_plain_code(spark, awkward):
    labels = spark.createDataFrame([(1, 1), (None, 0), (8, None)], "id long, label int")
    found = rules.judge(awkward, labels)
    wanted = []
    for row in awkward_rows():
        n, *rest = rule_counts(row[1])
        failed = n < 10 or 100 * rest[-1] > 20 * n
        wanted.append((row[0], n, *rest, failed, not failed))  # without both labels the forest rejects nothing
    assert ordered(found.select("id", *rules.COUNTS, "base_failed", "kept").collect()) == ordered(wanted)


def test_forest_parts_labelled_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").selectExpr("doc_id AS id", "quality AS label")
    found = rules.judge(docs, labels).join(labels, "id").select("label", "kept").collect()
    kept = {label: np.mean([row["kept"] for row in found if row["label"] == label]) for label in (0, 1)}
    assert kept[1] >= 0.9 and kept[0] <= 0.1


def test_path_lengths_equal_a_walk():
    x = np.random.default_rng(2).normal(size=(300, 3))
    tree = rules.grow(x[:64], np.random.default_rng(5), 6)
    for row, path in zip(x, tree.paths(x), strict=True):
        node = 0
        while tree.rate[node] >= 0:
            node = tree.left[node] if row[tree.rate[node]] < tree.at[node] else tree.right[node]
        assert path == tree.path[node]


def test_outliers_have_short_paths():
    x = np.random.default_rng(0).normal(size=(2000, 4))
    x[0] = 12
    score = rules.fit_forest(x).score(x)
    assert score[0] == score.max() and score[0] > 0.7 > np.quantile(score, 0.99) and np.median(score) < 0.5


def test_usual_path_is_that_of_a_search_tree():
    assert rules.usual_path(np.array([1, 2]))[()].tolist() == [0.0, 1.0]
    harmonic = sum(1 / i for i in range(1, 256))
    assert float(rules.usual_path(256)) == pytest.approx(2 * harmonic - 2 * 255 / 256, rel=1e-3)


def test_lines_and_windows_cross_no_text():
    import pyarrow as pa

    found = statistics(Texts(pa.array(["a b c d e", "a b c d e", None, "x\nx\n\nx", "a b c d e f a b c d e"])))
    assert found["n_repeat_words"].tolist() == [0, 0, 0, 0, 10]
    assert found["n_dup_lines"].tolist() == [0, 0, 0, 2, 0]
    assert found["n_lines"].tolist() == [1, 1, 1, 4, 1]


def test_empty_table(spark, nothing):
    labels = spark.createDataFrame([], "id long, label int")
    assert rules.judge(nothing, labels).filter(F.col("kept")).count() == 0


def test_forest_sample_is_bounded_in_rows_whatever_the_ids(spark, monkeypatch):
    """Half of all rows have no id; about the same share of them as of the rest is learnt from."""
    sizes = []
    monkeypatch.setattr(rules, "TREES", 2)
    monkeypatch.setattr(rules, "LEAVES", 100)
    monkeypatch.setattr(rules, "base_failed", lambda: F.lit(False))
    monkeypatch.setattr(rules, "copies_sampled", lambda groups, keys, size, f=rules.copies_sampled: sizes.append(size) or f(groups, keys, size))
    fit = rules.fit_forest
    monkeypatch.setattr(rules, "fit_forest", lambda x, *rest: sizes.append(len(x)) or fit(x, *rest))
    docs = spark.createDataFrame([(None if i % 2 else i, prose(i, 30)) for i in range(2000)], "doc_id long, text string")
    judged = rules.judge(docs, spark.createDataFrame([], "id long, label int"))
    assert judged.count() == 2000
    assert sizes[0] == 200 and 140 < sizes[1] < 260
