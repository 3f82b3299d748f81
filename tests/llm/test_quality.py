import numpy as np
import pytest

from psephos.llm import quality
from tests.llm.cases import prose, table


def test_pairs_are_ranked_as_a_gradient_search_ranks_them():
    draw = np.random.default_rng(4)
    differences = draw.normal(size=(2000, 3)) + np.array([1.0, -0.5, 0.0])
    w = np.zeros(3)
    for _ in range(20000):
        lost = 1 / (1 + np.exp(differences @ w))
        w += 0.5 * (differences.T @ lost / len(differences) - 1e-3 * w)
    assert quality.rank_pairs(differences) == pytest.approx(w, abs=1e-3)


def test_held_out_accuracy(spark):
    """Learnt from four fifths of the labelled documents, tested on the rest."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").selectExpr("doc_id AS id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").selectExpr("doc_id AS id", "quality AS label")
    model = quality.fit_ranking(*quality.training_rates(docs, labels.filter("id % 5 <> 0")))
    scores = {row["id"]: row["score"] for row in quality.quality_scores(docs, model).collect()}
    held = labels.filter("id % 5 = 0").collect()
    right = [(scores[row["id"]] >= quality.CUT) == (row["label"] == 1) for row in held]
    assert np.mean(right) >= 0.95 and all(0 <= s <= 1 for s in scores.values())


def test_awkward_rows_are_scored_and_kept_whole(spark, awkward):
    bad = [(100 + i, " ".join(f"{w}###" for w in prose(i, 50).split())) for i in range(20)]
    labels = spark.createDataFrame([(8, 1), (11, 1), (12, 0), (12, 1), (13, 1), (None, 1), (16, None), *((i, 0) for i, _ in bad)], "id long, label int")
    docs = spark.createDataFrame(bad, "id long, text string").union(awkward.selectExpr("doc_id AS id", "text"))
    model = quality.fit_ranking(*quality.training_rates(docs, labels))
    assert quality.quality_scores(docs, model).count() == docs.count()
    kept = quality.accepted(awkward, model)
    assert kept.columns == awkward.columns and kept.dtypes == awkward.dtypes
    rejected = quality.accepted(docs, model).filter("id >= 100").count()
    assert rejected == 0


def test_without_labels_every_score_is_half(spark, awkward, nothing):
    labels = spark.createDataFrame([(8, 1)], "id long, label int")
    docs = awkward.selectExpr("doc_id AS id", "text")
    model = quality.fit_ranking(*quality.training_rates(docs, labels))
    assert {row["score"] for row in quality.quality_scores(docs, model).collect()} == {0.5}
    assert quality.accepted(nothing, model).count() == 0


def test_sample_is_bounded_and_repeatable(spark):
    from pyspark.sql import functions as F

    rows = spark.range(50_000)
    ids = [row["id"] for row in quality.sampled(rows, F.col("id"), 5_000).collect()]
    assert 4_500 < len(ids) < 5_500
    assert sorted(ids) == sorted(row["id"] for row in quality.sampled(rows, F.col("id"), 5_000).collect())
    assert quality.sampled(rows, F.col("id"), 60_000).count() == 50_000


def test_all_pairs_of_the_sample_are_ranked(monkeypatch):
    draw = np.random.default_rng(5)
    good = np.arange(150) % 5 > 0
    x = draw.normal(size=(150, len(quality.RATES))) + 0.3 * good[:, None]
    monkeypatch.setattr(quality, "BLOCK", 1000)  # many blocks
    model = quality.fit_ranking(x, good)
    z = quality.expanded(x, model.center, model.scale)
    every = (z[good][:, None] - z[~good][None]).reshape(-1, z.shape[1])
    assert model.weights == pytest.approx(quality.rank_pairs(every), abs=1e-6)


def test_sample_is_bounded_in_rows_whatever_the_ids(spark, monkeypatch):
    """A third of all rows have one id and texts of their own, a third are exact copies of one row."""
    monkeypatch.setattr(quality, "SAMPLE", 300)
    docs = spark.createDataFrame(
        [(-1, f"hot {i} {prose(i, 5)}") for i in range(1000)] + [(-2, "copy of one row")] * 1000 + [(i, prose(i, 20)) for i in range(1000)],
        "id long, text string",
    ).repartition(4)
    labels = spark.createDataFrame([(-1, 0), (-2, 0), *((i, 1) for i in range(1000))], "id long, label int")
    x, good = quality.training_rates(docs, labels)
    assert len(x) == len(good) and 220 < len(x) < 380
    copies = (x == x[~good][:, None]).all(axis=2).sum(axis=1).max()
    assert 99 <= copies <= 101 and 60 < good.sum() < 140 and 60 < (~good).sum() - copies < 140


def _two_classes(count=400):
    """Texts that labels tell apart most of the time, with copies, empty texts and an id of many rows."""
    rows = [(i, "" if i % 41 == 0 else prose(i % 300, 10 + i % 37) + (" ### !!" * (1 + i % 4) if i % 5 == 0 else "")) for i in range(count)]
    rows += [(7, f"one id {prose(i, 8)}") for i in range(30)] + [(None, "no id")]
    return rows, [(i, int(i % 5 > 0) if i % 11 else int(i % 5 == 0)) for i in range(count)]


def test_all_rows_in_a_table_are_ranked_as_in_arrays(spark):
    rows, marks = _two_classes()
    docs = spark.createDataFrame(rows, "id long, text string").repartition(5)
    labels = spark.createDataFrame(marks, "id long, label int")
    one, all_ = quality.fit_ranking(*quality.training_rates(docs, labels)), quality.learn(docs, labels)
    assert all_.center == pytest.approx(one.center, abs=1e-12) and all_.scale == pytest.approx(one.scale, abs=1e-12)
    assert all_.weights == pytest.approx(one.weights, abs=1e-6)
    assert all_.threshold == pytest.approx(one.threshold, abs=1e-6)


def test_no_sample_stands_for_the_labels(spark, tmp_path, monkeypatch):
    from psephos.llm.queries import QUERIES

    rows, marks = _two_classes(600)
    spark.createDataFrame([(i, t, "en", "a") for i, t in rows], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, m, 0) for i, m in marks], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    whole = {(r["doc_id"], round(r["score"], 9)) for r in QUERIES["op7_quality_ranking"](spark, str(tmp_path)).collect()}
    monkeypatch.setattr(quality, "SAMPLE", 60)
    assert whole == {(r["doc_id"], round(r["score"], 9)) for r in QUERIES["op7_quality_ranking"](spark, str(tmp_path)).collect()}
