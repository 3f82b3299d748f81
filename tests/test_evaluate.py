import math
import random

import pytest

from psephos.operators import evaluate as ev


def frame(spark, rows):
    return spark.createDataFrame(rows, "y int, s double, p int").repartition(3)


@pytest.fixture(scope="module")
def scored(spark):
    generator = random.Random(2)
    rows = []
    for _ in range(400):
        score = round(generator.random(), 2)
        rows.append((int(generator.random() < score), score, int(score >= 0.6)))
    return rows


def plain_roc(rows):
    points, thresholds = [(0, 0)], sorted({r[1] for r in rows}, reverse=True)
    for t in thresholds:
        points.append((sum(r[0] for r in rows if r[1] >= t), sum(1 - r[0] for r in rows if r[1] >= t)))
    return points


def without_straight_stretches(points):
    """Second differences as in the usual definition; the origin is added afterwards."""
    inner = points[1:]
    kept = []
    for i, (tp, fp) in enumerate(inner):
        if 0 < i < len(inner) - 1:
            (a, b), (d, e) = inner[i - 1], inner[i + 1]
            if d - 2 * tp + a == 0 and e - 2 * fp + b == 0:
                continue
        kept.append((tp, fp))
    return [(0, 0)] + kept


@pytest.mark.parametrize("rows_per_range", [13, 1_000_000])
def test_roc_and_auc_equal_plain_counts(spark, scored, rows_per_range):
    df = frame(spark, scored)
    found = ev.roc_points(df, "y", "s", rows_per_range=rows_per_range).collect()
    assert sorted((r.tp, r.fp) for r in found) == sorted(plain_roc(scored))
    thin = ev.roc_points(df, "y", "s", True, rows_per_range=rows_per_range).collect()
    assert sorted((r.tp, r.fp) for r in thin) == sorted(without_straight_stretches(plain_roc(scored)))
    pos = [r[1] for r in scored if r[0]]
    neg = [r[1] for r in scored if not r[0]]
    pairs = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg)
    row = ev.auc(df, "y", "s", rows_per_range=rows_per_range).first()
    assert row.auc == pytest.approx(pairs / len(pos) / len(neg), abs=1e-12)
    assert row.gini == pytest.approx(2 * row.auc - 1)


@pytest.mark.parametrize("rows_per_range", [1, 2, 1_000_000])
def test_straight_stretches_at_both_ends(spark, rows_per_range):
    rows = [(1, s, 0) for s in (0.9, 0.8, 0.7)] + [(0, 0.6, 0), (1, 0.5, 0)]
    rows += [(0, s, 0) for s in (0.4, 0.3, 0.2, 0.1)]
    found = ev.roc_points(frame(spark, rows), "y", "s", True, rows_per_range=rows_per_range).collect()
    expected = without_straight_stretches(plain_roc(rows))
    assert sorted((r.tp, r.fp) for r in found) == sorted(expected)
    assert expected == [(0, 0), (1, 0), (3, 0), (3, 1), (4, 1), (4, 5)]


def test_auc_extremes(spark):
    assert ev.auc(frame(spark, [(0, 0.5, 0), (1, 0.5, 0)]), "y", "s").first().auc == 0.5
    assert ev.auc(frame(spark, [(0, 0.1, 0), (1, 0.9, 0)]), "y", "s").first().auc == 1.0
    assert ev.auc(frame(spark, [(1, 0.1, 0), (1, 0.9, 0)]), "y", "s").first().auc is None
    single = ev.roc_points(frame(spark, [(1, 0.1, 0), (1, 0.9, 0)]), "y", "s").collect()
    assert [r.fpr for r in single] == [None] * 3


def test_cells_add_up(spark, scored):
    df = frame(spark, scored)
    cells = {(r.label, r.predicted): r["count"] for r in ev.confusion(df, "y", "p").collect()}
    assert sum(cells.values()) == len(scored)
    m = ev.binary_metrics(df, "y", "p").first()
    assert (m.tp, m.fp, m.tn, m.fn) == (cells[1, 1], cells[0, 1], cells[0, 0], cells[1, 0])
    assert m.balanced_accuracy == pytest.approx((m.sensitivity + m.specificity) / 2)
    at = ev.metrics_at_cutoff(df, "y", "s", 0.6).first()
    assert (at.tp, at.fp, at.tn, at.fn) == (m.tp, m.fp, m.tn, m.fn)


def test_undefined_metrics(spark):
    none_predicted = ev.binary_metrics(frame(spark, [(1, 0.1, 0), (0, 0.2, 0)]), "y", "p").first()
    assert (none_predicted.precision, none_predicted.f1) == (0.0, 0.0)
    no_negatives = ev.metrics_at_cutoff(frame(spark, [(1, 0.5, 0)]), "y", "s").first()
    assert no_negatives.specificity is None and no_negatives.tp == 1


def test_missing_scores_take_no_part(spark):
    rows = [(1, None, 0), (0, float("nan"), 0), (1, 0.7, 1), (0, 0.2, None), (None, 0.9, 1), (0, 0.1, 0)]
    m = ev.metrics_at_cutoff(frame(spark, rows), "y", "s").first()
    assert (m.tp, m.fp, m.tn, m.fn) == (1, 0, 2, 0)
    first = ev.cutoff_sweep(frame(spark, rows), "y", "s").orderBy("cutoff").first()
    assert (first.sensitivity, first.specificity) == (1.0, 0.0)
    found = ev.evaluate(frame(spark, rows), "y", "s", "p")
    summary = found["summary"].first()
    assert (summary.tp, summary.fp, summary.tn, summary.fn, summary.n_missing) == (1, 0, 1, 0, 4)
    assert summary.auc == 1.0 and sum(row["count"] for row in found["confusion"].collect()) == 2


def test_sweep_equals_each_cutoff(spark):
    edges = [i * 0.01 for i in range(101)]
    rows = [(i % 2, s, 0) for i, s in enumerate(edges + [math.nextafter(s, -1) for s in edges] + [-0.3, 1.7])]
    found = ev.cutoff_sweep(frame(spark, rows), "y", "s").orderBy("cutoff").collect()
    assert [r.cutoff for r in found] == edges
    for row, cutoff in zip(found, edges):
        hit = [r for r in rows if r[1] >= cutoff]
        pos = sum(r[0] for r in rows)
        assert row.sensitivity == pytest.approx(sum(r[0] for r in hit) / pos)
        assert row.specificity == pytest.approx(
            sum(1 - r[0] for r in rows if r[1] < cutoff) / (len(rows) - pos)
        )


def test_sweep_at_029(spark):
    found = ev.cutoff_sweep(frame(spark, [(1, 0.29, 1), (0, 0.1, 0)]), "y", "s").orderBy("cutoff").collect()
    assert (found[29].sensitivity, found[30].sensitivity) == (1.0, 0.0)
    assert len(found) == 101 and (found[0].sensitivity, found[0].specificity) == (1.0, 0.0)


def test_report(spark):
    rows = [(1, 0.0, 1)] * 3 + [(1, 0.0, 0)] + [(0, 0.0, 1)] * 2 + [(0, 0.0, 0)] * 4
    found = {row["class"]: row for row in ev.classification_report(frame(spark, rows), "y", "p").collect()}
    assert found["1"].precision == pytest.approx(0.6) and found["1"].recall == pytest.approx(0.75)
    assert found["0"].precision == pytest.approx(0.8) and found["0"].support == 6
    assert found["accuracy"].f1 == pytest.approx(0.7) and found["accuracy"].precision is None
    assert found["macro avg"].precision == pytest.approx(0.7)
    assert found["weighted avg"].recall == pytest.approx(0.7)


def test_evaluate_and_weights(spark, scored):
    df = frame(spark, scored)
    whole = ev.evaluate(df, "y", "s", "p")
    merged = df.groupBy("y", "s", "p").count().withColumnRenamed("count", "n")
    again = ev.evaluate(merged, "y", "s", "p", "n")
    for name in ("summary", "confusion", "report", "roc"):
        assert sorted(map(str, whole[name].collect())) == sorted(map(str, again[name].collect()))
    assert whole["summary"].first().auc == ev.auc(df, "y", "s").first().auc
    sweep = [sorted(map(str, ev.cutoff_sweep(f, "y", "s", weight=w).collect())) for f, w in ((df, None), (merged, "n"))]
    assert sweep[0] == sweep[1]
    one_class = ev.evaluate(frame(spark, [(1, 0.2, 0), (1, 0.7, 1)]), "y", "s", "p")["summary"].first()
    assert one_class.auc is None and one_class.gini is None and one_class.accuracy == 0.5


def test_normalise(spark):
    df = spark.createDataFrame([(-2.0,), (0.0,), (2.0,), (None,)], "d double")
    found = sorted((r.s for r in ev.normalise_score(df, "d", "s").collect()), key=lambda v: (v is None, v))
    assert found[:3] == pytest.approx([0, 0.5, 1]) and found[3] is None


def test_score_falls_back(spark):
    df = spark.createDataFrame([(0.5, -2.0, 1), (None, 2.0, 0), (float("nan"), 0.0, 1)], "p double, d double, y int")
    by = [["p", "d", "y"], ["none", "d", "y"], [None, None, "y"]]
    found = [[r.s for r in ev.event_score(df, "s", *names).collect()] for names in by]
    assert found[0] == [0.5, None, None] and found[2] == [1.0, 0.0, 1.0]
    assert found[1] == pytest.approx([0.0, 1.0, 0.5])
    with pytest.raises(ValueError, match="score by"):
        ev.event_score(df, "s", "q")
