"""Evaluation of binary classifiers: confusion, metrics, ROC, AUC, cutoffs.

Labels and predictions are 0/1.  Every function takes ``weight``, a column with the number
of rows that a row stands for.  A row without label, or without the score or prediction that is
evaluated, takes no part; ``evaluate`` counts such rows.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from psephos.functions.numeric import known, ratio, total
from psephos.operators.running import running_totals
from psephos.operators.shape import quoted
from psephos.sources.scratch import stored


def _cells(df: DataFrame, label: str, positive: Column, weight: str | None) -> DataFrame:
    """One row tp, fp, tn, fn; ``positive`` is the predicted class as a condition."""
    actual = F.col(quoted(label))
    return df.agg(
        total(weight, (actual == 1) & positive).alias("tp"),
        total(weight, (actual == 0) & positive).alias("fp"),
        total(weight, (actual == 0) & ~positive).alias("tn"),
        total(weight, (actual == 1) & ~positive).alias("fn"),
    )


def _shares(empty_specificity: float | None = 0.0) -> dict[str, Column]:
    """Metrics from the columns tp, fp, tn, fn; an empty denominator gives 0."""
    tp, fp, tn, fn = (F.col(name) for name in ("tp", "fp", "tn", "fn"))
    return {
        "accuracy": ratio(tp + tn, tp + fp + tn + fn, None),
        "sensitivity": ratio(tp, tp + fn),
        "specificity": ratio(tn, tn + fp, empty_specificity),
        "precision": ratio(tp, tp + fp),
        "f1": ratio(2 * tp, 2 * tp + fp + fn),
    }


def confusion(df: DataFrame, label: str, pred: str, weight: str | None = None) -> DataFrame:
    """The four cells of the confusion matrix: label, predicted, count."""
    cells = _cells(df, label, F.col(quoted(pred)) == 1, weight)
    table = F.array(
        *[
            F.struct(
                F.lit(actual).alias("label"), F.lit(predicted).alias("predicted"),
                F.col(cell).alias("count"),
            )
            for actual, predicted, cell in ((0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn"), (1, 1, "tp"))
        ]
    )
    return cells.select(F.inline(table))


def binary_metrics(df: DataFrame, label: str, pred: str, weight: str | None = None) -> DataFrame:
    """One row: cells, accuracy, sensitivity, specificity, precision, F1, balanced accuracy."""
    cells = _cells(df, label, F.col(quoted(pred)) == 1, weight)
    return cells.withColumns(_shares()).withColumn(
        "balanced_accuracy", (F.col("sensitivity") + F.col("specificity")) / 2
    )


def classification_report(
    df: DataFrame, label: str, pred: str, weight: str | None = None
) -> DataFrame:
    """Precision, recall, F1 and support per class, accuracy, macro and weighted averages."""
    tp, fp, tn, fn = (F.col(name) for name in ("tp", "fp", "tn", "fn"))
    cells = _cells(df, label, F.col(quoted(pred)) == 1, weight).select(
        (tp + fn).alias("n1"), (tn + fp).alias("n0"), (tp + fp + tn + fn).alias("n"),
        ratio(tp, tp + fp).alias("p1"), ratio(tn, tn + fn).alias("p0"),
        ratio(tp, tp + fn).alias("r1"), ratio(tn, tn + fp).alias("r0"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), ratio(2 * tn, 2 * tn + fp + fn).alias("f0"),
        ratio(tp + tn, tp + fp + tn + fn, None).alias("accuracy"),
    )
    nothing = F.lit(None).cast("double")

    def line(name: str, precision: Column, recall: Column, f1: Column, support: str) -> Column:
        return F.struct(
            F.lit(name).alias("class"), precision.alias("precision"), recall.alias("recall"),
            f1.alias("f1"), F.col(support).alias("support"),
        )

    def macro(kind: str) -> Column:
        return (F.col(f"{kind}0") + F.col(f"{kind}1")) / 2

    def weighted(kind: str) -> Column:
        part = F.col(f"{kind}0") * F.col("n0") + F.col(f"{kind}1") * F.col("n1")
        return ratio(part, F.col("n"), None)

    lines = F.array(
        line("0", F.col("p0"), F.col("r0"), F.col("f0"), "n0"),
        line("1", F.col("p1"), F.col("r1"), F.col("f1"), "n1"),
        line("accuracy", nothing, nothing, F.col("accuracy"), "n"),
        line("macro avg", macro("p"), macro("r"), macro("f"), "n"),
        line("weighted avg", weighted("p"), weighted("r"), weighted("f"), "n"),
    )
    return cells.select(F.inline(lines))


def _by_score(df: DataFrame, label: str, score: str, weight: str | None) -> DataFrame:
    """Positives and negatives per distinct score."""
    actual = F.col(quoted(label))
    return (
        df.select(known(F.col(quoted(score))).alias("score"), actual.alias("_label"),
                  *([weight] if weight else []))
        .filter(F.col("score").isNotNull() & F.col("_label").isNotNull())
        .groupBy("score")
        .agg(
            total(weight, F.col("_label") == 1).alias("pos"),
            total(weight, F.col("_label") == 0).alias("neg"),
        )
    )


def _summed(grouped: DataFrame, rows_per_range: int | None) -> DataFrame:
    """The scores from the highest down, with what lies above and next to each."""
    return running_totals(
        grouped, "score", ["pos", "neg"], descending=True, following=True, rows_per_range=rows_per_range
    )


def _roc(summed: DataFrame, drop_collinear: bool) -> DataFrame:
    whole = summed.agg(F.sum("pos").alias("_pos"), F.sum("neg").alias("_neg"))
    if drop_collinear:
        # A point in the middle of a straight stretch has equal steps on both sides.
        bend = (F.col("next_pos") != F.col("pos")) | (F.col("next_neg") != F.col("neg"))
        first = (F.col("cum_pos") == F.col("pos")) & (F.col("cum_neg") == F.col("neg"))
        summed = summed.filter(F.col("next_pos").isNull() | first | bend)
    points = summed.select(
        F.col("score").alias("threshold"), F.col("cum_pos").alias("tp"), F.col("cum_neg").alias("fp")
    )
    origin = whole.select(
        F.lit(float("inf")).alias("threshold"), F.lit(0).cast("bigint").alias("tp"),
        F.lit(0).cast("bigint").alias("fp"),
    )
    all_pos, all_neg = (int(n or 0) for n in whole.first())
    return origin.unionByName(points).select(
        "threshold", "tp", "fp",
        ratio(F.col("fp"), F.lit(all_neg), None).alias("fpr"),
        ratio(F.col("tp"), F.lit(all_pos), None).alias("tpr"),
    )


def roc_points(
    df: DataFrame,
    label: str,
    score: str,
    drop_collinear: bool = False,
    weight: str | None = None,
    rows_per_range: int | None = None,
) -> DataFrame:
    """ROC points from the origin down to the lowest score: threshold, tp, fp, fpr, tpr.

    A rate is null if its class is absent.  ``drop_collinear`` leaves out the inner points
    of straight stretches; the first point after the origin always stays.
    """
    return _roc(_summed(_by_score(df, label, score, weight), rows_per_range), drop_collinear)


def _auc(summed: DataFrame) -> DataFrame:
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    # Every negative counts the positives above it, and half of those level with it.
    area = F.sum(neg * (F.col("cum_pos") - pos / 2))
    pairs = F.sum(pos) * F.sum(neg)
    return summed.agg(ratio(area, pairs, None).alias("auc")).withColumn(
        "gini", 2 * F.col("auc") - 1
    )


def auc(
    df: DataFrame,
    label: str,
    score: str,
    weight: str | None = None,
    rows_per_range: int | None = None,
) -> DataFrame:
    """One row: area under the ROC curve and Gini = 2 auc - 1; null if a class is absent."""
    return _auc(_summed(_by_score(df, label, score, weight), rows_per_range))


def metrics_at_cutoff(
    df: DataFrame, label: str, score: str, cutoff: float = 0.5, weight: str | None = None
) -> DataFrame:
    """One row of cells and metrics when scores from ``cutoff`` on count as positive.

    Specificity is null without negatives.
    """
    positive = known(F.col(quoted(score))) >= cutoff
    return _cells(df, label, positive, weight).withColumns(_shares(empty_specificity=None))


def cutoff_sweep(
    df: DataFrame, label: str, score: str, steps: int = 100, weight: str | None = None
) -> DataFrame:
    """Sensitivity and specificity at the cutoffs 0, 1/steps, ..., 1, from a single scan.

    Each row goes to the highest cutoff it reaches; suffix sums over those few groups give the
    rest.
    """
    step = 1.0 / steps
    given = known(F.col(quoted(score))).isNotNull()
    value = F.least(F.greatest(known(F.col(quoted(score))), F.lit(-1.0)), F.lit(2.0))
    guess = F.floor(value / step)
    reached = (
        F.when((guess + 1) * step <= value, guess + 1)
        .when(guess * step > value, guess - 1)
        .otherwise(guess)
    )
    index = F.greatest(F.least(reached, F.lit(steps)), F.lit(-1))
    actual = F.col(quoted(label))
    grouped = (
        df.select(index.cast("int").alias("_index"), actual.alias("_label"), given.alias("_known"),
                  *([weight] if weight else []))
        .filter(F.col("_known"))
        .groupBy("_index")
        .agg(
            total(weight, F.col("_label") == 1).alias("pos"),
            total(weight, F.col("_label") == 0).alias("neg"),
        )
    )
    every = df.sparkSession.range(-1, steps + 1, 1, 1).select(F.col("id").cast("int").alias("_index"))
    # One row per cutoff from here on.
    filled = every.join(F.broadcast(grouped), "_index", "left").fillna(0, ["pos", "neg"])
    up = Window.partitionBy(F.lit(0)).orderBy(F.desc("_index"))
    whole = Window.partitionBy(F.lit(0))
    summed = filled.select(
        "_index",
        F.sum("pos").over(up).alias("tp"), F.sum("neg").over(up).alias("fp"),
        F.sum("pos").over(whole).alias("all_pos"), F.sum("neg").over(whole).alias("all_neg"),
    )
    return summed.filter(F.col("_index") >= 0).select(
        (F.col("_index") * step).alias("cutoff"),
        ratio(F.col("tp"), F.col("all_pos")).alias("sensitivity"),
        ratio(F.col("all_neg") - F.col("fp"), F.col("all_neg")).alias("specificity"),
    )


def normalise_score(df: DataFrame, col: str, out: str) -> DataFrame:
    """Add the decision value scaled to 0..1 by its range, which keeps the order."""
    value = known(F.col(quoted(col)))
    span = df.agg(F.min(value).alias("low"), F.max(value).alias("high")).first()
    if span.low is None:
        return df.withColumn(out, F.lit(None).cast("double"))
    return df.withColumn(out, (value - F.lit(span.low)) / F.lit(span.high - span.low + 1e-12))


def event_score(
    df: DataFrame, out: str, probability: str | None = None, decision: str | None = None, prediction: str | None = None
) -> DataFrame:
    """Add the score of the event: its probability, else the decision value scaled to 0..1, else the prediction.

    The first of the three columns that is named and that ``df`` has counts, for all rows; a row
    where it is null has no score.
    """
    if probability in df.columns:
        return df.withColumn(out, known(F.col(quoted(probability))).cast("double"))
    if decision in df.columns:
        return normalise_score(df, decision, out)
    if prediction in df.columns:
        return df.withColumn(out, F.col(quoted(prediction)).cast("double"))
    raise ValueError(f"none of the columns {probability}, {decision}, {prediction} to score by")


def evaluate(
    df: DataFrame, label: str, score: str, pred: str, weight: str | None = None
) -> dict[str, DataFrame]:
    """Summary row, confusion matrix, class report and ROC points from one scan of ``df``.

    Rows are merged by label, prediction and score first.  AUC and Gini are null if they cannot
    be computed, as with a single class; ROC points on straight stretches are left out.  Rows without
    label, prediction or score are left out of all tables and counted in ``n_missing``.
    """
    every = stored(
        df.groupBy(
            F.col(quoted(label)).alias("label"), F.col(quoted(pred)).alias("predicted"),
            known(F.col(quoted(score))).alias("score"),
        ).agg(total(weight).alias("n"))
    )
    whole = F.col("label").isNotNull() & F.col("predicted").isNotNull() & F.col("score").isNotNull()
    missing = every.agg(F.coalesce(total("n", ~whole), F.lit(0))).first()[0]
    merged = every.filter(whole)
    summed = _summed(_by_score(merged, "label", "score", "n"), None)
    metrics = binary_metrics(merged, "label", "predicted", "n")
    area = _auc(summed).first()
    summary = metrics.withColumns(
        {
            "auc": F.lit(area.auc).cast("double"), "gini": F.lit(area.gini).cast("double"),
            "n_missing": F.lit(missing).cast("bigint"),
        }
    )
    return {
        "summary": summary,
        "confusion": confusion(merged, "label", "predicted", "n"),
        "report": classification_report(merged, "label", "predicted", "n"),
        "roc": _roc(summed, True),
    }
