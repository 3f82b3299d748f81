"""Binomial logit model: fit, coefficient tables, odds ratios."""
from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from psephos.functions.numeric import Z_95, half_even
from psephos.functions.text import significant_text
from psephos.operators.collinearity import vif
from psephos.operators.shape import quoted
from psephos.sources.scratch import stored

INTERCEPT = "const"
ITERATIONS = 100


@dataclass(frozen=True)
class LogitModel:
    """A fitted model; ``scale`` is what its row weights were divided by."""

    pipeline: PipelineModel
    scale: float


def fit_logit(
    train: DataFrame,
    features: Sequence[str],
    target: str,
    weight: str | None = None,
    merge_equal_rows: bool = True,
    score_col: str = "score",
) -> LogitModel:
    """Fit a logit model with intercept; ``weight`` counts a row that many times.

    Each iteration reads all rows.  With ``merge_equal_rows`` they are first merged into one
    row per combination of predictors, with the share of positives and the total weight.
    That changes nothing in the fit and leaves little to iterate over when the predictors are
    coded categories; turn it off for predictors that hardly repeat.

    Rows without a target, or without a positive weight, take no part either way.  A missing
    predictor, predictors that depend on each other, and a fit that does not converge are errors.
    """
    used = train.select(
        *[F.col(quoted(name)).cast("double").alias(name) for name in features],
        F.col(quoted(target)).cast("double").alias("_hit"),
        (F.col(quoted(weight)) if weight else F.lit(1)).cast("double").alias("_times"),
    )
    used = used.filter(F.col("_hit").isNotNull() & ~F.isnan("_hit") & (F.col("_times") > 0))
    if merge_equal_rows:
        used = used.groupBy(*map(quoted, features)).agg(
            (F.sum(F.col("_hit") * F.col("_times")) / F.sum("_times")).alias("_hit"),
            F.sum("_times").alias("_times"),
        )
    rows = stored(used)
    # The fit starts from values that depend on the weights and fails to converge from far
    # off when those are large, so the weights are brought down to at most 1.
    gaps = [F.count_if(F.col(quoted(name)).isNull()).alias(f"gap{i}") for i, name in enumerate(features)]
    scale, *missing = rows.agg(F.max("_times"), *gaps).first()
    if scale is None:
        raise ValueError(f"no row has a known {target}")
    if any(missing):
        raise ValueError(f"missing values in {', '.join(n for n, gap in zip(features, missing) if gap)}")
    if len(features) > 1:
        vif(rows, features, "_times")  # names predictors that do not vary or depend on others
    assembler = VectorAssembler(inputCols=list(features), outputCol="_features")
    regression = GeneralizedLinearRegression(
        family="binomial", link="logit", featuresCol="_features", labelCol="_hit",
        weightCol="_weight", predictionCol=score_col, tol=1e-10, maxIter=ITERATIONS,
    )
    weighted = rows.withColumn("_weight", F.col("_times") / F.lit(scale))
    model = regression.fit(assembler.transform(weighted))
    if model.hasSummary and model.summary.numIterations >= ITERATIONS:
        raise ValueError(f"the fit on {', '.join(features)} did not converge; are the classes separable?")
    return LogitModel(PipelineModel([assembler, model]), scale)


def logit_scores(model: LogitModel, df: DataFrame) -> DataFrame:
    """``df`` with the probability of the positive class in the model's score column."""
    return model.pipeline.transform(df).drop("_features")


def _exp(value: float) -> float:
    return math.exp(value) if value < 709 else math.inf


def logit_table(model: LogitModel) -> DataFrame:
    """Coefficients with standard errors, z, p, 95 % bounds and odds ratios, intercept first."""
    regression = model.pipeline.stages[-1]
    names = [*model.pipeline.stages[0].getInputCols(), INTERCEPT]
    values = [*regression.coefficients, regression.intercept]
    errors = [error / math.sqrt(model.scale) for error in regression.summary.coefficientStandardErrors]
    rows = []
    for name, value, error in zip(names, values, errors):
        z = value / error
        low, high = value - Z_95 * error, value + Z_95 * error
        # erfc keeps the tail that 1 - cdf would cancel to 0.
        p = math.erfc(abs(z) / math.sqrt(2))
        numbers = (value, error, z, p, low, high, *map(_exp, (value, low, high)))
        rows.append((name, *map(float, numbers)))
    rows.insert(0, rows.pop())
    return SparkSession.active().createDataFrame(
        rows,
        "variable string, coef double, std_err double, z double, p_value double, ci_low double, "
        "ci_high double, odds_ratio double, or_low double, or_high double",
    )


def significant_effects(table: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Effects with p below ``alpha``, without the intercept, rounded, smallest p first."""
    odds = F.col("odds_ratio")
    return (
        table.filter((F.col("variable") != INTERCEPT) & (F.col("p_value") < alpha))
        .orderBy("p_value", "variable")
        .select(
            "variable",
            half_even(F.col("coef"), 3).alias("coef"),
            "p_value",
            significant_text(F.col("p_value")).alias("p_text"),
            half_even(odds, 3).alias("odds_ratio"),
            F.concat(half_even(odds, 2).cast("string"), F.lit(" : 1")).alias("odds_text"),
            half_even(100 * (odds / (1 + odds)), 1).alias("probability_percent"),
        )
    )


def odds_intervals(table: DataFrame) -> DataFrame:
    """Odds ratio with its distance to the lower and upper 95 % bound, smallest ratio first."""
    return (
        table.filter(F.col("variable") != INTERCEPT)
        .select(
            "variable",
            "odds_ratio",
            (F.col("odds_ratio") - F.col("or_low")).alias("error_low"),
            (F.col("or_high") - F.col("odds_ratio")).alias("error_high"),
        )
        .orderBy("odds_ratio", "variable")
    )
