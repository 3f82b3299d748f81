"""Balanced class weights."""
from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasLabelCol, HasWeightCol
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from psephos.functions.numeric import total
from psephos.operators.shape import quoted


def class_weights(df: DataFrame, target: str, weight: str | None = None) -> dict:
    """Weight per class, rows / (classes * rows of the class), from one aggregation.

    One number per class comes to the driver.
    """
    counted = (
        df.filter(F.col(quoted(target)).isNotNull())
        .groupBy(F.col(quoted(target)).alias("label"))
        .agg(total(weight).alias("n"))
        .collect()
    )
    rows = sum(row.n for row in counted)
    return {row.label: rows / (len(counted) * row.n) for row in counted}


def _weight_of(target: str, weights: dict) -> Column:
    value, result = F.col(quoted(target)), None
    for label, amount in sorted(weights.items()):
        step = F.when if result is None else result.when
        result = step(value == label, F.lit(float(amount)))
    return F.lit(None).cast("double") if result is None else result


def balanced_weights(
    df: DataFrame, target: str, out: str, weight: str | None = None
) -> DataFrame:
    """Add the balanced weight of each row's class.

    The few weights become constants of the plan, so the rows need neither join nor shuffle.
    """
    return df.withColumn(out, _weight_of(target, class_weights(df, target, weight)))


class BalancedWeights(Estimator, HasLabelCol, HasWeightCol):
    """Balanced weights as a pipeline stage: each fold of a search gets its own."""

    @keyword_only
    def __init__(self, *, labelCol: str = "label", weightCol: str = "weight") -> None:
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> "BalancedWeightsModel":
        weights = class_weights(dataset, self.getLabelCol())
        return BalancedWeightsModel(self.getLabelCol(), self.getWeightCol(), weights)


class BalancedWeightsModel(Model, HasLabelCol, HasWeightCol):
    """Adds the weights found by :class:`BalancedWeights`."""

    weights = Param(Params._dummy(), "weights", "weight per label", TypeConverters.identity)

    def __init__(self, labelCol: str = "label", weightCol: str = "weight", weights=None) -> None:
        super().__init__()
        self._set(labelCol=labelCol, weightCol=weightCol, weights=weights or {})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumn(
            self.getWeightCol(), _weight_of(self.getLabelCol(), self.getOrDefault(self.weights))
        )
