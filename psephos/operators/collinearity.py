"""Variance inflation of predictors."""
from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from psephos.operators.shape import quoted


def _correlation(df: DataFrame, cols: Sequence[str], weight: str | None) -> np.ndarray:
    """Correlation matrix of the columns, k by k."""
    numbers = df.select(
        *[F.col(quoted(name)).cast("double").alias(f"x{i}") for i, name in enumerate(cols)],
        *([F.col(weight).cast("double").alias("w")] if weight else []),
    )
    names = [f"x{i}" for i in range(len(cols))]
    if weight is None:
        rows = VectorAssembler(inputCols=names, outputCol="x").transform(numbers).select("x")
        return Correlation.corr(rows, "x").first()[0].toArray()
    # Weighted rows stand for many equal ones; centre them first, then sum the products.
    sums = numbers.agg(
        F.sum("w").alias("w"), *[F.sum(F.col("w") * F.col(n)).alias(n) for n in names]
    ).first()
    if not sums["w"]:
        return np.full((len(cols), len(cols)), np.nan)
    means = np.asarray([sums[n] / sums["w"] for n in names])

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros((len(means), len(means)))
        for batch in batches:
            x = np.stack([np.asarray(batch.column(i)) for i in range(len(means))], 1) - means
            own += x.T @ (x * np.asarray(batch.column("w"))[:, None])
        i, j = np.triu_indices(len(means))
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(own[i, j])], ["i", "j", "p"])

    # One matrix per task, added up by cell.
    cells = numbers.mapInArrow(products, "i long, j long, p double").groupBy("i", "j").agg(F.sum("p").alias("p"))
    matrix = np.zeros((len(cols), len(cols)))
    for row in cells.collect():
        matrix[row.i, row.j] = matrix[row.j, row.i] = row.p
    spread = np.sqrt(np.diag(matrix))
    with np.errstate(invalid="ignore", divide="ignore"):
        return matrix / np.outer(spread, spread)


def independent(df: DataFrame, cols: Sequence[str], weight: str | None = None) -> list[str]:
    """The columns, in their order, that vary and do not depend linearly on an intercept and those before them."""
    if weight is None:
        df, weight = df.withColumn("_once", F.lit(1)), "_once"
    matrix = _correlation(df, cols, weight)
    kept: list[int] = []
    for i in np.flatnonzero(np.isfinite(np.diag(matrix))):
        before = matrix[kept, i]
        if 1 - before @ np.linalg.solve(matrix[np.ix_(kept, kept)], before) > 1e-9:
            kept.append(int(i))
    return [cols[i] for i in kept]


def vif(df: DataFrame, cols: Sequence[str], weight: str | None = None) -> DataFrame:
    """Variance inflation factor 1 / (1 - R²) per predictor, largest first.

    R² is that of the predictor on all others and an intercept; the factors are the
    diagonal of the inverted correlation matrix, the only thing that reaches the driver.
    """
    matrix = _correlation(df, cols, weight)
    if not np.isfinite(matrix).all():
        same = df.agg(*[(F.min(quoted(n)) == F.max(quoted(n))).alias(n) for n in cols]).first()
        constant = [name for name, is_same in zip(cols, same) if is_same is not False]
        raise ValueError(f"predictors do not vary: {', '.join(constant)}")
    if np.linalg.matrix_rank(matrix, tol=1e-9) < len(cols):
        raise ValueError(f"predictors are linearly dependent: {', '.join(cols)}")
    factors = np.diag(np.linalg.inv(matrix))
    rows = sorted(zip(cols, map(float, factors)), key=lambda row: (-row[1], row[0]))
    return df.sparkSession.createDataFrame(rows, "variable string, vif double")
