"""Number expressions: rounding, safe ratios, intervals."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z_95 = 1.959963984540054  # 97.5 % point of the standard normal distribution


def half_even(column: Column, decimals: int) -> Column:
    """Round on the binary value with ties to the even neighbour."""
    scale = float(10**decimals)
    return F.rint(column * scale) / scale


def ratio(part: Column, whole: Column, empty: float | None = 0.0) -> Column:
    """``part / whole`` as double, and ``empty`` where ``whole`` is 0."""
    return F.when(whole == 0, F.lit(empty).cast("double")).otherwise(
        part.cast("double") / F.when(whole != 0, whole.cast("double"))
    )


def known(column: Column) -> Column:
    """The number, or null if it is NaN, which Spark would order above all numbers."""
    value = column.cast("double")
    return F.when(~F.isnan(value), value)


def total(weight: str | None, condition: Column | None = None) -> Column:
    """Number of rows for which ``condition`` holds, each counting ``weight`` times."""
    amount = F.lit(1).cast("bigint") if weight is None else F.col(weight)
    if condition is not None:
        amount = F.when(condition, amount)
    return F.coalesce(F.sum(amount), F.lit(0).cast("bigint"))
