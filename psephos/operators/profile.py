"""Frequency tables, summaries per category, event rates, missing values."""
from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from psephos.functions.numeric import Z_95, half_even, known, ratio, total
from psephos.functions.text import percent_text
from psephos.operators.encode import decode_labels
from psephos.operators.quantiles import (
    add_bins,
    bin_of,
    edges_of,
    is_number,
    quantile_edges,
)
from psephos.operators.shape import quoted
from psephos.sources.scratch import stored


def count_by(
    df: DataFrame, keys: Sequence[str], weight: str | None = None, sort: bool = False
) -> DataFrame:
    """Rows per combination of keys, in key order if ``sort``."""
    counted = df.groupBy(*[F.col(quoted(k)) for k in keys]).agg(total(weight).alias("count"))
    return counted.orderBy(*keys) if sort else counted


def frequency(
    df: DataFrame, col: str, top: int | None = None, weight: str | None = None
) -> DataFrame:
    """Rows per value, most frequent first, equal counts by value; only the ``top`` first ones."""
    counted = count_by(df, [col], weight).orderBy(F.desc("count"), F.asc(quoted(col)))
    return counted if top is None else counted.limit(top)


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    """The different values of a column."""
    return df.select(quoted(col)).distinct()


def _stacked(df: DataFrame, cols: Sequence[str], others: Sequence[str] = ()) -> DataFrame:
    """One row (variable, value as text) per row and column, in a single scan."""
    texts = [F.col(quoted(name)).cast("string").alias(name) for name in cols]
    wide = df.select(*others, *texts)
    return wide.unpivot(
        list(others), [F.col(quoted(name)) for name in cols], "variable", "value"
    )


def profile_frequencies(df: DataFrame, cols: Sequence[str], top: int | None = 20) -> DataFrame:
    """The most frequent values of each column: variable, value, count, rank.

    All columns are counted in one pass.  The rank limit is applied in every partition of the
    counts before a variable's rows meet, so a column of distinct names stays cheap.
    """
    counted = _stacked(df, cols).groupBy("variable", "value").agg(total(None).alias("count"))
    best = Window.partitionBy("variable").orderBy(F.desc("count"), F.asc("value"))
    if top is None:
        return counted
    return counted.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)


def count_flags(df: DataFrame, flags: Sequence[str], weight: str | None = None) -> DataFrame:
    """One row with the number of rows per flag that is 1."""
    return df.agg(*[total(weight, F.col(quoted(f)) == 1).alias(f) for f in flags])


def positives_by_period(
    df: DataFrame,
    period: str,
    flags: Sequence[str],
    target: str,
    positive: object = 1,
    total_label: str = "TOTAL",
    weight: str | None = None,
) -> DataFrame:
    """Positive rows per flag and period, their sum, and a row of grand totals.

    A row with several flags counts under each and so several times in ``total``.  A period
    without flagged positives has no row; rows without a period do not count.
    """
    flagged = reduce(lambda a, b: a | b, [F.col(quoted(f)) == 1 for f in flags])
    chosen = df.filter((F.col(quoted(target)) == F.lit(positive)) & flagged)
    per_period = (
        chosen.filter(F.col(quoted(period)).isNotNull())
        .groupBy(F.col(quoted(period)).cast("string").alias(period))
        .agg(*[total(weight, F.col(quoted(f)) == 1).alias(f) for f in flags])
    )
    sums = [F.coalesce(F.sum(quoted(f)), F.lit(0).cast("bigint")).alias(f) for f in flags]
    grand = per_period.agg(*sums).select(F.lit(total_label).alias(period), *map(quoted, flags))
    every = reduce(lambda a, b: a + b, [F.col(quoted(f)) for f in flags])
    return per_period.unionByName(grand).withColumn("total", every)


def category_summary(
    df: DataFrame,
    variables: Sequence[str],
    labels: Mapping[str, Mapping[object, str]] | None = None,
    weight: str | None = None,
) -> DataFrame:
    """Count and percent per value of each variable, null included: one long table.

    Variables come in the given order, absent ones are skipped, and values ascend.
    """
    present = [name for name in variables if name in df.columns]
    counted = (
        _stacked(df, present, [weight] if weight else [])
        .groupBy("variable", "value")
        .agg(total(weight).alias("count"))
    )
    # One total per variable: as many rows as variables were named.
    totals = counted.groupBy("variable").agg(F.sum("count").alias("_all"))
    place = F.array_position(F.array(*map(F.lit, present)), F.col("variable"))
    shares = counted.join(F.broadcast(totals), "variable").withColumns(
        {
            "percent": half_even(F.col("count") / F.col("_all") * 100, 2),
            "_place": place,
            "_number": F.col("value").try_cast("double"),
        }
    )
    ordered = shares.orderBy("_place", F.asc_nulls_last("_number"), F.asc_nulls_last("value"))
    shown = decode_labels(ordered, "variable", "value", labels or {}, out="category")
    return shown.select("variable", "category", "count", "percent")


def binary_target(df: DataFrame, target: str, positive: object, negative: object) -> Column:
    """The target as 0/1: a number as it is, a text by its two labels, anything else null."""
    value = F.col(quoted(target))
    if isinstance(df.schema[target].dataType, T.StringType):
        return F.when(value == positive, 1).when(value == negative, 0).cast("double")
    return known(value)


def _rate_table(counted: DataFrame) -> DataFrame:
    """Event rate and its 95 % interval from sums per bin."""
    rate = ratio(F.col("_hits"), F.col("n_known"), None)
    spread = F.sqrt(
        F.greatest(rate * (1 - rate), F.lit(0.0)) / F.when(F.col("n_known") > 0, F.col("n_known"))
    )
    return counted.withColumns({"rate": rate, "_half": spread * Z_95}).withColumns(
        {"ci_low": F.col("rate") - F.col("_half"), "ci_high": F.col("rate") + F.col("_half")}
    )


def event_rates(
    df: DataFrame,
    variables: Sequence[str],
    target: str,
    max_classes: int = 5,
    positive: object = "ELEITO",
    negative: object = "NÃO ELEITO",
    weight: str | None = None,
) -> DataFrame:
    """Frequency and event rate (with 95 % interval) per category of each variable.

    A number with more than ``max_classes`` values is cut at its quantiles.  Rows without a
    value have no category; rows without a target count in ``n`` only.  The interval is the
    normal one for a share, which repeated resampling of 0/1 values approaches.

    One scan sums up every value of every variable; bins are made of those sums.
    """
    named = list(dict.fromkeys(variables))
    numbers = [name for name in named if is_number(df, name)]
    whole = [name for name in numbers if isinstance(df.schema[name].dataType, T.IntegralType)]

    def entry(name: str) -> Column:
        value = F.col(quoted(name))
        nothing = F.lit(None)
        number, text = (known(value), nothing) if name in numbers else (nothing, value)
        return F.struct(
            F.lit(name).alias("variable"), number.cast("double").alias("number"),
            text.cast("string").alias("text"),
        )

    long = df.select(
        binary_target(df, target, positive, negative).alias("_hit"),
        (F.lit(1) if weight is None else F.col(weight)).cast("bigint").alias("_times"),
        F.inline(F.array(*map(entry, named))),
    )
    sums = (
        long.filter(F.col("number").isNotNull() | F.col("text").isNotNull())
        .groupBy("variable", "number", "text")
        .agg(
            F.sum("_times").alias("n"),
            total("_times", F.col("_hit").isNotNull()).alias("n_known"),
            F.sum(F.col("_hit") * F.col("_times")).alias("_hits"),
        )
    )
    number = F.col("number")
    edges: dict[str, list[float]] = {}
    if numbers:
        sums = stored(sums)
        edges = edges_of(sums.filter(number.isNotNull()).select("variable", number.alias("value"), "n"), max_classes)

    shown = F.when(F.col("variable").isin(whole), number.cast("bigint").cast("string")).otherwise(
        number.cast("string")
    )
    category = F.coalesce(F.col("text"), shown)
    lower = upper = number
    for name, cuts in edges.items():
        chosen = F.col("variable") == name
        place = bin_of(number, cuts)
        category = F.when(chosen, place["label"]).otherwise(category)
        lower = F.when(chosen, place["lower"]).otherwise(lower)
        upper = F.when(chosen, place["upper"]).otherwise(upper)
    binned = (
        sums.select(
            "variable", category.alias("category"), lower.alias("lower"), upper.alias("upper"),
            "n", "n_known", "_hits",
        )
        .groupBy("variable", "category", "lower", "upper")
        .agg(*[F.sum(name).alias(name) for name in ("n", "n_known", "_hits")])
    )
    return _rate_table(binned).select(
        "variable", "category", "lower", "upper", "n", "n_known", "rate", "ci_low", "ci_high"
    )


def event_rate_by(
    df: DataFrame,
    var: str,
    target: str,
    max_classes: int = 5,
    positive: object = "ELEITO",
    negative: object = "NÃO ELEITO",
    weight: str | None = None,
) -> DataFrame:
    """:func:`event_rates` of one variable."""
    return event_rates(df, [var], target, max_classes, positive, negative, weight)


def calibration_by(
    df: DataFrame,
    var: str,
    target: str,
    pred: str,
    max_classes: int = 5,
    positive: object = "ELEITO",
    negative: object = "NÃO ELEITO",
    approximate: float | None = None,
) -> DataFrame:
    """Observed rate (with 95 % interval) and mean prediction per category of ``var``."""
    edges = quantile_edges(df, var, max_classes, approximate=approximate)
    binned = add_bins(
        df.select(
            F.col(quoted(var)),
            binary_target(df, target, positive, negative).alias("_hit"),
            known(F.col(quoted(pred))).alias("_pred"),
        ),
        var, edges, "category",
    )
    counted = (
        binned.filter(F.col("category").isNotNull())
        .groupBy("category", "category_lower", "category_upper")
        .agg(
            total(None).alias("n"),
            F.count("_hit").alias("n_known"),
            F.sum("_hit").alias("_hits"),
            F.avg("_pred").alias("predicted"),
        )
    )
    return _rate_table(counted).select(
        F.lit(var).alias("variable"), "category",
        F.col("category_lower").alias("lower"), F.col("category_upper").alias("upper"),
        "n", F.col("rate").alias("observed"), "ci_low", "ci_high", "predicted",
    )


def missing_report(df: DataFrame) -> DataFrame:
    """Per column: rows, missing rows (null or NaN), their share, and the share as text."""

    def missing(name: str) -> Column:
        value = F.col(quoted(name))
        if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
            return value.isNull() | F.isnan(value)
        return value.isNull()

    counts = df.agg(
        total(None).alias("n_rows"),
        F.array(
            *[
                F.struct(F.lit(name).alias("variable"), total(None, missing(name)).alias("missing"))
                for name in df.columns
            ]
        ).alias("_cols"),
    )
    share = ratio(F.col("_col.missing"), F.col("n_rows"), None)
    return counts.withColumn("_col", F.explode("_cols")).select(
        "_col.variable", "n_rows", "_col.missing", share.alias("share"),
        percent_text(share, 1).alias("share_text"),
    )
