"""Choosing columns and rows, stacking extracts, naming columns."""
from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def quoted(name: str) -> str:
    """A column name that may hold dots, dashes or brackets, quoted for lookup."""
    return "`" + name.replace("`", "``") + "`"


def select_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """The named columns in the given order; every one must be there."""
    missing = [name for name in cols if name not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {', '.join(missing)}")
    return df.select(*[F.col(quoted(name)) for name in cols])


def feature_columns(df: DataFrame, exclude: Iterable[str]) -> list[str]:
    """All column names but the excluded ones (target and period), in table order."""
    left_out = set(exclude)
    return [name for name in df.columns if name not in left_out]


def keep_in(df: DataFrame, col: str, values: Sequence) -> DataFrame:
    """Rows whose value is listed; null is not."""
    return df.filter(F.col(quoted(col)).isin(list(values)))


def drop_in(df: DataFrame, col: str, values: Sequence) -> DataFrame:
    """Rows whose value is known and not listed; null rows go too."""
    return df.filter(~F.col(quoted(col)).isin(list(values)))


def drop_null(df: DataFrame, col: str) -> DataFrame:
    """Rows with a value in ``col``."""
    return df.filter(F.col(quoted(col)).isNotNull())


def split_by_period(
    df: DataFrame, col: str, train: Sequence, test: Sequence
) -> tuple[DataFrame, DataFrame]:
    """Training and test rows by period; both prune partitions if ``col`` partitions the table."""
    return keep_in(df, col, train), keep_in(df, col, test)


def union_extracts(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows of all frames matched by column name; absent columns become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def collapse(df: DataFrame, cols: Sequence[str], count: str = "n") -> DataFrame:
    """One row per distinct combination of ``cols`` with its number of rows.

    Coded tables repeat few combinations very often.  Whatever treats equal rows
    equally (counts, rates, a logit fit, its evaluation) then needs one scan of the
    big table, and no group is ever larger than its partial counts.
    """
    return df.groupBy(*[F.col(quoted(name)) for name in cols]).agg(
        F.count(F.lit(1)).alias(count)
    )


def clean_name(name: str) -> str:
    """A plain ASCII identifier: accents off, dash and space to ``_``, ``+`` to ``_mais``."""
    plain = unicodedata.normalize("NFKD", name.replace("–", "-"))
    plain = plain.encode("ascii", "ignore").decode("ascii")
    return plain.translate(
        str.maketrans({"-": "_", " ": "_", "+": "_mais", ".": None, "(": None, ")": None})
    )


def clean_column_names(df: DataFrame) -> DataFrame:
    """Rename all columns by :func:`clean_name`; names that would coincide are an error."""
    names = [clean_name(name) for name in df.columns]
    if len(set(names)) < len(names):
        raise ValueError(f"column names coincide after cleaning: {sorted(names)}")
    return df.toDF(*names)
