"""0/1 flags from keyword lists."""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from psephos.functions.text import matches_any
from psephos.operators.shape import quoted


def flag_by_patterns(df: DataFrame, col: str, patterns: Sequence[str], out: str) -> DataFrame:
    """Add ``out`` = 1 where a pattern is found in ``col``, else 0, also for null."""
    found = matches_any(F.col(quoted(col)), patterns)
    return df.withColumn(out, F.when(found, 1).otherwise(0))


def any_flag(df: DataFrame, cols: Sequence[str], out: str) -> DataFrame:
    """Replace the flags ``cols`` by ``out`` = 1 where at least one of them is 1.

    ``out`` may reuse the name of one of the flags and always becomes the last column.
    """
    either = reduce(lambda a, b: a | b, [F.col(quoted(name)) == 1 for name in cols])
    kept = [F.col(quoted(name)) for name in df.columns if name not in {*cols, out}]
    return df.select(*kept, F.when(either, 1).otherwise(0).alias(out))
