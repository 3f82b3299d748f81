"""Writing cohort tables and report tables."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def write_table(
    df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite"
) -> str:
    """Store a table as Parquet and return its path.

    Rows stay in the tasks that hold them: a shuffle on a key such as the year would
    gather whole years in single tasks.
    """
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)
    return path


def write_report(
    df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite", order: Sequence = (),
    keep_order: bool = False,
) -> str:
    """Store a report of a few rows as one file (``parquet``, or ``csv`` with a header).

    ``order`` sorts the rows in the writing task.  ``keep_order`` is for a table that ends in a sort:
    the one task reads its sorted partitions in turn.  Otherwise any order may be lost on the way.

    Only its rows move to the one writing task; what computes them stays parallel.  A
    table that grows with the data, such as a ROC curve, goes to :func:`write_table`.
    """
    single = df.coalesce(1) if keep_order else df.repartition(1)
    writer = (single.sortWithinPartitions(*order) if order else single).write.mode(mode)
    if fmt == "csv":
        writer.option("header", True).csv(path)
    elif fmt == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"unknown report format: {fmt}")
    return path
