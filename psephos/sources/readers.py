"""Reading delimited extracts and stored tables."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from psephos.operators.shape import select_columns, union_extracts


def read_extracts(
    spark: SparkSession,
    paths: Sequence[str],
    schema: T.StructType,
    sep: str = ";",
    encoding: str = "iso-8859-1",
) -> DataFrame:
    """Union of delimited files with a header line, restricted to the columns of ``schema``.

    Spark binds a CSV schema by position, while extracts carry more columns than are
    wanted and their order changes from year to year.  So each path's own header
    fixes the order, the wanted columns take their declared types, and all others stay
    unread text that column pruning drops.  No value is inferred, hence no extra pass.
    Files below one path must share their header; one that differs is an error.
    """
    wanted = {field.name: field for field in schema.fields}
    frames = []
    for path in paths:
        reader = spark.read.options(header=True, sep=sep, encoding=encoding)
        header = reader.csv(path).columns
        bound = T.StructType(
            [wanted.get(name, T.StructField(name, T.StringType())) for name in header]
        )
        checked = reader.option("enforceSchema", False).schema(bound)
        frames.append(select_columns(checked.csv(path), schema.names))
    return union_extracts(frames)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A table stored by :func:`psephos.sources.writers.write_table`."""
    return spark.read.parquet(path)
