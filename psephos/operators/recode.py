"""Recoding labels, dates, ages and bands."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from psephos.operators.shape import quoted

KEEP = object()  # default of recode(): values outside all groups stay as they are
AS_DEFAULT = object()  # null_as of recode(): null is treated like any other unlisted value


def recode(
    df: DataFrame,
    col: str,
    groups: Mapping[str, Sequence[str]],
    default: object = KEEP,
    null_values: Sequence[str] = (),
    trim: bool = False,
    null_as: object = AS_DEFAULT,
    out: str | None = None,
) -> DataFrame:
    """Replace each label by the name of its group, the first one that lists it.

    ``null_values`` become null.  Anything else, null included, becomes ``default`` (a label,
    None, or ``KEEP``); ``null_as`` sets another label, or None, for null.
    """
    value = F.col(quoted(col))
    probe = F.trim(value) if trim else value
    result = value if default is KEEP else F.lit(default).cast("string")
    labels: dict[str, str] = {}
    for label, members in groups.items():
        for member in members:
            labels.setdefault(member, label)
    if labels:
        result = F.coalesce(looked_up(probe, labels), result)
    if null_values:
        result = F.when(~F.coalesce(probe.isin(list(null_values)), F.lit(False)), result)
    if null_as is not AS_DEFAULT:
        result = F.when(value.isNull(), F.lit(null_as).cast("string")).otherwise(result)
    return df.withColumn(out or col, result)


def looked_up(value: Column, mapping: Mapping) -> Column:
    """What ``mapping`` holds for the value, null if nothing.

    A constant map is searched by a loop outside the generated code of the row, which stays short enough
    to be compiled; a branch per result would not.
    """
    pairs = [F.lit(x) for pair in mapping.items() for x in pair]
    return F.element_at(F.create_map(*pairs), value) if pairs else F.lit(None)


def map_values(
    df: DataFrame, col: str, mapping: Mapping[str, str], out: str, default: str | None = None
) -> DataFrame:
    """Add ``out`` = the mapped label, else ``default``, also for null."""
    found = looked_up(F.col(quoted(col)), mapping)
    return df.withColumn(out, found if default is None else F.coalesce(found, F.lit(default)))


def parse_date(df: DataFrame, col: str, fmt: str, out: str) -> DataFrame:
    """Add the date written in ``col``; null where the text is no date of that format."""
    return df.withColumn(out, F.try_to_date(F.col(quoted(col)), fmt))


def age_at_year(
    df: DataFrame, year_col: str, date_col: str, out: str, birth_year: str
) -> DataFrame:
    """Add the birth year and the age reached in the year, whatever the day."""
    born = F.year(F.col(quoted(date_col)))
    return df.withColumns({birth_year: born, out: F.col(quoted(year_col)) - born})


def band(
    df: DataFrame,
    col: str,
    edges: Sequence[float],
    labels: Sequence[str],
    null_label: str,
    out: str,
) -> DataFrame:
    """Add the band of a number: ``labels[i]`` below ``edges[i]``, the last label from there on."""
    if len(labels) != len(edges) + 1:
        raise ValueError("there must be one label more than edges")
    value = F.col(quoted(col))
    result = F.when(value.isNull(), null_label)
    for edge, label in zip(edges, labels):
        result = result.when(value < edge, label)
    return df.withColumn(out, result.otherwise(labels[-1]))
