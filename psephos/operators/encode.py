"""Numeric codes for categories, and their display labels."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from psephos.operators.recode import looked_up
from psephos.operators.shape import quoted

FIRST = object()  # reference of one_hot(): the first category in sorted order


def encode_binary(df: DataFrame, col: str, one: str, out: str | None = None) -> DataFrame:
    """1 for the label ``one``, 0 for anything else, null included."""
    return df.withColumn(out or col, F.when(F.col(quoted(col)) == one, 1).otherwise(0))


def encode_ordinal(
    df: DataFrame, col: str, mapping: Mapping[str, int], default: int = 0, out: str | None = None
) -> DataFrame:
    """The code of each label, ``default`` for anything else, null included."""
    code = looked_up(F.col(quoted(col)), mapping)
    return df.withColumn(out or col, F.coalesce(code, F.lit(default)))


def discover_categories(
    df: DataFrame, cols: Sequence[str], limit: int | None = None
) -> dict[str, list]:
    """The distinct non-null values of each column, sorted, found in one pass.

    Meant for columns with few values, since each becomes a column.  With ``limit``, more than so
    many in all is an error, and no more than that ever reaches the driver.
    """
    pairs = df.unpivot(
        [], [F.col(quoted(name)).cast("string").alias(name) for name in cols], "variable", "value"
    )
    found = pairs.dropna().distinct()
    found = (found if limit is None else found.limit(limit + 1)).collect()
    if limit is not None and len(found) > limit:
        raise ValueError(f"more than {limit} categories in {', '.join(cols)}")
    types = dict(df.dtypes)
    result: dict[str, list] = {name: [] for name in cols}
    for row in found:
        number = types[row.variable] in {"tinyint", "smallint", "int", "bigint"}
        result[row.variable].append(int(row.value) if number else row.value)
    return {name: sorted(values) for name, values in result.items()}


def one_hot(
    df: DataFrame,
    col: str,
    categories: Sequence,
    reference: object = FIRST,
    drop_original: bool = True,
) -> DataFrame:
    """Append a 0/1 column ``<col>_<category>`` per category but the reference.

    Values outside the list, and null, are 0 in all of them.  A named reference must be among
    the categories; None leaves out nothing.
    """
    listed = sorted(set(categories))
    if reference is FIRST:
        listed = listed[1:]
    elif reference is not None:
        if reference not in listed:
            raise ValueError(f"{reference} is not among the categories of {col}")
        listed.remove(reference)
    value = F.col(quoted(col))
    kept: list[Column] = [
        F.col(quoted(name)) for name in df.columns if not (drop_original and name == col)
    ]
    dummies = [F.when(value == item, 1).otherwise(0).alias(f"{col}_{item}") for item in listed]
    return df.select(*kept, *dummies)


def decode_labels(
    df: DataFrame,
    var_col: str,
    val_col: str,
    labels: Mapping[str, Mapping[object, str]],
    out: str | None = None,
) -> DataFrame:
    """Replace the coded value of each variable by its display label, or keep it as text.

    The dictionary is part of the plan, so no join is needed.
    """
    variable, value = F.col(quoted(var_col)), F.col(quoted(val_col)).cast("string")
    result = None
    for name, mapping in labels.items():
        for code, label in mapping.items():
            step = F.when if result is None else result.when
            result = step((variable == name) & (value == str(code)), label)
    return df.withColumn(out or val_col, value if result is None else result.otherwise(value))
