"""Running totals over a whole ordered table, without a single-task window."""
from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from psephos.sources.scratch import stored


def _numbered(column: pa.Array) -> np.ndarray:
    """A number per distinct value of a batch, -1 for null."""
    return np.asarray(column.dictionary_encode().indices.fill_null(-1), np.int64)


def _within_ranges(sums: Sequence[str], group: str | None, schema: pa.Schema):
    """Adds the totals of each sum up to every row, within its group and task, the next value, and the task."""

    def added(batch: pa.RecordBatch, carried: dict, same: bool, after: pa.RecordBatch | None, range_: int) -> pa.RecordBatch:
        n = batch.num_rows
        new = np.zeros(n, bool)
        if group is not None:
            codes = _numbered(batch.column(group))
            new[1:] = codes[1:] != codes[:-1]
        first = np.flatnonzero(np.concatenate([[True], new[1:]]))
        begin = np.repeat(first, np.diff(np.append(first, n)))
        columns = list(batch.columns)
        for name in sums:
            values = np.asarray(batch.column(name))
            whole = np.cumsum(values)
            cum = whole - (whole - values)[begin]
            if same:
                cum[begin == 0] += carried[name]
            carried[name] = cum[-1]
            # The next row of the same group; the last row of a task has none here.
            follows = np.append(~new[1:], after is not None)
            next_ = np.append(values[1:], values[:1] if after is None else np.asarray(after.column(name)[:1]))
            columns += [pa.array(cum), pa.array(next_, mask=~follows)]
        columns.append(pa.array(np.full(n, range_)))
        return pa.RecordBatch.from_arrays([x.cast(field.type) for x, field in zip(columns, schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        range_, held, same, carried = TaskContext.get().partitionId(), None, False, {}
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                goes_on = group is None or held.column(group)[-1].as_py() == batch.column(group)[0].as_py()
                yield added(held, carried, same, batch if goes_on else None, range_)
                same = goes_on
            held = batch
        if held is not None:
            yield added(held, carried, same, None, range_)

    return run


def running_totals(
    grouped: DataFrame,
    key: str,
    sums: Sequence[str],
    descending: bool = False,
    following: bool = False,
    group: str | None = None,
    rows_per_range: int | None = None,
) -> DataFrame:
    """Add ``cum_<sum>`` (inclusive) for each sum in the order of ``key``.

    ``grouped`` holds one row per key; with ``group``, each group has its own keys and totals.
    Rows are dealt into ranges of keys, as many as the session shuffles into or of about ``rows_per_range`` rows.
    Each task sorts its range and sums it up while writing it, so rows move once; the totals of the ranges, one row
    for each (and group), then give the offsets.
    ``following`` also adds ``next_<sum>``, the value of the next key, null for the last.
    """
    if rows_per_range is None:
        ranges = int(grouped.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    else:
        ranges = max(1, -(-grouped.count() // rows_per_range))
    groups = [] if group is None else [group]

    def ordered(name: str) -> Column:
        return F.col(name).desc() if descending else F.col(name).asc()

    order = [*(F.col(name).asc() for name in groups), ordered(key)]
    added = [StructField(f"{kind}_{name}", grouped.schema[name].dataType) for name in sums for kind in ("cum", "next")]
    types = StructType([*grouped.schema.fields, *added, StructField("_range", LongType())])
    run = _within_ranges(sums, group, to_arrow_schema(types))
    placed = stored(grouped.repartitionByRange(ranges, *order).sortWithinPartitions(*order).mapInArrow(run, types))

    first = F.max_by if descending else F.min_by
    totals = placed.groupBy(*groups, "_range").agg(
        *[F.sum(name).alias(f"_total_{name}") for name in sums],
        *[first(name, key).alias(f"_first_{name}") for name in sums],
    )
    later = Window.partitionBy(*(groups or [F.lit(0)])).orderBy("_range")
    earlier = later.rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *groups, "_range",
        *[F.coalesce(F.sum(f"_total_{n}").over(earlier), F.lit(0)).alias(f"_before_{n}") for n in sums],
        *[F.lead(f"_first_{n}").over(later).alias(f"_after_{n}") for n in sums],
    )
    # Without groups a row per range, and there are as many of them as partitions.
    joined = placed.join(offsets if groups else F.broadcast(offsets), [*groups, "_range"])
    out = []
    for name in sums:
        out.append((F.col(f"cum_{name}") + F.col(f"_before_{name}")).alias(f"cum_{name}"))
        if following:
            out.append(F.coalesce(f"next_{name}", f"_after_{name}").alias(f"next_{name}"))
    return joined.select(*grouped.columns, *out)
