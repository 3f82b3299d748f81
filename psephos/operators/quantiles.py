"""Exact quantile edges and quantile bins."""
from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from psephos.functions.numeric import known, total
from psephos.operators.shape import quoted


def is_number(df: DataFrame, col: str) -> bool:
    """Whether the column holds numbers."""
    return isinstance(df.schema[col].dataType, T.NumericType)


#: Values between two brackets that come to the driver at most; more are bracketed again.
BETWEEN = 10_000
#: Relative rank error of the sketches behind the first brackets.
ACCURACY = 1_000


def quantile_edges(
    df: DataFrame,
    col: str,
    k: int,
    weight: str | None = None,
    approximate: float | None = None,
    between: int = BETWEEN,
) -> list[float] | None:
    """Edges of ``k`` bins of equal frequency, equal edges merged; None if it needs no bins.

    A column needs none if it has at most ``k`` distinct values or only 0 and 1.  Edges are
    order statistics with linear interpolation; ``approximate`` (a relative rank error) reads them off a sketch
    of the rows instead.
    """
    if not is_number(df, col):
        return None
    rows = df.select(
        F.lit(col).alias("variable"), known(F.col(quoted(col))).alias("value"),
        (F.lit(1) if weight is None else F.col(weight)).cast("bigint").alias("n"),
    ).filter(F.col("value").isNotNull())
    if approximate is not None:
        if weight is not None:
            raise ValueError("approximate edges count every row once")
        few = {row.value for row in rows.select("value").distinct().limit(max(k, 2) + 1).collect()}
        if len(few) <= k or few <= {0.0, 1.0}:
            return None
        shares = [i / k for i in range(k + 1)]
        return sorted(set(rows.approxQuantile("value", shares, approximate)))
    return edges_of(rows, k, between).get(col)


def edges_of(rows: DataFrame, k: int, between: int = BETWEEN) -> dict[str, list[float]]:
    """Edges of ``k`` bins per variable that needs bins, from rows (variable, value, n).

    One pass sketches every variable, which gives two brackets around each wanted rank; a second counts the rows
    up to every bracket; a third reads the few values between the brackets of a rank.  Nothing is sorted or
    shuffled but sums.  ``rows`` is read in each pass.  The driver gets a few numbers per edge, and at most
    ``between`` values for a pair of brackets, which are moved closer until that holds.
    """
    rows = rows.filter(F.col("n") > 0)
    shares = sorted({min(max(i / k + step, 0.0), 1.0) for i in range(k + 1) for step in (-2 / ACCURACY, 0.0, 2 / ACCURACY)})
    sketches = rows.groupBy("variable").agg(
        F.sum("n").alias("rows"), F.min("value").alias("low"), F.max("value").alias("high"),
        F.bool_and(F.col("value").isin(0.0, 1.0)).alias("dummy"), F.approx_count_distinct("value").alias("distinct"),
        F.percentile_approx("value", shares, 10 * ACCURACY).alias("marks"),
    ).collect()
    # The estimate is off by a twentieth; only columns of few values need an exact count, and these are few.
    unsure = [s.variable for s in sketches if s.distinct <= 2 * k + 2 and not s.dummy]
    exact = {}
    if unsure:
        of_few = rows.filter(F.col("variable").isin(unsure)).groupBy("variable").agg(F.size(F.collect_set("value")).alias("distinct"))
        exact = {row.variable: row.distinct for row in of_few.collect()}
    cut = {s.variable: s for s in sketches if not s.dummy and exact.get(s.variable, k + 1) > k}
    if not cut:
        return {}
    ranks = {
        name: sorted({r for i in range(k + 1) for p in [i / k * (s.rows - 1)] for r in (int(p), min(int(p) + 1, s.rows - 1))})
        for name, s in cut.items()
    }
    rows = rows.filter(F.col("variable").isin(list(cut)))
    marks = {name: sorted({s.low, s.high, *s.marks}) for name, s in cut.items()}
    values = _values_at(rows, ranks, marks, between)
    edges = {}
    for name, s in cut.items():
        found = set()
        for i in range(k + 1):
            place = i / k * (s.rows - 1)
            low = int(place)
            below, above = values[name, low], values[name, min(low + 1, s.rows - 1)]
            found.add(below + (above - below) * (place - low))
        edges[name] = sorted(found)
    return edges


def _counts(rows: DataFrame, marks: Mapping[str, Sequence[float]]) -> dict[str, list[tuple[int, int, int]]]:
    """Per variable and gap between its marks: rows at the lower mark, rows inside, and distinct values inside, about.

    A mark is the smallest value of its gap; the last gap holds its mark alone.
    """
    place = F.lit(None).cast("int")
    for name, own in marks.items():
        edges = F.array(*map(F.lit, own))
        mine = F.size(F.filter(edges, lambda mark: mark <= F.col("value"))) - 1
        place = F.when(F.col("variable") == name, mine).otherwise(place)
    at = [F.when(F.col("variable") == name, F.element_at(F.array(*map(F.lit, own)), F.col("gap") + 1)) for name, own in marks.items()]
    on_mark = F.col("value") == F.coalesce(*at)
    # Later rounds have marks for some variables only; rows of others have no gap.
    sums = rows.filter(F.col("variable").isin(list(marks))).withColumn("gap", place).groupBy("variable", "gap").agg(
        total("n", on_mark).alias("at"), total("n", ~on_mark).alias("inside"), F.approx_count_distinct(F.when(~on_mark, F.col("value"))).alias("distinct")
    )
    out = {name: [(0, 0, 0)] * len(own) for name, own in marks.items()}
    for row in sums.collect():
        out[row.variable][row.gap] = (row.at, row.inside, row.distinct)
    return out


def _values_at(
    rows: DataFrame, ranks: Mapping[str, Sequence[int]], marks: dict[str, list[float]], between: int
) -> dict[tuple[str, int], float]:
    """The value at each wanted rank, from 0, of each variable."""
    values: dict[tuple[str, int], float] = {}
    while True:
        counted = _counts(rows, marks)
        gaps: dict[tuple[str, int], tuple[int, list[int], int]] = {}
        for name, own in marks.items():
            start = 0
            for gap, (at, inside, distinct) in enumerate(counted[name]):
                for rank in ranks[name]:
                    if start <= rank < start + at:
                        values[name, rank] = own[gap]
                    elif start + at <= rank < start + at + inside:
                        gaps.setdefault((name, gap), (start + at, [], distinct))[1].append(rank)
                start += at + inside
        wide = {key for key, (_, _, distinct) in gaps.items() if distinct > between}
        inside_of = {
            key: (F.col("variable") == key[0]) & (F.col("value") > marks[key[0]][key[1]])
            & (F.col("value") < (marks[key[0]][key[1] + 1] if key[1] + 1 < len(marks[key[0]]) else math.inf))
            for key in gaps
        }
        narrow = [key for key in gaps if key not in wide]
        if narrow:
            here = F.lit(False)
            for key in narrow:
                here = here | inside_of[key]
            # About ``between`` values a gap, and a gap holds a wanted rank.
            found = rows.filter(here).groupBy("variable", "value").agg(F.sum("n").alias("n")).collect()
            for name, gap in narrow:
                start, wanted, _ = gaps[name, gap]
                low = marks[name][gap]
                high = marks[name][gap + 1] if gap + 1 < len(marks[name]) else math.inf
                for value, n in sorted((row.value, row.n) for row in found if row.variable == name and low < row.value < high):
                    values.update({(name, rank): value for rank in wanted if start <= rank < start + n})
                    start += n
        if not wide:
            return values
        # More marks within the wide gaps, from a sketch of each; a gap without wanted ranks needs none.
        closer: dict[str, list[float]] = {}
        for key in sorted(wide):
            shares = [i / 100 for i in range(1, 100)]
            own = rows.filter(inside_of[key]).agg(F.percentile_approx("value", shares, ACCURACY).alias("marks")).first().marks
            closer.setdefault(key[0], []).extend(own)
        ranks = {name: [rank for rank in ranks[name] if (name, rank) not in values] for name in closer}
        marks = {name: sorted({*marks[name], *own}) for name, own in closer.items()}


def medians(rows: DataFrame, between: int = BETWEEN) -> dict[str, float]:
    """The exact median of each variable, from rows (variable, value), found between brackets as the edges are."""
    rows = rows.withColumn("n", F.lit(1).cast("bigint"))
    shares = [0.5 - 2 / ACCURACY, 0.5, 0.5 + 2 / ACCURACY]
    sketches = rows.groupBy("variable").agg(
        F.sum("n").alias("rows"), F.min("value").alias("low"), F.max("value").alias("high"),
        F.percentile_approx("value", shares, 10 * ACCURACY).alias("marks"),
    ).collect()
    ranks = {s.variable: sorted({(s.rows - 1) // 2, s.rows // 2}) for s in sketches}
    values = _values_at(rows, ranks, {s.variable: sorted({s.low, s.high, *s.marks}) for s in sketches}, between)
    return {name: (values[name, own[0]] + values[name, own[-1]]) / 2 for name, own in ranks.items()}


def bin_of(number: Column, edges: Sequence[float]) -> Column:
    """The bin (label, lower, upper) of a number that is not null."""
    bins = [
        F.struct(
            F.lit(f"{'[' if i == 0 else '('}{low}, {high}]").alias("label"),
            F.lit(low).alias("lower"),
            F.lit(high).alias("upper"),
        )
        for i, (low, high) in enumerate(zip(edges, edges[1:]))
    ]
    place = F.when(number.isNull(), None)
    for one, upper in zip(bins[:-1], edges[1:-1]):
        place = place.when(number <= upper, one)
    return place.otherwise(bins[-1])


def add_bins(df: DataFrame, col: str, edges: Sequence[float] | None, out: str) -> DataFrame:
    """Add ``out`` (a label), ``out_lower`` and ``out_upper`` for given edges.

    Bins are closed on the right and the first also on the left.  Without edges the value is
    its own category, with the bounds null unless it is a number.  Null gets no bin.
    """
    value = F.col(quoted(col))
    if edges is None:
        bound = known(value) if is_number(df, col) else F.lit(None).cast("double")
        text = value.cast("string")
        if df.schema[col].dataType in (T.DoubleType(), T.FloatType()):
            text = F.when(~F.isnan(value), text)
        return df.withColumns({out: text, f"{out}_lower": bound, f"{out}_upper": bound})

    placed = df.withColumn("_bin", bin_of(known(value), edges))
    return placed.withColumns(
        {out: F.col("_bin.label"), f"{out}_lower": F.col("_bin.lower"),
         f"{out}_upper": F.col("_bin.upper")}
    ).drop("_bin")


def quantile_bin(
    df: DataFrame, col: str, k: int, out: str, approximate: float | None = None
) -> DataFrame:
    """Add the quantile bin of ``col``; a column that needs no bins keeps its values."""
    return add_bins(df, col, quantile_edges(df, col, k, approximate=approximate), out)
