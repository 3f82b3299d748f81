"""Random forest with balanced classes: fit, scores, importances, grid search.

Predictors are binned and equal rows merged, so a fit reads one row per combination that occurs.  Trees are
bagged by the counts of these rows.  Merged rows that fit into ``TASK_ROWS`` travel to tasks that grow whole
trees; beyond that, every level of all trees is one pass over the stored rows, whose counts per node, predictor
and bin Spark adds up.  Both ways give the same trees.
"""
from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, replace
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from psephos.functions.numeric import total
from psephos.operators.shape import quoted
from psephos.operators.trees import Growing, Rows, Settings, Tree, gains, grown, reached
from psephos.sources.scratch import stored

SEED = 100
#: Merged rows that may travel to every task; a byte per predictor and 20 more each.
TASK_ROWS = 200_000
#: Trees that one task grows.
TREES_PER_TASK = 5


def subset_size(features: int, rule: str) -> int:
    """Predictors tried per split; roots and logarithms are cut, not raised."""
    if rule == "sqrt":
        return max(1, math.isqrt(features))
    if rule == "log2":
        return max(1, int(math.log2(features)))
    return features if rule == "all" else min(features, max(1, int(rule)))


@dataclass
class Forest:
    """Trees over binned predictors; ``cuts`` holds the upper edge of every bin but the last, per predictor."""

    features: list[str]
    cuts: list[list[float]]
    trees: list[Tree]
    settings: Settings


@dataclass
class _Merged:
    """The merged rows of a training table: c0, c1, ... (bins), label, n and, with folds, n0, n1, ... per fold."""

    table: DataFrame
    features: list[str]
    cuts: list[list[float]]
    folds: int

    @property
    def bins(self) -> int:
        return max((len(cut) for cut in self.cuts), default=0) + 1

    def class_rows(self) -> np.ndarray:
        """Rows per part and class: all of them first, then each fold."""
        names = ["n", *(f"n{i}" for i in range(self.folds))]
        sums = {row["label"]: row for row in self.table.groupBy("label").agg(*(F.sum(n).alias(n) for n in names)).collect()}
        return np.asarray([[sums[label][n] if label in sums else 0 for label in (0, 1)] for n in names], np.int64)


def _settings(params: Mapping, features: int) -> tuple[Settings, int, int]:
    """Tree settings, trees and bins of ``params``."""
    given = {"trees": 100, "bins": 32, "max_features": "sqrt", "depth": 5, **params}
    names = {"trees", "bins", "max_features", "depth", "min_leaf", "min_split", "min_gain", "min_share"}
    unknown = set(given) - names
    if unknown:
        raise ValueError(f"unknown forest parameters: {', '.join(sorted(unknown))}")
    tried = subset_size(features, given.pop("max_features"))
    trees, bins = given.pop("trees"), given.pop("bins")
    return Settings(tried=tried, **given), trees, bins


def _cut_points(train: DataFrame, features: Sequence[str], bins: int) -> list[list[float]]:
    """Up to ``bins - 1`` edges per predictor: between its values if they are few, else at quantiles."""
    value = [F.col(f"x{i}") for i in range(len(features))]
    first = train.agg(
        *[F.approx_count_distinct(v).alias(f"d{i}") for i, v in enumerate(value)],
        *[F.count_if(v.isNull() | F.isnan(v)).alias(f"gap{i}") for i, v in enumerate(value)],
    ).first()
    missing = [name for i, name in enumerate(features) if first[f"gap{i}"]]
    if missing:
        raise ValueError(f"missing values in {', '.join(missing)}")
    # The count is an estimate, which is off by a twentieth: a set of twice the bins is bounded all the same.
    few = [first[f"d{i}"] <= 2 * bins for i in range(len(features))]
    shares = [i / bins for i in range(1, bins)]
    found = train.agg(
        *[(F.collect_set(v) if few[i] else F.percentile_approx(v, shares, 10_000)).alias(f"v{i}") for i, v in enumerate(value)]
    ).first()
    cuts = []
    for i in range(len(features)):
        values = sorted(set(found[f"v{i}"] or []))
        if few[i] and len(values) > bins:
            values = sorted({values[len(values) * k // bins] for k in range(1, bins)})
            cuts.append(values)
        elif few[i]:
            cuts.append([(a + b) / 2 for a, b in zip(values, values[1:])])
        else:
            cuts.append(values)
    return cuts


def _bin(value: Column, cuts: Sequence[float]) -> Column:
    """How many of the edges lie below the value."""
    place = F.lit(0)
    for cut in cuts:
        place = place + (value > F.lit(cut)).cast("int")
    return place.cast("tinyint")


def _merge(train: DataFrame, features: Sequence[str], target: str, bins: int, weight: str | None, folds: int = 0) -> _Merged:
    """Bin the predictors of rows with a target and merge equal rows; ``_fold`` numbers the folds if there are any."""
    used = train.filter(F.col(quoted(target)).isNotNull()).select(
        *[F.col(quoted(name)).cast("double").alias(f"x{i}") for i, name in enumerate(features)],
        (F.col(quoted(target)) == 1).cast("int").alias("label"),
        (F.lit(1) if weight is None else F.col(quoted(weight))).cast("long").alias("times"),
        *(["_fold"] if folds else []),
    )
    cuts = _cut_points(used, features, bins)
    codes = [_bin(F.col(f"x{i}"), cut).alias(f"c{i}") for i, cut in enumerate(cuts)]
    coded = used.select(*codes, "label", "times", *(["_fold"] if folds else []))
    sums = [total("times").cast("long").alias("n")]
    sums += [total("times", F.col("_fold") == i).cast("long").alias(f"n{i}") for i in range(folds)]
    merged = stored(coded.groupBy(*[f"c{i}" for i in range(len(features))], "label").agg(*sums))
    return _Merged(merged, list(features), cuts, folds)


def _rows(table: pa.Table | pa.RecordBatch, features: int, fold: int | None = None) -> Rows:
    """Merged rows from Arrow; with a fold, the counts are of the rows outside it."""
    codes = np.stack([np.asarray(table.column(f"c{i}"), np.int64) for i in range(features)], 1) if features else np.zeros((table.num_rows, 0), np.int64)
    counts = np.asarray(table.column("n"), np.int64)
    if fold is not None:
        counts = counts - np.asarray(table.column(f"n{fold}"), np.int64)
    return Rows.of(codes, np.asarray(table.column("label"), np.int64), counts)


def _class_weights(rows: np.ndarray) -> tuple[float, float]:
    """Balanced weights from the rows of both classes."""
    present = np.count_nonzero(rows)
    return tuple(float(rows.sum() / (present * n)) if n else 0.0 for n in rows)


def _in_tasks(merged: _Merged, specs: list[tuple], parts: int, work, types: str, schema: pa.Schema) -> DataFrame:
    """``work(rows table, spec)`` for every spec, in ``parts`` tasks that get all merged rows; at most ``TASK_ROWS``."""
    spark = merged.table.sparkSession
    rows = spark.sparkContext.broadcast(merged.table.toArrow().combine_chunks())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for spec in batch.column("spec").to_pylist():
                out = work(rows.value, specs[spec])
                yield pa.RecordBatch.from_arrays([pa.array(column, field.type) for column, field in zip(out, schema)], schema=schema)

    numbers = spark.range(0, len(specs), 1, parts).withColumnRenamed("id", "spec")
    return numbers.mapInArrow(run, types)


_TREE_TYPES = "tree int, parts array<binary>"
_TREE = pa.schema([("tree", pa.int32()), ("parts", pa.list_(pa.binary()))])


def _grow_in_tasks(merged: _Merged, trees: int, settings: Settings, weights: tuple[float, float]) -> list[Tree]:
    specs = [(first, min(first + TREES_PER_TASK, trees)) for first in range(0, trees, TREES_PER_TASK)]
    features, bins = len(merged.features), merged.bins

    def work(table: pa.Table, spec: tuple[int, int]) -> list:
        rows = _rows(table, features)
        numbers = list(range(*spec))
        return [numbers, [grown(rows, t, SEED, settings, bins, weights).packed() for t in numbers]]

    found = _in_tasks(merged, specs, len(specs), work, _TREE_TYPES, _TREE).collect()
    return [Tree.read(row["parts"]) for row in sorted(found, key=lambda row: row["tree"])]


def _grow_by_levels(merged: _Merged, trees: int, settings: Settings, weights: tuple[float, float], fold: int | None = None) -> list[Tree]:
    """All trees level by level: each pass counts the rows of every open node, which are added up per node."""
    spark, features, bins = merged.table.sparkSession, len(merged.features), merged.bins
    growing = [Growing(t, SEED, settings, bins, features, weights) for t in range(trees)]
    schema = pa.schema([("tree", pa.int32()), ("node", pa.int32()), ("place", pa.int32()), ("n", pa.int64())])
    types = "tree int, node int, place int, n long"

    def counts(batches: Iterator[pa.RecordBatch], state: list, begin: bool) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, TASK_ROWS):
                rows = _rows(batch.slice(start, TASK_ROWS), features, fold)
                for under in state:
                    draws = rows.draw(under.tree, SEED)
                    if begin:
                        flat = np.bincount(rows.label, draws, 2)
                        size = 2
                    else:
                        at = reached(under.finished(), rows.codes)
                        node = np.searchsorted(under.open, at)
                        held = under.open[np.minimum(node, len(under.open) - 1)] == at
                        flat = under.histogram(rows, draws, np.where(held, node, -1)).ravel()
                        size = len(flat) // len(under.open)
                    full = np.flatnonzero(flat)
                    columns = (np.full(len(full), under.tree), full // size, full % size, flat[full])
                    yield pa.RecordBatch.from_arrays([pa.array(c, field.type) for c, field in zip(columns, schema)], schema=schema)

    def passed(begin: bool) -> DataFrame:
        state = spark.sparkContext.broadcast([under for under in growing if begin or len(under.open)])
        found = merged.table.mapInArrow(lambda batches: counts(batches, state.value, begin), types)
        return found.groupBy("tree", "node", "place").agg(F.sum("n").alias("n"))

    sums = {(row["tree"], row["place"]): row["n"] for row in passed(True).collect()}  # two a tree
    for under in growing:
        under.begin(np.asarray([sums.get((under.tree, label), 0) for label in (0, 1)], np.int64))
    chosen = pa.schema([("tree", pa.int32()), ("node", pa.int32()), ("feature", pa.int32()), ("cut", pa.int32()), ("left", pa.list_(pa.int64())), ("gain", pa.float64())])
    while any(len(under.open) for under in growing):
        state = spark.sparkContext.broadcast({under.tree: under for under in growing if len(under.open)})
        per_node = passed(False).groupBy("tree", "node").agg(F.collect_list("place").alias("places"), F.collect_list("n").alias("counts"))

        def split(batches: Iterator[pa.RecordBatch], state=state) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for tree, node, places, numbers in zip(*(batch.column(i).to_pylist() for i in range(4))):
                    under = state.value[tree]
                    flat = np.zeros(min(settings.tried, features) * bins * 2)
                    flat[places] = numbers
                    feature, cut, left, gain = under.best(flat.reshape(1, -1, bins, 2), np.asarray([node]))
                    columns = ([tree], [node], feature, cut, [left[0].astype(np.int64)], gain)
                    yield pa.RecordBatch.from_arrays([pa.array(c, field.type) for c, field in zip(columns, chosen)], schema=chosen)

        # As many rows as the trees have open nodes.
        found = per_node.mapInArrow(split, "tree int, node int, feature int, cut int, left array<long>, gain double").toArrow()
        arrays = {name: found.column(name).to_numpy() for name in ("tree", "node", "feature", "cut", "gain")}
        lefts = np.asarray(found.column("left").to_pylist(), np.float64).reshape(-1, 2)
        for under in growing:
            if len(under.open):
                mine = np.flatnonzero(arrays["tree"] == under.tree)
                mine = mine[np.argsort(arrays["node"][mine])]
                under.split(arrays["feature"][mine], arrays["cut"][mine], lefts[mine], arrays["gain"][mine])
    return [under.finished() for under in growing]


def fit_forest(
    train: DataFrame, features: Sequence[str], target: str, params: Mapping, weight: str | None = None
) -> Forest:
    """Fit a forest on balanced classes; ``weight`` holds how many rows a row stands for.

    ``params``: ``trees``, ``depth``, ``min_leaf`` drawn rows per leaf, ``min_split`` drawn rows of a node that is
    split, ``max_features`` (``sqrt``, ``log2``, ``all`` or a number as text), ``min_gain`` (decrease of impurity), ``min_share``
    (of the total weight in a leaf) and ``bins`` per predictor.  Rows without a target take no part; a missing
    predictor is an error.
    """
    settings, trees, bins = _settings(params, len(features))
    return _fit(_merge(train, features, target, bins, weight), trees, settings)


def _fit(merged: _Merged, trees: int, settings: Settings) -> Forest:
    weights = _class_weights(merged.class_rows()[0])
    grow = _grow_in_tasks if merged.table.count() <= TASK_ROWS else _grow_by_levels
    return Forest(merged.features, merged.cuts, grow(merged, trees, settings, weights), settings)


def _distinct(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows of bins, and which of them each row is."""
    sizes = codes.max(axis=0, initial=0).astype(object) + 1
    if math.prod(sizes) >= 1 << 62:
        distinct, which = np.unique(codes, axis=0, return_inverse=True)
        return distinct, which.ravel()
    key = np.zeros(len(codes), np.int64)
    for i, size in enumerate(sizes):
        key = key * int(size) + codes[:, i]
    _, first, which = np.unique(key, return_index=True, return_inverse=True)
    return codes[first], which


def _shares(trees: Sequence[Tree], codes: np.ndarray) -> np.ndarray:
    """Sum of the leaf shares over the trees; equal rows are looked up once."""
    distinct, which = _distinct(codes)
    total_ = np.zeros(len(distinct))
    for tree in trees:
        total_ += tree.share[reached(tree, distinct)]
    return total_[which]


def forest_scores(model: Forest, df: DataFrame, score_col: str = "score") -> DataFrame:
    """``df`` with the mean tree probability of class 1 and the more probable class.

    A row that misses a predictor has neither.
    """
    shared = df.sparkSession.sparkContext.broadcast(([np.asarray(cut) for cut in model.cuts], model.trees))

    def score(*columns: pa.Array) -> pa.Array:
        cuts, trees = shared.value
        values = np.stack([np.asarray(column.fill_null(np.nan), np.float64) for column in columns], 1)
        known = ~np.isnan(values).any(axis=1)
        codes = np.stack([np.searchsorted(cut, values[:, i]) for i, cut in enumerate(cuts)], 1)
        return pa.array(_shares(trees, codes) / max(len(trees), 1), pa.float64(), mask=~known)

    inputs = [F.col(quoted(name)).cast("double") for name in model.features]
    scored = df.withColumn(score_col, F.arrow_udf(score, "double")(*inputs))
    return scored.withColumn("prediction", (F.col(quoted(score_col)) > 0.5).cast("int"))


def forest_importance(model: Forest) -> DataFrame:
    """Share of the impurity decrease per predictor, largest first."""
    pairs = zip(model.features, gains(model.trees, len(model.features)).tolist())
    rows = sorted(pairs, key=lambda row: (-row[1], row[0]))
    return SparkSession.active().createDataFrame(rows, "feature string, importance double")


def stratified_folds(df: DataFrame, target: str, folds: int, out: str = "fold") -> DataFrame:
    """Add a fold number so that every fold holds an equal share of every class, give or take a row.

    Rows are dealt out class by class.  They are stored first with their partition and place,
    which fixes their order; each partition is then numbered on its own, starting after the
    rows of its class in earlier partitions, so no class is ever gathered in one task.
    """
    placed = stored(
        df.withColumns({"_part": F.spark_partition_id(), "_pos": F.monotonically_increasing_id()})
    )
    # One row per partition and class; both grow with the data, so Spark chooses the join.
    counts = placed.groupBy("_part", target).agg(F.count(F.lit(1)).alias("_rows"))
    earlier = (
        Window.partitionBy(target).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = counts.select(
        F.col("_part").alias("_in"), F.col(quoted(target)).alias("_class"),
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_start"),
    )
    inside = Window.partitionBy("_part", target).orderBy("_pos")
    same = (F.col("_part") == F.col("_in")) & F.col(quoted(target)).eqNullSafe(F.col("_class"))
    numbered = placed.join(starts, same).withColumn(
        out, ((F.col("_start") + F.row_number().over(inside) - 1) % folds).cast("int")
    )
    return numbered.select(*map(quoted, df.columns), out)


_HITS = pa.schema([("point", pa.int32()), ("fold", pa.int32()), ("tp", pa.int64()), ("fp", pa.int64()), ("fn", pa.int64())])
_HITS_TYPES = "point int, fold int, tp long, fp long, fn long"


def _hits(rows: Rows, held: np.ndarray, trees: Sequence[Tree], places: Sequence[tuple[int, Settings, int]]) -> list[tuple]:
    """(point, tp, fp, fn) of points (number, settings, trees) that one run of trees serves, on the rows ``held``."""
    used = np.flatnonzero(held > 0)
    codes, label, times = rows.codes[used], rows.label[used], held[used]
    (distinct, which), out = _distinct(codes), []
    for depth, split in sorted({(settings.depth, settings.min_split) for _, settings, _ in places}):
        wanted = {n: point for point, settings, n in places if (settings.depth, settings.min_split) == (depth, split)}
        total_ = np.zeros(len(distinct))
        for n, tree in enumerate(trees, 1):
            total_ += tree.share[reached(tree, distinct, depth, split)]
            if n in wanted:
                positive = (total_ / n > 0.5)[which]
                sums = [int(times[mask].sum()) for mask in (positive & (label == 1), positive & (label == 0), ~positive & (label == 1))]
                out.append((wanted[n], *sums))
    return out


def _family(settings: Settings) -> Settings:
    """What trees must have in common: all but depth and least rows to split, at which any tree can be cut."""
    return replace(settings, depth=0, min_split=0)


def tune_forest(
    train: DataFrame,
    features: Sequence[str],
    target: str,
    grid: Mapping[str, Sequence],
    folds: int = 5,
) -> tuple[Forest, DataFrame]:
    """Try every combination of ``grid`` by cross-validated F1 of class 1.

    Returns the best model, fitted again on all rows, and one row per combination with
    mean and spread of F1.  Class weights are balanced anew within each fold.  A run of trees serves all points
    that differ in the number of trees, the depth and the least rows to split only: its first trees, cut where
    the point says so, are the trees of that point.  Points that come to the same forest share it.
    """
    names = sorted(grid)
    points = [dict(zip(names, values)) for values in product(*(grid[name] for name in names))]
    made = [_settings(point, len(features)) for point in points]
    bins = {b for _, _, b in made}
    if len(bins) > 1:
        raise ValueError("the bins of predictors cannot be searched")
    same: dict[tuple, int] = {}
    for i, (settings, trees, _) in enumerate(made):
        same.setdefault((settings, trees), i)
    families: dict[Settings, list[tuple[int, Settings, int]]] = {}
    for (settings, trees), i in same.items():
        families.setdefault(_family(settings), []).append((i, settings, trees))
    # The shallowest cuts come from the deepest trees.
    specs = [
        (fold, replace(family, depth=max(s.depth for _, s, _ in places), min_split=min(s.min_split for _, s, _ in places)), places)
        for family, places in families.items() for fold in range(folds)
    ]
    specs.sort(key=lambda spec: -spec[1].tried)  # the longest first

    used = train.select(*map(quoted, [*features, target])).filter(F.col(quoted(target)).isNotNull())
    merged = _merge(stratified_folds(used, target, folds, out="_fold"), features, target, bins.pop(), None, folds)
    rows_of = merged.class_rows()
    weights = [_class_weights(rows_of[0] - rows_of[1 + fold]) for fold in range(folds)]
    if merged.table.count() <= TASK_ROWS:
        found = _tune_in_tasks(merged, specs, weights)
    else:
        found = [hit for spec in specs for hit in _tune_by_levels(merged, *spec, weights[spec[0]])]
    scores: dict[int, list[float]] = {}
    for point, _, tp, fp, fn in sorted(found):
        scores.setdefault(point, []).append(2 * tp / (2 * tp + fp + fn) if tp else 0.0)
    place = [same[settings, trees] for settings, trees, _ in made]
    best = max(range(len(points)), key=lambda i: np.mean(scores[place[i]]))
    rows = [
        (
            ", ".join(f"{key}={value}" for key, value in point.items()),
            float(np.mean(scores[place[i]])), float(np.std(scores[place[i]])), i == best,
        )
        for i, point in enumerate(points)
    ]
    table = train.sparkSession.createDataFrame(
        rows, "parameters string, mean_f1 double, std_f1 double, best boolean"
    )
    return _fit(merged, made[best][1], made[best][0]), table


def _tune_in_tasks(merged: _Merged, specs: list[tuple], weights: list[tuple[float, float]]) -> list[tuple]:
    features, bins = len(merged.features), merged.bins

    def work(table: pa.Table, spec: tuple) -> list:
        fold, settings, places = spec
        rows = _rows(table, features, fold)
        trees = [grown(rows, t, SEED, settings, bins, weights[fold]) for t in range(max(n for _, _, n in places))]
        hits = _hits(rows, np.asarray(table.column(f"n{fold}"), np.int64), trees, places)
        return list(zip(*[(point, fold, *sums) for point, *sums in hits]))

    return [tuple(row) for row in _in_tasks(merged, specs, len(specs), work, _HITS_TYPES, _HITS).collect()]


def _tune_by_levels(merged: _Merged, fold: int, settings: Settings, places: list, weights: tuple[float, float]) -> list[tuple]:
    features = len(merged.features)
    trees = merged.table.sparkSession.sparkContext.broadcast(
        _grow_by_levels(merged, max(n for _, _, n in places), settings, weights, fold)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = _hits(_rows(batch, features, fold), np.asarray(batch.column(f"n{fold}"), np.int64), trees.value, places)
            columns = zip(*[(point, fold, *sums) for point, *sums in hits])
            yield pa.RecordBatch.from_arrays([pa.array(c, field.type) for c, field in zip(columns, _HITS)], schema=_HITS)

    found = merged.table.mapInArrow(run, _HITS_TYPES).groupBy("point", "fold").agg(*(F.sum(n).alias(n) for n in ("tp", "fp", "fn")))
    return [tuple(row) for row in found.collect()]
