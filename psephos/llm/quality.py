"""A quality score by Bradley-Terry ranking of labelled documents.

Each pair of a document labelled good and one labelled bad is a preference.  The model gives a
document the weighted sum of its rates, and the weights maximise the likelihood that the
preferred document of each pair wins, which is logistic loss on differences of
features.  The threshold is the quantile of the training scores that best parts the labels;
scores are shifted so that it lies at ``CUT``, and squeezed into 0 to 1.

Fitting (:func:`learn`) reads every labelled row and ranks all pairs of them.  The loss of a pair depends on its two
strengths alone, so each Newton step puts the rows of either class on a grid of strengths, where a grid point holds the
number of its rows and the sum of their features; a row is shared among its four nearest points by cubic interpolation,
which keeps all sums over pairs to about nine digits.  Medians and the quantiles behind the threshold are exact.  The
driver gets the grid and a matrix of features, never rows.  :func:`fit_ranking` does the same to arrays, pair by pair.

Defined cases: a null text is an empty one and is scored; rows without a
label of either kind are not learnt from; several labels of one id count by their
mean; without both labels every score is 0.5.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from psephos.llm.features import RATES, rates_of
from psephos.llm.tables import by_block, columns, place
from psephos.llm.text import Texts
from psephos.operators.quantiles import medians
from psephos.operators.running import running_totals
from psephos.sources import stored

SAMPLE = 20_000
BLOCK = 1 << 21  # pairs worked on at a time
CUT = 0.3
STEP = 1 / 64  # of the grid of strengths
POINTS = 4096  # of the grid on either side of 0, at most


#: Quantiles of the strengths that are tried as thresholds.
CUTS = np.linspace(0.002, 0.998, 499)


@dataclass
class Ranking:
    """Weights on standardised rates, and the score at which the threshold lies."""

    center: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float

    def strength(self, x: np.ndarray) -> np.ndarray:
        """The Bradley-Terry strength of each row of rates."""
        return expanded(x, self.center, self.scale) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """Between 0 and 1; ``CUT`` at the threshold."""
        if not self.weights.any():
            return np.full(len(x), 0.5)
        shifted = np.clip(self.strength(x) - self.threshold + np.log(CUT / (1 - CUT)), -30, 30)
        return 1 / (1 + np.exp(-shifted))


def expanded(x: np.ndarray, center: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Standardised rates and their distance from the usual value."""
    z = np.clip((x - center) / scale, -6, 6)
    return np.concatenate([z, np.abs(z)], axis=1)


def rank_pairs(preferred: np.ndarray, others: np.ndarray | None = None, penalty: float = 1e-3, rounds: int = 30) -> np.ndarray:
    """Weights of least logistic loss on the differences of all pairs (preferred minus other), by Newton steps.

    Without ``others`` the differences are given.  Only sums over pairs are kept, block by block.
    """
    k = preferred.shape[1]
    others = np.zeros((1, k)) if others is None else others
    n = len(preferred) * len(others)
    w, size = np.zeros(k), max(1, BLOCK // len(others))
    for _ in range(rounds):
        strength, against = preferred @ w, others @ w
        gradient, curve, cross = np.zeros(k), np.zeros((k, k)), np.zeros((k, k))
        lost_by, spread_by = np.zeros(len(others)), np.zeros(len(others))
        for i in range(0, len(preferred), size):
            rows = preferred[i : i + size]
            lost = 1 / (1 + np.exp(np.clip(strength[i : i + size, None] - against, -30, 30)))
            gradient += rows.T @ lost.sum(axis=1)
            lost_by += lost.sum(axis=0)
            lost *= 1 - lost
            curve += (rows * lost.sum(axis=1)[:, None]).T @ rows
            spread_by += lost.sum(axis=0)
            cross += rows.T @ (lost @ others)
        gradient = (gradient - others.T @ lost_by) / n - penalty * w
        curve = (curve + (others * spread_by[:, None]).T @ others - cross - cross.T) / n + penalty * np.eye(k)
        step = np.linalg.solve(curve, gradient)
        w += step / max(1.0, np.abs(step).max())
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit_ranking(x: np.ndarray, good: np.ndarray) -> Ranking:
    """Learn from arrays of rates and labels, which :func:`learn` does for tables of any size."""
    if not len(x) or good.all() or not good.any():
        return Ranking(np.zeros(len(RATES)), np.ones(len(RATES)), np.zeros(2 * len(RATES)), 0.0)
    # Centred on good documents, so that the distances say how unusual a text is among them.
    center, scale = np.median(x[good], axis=0), x[good].std(axis=0) + 1e-6
    z = expanded(x, center, scale)
    weights = rank_pairs(z[good], z[~good])
    strength = z @ weights
    cuts = np.quantile(strength, CUTS)
    kept = strength[:, None] >= cuts
    balanced = kept[good].mean(axis=0) + (~kept[~good]).mean(axis=0)
    best = np.flatnonzero(balanced == balanced.max())
    return Ranking(center, scale, weights, float(cuts[best].mean()))


def sampled(rows: DataFrame, key: Column, size: int) -> DataFrame:
    """About ``size`` rows, by a hash of the key; all rows where there are no more."""
    total = rows.count()
    share = min(1.0, size / max(total, 1))
    return rows.filter(F.pmod(F.xxhash64(F.lit(11), key), F.lit(1_000_000)) < F.lit(int(np.ceil(share * 1_000_000))))


def copies_sampled(groups: DataFrame, keys: list[str], size: int) -> DataFrame:
    """``groups`` with the ``copies`` of each in a sample of about ``size`` rows, if any.

    ``groups`` has one row per ``keys`` and ``n``, its number of rows; it is read twice and should be a stored one.
    """
    total = groups.agg(F.sum("n").alias("n")).first()["n"] or 0
    share = min(1.0, size / max(total, 1))
    chance = F.pmod(F.xxhash64(F.lit(11), *keys), F.lit(1_000_000)) / F.lit(1_000_000)
    return groups.withColumn("copies", F.floor(F.col("n") * F.lit(share) + chance).cast("long")).filter("copies > 0").drop("n")


def training_rates(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Rates and labels of a sample of the labelled rows; ``docs`` (id, text), ``labels`` (id, label)."""
    known = labels.filter("id is not null and label is not null").groupBy("id").agg((F.avg("label") >= 0.5).alias("good"))
    placed = docs.select("id", "text", place("text").alias("place"))
    groups = placed.groupBy("id", "place").agg(F.count(F.lit(1)).alias("n")).join(known, "id")
    chosen = F.broadcast(copies_sampled(stored(groups), ["id", "place"], SAMPLE))  # about SAMPLE rows
    schema = pa.schema([("good", pa.bool_()), ("copies", pa.int64()), ("rates", pa.list_(pa.float64()))])

    def work(block: pa.RecordBatch) -> pa.RecordBatch:
        return columns(
            schema, good=block.column("good"), copies=block.column("copies"), rates=list(rates_of(Texts(block.column("text"))))
        )

    texts = placed.join(chosen, ["id", "place"]).dropDuplicates(["id", "place"])
    rows = by_block(texts.select("good", "copies", "text"), "text", "good boolean, copies long, rates array<double>", work).collect()
    copies = np.array([row["copies"] for row in rows], np.int64)
    x = np.array([row["rates"] for row in rows]).reshape(-1, len(RATES))
    return np.repeat(x, copies, axis=0), np.repeat(np.array([row["good"] for row in rows], bool), copies)


def labelled_rates(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(good, rates) of every row of ``docs`` (id, text) that ``labels`` (id, label) has a label for, stored."""
    known = labels.filter("id is not null and label is not null").groupBy("id").agg((F.avg("label") >= 0.5).alias("good"))
    schema = pa.schema([("id", pa.int64()), ("rates", pa.list_(pa.float64()))])

    def work(block: pa.RecordBatch) -> pa.RecordBatch:
        return columns(schema, id=block.column("id"), rates=list(rates_of(Texts(block.column("text")))))

    # Rates are small, so that no text is shuffled for the join.
    rated = by_block(docs.filter("id is not null").select("id", "text"), "text", "id long, rates array<double>", work)
    return stored(rated.join(known, "id").select("good", "rates"))


def _of_batch(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Rates and labels of a batch of (good, rates)."""
    return np.asarray(batch.column("rates").flatten()).reshape(-1, len(RATES)), np.asarray(batch.column("good").to_numpy(zero_copy_only=False), bool)


def _on_grid(rows: DataFrame, model: Ranking, step: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per class (bad, good): the strengths of the grid points, and the number of rows and sums of features at each."""
    width = 1 + len(model.weights)
    names = [f"s{i}" for i in range(width)]
    schema = pa.schema([("good", pa.bool_()), ("point", pa.int64()), *((name, pa.float64()) for name in names)])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, good = _of_batch(batch)
            z = np.concatenate([np.ones((len(x), 1)), expanded(x, model.center, model.scale)], axis=1)
            at = z[:, 1:] @ model.weights / step
            below = np.floor(at).astype(np.int64)
            t = at - below
            shares = (-t * (t - 1) * (t - 2) / 6, (t + 1) * (t - 1) * (t - 2) / 2, -(t + 1) * t * (t - 2) / 2, (t + 1) * t * (t - 1) / 6)
            for label in (False, True):
                own = np.flatnonzero(good == label)
                if not len(own):
                    continue
                points, place = np.unique(np.concatenate([below[own] + i for i in (-1, 0, 1, 2)]), return_inverse=True)
                parts = np.concatenate([share[own, None] * z[own] for share in shares])
                cells = [np.bincount(place, parts[:, i], len(points)) for i in range(width)]
                yield columns(schema, good=np.full(len(points), label), point=points, **dict(zip(names, cells)))

    types = "good boolean, point long, " + ", ".join(f"{name} double" for name in names)
    found = rows.mapInArrow(sums, types).groupBy("good", "point").agg(*[F.sum(name).alias(name) for name in names]).orderBy("point").toArrow()
    label = np.asarray(found.column("good").to_numpy(zero_copy_only=False), bool)
    point = np.asarray(found.column("point")) * step
    values = np.stack([np.asarray(found.column(name)) for name in names], axis=1)
    return [(point[label == own], values[label == own]) for own in (False, True)]


def _squares(rows: DataFrame, model: Ranking, spreads: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The products of features summed over all rows, each times the spread of its class (bad, good) at its strength."""
    k = len(model.weights)
    i, j = np.triu_indices(k)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros((k, k))
        for batch in batches:
            x, good = _of_batch(batch)
            z = expanded(x, model.center, model.scale)
            at = z @ model.weights
            spread = np.where(good, np.interp(at, *spreads[1]), np.interp(at, *spreads[0]))
            own += z.T @ (z * spread[:, None])
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(own[i, j])], ["i", "j", "p"])

    found = rows.mapInArrow(products, "i long, j long, p double").groupBy("i", "j").agg(F.sum("p").alias("p")).collect()
    matrix = np.zeros((k, k))
    for row in found:
        matrix[row["i"], row["j"]] = matrix[row["j"], row["i"]] = row["p"]
    return matrix


def rank_rows(rows: DataFrame, center: np.ndarray, scale: np.ndarray, penalty: float = 1e-3, rounds: int = 30) -> np.ndarray:
    """The weights of :func:`rank_pairs` on all pairs of the good and the bad rows of ``rows`` (good, rates)."""
    w = np.zeros(2 * len(RATES))
    for _ in range(rounds):
        model = Ranking(center, scale, w, 0.0)
        step = max(STEP, 6 * np.abs(w).sum() / POINTS)  # features lie within 6
        (bad, others), (good, preferred) = _on_grid(rows, model, step)
        n = others[:, 0].sum() * preferred[:, 0].sum()
        gradient, cross = np.zeros(len(w)), np.zeros((len(w), len(w)))
        spread_good, spread_bad = np.zeros(len(good)), np.zeros(len(bad))
        size = max(1, BLOCK // len(bad))
        for i in range(0, len(good), size):
            part = preferred[i : i + size]
            lost = 1 / (1 + np.exp(np.clip(good[i : i + size, None] - bad, -30, 30)))
            gradient += part[:, 1:].T @ (lost @ others[:, 0]) - others[:, 1:].T @ (part[:, 0] @ lost)
            lost *= 1 - lost
            spread_good[i : i + size] = lost @ others[:, 0]
            spread_bad += part[:, 0] @ lost
            cross += part[:, 1:].T @ (lost @ others[:, 1:])
        gradient = gradient / n - penalty * w
        curve = (_squares(rows, model, [(bad, spread_bad), (good, spread_good)]) - cross - cross.T) / n + penalty * np.eye(len(w))
        change = np.linalg.solve(curve, gradient)
        w = w + change / max(1.0, np.abs(change).max())
        if np.abs(change).max() < 1e-6:
            break
    return w


def best_threshold(strengths: DataFrame) -> float:
    """The mean of those quantiles of ``strengths`` (good, strength) that part the classes best."""
    counted = strengths.groupBy("strength").agg(F.count(F.lit(1)).alias("n"), F.count_if("good").alias("hits"))
    totals = stored(running_totals(counted, "strength", ["n", "hits"]))
    every, hits = totals.agg(F.sum("n"), F.sum("hits")).first()
    place = CUTS * (every - 1)
    low = np.floor(place).astype(np.int64)
    wanted = np.unique(np.concatenate([low, np.minimum(low + 1, every - 1)]))

    def holding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            upto = np.asarray(batch.column("cum_n"))
            before = upto - np.asarray(batch.column("n"))
            yield batch.filter(pa.array(np.searchsorted(wanted, before) < np.searchsorted(wanted, upto)))

    rows = totals.mapInArrow(holding, totals.schema).orderBy("strength").toArrow()  # two a quantile at most
    value, n, own, upto, own_upto = (np.asarray(rows.column(name)) for name in ("strength", "n", "hits", "cum_n", "cum_hits"))
    at, after = np.searchsorted(upto, low, side="right"), np.searchsorted(upto, np.minimum(low + 1, every - 1), side="right")
    cuts = value[at] + (value[after] - value[at]) * (place - low)
    # A row at the cut is kept.
    below, hits_below = np.where(cuts > value[at], (upto[at], own_upto[at]), (upto[at] - n[at], own_upto[at] - own[at]))
    balanced = (hits - hits_below) / hits + (below - hits_below) / (every - hits)
    return float(cuts[np.flatnonzero(balanced == balanced.max())].mean())


def learn(docs: DataFrame, labels: DataFrame) -> Ranking:
    """The ranking learnt from every row of ``docs`` (id, text) that ``labels`` (id, label) has a label for."""
    rows = labelled_rates(docs, labels)
    if rows.select("good").distinct().count() < 2:
        return Ranking(np.zeros(len(RATES)), np.ones(len(RATES)), np.zeros(2 * len(RATES)), 0.0)
    # Centred on good documents, so that the distances say how unusual a text is among them.
    liked = rows.filter("good").select(F.posexplode("rates").alias("place", "value"))
    liked = liked.select(F.col("place").cast("string").alias("variable"), "value")
    middle = medians(liked)
    spread = {row["variable"]: row["spread"] for row in liked.groupBy("variable").agg(F.stddev_pop("value").alias("spread")).collect()}
    center, scale = (np.array([found[str(i)] for i in range(len(RATES))]) for found in (middle, spread))
    scale = scale + 1e-6
    model = Ranking(center, scale, rank_rows(rows, center, scale), 0.0)
    schema = pa.schema([("good", pa.bool_()), ("strength", pa.float64())])

    def strengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield columns(schema, good=batch.column("good"), strength=model.strength(_of_batch(batch)[0]))

    model.threshold = best_threshold(stored(rows.mapInArrow(strengths, "good boolean, strength double")))
    return model


def quality_scores(docs: DataFrame, model: Ranking) -> DataFrame:
    """(id, score) of every row of ``docs`` (id, text)."""
    schema = pa.schema([("id", pa.int64()), ("score", pa.float64())])

    def work(block: pa.RecordBatch) -> pa.RecordBatch:
        return columns(schema, id=block.column("id"), score=model.score(rates_of(Texts(block.column("text")))))

    return by_block(docs.select("id", "text"), "text", "id long, score double", work)


def accepted(docs: DataFrame, model: Ranking, text: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that score at least ``CUT``."""

    def work(block: pa.RecordBatch) -> pa.RecordBatch:
        return block.filter(pa.array(model.score(rates_of(Texts(block.column(text)))) >= CUT))

    return by_block(docs, text, docs.schema, work)
