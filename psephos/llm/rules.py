"""Quality rules: counts of every text, two fixed rules, and an isolation forest on the rates.

A tree splits a small sample at random values of random rates until its rows stand alone; texts
that few splits isolate are anomalous.  The path length, averaged over trees, gives a score in 0..1,
and the score above which texts are rejected is calibrated on labelled rows.

The forest is fitted on about ``TREES * LEAVES`` rows, chosen by a hash; counts, scores and the
calibration cover all rows.  Defined cases: a null or empty text has counts of 0 and fails
the fixed rules; without labels of both kinds the forest rejects nothing; rows
with equal ids are judged each by its own text.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from psephos.llm.features import RULE_RATES, rates
from psephos.llm.quality import copies_sampled
from psephos.llm.tables import by_block, columns
from psephos.llm.text import Texts, statistics
from psephos.sources import stored

TREES = 200
LEAVES = 256
#: Steps of the score between 0 and 1 at which the calibration looks.
STEPS = 1000
#: Largest share of good labelled rows that the calibration may reject.
LOSS = 0.05

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def base_failed() -> Column:
    """Too short, or more than a fifth of the words in repeated windows."""
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def document_rates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, the counts, rates) of every row."""
    fields = [("id", pa.int64()), *((name, pa.int64()) for name in COUNTS), ("rates", pa.list_(pa.float64()))]
    schema = pa.schema(fields)

    def work(block: pa.RecordBatch) -> pa.RecordBatch:
        counts = statistics(Texts(block.column("text")))
        return columns(schema, id=block.column("id"), rates=list(rates(counts)[:, : len(RULE_RATES)]), **{name: counts[name] for name in COUNTS})

    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    return by_block(rows, "text", "id long, " + "".join(f"{name} long, " for name in COUNTS) + "rates array<double>", work)


def usual_path(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search in a binary tree of ``n`` rows."""
    n = np.asarray(n, float)
    many = 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / np.maximum(n, 1)
    return np.where(n > 2, many, np.where(n == 2, 1.0, 0.0))


@dataclass
class Tree:
    """Nodes by number: the rate that splits it (-1 in a leaf), where, its children, and its path."""

    rate: np.ndarray
    at: np.ndarray
    left: np.ndarray
    right: np.ndarray
    path: np.ndarray

    def paths(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        rows = np.arange(len(x))
        while True:
            rate = self.rate[node]
            if (rate < 0).all():
                return self.path[node]
            lower = x[rows, np.maximum(rate, 0)] < self.at[node]
            node = np.where(rate < 0, node, np.where(lower, self.left[node], self.right[node]))


def grow(x: np.ndarray, draw: np.random.Generator, depth: int) -> Tree:
    nodes: list[list[float]] = []

    def add(rows: np.ndarray, level: int) -> int:
        me = len(nodes)
        nodes.append([-1, 0.0, 0, 0, level + float(usual_path(len(rows)))])
        low, high = x[rows].min(axis=0), x[rows].max(axis=0)
        varied = np.flatnonzero(high > low)
        if level < depth and len(rows) > 1 and len(varied):
            rate = int(draw.choice(varied))
            at = float(draw.uniform(low[rate], high[rate]))
            lower = x[rows, rate] < at
            if lower.any() and not lower.all():
                nodes[me][:4] = [rate, at, add(rows[lower], level + 1), add(rows[~lower], level + 1)]
        return me

    add(np.arange(len(x)), 0)
    table = np.array(nodes)
    return Tree(table[:, 0].astype(int), table[:, 1], table[:, 2].astype(int), table[:, 3].astype(int), table[:, 4])


@dataclass
class IsolationForest:
    trees: list[Tree]
    leaves: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Towards 1 for rows that few splits isolate."""
        if not self.trees:
            return np.zeros(len(x))
        mean = sum(tree.paths(x) for tree in self.trees) / len(self.trees)
        return 2.0 ** (-mean / max(float(usual_path(self.leaves)), 1e-9))


def fit_forest(x: np.ndarray, seed: int = 7, trees: int = TREES, leaves: int = LEAVES) -> IsolationForest:
    draw = np.random.default_rng(seed)
    size = min(leaves, len(x))
    if size < 2:
        return IsolationForest([], leaves)
    depth = int(np.ceil(np.log2(size)))
    return IsolationForest([grow(x[draw.choice(len(x), size, replace=False)], draw, depth) for _ in range(trees)], size)


def scored(rows: DataFrame, forest: IsolationForest) -> DataFrame:
    """``rows`` of ``document_rates`` with the forest's ``anomaly`` in place of the rates."""
    schema = pa.schema([("id", pa.int64()), *((name, pa.int64()) for name in COUNTS), ("anomaly", pa.float64())])

    def run(batches):
        for batch in batches:
            x = np.asarray(batch.column("rates").flatten()).reshape(-1, len(RULE_RATES))
            values = {name: batch.column(name) for name in ("id", *COUNTS)}
            yield columns(schema, anomaly=forest.score(x), **values)

    return rows.mapInArrow(run, "id long, " + "".join(f"{name} long, " for name in COUNTS) + "anomaly double")


def calibrated(scores: DataFrame, labels: DataFrame, loss: float = LOSS) -> float:
    """The highest score that is kept.

    Among the thresholds that reject at most ``loss`` of the good labelled rows, the one that
    best parts good from bad.  Only counts by step of the score come to the driver.
    """
    known = labels.filter("id is not null and label is not null").groupBy("id").agg((F.avg("label") >= 0.5).alias("good"))
    judged = scores.filter(~base_failed()).select("id", F.floor(F.col("anomaly") * STEPS).cast("int").alias("step"))
    counts = judged.join(known, "id").groupBy("step").agg(
        F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad")
    ).collect()
    good, bad = np.zeros(STEPS + 1), np.zeros(STEPS + 1)
    for row in counts:
        good[row["step"]], bad[row["step"]] = row["good"], row["bad"]
    if not good.sum() or not bad.sum():
        return 1.0
    lost, caught = 1 - np.cumsum(good) / good.sum(), 1 - np.cumsum(bad) / bad.sum()
    worth = np.where(lost <= loss, caught - lost, -1.0)
    return float((np.flatnonzero(worth == worth.max())[-1] + 1) / STEPS)


def judge(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: int = 7) -> DataFrame:
    """(id, the counts, base_failed, anomaly, kept) of every row; ``labels`` has id and label."""
    rows = stored(document_rates(docs, doc_id, text))
    passed = rows.filter(~base_failed()).select("id", "rates", F.xxhash64("id", "rates").alias("key"))
    groups = stored(passed.groupBy("key").agg(F.count(F.lit(1)).alias("n")))
    chosen = F.broadcast(copies_sampled(groups, ["key"], TREES * LEAVES))  # rows alike in id and rates are counted only
    sample = passed.join(chosen, "key").groupBy("key").agg(*(F.first(name).alias(name) for name in ("id", "rates", "copies"))).collect()
    sample.sort(key=lambda row: (row["id"] is None, row["id"], row["rates"]))
    x = np.array([row["rates"] for row in sample]).reshape(-1, len(RULE_RATES))
    forest = fit_forest(np.repeat(x, np.array([row["copies"] for row in sample], np.int64), axis=0), seed)
    scores = stored(scored(rows, forest))
    most = calibrated(scores, labels)
    verdict = ~F.col("base_failed") & (F.col("anomaly") < F.lit(most))
    return scores.withColumn("base_failed", base_failed()).withColumn("kept", verdict)
