"""Growing and reading the trees of a forest on merged rows.

Rows are merged into one per combination of binned predictors and class, with a count.  Drawing n equal rows
with replacement gives each tree a Poisson(n) number of them, so the merged rows are bagged by their counts.
The draws and the predictors tried at a node come from hashes of the row, the tree and the path to the node:
they do not depend on how the rows are spread, and a tree cut at a smaller depth, or at nodes with too few
rows, is the tree that these settings would have grown.
"""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, fields

import numpy as np

_U = np.uint64
_GOLDEN = _U(0x9E3779B97F4A7C15)


def scrambled(x: np.ndarray) -> np.ndarray:
    """Each 64-bit number scrambled, one to one."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _uniform(x: np.ndarray) -> np.ndarray:
    """Numbers strictly between 0 and 1 from 64-bit ones."""
    return ((x >> _U(11)).astype(np.float64) + 0.5) / (1 << 53)


def drawn(counts: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """A Poisson number for every mean in ``counts``, fixed by its key.

    Small means by the inverse of the distribution; from 64 on the normal quantile with its
    first two corrections, which is off by less than one row in some thousand draws.
    """
    u = _uniform(scrambled(keys))
    out = np.zeros(len(counts), np.int64)
    small = np.flatnonzero((counts > 0) & (counts < 64))
    mean, left = counts[small].astype(np.float64), u[small]
    chance, k = np.exp(-mean), 0
    while len(small):
        over = left >= chance
        out[small[~over]] = k
        small, mean, left, chance, k = small[over], mean[over], (left - chance)[over], chance[over], k + 1
        chance = chance * mean / k
        if k > 400:  # what rounding has left of the last chances
            out[small] = k
            break
    large = np.flatnonzero(counts >= 64)
    mean = counts[large].astype(np.float64)
    other = _uniform(scrambled(keys[large] + _GOLDEN))
    z = np.sqrt(-2 * np.log(u[large])) * np.cos(2 * np.pi * other)
    value = mean + np.sqrt(mean) * z + (z * z - 1) / 6 + (z - z**3) / (72 * np.sqrt(mean))
    out[large] = np.maximum(np.floor(value + 0.5), 0).astype(np.int64)
    return out


@dataclass(frozen=True)
class Settings:
    """How trees grow: ``tried`` predictors per node, least drawn rows per leaf and to split, limits of gain."""

    depth: int
    tried: int
    min_leaf: int = 1
    min_split: int = 2
    min_gain: float = 0.0
    min_share: float = 0.0


@dataclass
class Rows:
    """Merged rows: a bin per predictor, the class 0 or 1, how many each stands for, and a key."""

    codes: np.ndarray
    label: np.ndarray
    counts: np.ndarray
    keys: np.ndarray

    @staticmethod
    def of(codes: np.ndarray, label: np.ndarray, counts: np.ndarray) -> "Rows":
        keys = label.astype(np.uint64) + _U(1)
        for i in range(codes.shape[1]):
            keys = scrambled(keys * _GOLDEN + codes[:, i].astype(np.uint64))
        return Rows(codes, label.astype(np.int64), counts.astype(np.int64), keys)

    def draw(self, tree: int, seed: int) -> np.ndarray:
        return drawn(self.counts, self.keys + scrambled(np.asarray([tree * 1_000_003 + seed], np.uint64)))


@dataclass
class Tree:
    """Nodes in the order they were made; the right child follows the left one, a leaf has none.

    A row goes left if the bin of ``feature`` is at most ``cut``.  ``rows`` were drawn, ``share`` is that of the
    weight of class 1, ``gain`` the weighted decrease of impurity by the split.
    """

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    depth: np.ndarray
    rows: np.ndarray
    share: np.ndarray
    gain: np.ndarray

    def packed(self) -> list[bytes]:
        return [getattr(self, field.name).tobytes() for field in fields(self)]

    @staticmethod
    def read(parts: Sequence[bytes]) -> "Tree":
        kinds = (np.int32, np.int32, np.int32, np.int32, np.int64, np.float64, np.float64)
        return Tree(*(np.frombuffer(part, kind) for part, kind in zip(parts, kinds, strict=True)))


class Growing:
    """A tree under way: finished nodes, and the open nodes of the last level."""

    def __init__(self, tree: int, seed: int, settings: Settings, bins: int, features: int, weights: tuple[float, float]) -> None:
        self.tree, self.settings, self.bins, self.features = tree, settings, bins, features
        self.weights = np.asarray(weights)
        self.parts: dict[str, list] = {field.name: [] for field in fields(Tree)}
        self.made = 0
        self.open = np.zeros(0, np.int64)  # nodes to split
        self.paths = np.zeros(0, np.uint64)
        self.seed = scrambled(np.asarray([tree * 7_368_787 + seed + 1], np.uint64))
        self.total = 0.0

    def begin(self, sums: np.ndarray) -> None:
        """Make the root from the drawn rows per class."""
        self.total = float(sums @ self.weights)
        self._add(sums[None, :], self.seed, 0)

    def _add(self, sums: np.ndarray, paths: np.ndarray, depth: int) -> None:
        """New nodes with these drawn rows per class, and which of them stay open."""
        weight = sums * self.weights
        whole = weight.sum(axis=1)
        share = np.divide(weight[:, 1], whole, out=np.full(len(whole), 0.5), where=whole > 0)
        n, rows = len(sums), sums.sum(axis=1)
        none = np.full(n, -1, np.int32)
        for name, values in zip(self.parts, (none, none.copy(), none.copy(), np.full(n, depth, np.int32), rows, share, np.zeros(n)), strict=True):
            self.parts[name].append(values)
        pure = (sums == 0).any(axis=1)
        stays = np.flatnonzero(~pure & (rows >= max(self.settings.min_split, 2)) & (depth < self.settings.depth))
        self.open, self.paths = self.made + stays, paths[stays]
        self.sums, self.level = sums[stays], depth
        self.first, self.made = self.made, self.made + n

    def tried(self) -> np.ndarray:
        """The predictors that each open node tries, in order."""
        m = self.settings.tried
        if m >= self.features:
            return np.broadcast_to(np.arange(self.features), (len(self.open), self.features))
        lots = scrambled(self.paths[:, None] + _GOLDEN * np.arange(1, self.features + 1, dtype=np.uint64))
        return np.sort(np.argpartition(lots, m - 1, axis=1)[:, :m], axis=1)

    def histogram(self, rows: Rows, draws: np.ndarray, node: np.ndarray) -> np.ndarray:
        """Drawn rows by open node, predictor tried, bin and class; ``node`` is the open node of each row or -1."""
        used = np.flatnonzero((node >= 0) & (draws > 0))
        tried = self.tried()
        m, at = tried.shape[1], node[used]
        place = (at[:, None] * m + np.arange(m)) * self.bins + rows.codes[used[:, None], tried[at]]
        place = (place * 2 + rows.label[used][:, None]).ravel()
        size = len(self.open) * m * self.bins * 2
        return np.bincount(place, np.repeat(draws[used], m), size).reshape(len(self.open), m, self.bins, 2)

    def best(self, counts: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, ...]:
        """For the open nodes ``of``, from their histogram: predictor, cut, left sums and gain; gain 0 is no split."""
        sums = self.sums[of]
        left = counts.cumsum(axis=2)[:, :, :-1, :]
        right = sums[:, None, None, :] - left
        whole = sums * self.weights

        def impure(w: np.ndarray) -> np.ndarray:
            """Gini impurity times weight."""
            both = w.sum(axis=-1)
            return np.divide(2 * w[..., 0] * w[..., 1], both, out=np.zeros_like(both), where=both > 0)

        lw, rw = left * self.weights, right * self.weights
        gain = impure(whole)[:, None, None] - impure(lw) - impure(rw)
        least = max(self.settings.min_leaf, 1)
        fits = (left.sum(axis=3) >= least) & (right.sum(axis=3) >= least)
        share = self.settings.min_share * self.total
        fits &= (lw.sum(axis=3) >= share) & (rw.sum(axis=3) >= share)
        enough = np.maximum(self.settings.min_gain, 1e-12) * whole.sum(axis=1)
        gain = np.where(fits & (gain > enough[:, None, None]), gain, 0.0)
        flat = gain.reshape(len(of), -1)
        pick = flat.argmax(axis=1) if flat.shape[1] else np.zeros(len(of), np.int64)
        chosen = flat[np.arange(len(of)), pick] if flat.shape[1] else np.zeros(len(of))
        slot, cut = divmod(pick, max(self.bins - 1, 1))
        feature = self.tried()[of][np.arange(len(of)), slot]
        return feature, cut, left[np.arange(len(of)), slot, cut] if flat.shape[1] else sums, chosen

    def split(self, feature: np.ndarray, cut: np.ndarray, left: np.ndarray, gain: np.ndarray) -> np.ndarray:
        """Split the open nodes that gain, and open their children; for each, its place among the split ones or -1."""
        parts = np.flatnonzero(gain > 0)
        inside = self.open[parts] - self.first
        for name, values in (("feature", feature), ("cut", cut), ("gain", gain)):
            self.parts[name][-1][inside] = values[parts]
        self.parts["left"][-1][inside] = self.made + 2 * np.arange(len(parts))
        sums, paths = self.sums[parts], self.paths[parts]
        order = np.full(len(gain), -1)
        order[parts] = np.arange(len(parts))
        if len(parts):
            both = np.stack([left[parts], sums - left[parts]], 1).reshape(-1, 2).astype(np.int64)
            self._add(both, scrambled(np.stack([2 * paths, 2 * paths + _U(1)], 1).ravel()), self.level + 1)
        else:
            self.open = self.open[:0]
        return order

    def finished(self) -> Tree:
        return Tree(*(np.concatenate(self.parts[field.name]) for field in fields(Tree)))


def grown(rows: Rows, tree: int, seed: int, settings: Settings, bins: int, weights: tuple[float, float]) -> Tree:
    """One tree on rows that fit into memory."""
    draws = rows.draw(tree, seed)
    under = Growing(tree, seed, settings, bins, rows.codes.shape[1], weights)
    under.begin(np.bincount(rows.label, draws, 2).astype(np.int64))
    node = np.where(np.isin(0, under.open), 0, -1) + np.zeros(len(draws), np.int64)
    while len(under.open):
        feature, cut, left, gain = under.best(under.histogram(rows, draws, node), np.arange(len(under.open)))
        order = under.split(feature, cut, left, gain)
        stays = np.where(node >= 0, order[node], -1)
        right = rows.codes[np.arange(len(node)), feature[node]] > cut[node]
        child = under.first + 2 * stays + right
        node = np.where(stays >= 0, np.searchsorted(under.open, child), -1)
        if len(under.open):
            held = under.open[np.minimum(node, len(under.open) - 1)] == child
            node = np.where((node >= 0) & held, node, -1)
    return under.finished()


def reached(tree: Tree, codes: np.ndarray, depth: int | None = None, min_split: int = 0) -> np.ndarray:
    """The node at which each row ends, the tree being cut at a depth and at nodes of too few rows."""
    node = np.zeros(len(codes), np.int64)
    inner = (tree.left >= 0) & (tree.rows >= min_split)
    if depth is not None:
        inner &= tree.depth < depth
    going = np.flatnonzero(inner[node])
    while len(going):
        at = node[going]
        node[going] = tree.left[at] + (codes[going, tree.feature[at]] > tree.cut[at])
        going = going[inner[node[going]]]
    return node


def gains(trees: Sequence[Tree], features: int) -> np.ndarray:
    """Share of the impurity decrease per predictor: shares per tree, then over all trees."""
    total = np.zeros(features)
    for tree in trees:
        inner = tree.left >= 0
        own = np.bincount(tree.feature[inner], tree.gain[inner], features)
        if own.sum() > 0:
            total += own / own.sum()
    return total / total.sum() if total.sum() > 0 else total
