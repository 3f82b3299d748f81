"""Words, hashes and windows of whole batches of texts, computed on their UTF-8 bytes.

Texts arrive as Arrow columns and are handled as one byte array with offsets, so that a task
spends no Python step per word.  Blocks of a few megabytes bound the memory; a text longer than
a block is a block of its own and is hashed piece by piece.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20
_PIECE = 1 << 18  # words hashed at a time

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
WORD = np.zeros(256, bool)  # digits, letters and everything beyond ASCII
WORD[0x30:0x3A] = WORD[0x41:0x5B] = WORD[0x61:0x7B] = WORD[0x80:] = True

_U = np.uint64
_table = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASE = _U(0x9E3779B97F4A7C15)
_INVERSE = _U(pow(int(_BASE), -1, 2**64))
_GRAM = _U(0xD1342543DE82EF95)
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse, modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        up, down = np.full(size, _BASE), np.full(size, _INVERSE)
        up[0] = down[0] = 1
        _powers[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _powers[0][:n], _powers[1][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """Each 64-bit number scrambled, one to one."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def blocks(batch: pa.RecordBatch, column: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of ``batch`` in runs of at most ``limit`` bytes of text, or of one row."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    row = 0
    while row < len(ends):
        before = ends[row - 1] if row else 0
        upto = max(int(np.searchsorted(ends, before + limit, side="right")), row + 1)
        yield batch.slice(row, upto - row)
        row = upto


class Texts:
    """The texts of one block: ``data`` holds their bytes, ``offsets`` where each begins."""

    def __init__(self, column: pa.Array, lower: bool = False) -> None:
        column = pc.fill_null(column.cast(pa.large_string()), "")
        _, at, data = column.buffers()
        n = len(column)
        self.offsets = np.frombuffer(at, np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
        first, last = int(self.offsets[0]), int(self.offsets[-1])
        self.data = np.frombuffer(data, np.uint8, last - first, first) if last > first else np.zeros(0, np.uint8)
        self.offsets = self.offsets - first
        if lower:
            self.data = LOWER[self.data]

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def bytes_of(self, row: int) -> bytes:
        return self.data[self.offsets[row] : self.offsets[row + 1]].tobytes()

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """How many bytes of each text are flagged."""
        return np.diff(np.searchsorted(np.flatnonzero(flags), self.offsets))

    def runs(self, inside: np.ndarray, edges: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the maximal runs of flagged bytes; none crosses an edge."""
        edges = self.offsets if edges is None else edges
        n = len(inside)
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        before[edges[edges < n]] = False
        after[edges[edges > 0] - 1] = False
        return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1

    def words(self, inside: np.ndarray | None = None) -> "Words":
        """Runs of bytes that are no white space, or of those flagged ``inside``."""
        starts, ends = self.runs(~SPACE[self.data] if inside is None else inside)
        return Words(self, starts, ends)

    def lines(self) -> "Words":
        """The pieces between line feeds, empty ones included."""
        feeds = np.flatnonzero(self.data == 10)
        starts = np.sort(np.concatenate([self.offsets[:-1], feeds + 1]), kind="stable")
        ends = np.sort(np.concatenate([feeds, self.offsets[1:]]), kind="stable")
        # A feed that ends one text leaves an empty line there, not in the next text.
        bounds = np.concatenate([[0], np.cumsum(self.per_text(self.data == 10) + 1)])
        return Words(self, starts, ends, bounds)


class Words:
    """Pieces of the texts of a block; ``bounds`` holds the first piece of each text."""

    def __init__(self, texts: Texts, starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray | None = None) -> None:
        self.texts, self.starts, self.ends = texts, starts, ends
        self.bounds = np.searchsorted(starts, texts.offsets) if bounds is None else bounds
        self.counts = np.diff(self.bounds)

    def __len__(self) -> int:
        return len(self.starts)

    def text_of_each(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of the bytes of each piece, the same in every block."""
        out = np.empty(len(self), np.uint64)
        for i in range(0, len(self), _PIECE):
            s, e = self.starts[i : i + _PIECE], self.ends[i : i + _PIECE]
            low, high = int(s.min()), int(e.max())
            up, down = _power_tables(high - low + 1)
            sums = np.zeros(high - low + 1, np.uint64)
            np.cumsum(_table[self.texts.data[low:high]] * up[:-1], out=sums[1:])
            out[i : i + _PIECE] = mixed((sums[e - low] - sums[s - low]) * down[s - low] + (e - s).astype(np.uint64))
        return out

    def windows(self, k: int, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Start and hash of every run of ``k`` pieces that lies in one text."""
        h = self.hashes() if hashes is None else hashes
        n = len(h) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        whole = h[:n].copy()
        for j in range(1, k):
            whole *= _GRAM
            whole += h[j : j + n]
        left = np.repeat(self.bounds[1:], self.counts)[:n] - np.arange(n)  # pieces left in the text
        at = np.flatnonzero(left >= k)
        return at, mixed(whole[at])


def sums_between(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``values`` from each bound to the next."""
    total = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def word_streams(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of each text, a blank after each and a line feed after the last, as bytes.

    With the bounds of the texts and their numbers of words; a text without words is a lone line feed.
    """
    words = texts.words()
    empty = np.flatnonzero(words.counts == 0)
    starts = np.insert(words.starts, words.bounds[empty], 0)
    lengths = np.insert(words.ends - words.starts, words.bounds[empty], -1) + 1
    lengths[lengths == 0] = 1
    counts = np.maximum(words.counts, 1)
    ends = np.cumsum(lengths)
    at = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths - starts, lengths)
    data = texts.data[np.minimum(at, len(texts.data) - 1)] if len(texts.data) else np.zeros(len(at), np.uint8)
    data = data.copy()
    data[ends - 1] = 0x20
    bounds = np.append(0, ends[np.cumsum(counts) - 1]) if len(counts) else np.zeros(1, np.int64)
    data[bounds[1:] - 1] = 0x0A
    return data, bounds, words.counts


def grouped_equal(group: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that puts equal (group, key) pairs together, and which of it begin a new pair."""
    order = np.argsort(mixed(group.astype(np.uint64) * _U(0x632BE59BD9B4E019)) ^ keys)
    g, k = group[order], keys[order]
    new = np.ones(len(order), bool)
    new[1:] = (g[1:] != g[:-1]) | (k[1:] != k[:-1])
    return order, new


def covered(starts: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of ``n`` pieces lie in a window of ``k`` pieces that begins at one of ``starts``."""
    steps = np.bincount(starts, minlength=n + 1) - np.bincount(starts + k, minlength=n + 1)[: n + 1]
    return np.cumsum(steps)[:n] > 0


def statistics(texts: Texts) -> dict[str, np.ndarray]:
    """What rules on quality count in each text; long columns, by name."""
    data, words = texts.data, texts.words()
    n = len(texts)
    spaces = SPACE[data]
    points = (data & 0xC0) != 0x80
    out = {"n_words": words.counts.astype(np.int64), "word_chars": texts.per_text(points & ~spaces)}
    symbols = np.zeros(256, bool)
    symbols[np.frombuffer(b"#*$%&|<>", np.uint8)] = True
    out["n_symbols"] = texts.per_text(symbols[data])

    lines = texts.lines()
    filled = sums_between(~spaces, np.stack([lines.starts, lines.ends], 1).ravel())[::2] > 0 if len(lines) else np.zeros(0, bool)
    at, owner = np.flatnonzero(filled), lines.text_of_each()
    out["n_lines"] = lines.counts.astype(np.int64)
    order, new = grouped_equal(owner[at], lines.hashes()[at])
    out["n_dup_lines"] = np.bincount(owner[at][order][~new], minlength=n).astype(np.int64)

    hashes, owner = words.hashes(), words.text_of_each()
    at, grams = words.windows(5, hashes)
    order, new = grouped_equal(owner[at], grams)
    first = np.flatnonzero(new)
    sizes = np.diff(np.append(first, len(order)))
    again = at[order[np.repeat(sizes > 1, sizes)]]
    out["n_repeat_words"] = sums_between(covered(again, 5, len(words)), words.bounds)
    twice = np.zeros(len(words), bool)
    twice[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    out["n_stutters"] = sums_between(twice, words.bounds)
    order, new = grouped_equal(owner, hashes)
    out["n_distinct"] = np.bincount(owner[order][new], minlength=n).astype(np.int64)

    for name, low, high in (("n_upper", 0x41, 0x5A), ("n_lower", 0x61, 0x7A), ("n_digits", 0x30, 0x39)):
        out[name] = texts.per_text((data >= low) & (data <= high))
    out["n_beyond"] = texts.per_text(data >= 0xC0)
    out["n_marks"] = texts.per_text(~WORD[data] & ~spaces)
    out["n_shouts"] = texts.per_text((data == 0x21) | (data == 0x3F))
    lengths = sums_between(points, np.stack([words.starts, words.ends], 1).ravel())[::2] if len(words) else np.zeros(0, np.int64)
    out["n_short"] = sums_between((lengths <= 2).astype(np.int64), words.bounds)
    out["n_long"] = sums_between((lengths >= 15).astype(np.int64), words.bounds)
    return out
