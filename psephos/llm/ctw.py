"""Context-tree weighting of byte contexts, trained on a corpus and used to score its texts.

A text is the sequence of its lower-case words, one blank after each and a line feed after the last.
Every byte is coded as eight binary decisions, and each decision has a context tree over the
``DEPTH`` bytes before it.  A node holds the Krichevsky-Trofimov estimate of its decisions, and
its weighted probability is the mean of that estimate and of the product of its children; so
all depths are mixed by how well they describe the training texts.  A byte's code length
mixes the estimates along its context with these weights, down to the deepest context seen.

The counts of the tree are kept as (context, byte) codes.  Blocks of documents send their distinct codes
to the owner of the last three context bytes, which never has more than 2**24 codes; the sums
over trees shrink to 256 x 255 nodes at depth 1, the only ones that come to the driver.  Each
block then gets the code lengths of its own codes, so that no task holds the model.

Defined cases: a null or empty text is a lone line feed; equal ids are separate rows; a null id
belongs to the training texts; without training texts every decision costs one bit.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from psephos.llm.packed import answers, key_bounds, merged, packed, summed, unpacked
from psephos.llm.tables import columns
from psephos.llm.text import SPACE, Texts, Words, blocks, sums_between, word_streams
from psephos.sources import stored

DEPTH = 5
#: Bytes of text that share one request for code lengths.
BLOCK = 32 << 20
_STEP = 1 << 20
_CHUNK = 1 << 16
_U = np.uint64
_LOG2 = float(np.log(2))

BLOCKS = pa.schema([
    ("kind", pa.int32()), ("block", pa.int64()), ("id", pa.int64()), ("held_out", pa.bool_()), ("stream", pa.binary()),
    ("n_tokens", pa.int64()), ("key", pa.int64()), ("codes", pa.binary()), ("sums", pa.binary()),
])
TEXT, GRAMS, WORDS = 0, 1, 2


# ---------------------------------------------------------------- texts as codes


def context_codes(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each byte: its context, the nearest byte highest, and the byte itself lowest."""
    n = len(data)
    padded = np.concatenate([np.full(DEPTH, 0x0A, np.uint8), data])
    codes = np.empty(n, np.uint64)
    shifts = [_U(8 * (DEPTH - d + 1)) for d in range(1, DEPTH + 1)]
    for i in range(0, n, _CHUNK):
        j = min(i + _CHUNK, n)
        part = padded[i + DEPTH : j + DEPTH].astype(np.uint64)
        for d, shift in enumerate(shifts, 1):
            part |= padded[i + DEPTH - d : j + DEPTH - d].astype(np.uint64) << shift
        codes[i:j] = part
    # The first bytes of a text have line feeds before them, not the text before.
    for k in range(DEPTH):
        at = bounds[:-1][np.diff(bounds) > k] + k
        for shift in shifts[k:]:
            codes[at] = codes[at] & ~(_U(0xFF) << shift) | (_U(0x0A) << shift)
    return codes


def counted(codes: np.ndarray, learnt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in order, and how often each is among those learnt."""
    mine = np.sort(codes[learnt])
    first = np.flatnonzero(np.append(True, mine[1:] != mine[:-1])) if len(mine) else np.zeros(0, np.int64)
    others = np.sort(codes[~learnt])
    others = others[np.append(True, others[1:] != others[:-1])] if len(others) else others
    times = np.diff(np.append(first, len(mine))).astype(np.float64)
    return summed(np.concatenate([mine[first], others]), np.concatenate([times, np.zeros(len(others))]))


def looked_up(table: np.ndarray, values: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The value of each code; codes are looked up in order, piece by piece, as that is far faster."""
    out = np.empty(len(codes))
    for i in range(0, len(codes), _CHUNK):
        part = codes[i : i + _CHUNK]
        # A code has 48 bits, which leaves 16 for its place in the piece.
        order = np.sort(part << _U(16) | np.arange(len(part), dtype=np.uint64))
        out[i + (order & _U(0xFFFF)).astype(np.int64)] = values[np.searchsorted(table, order >> _U(16))]
    return out


def stream_words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of byte sequences, and how many words each sequence has."""
    texts = Texts.__new__(Texts)
    texts.data, texts.offsets = data, bounds
    starts, ends = texts.runs(~SPACE[data])
    words = Words(texts, starts, ends)
    return words.hashes(), words.counts


def blocked(docs: DataFrame) -> DataFrame:
    """One scan of ``docs`` (id, held_out, text): the texts by block, and each block's distinct codes.

    Codes come with how often the training texts of the block hold them, which may be 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        grams: list[tuple[np.ndarray, np.ndarray]] = []
        words: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def close() -> Iterator[pa.RecordBatch]:
            for kind, parts, shift in ((GRAMS, grams, 24), (WORDS, words, 52)):
                if parts:
                    codes, sums = summed(*(np.concatenate(x) for x in zip(*parts, strict=True)))
                    keys = (codes >> _U(shift)).astype(np.int64)
                    bounds = key_bounds(keys)
                    k = len(bounds) - 1
                    none = pa.nulls(k)
                    yield columns(
                        BLOCKS, kind=np.full(k, kind), block=np.full(k, number), id=none, held_out=none, stream=none, n_tokens=none,
                        key=keys[bounds[:-1]], codes=packed(codes, bounds), sums=packed(sums, bounds),
                    )

        for batch in batches:
            for part in blocks(batch, "text", _STEP):
                data, bounds, counts = word_streams(Texts(part.column("text"), lower=True))
                if size and size + len(data) > BLOCK:
                    yield from close()
                    number, size, grams, words = number + 1, 0, [], []
                size += len(data)
                held = np.asarray(part.column("held_out").to_pylist(), bool)
                grams.append(counted(context_codes(data, bounds), np.repeat(~held, np.diff(bounds))))
                hashes, own = stream_words(data, bounds)
                words.append(counted(hashes, np.repeat(~held, own)))
                n = part.num_rows
                none = pa.nulls(n)
                yield columns(
                    BLOCKS, kind=np.full(n, TEXT), block=np.full(n, number), id=part.column("id"), held_out=held,
                    stream=packed(data, bounds), n_tokens=counts + 1, key=none, codes=none, sums=none,
                )
        yield from close()

    return docs.select("id", "held_out", "text").mapInArrow(
        run,
        "kind int, block long, id long, held_out boolean, stream binary, n_tokens long, key long, codes binary, sums binary",
    )


# ---------------------------------------------------------------- the tree


def log_gamma(z: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function for z >= 0.5, by Stirling's series at z + 8."""
    product = np.ones_like(z)
    for i in range(8):
        product = product * (z + i)
    y = z + 8
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series - np.log(product)


def estimate(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log probability that Krichevsky and Trofimov give to any sequence with these counts."""
    return log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - log_gamma(n0 + n1 + 1) - np.log(np.pi)


def weighted(own: np.ndarray, children: np.ndarray) -> np.ndarray:
    """Log of the mean of a node's estimate and the product of its children."""
    return np.logaddexp(own, children) - _LOG2


def decisions(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The node among a byte's decisions (1 to 255) and the decision, for the eight of each code."""
    x = (codes & _U(255)).astype(np.int64)
    j = np.arange(8)[:, None]
    return (1 << j) | (x >> (8 - j)), (x >> (7 - j)) & 1


class Levels:
    """The nodes of depths 3 to ``DEPTH`` over sorted codes with counts."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray) -> None:
        self.node, self.bit = decisions(codes)
        weight = np.broadcast_to(counts, self.node.shape).ravel()
        ones = self.bit.ravel() * weight
        self.index: dict[int, np.ndarray] = {}
        self.n0: dict[int, np.ndarray] = {}
        self.n1: dict[int, np.ndarray] = {}
        self.own: dict[int, np.ndarray] = {}
        self.all: dict[int, np.ndarray] = {}
        self.first: dict[int, np.ndarray] = {}
        for depth in range(DEPTH, 2, -1):
            context = codes >> _U(8 * (DEPTH - depth + 1))
            dense = np.cumsum(np.append(0, context[1:] != context[:-1])) if len(codes) else np.zeros(0, np.int64)
            _, first, index = np.unique((dense * 256 + self.node).ravel(), return_index=True, return_inverse=True)
            total = np.bincount(index, weight, len(first))
            n1 = np.bincount(index, ones, len(first))
            self.index[depth], self.first[depth], self.n0[depth], self.n1[depth] = index, first, total - n1, n1
            self.own[depth] = self.all[depth] = estimate(total - n1, n1)
            if depth < DEPTH:
                parent = np.empty(len(self.all[depth + 1]), np.int64)
                parent[self.index[depth + 1]] = index
                self.all[depth] = weighted(self.own[depth], np.bincount(parent, self.all[depth + 1], len(first)))

    def lengths(self, left: np.ndarray, sure: np.ndarray, rate: np.ndarray) -> np.ndarray:
        """Log10 probability of each code's byte.

        For each decision come, from depth 2: the weight left for deeper contexts, the probability of a 1
        that is settled, and the estimate of the deepest context so far.
        """
        left, sure, rate = left.copy(), sure.copy(), rate.copy()
        for depth in range(3, DEPTH + 1):
            n0, n1 = (x[depth][self.index[depth]] for x in (self.n0, self.n1))
            weight = np.exp(self.own[depth] - _LOG2 - self.all[depth])[self.index[depth]] if depth < DEPTH else 1.0
            left, sure, rate = descend(left, sure, rate, n0, n1, weight)
        one = sure + left * rate
        return np.log10(np.where(self.bit.ravel() == 1, one, 1 - one)).reshape(self.bit.shape).sum(axis=0)


def descend(left, sure, rate, n0, n1, weight):
    """One step down the context: an unseen context ends the path at the one above it."""
    seen = n0 + n1 > 0
    own = (n1 + 0.5) / (n0 + n1 + 1)
    sure = np.where(seen, sure + left * weight * own, sure + left * rate)
    left = np.where(seen, left * (1 - weight), 0.0)
    return left, sure, np.where(seen, own, rate)


def leaves_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From merged rows of codes to the nodes of depth 3: (context of two bytes, node, counts, weighted)."""
    schema = pa.schema([("two", pa.int64()), ("node", pa.int64()), ("n0", pa.float64()), ("n1", pa.float64()), ("log", pa.float64())])
    for batch in batches:
        for part in blocks(batch, "codes", 8 << 20):
            codes, _ = unpacked(part.column("codes"), "<u8")
            counts, _ = unpacked(part.column("sums"), "<f8")
            levels = Levels(codes, counts)
            first = levels.first[3]
            two = (codes[first % len(codes)] >> _U(32)).astype(np.int64)
            yield columns(schema, two=two, node=levels.node.ravel()[first], n0=levels.n0[3], n1=levels.n1[3], log=levels.all[3])


def with_estimates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of depth 2 with their own estimate and weighted probability."""
    for batch in batches:
        n0, n1, children = (np.asarray(batch.column(name)) for name in ("n0", "n1", "children"))
        own = estimate(n0, n1)
        values = [batch.column("two"), batch.column("node"), n0, n1, own, weighted(own, children)]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in values], names=["two", "node", "n0", "n1", "own", "log"])


def top_of_tree(nodes: list) -> np.ndarray:
    """From the summed nodes of depth 1 (one, node, n0, n1, children): what depth 2 is given.

    An array by byte and node of weight left, probability settled, and rate.
    """
    n0, n1, children = (np.zeros((256, 256)) for _ in range(3))
    for row in nodes:
        n0[row["one"], row["node"]], n1[row["one"], row["node"]] = row["n0"], row["n1"]
        children[row["one"], row["node"]] = row["children"]
    own = estimate(n0, n1)
    log = weighted(own, children)
    root0, root1 = n0.sum(axis=0), n1.sum(axis=0)
    root = estimate(root0, root1)
    weight = np.exp(root - _LOG2 - weighted(root, log.sum(axis=0)))
    start = np.ones(256), np.zeros(256), np.full(256, 0.5)
    state = [np.broadcast_to(x, (256, 256)) for x in descend(*start, root0, root1, weight)]
    return np.stack(descend(*state, n0, n1, np.exp(own - _LOG2 - log)))


def code_lengths(counts: DataFrame) -> DataFrame:
    """(key, codes, found): log10 probability, as 32-bit floats, of every code of the merged ``counts``."""
    depth3 = counts.mapInArrow(leaves_up, "two long, node long, n0 double, n1 double, log double")
    depth2 = depth3.groupBy("two", "node").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("log").alias("children"))
    depth2 = stored(depth2.mapInArrow(with_estimates, "two long, node long, n0 double, n1 double, own double, log double"))
    depth1 = depth2.groupBy(F.shiftright("two", 8).alias("one"), "node").agg(
        F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("log").alias("children")
    )
    top = top_of_tree(depth1.collect())  # at most 256 x 255 rows

    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n0, n1, own, log = (np.asarray(batch.column(name)) for name in ("n0", "n1", "own", "log"))
            two, node = np.asarray(batch.column("two")), np.asarray(batch.column("node"))
            state = descend(*top[:, two >> 8, node], n0, n1, np.exp(own - _LOG2 - log))
            yield pa.RecordBatch.from_arrays(
                [batch.column("two"), batch.column("node"), *(pa.array(x) for x in state)], names=["two", "node", "left", "sure", "rate"]
            )

    above = depth2.mapInArrow(down, "two long, node long, left double, sure double, rate double")
    above = above.groupBy("two").agg(F.collect_list(F.struct("node", "left", "sure", "rate")).alias("above"))  # at most 255

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("key", pa.int64()), ("codes", pa.binary()), ("found", pa.binary())])
        for batch in batches:
            for part in blocks(batch, "codes", 8 << 20):
                codes, lengths = unpacked(part.column("codes"), "<u8")
                counts_, _ = unpacked(part.column("sums"), "<f8")
                levels = Levels(codes, counts_)
                lists = part.column("above")
                sizes = np.diff(np.asarray(lists.offsets))
                flat = lists.flatten()
                row = np.repeat(np.arange(part.num_rows), sizes)
                place = row * 256 + np.asarray(flat.field("node"))
                slot = (np.repeat(np.arange(part.num_rows), lengths) * 256 + levels.node).ravel()
                state = []
                for name in ("left", "sure", "rate"):
                    table = np.zeros(part.num_rows * 256)
                    table[place] = np.asarray(flat.field(name))
                    state.append(table[slot])
                found = levels.lengths(*state).astype("<f4")
                bounds = np.append(0, np.cumsum(lengths))
                yield columns(schema, key=part.column("key"), codes=part.column("codes"), found=packed(found, bounds))

    whole = counts.withColumn("two", F.shiftright("key", 8)).join(above, "two")
    return whole.select("key", "codes", "sums", "above").mapInArrow(finish, "key long, codes binary, found binary")


# ---------------------------------------------------------------- scores


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", held_out: str | None = None) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) of every row.

    Rows whose ``held_out`` column is true are not learnt from.  ``base_score`` is the log10 probability
    of the words and the end under smoothed word counts, ``score`` that of the bytes under the tree.
    """
    flag = F.coalesce(F.col(held_out), F.lit(False)) if held_out else F.lit(False)
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), flag.alias("held_out"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    found = stored(blocked(rows))
    texts = found.filter(F.col("kind") == TEXT).select("block", "id", "held_out", "stream", "n_tokens")
    grams, words = (found.filter(F.col("kind") == kind).select("block", "key", "codes", "sums") for kind in (GRAMS, WORDS))
    head = texts.agg(
        F.countDistinct("block").alias("blocks"), F.count_if(~F.col("held_out")).alias("ends"),
        F.sum(F.when(~F.col("held_out"), F.col("n_tokens")).otherwise(0)).alias("tokens"),
    ).first()
    groups = max(1, round(head["blocks"] ** 0.5 / 4))
    ends, tokens = head["ends"] or 0, head["tokens"] or 0

    gram_counts = stored(merged(grams, groups))
    word_counts = stored(merged(words, groups))
    kinds = word_counts.mapInArrow(known_codes, "n long").agg(F.sum("n")).first()[0] or 0
    total = tokens + kinds + (ends > 0) + 1

    lengths = answers(grams, code_lengths(gram_counts), groups, "<f4").withColumn("kind", F.lit(GRAMS))
    known = answers(words, word_counts.withColumnRenamed("sums", "found"), groups, "<f8").withColumn("kind", F.lit(WORDS))
    schema = pa.schema([
        ("id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
        ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("bits_per_byte", pa.float64()),
    ])

    def finish(mine: pa.Table, served: pa.Table) -> pa.Table:
        served = served.sort_by([("kind", "ascending"), ("key", "ascending")]).combine_chunks()
        kind = np.asarray(served.column("kind").to_numpy())
        values = []
        for number, dtype in ((GRAMS, "<f4"), (WORDS, "<f8")):
            own = served.filter(pa.array(kind == number)).combine_chunks().to_batches()
            values.append(unpacked(own[0].column("found"), dtype)[0].astype(np.float64) if own else np.zeros(0))
        batches = [part for batch in mine.to_batches() for part in blocks(batch, "stream", _STEP)]
        parts = []
        for part in batches:
            data, sizes = unpacked(part.column("stream"), "u1")
            parts.append((part, np.append(0, np.cumsum(sizes)), data))
        # The values come in the order of the block's distinct codes.
        grams_ = distinct(context_codes(data, bounds) for _, bounds, data in parts)
        words_ = distinct(stream_words(data, bounds)[0] for _, bounds, data in parts)
        out = []
        for part, bounds, data in parts:
            whole = sums_between(looked_up(grams_, values[0], context_codes(data, bounds)), bounds)
            hashes, counts = stream_words(data, bounds)
            seen = values[1][np.searchsorted(words_, hashes)]
            at = np.append(0, np.cumsum(counts))
            base = sums_between(np.log10(seen + 1), at) + np.log10(ends + 1) - (counts + 1) * np.log10(total)
            n_known = sums_between((seen > 0).astype(np.int64), at) + int(ends > 0)
            out.append(columns(
                schema, id=part.column("id"), held_out=part.column("held_out"), n_tokens=counts + 1, n_known=n_known,
                train_tokens=np.full(part.num_rows, tokens), base_score=base, score=whole,
                bits_per_byte=-whole / np.log10(2) / np.diff(bounds),
            ))
        return pa.Table.from_batches(out, schema)

    served = lengths.unionByName(known).select("block", "kind", "key", "found")
    return texts.groupBy("block").cogroup(served.groupBy("block")).applyInArrow(
        finish,
        "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double",
    )


def distinct(codes: Iterator[np.ndarray]) -> np.ndarray:
    """The distinct codes of all arrays, in order."""

    def once(x: np.ndarray) -> np.ndarray:
        x = np.sort(x)
        return x[np.append(True, x[1:] != x[:-1])] if len(x) else x

    parts = [once(x) for x in codes]
    return once(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def known_codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sums, _ = unpacked(batch.column("sums"), "<f8")
        yield pa.RecordBatch.from_arrays([pa.array([int((sums > 0).sum())])], names=["n"])
