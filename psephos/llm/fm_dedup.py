"""Removal of repeated passages by FM-indexes, one per shard.

A window of ``WINDOW`` words is removed from a document if it also starts in one with a smaller id.
Windows are routed by content: of the short n-grams in a window, the one with the smallest
hash is its anchor, so equal windows have the same anchor, and neighbouring windows mostly share one.
A run of windows with one anchor is a segment.  Equal segments form a class, named by
its smallest id; only classes of anchors that occur in two documents go on, one
representative each, to the shard of their anchor.

A shard indexes its segments as sequences of ``STRIDE``-word symbols, one sequence per phase: a
Burrows-Wheeler transform under a wavelet matrix.  The windows of every segment are then streamed
by backward search, and the length to which each still matches a document with a smaller id is its
matching statistic; runs of windows whose statistic reaches the threshold are reported.

An anchor with more than ``CLASSES`` classes, such as the edge of a passage that many documents
share, is not indexed: its windows are grouped one by one by their hash instead, which is exact
as well and leaves no large group.

Defined cases: a null or short text loses nothing; a document without id counts as having the
largest; rows with equal ids do not remove each other's words; windows are judged on the input.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from psephos.llm.packed import packed, unpacked
from psephos.llm.tables import by_block, columns, place
from psephos.llm.text import Texts, Words, _power_tables, covered, mixed, word_streams
from psephos.sources import stored

WINDOW = 50
STRIDE = 10
ANCHOR = 8
#: Windows in a segment at most.
RUN = WINDOW - ANCHOR + 1
CLASSES = 2000
SHARD_WORDS = 400_000

_U = np.uint64
NO_ID = (1 << 63) - 1


# ---------------------------------------------------------------- the index


class WaveletMatrix:
    """Ranks of symbols in a sequence: one row of packed bits per bit of a symbol."""

    def __init__(self, values: np.ndarray, symbols: int) -> None:
        self.levels = range(max(int(symbols - 1).bit_length(), 1) - 1, -1, -1)
        self.words, self.ones, self.zeros = [], [], []
        for level in self.levels:
            bits = (values >> level) & 1
            padded = np.zeros(len(bits) // 64 * 64 + 64, np.uint8)
            padded[: len(bits)] = bits
            words = np.packbits(padded, bitorder="little").view(np.uint64)
            self.words.append(words)
            self.ones.append(np.append(0, np.cumsum(np.bitwise_count(words), dtype=np.int64))[:-1].astype(np.int32))
            self.zeros.append(int(len(bits) - bits.sum()))
            values = np.concatenate([values[bits == 0], values[bits == 1]])
        self.origin = self._trace(np.arange(symbols), np.zeros(symbols, np.int64))

    def _trace(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        for level, words, ones, zeros in zip(self.levels, self.words, self.ones, self.zeros, strict=True):
            word = place >> 6
            mask = (_U(1) << (place & 63).astype(np.uint64)) - _U(1)
            before = ones[word] + np.bitwise_count(words[word] & mask)
            place = np.where((symbol >> level) & 1, zeros + before, place - before)
        return place

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before its place."""
        return self._trace(symbol, place) - self.origin[symbol]


class FMIndex:
    """Backward search over a sequence of symbols; 0 parts strings and is in no pattern.

    Suffixes are sorted by their first ``depth`` symbols at least, which is all that patterns of up to
    ``depth`` symbols need.
    """

    def __init__(self, sequence: np.ndarray, symbols: int, depth: int) -> None:
        rank, reach = sequence.astype(np.int64), 1
        while reach < depth:
            later = np.zeros(len(rank), np.int64)
            later[:-reach] = rank[reach:] + 1
            pair = rank * (int(rank.max(initial=0)) + 2) + later
            _, rank = np.unique(pair, return_inverse=True)
            reach *= 2
        self.suffixes = np.argsort(rank, kind="stable")
        self.before = WaveletMatrix(sequence[self.suffixes - 1], symbols)
        self.smaller = np.append(0, np.cumsum(np.bincount(sequence, minlength=symbols)))[:-1]
        self.length = len(sequence)

    def extended(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix ranges of patterns with a symbol put before each."""
        first = self.smaller[symbol]
        return first + self.before.rank(symbol, low), first + self.before.rank(symbol, high)


def repeated_windows(segments: list[np.ndarray], owners: np.ndarray, window: int, stride: int) -> list[np.ndarray]:
    """For each segment of word hashes, which of its windows occur in a segment of a smaller owner.

    One FM-index over all segments; every window of a segment is a pattern.
    """
    steps = window // stride
    sizes = np.array([len(x) for x in segments])
    words = np.concatenate(segments)
    grams = np.zeros(len(words), np.uint64)
    for j in range(stride):
        grams[: len(words) - j] = grams[: len(words) - j] * _U(0xD1342543DE82EF95) + words[j:]
    starts = np.append(0, np.cumsum(sizes))
    segment = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(words)) - starts[segment]
    real = place <= sizes[segment] - stride  # starts of symbols
    segment, place = segment[real], place[real]
    _, symbol = np.unique(mixed(grams[real]), return_inverse=True)
    symbol += 1

    # Each phase of each segment is a string of symbols that follow each other.
    string = segment * stride + place % stride
    order = np.lexsort((place, string))
    ends = np.append(string[order][1:] != string[order][:-1], True)
    at = np.arange(len(order)) + np.append(0, np.cumsum(ends)[:-1])
    sequence = np.zeros(len(order) + int(ends.sum()), np.int64)
    sequence[at] = symbol[order]
    owner_at = np.full(len(sequence), NO_ID)
    owner_at[at] = owners[segment[order]]
    where = np.empty(len(order), np.int64)
    where[order] = at  # of each symbol, its place in the sequence

    index = FMIndex(sequence, int(symbol.max()) + 1, steps)
    owner_by_suffix = np.append(owner_at[index.suffixes], NO_ID)
    query = np.flatnonzero(place <= sizes[segment] - window)
    own = owners[segment[query]]
    low, high = np.zeros(len(query), np.int64), np.full(len(query), index.length)
    matched = np.zeros(len(query), np.int64)  # the matching statistic, in words
    live = np.arange(len(query))
    for step in range(steps - 1, -1, -1):
        symbols = sequence[where[query[live]] + step]
        low[live], high[live] = index.extended(symbols, low[live], high[live])
        # A pattern that only its own document holds cannot come to match a smaller one.
        bounds, inverse = np.unique(low[live] * (index.length + 1) + high[live], return_inverse=True)
        pairs = np.stack([bounds // (index.length + 1), bounds % (index.length + 1)], axis=1).ravel()
        least = np.minimum.reduceat(owner_by_suffix, pairs)[::2][inverse] if len(pairs) else np.zeros(0, np.int64)
        live = live[least < own[live]]
        matched[live] += stride
    out = [np.zeros(max(n - window + 1, 0), bool) for n in sizes]
    hit = np.flatnonzero(matched >= window)
    for s, p in zip(segment[query[hit]].tolist(), place[query[hit]].tolist(), strict=True):
        out[s][p] = True
    return out


# ---------------------------------------------------------------- segments


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of ``width`` values from each place on; what passes the end is left out."""
    reach = 1
    while reach * 2 <= width:
        values = np.minimum(values, np.append(values[reach:], np.repeat(values[-1:], reach))[: len(values)])
        reach *= 2
    rest = width - reach
    return np.minimum(values, np.append(values[rest:], np.repeat(values[-1:], rest))[: len(values)]) if rest else values


def spans_hashed(hashes: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """A hash of the words from each low to each high."""
    up, down = _power_tables(len(hashes) + 1)
    sums = np.append(_U(0), np.cumsum(hashes * up[:-1]))
    return mixed((sums[high] - sums[low]) * down[low] + (high - low).astype(np.uint64))


def segments(words: Words, hashes: np.ndarray) -> dict[str, np.ndarray]:
    """Runs of windows with one anchor: text, anchor, seg (hash of the words), low and n (windows)."""
    at, _ = words.windows(WINDOW, hashes)
    if not len(at):
        return {name: np.zeros(0, np.int64) for name in ("text", "anchor", "seg", "low", "n")}
    gram = np.full(len(hashes), np.iinfo(np.uint64).max, np.uint64)
    places, values = words.windows(ANCHOR, hashes)
    gram[places] = values
    anchor = sliding_least(gram, RUN)[at]
    owner = words.text_of_each()[at]
    new = np.append(True, (at[1:] != at[:-1] + 1) | (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1]))
    first = np.flatnonzero(new)
    place = np.arange(len(at)) - first[np.cumsum(new) - 1]
    first = np.flatnonzero(place % RUN == 0)
    n = np.diff(np.append(first, len(at)))
    low = at[first]
    seg = spans_hashed(hashes, low, low + n + WINDOW - 1)
    text = owner[first]
    return {"text": text, "anchor": anchor[first].view(np.int64), "seg": seg.view(np.int64), "low": low - words.bounds[text], "n": n}


SCAN = pa.schema([
    ("id", pa.int64()), ("place", pa.int64()), ("n_words", pa.int64()), ("sha256", pa.string()),
    ("anchor", pa.int64()), ("seg", pa.int64()), ("low", pa.int32()), ("n", pa.int32()),
])


def scanned(docs: DataFrame) -> DataFrame:
    """One scan of ``docs`` (id, place, text): a row per document, with n_words, and one per segment."""

    def work(block: pa.RecordBatch) -> pa.RecordBatch:
        texts = Texts(block.column("text"))
        data, bounds, counts = word_streams(texts)
        words = texts.words()
        found = segments(words, words.hashes())
        sha = [hashlib.sha256(data[s : e - 1].tobytes()).hexdigest() for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        ids, places = np.asarray(block.column("id")), np.asarray(block.column("place"))
        n, k = len(texts), len(found["text"])
        whole = columns(
            SCAN, id=ids, place=places, n_words=counts, sha256=sha,
            anchor=pa.nulls(n), seg=pa.nulls(n), low=pa.nulls(n), n=pa.nulls(n),
        )
        parts = columns(
            SCAN, id=ids[found["text"]], place=places[found["text"]], n_words=pa.nulls(k), sha256=pa.nulls(k),
            anchor=found["anchor"], seg=found["seg"], low=found["low"], n=found["n"],
        )
        return pa.Table.from_batches([whole, parts]).combine_chunks().to_batches()[0]

    return by_block(docs, "text", "id long, place long, n_words long, sha256 string, anchor long, seg long, low int, n int", work)


def segment_words(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(anchor, seg, first, classes, words) of each class of ``wanted`` (id, place, anchor, seg, low, n, classes)."""
    items = F.collect_list(F.struct("anchor", "seg", "low", "n", "classes")).alias("items")
    # Rows that are equal in id and text give the same words; the index takes them as one.
    rows = docs.join(wanted.groupBy("id", "place").agg(items), ["id", "place"])
    schema = pa.schema([
        ("anchor", pa.int64()), ("seg", pa.int64()), ("first", pa.int64()), ("classes", pa.int64()), ("words", pa.binary()),
    ])

    def work(block: pa.RecordBatch) -> pa.RecordBatch:
        words = Texts(block.column("text")).words()
        hashes = words.hashes()
        items = block.column("items")
        sizes = np.diff(np.asarray(items.offsets))
        flat = items.flatten()
        row = np.repeat(np.arange(block.num_rows), sizes)
        low = np.asarray(flat.field("low")).astype(np.int64) + words.bounds[row]
        length = np.asarray(flat.field("n")).astype(np.int64) + WINDOW - 1
        bounds = np.append(0, np.cumsum(length))
        at = np.arange(bounds[-1]) - np.repeat(bounds[:-1] - low, length)
        return columns(
            schema, anchor=flat.field("anchor"), seg=flat.field("seg"), first=np.asarray(block.column("id"))[row],
            classes=flat.field("classes"), words=packed(hashes[at], bounds),
        )

    return by_block(rows, "text", "anchor long, seg long, first long, classes long, words binary", work)


RANGES = "anchor long, seg long, ranges array<struct<low:int,high:int>>"


def runs_of(flags: np.ndarray) -> list[dict[str, int]]:
    """Maximal runs of set flags, ends exclusive."""
    steps = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [{"low": int(s), "high": int(e)} for s, e in zip(steps[::2], steps[1::2], strict=True)]


def search_shard(table: pa.Table) -> pa.Table:
    """The ranges of windows of each class of one shard that a smaller document holds as well."""
    table = table.sort_by([("anchor", "ascending"), ("seg", "ascending")])
    keys = list(zip(table.column("anchor").to_pylist(), table.column("seg").to_pylist(), strict=True))
    once = [i for i, key in enumerate(keys) if i == 0 or key != keys[i - 1]]
    table = table.take(pa.array(once)).combine_chunks()
    words, sizes = unpacked(pa.concat_arrays(table.column("words").chunks), "<u8")
    parts = np.split(words, np.cumsum(sizes)[:-1])
    found = [runs_of(x) for x in repeated_windows(parts, table.column("first").to_numpy(), WINDOW, STRIDE)]
    kind = pa.list_(pa.struct([("low", pa.int32()), ("high", pa.int32())]))
    out = pa.table({"anchor": table.column("anchor"), "seg": table.column("seg"), "ranges": pa.array(found, kind)})
    return out.filter(pa.array([bool(x) for x in found], pa.bool_()))


def search_windows(words: DataFrame) -> DataFrame:
    """The same for segments of crowded anchors, window by window."""
    schema = pa.schema([("anchor", pa.int64()), ("seg", pa.int64()), ("first", pa.int64()), ("at", pa.int32()), ("hash", pa.int64()), ("more", pa.int64())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            flat, sizes = unpacked(batch.column("words"), "<u8")
            starts = np.cumsum(sizes) - sizes
            n = sizes - WINDOW + 1
            row = np.repeat(np.arange(len(sizes)), n)
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            low = starts[row] + at
            yield columns(
                schema, anchor=batch.column("anchor").take(pa.array(row)), seg=batch.column("seg").take(pa.array(row)),
                first=batch.column("first").take(pa.array(row)), at=at,
                hash=spans_hashed(flat, low, low + WINDOW).view(np.int64),
                more=spans_hashed(mixed(flat), low, low + WINDOW).view(np.int64),
            )

    windows = stored(words.mapInArrow(cut, "anchor long, seg long, first long, at int, hash long, more long"))
    least = windows.groupBy("hash", "more").agg(F.min("first").alias("least"), F.max("first").alias("last")).filter("least < last")
    hits = windows.join(stored(least), ["hash", "more"]).filter("least < first")
    return hits.groupBy("anchor", "seg").agg(
        F.sort_array(F.collect_set(F.struct(F.col("at").alias("low"), (F.col("at") + 1).alias("high")))).alias("ranges")
    )


def removed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_words, n_removed, kept_sha256) of every row; the kept words are joined by one blank."""
    docs = docs.select(
        F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("id"), place(text).alias("place"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    found = stored(scanned(docs))
    wholes = found.filter("anchor is null").select("id", "place", "n_words", "sha256")
    parts = found.filter("anchor is not null").select("id", "place", "anchor", "seg", "low", "n")
    classes = stored(
        parts.groupBy("anchor", "seg").agg(F.min(F.struct("id", "place", "low", "n")).alias("best"), F.max("id").alias("last"))
        .select("anchor", "seg", "best.*", "last")
    )
    anchors = classes.groupBy("anchor").agg(
        F.count(F.lit(1)).alias("classes"), F.min("id").alias("least"), F.max("last").alias("most")
    ).filter("least < most")
    shared = stored(classes.join(stored(anchors), "anchor").drop("least", "most"))
    several = shared.filter("classes > 1").select("id", "place", "anchor", "seg", "low", "n", "classes")

    fetched = stored(segment_words(docs, several))
    plain = fetched.filter(F.col("classes") <= CLASSES)
    total = plain.agg(F.sum(F.length("words"))).first()[0] or 0
    shards = max(1, -(-total // (8 * SHARD_WORDS)))
    indexed = plain.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards))).groupBy("shard")
    by_index = indexed.applyInArrow(lambda table: search_shard(table.select(["anchor", "seg", "first", "words"])), RANGES)
    crowded = search_windows(fetched.filter(F.col("classes") > CLASSES))
    ranges = stored(by_index.unionByName(crowded))

    known = stored(shared.select("anchor", "seg", F.col("id").alias("first"), "last").join(ranges, ["anchor", "seg"], "left")
                   .filter("first < last or ranges is not null"))
    hits = parts.join(known, ["anchor", "seg"]).select(
        "id", "place",
        F.when(F.col("first") < F.col("id"), F.array(F.struct(F.lit(0).alias("low"), F.col("n").alias("high"))))
        .otherwise(F.col("ranges")).alias("ranges"), F.col("low").alias("start"),
    ).filter("ranges is not null")
    hits = hits.select("id", "place", F.explode("ranges").alias("r"), "start").select(
        "id", "place", F.struct((F.col("start") + F.col("r.low")).alias("low"), (F.col("start") + F.col("r.high")).alias("high")).alias("r")
    )
    cuts = stored(hits.groupBy("id", "place").agg(F.collect_set("r").alias("cuts")))
    own = F.when(F.col("id") != NO_ID, F.col("id")).alias("id")
    schema = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])

    def work(block: pa.RecordBatch) -> pa.RecordBatch:
        texts = Texts(block.column("text"))
        words = texts.words()
        items = block.column("cuts")
        row = np.repeat(np.arange(block.num_rows), np.diff(np.asarray(items.offsets)))
        flat = items.flatten()
        low, high = (np.asarray(flat.field(name)).astype(np.int64) + words.bounds[row] for name in ("low", "high"))
        n = high - low
        starts = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - low, n)
        gone = covered(starts, WINDOW, len(words))
        sha, counts = [], []
        for i in range(block.num_rows):
            a, b = words.bounds[i], words.bounds[i + 1]
            at = np.flatnonzero(~gone[a:b]) + a
            kept = b" ".join(texts.data[s:e].tobytes() for s, e in zip(words.starts[at].tolist(), words.ends[at].tolist(), strict=True))
            sha.append(hashlib.sha256(kept).hexdigest())
            counts.append(int(gone[a:b].sum()))
        return columns(schema, id=block.column("id"), n_words=words.counts, n_removed=counts, kept_sha256=sha)

    changed = by_block(docs.join(cuts, ["id", "place"]), "text", "id long, n_words long, n_removed long, kept_sha256 string", work)
    keys = cuts.select("id", "place")
    same = wholes.join(keys, ["id", "place"], "left_anti")
    same = same.select("id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("sha256").alias("kept_sha256"))
    return changed.unionByName(same).select(own, "n_words", "n_removed", "kept_sha256")
