"""Ranked lexical search over K2-treaps: quadtrees over a grid of terms and documents.

Documents are cut into shards as they are read.  A shard's grid has a row per term, frequent terms
first, and a column per document, short documents first; the point of a term and a document holds
the impact of the one on the other.  The grid is halved both ways level by level.  Each level keeps four bits
per cell, which of its quarters hold points, and the greatest impact in every such quarter, stored as
what it lies below that of its cell.  A quarter's place in the next level is the number of bits set
before its own, so no pointers are kept.

A query follows the rows of its terms together: a state is a range of documents with one cell per term, and its
bound is the sum of the weighted maxima.  States are opened best bound first, many at a time, until no bound
reaches the score of the last wanted document, so no document that could rank is passed over.  Tasks carry
that score from shard to shard, and hand on their best rows alone.

Terms are told apart by 64-bit hashes.  Defined cases: a null text has no terms; a document
or item without terms has no score; equal scores rank by id, null ids last, and rows of equal id are
ranked each; every row of the items is answered on its own; empty tables give no rows.  Other
columns are not read.
"""
from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from psephos.llm.tables import columns
from psephos.llm.text import WORD, Texts, blocks, grouped_equal
from psephos.sources import stored

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Documents and points at which a shard is closed; one more block of texts may come in.
SHARD_DOCS = 1 << 13
SHARD_POINTS = 1 << 21
#: States opened at a time.
OPENED = 256
#: Terms of the items that are sent to all tasks at once.
ITEM_TERMS = 1 << 20

_U = np.uint64


def impacts(tf: np.ndarray, n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """What ``tf`` occurrences are worth in documents of ``n`` terms, given the totals of the corpus.

    100 - 50 + 50 * n * documents / terms is the length of a document against the mean, in hundredths.
    """
    # Split so that no product passes 64 bits: 50 * documents may meet a document of any length.
    whole, rest = divmod(50 * documents, max(terms, 1))
    length = 50 + n * whole + _product_div(n, rest, max(terms, 1))
    return (1_000_000_000 * tf) // (1000 * tf + 20 * length)


def _product_div(n: np.ndarray, rest: int, by: int) -> np.ndarray:
    """n * rest // by, exactly, for rest < by."""
    if len(n) and int(n.max()) * rest >= 1 << 63:
        return np.asarray([int(x) * rest // by for x in n], np.int64)
    return n * rest // by


def _interleaved(x: np.ndarray) -> np.ndarray:
    """The bits of 32-bit numbers at the even places of 64-bit ones."""
    x = x.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | (x << _U(shift))) & _U(mask)
    return x


def _packed(values: np.ndarray) -> bytes:
    return zlib.compress(values.tobytes(), 1)


class Treap:
    """A quadtree of ``depth`` levels: per level the bits of its cells, their ranks, and the maxima below."""

    def __init__(self, depth: int, bits: list[bytes], drops: list[bytes], top: int) -> None:
        self.depth, self.words, self.ranks, self.maxima = depth, [], [], []
        above = np.asarray([top], np.int64)
        for level in range(depth):
            flags = np.frombuffer(zlib.decompress(bits[level]), np.uint8)
            # One cell more at the end, without quarters, stands for every cell that is not there.
            size = -(-(len(flags) + 8) // 8) * 8
            words = np.concatenate([flags, np.zeros(size - len(flags), np.uint8)]).view("<u8")
            counts = np.bitwise_count(words).astype(np.int64)
            drop = np.frombuffer(zlib.decompress(drops[level]), "<u4").astype(np.int64)
            owner = np.flatnonzero(np.unpackbits(flags, bitorder="little")) >> 2
            own = above[owner] - drop
            self.words.append(words)
            self.ranks.append(np.concatenate([[0], np.cumsum(counts)[:-1]]))
            self.maxima.append(np.append(own, 0))
            above = own

    @staticmethod
    def packed(rows: np.ndarray, cols: np.ndarray, values: np.ndarray) -> dict:
        """The parts of the treap over points in distinct places; ``bits`` and ``drops`` per level."""
        side = int(max(rows.max(initial=0), cols.max(initial=0)))
        depth = max(side.bit_length(), 1)
        code = (_interleaved(rows) << _U(1)) | _interleaved(cols)
        order = np.argsort(code)
        code, values = code[order], values[order].astype(np.int64)
        bits, drops = [], []
        cells, best = code, values  # of the level below, from the points up
        for _ in range(depth):
            up = cells >> _U(2)
            first = np.ones(len(up), bool)
            first[1:] = up[1:] != up[:-1]
            owner = np.cumsum(first) - 1
            starts = np.flatnonzero(first)
            above = np.maximum.reduceat(best, starts) if len(starts) else best[:0]
            flags = np.zeros(4 * len(starts), np.uint8)
            flags[4 * owner + (cells & _U(3)).astype(np.int64)] = 1
            bits.append(_packed(np.packbits(flags, bitorder="little")))
            drops.append(_packed((above[owner] - best).astype("<u4")))
            cells, best = up[starts], above
        return {"depth": depth, "bits": bits[::-1], "drops": drops[::-1], "top": int(best[0]) if len(best) else 0}

    def halves(self, level: int, nodes: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For cells of a level, the left and right quarters on the upper (0) or lower (1) side of each."""
        at = 4 * nodes + 2 * side
        place, shift = at >> 6, (at & 63).astype(np.uint64)
        word = self.words[level][place]
        before = self.ranks[level][place] + np.bitwise_count(word & ((_U(1) << shift) - _U(1)))
        two = word >> shift
        left, right = (two & _U(1)).astype(bool), (two & _U(2)).astype(bool)
        none = len(self.maxima[level]) - 1
        return np.where(left, before, none), np.where(right, before + left, none)

    def best(self, rows: np.ndarray, weights: np.ndarray, n: int, least: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Columns and scores of all documents that score ``least`` and the k-th best score at least."""
        open_: list = [None] * self.depth
        open_[0] = (np.asarray([1 << 62]), np.zeros(1, np.int64), np.zeros((1, len(rows)), np.int64))
        cols, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        while True:
            tops = [(-1 if x is None else int(x[0].max())) for x in open_]
            level = int(np.argmax(tops))
            if tops[level] < max(least, 1):
                return cols, scores
            bounds, spans, nodes = open_[level]
            if len(bounds) > OPENED:
                order = np.argpartition(-bounds, OPENED)
                now, rest = order[:OPENED], order[OPENED:]
                rest = rest[bounds[rest] >= least]
                open_[level] = (bounds[rest], spans[rest], nodes[rest]) if len(rest) else None
                spans, nodes = spans[now], nodes[now]
            else:
                open_[level] = None
            low = (rows >> (self.depth - 1 - level)) & 1
            left, right = self.halves(level, nodes, low)
            nodes = np.concatenate([left, right])
            spans = np.concatenate([2 * spans, 2 * spans + 1])
            bounds = self.maxima[level][nodes] @ weights
            kept = np.flatnonzero((bounds >= max(least, 1)) & (spans << (self.depth - 1 - level) < n))
            if level + 1 == self.depth:
                cols, scores = np.append(cols, spans[kept]), np.append(scores, bounds[kept])
                if len(scores) >= k:
                    least = max(least, int(np.partition(scores, len(scores) - k)[len(scores) - k]))
                    good = scores >= least
                    cols, scores = cols[good], scores[good]
            elif len(kept):
                new = (bounds[kept], spans[kept], nodes[kept])
                old = open_[level + 1]
                open_[level + 1] = new if old is None else tuple(np.concatenate(x) for x in zip(old, new, strict=True))


def corpus_totals(docs: DataFrame) -> tuple[int, int]:
    """How many of ``docs`` (id, text) hold a term, and all their terms."""
    n = F.coalesce(F.regexp_count("text", F.lit(TERM)), F.lit(0)).cast("long")
    row = docs.select(n.alias("n")).agg(F.count(F.when(F.col("n") > 0, 1)).alias("holding"), F.sum("n").alias("terms")).first()
    return int(row["holding"]), int(row["terms"] or 0)


class _Shard:
    """The counts of the documents read so far for one shard."""

    def __init__(self) -> None:
        self.ids: list[pa.Array] = []
        self.sizes, self.owners, self.terms, self.times = [], [], [], []
        self.rows = self.points = 0

    def add(self, block: pa.RecordBatch) -> None:
        texts = Texts(block.column("text"), lower=True)
        words = texts.words(WORD[texts.data])
        hashes, owner = words.hashes(), words.text_of_each()
        order, new = grouped_equal(owner, hashes)
        first = np.flatnonzero(new)
        self.ids.append(block.column("id"))
        self.sizes.append(words.counts.astype(np.int64))
        self.owners.append(owner[order][first] + self.rows)
        self.terms.append(hashes[order][first])
        self.times.append(np.diff(np.append(first, len(order))))
        self.rows += block.num_rows
        self.points += len(first)

    def row(self, schema: pa.Schema, documents: int, terms: int) -> pa.RecordBatch:
        ids, sizes = pa.chunked_array(self.ids, pa.int64()), np.concatenate(self.sizes)
        owners, hashes, times = map(np.concatenate, (self.owners, self.terms, self.times))
        cols = np.argsort(sizes, kind="stable")  # document of each column
        place = np.empty_like(cols)
        place[cols] = np.arange(len(cols))
        distinct, which, counts = np.unique(hashes, return_inverse=True, return_counts=True)
        order = np.lexsort((distinct, -counts))  # term of each row
        at = np.empty_like(order)
        at[order] = np.arange(len(order))
        values = impacts(times.astype(np.int64), sizes[owners], documents, terms)
        treap = Treap.packed(at[which], place[owners], values)
        ids = ids.take(pa.array(cols)).combine_chunks()
        known = np.asarray(ids.is_valid(), bool)
        return columns(
            schema, docs=[self.rows], ids=[_packed(ids.fill_null(0).to_numpy())], known=[_packed(np.packbits(known))],
            terms=[_packed(distinct)], rows=[_packed(at.astype("<u4"))], df=[_packed(counts.astype("<u4"))],
            depth=[treap["depth"]], top=[treap["top"]], bits=[treap["bits"]], drops=[treap["drops"]],
        )


_INDEX = pa.schema([
    ("docs", pa.int64()), ("ids", pa.binary()), ("known", pa.binary()), ("terms", pa.binary()), ("rows", pa.binary()),
    ("df", pa.binary()), ("depth", pa.int32()), ("top", pa.int64()), ("bits", pa.list_(pa.binary())), ("drops", pa.list_(pa.binary())),
])
_INDEX_TYPES = (
    "docs long, ids binary, known binary, terms binary, rows binary, df binary, depth int, top long, "
    "bits array<binary>, drops array<binary>"
)


@dataclass
class Index:
    """Shards of all documents that hold a term, stored, with the totals of the corpus."""

    shards: DataFrame
    documents: int
    terms: int


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Index:
    """Index every term of every row of ``docs``, in one scan after one that counts."""
    docs = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    documents, terms = corpus_totals(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = _Shard()
        for batch in batches:
            for block in blocks(batch, "text"):
                shard.add(block)
                if shard.rows >= SHARD_DOCS or shard.points >= SHARD_POINTS:
                    yield shard.row(_INDEX, documents, terms)
                    shard = _Shard()
        if shard.points:
            yield shard.row(_INDEX, documents, terms)

    return Index(stored(docs.mapInArrow(run, _INDEX_TYPES)), documents, terms)


def item_terms(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """(item, item_id, terms): the distinct hashes of the terms of every row of ``items``, numbered."""
    schema = pa.schema([("item", pa.int64()), ("item_id", pa.int64()), ("terms", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, "text"):
                texts = Texts(block.column("text"), lower=True)
                words = texts.words(WORD[texts.data])
                hashes = words.hashes().view(np.int64)
                terms = [np.unique(hashes[a:b]) for a, b in zip(words.bounds[:-1], words.bounds[1:], strict=True)]
                yield columns(schema, item=block.column("item"), item_id=block.column("item_id"), terms=terms)

    rows = items.select(F.monotonically_increasing_id().alias("item"), F.col(item_id).cast("long").alias("item_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "item long, item_id long, terms array<long>")


def weights(index: Index, terms: np.ndarray) -> np.ndarray:
    """The weight of each of the sorted ``terms``; about ``ITEM_TERMS`` of them, so they may travel."""
    shared = index.shards.sparkSession.sparkContext.broadcast(terms)
    schema = pa.schema([("term", pa.int64()), ("df", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(shared.value), np.int64)
        for batch in batches:
            for own, df in zip(batch.column("terms").to_pylist(), batch.column("df").to_pylist(), strict=True):
                found, at = _found(np.frombuffer(zlib.decompress(own), _U), shared.value)
                total[found] += np.frombuffer(zlib.decompress(df), "<u4")[at].astype(np.int64)
        held = np.flatnonzero(total)
        yield columns(schema, term=held, df=total[held])

    counted = index.shards.select("terms", "df").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * index.documents + 2) / (2 * F.col("df") + 1)))
    found = counted.select("term", weight.cast("long").alias("weight")).toArrow()
    out = np.zeros(len(terms), np.int64)
    out[np.asarray(found.column("term"))] = np.asarray(found.column("weight"))
    return out


def _found(own: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``wanted`` the sorted ``own`` holds, and where."""
    at = np.searchsorted(own, wanted)
    hit = np.flatnonzero(at < len(own))
    hit = hit[own[at[hit]] == wanted[hit]]
    return hit, at[hit]


def _ranked(ids: np.ndarray, known: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """The places of the k best: highest score, then smallest id, null ids last."""
    return np.lexsort((ids, ~known, -scores))[:k]


def _answers(index: Index, items: pa.Table, k: int) -> DataFrame:
    """(item, item_id, doc_id, score): for each task, its best k documents of every item."""
    spark = index.shards.sparkSession
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in items.column("terms").to_pylist()], dtype=np.int64)])
    flat = [x for row in items.column("terms").to_pylist() for x in row]
    terms, which = np.unique(np.asarray(flat, np.int64).view(np.uint64), return_inverse=True)
    numbers, names = items.column("item").to_pylist(), items.column("item_id").to_pylist()
    shared = spark.sparkContext.broadcast((terms, weights(index, terms), which, offsets, numbers, names))
    schema = pa.schema([("item", pa.int64()), ("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, weight, which, offsets, numbers, names = shared.value
        best: dict[int, tuple] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                shard = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                treap = Treap(shard["depth"], shard["bits"], shard["drops"], shard["top"])
                n = shard["docs"]
                ids = np.frombuffer(zlib.decompress(shard["ids"]), np.int64)
                known = np.unpackbits(np.frombuffer(zlib.decompress(shard["known"]), np.uint8))[:n].astype(bool)
                found, at = _found(np.frombuffer(zlib.decompress(shard["terms"]), _U), terms)
                row = np.full(len(terms), -1, np.int64)
                row[found] = np.frombuffer(zlib.decompress(shard["rows"]), "<u4")[at]
                row[weight == 0] = -1
                for item in range(len(numbers)):
                    own = which[offsets[item] : offsets[item + 1]]
                    own = own[row[own] >= 0]
                    if not len(own):
                        continue
                    old = best.get(item)
                    least = int(old[2][-1]) if old is not None and len(old[2]) == k else 0
                    cols, scores = treap.best(row[own], weight[own], n, least, k)
                    found_ids, found_known = ids[cols], known[cols]
                    if old is not None:
                        found_ids, found_known, scores = (np.append(a, b) for a, b in zip(old, (found_ids, found_known, scores), strict=True))
                    top = _ranked(found_ids, found_known, scores, k)
                    best[item] = (found_ids[top], found_known[top], scores[top])
        for item, (found_ids, found_known, scores) in best.items():
            m = len(scores)
            doc = pa.array(found_ids, mask=~found_known)
            yield columns(schema, item=[numbers[item]] * m, item_id=[names[item]] * m, doc_id=doc, score=scores)

    return index.shards.mapInArrow(run, "item long, item_id long, doc_id long, score long")


def search(index: Index, items: DataFrame, k: int = 50, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item, item_id, rank, doc_id, score): the ``k`` best documents of every row of ``items``.

    ``item`` numbers the rows.  Items go to the tasks in blocks of about ``ITEM_TERMS`` terms.
    """
    spark = items.sparkSession
    rows = stored(item_terms(items, item_id, text))
    total = rows.agg(F.sum(F.size("terms"))).first()[0] or 0
    parts = -(-total // ITEM_TERMS)
    found = spark.createDataFrame([], "item long, item_id long, doc_id long, score long")
    for part in range(parts):
        block = rows.filter((F.size("terms") > 0) & (F.pmod(F.xxhash64("item"), F.lit(parts)) == part)).toArrow()
        if block.num_rows:
            found = found.unionByName(_answers(index, block, k))
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("item", "item_id", "rank", "doc_id", "score")
