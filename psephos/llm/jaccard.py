"""Similarity join of documents by the Jaccard measure of their word n-grams.

Rows with equal sets form a class, and only classes are compared.  N-grams are ordered
rarest first; two sets as similar as asked for share an n-gram among the first few of each, their
prefixes.  Classes that share a prefix n-gram are first compared with one hub of that n-gram,
which settles groups of near copies in as many comparisons as they have members.  Where an n-gram
has many classes apart from its largest component, they meet random hubs in rounds.  What then
lies in different components is compared pair by pair.  Before any text is fetched, pairs pass
filters on length, on the places of the shared n-gram, and on the counts of the sets in 256
cells, which bound the overlap of the rest from above.  Each pair is verified once, exactly.

How rare an n-gram is comes from a table of ``SLOTS`` counters over all documents; n-grams that
share a counter are taken for as frequent as both, which costs time but no link.

Defined cases: a text of fewer words than an n-gram has its whole sequence as its set; one
without words, or null, has an empty set and is linked with nothing; equal ids are separate rows;
an empty table gives no rows.
"""
from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from psephos.llm.components import components
from psephos.llm.tables import by_block, by_position, columns, give_back, join_groups, key_filter, passes, place
from psephos.llm.text import BLOCK_BYTES, Texts, blocks, grouped_equal, mixed, sums_between
from psephos.sources import stored

SLOTS = 1 << 24
PARTS = 64
CELLS = 256
#: A set of keys of at most so many rows is broadcast; beyond it both sides are shuffled.
FEW = 200_000
#: An n-gram is crowded while more classes than that lie outside its largest component; each of its classes then meets
#: so many random ones in a round.  Rounds go on while a tenth of the classes of crowded n-grams find links; then all pairs
#: that are left are compared, at n-grams that are not crowded at most so many for each posting.
HUBS = 64

_U = np.uint64


@dataclass(frozen=True)
class Measure:
    """N-grams of ``words`` words; linked from ``percent`` per cent Jaccard similarity on."""

    words: int = 5
    percent: int = 80

    def prefix(self, n: np.ndarray) -> np.ndarray:
        """Length of the prefix of a set of ``n``: one more than may be missing from the other."""
        return n - -(-self.percent * n // 100) + 1

    def overlap(self, n: np.ndarray, m: np.ndarray) -> np.ndarray:
        """Least size of the intersection of linked sets of ``n`` and ``m``."""
        return -(-self.percent * (n + m) // (100 + self.percent))


def sets(texts: Texts, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner and hash of the distinct n-grams of each text, ordered by owner, and their bounds."""
    words = texts.words()
    hashes, owner = words.hashes(), words.text_of_each()
    at, grams = words.windows(k, hashes)
    owners, values = [owner[at]], [grams]
    for j in range(1, k):
        first = words.bounds[:-1][words.counts == j]
        at, grams = words.windows(j, hashes)
        whole = np.isin(at, first)
        owners.append(owner[at[whole]])
        values.append(mixed(grams[whole] + _U(j)))
    owners, values = np.concatenate(owners), np.concatenate(values)
    order, new = grouped_equal(owners, values)
    owners, values = owners[order][new], values[order][new]
    order = np.argsort(owners, kind="stable")
    owners, values = owners[order], values[order]
    return owners, values, np.searchsorted(owners, np.arange(len(texts) + 1))


def signatures(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """64 bits that identify each set: two sums over its members, scrambled together."""
    low = sums_between(mixed(values).view(np.int64), bounds).view(np.uint64)
    high = sums_between(mixed(values * _U(0x9FB21C651E98DF25) + _U(77)).view(np.int64), bounds).view(np.uint64)
    return (mixed(low) ^ mixed(high + _U(0x632BE59BD9B4E019))).view(np.int64)


def cell_counts(owners: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """How many members of each set fall into each cell, at most 255."""
    cells = np.bincount(owners * CELLS + (values & _U(CELLS - 1)).astype(np.int64), minlength=n * CELLS)
    return np.minimum(cells, 255).astype(np.uint8).reshape(n, CELLS)


def described(docs: DataFrame, measure: Measure) -> DataFrame:
    """One scan of ``docs`` (id, text): a row per document, and per task the counters of its n-grams.

    Rows of documents have id, place (a hash of the text), n, sig and cells; rows of counters part and counts.
    """
    schema = pa.schema([
        ("id", pa.int64()), ("place", pa.int64()), ("n", pa.int64()), ("sig", pa.int64()), ("cells", pa.binary()),
        ("part", pa.int32()), ("counts", pa.binary()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros(SLOTS, np.uint16)
        for batch in batches:
            for block in blocks(batch, "text"):
                owners, values, bounds = sets(Texts(block.column("text"), lower=True), measure.words)
                slots, times = np.unique((values >> _U(40)).astype(np.int64), return_counts=True)
                counters[slots] = np.minimum(counters[slots] + times, 65535)
                n = block.num_rows
                yield columns(
                    schema, id=block.column("id"), place=block.column("place"), n=np.diff(bounds),
                    sig=signatures(values, bounds), cells=[x.tobytes() for x in cell_counts(owners, values, n)],
                    part=pa.nulls(n), counts=pa.nulls(n),
                )
        parts = [zlib.compress(x.tobytes(), 1) for x in counters.reshape(PARTS, -1)]
        none = pa.nulls(PARTS)
        yield columns(schema, id=none, place=none, n=none, sig=none, cells=none, part=np.arange(PARTS), counts=parts)
        give_back()

    rows = docs.select("id", "text", place("text").alias("place"))
    return rows.mapInArrow(run, "id long, place long, n long, sig long, cells binary, part int, counts binary")


def frequencies(counters: DataFrame) -> np.ndarray:
    """The counters of all tasks added up, on a logarithmic scale of 0 to 255; ``SLOTS`` bytes."""
    schema = pa.schema([("part", pa.int32()), ("scale", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column("part").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                total[part] = total.get(part, 0) + np.frombuffer(zlib.decompress(counts), np.uint16).astype(np.int64)
        for part, counts in total.items():
            scale = np.minimum(np.log2(counts + 1.0) * 8, 255).astype(np.uint8)
            yield columns(schema, part=[part], scale=[scale.tobytes()])

    merged = counters.select("part", "counts").repartition(PARTS, "part").mapInArrow(run, "part int, scale binary")
    found = {row["part"]: row["scale"] for row in merged.collect()}
    empty = bytes(SLOTS // PARTS)
    return np.frombuffer(b"".join(found.get(part, empty) for part in range(PARTS)), np.uint8)


def postings(docs: DataFrame, measure: Measure, scale: np.ndarray, known: tuple[np.ndarray, int] | None = None) -> DataFrame:
    """(token, sig, n, pos): the prefix of the set of every document, ``pos`` from 0, as far as ``known`` lets it pass."""
    shared = docs.sparkSession.sparkContext.broadcast((scale, known))  # SLOTS bytes, and those of the filter
    schema = pa.schema([("token", pa.int64()), ("sig", pa.int64()), ("n", pa.int32()), ("pos", pa.int32())])

    def work(block: pa.RecordBatch) -> pa.RecordBatch:
        owners, values, bounds = sets(Texts(block.column("text"), lower=True), measure.words)
        sizes, (scale, known) = np.diff(bounds), shared.value
        order = np.lexsort((values, scale[(values >> _U(40)).astype(np.int64)], owners))
        pos = np.arange(len(values)) - bounds[owners]
        kept = pos < measure.prefix(sizes)[owners]
        if known is not None:
            kept &= passes(*known, values[order])
        sig = signatures(values, bounds)[owners[kept]]
        return columns(schema, token=values[order][kept].view(np.int64), sig=sig, n=sizes[owners[kept]], pos=pos[kept])

    return by_block(docs.select("text"), "text", "token long, sig long, n int, pos int", work)


def within_reach(measure: Measure, left: str, right: str) -> Column:
    """Length and positional filter on rows with n and pos of two classes."""
    n, m = F.col(f"{left}.n"), F.col(f"{right}.n")
    rest = F.least(n - F.col(f"{left}.pos"), m - F.col(f"{right}.pos"))
    ok = (100 * n >= measure.percent * m) & (100 * m >= measure.percent * n)
    return ok & (rest * (100 + measure.percent) >= measure.percent * (n + m))


def cell_filter(pairs: DataFrame, classes: DataFrame, measure: Measure) -> DataFrame:
    """Pairs (a, b) whose counts by cell leave room for the overlap they need.

    With the id and place of the row that stands for each class.
    """
    named = {x: [F.col("sig").alias(x), *(F.col(name).alias(f"{name}_{x}") for name in ("n", "cells", "id", "place"))] for x in "ab"}
    kept = ["a", "b", "id_a", "place_a", "id_b", "place_b"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (
                    np.frombuffer(b"".join(batch.column(name).to_pylist()), np.uint8).reshape(-1, CELLS).astype(np.int16)
                    for name in ("cells_a", "cells_b")
                )
                n, m = (np.asarray(batch.column(name)) for name in ("n_a", "n_b"))
                apart = np.abs(x - y).sum(axis=1, dtype=np.int64)
                fits = apart <= n + m - 2 * measure.overlap(n, m)
                yield batch.select(kept).filter(pa.array(fits))

    joined = pairs.join(classes.select(named["a"]), "a").join(classes.select(named["b"]), "b")
    return joined.mapInArrow(run, "a long, b long, id_a long, place_a long, id_b long, place_b long")


def verified(pairs: DataFrame, docs: DataFrame, measure: Measure) -> DataFrame:
    """Pairs (a, b) of stored ``pairs`` that are linked; the texts of their classes are compared."""
    ends = [
        pairs.select(
            F.col(x).alias("sig"), F.col(f"id_{x}").alias("id"), F.col(f"place_{x}").alias("place"),
            *(F.lit(x == side).alias(f"is_{side}") for side in "ab"),
        )
        for x in "ab"
    ]
    keys = stored(
        ends[0].unionByName(ends[1]).groupBy("sig", "id", "place").agg(F.max("is_a").alias("is_a"), F.max("is_b").alias("is_b"))
    )
    keys = F.broadcast(keys) if keys.count() <= FEW else keys
    whole = docs.select(F.col("id").alias("own"), place("text").alias("at"), "text")
    texts = stored(
        whole.join(keys, F.col("own").eqNullSafe(F.col("id")) & (F.col("at") == F.col("place")))
        .groupBy("sig").agg(
            F.min("text").alias("text"), F.max("is_a").alias("is_a"), F.max("is_b").alias("is_b")
        )  # rows equal in id and text
    )
    pairs = pairs.select("a", "b")
    # A text is shuffled for the end where it stands: hubs, of which there are few, for theirs only.
    joined = pairs.join(texts.filter("is_a").select(F.col("sig").alias("a"), "text"), "a")
    joined = joined.join(texts.filter("is_b").select(F.col("sig").alias("b"), F.col("text").alias("other")), "b")

    def work(block: pa.RecordBatch) -> pa.RecordBatch:
        linked = np.zeros(block.num_rows, bool)
        _, mine, bounds = sets(Texts(block.column("text"), lower=True), measure.words)
        # Rows come sorted by b: each run of equal hubs is read once.
        keys = block.column("b").to_pylist()
        last, theirs = None, np.zeros(0, _U)
        for i, key in enumerate(keys):
            if key != last:
                last, theirs = key, np.sort(sets(Texts(block.column("other").slice(i, 1), lower=True), measure.words)[1])
            own = mine[bounds[i] : bounds[i + 1]]
            slot = np.minimum(np.searchsorted(theirs, own), len(theirs) - 1)
            both = int((theirs[slot] == own).sum()) if len(theirs) else 0
            linked[i] = 100 * both >= measure.percent * (len(own) + len(theirs) - both)
        return block.select(["a", "b"]).filter(pa.array(linked))

    return by_block(joined, "text", "a long, b long", work, BLOCK_BYTES)


def open_postings(unmet: DataFrame, under: DataFrame) -> tuple[DataFrame | None, bool]:
    """Postings of tokens whose classes have different roots, with the most frequent one as ``main``; None without any.

    ``unmet`` lacks the hub of each token, which has met all others there.  ``loose`` is how many of the classes of the
    token are not under ``main``.  Also whether any token has more than ``HUBS`` of these.
    """
    placed = unmet.join(under, "sig", "left").select("token", "sig", "n", "pos", F.coalesce("root", "sig").alias("root"))
    counts = placed.groupBy("token", "root").agg(F.count(F.lit(1)).alias("members"))
    tokens = stored(
        counts.groupBy("token").agg(
            F.max(F.struct("members", "root")).alias("most"), F.count(F.lit(1)).alias("roots"), F.sum("members").alias("members")
        ).filter("roots > 1")
        .select("token", "members", F.col("most.root").alias("main"), (F.col("members") - F.col("most.members")).alias("loose"))
    )
    loose = tokens.agg(F.max("loose")).first()[0]
    if loose is None:
        return None, False
    return stored(placed.join(tokens, "token")), loose > HUBS


def random_hubs(open_: DataFrame, measure: Measure, turn: int) -> DataFrame:
    """Pairs (a, b) of each class with up to ``HUBS`` random classes of its most frequent token in ``open_``."""
    best = open_.groupBy("sig").agg(F.max_by(F.struct("token", "n", "pos", "root"), F.struct("members", "token")).alias("x"))
    lots = open_.withColumn("lot", F.pmod(F.xxhash64("sig", F.lit(turn)), F.lit(HUBS)))
    hubs = lots.groupBy("token", "lot").agg(
        F.min_by(F.struct("sig", "n", "pos", "root"), F.xxhash64("sig", F.lit(-turn))).alias("hub")
    ).select("token", "hub.*")
    # Either side is shuffled by token after its aggregation, so a crowded token is split at run time.
    met = best.select("sig", "x.*").alias("x").join(hubs.alias("y"), F.col("x.token") == F.col("y.token"))
    met = met.filter((F.col("x.root") != F.col("y.root")) & within_reach(measure, "x", "y"))
    return met.select(F.least("x.sig", "y.sig").alias("a"), F.greatest("x.sig", "y.sig").alias("b")).distinct()


def ends_apart(under: DataFrame, links: DataFrame) -> DataFrame:
    """(x, y): the roots of the ends of each of ``links`` (a, b) that joins two; a class not in ``under`` is its own."""
    ends = links
    for end in "ab":
        ends = ends.join(under.select(F.col("sig").alias(end), F.col("root").alias(f"root_{end}")), end, "left")
    return ends.select(F.coalesce("root_a", "a").alias("x"), F.coalesce("root_b", "b").alias("y")).filter("x <> y")


def hung(under: DataFrame, links: DataFrame) -> DataFrame:
    """Stored (sig, root) of ``under``, with each root hung below the least that ``links`` (a, b) join it to.

    Classes under one root are connected; connected ones may still have different roots, which
    costs comparisons and no link.
    """
    ends = ends_apart(under, links)
    below = stored(ends.groupBy(F.greatest("x", "y").alias("root")).agg(F.min(F.least("x", "y")).alias("least")))
    above = below.select(F.col("root").alias("least"), F.col("least").alias("higher"))
    below = stored(below.join(above, "least", "left").select("root", F.coalesce("higher", "least").alias("least")))
    nodes = under.unionByName(
        below.select(F.col("root").alias("sig"), "root").join(under.select("sig"), "sig", "left_anti")
    )
    return stored(nodes.join(below, "root", "left").select("sig", F.coalesce("least", "root").alias("root")))


def remaining(open_: DataFrame, tried: DataFrame, classes: DataFrame, docs: DataFrame, measure: Measure) -> DataFrame:
    """Links (a, b) among the pairs of ``open_`` postings across roots that are not in ``tried``.

    A posting travels with numbers only, so what is shuffled grows with the postings, not with the square of their
    number in a class.  A pair that meets at several tokens is merged before its cells are fetched.
    """
    few = open_.filter("root <> main").select("token", "sig", "n", "pos", "root").alias("x")
    all_ = open_.select("token", "sig", "n", "pos", "root", (F.col("root") == F.col("main")).alias("in_main")).alias("y")
    rest = few.join(all_, F.col("x.token") == F.col("y.token")).filter(
        (F.col("x.root") != F.col("y.root")) & (F.col("y.in_main") | (F.col("x.sig") < F.col("y.sig")))
        & within_reach(measure, "x", "y")
    )
    rest = rest.select(F.least("x.sig", "y.sig").alias("a"), F.greatest("x.sig", "y.sig").alias("b")).distinct()
    rest = stored(cell_filter(stored(rest.join(tried, ["a", "b"], "left_anti")), classes, measure))
    return rest.select("a", "b") if rest.isEmpty() else stored(verified(rest, docs, measure))


def join_classes(docs: DataFrame, measure: Measure) -> tuple[DataFrame, DataFrame]:
    """Rows (id, place, n, sig) of every document of ``docs`` (id, text), and components of the sigs."""
    found = stored(described(docs, measure))
    rows = found.filter("part is null").select("id", "place", "n", "sig")
    scale = frequencies(found.filter("part is not null"))
    classes = stored(
        found.filter("part is null and n > 0").groupBy("sig").agg(
            F.min(F.struct(F.col("id").isNull(), "id", "place")).alias("first"), F.first("n").alias("n"),
            F.first("cells").alias("cells"), F.count(F.lit(1)).alias("size"),
        ).select("sig", "n", "cells", "size", "first.id", "first.place")
    )

    # The prefixes are computed twice rather than stored: most of their tokens are nobody else's, and a filter on the
    # others keeps them from being shuffled again.
    tokens = postings(docs, measure, scale).groupBy("token").agg(F.min("sig").alias("hub"), F.max("sig").alias("last"))
    tokens = stored(tokens.filter("hub <> last").select("token", "hub"))
    every = postings(docs, measure, scale, key_filter(tokens, "token"))
    shared = stored(every.join(tokens, "token").distinct())  # classes that share a token, once each
    hubs = stored(shared.filter("sig = hub").select("token", "sig", "n", "pos"))
    unmet = shared.filter("sig <> hub")
    met = unmet.alias("x").join(hubs.alias("y"), F.col("x.token") == F.col("y.token"))
    met = met.filter(within_reach(measure, "x", "y"))
    pairs = stored(met.select(F.col("x.sig").alias("a"), F.col("y.sig").alias("b")).distinct())
    links = stored(verified(stored(cell_filter(pairs, classes, measure)), docs, measure))

    # Classes under one hub are settled, and so are those under its own hub.
    under = links.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "sig")
    above = under.select(F.col("sig").alias("root"), F.col("root").alias("higher"))
    under = stored(under.join(above, "root", "left").select("sig", F.coalesce("higher", "root").alias("root")))
    tried = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    open_, crowded = open_postings(unmet, under)
    if open_ is not None:  # what is open later is so now
        classes_open = stored(classes.join(open_.select("sig").distinct(), "sig", "left_semi"))
    turn, worth = 0, True
    while crowded and worth:
        turn += 1
        loose = open_.filter(F.col("loose") > HUBS)
        pairs = stored(random_hubs(loose, measure, turn).join(tried, ["a", "b"], "left_anti"))
        new = stored(verified(stored(cell_filter(pairs, classes_open, measure)), docs, measure))
        worth = 10 * new.count() >= loose.agg(F.approx_count_distinct("sig")).first()[0]
        tried = tried.unionByName(pairs)
        links = links.unionByName(new)
        under = hung(under, new)
        open_, crowded = open_postings(unmet, under)
    if open_ is not None:
        links = links.unionByName(remaining(open_, tried, classes_open, docs, measure))

    # Nearly all links lie under one root; components are found among the roots of the rest.
    between = ends_apart(under, links).select(F.col("x").alias("a"), F.col("y").alias("b"))
    tops = stored(components(between).select(F.col("node").alias("root"), F.col("root").alias("top")))
    nodes = classes.select("sig", "size", "id").join(under, "sig", "left")
    nodes = nodes.select("sig", "size", "id", F.coalesce("root", "sig").alias("root")).join(tops, "root", "left")
    nodes = stored(nodes.select("sig", "size", "id", F.coalesce("top", "root").alias("root")))
    least = stored(nodes.groupBy("root").agg(F.min("id").alias("component_id"), F.count(F.lit(1)).alias("degree")))
    return rows, stored(join_groups(nodes, least, "root", "degree").select("sig", "size", "root", "component_id"))


def similar(docs: DataFrame, measure: Measure, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, place, n, component_id, root) of every row; the component is named by its smallest id.

    ``root`` names it too, by a signature, also where no member has an id.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows, classes = join_classes(docs, measure)
    full = join_groups(rows.filter("n > 0"), classes, "sig", "size").select("id", "place", "n", "component_id", "root")
    alone = rows.filter("n = 0").select("id", "place", "n", F.col("id").alias("component_id"), F.col("sig").alias("root"))
    return full.unionByName(alone)


def keep_first(docs: DataFrame, measure: Measure, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` with the smallest id of their component, with all their columns.

    Documents without words stay, as they are linked with nothing.
    """
    names = docs.columns
    docs, (doc_id, text) = by_position(docs, doc_id, text)
    found = stored(similar(docs, measure, doc_id, text))
    first = found.filter("n > 0").groupBy("root").agg(F.min(F.struct(F.col("id").isNull(), "id", "place")).alias("first"))
    keys = first.select("first.id", "first.place")
    times = found.filter("n > 0").groupBy("id", "place").agg(F.count(F.lit(1)).alias("times"))
    on = keys["id"].eqNullSafe(times["id"]) & (keys["place"] == times["place"])
    kept = stored(keys.join(times, on).select(keys["id"].alias("__id"), keys["place"].alias("__place"), times["times"].alias("__times")))
    empty = F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]")), F.lit(0)) == 0
    match = F.col(doc_id).cast("long").eqNullSafe(F.col("__id")) & (place(text) == F.col("__place"))
    rows = docs.filter(~empty).join(kept, match)
    once = rows.filter("__times = 1")
    again = rows.filter("__times > 1").dropDuplicates(["__id", "__place"])
    return once.unionByName(again).select(*docs.columns).unionByName(docs.filter(empty)).toDF(*names)
