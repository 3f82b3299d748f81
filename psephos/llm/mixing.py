"""Mixing overlapping sources to target weights by a min-cost flow.

A document belongs to one or more sources; the sources it belongs to are its membership
pattern.  Sizes are summed by pattern, and a flow carries words from patterns to the quotas
of their sources.  The first pass over a pattern costs nothing, each further pass costs more
than the one before, so that no text is repeated while unread text could serve.  The flow
of each pattern is then filled with documents in a seeded order.

Defined cases: a null source is a source of its own, last in order; a document without any
source, or of size 0, is never taken; rows with equal ids are separate rows; an empty
table gives an empty mix.  The one document of a pattern at which the flow ends is taken
in part, so that every quota is met to the word.
"""
from __future__ import annotations

import heapq
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from psephos.sources import stored

#: Slices of the seeded order; running sums go over slices first, then within one slice.
SLICES = 4096


def shared_targets(sizes: Mapping[str | None, int], weights: Mapping[str | None, float], total: float, most: float) -> dict[str | None, float]:
    """``total`` shared by weight; what exceeds ``most`` times a source's size is shared anew."""
    targets: dict[str | None, float] = {}
    left, open_ = float(total), dict(weights)
    while open_:
        unit = sum(open_.values())
        share = {source: left * weight / unit for source, weight in open_.items()}
        above = [source for source in open_ if share[source] > most * sizes[source]]
        if not above:
            return targets | share
        for source in above:
            targets[source] = float(most * sizes[source])
            left -= targets[source]
            del open_[source]
    return targets


def cheapest_flow(
    supply: Sequence[int], costs: Sequence[float], members: Sequence[Sequence[int]], quotas: Sequence[int]
) -> list[dict[int, int]]:
    """Words from each pattern to each of its sources: most first, then least cost.

    A pattern offers ``supply`` words once per entry of ``costs``, which must not fall.
    Shortest paths with potentials over patterns x sources; no table of documents is involved.
    """
    patterns, sources = len(supply), len(quotas)
    start, end = patterns + sources, patterns + sources + 1
    to: list[int] = []
    room: list[int] = []
    price: list[float] = []
    out: list[list[int]] = [[] for _ in range(end + 1)]

    def arc(a: int, b: int, capacity: int, cost: float) -> int:
        for x, y, c, p in ((a, b, capacity, cost), (b, a, 0, -cost)):
            out[x].append(len(to))
            to.append(y)
            room.append(c)
            price.append(p)
        return len(to) - 2

    carried = []
    for i, (words, own) in enumerate(zip(supply, members, strict=True)):
        for cost in costs:
            arc(start, i, words, cost)
        carried += [(i, s, arc(i, patterns + s, words * len(costs), 0.0)) for s in own]
    for s, quota in enumerate(quotas):
        arc(patterns + s, end, quota, 0.0)

    potential = [0.0] * (end + 1)
    while True:
        far = [float("inf")] * (end + 1)
        via = [-1] * (end + 1)
        far[start] = 0.0
        queue = [(0.0, start)]
        while queue:
            d, a = heapq.heappop(queue)
            if d > far[a]:
                continue
            for e in out[a]:
                step = d + price[e] + potential[a] - potential[to[e]]
                if room[e] > 0 and step < far[to[e]] - 1e-9:
                    far[to[e]], via[to[e]] = step, e
                    heapq.heappush(queue, (step, to[e]))
        if via[end] < 0:
            break
        potential = [p + d if d < float("inf") else p for p, d in zip(potential, far, strict=True)]
        path, b = [], end
        while b != start:
            path.append(via[b])
            b = to[via[b] ^ 1]
        words = min(room[e] for e in path)
        for e in path:
            room[e] -= words
            room[e ^ 1] += words
    flows: list[dict[int, int]] = [{} for _ in range(patterns)]
    for i, s, e in carried:
        flows[i][s] = flows[i].get(s, 0) + room[e ^ 1]
    return flows


def mix(
    rows: DataFrame, weights: Sequence[float] | Mapping[str | None, float], share: float = 1.5, passes: int = 2, seed: int = 7
) -> tuple[DataFrame, DataFrame]:
    """Choose how many words of each row the mix takes.

    ``rows`` has id, sources (array of text) and size, and is read three times, so it should be a
    stored table.  ``weights`` maps sources to weights, or is a sequence that repeats over the sources in
    order.  The mix holds ``share`` times all words; no row gives more than ``passes`` times its
    size.  Returns (id, sources, size, taken) and one row per source: source, source_size,
    target, filled.  Only sums by pattern come to the driver: as many rows as there are
    different sets of sources.
    """
    spark = rows.sparkSession
    pattern = F.to_json(F.array_sort(F.array_distinct(F.coalesce("sources", F.array()))))
    keyed = rows.select(
        "id", "sources", "size", pattern.alias("pattern"),
        F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 40)).alias("turn"),
    ).withColumn("slice", (F.col("turn") % SLICES).cast("int"))
    slices = stored(
        keyed.groupBy("pattern", "slice").agg(F.sum("size").alias("words"), F.first(F.array_sort(F.array_distinct(F.coalesce("sources", F.array())))).alias("members"))
    )
    sums = slices.groupBy("pattern").agg(F.sum("words").alias("words"), F.first("members").alias("members")).orderBy("pattern").collect()

    names = sorted({name for row in sums for name in row["members"]}, key=lambda name: (name is None, name or ""))
    own = [[names.index(name) for name in row["members"]] for row in sums]
    words = [int(row["words"] or 0) for row in sums]
    sizes = {name: sum(w for w, of in zip(words, own, strict=True) if i in of) for i, name in enumerate(names)}
    if not isinstance(weights, Mapping):
        weights = {name: weights[i % len(weights)] for i, name in enumerate(names)}
    usable = sum(w for w, of in zip(words, own, strict=True) if of)
    targets = shared_targets(sizes, {name: weights[name] for name in names}, share * usable, passes)
    quotas = [int(targets[name] + 0.5) for name in names]
    flows = cheapest_flow(words, [float(i) for i in range(passes)], own, quotas)
    filled = [sum(flow.get(i, 0) for flow in flows) for i in range(len(names))]

    source_rows = [(name, int(sizes[name]), float(targets[name]), int(filled[i])) for i, name in enumerate(names)]
    by_source = spark.createDataFrame(source_rows, "source string, source_size long, target double, filled long")
    flow_rows = [(row["pattern"], int(sum(flow.values())), int(w)) for row, flow, w in zip(sums, flows, words, strict=True)]
    flow_table = spark.createDataFrame(flow_rows, "pattern string, flow long, supply long")

    before = Window.partitionBy("pattern").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = slices.join(F.broadcast(flow_table), "pattern").select(
        "pattern", "slice", "words", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("offset"),
        # Whole passes over the pattern, and what the last, partial pass still takes.
        F.when(F.col("supply") > 0, F.floor(F.col("flow") / F.col("supply"))).otherwise(0).alias("whole"),
        F.when(F.col("supply") > 0, F.col("flow") % F.col("supply")).otherwise(0).alias("rest"),
    )
    # Of a slice that lies wholly before or after the end of the partial pass, no order is needed.
    offsets = offsets.withColumn("left", F.col("rest") - F.col("offset"))
    cut = offsets.filter("left > 0 and left < words").select("pattern", "slice", "left", "whole")
    even = offsets.filter("left <= 0 or left >= words").select(
        "pattern", "slice", (F.col("whole") + F.when(F.col("left") > 0, 1).otherwise(0)).alias("times")
    )
    columns = ["id", "sources", "size"]
    plain = keyed.join(even, ["pattern", "slice"]).select(*columns, (F.col("size") * F.col("times")).cast("long").alias("taken"))
    order = Window.partitionBy("pattern", "slice").orderBy("turn", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    fitted = keyed.join(F.broadcast(cut), ["pattern", "slice"]).withColumn("room", F.col("left") - F.coalesce(F.sum("size").over(order), F.lit(0)))
    partial = F.greatest(F.lit(0), F.least("size", "room"))
    fitted = fitted.select(*columns, (F.col("size") * F.col("whole") + partial).cast("long").alias("taken"))
    return plain.unionByName(fitted), by_source


def copies() -> Column:
    """How often a whole document is read: the words taken over its size, rounded."""
    return F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
