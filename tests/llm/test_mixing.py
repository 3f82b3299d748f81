import itertools

import pytest
from pyspark.sql import functions as F

from psephos.llm import mixing
from psephos.sources import stored


def test_targets_stop_at_twice_the_source_and_share_the_rest():
    sizes = {"a": 10, "b": 100, "c": 100}
    targets = mixing.shared_targets(sizes, {"a": 3, "b": 1, "c": 2}, 1.5 * 210, 2)
    assert targets["a"] == 20 and sum(targets.values()) == pytest.approx(315)
    assert targets["c"] == pytest.approx(2 * targets["b"])


def best_flow(supply, costs, members, quotas):
    """Most words, then least cost, by trying every flow."""
    best = None
    options = []
    for words, own in zip(supply, members, strict=True):
        top = words * len(costs)
        options.append([c for c in itertools.product(range(top + 1), repeat=len(own)) if sum(c) <= top])
    for choice in itertools.product(*options):
        into = [0] * len(quotas)
        cost = 0.0
        for flow, own, words in zip(choice, members, supply, strict=True):
            for s, f in zip(own, flow, strict=True):
                into[s] += f
            total = sum(flow)
            cost += sum(costs[i] * max(0, min(words, total - i * words)) for i in range(len(costs)))
        if all(x <= q for x, q in zip(into, quotas, strict=True)):
            key = (-sum(into), cost)
            best = key if best is None else min(best, key)
    return best


@pytest.mark.parametrize("case", [
    ([2, 1, 2], [[0], [1], [0, 1]], [3, 3]),
    ([1, 2, 1], [[0, 1], [1], [0]], [2, 5]),
    ([3, 1], [[0, 1], [1]], [1, 4]),
    ([0, 2], [[0], [0, 1]], [2, 2]),
])
def test_flow_is_cheapest(case):
    supply, members, quotas = case
    flows = mixing.cheapest_flow(supply, [0.0, 1.0], members, quotas)
    total = sum(sum(f.values()) for f in flows)
    cost = sum(max(0, sum(f.values()) - w) for f, w in zip(flows, supply, strict=True))
    assert (-total, cost) == best_flow(supply, [0.0, 1.0], members, quotas)


def test_overlapping_sources_meet_quotas(spark):
    rows = [(i, s, 5 + i * 7 % 40) for i in range(600) for s in ([["a"], ["b"], ["a", "b"], [None], ["a", "a"], [], None][i % 7],)]
    df = stored(spark.createDataFrame(rows + [(1, ["a"], 0), (1, ["a"], 0)], "id long, sources array<string>, size long"))
    taken, sources = mixing.mix(df, {"a": 3, "b": 1, None: 2})
    found = taken.collect()
    assert len(found) == len(rows) + 2
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in found)
    assert all(r["taken"] == 0 for r in found if not r["sources"])
    by_source = {r["source"]: r for r in sources.collect()}
    assert all(abs(r["filled"] - r["target"]) <= 1 for r in by_source.values())
    assert sum(r["taken"] for r in found) == sum(r["filled"] for r in by_source.values())
    again, _ = mixing.mix(df, {"a": 3, "b": 1, None: 2})
    assert sorted((r["id"], r["size"], r["taken"]) for r in found) == sorted((r["id"], r["size"], r["taken"]) for r in again.collect())
    other, _ = mixing.mix(df, {"a": 3, "b": 1, None: 2}, seed=8)
    assert {(r["id"], r["taken"]) for r in found} != {(r["id"], r["taken"]) for r in other.collect()}


def test_empty_table(spark):
    df = spark.createDataFrame([], "id long, sources array<string>, size long")
    taken, sources = mixing.mix(df, [3, 1, 2])
    assert taken.count() == 0 and sources.count() == 0


def test_whole_copies(spark):
    df = spark.createDataFrame([(10, 0), (10, 4), (10, 16), (10, 20), (0, 0)], "size long, taken long")
    assert [r[0] for r in df.select(mixing.copies()).collect()] == [0, 0, 2, 2, 0]
    assert df.filter(F.col("size") > 0).count() == 4
