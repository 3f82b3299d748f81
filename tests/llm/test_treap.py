"""Ranked search over treaps against scoring every document."""
import math
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from psephos.llm import treap
from psephos.llm.treap import Treap
from tests.llm.cases import LOWER, SCHEMA, awkward_rows, ordered, prose

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text: str | None) -> list[str]:
    return TERM.findall((text or "").translate(LOWER))


def expected(rows: list[tuple], items: list[tuple], k: int) -> list[tuple]:
    docs = [(row[0], terms(row[1])) for row in rows]
    documents, total = sum(bool(t) for _, t in docs), sum(len(t) for _, t in docs)
    out = []
    for item, text in items:
        wanted, scores = set(terms(text)), []
        weight = {}
        for term in wanted:
            df = sum(term in t for _, t in docs)
            weight[term] = math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))
        for i, t in docs:
            m = 50 + (50 * len(t) * documents) // max(total, 1)
            score = sum(weight[x] * ((10**9 * t.count(x)) // (1000 * t.count(x) + 20 * m)) for x in wanted if x in t)
            if score > 0:
                scores.append((-score, i is None, i))
        scores.sort(key=lambda s: (s[0], s[1], s[2] or 0))
        out += [(item, rank, s[2], -s[0]) for rank, s in enumerate(scores[:k], 1)]
    return out


def corpus() -> list[tuple]:
    more = [(200 + i, prose(i % 40, 5 + 7 * (i % 31)) + (" Zebra" if i % 9 == 0 else ""), "en", "a", None) for i in range(260)]
    return awkward_rows() + more


ITEMS = [(1, prose(3, 40)), (2, "zebra ZEBRA café"), (3, None), (4, ""), (5, "unheard of"), (6, "w5"), (6, "again one two"), (None, "line naïve"), (7, "... !!")]


@pytest.mark.parametrize("k, shard", [(5, 1 << 13), (50, 40), (1, 7), (1000, 100)])
def test_search_equals_scoring_all(spark, monkeypatch, k, shard):
    monkeypatch.setattr(treap, "SHARD_DOCS", shard)
    monkeypatch.setattr("psephos.llm.text.BLOCK_BYTES", 4000)
    docs = spark.createDataFrame(corpus(), SCHEMA).repartition(3).withColumns({x: F.lit("clash") for x in ("id", "terms", "item", "rank", "df")})
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumns({x: F.lit("clash") for x in ("item", "terms", "score")})
    found = treap.search(treap.build_index(docs), items, k).select("item_id", "rank", "doc_id", "score")
    assert ordered(found.collect()) == ordered(expected(corpus(), ITEMS, k))


def test_items_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(treap, "ITEM_TERMS", 10)
    docs = spark.createDataFrame(corpus(), SCHEMA).repartition(2)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = treap.search(treap.build_index(docs), items, 10).select("item_id", "rank", "doc_id", "score")
    assert ordered(found.collect()) == ordered(expected(corpus(), ITEMS, 10))


def test_few_states_are_opened_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(treap, "OPENED", 2)
    docs = spark.createDataFrame(corpus(), SCHEMA).coalesce(1)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = treap.search(treap.build_index(docs), items, 3).select("item_id", "rank", "doc_id", "score")
    assert ordered(found.collect()) == ordered(expected(corpus(), ITEMS, 3))


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.tuples(st.integers(0, 90), st.integers(0, 40)), st.integers(1, 1000), min_size=1, max_size=120), st.integers(1, 6))
def test_treap_finds_the_best_columns(points, k):
    rows, cols = (np.asarray([p[i] for p in points], np.int64) for i in (0, 1))
    values = np.asarray(list(points.values()), np.int64)
    packed = Treap.packed(rows, cols, values)
    tree = Treap(packed["depth"], packed["bits"], packed["drops"], packed["top"])
    chosen, weight = np.unique(rows)[::2], np.arange(1, len(np.unique(rows)[::2]) + 1)
    scores = np.zeros(41, np.int64)
    for (r, c), v in points.items():
        if r in chosen:
            scores[c] += v * weight[np.searchsorted(chosen, r)]
    found, got = tree.best(chosen, weight, 41, 0, k)
    least = max(np.sort(scores)[::-1][:k][-1], 1)
    assert dict(zip(found.tolist(), got.tolist(), strict=True)) == {c: s for c, s in enumerate(scores.tolist()) if s >= least}


def test_points_are_stored_as_bits():
    rng = np.random.default_rng(1)
    rows, cols = rng.integers(0, 1 << 12, (2, 200_000))
    points = np.unique(rows << 12 | cols)
    packed = Treap.packed(points >> 12, points & 4095, rng.integers(1, 1000, len(points)))
    bits = sum(len(x) for x in packed["bits"])
    assert bits < 2 * len(points)  # a pointer each would be 4 bytes a level


def test_impacts_are_exact_for_huge_corpora():
    n = np.asarray([0, 1, 10**7, 5 * 10**8])
    documents, total = 10**11, 3 * 10**13
    found = treap.impacts(np.asarray([1, 1, 9, 400]), n, documents, total)
    for tf, size, value in zip([1, 1, 9, 400], n.tolist(), found.tolist(), strict=True):
        m = 50 + (50 * size * documents) // total
        assert value == (10**9 * tf) // (1000 * tf + 20 * m)


def test_empty_tables(nothing, spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert treap.search(treap.build_index(nothing), items).collect() == []
    docs = spark.createDataFrame(corpus(), SCHEMA)
    assert treap.search(treap.build_index(docs), items.limit(0)).collect() == []
