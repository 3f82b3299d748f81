import numpy as np
import pytest

from psephos.llm import fm_dedup
from tests.llm.cases import awkward_rows, ordered, prose, table, without_repeats


def passages() -> list[tuple]:
    shared, other = prose(40, 90), prose(41, 55)
    rows = [(1000 + i, f"{prose(60 + i, 30)} {shared} {prose(90 + i, 25)}") for i in range(25)]
    rows += [(1100 + i, f"{other}\n{prose(130 + i, 60)}\n{other}") for i in range(5)]
    rows += [(1200, " ".join(["la"] * 700)), (1201, " ".join(["la"] * 60) + " end"), (1202, " ".join(["la", "li"] * 100))]
    rows += [(1203, " ".join(shared.split()[:50])), (1204, " ".join(shared.split()[3:52])), (1205, " ".join(shared.split()[-50:]))]
    return [(i, text, None, None, None) for i, text in rows]


@pytest.mark.parametrize("classes", [2000, 3, 0])
def test_removed_words_equal_a_table_of_windows(spark, monkeypatch, classes):
    """By the indexes alone, by both ways, and by windows alone."""
    monkeypatch.setattr(fm_dedup, "CLASSES", classes)
    rows = awkward_rows() + passages()
    found = fm_dedup.removed(table(spark, rows))
    assert ordered(found.collect()) == ordered(without_repeats(rows))


def test_many_shards(spark, monkeypatch):
    monkeypatch.setattr(fm_dedup, "SHARD_WORDS", 500)
    rows = passages()
    assert ordered(fm_dedup.removed(table(spark, rows)).collect()) == ordered(without_repeats(rows))


def test_backward_search_counts_patterns():
    draw = np.random.default_rng(3)
    text = np.append(draw.integers(1, 7, 4000), 0)
    text[::37] = 0
    index = fm_dedup.FMIndex(text, 7, 5)
    for pattern in draw.integers(1, 7, (200, 5)):
        low, high = np.zeros(1, int), np.full(1, len(text))
        for symbol in pattern[::-1]:
            low, high = index.extended(np.array([symbol]), low, high)
        places = [i for i in range(len(text) - 4) if (text[i : i + 5] == pattern).all()]
        assert sorted(index.suffixes[low[0] : max(high[0], low[0])].tolist()) == places


def test_wavelet_ranks():
    values = np.random.default_rng(1).integers(0, 1000, 5000)
    matrix = fm_dedup.WaveletMatrix(values, 1000)
    symbol, place = values[::7], np.arange(0, 5000, 7)
    assert matrix.rank(symbol, place).tolist() == [int((values[:p] == s).sum()) for s, p in zip(symbol, place, strict=True)]


def test_empty_table(nothing):
    assert fm_dedup.removed(nothing).count() == 0
