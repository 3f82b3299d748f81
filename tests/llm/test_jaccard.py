import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from psephos.llm import jaccard
from psephos.llm.text import Texts
from tests.llm.cases import SCHEMA, awkward_rows, linked_components, ordered, prose, table


def near_copies() -> list[tuple]:
    """A group of copies with one word changed each, chains of drifting copies, and strangers."""
    rows = []
    base = prose(21, 150).split()
    for i in range(40):
        copy = list(base)
        copy[i * 3 % 150] = f"changed{i}"
        rows.append((100 + i, " ".join(copy)))
    drift = prose(33, 120).split()
    for i in range(12):
        drift[i * 7 : i * 7 + 4] = [f"d{i}a", f"d{i}b", f"d{i}c", f"d{i}d"]
        rows.append((300 + i, " ".join(drift)))
    rows += [(400 + i, prose(50 + i, 40 + i)) for i in range(30)]
    rows += [(500 + i, prose(80, 100) + " " + prose(90 + i, 12 + i)) for i in range(25)]
    return [(i, text, None, None, None) for i, text in rows]


@pytest.mark.parametrize("k, percent", [(3, 90), (5, 80)])
def test_components_equal_all_pairs(spark, k, percent):
    rows = awkward_rows() + near_copies()
    found = jaccard.similar(table(spark, rows), jaccard.Measure(k, percent))
    assert ordered(found.select("id", "n", "component_id").collect()) == ordered(linked_components(rows, k, percent))


def test_counters_shared_by_all_change_nothing(spark, monkeypatch):
    """With so few counters that no n-gram looks rare, the links stay."""
    rows = near_copies()
    monkeypatch.setattr(jaccard, "frequencies", lambda counters: np.zeros(jaccard.SLOTS, np.uint8))
    found = jaccard.similar(table(spark, rows), jaccard.Measure(5, 80))
    assert ordered(found.select("id", "n", "component_id").collect()) == ordered(linked_components(rows, 5, 80))


def test_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "FEW", 0)
    rows = near_copies()
    found = jaccard.similar(table(spark, rows), jaccard.Measure(3, 90))
    assert ordered(found.select("id", "n", "component_id").collect()) == ordered(linked_components(rows, 3, 90))


def almost_linked(groups: int, members: int) -> list[tuple]:
    """Groups whose texts share 85 of their 100 five-word n-grams: 74 per cent, with shared ones in their prefixes."""
    return [
        (100 * g + i, prose(200 + g, 89) + " " + prose(1000 + 10 * g + i, 15), None, None, None)
        for g in range(groups) for i in range(members)
    ]


def test_classes_that_met_at_a_hub_are_not_open(spark, monkeypatch):
    """Of two classes at a token one is the hub, so no pair is left for the last comparison."""
    rows, left = almost_linked(6, 2), []
    monkeypatch.setattr(jaccard, "remaining", lambda open_, *rest: left.append(open_.count()) or rest[0].limit(0))
    found = jaccard.similar(table(spark, rows), jaccard.Measure(5, 80))
    assert ordered(found.select("id", "n", "component_id").collect()) == ordered(linked_components(rows, 5, 80))
    assert left == []


def test_open_postings_do_not_grow_with_their_class(spark, monkeypatch):
    """The last comparison shuffles numbers, no lists of the n-grams of a class with each of them."""
    rows, schemas, reached = almost_linked(6, 4), [], []
    store, last = jaccard.stored, jaccard.remaining
    monkeypatch.setattr(jaccard, "stored", lambda df: schemas.append(df.schema.simpleString()) or store(df))
    monkeypatch.setattr(jaccard, "remaining", lambda *given: reached.append(given[0].count()) or last(*given))
    found = jaccard.similar(table(spark, rows), jaccard.Measure(5, 80))
    assert ordered(found.select("id", "n", "component_id").collect()) == ordered(linked_components(rows, 5, 80))
    assert reached and not [schema for schema in schemas if "array" in schema]


def test_a_crowded_token_meets_random_hubs_beside_many_others(spark, monkeypatch):
    """Near copies whose hub is linked with none of them, among many tokens of few classes, are not compared all with all."""
    core, measure, apart = prose(300, 104), jaccard.Measure(5, 80), []

    def sig(text):
        _, values, bounds = jaccard.sets(Texts(pa.array([text]), lower=True), 5)
        return jaccard.signatures(values, bounds)[0]

    copies = [f"{core} {prose(2000 + i, 10)}" for i in range(jaccard.HUBS + 6)]
    least = min(map(sig, copies))
    hub = next(text for text in (f"{core} {prose(4000 + i, 22)}" for i in range(2000)) if sig(text) < least)
    rows = [(5000 + i, text, None, None, None) for i, text in enumerate([hub, *copies])] + almost_linked(12, 3)
    last = jaccard.remaining

    def noted(open_, *rest):
        roots = open_.groupBy("token", "root").count().groupBy("token").agg((F.sum("count") - F.max("count")).alias("apart"))
        apart.append(roots.agg(F.max("apart")).first()[0])
        return last(open_, *rest)

    monkeypatch.setattr(jaccard, "remaining", noted)
    found = jaccard.similar(table(spark, rows), measure)
    assert ordered(found.select("id", "n", "component_id").collect()) == ordered(linked_components(rows, 5, 80))
    assert apart and apart[0] <= jaccard.HUBS


def test_keep_first_leaves_one_of_each_group(spark):
    rows = awkward_rows() + near_copies()
    kept = jaccard.keep_first(table(spark, rows), jaccard.Measure(5, 80))
    wanted = [(i,) for i, n, least in linked_components(rows, 5, 80) if n == 0 or i == least]
    ids = [(row["doc_id"],) for row in kept.select("doc_id").collect()]
    # Id 9 occurs twice with one text, in a group that id 8 names.
    assert ordered(ids) == ordered(wanted)


def test_thresholds_are_exact():
    measure = jaccard.Measure(5, 80)
    n = np.arange(1, 400)
    assert (measure.overlap(n, n) == np.array([next(o for o in range(1, 401) if 100 * o >= 80 * (2 * x - o)) for x in n])).all()
    assert (measure.prefix(n) == n - np.ceil(n * 0.8 - 1e-9) + 1).all()


def test_empty_table(nothing):
    assert jaccard.similar(nothing, jaccard.Measure()).count() == 0
    assert jaccard.keep_first(nothing, jaccard.Measure()).count() == 0
    assert nothing.schema.simpleString().count(",") == SCHEMA.count(",")
