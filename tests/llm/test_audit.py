"""The filter audit against plain counting over every order."""
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from psephos.llm import audit
from tests.llm.cases import SCHEMA, awkward_rows, ordered, words


def fails(row: tuple, rows: list[tuple]) -> set[str]:
    text = row[1] or ""
    w = words(text)
    out = set()
    if len(w) < 200:
        out.add("A")
    if 100 * len(set(w)) < 50 * len(w):
        out.add("B")
    if 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text):
        out.add("C")
    if set(text) & set("#$%&*|"):
        out.add("D")
    if row[0] is not None and any(x[0] is not None and x[0] < row[0] and (x[1] or "") == text for x in rows):
        out.add("E")
    return out


def expected(rows: list[tuple], good: set, toxic: set) -> list[tuple]:
    out = []
    for part in {row[2] or "" for row in rows}:
        own = [(row[0], fails(row, rows)) for row in rows if (row[2] or "") == part]
        steps, shapley = [], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for step, name in enumerate(order, 1):
                gone = [x for x in left if name in x[1]]
                left = [x for x in left if name not in x[1]]
                shapley[name] += len(gone)
                steps.append((
                    part, "".join(order), step, len(left), len(gone), sum(name in x[1] for x in own) - len(gone),
                    sum(x[1] == {name} for x in own), sum(x[0] in good for x in gone), sum(x[0] in toxic for x in gone), name,
                ))
        out += [(*x[:-1], shapley[x[-1]]) for x in steps]
    return out


def loud_rows() -> list[tuple]:
    texts = ["SHOUT " * 250, "#tag", "a b c " * 90, "CAPS", "CAPS", None, "", "A | B"]
    return [(50 + i, text, lang, "a", None) for i, text in enumerate(texts) for lang in ("", "xx")][: 2 * len(texts)]


def test_report_equals_plain_counting(spark):
    rows = awkward_rows() + loud_rows()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    docs = docs.withColumns({name: F.lit("clash") for name in ("id", "part", "row", "digest", "first", "size", "A", "E", "good")})
    labels = spark.createDataFrame(
        [(1, 1, 0), (9, 1, 1), (9, 0, 0), (15, 0, 1), (50, 1, None), (51, None, 1), (None, 1, 1), (999, 1, 1)], "id long, good int, toxic int"
    )
    found = audit.audit(docs, labels, ["good", "toxic"])
    assert ordered(found.collect()) == ordered(expected(rows, {1, 9, 50}, {9, 15, 51}))


def test_survivors_do_not_depend_on_the_order(awkward, spark):
    labels = spark.createDataFrame([], "id long, good int")
    last = audit.audit(awkward, labels, ["good"]).filter("step = 5")
    assert last.groupBy("part").agg(F.countDistinct("kept").alias("n")).filter("n > 1").isEmpty()
    shares = audit.audit(awkward, labels, ["good"]).groupBy("part", "filter_order").agg(F.sum("shapley").alias("s"), F.sum("removed").alias("r"))
    assert shares.filter("s <> 120 * r").isEmpty()


def test_other_filters(spark):
    rows = spark.createDataFrame(
        [(1, "p", True, False, False), (2, "p", True, True, False), (3, "p", False, True, True), (4, "q", False, False, False)],
        "row long, part string, x boolean, y boolean, z boolean",
    )
    counts = audit.removals(audit.failing_ids(rows, ["x", "y", "z"], []), [])
    found = {(r["filter"], r["before"]): r["removed"] for r in counts.collect()}
    assert found == {("x", 0): 2, ("y", 0): 2, ("z", 0): 1, ("x", 2): 1, ("x", 4): 2, ("y", 1): 1, ("y", 4): 1, ("z", 1): 1, ("x", 6): 1}
    table = audit.report(rows.groupBy("part").agg(F.count("row").alias("rows")), counts, ["x", "y", "z"], [])
    assert table.count() == 2 * 6 * 3
    kept = {(r["filter_order"], r["step"]): r["kept"] for r in table.filter("part = 'p'").collect()}
    assert [kept["yxz", k] for k in (1, 2, 3)] == [1, 0, 0]


def test_empty_table(nothing, spark):
    labels = spark.createDataFrame([], "id long, good int")
    assert audit.audit(nothing, labels, ["good"]).collect() == []


@pytest.mark.parametrize("text, failed", [("x" * 97 + "ABC", False), ("x" * 96 + "ABCD", True), ("", False), ("ÀÉ", False)])
def test_share_of_capitals(spark, text, failed):
    row = spark.createDataFrame([(text,)], "text string").select(audit.text_filters(F.col("text"))["C"].alias("c")).first()
    assert row["c"] == failed
