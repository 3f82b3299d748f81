"""Audit of a chain of filters: what each would remove in every order in which they could stand.

Every filter has one table of the ids that fail it.  What a filter removes after a set of others is its
table left-anti joined with theirs; the sets grow by one filter a level, and each level joins what the level
before left.  As a prefix of an order counts by its set alone, 2**n sets serve all n! orders.  Only
failing ids are ever joined: survivors are all rows less what was removed, and what is redundant is the
left-semi side of the same joins, the failing ids less the removed ones.  Label losses travel as
flags of the ids.

Defined cases: rows are told apart by a number given when they are stored, so null and repeated ids are
rows like others; a null text is an empty one, a null part an empty string; equal texts fail with every row
but those of the smallest id, and a null id is neither smaller than another nor larger; labels that repeat an
id count if any of them is 1; an empty table gives no rows.  Other columns are not read.  The words of one text are
held at a time, about 20 bytes for each of its own.
"""
from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from psephos.llm.tables import join_groups
from psephos.sources import scratch_folder, stored

WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def text_filters(text: Column) -> dict[str, Column]:
    """Whether a text is short, repeats its words, is in capitals, or holds odd symbols."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    capitals = F.length(text) - F.length(F.translate(text, UPPER, ""))
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * capitals > 3 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def judged(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(row, id, part, A to E) of every row of ``docs``; E is a text that a smaller id has too."""
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = stored(
        docs.select(
            F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(part), F.lit("")).alias("part"),
            F.unhex(F.sha2(whole, 256)).alias("digest"), *(c.alias(name) for name, c in text_filters(whole).items()),
            F.monotonically_increasing_id().alias("row"),
        )
    )
    groups = stored(rows.groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("size")))
    later = F.coalesce(F.col("id") > F.col("first"), F.lit(False))
    return join_groups(rows, groups, "digest", "size").select("row", "id", "part", *"ABCD", later.alias("E"))


def with_labels(rows: DataFrame, labels: DataFrame, marks: Sequence[str]) -> DataFrame:
    """``rows`` with a flag per mark: whether ``labels`` (id and marks) has a 1 for the row's id."""
    one = [F.max(F.when(F.col(name) == 1, 1).otherwise(0)).alias(name) for name in marks]
    known = labels.filter("id is not null").groupBy("id").agg(*one)
    return rows.join(known, "id", "left").withColumns({name: F.coalesce(name, F.lit(0)) for name in marks})


def failing_ids(rows: DataFrame, filters: Sequence[str], marks: Sequence[str]) -> dict[str, DataFrame]:
    """One table of failing rows (row, part, marks) per filter, written in one pass."""
    path = scratch_folder(rows.sparkSession, "failing")
    names = F.array_compact(F.array(*(F.when(F.col(name), F.lit(name)) for name in filters)))
    found = rows.select("row", "part", *marks, F.explode(names).alias("filter"))
    found.write.partitionBy("filter").parquet(path)
    schema = found.schema
    all_ = rows.sparkSession.read.schema(schema).parquet(path)
    return {name: all_.filter(F.col("filter") == name).drop("filter") for name in filters}


def removals(failing: Mapping[str, DataFrame], marks: Sequence[str]) -> DataFrame:
    """(part, filter, before, removed, marks) for each filter after each set of others that removes anything.

    ``before`` has bit i set where the i-th filter stands before this one.
    """
    names = list(failing)
    rows = [table.withColumns({"filter": F.lit(name), "before": F.lit(0)}) for name, table in failing.items()]
    left = reduce(DataFrame.unionByName, rows)
    counts = []
    for size in range(len(names)):
        counts.append(
            left.groupBy("part", "filter", "before").agg(
                F.count(F.lit(1)).alias("removed"), *(F.sum(name).cast("long").alias(name) for name in marks)
            )
        )
        if size + 1 < len(names):
            # Sets grow in the order of the filters, so that each is reached once.
            grown = []
            for i in range(size, len(names)):
                open_ = left.filter((F.col("before") < (1 << i)) & (F.col("filter") != names[i]))
                still = open_.join(failing[names[i]].select("row"), "row", "left_anti")
                grown.append(still.withColumn("before", F.col("before") + F.lit(1 << i)))
            left = stored(reduce(DataFrame.unionByName, grown))
    return stored(reduce(DataFrame.unionByName, counts))


def report(totals: DataFrame, counts: DataFrame, filters: Sequence[str], marks: Sequence[str]) -> DataFrame:
    """A row per part, order of the filters and step; ``totals`` holds the rows of each part.

    ``shapley`` adds up what the filter of the step removes in all orders.
    """
    spark = totals.sparkSession
    bit = {name: 1 << i for i, name in enumerate(filters)}
    steps = [
        ("".join(order), k + 1, order[k], sum(bit[name] for name in order[:k]))
        for order in permutations(filters) for k in range(len(filters))
    ]
    orders = spark.createDataFrame(steps, "filter_order string, step int, filter string, before int")
    sets = sorted({(name, before) for _, _, name, before in steps})
    every = F.explode(F.array(*(F.struct(F.lit(name).alias("filter"), F.lit(before).alias("before")) for name, before in sets)))
    cells = totals.select("part", "rows", every.alias("x")).select("part", "rows", "x.*")
    zero = {name: F.coalesce(name, F.lit(0).cast("long")) for name in ("removed", *marks)}
    cells = cells.join(counts, ["part", "filter", "before"], "left").withColumns(zero)
    of_filter = Window.partitionBy("part", "filter")
    alone = F.max(F.when(F.col("before") == 0, F.col("removed"))).over(of_filter)
    only = F.max(F.when(F.col("before") == sum(bit.values()) - F.col("bit"), F.col("removed"))).over(of_filter)
    bits = reduce(lambda c, name: c.when(F.col("filter") == name, bit[name]), filters, F)
    cells = cells.withColumn("bit", bits).withColumns({"failing": alone, "unique_fails": only})
    rows = cells.join(F.broadcast(orders), ["filter", "before"])  # n * n! rows
    so_far = Window.partitionBy("part", "filter_order").orderBy("step")
    return rows.select(
        "part", "filter_order", "step", (F.col("rows") - F.sum("removed").over(so_far)).alias("kept"), "removed",
        (F.col("failing") - F.col("removed")).alias("redundant"), "unique_fails", *marks,
        F.sum("removed").over(of_filter).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, marks: Sequence[str], doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """The report on the five filters of this module over ``docs``; ``labels`` has id and ``marks``."""
    filters = list("ABCDE")
    rows = stored(with_labels(judged(docs, doc_id, text, part), labels, marks))
    totals = rows.groupBy("part").agg(F.count(F.lit(1)).alias("rows"))
    return report(totals, removals(failing_ids(rows, filters, marks), marks), filters, marks)
