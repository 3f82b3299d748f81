import hashlib
import re
from collections import defaultdict
from pathlib import Path

from psephos.llm import exact
from psephos.sources import stored
from tests.llm.cases import awkward_rows, ordered


def brute(rows):
    groups = defaultdict(list)
    for place, row in enumerate(rows):
        text = row[1] or ""
        digest = hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", text).encode()).hexdigest()
        groups[digest].append((-len(text), row[0] is None, row[0] or 0, place, row[0]))
    out = []
    for digest, members in groups.items():
        members.sort()
        out += [(m[4], members[0][4], len(members), m is members[0], digest) for m in members]
    return out


def test_every_row_has_its_keeper(awkward):
    rows = stored(exact.digests(awkward))
    found = exact.deduplicate(rows, exact.new_index(rows.sparkSession))
    assert ordered(found.select("id", "keep_id", "group_size", "kept", "digest").collect()) == ordered(brute(awkward_rows()))


def test_index_outlives_a_batch(spark, awkward):
    index = exact.new_index(spark)
    rows = stored(exact.digests(awkward))
    first = exact.deduplicate(rows, index).filter("kept").count()
    again = exact.DigestIndex(spark, index.name, index.path)
    assert exact.deduplicate(rows, again).filter("kept").count() == 0
    assert again.table().count() == first == rows.select("digest").distinct().count()
    more = stored(exact.digests(spark.createDataFrame([(99, "new text"), (98, "one")], "doc_id long, text string")))
    found = {row["id"]: (row["kept"], row["keep_id"]) for row in exact.deduplicate(more, again).collect()}
    assert found == {99: (True, 99), 98: (False, 4)}


def test_a_batch_that_failed_after_its_addition_runs_again(spark, awkward):
    index = exact.new_index(spark)
    before = stored(exact.digests(spark.createDataFrame([(98, "one"), (97, "other")], "doc_id long, text string")))
    exact.deduplicate(before, index, "before")
    rows = stored(exact.digests(awkward))
    index.add(rows, "broken off")  # the addition is there, the result is not
    size = index.table().count()
    again = ordered(exact.deduplicate(rows, index, "broken off").collect())
    assert index.table().count() == size
    assert again == ordered(exact.deduplicate(rows, index, "broken off").collect())
    other = exact.new_index(spark)
    exact.deduplicate(before, other, "before")
    assert again == ordered(exact.deduplicate(rows, other, "at once").collect())


def test_compacted_index_has_a_sorted_file_per_bucket(spark, monkeypatch):
    monkeypatch.setattr(exact, "LEAST_BUCKETS", 2)
    monkeypatch.setattr(exact, "BUCKET_ROWS", 50)
    index = exact.new_index(spark)
    for i in range(10):
        rows = spark.range(15 * i, 15 * i + 20).selectExpr("id as doc_id", "cast(id as string) as text")
        index.add(stored(exact.digests(rows)))
    whole = index.compacted()
    assert (index.buckets, whole.buckets) == (2, 4) and exact.DigestIndex(spark, whole.name, whole.path).buckets == 4
    assert ordered(whole.table().collect()) == ordered(index.table().collect()) and whole.table().count() == 155
    files = sorted(Path(whole.path).glob("*.parquet"))
    assert len(files) == 4
    for file in files:
        digests = [row["digest"] for row in spark.read.parquet(str(file)).collect()]
        assert digests and digests == sorted(digests)
    repeated = stored(exact.digests(spark.createDataFrame([(500, "7"), (501, "new")], "doc_id long, text string")))
    found = {row["id"]: (row["kept"], row["keep_id"]) for row in exact.deduplicate(repeated, whole).collect()}
    assert found == {500: (False, 7), 501: (True, 501)}


def test_keep_first_keeps_columns_and_one_row(awkward):
    kept = exact.keep_first(awkward)
    assert kept.columns == awkward.columns
    wanted = [(row[0],) for row in brute(awkward_rows()) if row[3]]
    assert ordered(kept.select("doc_id").collect()) == ordered(wanted)


def test_empty_table(nothing):
    assert exact.keep_first(nothing).count() == 0
