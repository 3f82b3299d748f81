"""The registered queries on the smallest tables, against SQL where there is some."""
import pytest

import __spark_entry__ as contract
from checks.compare import connect, differences
from psephos.llm.oracles import ORACLES
from psephos.llm.queries import QUERIES
from tests.llm.cases import linked_components, ordered, without_repeats

FOLDER = "/root/testdata/sf0.001"


def test_operators_and_the_pipeline_are_registered():
    names = list(contract.queries())
    assert [sum(name.startswith(f"op{n}_") for name in names) for n in range(1, 14)] == [1] * 13
    assert "pipeline" in names and set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    result = QUERIES[name](spark, FOLDER)
    rows = [tuple(row) for row in result.collect()]
    sql = connect(FOLDER).execute(ORACLES[name])
    assert differences(rows, result.columns, sql.fetchall(), [column[0] for column in sql.description]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_one_row_per_document(spark, name):
    result = QUERIES[name](spark, FOLDER)
    ids = [row["doc_id"] for row in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id").collect()]
    assert sorted(row["doc_id"] for row in result.collect()) == sorted(ids)


def documents(spark):
    return [tuple(row) for row in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]


def test_components_equal_all_pairs(spark):
    found = QUERIES["op10_jaccard_join"](spark, FOLDER).select("doc_id", "n_shingles", "component_id")
    assert ordered(found.collect()) == ordered(linked_components(documents(spark), 3, 90))


def test_kept_words_equal_a_table_of_windows(spark):
    found = QUERIES["op6_fm_substrings"](spark, FOLDER)
    assert ordered(found.collect()) == ordered(without_repeats(documents(spark)))


def test_each_source_is_near_its_target(spark):
    rows = QUERIES["op1_source_mix"](spark, FOLDER).collect()
    sources = {row["doc_id"]: row["source"] for row in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    taken, targets = {}, {}
    for row in rows:
        assert 0 <= row["taken"] <= 2 * row["size"]
        taken[sources[row["doc_id"]]] = taken.get(sources[row["doc_id"]], 0) + row["taken"]
        targets[sources[row["doc_id"]]] = row["target"]
    assert all(abs(taken[s] - targets[s]) <= 1 for s in targets)
    assert sum(targets.values()) == pytest.approx(1.5 * sum(row["size"] for row in rows))
