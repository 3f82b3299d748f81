"""Every driver query against its SQL, on the smallest tables."""
import pytest

import __spark_entry__ as contract
from checks.compare import connect, differences
from checks.oracles import ORACLES as SQL
from checks.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def database():
    return connect(FOLDER)


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(QUERIES)
    assert set(QUERIES) - set(SQL) == {
        "office_logit", "office_vif", "forest_scores", "forest_importance", "forest_tuning"
    }


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, database, name):
    # On the smallest tables some predictors of the model do not vary.
    larger = name == "office_logit_totals"
    folder = FOLDER.replace("0.001", "0.01") if larger else FOLDER
    result = QUERIES[name](spark, folder)
    rows = [tuple(row) for row in result.collect()]
    sql = (connect(folder) if larger else database).execute(SQL[name])
    names = [column[0] for column in sql.description]
    assert differences(rows, result.columns, sql.fetchall(), names) == ""


def test_contract_holds_all():
    assert set(QUERIES) <= set(contract.queries())
    assert set(SQL) <= set(contract.oracle_sql()) <= set(contract.queries())


def test_flagship(spark):
    assert contract.entry(spark).columns == ["ANO_ELEICAO", "RELIGIOSOS", "SEGURANCA", "total"]
