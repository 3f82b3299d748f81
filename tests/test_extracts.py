"""What the queries that write extracts move and store."""
from datetime import datetime

import pytest

from checks import inputs, queries


@pytest.fixture
def folder(spark, tmp_path):
    days = [datetime(1996 + i % 6, 1 + i % 12, 1 + i % 28) for i in range(60)]
    lines = [(i % 20, i % 9, i, 1 + i % 7, float(45 + i % 6), i % 11 / 100, i % 9 / 100, "RAN"[i % 3], "FO"[i % 2], days[i]) for i in range(60)]
    orders = [(i, "FOP"[i % 3], days[i], ["1-URGENT", "3-MEDIUM", "5-LOW"][i % 3]) for i in range(20)]
    parts = [(i, f"{word} gear", f"Brand#{1 + i}", kind, 20 + i) for i, (word, kind) in enumerate(zip(["hot", "cold", "red", "new", "old"] * 2, ["PROMO", "ECONOMY", "SMALL"] * 3))]
    for name, rows, columns in (
        ("lineitem", lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"),
        ("orders", orders, "o_orderkey long, o_orderstatus string, o_orderdate timestamp, o_orderpriority string"),
        ("part", parts, "p_partkey long, p_name string, p_brand string, p_type string, p_size int"),
    ):
        spark.createDataFrame(rows, columns).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_lines_move_without_texts(spark, folder):
    """Only what a part says in words goes through a shuffle as text."""
    found = inputs.candidates(spark, folder)
    texts = {name for name, kind in found.dtypes if kind == "string"}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = inputs.candidates(spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    joined = plan[plan.index("Join") :]  # below the projection that names the codes
    assert {"DS_CARGO", "DS_GENERO", "DS_COR_RACA", "DS_ESTADO_CIVIL", "SG_UF"} <= texts
    assert not any(f" AS {name}#" in joined for name in ("DS_CARGO", "DS_ESTADO_CIVIL", "ANO_ELEICAO"))
    lines = joined[joined.index("l_orderkey") :]
    assert " AS gender#" in lines and " AS outcome#" in lines


@pytest.mark.parametrize("name", ["extracts_mixed_order", "extracts_round_trip"])
def test_extracts_are_packed_and_whole(spark, folder, tmp_path, monkeypatch, name):
    place = tmp_path / "place"
    monkeypatch.setattr(queries, "scratch_folder", lambda session, kind: str(place))
    found = queries.QUERIES[name](spark, folder)
    files = [path.name for path in place.rglob("part-*")]
    assert files and all(name.endswith(".csv.gz") for name in files)
    raw = inputs.candidates(spark, folder).toPandas()
    assert len(raw) == 60
    counted = found.toPandas()
    assert counted["n"].sum() == 60 and counted["numbers"].sum() == raw["NR_CANDIDATO"].sum()


def test_mixed_order_joins_once(spark, folder, monkeypatch):
    kept, plain = [], queries.stored
    monkeypatch.setattr(queries, "stored", lambda df: kept.append(df) or plain(df))
    assert queries.extracts_mixed_order(spark, folder).count() > 0
    assert len(kept) == 1
