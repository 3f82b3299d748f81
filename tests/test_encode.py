import pytest

from psephos.operators.encode import (
    decode_labels,
    discover_categories,
    encode_binary,
    encode_ordinal,
    one_hot,
)
from psephos.operators.shape import clean_column_names, clean_name, select_columns, union_extracts


def test_binary_and_ordinal(one_column, by_id):
    assert by_id(encode_binary(one_column(["M", "F", None]), "value", "M"), "value") == [1, 0, 0]
    codes = encode_ordinal(one_column(["a", "b", "z", None]), "value", {"a": 1, "b": 2})
    assert by_id(codes, "value") == [1, 2, 0, 0]


def test_one_hot_drops_the_first_or_the_named_category(one_column, by_id):
    df = one_column(["b", "a", "c", None, "z"])
    first = one_hot(df, "value", ["c", "b", "a"])
    assert first.columns == ["id", "value_b", "value_c"]
    assert by_id(first, "value_b") == [1, 0, 0, 0, 0]
    named = one_hot(df, "value", ["a", "b", "c"], reference="b", drop_original=False)
    assert named.columns == ["id", "value", "value_a", "value_c"]
    assert one_hot(df, "value", ["a", "b"], reference=None).columns == ["id", "value_a", "value_b"]
    with pytest.raises(ValueError, match="q is not among"):
        one_hot(df, "value", ["a", "b"], reference="q")


def test_dummies_and_reference_add_up(one_column):
    df = one_hot(one_column(["a", "b", "c", "a"]), "value", ["a", "b", "c"], reference=None)
    assert all(row.value_a + row.value_b + row.value_c == 1 for row in df.collect())


def test_discovery_is_sorted_and_bounded(spark):
    df = spark.createDataFrame([(10, "b"), (9, "a"), (None, None), (9, "b")], "n int, s string")
    assert discover_categories(df, ["n", "s"]) == {"n": [9, 10], "s": ["a", "b"]}
    with pytest.raises(ValueError, match="more than 3"):
        discover_categories(df, ["n", "s"], limit=3)


def test_labels(spark):
    df = spark.createDataFrame([("x", 1), ("x", 2), ("y", 1), ("x", None)], "v string, c int")
    rows = decode_labels(df, "v", "c", {"x": {1: "one"}}).collect()
    assert sorted((r.v, r.c or "") for r in rows) == [("x", ""), ("x", "2"), ("x", "one"), ("y", "1")]


def test_names(spark):
    cleaned = {
        "DS_ESTADO_CIVIL_CASADO(A)": "DS_ESTADO_CIVIL_CASADOA",
        "REGIAO_CENTRO-OESTE": "REGIAO_CENTRO_OESTE", "Até Sup.": "Ate_Sup", "18–29": "18_29",
        "60+": "60_mais",
    }
    assert {name: clean_name(name) for name in cleaned} == cleaned
    with pytest.raises(ValueError, match="coincide"):
        clean_column_names(spark.createDataFrame([(1, 2)], "`a.` int, a int"))


def test_columns_and_union(spark):
    a = spark.createDataFrame([(1, "x")], "n int, s string")
    b = spark.createDataFrame([("x", 1)], "s string, n int")
    c = spark.createDataFrame([(2,)], "n int")
    rows = union_extracts([a, b, c]).collect()
    assert sorted((r.n, r.s or "") for r in rows) == [(1, "x"), (1, "x"), (2, "")]
    with pytest.raises(ValueError, match="not found: q"):
        select_columns(a, ["n", "q"])
