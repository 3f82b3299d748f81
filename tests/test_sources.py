import pytest
from pyspark.sql import types as T

from psephos.sources import (
    read_extracts,
    read_table,
    scratch_folder,
    stored,
    write_report,
    write_table,
)

SCHEMA = T.StructType([T.StructField("ANO", T.IntegerType()), T.StructField("NOME", T.StringType())])


def test_extracts_follow_their_own_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text('"NOME";"EXTRA";"ANO"\n"JOÃO; FILHO";"1";"2014"\n"";"2";"2014"\n', "latin-1")
    (tmp_path / "b.csv").write_text('ANO;NOME\n2018;IRMÃ\n', "latin-1")
    df = read_extracts(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")], SCHEMA)
    assert df.schema.simpleString() == "struct<ANO:int,NOME:string>"
    rows = sorted((tuple(row) for row in df.collect()), key=str)
    assert rows == [(2014, "JOÃO; FILHO"), (2014, None), (2018, "IRMÃ")]


def test_absent_column_is_an_error(spark, tmp_path):
    (tmp_path / "a.csv").write_text("ANO;OUTRO\n2014;x\n", "latin-1")
    with pytest.raises(ValueError, match="NOME"):
        read_extracts(spark, [str(tmp_path / "a.csv")], SCHEMA)


def test_unread_columns_are_pruned(spark, tmp_path):
    (tmp_path / "a.csv").write_text("A;ANO;B;NOME\n1;2014;2;x\n", "latin-1")
    plan = read_extracts(spark, [str(tmp_path / "a.csv")], SCHEMA)._jdf.queryExecution().toString()
    assert "ReadSchema: struct<ANO:int,NOME:string>" in plan


def test_tables_and_reports(spark, tmp_path):
    df = spark.createDataFrame([(2014, "a"), (2018, None)], SCHEMA)
    stored = read_table(spark, write_table(df, str(tmp_path / "t"), ["ANO"]))
    plan = stored.filter("ANO = 2014")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(ANO" in plan
    assert sorted(map(str, stored.select("ANO", "NOME").collect())) == sorted(map(str, df.collect()))
    path = write_report(df, str(tmp_path / "r"), fmt="csv")
    assert spark.read.csv(path, header=True).count() == 2
    with pytest.raises(ValueError, match="unknown report format"):
        write_report(df, str(tmp_path / "x"), fmt="xls")


def test_intermediate_tables_go_to_the_named_folder(spark):
    named = spark.conf.get("spark.checkpoint.dir")
    assert scratch_folder(spark, "x").startswith(f"{named}/x-")
    assert scratch_folder(spark, "x") != scratch_folder(spark, "x")
    df = spark.range(10).selectExpr("id % 3 AS k", "id").groupBy("k").count()
    kept = stored(df)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and named in plan
    assert kept.schema.simpleString() == df.schema.simpleString()
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, df.collect()))


def test_a_cluster_must_name_the_folder():
    class Context:
        master = "spark://somewhere"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_folder(Session(), "x")


def test_other_column_order_in_one_folder_is_an_error(spark, tmp_path):
    (tmp_path / "a.csv").write_text("ANO;NOME\n2014;x\n", "latin-1")
    (tmp_path / "b.csv").write_text("NOME;ANO\ny;2018\n", "latin-1")
    with pytest.raises(Exception, match="(?i)header"):
        read_extracts(spark, [str(tmp_path)], SCHEMA).collect()


def test_reports_are_sorted_as_asked(spark, tmp_path):
    df = spark.range(0, 1000, 1, 7).selectExpr("CAST((id * 37) % 1000 AS int) AS ANO", "'x' AS NOME")
    path = write_report(df, str(tmp_path / "r"), fmt="csv", order=["ANO"])
    assert [int(row["ANO"]) for row in spark.read.csv(path, header=True).collect()] == list(range(1000))
