"""The driver's tables in the shape the operators expect."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from psephos.plans import config as c

# Fixed values of the adapter: what plays a state, a party, an education level.
STATES = [state for states in c.REGION_STATES.values() for state in states] + ["ZZ"]
PARTIES = [
    "PT", "PSOL", "PDT", "PC do B", "REDE", "PV", "PL", "PSD", "MDB", "PP", "NOVO", "DEM", "PSDB",
    "PTB", "AVANTE", "PODE", "PSC", "PRTB", "DC", "PMN", "UNIÃO", "PATRIOTA", "XYZ", "pt", "CIDADANIA",
]
EDUCATION = [label for labels in c.EDUCATION_GROUPS.values() for label in labels]
RACES = [
    "#NE#", "BRANCA", "BRANCA", "BRANCA", "AMARELA", "PARDA", "PARDA", "PRETA", "INDÍGENA", "OUTRA",
    "NÃO INFORMADO",
]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), index.cast("int") + 1)


def _code(*conditions: Column) -> Column:
    """The place of the first condition that holds, or their number."""
    return reduce(lambda rest, i: F.when(conditions[i], i).otherwise(rest), reversed(range(len(conditions))), F.lit(len(conditions))).cast("tinyint")


def _named(code: str, *values: object) -> Column:
    """The value that a code of :func:`_code` stands for."""
    return reduce(lambda rest, i: F.when(F.col(code) == i, values[i]).otherwise(rest), reversed(range(len(values) - 1)), F.lit(values[-1]))


def candidates(spark: SparkSession, folder: str) -> DataFrame:
    """One candidate record per line item, with the columns of the extracts.

    What depends on the order, the part or the line alone is derived before the joins, labels of lines and orders
    as small codes that are named after them, so that a line moves in few bytes.  Orders and parts are unique by key, so a key shared by
    many line items only makes one side of the join heavy, which adaptive execution splits.
    """
    year = F.year("o_orderdate")
    orders = table(spark, folder, "orders").select(
        "o_orderkey",
        _code(year <= 1997, year <= 1999).alias("year"),
        _code(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), F.col("o_orderpriority").isin("3-MEDIUM", "4-NOT SPECIFIED")).alias("office"),
        _code(F.col("o_orderstatus") == "F", F.col("o_orderstatus") == "O").alias("marital"),
    )
    word = F.split_part("p_name", F.lit(" "), F.lit(1))
    noun = F.upper(F.split_part("p_name", F.lit(" "), F.lit(2)))
    brand = F.split_part("p_brand", F.lit("#"), F.lit(2)).cast("int")
    parts = table(spark, folder, "part").select(
        "p_partkey",
        "p_size",
        F.upper("p_name").alias("NM_CANDIDATO"),
        F.when(word == "hot", F.concat(F.lit("PASTOR "), noun))
        .when(word == "cold", F.concat(F.lit("CABO "), noun))
        .when(word == "red", F.concat(noun, F.lit(" PM")))
        .when(word == "new", F.concat(F.lit("IRMÃO "), noun))
        .otherwise(F.upper("p_name")).alias("NM_URNA_CANDIDATO"),
        brand.alias("NR_PARTIDO"),
        _pick(PARTIES, brand - 1).alias("SG_PARTIDO"),
        F.col("p_brand").alias("NM_PARTIDO"),
        F.when(F.col("p_type") == "PROMO", "POLICIAL MILITAR")
        .when(F.col("p_type") == "ECONOMY", "SACERDOTE OU MEMBRO DE ORDEM OU SEITA RELIGIOSA")
        .otherwise(F.col("p_type")).alias("DS_OCUPACAO"),
    )
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey",
        "l_partkey",
        "l_linenumber",
        F.col("l_shipdate").cast("date").alias("day"),
        (F.col("l_suppkey") % 28).cast("tinyint").alias("state"),
        _code(F.col("l_tax") == 0.08, F.col("l_linestatus") == "F").alias("gender"),
        _code(F.col("l_quantity") == 50).alias("education"),
        F.round(F.col("l_discount") * 100).cast("int").alias("race"),
        _code(F.col("l_tax") == 0.07, F.col("l_returnflag") == "R", F.col("l_returnflag") == "A").alias("outcome"),
    )
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(parts, F.col("l_partkey") == F.col("p_partkey"))
    return rows.select(
        _named("year", 2014, 2018, 2022).alias("ANO_ELEICAO"),
        _pick(STATES, F.col("state")).alias("SG_UF"),
        _named("office", c.STATE, c.FEDERAL, "SENADOR").alias("DS_CARGO"),
        # The 29th of February falls into years without one, which makes unreadable dates.
        F.concat(
            F.date_format("day", "dd/MM/"),
            (F.year("day") - F.col("p_size")).cast("string"),
        ).alias("DT_NASCIMENTO"),
        F.col("l_linenumber").alias("NR_CANDIDATO"),
        "NM_CANDIDATO", "NM_URNA_CANDIDATO", "NR_PARTIDO", "SG_PARTIDO", "NM_PARTIDO",
        _named("gender", "NÃO DIVULGÁVEL", "FEMININO", "MASCULINO").alias("DS_GENERO"),
        F.when(F.col("education") == 0, "ANALFABETO")
        .otherwise(_pick(EDUCATION, F.col("l_linenumber") - 1)).alias("DS_GRAU_INSTRUCAO"),
        _named("marital", "CASADO(A)", "SOLTEIRO(A)", "VIÚVO(A)").alias("DS_ESTADO_CIVIL"),
        _pick(RACES, F.col("race")).alias("DS_COR_RACA"),
        "DS_OCUPACAO",
        _named("outcome", "#NULO#", " ELEITO POR QP ", "SUPLENTE", None).alias("DS_SIT_TOT_TURNO"),
    )


def scored_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as labelled scores: an 11-valued and a nearly continuous score in 0..1."""
    price = F.col("l_extendedprice")
    return table(spark, folder, "lineitem").select(
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("label"),
        F.when(F.col("l_linestatus") == "O", 1).otherwise(0).alias("pred"),
        (F.col("l_discount") * 10).alias("score"),
        (price / 131072).alias("fine_score"),
        F.col("l_quantity").alias("quantity"),
        (F.col("l_tax") * 100).alias("tax"),
    )
