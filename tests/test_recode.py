import datetime as dt

from psephos.operators.recode import age_at_year, band, map_values, parse_date, recode
from psephos.operators.shape import drop_in
from psephos.plans import config as c


def test_outcome(one_column, by_id):
    labels = [" ELEITO POR QP ", "ELEITO", "SUPLENTE", "#NULO#", " #NULO", None, "ELEITO POR MÉDIA"]
    df = recode(
        one_column(labels), "value", c.OUTCOME_GROUPS, default=c.NOT_ELECTED,
        null_values=c.OUTCOME_NULLS, trim=True,
    )
    no, yes = c.NOT_ELECTED, c.ELECTED
    assert by_id(df, "value") == [yes, no, no, None, None, no, yes]


def test_null_can_have_its_own_label(one_column, by_id):
    df = recode(one_column(["a", None]), "value", {"A": ["a"]}, default="rest", null_as="unknown")
    assert by_id(df, "value") == ["A", "unknown"]
    df = recode(one_column(["a", None, "b"]), "value", {"A": ["a"]}, default="rest", null_as=None)
    assert by_id(df, "value") == ["A", None, "rest"]


def test_education_keeps_other_labels(one_column, by_id):
    df = recode(one_column(["LÊ E ESCREVE", "ANALFABETO", None]), "value", c.EDUCATION_GROUPS)
    assert by_id(df, "value") == ["Até EF", "ANALFABETO", None]


def test_marital(one_column, by_id):
    labels = ["VIÚVO(A)", None, "CASADO(A)"]
    df = recode(one_column(labels), "value", c.MARITAL_GROUPS, default=c.MARITAL_OTHER)
    assert by_id(df, "value") == ["OUTRO", "OUTRO", "CASADO(A)"]


def test_race(one_column):
    labels = ["#NE#", None, "AMARELA", "OUTRA", "INDÍGENA"]
    known = drop_in(one_column(labels), "value", c.RACE_UNKNOWN)
    df = recode(known, "value", c.RACE_GROUPS, default=None)
    assert sorted(map(tuple, df.collect())) == [(2, "BRANCA"), (3, None), (4, "NÃO BRANCA")]


def test_party_and_region(one_column, by_id):
    df = recode(
        one_column(["PT", "pt", "REDE", "XYZ", None]), "value", c.SPECTRUM_PARTIES, default=None, out="s"
    )
    assert by_id(df, "s") == ["Esquerda", None, "Centro", None, None]
    states = {state: region for region, states in c.REGION_STATES.items() for state in states}
    df = map_values(one_column(["DF", "ZZ", None]), "value", states, "r", c.REGION_UNKNOWN)
    assert by_id(df, "r") == ["CENTRO-OESTE", "DESCONHECIDA", "DESCONHECIDA"]


def test_dates_and_ages(one_column, by_id):
    df = parse_date(one_column(["05/06/1980", "31/02/2000", "", None, "1980-06-05"]), "value", c.DATE_FORMAT, "d")
    df = age_at_year(df.selectExpr("*", "2018 AS year"), "year", "d", "age", "born")
    assert by_id(df, "d") == [dt.date(1980, 6, 5), None, None, None, None]
    assert by_id(df, "age") == [38, None, None, None, None]


def test_age_bands(one_column, by_id):
    ages = [17, 29, 30, 44, 45, 59, 60, None]
    df = band(one_column(ages, "int"), "value", c.AGE_EDGES, c.AGE_LABELS, c.AGE_UNKNOWN, "band")
    low, mid, high, top = c.AGE_LABELS
    assert by_id(df, "band") == [low, low, mid, mid, high, high, top, c.AGE_UNKNOWN]
