"""From raw extracts to the coded feature table."""
from __future__ import annotations

from pyspark.sql import DataFrame

from psephos.operators.encode import encode_binary, encode_ordinal, one_hot
from psephos.operators.flags import any_flag, flag_by_patterns
from psephos.operators.profile import (
    category_summary,
    count_by,
    frequency,
    profile_frequencies,
)
from psephos.operators.recode import age_at_year, band, map_values, parse_date, recode
from psephos.operators.shape import drop_in, drop_null, keep_in, select_columns
from psephos.plans import config as c


def build_cohort(raw: DataFrame) -> DataFrame:
    """Candidates for the offices studied, flagged and recoded: one projection over the scan."""
    df = keep_in(select_columns(raw, c.RAW_SCHEMA.names), "DS_CARGO", c.OFFICES)

    df = flag_by_patterns(df, "NM_URNA_CANDIDATO", c.RELIGIOUS_NAMES, "_name")
    df = flag_by_patterns(df, "DS_OCUPACAO", c.RELIGIOUS_OCCUPATIONS, "_occupation")
    df = any_flag(df, ["_name", "_occupation"], "RELIGIOSOS")
    df = flag_by_patterns(df, "NM_URNA_CANDIDATO", c.SECURITY_NAMES, "_name")
    df = flag_by_patterns(df, "DS_OCUPACAO", c.SECURITY_OCCUPATIONS, "_occupation")
    df = any_flag(df, ["_name", "_occupation"], "SEGURANCA")

    df = recode(
        df, c.TARGET, c.OUTCOME_GROUPS, default=c.NOT_ELECTED, null_values=c.OUTCOME_NULLS, trim=True
    )
    df = drop_null(df, c.TARGET)
    df = keep_in(df, "DS_GENERO", c.GENDERS)
    df = recode(df, "DS_GRAU_INSTRUCAO", c.EDUCATION_GROUPS)
    df = recode(df, "DS_ESTADO_CIVIL", c.MARITAL_GROUPS, default=c.MARITAL_OTHER)
    df = drop_in(df, "DS_COR_RACA", c.RACE_UNKNOWN)
    df = recode(df, "DS_COR_RACA", c.RACE_GROUPS, default=None)

    df = recode(df, "SG_PARTIDO", c.SPECTRUM_PARTIES, default=None, out="ESPECTRO_POL")
    df = parse_date(df, "DT_NASCIMENTO", c.DATE_FORMAT, "DT_NASCIMENTO_DATE")
    df = age_at_year(df, c.PERIOD, "DT_NASCIMENTO_DATE", "IDADE", "ANO_NASCIMENTO")
    df = band(df, "IDADE", c.AGE_EDGES, c.AGE_LABELS, c.AGE_UNKNOWN, "FAIXA_ETARIA")
    return recode(df, "SG_UF", c.REGION_STATES, default=c.REGION_UNKNOWN, out="REGIAO")


def feature_table(cohort: DataFrame) -> DataFrame:
    """Coded predictors, target and year for all offices, the office first.

    Categories and references are listed, so the columns do not depend on the data: values
    outside the lists are 0 in all columns of their group.
    """
    df = select_columns(cohort, ["DS_CARGO", *c.MODEL_COLUMNS])
    df = encode_binary(df, c.TARGET, c.ELECTED)
    df = encode_binary(df, "DS_GENERO", "MASCULINO")
    df = encode_binary(df, "DS_COR_RACA", "BRANCA")
    df = encode_ordinal(df, "DS_GRAU_INSTRUCAO", c.EDUCATION_CODES)
    df = one_hot(df, "DS_GRAU_INSTRUCAO", list(c.EDUCATION_CODES.values()))
    df = encode_ordinal(df, "FAIXA_ETARIA", c.AGE_CODES)
    df = one_hot(df, "FAIXA_ETARIA", list(c.AGE_CODES.values()))
    df = one_hot(
        df, "DS_ESTADO_CIVIL", [*c.MARITAL_GROUPS, c.MARITAL_OTHER], reference="SOLTEIRO(A)"
    )
    df = one_hot(df, "ESPECTRO_POL", list(c.SPECTRUM_PARTIES))
    return one_hot(df, "REGIAO", list(c.REGION_STATES), reference="SUDESTE")


def unlisted_counts(cohort: DataFrame) -> DataFrame:
    """Rows per value and year that the coding silently treats as the reference category."""
    df = cohort.select(c.PERIOD, "ESPECTRO_POL", "REGIAO", "FAIXA_ETARIA", "DS_GRAU_INSTRUCAO")
    return count_by(
        df.filter(
            df.ESPECTRO_POL.isNull()
            | (df.REGIAO == c.REGION_UNKNOWN)
            | (df.FAIXA_ETARIA == c.AGE_UNKNOWN)
            | ~df.DS_GRAU_INSTRUCAO.isin(list(c.EDUCATION_CODES))
        ),
        df.columns,
    )


def cohort_profiles(raw: DataFrame, cohort: DataFrame) -> dict[str, DataFrame]:
    """The distributions looked at before and after recoding.  ``cohort`` should be stored."""
    recoded = [
        "DS_CARGO", "RELIGIOSOS", "SEGURANCA", c.TARGET, "DS_GENERO", "DS_GRAU_INSTRUCAO",
        "DS_ESTADO_CIVIL", "DS_COR_RACA", "ESPECTRO_POL", "FAIXA_ETARIA", "REGIAO",
    ]
    return {
        "raw_frequencies": profile_frequencies(raw, c.RAW_SCHEMA.names, top=20),
        "rows_by_year": count_by(raw, [c.PERIOD]),
        "rows_by_year_and_office": count_by(cohort, [c.PERIOD, "DS_CARGO"], sort=True),
        "states": frequency(cohort, "SG_UF", top=30),
        "cohort_summary": category_summary(cohort, recoded),
        "unlisted": unlisted_counts(cohort),
    }
