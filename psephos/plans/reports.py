"""Models and report tables per office."""
from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from psephos.operators.collinearity import independent, vif
from psephos.operators.evaluate import cutoff_sweep, evaluate, metrics_at_cutoff
from psephos.operators.forest import fit_forest, forest_importance, forest_scores, tune_forest
from psephos.operators.logit import (
    fit_logit,
    logit_scores,
    logit_table,
    odds_intervals,
    significant_effects,
)
from psephos.operators.profile import (
    category_summary,
    count_by,
    count_flags,
    event_rates,
    positives_by_period,
)
from psephos.operators.shape import (
    clean_column_names,
    collapse,
    feature_columns,
    keep_in,
    split_by_period,
)
from psephos.operators.weights import balanced_weights
from psephos.plans import config as c
from psephos.plans.cohort import build_cohort, cohort_profiles, feature_table
from psephos.sources import read_extracts, read_table, stored, write_report, write_table

ROWS = "n"
REPORTS_AT_ONCE = 8

#: Reports whose rows have an order of their own.
SORTED = {
    "raw_frequencies", "rows_by_year_and_office", "states", "cohort_summary", "category_summary",
    "logit_coefficients", "logit_effects", "logit_odds", "vif",
}


def cohort_reports(cohort: DataFrame) -> dict[str, DataFrame]:
    """Flag counts and elected candidates per year of one office."""
    elected = positives_by_period(cohort, c.PERIOD, c.FLAGS, c.TARGET, c.ELECTED)
    names = {"RELIGIOSOS": "RELIGIOSOS_ELEITOS", "SEGURANCA": "SEGURANCA_ELEITOS"}
    return {
        "flag_counts": count_flags(cohort, c.FLAGS),
        "elected_by_year": elected.withColumnsRenamed({**names, "total": "TOTAL_CATEGORIAS"}),
    }


def descriptive_reports(merged: DataFrame) -> dict[str, DataFrame]:
    """Category summary, class counts and event rates of merged feature rows."""
    variables = feature_columns(merged, [ROWS])
    summary = category_summary(merged, list(c.LABELS), c.LABELS, ROWS)
    return {
        "category_summary": summary.withColumnsRenamed(
            {"variable": "variavel", "category": "categoria", "percent": "percentual (%)"}
        ),
        "class_counts": count_by(merged, [c.TARGET], ROWS),
        "event_rates": event_rates(merged, variables, c.TARGET, max_classes=2, weight=ROWS),
    }


def forest_reports(
    features: DataFrame,
    merged: DataFrame,
    params: Mapping = c.FOREST,
    grid: Mapping[str, Sequence] | None = None,
    folds: int = c.FOLDS,
) -> dict[str, DataFrame]:
    """Forest as given and, with a ``grid``, the tuned one: metrics, ROC, importances.

    Only the folds of the search need single rows; everything else counts merged ones.
    """
    predictors = feature_columns(merged, [c.TARGET, c.PERIOD, ROWS])
    parts = split_by_period(merged, c.PERIOD, c.TRAIN_YEARS, c.TEST_YEARS)
    reports: dict[str, DataFrame] = {}
    models = {"forest": fit_forest(parts[0], predictors, c.TARGET, params, ROWS)}
    if grid is not None:
        train, _ = split_by_period(features, c.PERIOD, c.TRAIN_YEARS, c.TEST_YEARS)
        models["tuned"], reports["tuning"] = tune_forest(
            train, predictors, c.TARGET, grid, folds
        )
    for name, model in models.items():
        for part, rows in zip(("train", "test"), parts):
            tables = evaluate(
                forest_scores(model, rows), c.TARGET, "score", "prediction", ROWS
            )
            reports.update({f"{name}_{part}_{key}": table for key, table in tables.items()})
        reports[f"{name}_importance"] = forest_importance(model).withColumnsRenamed(
            {"feature": "features"}
        )
    return reports


def logit_reports(merged: DataFrame, cutoff: float = 0.5) -> dict[str, DataFrame]:
    """Logit model on merged rows: collinearity, coefficients, odds, evaluation at cutoffs.

    A predictor that has one value in all training rows, or depends on the intercept and those before it, adds nothing
    to them; it is left out of the model and named in a report.
    """
    plain = clean_column_names(merged)
    named = feature_columns(plain, [c.TARGET, c.PERIOD, ROWS])
    train, test = split_by_period(plain, c.PERIOD, c.TRAIN_YEARS, c.TEST_YEARS)
    predictors = independent(train, named, ROWS)
    weighted = balanced_weights(train, c.TARGET, "_class", ROWS).withColumn(
        "_frequency", F.col("_class") * F.col(ROWS)
    )
    model = fit_logit(weighted, predictors, c.TARGET, "_frequency")
    table = logit_table(model)
    effects = significant_effects(table)
    left_out = [(name,) for name in named if name not in predictors]
    reports = {
        "logit_left_out": train.sparkSession.createDataFrame(left_out, "variavel string"),
        "vif": vif(train, predictors, ROWS).withColumnsRenamed(
            {"variable": "variavel", "vif": "VIF"}
        ),
        "logit_coefficients": table.withColumnsRenamed(
            {
                "coef": "Coef.", "std_err": "Std.Err.", "p_value": "P>|z|", "ci_low": "[0.025",
                "ci_high": "0.975]", "odds_ratio": "OR", "or_low": "OR_2.5%", "or_high": "OR_97.5%",
            }
        ),
        "logit_effects": effects.select(
            F.col("variable").alias("Variavel"), F.col("coef").alias("Coeficiente"),
            F.col("p_text").alias("P-valor"), F.col("odds_ratio").alias("OR"),
            F.col("odds_text").alias("Chances (odds)"),
            F.col("probability_percent").alias("Probabilidade (%)"),
        ),
        "logit_odds": odds_intervals(table),
    }
    for part, rows in (("train", train), ("test", test)):
        scored = stored(
            logit_scores(model, rows).withColumn(
                "prediction", (F.col("score") >= cutoff).cast("int")
            )
        )
        tables = evaluate(scored, c.TARGET, "score", "prediction", ROWS)
        reports.update({f"logit_{part}_{key}": table for key, table in tables.items()})
        reports[f"logit_{part}_cutoff"] = metrics_at_cutoff(
            scored, c.TARGET, "score", cutoff, ROWS
        ).select(
            F.col("tp").alias("VP"), F.col("fp").alias("FP"), F.col("tn").alias("VN"),
            F.col("fn").alias("FN"), F.col("accuracy").alias("Acurácia"),
            F.col("sensitivity").alias("Sensibilidade (Recall)"),
            F.col("specificity").alias("Especificidade"), F.col("precision").alias("Precision"),
            F.col("f1").alias("F1-score"),
        )
        reports[f"logit_{part}_sweep"] = cutoff_sweep(
            scored, c.TARGET, "score", weight=ROWS
        ).withColumnsRenamed(
            {"cutoff": "cutoffs", "sensitivity": "sensitividade", "specificity": "especificidade"}
        )
    return reports


def office_reports(
    cohort: DataFrame,
    features: DataFrame,
    params: Mapping = c.FOREST,
    grid: Mapping[str, Sequence] | None = None,
    folds: int = c.FOLDS,
) -> dict[str, DataFrame]:
    """All report tables of one office from its stored cohort and feature rows.

    The feature rows are merged once; only the folds of a search go back to single rows.
    """
    columns = feature_columns(features, ["DS_CARGO"])
    merged = stored(collapse(features, columns, ROWS))
    return {
        **cohort_reports(cohort),
        **descriptive_reports(merged),
        **forest_reports(features, merged, params, grid, folds),
        **logit_reports(merged),
    }


def run_analysis(
    spark: SparkSession,
    extracts: Sequence[str],
    folder: str,
    offices: Sequence[str] = c.OFFICES,
    params: Mapping = c.FOREST,
    grids: Mapping[str, Mapping[str, Sequence]] | None = None,
    folds: int = c.FOLDS,
) -> list[str]:
    """The whole analysis: extracts to cohort, features and reports below ``folder``.

    The text files are parsed once; extracts, cohort and features are stored with the office and
    year as partitions and read back.  Pass ``config.GRIDS`` for the full search of each
    office; returns the report paths.
    """

    def kept(table: DataFrame, name: str, partition_by: Sequence[str]) -> DataFrame:
        return read_table(spark, write_table(table, f"{folder}/{name}", partition_by))

    def report(name: str, table: DataFrame) -> str:
        path = f"{folder}/reports/{name}"
        # A ROC curve has a row per distinct score, all other reports have few.
        if name.endswith("_roc"):
            return write_table(table, path)
        last = name.rsplit("/", 1)[1]
        order = [F.col(c.PERIOD).cast("string")] if last == "elected_by_year" else []
        return write_report(table, path, order=order, keep_order=last in SORTED or last.endswith("_importance"))

    def written(names: list[str], tables: list[DataFrame]) -> list[str]:
        # Each report is a small job of its own; several at once keep the executors busy.
        with ThreadPoolExecutor(REPORTS_AT_ONCE) as pool:
            return list(pool.map(report, names, tables))

    raw = kept(read_extracts(spark, extracts, c.RAW_SCHEMA), "extracts", [c.PERIOD])
    cohort = kept(build_cohort(raw), "cohort", ["DS_CARGO", c.PERIOD])
    features = kept(feature_table(cohort), "features", ["DS_CARGO", c.PERIOD])
    profiles = cohort_profiles(raw, cohort)
    paths = written([f"cohort/{name}" for name in profiles], list(profiles.values()))

    def of_office(office: str) -> list[str]:
        tables = office_reports(
            keep_in(cohort, "DS_CARGO", [office]),
            keep_in(features, "DS_CARGO", [office]),
            params,
            (grids or {}).get(office),
            folds,
        )
        place = office.lower().replace(" ", "_")
        return written([f"{place}/{name}" for name in tables], list(tables.values()))

    # Most steps of an office are small jobs on merged rows that wait for each other; another office fills the gaps.
    with ThreadPoolExecutor(max(1, len(offices))) as pool:
        for found in pool.map(of_office, offices):
            paths += found
    return paths
