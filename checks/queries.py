"""One query per operator: each takes (spark, folder) and reads whole tables."""
from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.inputs import candidates, scored_lines, table
from psephos.functions.numeric import half_even
from psephos.functions.text import percent_text, significant_text
from psephos.operators import encode, evaluate, flags, forest, logit, profile, recode, shape, weights
from psephos.operators.collinearity import vif
from psephos.operators.quantiles import quantile_bin
from psephos.plans import config as c
from psephos.plans.cohort import build_cohort, feature_table, unlisted_counts
from psephos.plans.reports import run_analysis
from psephos.sources import (
    read_extracts,
    read_table,
    scratch_folder,
    stored,
    write_report,
    write_table,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

NAME_PATTERNS = [r"^hot", r"gear$", r"lue\s", r"izm", r"^new", r"^newer", r"wid\.", r"old ring"]
TEXT_PATTERNS = [r"^The", r"^Un", r"tion\.", r"eau", r"\sder\s", r"[0-9]{4}"]


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def rounded(df: DataFrame, decimals: int, *cols: str) -> DataFrame:
    return df.withColumns({name: F.round(name, decimals) for name in cols})


# ---------------------------------------------------------------- sources and sinks


@query
def extracts_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Candidates written as one delimited Latin-1 extract per year, read back and counted."""
    raw = candidates(spark, folder).withColumn("DS_COLIGACAO", F.lit("FORA; \"COLIGAÇÃO\""))
    place = scratch_folder(spark, "extracts")
    # Text repeats its labels in every row and is packed; each task writes files of its own, so many can be read at once.
    raw.withColumn("year", F.col(c.PERIOD)).write.partitionBy("year").options(
        header=True, sep=";", encoding="iso-8859-1", compression="gzip"
    ).csv(place)
    paths = [f"{place}/year={year}" for year in [*c.TRAIN_YEARS, *c.TEST_YEARS]]
    extracts = read_extracts(spark, paths, c.RAW_SCHEMA)
    return extracts.groupBy("ANO_ELEICAO", "DS_GRAU_INSTRUCAO", "DS_SIT_TOT_TURNO").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("NR_CANDIDATO").alias("numbers"),
        F.countDistinct("NM_URNA_CANDIDATO").alias("names"),
    )


@query
def table_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Orders stored by status and read back, with partition pruning on the way."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    place = write_table(orders, scratch_folder(spark, "orders"), ["o_orderstatus"])
    kept = shape.keep_in(read_table(spark, place), "o_orderstatus", ["F", "O"])
    return kept.select("o_orderkey", F.col("o_orderstatus").cast("string"), "o_totalprice")


@query
def report_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """A report written as CSV with a header and read back."""
    counts = profile.count_by(table(spark, folder, "part"), ["p_type", "p_size"])
    place = write_report(counts, scratch_folder(spark, "report"), fmt="csv")
    return spark.read.schema("p_type string, p_size int, count bigint").csv(place, header=True)


# ---------------------------------------------------------------- shape


@query
def select_columns(spark: SparkSession, folder: str) -> DataFrame:
    return shape.select_columns(table(spark, folder, "customer"), ["c_custkey", "c_mktsegment"])


@query
def feature_columns(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    kept = shape.feature_columns(orders, ["o_totalprice", "o_orderdate", "o_custkey"])
    return shape.select_columns(orders, kept)


@query
def keep_in(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderpriority")
    return shape.keep_in(orders, "o_orderpriority", ["1-URGENT", "5-LOW"])


@query
def drop_in(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select(
        "o_orderkey", F.nullif("o_orderpriority", F.lit("5-LOW")).alias("priority")
    )
    return shape.drop_in(orders, "priority", ["1-URGENT", "2-HIGH"])


@query
def drop_null(spark: SparkSession, folder: str) -> DataFrame:
    parts = table(spark, folder, "part").select(
        "p_partkey", F.nullif("p_type", F.lit("PROMO")).alias("p_type")
    )
    return shape.drop_null(parts, "p_type")


@query
def split_by_period(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").withColumn("period", F.year("o_orderdate"))
    train, test = shape.split_by_period(orders, "period", [1995, 1996, 1997, 1998, 1999], [2000, 2001])
    parts = [
        profile.count_by(rows, ["period"]).withColumn("part", F.lit(name))
        for rows, name in ((train, "train"), (test, "test"))
    ]
    return shape.union_extracts(parts)


@query
def union_extracts(spark: SparkSession, folder: str) -> DataFrame:
    """Three extracts with different columns, counted with what is missing in each."""
    orders = table(spark, folder, "orders").withColumn("year", F.year("o_orderdate"))
    early = orders.filter("year <= 1997").select("year", "o_orderstatus", "o_totalprice")
    middle = orders.filter("year in (1998, 1999)").select("o_totalprice", "year", "o_orderpriority")
    late = orders.filter("year >= 2000").select("o_orderpriority", "o_orderstatus", "year")
    return shape.union_extracts([early, middle, late]).groupBy("year").agg(
        F.count(F.lit(1)).alias("n"), F.count("o_orderstatus").alias("status"),
        F.count("o_orderpriority").alias("priority"), F.count("o_totalprice").alias("price"),
    )


@query
def clean_names(spark: SparkSession, folder: str) -> DataFrame:
    customers = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("Até Sup."), F.col("c_nationkey").alias("18–29"),
        F.col("c_mktsegment").alias("REGIAO_CENTRO-OESTE (ç)"), F.col("c_name").alias("60+"),
    )
    return shape.clean_column_names(customers)


@query
def collapse_rows(spark: SparkSession, folder: str) -> DataFrame:
    return shape.collapse(
        table(spark, folder, "lineitem"), ["l_returnflag", "l_linestatus", "l_quantity"]
    )


# ---------------------------------------------------------------- flags


@query
def flag_patterns(spark: SparkSession, folder: str) -> DataFrame:
    parts = table(spark, folder, "part").select(
        "p_partkey", F.nullif("p_name", F.lit("old rod")).alias("p_name")
    )
    return flags.flag_by_patterns(parts, "p_name", NAME_PATTERNS, "flag")


@query
def flag_long_text(spark: SparkSession, folder: str) -> DataFrame:
    """Keyword flags over whole document texts, counted per language."""
    documents = table(spark, folder, "documents").select("lang", "source", "text")
    flagged = flags.flag_by_patterns(documents, "text", TEXT_PATTERNS, "flag")
    return profile.count_by(flagged, ["lang", "source", "flag"])


@query
def flag_occupation(spark: SparkSession, folder: str) -> DataFrame:
    parts = table(spark, folder, "part").select("p_partkey", "p_type")
    return flags.flag_by_patterns(parts, "p_type", ["SMAL", "ECONOMY"], "flag")


@query
def any_flag(spark: SparkSession, folder: str) -> DataFrame:
    parts = table(spark, folder, "part").select("p_partkey", "p_name", "p_type")
    parts = flags.flag_by_patterns(parts, "p_name", NAME_PATTERNS, "flag")
    parts = flags.flag_by_patterns(parts, "p_type", ["SMALL"], "helper")
    return flags.any_flag(parts, ["flag", "helper"], "flag")


# ---------------------------------------------------------------- recodes


@query
def recode_outcome(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select(
        "o_orderkey",
        F.concat(F.lit(" "), F.nullif("o_orderpriority", F.lit("5-LOW")), F.lit("  ")).alias("outcome"),
    )
    return recode.recode(
        orders, "outcome", {"ELEITO": ["1-URGENT", "2-HIGH"]}, default="NÃO ELEITO",
        null_values=["4-NOT SPECIFIED"], trim=True,
    )


@query
def recode_keep(spark: SparkSession, folder: str) -> DataFrame:
    customers = table(spark, folder, "customer").select(
        "c_custkey", F.nullif("c_mktsegment", F.lit("MACHINERY")).alias("segment")
    )
    return recode.recode(
        customers, "segment", {"home": ["HOUSEHOLD", "FURNITURE"], "site": ["BUILDING"]}
    )


@query
def recode_default(spark: SparkSession, folder: str) -> DataFrame:
    customers = table(spark, folder, "customer").select(
        "c_custkey", F.nullif("c_mktsegment", F.lit("MACHINERY")).alias("segment")
    )
    return recode.recode(
        customers, "segment", {"HOUSEHOLD": ["HOUSEHOLD"], "BUILDING": ["BUILDING"]}, default="OUTRO"
    )


@query
def recode_race(spark: SparkSession, folder: str) -> DataFrame:
    """Unknown and null labels dropped, then two groups, anything else null."""
    parts = table(spark, folder, "part").select(
        "p_partkey", F.nullif("p_type", F.lit("PROMO")).alias("p_type")
    )
    known = shape.drop_in(parts, "p_type", ["ECONOMY"])
    return recode.recode(known, "p_type", {"L": ["LARGE", "MEDIUM"], "S": ["SMALL"]}, default=None)


@query
def map_values(spark: SparkSession, folder: str) -> DataFrame:
    mapping = {f"Brand#{i}": "Esquerda" for i in range(1, 6)}
    mapping |= {f"Brand#{i}": "Centro" for i in range(6, 9)}
    mapping |= {f"Brand#{i}": "Direita" for i in range(9, 24)}
    parts = table(spark, folder, "part").select("p_partkey", "p_brand")
    return recode.map_values(parts, "p_brand", mapping, "spectrum")


@query
def map_region(spark: SparkSession, folder: str) -> DataFrame:
    regions = {f"NATION_{i}": name for i, name in enumerate(["NORTE", "SUL", "SUDESTE"] * 7)}
    customers = table(spark, folder, "customer").select(
        "c_custkey", F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string")).alias("state")
    )
    return recode.map_values(customers, "state", regions, "region", default="DESCONHECIDA")


@query
def parse_date_age(spark: SparkSession, folder: str) -> DataFrame:
    text = F.date_format(F.col("o_orderdate").cast("date"), "dd/MM/yyyy")
    orders = table(spark, folder, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderpriority") == "5-LOW", "31/02/2000")
        .when(F.col("o_orderpriority") == "2-HIGH", "")
        .when(F.col("o_orderpriority") != "3-MEDIUM", text).alias("date_text"),
        F.when(F.col("o_orderstatus") == "F", 2018).otherwise(2022).alias("year"),
    )
    dated = recode.parse_date(orders, "date_text", "dd/MM/yyyy", "born")
    return recode.age_at_year(dated, "year", "born", "age", "birth_year")


@query
def band(spark: SparkSession, folder: str) -> DataFrame:
    parts = table(spark, folder, "part").select(
        "p_partkey", F.nullif("p_size", F.lit(7)).alias("size")
    )
    return recode.band(
        parts, "size", [10, 25, 40], ["<10", "10–24", "25–39", "40+"], "Desconhecida", "band"
    )


# ---------------------------------------------------------------- counts and profiles


@query
def count_by(spark: SparkSession, folder: str) -> DataFrame:
    return profile.count_by(table(spark, folder, "lineitem"), ["l_returnflag"])


@query
def count_by_two(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").withColumn("year", F.year("o_orderdate"))
    return profile.count_by(orders, ["year", "o_orderpriority"], sort=True)


@query
def frequency(spark: SparkSession, folder: str) -> DataFrame:
    return profile.frequency(table(spark, folder, "part"), "p_name")


@query
def frequency_top(spark: SparkSession, folder: str) -> DataFrame:
    return profile.frequency(table(spark, folder, "lineitem"), "l_suppkey", top=30)


@query
def profile_frequencies(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("date"))
    cols = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority"]
    return profile.profile_frequencies(orders, cols, top=20)


@query
def distinct_values(spark: SparkSession, folder: str) -> DataFrame:
    return profile.distinct_values(table(spark, folder, "lineitem"), "l_partkey")


@query
def count_flags(spark: SparkSession, folder: str) -> DataFrame:
    parts = table(spark, folder, "part")
    parts = flags.flag_by_patterns(parts, "p_name", NAME_PATTERNS, "a")
    return profile.count_flags(flags.flag_by_patterns(parts, "p_type", ["SMALL"], "b"), ["a", "b"])


@query
def positives_by_period(spark: SparkSession, folder: str) -> DataFrame:
    """Returned lines per ship year that match keywords on part name or type."""
    lines = table(spark, folder, "lineitem").join(
        table(spark, folder, "part"), F.col("l_partkey") == F.col("p_partkey")
    )
    lines = lines.withColumn("period", F.nullif(F.year("l_shipdate"), F.lit(1997)))
    lines = flags.flag_by_patterns(lines, "p_name", NAME_PATTERNS, "a")
    lines = flags.flag_by_patterns(lines, "p_type", ["SMALL"], "b")
    return profile.positives_by_period(lines, "period", ["a", "b"], "l_returnflag", "R")


@query
def category_summary(spark: SparkSession, folder: str) -> DataFrame:
    parts = table(spark, folder, "part").withColumn("p_size", F.nullif("p_size", F.lit(7)))
    labels = {"p_type": {"SMALL": "pequeno"}, "p_size": {1: "um"}}
    return profile.category_summary(parts, ["p_type", "absent", "p_size", "p_brand"], labels)


@query
def event_rate_by(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").select(
        "l_suppkey", F.nullif("l_returnflag", F.lit("N")).alias("flag"), "l_linestatus"
    )
    rates = profile.event_rate_by(lines, "l_linestatus", "flag", 5, positive="R", negative="A")
    return rounded(rates, 9, "rate", "ci_low", "ci_high")


@query
def event_rate_quantiles(spark: SparkSession, folder: str) -> DataFrame:
    lines = scored_lines(spark, folder)
    rates = profile.event_rates(lines, ["quantity", "fine_score", "pred", "tax"], "label", 2)
    return rounded(rates.drop("category"), 9, "lower", "upper", "rate", "ci_low", "ci_high")


@query
def quantile_bins(spark: SparkSession, folder: str) -> DataFrame:
    customers = table(spark, folder, "customer").select("c_custkey", "c_acctbal")
    binned = quantile_bin(customers, "c_acctbal", 7, "bin")
    return rounded(binned.drop("bin"), 6, "bin_lower", "bin_upper")


@query
def missing_report(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").select(
        F.nullif("l_returnflag", F.lit("R")).alias("flag"),
        F.when(F.col("l_quantity") > 45, F.lit(float("nan"))).otherwise(F.col("l_quantity")).alias("quantity"),
        "l_orderkey",
    )
    return rounded(profile.missing_report(lines), 9, "share")


@query
def calibration_by(spark: SparkSession, folder: str) -> DataFrame:
    rates = profile.calibration_by(scored_lines(spark, folder), "quantity", "label", "fine_score", 4)
    return rounded(
        rates.drop("category"), 9, "lower", "upper", "observed", "ci_low", "ci_high", "predicted"
    )


# ---------------------------------------------------------------- encoding and weights


@query
def encode_binary(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select(
        "o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("status")
    )
    return encode.encode_binary(orders, "status", "F")


@query
def encode_ordinal(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderpriority")
    codes = {"1-URGENT": 1, "2-HIGH": 2, "3-MEDIUM": 3}
    return encode.encode_ordinal(orders, "o_orderpriority", codes)


@query
def one_hot_first(spark: SparkSession, folder: str) -> DataFrame:
    parts = table(spark, folder, "part").select(
        "p_partkey", F.nullif("p_type", F.lit("PROMO")).alias("p_type")
    )
    found = encode.discover_categories(parts, ["p_type"])
    return encode.one_hot(parts, "p_type", found["p_type"])


@query
def one_hot_named(spark: SparkSession, folder: str) -> DataFrame:
    parts = table(spark, folder, "part").select("p_partkey", "p_type")
    return encode.one_hot(
        parts, "p_type", ["LARGE", "MEDIUM", "SMALL"], reference="MEDIUM", drop_original=False
    )


@query
def decode_labels(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").select(
        F.col("l_linestatus").alias("variable"), F.col("l_linenumber").alias("value")
    )
    labels = {"F": {1: "um", 2: "dois"}, "O": {1: "one"}}
    return profile.count_by(
        encode.decode_labels(lines, "variable", "value", labels), ["variable", "value"]
    )


@query
def balanced_weights(spark: SparkSession, folder: str) -> DataFrame:
    labels = table(spark, folder, "labels").select("doc_id", "quality")
    return rounded(weights.balanced_weights(labels, "quality", "weight"), 9, "weight")


@query
def vif_two(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem")
    return rounded(vif(lines, ["l_quantity", "l_extendedprice"]), 6, "vif")


# ---------------------------------------------------------------- evaluation


@query
def confusion(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.confusion(scored_lines(spark, folder), "label", "pred")


@query
def binary_metrics(spark: SparkSession, folder: str) -> DataFrame:
    metrics = evaluate.binary_metrics(scored_lines(spark, folder), "label", "pred")
    return rounded(
        metrics, 9, "accuracy", "sensitivity", "specificity", "precision", "f1", "balanced_accuracy"
    )


@query
def classification_report(spark: SparkSession, folder: str) -> DataFrame:
    report = evaluate.classification_report(scored_lines(spark, folder), "label", "pred")
    return rounded(report, 9, "precision", "recall", "f1")


@query
def roc_points(spark: SparkSession, folder: str) -> DataFrame:
    points = evaluate.roc_points(scored_lines(spark, folder), "label", "score")
    return rounded(points.drop("threshold"), 9, "fpr", "tpr")


@query
def roc_points_fine(spark: SparkSession, folder: str) -> DataFrame:
    """Nearly as many scores as rows, summed in ranges, without points on straight stretches."""
    points = evaluate.roc_points(
        scored_lines(spark, folder), "label", "fine_score", drop_collinear=True, rows_per_range=10_000
    )
    return rounded(points.drop("threshold"), 9, "fpr", "tpr")


@query
def auc_gini(spark: SparkSession, folder: str) -> DataFrame:
    area = evaluate.auc(scored_lines(spark, folder), "label", "fine_score")
    return rounded(area, 9, "auc", "gini")


@query
def metrics_at_cutoff(spark: SparkSession, folder: str) -> DataFrame:
    metrics = evaluate.metrics_at_cutoff(scored_lines(spark, folder), "label", "score", 0.5)
    return rounded(metrics, 9, "accuracy", "sensitivity", "specificity", "precision", "f1")


@query
def cutoff_sweep(spark: SparkSession, folder: str) -> DataFrame:
    sweep = evaluate.cutoff_sweep(scored_lines(spark, folder), "label", "fine_score")
    return rounded(sweep, 9, "cutoff", "sensitivity", "specificity")


@query
def normalise_score(spark: SparkSession, folder: str) -> DataFrame:
    customers = table(spark, folder, "customer").select("c_custkey", "c_acctbal")
    return rounded(evaluate.normalise_score(customers, "c_acctbal", "score"), 9, "score")


@query
def score_fallback(spark: SparkSession, folder: str) -> DataFrame:
    """The score by a probability, by a decision value, and by the prediction where there is nothing else."""
    customers = table(spark, folder, "customer").select(
        "c_custkey", F.col("c_acctbal").alias("decision"), (F.col("c_acctbal") > 0).cast("int").alias("prediction"),
        F.when(F.col("c_nationkey") > 0, F.col("c_nationkey") / 32).alias("probability"),
    )
    found = [
        evaluate.event_score(rows, "score", "probability", "decision", "prediction").select(
            F.lit(name).alias("by"), "c_custkey", "score"
        )
        for name, rows in (
            ("probability", customers), ("decision", customers.drop("probability")),
            ("prediction", customers.drop("probability", "decision")),
        )
    ]
    return rounded(found[0].unionByName(found[1]).unionByName(found[2]), 9, "score")


@query
def evaluate_summary(spark: SparkSession, folder: str) -> DataFrame:
    tables = evaluate.evaluate(scored_lines(spark, folder), "label", "score", "pred")
    return rounded(
        tables["summary"], 9, "accuracy", "sensitivity", "specificity", "precision", "f1",
        "balanced_accuracy", "auc", "gini",
    )


# ---------------------------------------------------------------- logit model


def _one_predictor(spark: SparkSession, folder: str) -> DataFrame:
    lines = scored_lines(spark, folder).select("label", "pred")
    return weights.balanced_weights(lines, "label", "weight")


@query
def logit_table(spark: SparkSession, folder: str) -> DataFrame:
    """Balanced logit model with one 0/1 predictor, which has a closed form."""
    model = logit.fit_logit(_one_predictor(spark, folder), ["pred"], "label", "weight")
    numbers = ["coef", "std_err", "z", "ci_low", "ci_high", "odds_ratio", "or_low", "or_high"]
    return rounded(logit.logit_table(model).drop("p_value"), 6, *numbers)


def _doc_model(spark: SparkSession, folder: str):
    documents = (
        table(spark, folder, "documents")
        .join(table(spark, folder, "labels"), "doc_id")
        .select(
            "doc_id", "quality", F.when(F.col("n_chars") > 1500, 1).otherwise(0).alias("long")
        )
    )
    return documents, logit.fit_logit(documents, ["long"], "quality")


@query
def significant_effects(spark: SparkSession, folder: str) -> DataFrame:
    table_ = logit.logit_table(_doc_model(spark, folder)[1])
    return logit.significant_effects(table_).drop("p_value", "p_text")


@query
def odds_intervals(spark: SparkSession, folder: str) -> DataFrame:
    intervals = logit.odds_intervals(logit.logit_table(_doc_model(spark, folder)[1]))
    return rounded(intervals, 6, "odds_ratio", "error_low", "error_high")


@query
def logit_scores(spark: SparkSession, folder: str) -> DataFrame:
    documents, model = _doc_model(spark, folder)
    return rounded(logit.logit_scores(model, documents), 6, "score")


@query
def stratum_effects(spark: SparkSession, folder: str) -> DataFrame:
    """Effects of groups of lines, of which some differ from the first group and some do not."""
    lines = table(spark, folder, "lineitem").select(
        (F.col("l_quantity") > F.when(F.col("l_linenumber") > 4, 20).otherwise(25)).cast("int").alias("large"),
        *[(F.col("l_linenumber") == i).cast("int").alias(f"line_{i}") for i in range(2, 8)],
    )
    found = logit.logit_table(logit.fit_logit(lines, [f"line_{i}" for i in range(2, 8)], "large"))
    effects = logit.significant_effects(found)
    return rounded(effects.drop("p_text"), 6, "p_value")


@query
def logit_null_target(spark: SparkSession, folder: str) -> DataFrame:
    """Rows without a target take no part in a fit, with a closed form on the others."""
    lines = table(spark, folder, "lineitem").select(
        F.when(F.col("l_returnflag") != "N", (F.col("l_returnflag") == "R").cast("int")).alias("label"),
        (F.col("l_quantity") > 20).cast("int").alias("large"),
    )
    found = logit.logit_table(logit.fit_logit(lines, ["large"], "label"))
    return rounded(found.select("variable", "coef", "std_err"), 6, "coef", "std_err")


def _in_order(report: DataFrame, spark: SparkSession, name: str) -> DataFrame:
    """A report as it stands in its file, with the place of each row."""
    path = write_report(report, scratch_folder(spark, name), keep_order=True)
    return spark.read.parquet(path).select("*", (F.col("_metadata.row_index") + 1).alias("place"))


@query
def report_order_frequency(spark: SparkSession, folder: str) -> DataFrame:
    """Frequencies come largest first, ties by value, from the file too."""
    return _in_order(profile.frequency(table(spark, folder, "part"), "p_type"), spark, "frequency")


@query
def report_order_summary(spark: SparkSession, folder: str) -> DataFrame:
    """A summary comes variable by variable as listed, numbers in their order."""
    parts = table(spark, folder, "part").select("p_type", "p_size")
    report = _in_order(profile.category_summary(parts, ["p_size", "p_type"]), spark, "summary")
    return report.select("variable", "category", "count", "place")


@query
def report_order_effects(spark: SparkSession, folder: str) -> DataFrame:
    """Odds come smallest first from the file."""
    lines = table(spark, folder, "lineitem").select(
        (F.col("l_quantity") > 5 * F.col("l_linenumber")).cast("int").alias("large"),
        *[(F.col("l_linenumber") == i).cast("int").alias(f"line_{i}") for i in range(2, 8)],
    )
    found = logit.logit_table(logit.fit_logit(lines, [f"line_{i}" for i in range(2, 8)], "large"))
    report = _in_order(logit.odds_intervals(found), spark, "odds")
    return rounded(report.select("variable", "odds_ratio", "place"), 6, "odds_ratio")


@query
def report_order_importance(spark: SparkSession, folder: str) -> DataFrame:
    """Importances come largest first, ties by name, from the file."""
    lines, predictors = _ruled(spark, folder)
    model = forest.fit_forest(
        lines.withColumn("target", F.col("open")), predictors, "target", {**c.FOREST, "max_features": "all"}
    )
    report = _in_order(forest.forest_importance(model), spark, "importance")
    return rounded(report, 9, "importance")


@query
def percent_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Shares as text, with those that lie in the middle between two results."""
    parts = table(spark, folder, "part").select("p_partkey", (F.col("p_partkey") / 2000).alias("share"))
    return parts.select(
        "p_partkey", percent_text(F.col("share"), 1).alias("one"), percent_text(F.col("share") / 8, 2).alias("two"),
        significant_text(F.col("share") / 7919, 3).alias("significant"),
    )


@query
def evaluate_missing_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Rows without score or prediction are counted and take no part in the summary."""
    lines = scored_lines(spark, folder).select(
        "label", F.when(F.col("quantity") <= 40, F.col("pred")).alias("pred"), F.when(F.col("tax") < 8, F.col("score")).alias("score"),
    )
    summary = evaluate.evaluate(lines, "label", "score", "pred")["summary"]
    return rounded(summary.select("accuracy", "sensitivity", "n_missing"), 9, "accuracy", "sensitivity")


@query
def extracts_mixed_order(spark: SparkSession, folder: str) -> DataFrame:
    """Extracts whose columns stand in another order are bound by their headers."""
    raw = stored(candidates(spark, folder))  # joined once, not for each year
    place, paths = scratch_folder(spark, "mixed"), []
    for i, year in enumerate([*c.TRAIN_YEARS, *c.TEST_YEARS]):
        names = raw.columns[::-1] if i % 2 else raw.columns
        one = raw.filter(F.col(c.PERIOD) == year).select(names)
        one.write.options(header=True, sep=";", encoding="iso-8859-1", compression="gzip").csv(f"{place}/{year}")
        paths.append(f"{place}/{year}")
    extracts = read_extracts(spark, paths, c.RAW_SCHEMA)
    return extracts.groupBy("ANO_ELEICAO", "DS_GRAU_INSTRUCAO").agg(
        F.count(F.lit(1)).alias("n"), F.sum("NR_CANDIDATO").alias("numbers"), F.countDistinct("NM_URNA_CANDIDATO").alias("names"),
    )


# ---------------------------------------------------------------- the whole analysis


@query
def cohort_table(spark: SparkSession, folder: str) -> DataFrame:
    """The recoded candidates, counted by everything that was derived."""
    cohort = build_cohort(candidates(spark, folder))
    return cohort.groupBy(
        "ANO_ELEICAO", "DS_CARGO", "RELIGIOSOS", "SEGURANCA", "DS_SIT_TOT_TURNO", "DS_GENERO",
        "DS_GRAU_INSTRUCAO", "DS_ESTADO_CIVIL", "DS_COR_RACA", "ESPECTRO_POL", "FAIXA_ETARIA", "REGIAO",
    ).agg(
        F.count(F.lit(1)).alias("n"), F.sum("IDADE").alias("ages"),
        F.min("DT_NASCIMENTO_DATE").alias("first_born"), F.sum("NR_CANDIDATO").alias("numbers"),
    )


@query
def feature_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The coded feature table of both offices, equal rows merged, plain column names."""
    features = shape.clean_column_names(feature_table(build_cohort(candidates(spark, folder))))
    return shape.collapse(features, features.columns)


@query
def elected_by_year(spark: SparkSession, folder: str) -> DataFrame:
    cohort = shape.keep_in(build_cohort(candidates(spark, folder)), "DS_CARGO", [c.STATE])
    return profile.positives_by_period(cohort, c.PERIOD, c.FLAGS, c.TARGET, c.ELECTED)


@query
def unlisted_values(spark: SparkSession, folder: str) -> DataFrame:
    return unlisted_counts(build_cohort(candidates(spark, folder)))


def _features(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, list[str]]:
    features = feature_table(build_cohort(candidates(spark, folder)))
    plain = stored(
        shape.clean_column_names(shape.keep_in(features, "DS_CARGO", [c.FEDERAL]).drop("DS_CARGO"))
    )
    predictors = shape.feature_columns(plain, [c.TARGET, c.PERIOD])
    return (*shape.split_by_period(plain, c.PERIOD, c.TRAIN_YEARS, c.TEST_YEARS), predictors)


@query
def analysis_reports(spark: SparkSession, folder: str) -> DataFrame:
    """The shipped analysis from extracts to stored reports, and what those reports count.

    A row for each count of the reports that do not depend on how a model was fitted; of the
    evaluations, the rows per actual class that their matrices add up to.
    """
    place = scratch_folder(spark, "analysis")
    options = {"header": True, "sep": ";", "encoding": "iso-8859-1"}
    # One pass over the joined rows writes the extracts of all years; a year without rows gets an empty one.
    raw = candidates(spark, folder).withColumn("year", F.col(c.PERIOD))
    raw.write.partitionBy("year").options(**options).csv(f"{place}/extracts")
    written = spark.read.schema(c.RAW_SCHEMA).csv(f"{place}/extracts").inputFiles()
    paths = []
    for year in [*c.TRAIN_YEARS, *c.TEST_YEARS]:
        paths.append(f"{place}/extracts/year={year}")
        if not any(f"/year={year}/" in name for name in written):
            raw.drop("year").limit(0).write.options(**options).csv(paths[-1])
    reports = {path.split("/reports/")[1]: path for path in run_analysis(spark, paths, f"{place}/out")}

    def read(office: str, name: str) -> DataFrame:
        return spark.read.parquet(reports[f"{office.lower().replace(' ', '_')}/{name}"])

    found = []
    for office in c.OFFICES:
        flagged = read(office, "flag_counts").select(F.col("RELIGIOSOS").alias("r"), F.col("SEGURANCA").alias("s"))
        counted = {
            "flag_counts": flagged.unpivot([], ["r", "s"], "key", "n"),
            "class_counts": read(office, "class_counts").select(F.col(c.TARGET).alias("key"), F.col("count").alias("n")),
            "elected_by_year": read(office, "elected_by_year").select(
                F.col(c.PERIOD).alias("key"), F.col("TOTAL_CATEGORIAS").alias("n")
            ),
            "category_summary": read(office, "category_summary").select(
                F.concat_ws("=", "variavel", "categoria").alias("key"), F.col("count").alias("n")
            ),
        }
        for model in ("forest", "logit"):
            for part in ("train", "test"):
                cells = read(office, f"{model}_{part}_confusion").groupBy("label").agg(F.sum("count").alias("n"))
                counted[f"{model}_{part}"] = cells.withColumnRenamed("label", "key")
        found += [
            rows.select(
                F.lit(office).alias("office"), F.lit(name).alias("report"), F.col("key").cast("string").alias("key"),
                F.col("n").cast("long").alias("n"),
            )
            for name, rows in counted.items()
        ]
    return reduce(DataFrame.unionByName, found)


@query
def office_logit(spark: SparkSession, folder: str) -> DataFrame:
    """Balanced logit model of one office with all predictors."""
    train, _, predictors = _features(spark, folder)
    weighted = weights.balanced_weights(train, c.TARGET, "weight")
    return logit.logit_table(logit.fit_logit(weighted, predictors, c.TARGET, "weight"))


@query
def office_logit_totals(spark: SparkSession, folder: str) -> DataFrame:
    """At the optimum the weighted scores add up to the weighted positives, for each predictor."""
    train, _, predictors = _features(spark, folder)
    weighted = weights.balanced_weights(train, c.TARGET, "weight")
    scored = logit.logit_scores(logit.fit_logit(weighted, predictors, c.TARGET, "weight"), weighted)
    sums = scored.agg(
        F.sum(F.col("weight") * F.col("score")).alias("const"),
        *[F.sum(F.col("weight") * F.col("score") * F.col(name)).alias(name) for name in predictors],
    )
    return rounded(sums.unpivot([], sums.columns, "variable", "total"), 2, "total")


@query
def office_vif(spark: SparkSession, folder: str) -> DataFrame:
    train, _, predictors = _features(spark, folder)
    return vif(train, predictors)


@query
def forest_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Test rows per predicted class and decile of the score."""
    train, test, predictors = _features(spark, folder)
    scored = forest.forest_scores(forest.fit_forest(train, predictors, c.TARGET, c.FOREST), test)
    tenth = half_even(F.col("score"), 1).alias("tenth")
    return profile.count_by(scored.select("*", tenth), [c.TARGET, "prediction", "tenth"])


@query
def forest_importance(spark: SparkSession, folder: str) -> DataFrame:
    train, _, predictors = _features(spark, folder)
    return forest.forest_importance(forest.fit_forest(train, predictors, c.TARGET, c.FOREST))


def _ruled(spark: SparkSession, folder: str) -> tuple[DataFrame, list[str]]:
    """Lines with a target that is set if two of their columns are."""
    lines = scored_lines(spark, folder).select(
        F.col("pred").alias("open"), (F.col("quantity") > 25).cast("int").alias("many"),
        F.col("tax").cast("double").alias("tax"), F.col("score").cast("double").alias("discount"),
    )
    return lines.withColumn("wanted", F.col("open") * F.col("many")), ["open", "many", "tax", "discount"]


@query
def forest_finds_rule(spark: SparkSession, folder: str) -> DataFrame:
    """The shipped forest, trying all predictors, predicts a rule on two columns without error."""
    lines, predictors = _ruled(spark, folder)
    model = forest.fit_forest(lines, predictors, "wanted", {**c.FOREST, "max_features": "all"})
    return profile.count_by(forest.forest_scores(model, lines), ["open", "many", "wanted", "prediction"])


@query
def forest_importance_of_one(spark: SparkSession, folder: str) -> DataFrame:
    """A predictor that is the target has all the importance."""
    lines, predictors = _ruled(spark, folder)
    model = forest.fit_forest(
        lines.withColumn("target", F.col("open")), predictors, "target", {**c.FOREST, "max_features": "all"}
    )
    return rounded(forest.forest_importance(model), 9, "importance")


@query
def forest_tuning_depth(spark: SparkSession, folder: str) -> DataFrame:
    """A target that needs two columns at once needs a depth of two."""
    lines, predictors = _ruled(spark, folder)
    grid = {"trees": [20], "depth": [1, 2], "max_features": ["all"], "min_leaf": [1]}
    found = forest.tune_forest(lines, predictors, "wanted", grid)[1]
    return found.select("parameters", "best", (F.col("mean_f1") == 1).alias("without_error"))


@query
def forest_min_split(spark: SparkSession, folder: str) -> DataFrame:
    """A target that needs a second split of a small node: found with few rows to split, not with many."""
    lines = scored_lines(spark, folder).select(
        F.col("pred").alias("open"), (F.col("quantity") > 44).cast("int").alias("rare")
    )
    lines = stored(lines.withColumn("wanted", F.col("open") * F.col("rare")))
    params = {"trees": 20, "depth": 3, "max_features": "all"}
    parts = []
    for name, least in (("few", 2), ("many", lines.count() // 3)):
        model = forest.fit_forest(lines, ["open", "rare"], "wanted", {**params, "min_split": least})
        scored = forest.forest_scores(model, lines).withColumn("min_split", F.lit(name))
        parts.append(profile.count_by(scored, ["min_split", "open", "rare", "prediction"]))
    return parts[0].unionByName(parts[1])


@query
def stratified_folds(spark: SparkSession, folder: str) -> DataFrame:
    """Rows per class and fold, which differ by one at most."""
    lines = scored_lines(spark, folder).select("label", "quantity", "score")
    return profile.count_by(forest.stratified_folds(lines, "label", 5), ["label", "fold"])


@query
def forest_tuning(spark: SparkSession, folder: str) -> DataFrame:
    train, _, predictors = _features(spark, folder)
    return forest.tune_forest(train, predictors, c.TARGET, c.GRIDS[c.FEDERAL], folds=c.FOLDS)[1]
