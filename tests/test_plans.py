"""The shipped analysis on small extracts, and the plans that must hold at any size."""
import random

import pytest

from checks.inputs import candidates
from psephos.operators import evaluate, profile
from psephos.operators.shape import keep_in
from psephos.plans import config as c
from psephos.plans.cohort import build_cohort, feature_table
from psephos.plans.reports import office_reports, run_analysis

FEATURES = [
    "DS_CARGO", "DS_SIT_TOT_TURNO", "DS_GENERO", "DS_COR_RACA", "RELIGIOSOS", "SEGURANCA",
    "ANO_ELEICAO", "DS_GRAU_INSTRUCAO_2", "DS_GRAU_INSTRUCAO_3", "FAIXA_ETARIA_2", "FAIXA_ETARIA_3",
    "FAIXA_ETARIA_4", "DS_ESTADO_CIVIL_CASADO(A)", "DS_ESTADO_CIVIL_OUTRO", "ESPECTRO_POL_Direita",
    "ESPECTRO_POL_Esquerda", "REGIAO_CENTRO-OESTE", "REGIAO_NORDESTE", "REGIAO_NORTE", "REGIAO_SUL",
]
FOLDER = "/root/testdata/sf0.001"


def executed(df):
    """The physical plan as it was run."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


@pytest.fixture(scope="module")
def raw(spark):
    """Random candidates whose chance depends on their labels."""
    generator = random.Random(4)
    pick = generator.choice
    rows = []
    for i in range(3000):
        religious, male = generator.random() < 0.2, generator.random() < 0.6
        chance = 0.1 + 0.2 * religious + 0.1 * male
        rows.append(
            (
                pick([2014, 2018, 2022]), pick(["SP", "AC", "BA", "DF", "RS", "RJ"]),
                pick(c.OFFICES + ["SENADOR"]), f"0{pick('123456789')}/05/{generator.randrange(1940, 1996)}",
                i, f"NOME {i}", ("PASTOR " if religious else "") + pick(["JOSE", "ANA", "CABO RUI"]), 1,
                pick(["PT", "PV", "PL", "PSOL", "REDE", "MDB", "XYZ"]), "P",
                "MASCULINO" if male else "FEMININO",
                pick(["LÊ E ESCREVE", "ENSINO MÉDIO COMPLETO", "SUPERIOR COMPLETO"]),
                pick(["SOLTEIRO(A)", "CASADO(A)", "VIÚVO(A)"]), pick(["BRANCA", "PARDA", "#NE#"]),
                pick(["ADVOGADO", "POLICIAL MILITAR", "MÉDICO"]),
                "ELEITO POR QP" if generator.random() < chance else pick(["SUPLENTE", "NÃO ELEITO"]),
            )
        )
    return spark.createDataFrame(rows, c.RAW_SCHEMA).repartition(4)


def test_cohort_and_features(raw):
    cohort = build_cohort(raw)
    assert cohort.columns == [
        *c.RAW_SCHEMA.names, "RELIGIOSOS", "SEGURANCA", "ESPECTRO_POL", "DT_NASCIMENTO_DATE",
        "ANO_NASCIMENTO", "IDADE", "FAIXA_ETARIA", "REGIAO",
    ]
    assert feature_table(cohort).columns == FEATURES
    assert {r.DS_CARGO for r in cohort.select("DS_CARGO").distinct().collect()} == set(c.OFFICES)


def test_whole_analysis(spark, raw, tmp_path):
    for year in (2014, 2018, 2022):
        keep_in(raw, c.PERIOD, [year]).write.options(
            header=True, sep=";", encoding="iso-8859-1"
        ).csv(str(tmp_path / f"extract_{year}"))
    small = {"trees": [3], "depth": [2, 4], "max_features": ["sqrt"], "min_leaf": [1]}
    paths = run_analysis(
        spark, [str(tmp_path / f"extract_{year}") for year in (2014, 2018, 2022)], str(tmp_path / "out"),
        params={"trees": 5, "depth": 4, "max_features": "sqrt", "min_leaf": 1},
        grids={c.STATE: small}, folds=3,
    )
    names = {path.split("/reports/")[1] for path in paths}
    cohort = spark.read.parquet(f"{tmp_path}/out/cohort")
    assert sorted(map(str, cohort.select(build_cohort(raw).columns).collect())) == sorted(
        map(str, build_cohort(raw).collect())
    )
    for place in ("deputado_estadual", "deputado_federal"):
        for report in (
            "elected_by_year", "category_summary", "event_rates", "forest_importance", "vif",
            "logit_coefficients", "logit_effects", "logit_odds", "logit_test_cutoff", "logit_train_sweep",
            "logit_test_roc", "forest_test_summary",
        ):
            assert f"{place}/{report}" in names
    assert "deputado_estadual/tuning" in names and "deputado_federal/tuning" not in names
    out = f"{tmp_path}/out/reports/deputado_estadual"
    table = {r.variable: r for r in spark.read.parquet(f"{out}/logit_coefficients").collect()}
    assert len(table) == 18 and table["RELIGIOSOS"]["OR"] > 1.3
    sweep = spark.read.parquet(f"{out}/logit_train_sweep").orderBy("cutoffs").collect()
    cut = spark.read.parquet(f"{out}/logit_train_cutoff").first()
    assert sweep[50].sensitividade == pytest.approx(cut["Sensibilidade (Recall)"])
    assert all(a.sensitividade >= b.sensitividade for a, b in zip(sweep, sweep[1:]))
    summary = spark.read.parquet(f"{out}/category_summary").groupBy("variavel").sum("percentual (%)").collect()
    assert len(summary) == len(c.LABELS) and all(abs(r[1] - 100) < 0.05 for r in summary)


def test_merged_rows_give_the_reports_of_single_rows(spark, raw):
    cohort = keep_in(build_cohort(raw), "DS_CARGO", [c.FEDERAL]).cache()
    features = feature_table(cohort).cache()
    reports = office_reports(
        cohort, features, {"trees": 3, "depth": 3, "max_features": "sqrt", "min_leaf": 1}
    )
    variables = [name for name in features.columns if name != "DS_CARGO"]
    plain = profile.event_rates(features.drop("DS_CARGO"), variables, c.TARGET, 2)
    assert sorted(map(str, reports["event_rates"].collect())) == sorted(map(str, plain.collect()))
    train = keep_in(features, c.PERIOD, c.TRAIN_YEARS)
    counts = {(r.label, r.predicted): r["count"] for r in reports["logit_train_confusion"].collect()}
    assert sum(counts.values()) == train.count()


# ------------------------------------------------------------------ plans


def test_cohort_is_one_narrow_stage_with_pushed_filters(spark, raw, tmp_path):
    raw.write.parquet(str(tmp_path / "raw"))
    cohort = build_cohort(spark.read.parquet(str(tmp_path / "raw")))
    plan = executed(cohort.select("RELIGIOSOS", "REGIAO"))
    assert "Exchange" not in plan and "Python" not in plan
    assert "In(DS_CARGO" in plan and "ReadSchema" in plan and "NM_CANDIDATO" not in plan.split("ReadSchema")[1]


def test_positives_scan_once(spark, raw):
    cohort = build_cohort(raw)
    plan = executed(profile.positives_by_period(cohort, c.PERIOD, c.FLAGS, c.TARGET, c.ELECTED))
    assert "ReusedExchange" in plan


def test_summary_counts_once(spark):
    parts = spark.read.parquet(f"{FOLDER}/part.parquet")
    plan = executed(profile.category_summary(parts, ["p_type", "p_size"]))
    assert "ReusedExchange" in plan and "Window" not in plan


def test_profile_limits_before_a_variable_meets(spark):
    orders = spark.read.parquet(f"{FOLDER}/orders.parquet")
    plan = executed(profile.profile_frequencies(orders, ["o_custkey", "o_orderstatus"], top=20))
    assert plan.count("WindowGroupLimit") == 2
    assert plan.index("WindowGroupLimit") < plan.rindex("Exchange hashpartitioning(variable")
    assert "ReadSchema: struct<o_custkey:bigint,o_orderstatus:string>" in plan


def test_no_window_over_raw_rows_and_no_cross_join(spark, raw):
    rows = spark.read.parquet(f"{FOLDER}/lineitem.parquet").selectExpr(
        "int(l_returnflag = 'R') AS y", "l_extendedprice AS s"
    )
    for df in (
        evaluate.roc_points(rows, "y", "s"), evaluate.auc(rows, "y", "s"),
        evaluate.auc(rows, "y", "s", rows_per_range=500), evaluate.cutoff_sweep(rows, "y", "s"),
    ):
        plan = executed(df)
        assert "Cartesian" not in plan and "NestedLoop" not in plan
        # Windows see sums per score, range or cutoff, never the rows of the file.
        below = plan.split("Window")[-1]
        assert "lineitem.parquet" not in below or "HashAggregate" in below
    merged = executed(build_cohort(raw).groupBy("REGIAO").count())
    assert "partial_count" in merged


def test_adapter_joins_by_key(spark):
    plan = executed(candidates(spark, FOLDER).groupBy("ANO_ELEICAO").count())
    assert "Cartesian" not in plan and "NestedLoop" not in plan
