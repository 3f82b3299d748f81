"""SQL that gives the rows of :mod:`checks.queries`, for DuckDB over the same tables."""
from __future__ import annotations

from checks.inputs import EDUCATION, PARTIES, RACES, STATES
from checks.queries import NAME_PATTERNS, TEXT_PATTERNS
from psephos.functions.numeric import Z_95
from psephos.plans import config as c

ORACLES: dict[str, str] = {}


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def listed(values) -> str:
    return ", ".join(map(text, values))


def found(column: str, patterns) -> str:
    return f"coalesce(regexp_matches({column}, {text('|'.join(patterns))}), false)"


def pick(values, index: str) -> str:
    return f"([{listed(values)}])[({index}) + 1]"


def pairs(mapping, value: str, default: str) -> str:
    branches = " ".join(f"WHEN {value} IN ({listed(m)}) THEN {text(k)}" for k, m in mapping.items())
    return f"CASE {branches} ELSE {default} END"


LINES = """(SELECT (l_returnflag = 'R')::INTEGER AS label, (l_linestatus = 'O')::INTEGER AS pred,
    l_discount * 10::DOUBLE AS score, l_extendedprice / 131072::DOUBLE AS fine_score,
    l_quantity AS quantity, l_tax * 100::DOUBLE AS tax FROM lineitem)"""

CANDIDATES = f"""(SELECT
    CASE WHEN year(o_orderdate) <= 1997 THEN 2014 WHEN year(o_orderdate) <= 1999 THEN 2018
         ELSE 2022 END::INTEGER AS ANO_ELEICAO,
    {pick(STATES, "l_suppkey % 28")} AS SG_UF,
    CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN '{c.STATE}'
         WHEN o_orderpriority IN ('3-MEDIUM', '4-NOT SPECIFIED') THEN '{c.FEDERAL}'
         ELSE 'SENADOR' END AS DS_CARGO,
    strftime(l_shipdate, '%d/%m/') || (year(l_shipdate) - p_size) AS DT_NASCIMENTO,
    l_linenumber AS NR_CANDIDATO,
    CASE split_part(p_name, ' ', 1)
         WHEN 'hot' THEN 'PASTOR ' || upper(split_part(p_name, ' ', 2))
         WHEN 'cold' THEN 'CABO ' || upper(split_part(p_name, ' ', 2))
         WHEN 'red' THEN upper(split_part(p_name, ' ', 2)) || ' PM'
         WHEN 'new' THEN 'IRMÃO ' || upper(split_part(p_name, ' ', 2))
         ELSE upper(p_name) END AS NM_URNA_CANDIDATO,
    {pick(PARTIES, "split_part(p_brand, '#', 2)::INTEGER - 1")} AS SG_PARTIDO,
    CASE WHEN l_tax = 0.08::DOUBLE THEN 'NÃO DIVULGÁVEL' WHEN l_linestatus = 'F' THEN 'FEMININO'
         ELSE 'MASCULINO' END AS DS_GENERO,
    CASE WHEN l_quantity = 50 THEN 'ANALFABETO'
         ELSE {pick(EDUCATION, "l_linenumber - 1")} END AS DS_GRAU_INSTRUCAO,
    CASE o_orderstatus WHEN 'F' THEN 'CASADO(A)' WHEN 'O' THEN 'SOLTEIRO(A)'
         ELSE 'VIÚVO(A)' END AS DS_ESTADO_CIVIL,
    {pick(RACES, "round(l_discount * 100)::INTEGER")} AS DS_COR_RACA,
    CASE p_type WHEN 'PROMO' THEN 'POLICIAL MILITAR'
         WHEN 'ECONOMY' THEN 'SACERDOTE OU MEMBRO DE ORDEM OU SEITA RELIGIOSA'
         ELSE p_type END AS DS_OCUPACAO,
    CASE WHEN l_tax = 0.07::DOUBLE THEN '#NULO#' WHEN l_returnflag = 'R' THEN ' ELEITO POR QP '
         WHEN l_returnflag = 'A' THEN 'SUPLENTE' END AS DS_SIT_TOT_TURNO
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""

COHORT = f"""(SELECT *, CASE WHEN IDADE IS NULL THEN 'Desconhecida' WHEN IDADE < 30 THEN '18–29'
      WHEN IDADE <= 44 THEN '30–44' WHEN IDADE <= 59 THEN '45–59' ELSE '60+' END AS FAIXA_ETARIA
    FROM (SELECT *, (ANO_ELEICAO - year(DT_NASCIMENTO_DATE))::INTEGER AS IDADE FROM (SELECT
    ANO_ELEICAO, SG_UF, DS_CARGO, NR_CANDIDATO, DS_GENERO,
    ({found("NM_URNA_CANDIDATO", c.RELIGIOUS_NAMES)}
      OR {found("DS_OCUPACAO", c.RELIGIOUS_OCCUPATIONS)})::INTEGER AS RELIGIOSOS,
    ({found("NM_URNA_CANDIDATO", c.SECURITY_NAMES)}
      OR {found("DS_OCUPACAO", c.SECURITY_OCCUPATIONS)})::INTEGER AS SEGURANCA,
    CASE WHEN trim(DS_SIT_TOT_TURNO) IN ('ELEITO POR QP', 'ELEITO POR MÉDIA') THEN 'ELEITO'
         ELSE 'NÃO ELEITO' END AS DS_SIT_TOT_TURNO,
    {pairs(c.EDUCATION_GROUPS, "DS_GRAU_INSTRUCAO", "DS_GRAU_INSTRUCAO")} AS DS_GRAU_INSTRUCAO,
    CASE WHEN DS_ESTADO_CIVIL IN ('SOLTEIRO(A)', 'CASADO(A)') THEN DS_ESTADO_CIVIL
         ELSE 'OUTRO' END AS DS_ESTADO_CIVIL,
    {pairs(c.RACE_GROUPS, "DS_COR_RACA", "NULL")} AS DS_COR_RACA,
    {pairs(c.SPECTRUM_PARTIES, "SG_PARTIDO", "NULL")} AS ESPECTRO_POL,
    try_strptime(DT_NASCIMENTO, '%d/%m/%Y')::DATE AS DT_NASCIMENTO_DATE,
    {pairs(c.REGION_STATES, "SG_UF", "'DESCONHECIDA'")} AS REGIAO
  FROM {CANDIDATES}
  WHERE DS_CARGO IN ('{c.STATE}', '{c.FEDERAL}') AND DS_GENERO IN ('MASCULINO', 'FEMININO')
    AND coalesce(trim(DS_SIT_TOT_TURNO), '') NOT IN ('#NULO#', '#NULO')
    AND DS_COR_RACA NOT IN ('#NE#', 'NÃO INFORMADO'))))"""

# ---------------------------------------------------------------- sources and sinks

ORACLES["extracts_round_trip"] = f"""
SELECT ANO_ELEICAO, DS_GRAU_INSTRUCAO, trim(DS_SIT_TOT_TURNO) AS DS_SIT_TOT_TURNO,
  count(*)::BIGINT AS n, sum(NR_CANDIDATO)::BIGINT AS numbers,
  count(DISTINCT NM_URNA_CANDIDATO)::BIGINT AS names
FROM {CANDIDATES} GROUP BY 1, 2, 3"""

ORACLES["table_round_trip"] = """
SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus IN ('F', 'O')"""

ORACLES["report_round_trip"] = """
SELECT p_type, p_size, count(*)::BIGINT AS count FROM part GROUP BY 1, 2"""

# ---------------------------------------------------------------- shape

ORACLES["select_columns"] = "SELECT c_custkey, c_mktsegment FROM customer"
ORACLES["feature_columns"] = "SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders"
ORACLES["keep_in"] = """
SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW')"""
ORACLES["drop_in"] = """
SELECT o_orderkey, o_orderpriority AS priority FROM orders
WHERE o_orderpriority IN ('3-MEDIUM', '4-NOT SPECIFIED')"""
ORACLES["drop_null"] = "SELECT p_partkey, p_type FROM part WHERE p_type <> 'PROMO'"
ORACLES["split_by_period"] = """
SELECT year(o_orderdate)::INTEGER AS period, count(*)::BIGINT AS count,
  CASE WHEN year(o_orderdate) < 2000 THEN 'train' ELSE 'test' END AS part
FROM orders GROUP BY 1, 3"""
ORACLES["union_extracts"] = """
SELECT year(o_orderdate)::INTEGER AS year, count(*)::BIGINT AS n,
  count(*) FILTER (year(o_orderdate) NOT IN (1998, 1999))::BIGINT AS status,
  count(*) FILTER (year(o_orderdate) >= 1998)::BIGINT AS priority,
  count(*) FILTER (year(o_orderdate) <= 1999)::BIGINT AS price
FROM orders GROUP BY 1"""
ORACLES["clean_names"] = """
SELECT c_custkey AS Ate_Sup, c_nationkey AS "18_29", c_mktsegment AS REGIAO_CENTRO_OESTE_c,
  c_name AS "60_mais" FROM customer"""
ORACLES["collapse_rows"] = """
SELECT l_returnflag, l_linestatus, l_quantity, count(*)::BIGINT AS n FROM lineitem GROUP BY 1, 2, 3"""

# ---------------------------------------------------------------- flags

ORACLES["flag_patterns"] = f"""
SELECT p_partkey, nullif(p_name, 'old rod') AS p_name,
  {found("nullif(p_name, 'old rod')", NAME_PATTERNS)}::INTEGER AS flag FROM part"""
ORACLES["flag_long_text"] = f"""
SELECT lang, source, {found("text", TEXT_PATTERNS)}::INTEGER AS flag, count(*)::BIGINT AS count
FROM documents GROUP BY 1, 2, 3"""
ORACLES["flag_occupation"] = """
SELECT p_partkey, p_type, (p_type LIKE '%SMAL%' OR p_type LIKE '%ECONOMY%')::INTEGER AS flag FROM part"""
ORACLES["any_flag"] = f"""
SELECT p_partkey, p_name, p_type,
  ({found("p_name", NAME_PATTERNS)} OR p_type = 'SMALL')::INTEGER AS flag FROM part"""

# ---------------------------------------------------------------- recodes

ORACLES["recode_outcome"] = """
SELECT o_orderkey, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'ELEITO'
  WHEN o_orderpriority = '4-NOT SPECIFIED' THEN NULL ELSE 'NÃO ELEITO' END AS outcome FROM orders"""
ORACLES["recode_keep"] = """
SELECT c_custkey, CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'home' WHEN 'FURNITURE' THEN 'home'
  WHEN 'BUILDING' THEN 'site' WHEN 'MACHINERY' THEN NULL ELSE c_mktsegment END AS segment
FROM customer"""
ORACLES["recode_default"] = """
SELECT c_custkey, CASE WHEN c_mktsegment IN ('HOUSEHOLD', 'BUILDING') THEN c_mktsegment
  ELSE 'OUTRO' END AS segment FROM customer"""
ORACLES["recode_race"] = """
SELECT p_partkey, CASE WHEN p_type IN ('LARGE', 'MEDIUM') THEN 'L' WHEN p_type = 'SMALL' THEN 'S'
  END AS p_type FROM part WHERE p_type NOT IN ('PROMO', 'ECONOMY')"""
ORACLES["map_values"] = """
SELECT p_partkey, p_brand, CASE WHEN b <= 5 THEN 'Esquerda' WHEN b <= 8 THEN 'Centro'
  WHEN b <= 23 THEN 'Direita' END AS spectrum
FROM (SELECT *, split_part(p_brand, '#', 2)::INTEGER AS b FROM part)"""
ORACLES["map_region"] = """
SELECT c_custkey, 'NATION_' || c_nationkey AS state,
  CASE WHEN c_nationkey > 20 THEN 'DESCONHECIDA' WHEN c_nationkey % 3 = 0 THEN 'NORTE'
       WHEN c_nationkey % 3 = 1 THEN 'SUL' ELSE 'SUDESTE' END AS region FROM customer"""
ORACLES["parse_date_age"] = """
SELECT *, (year - birth_year)::INTEGER AS age FROM (
  SELECT *, year(born)::INTEGER AS birth_year FROM (
    SELECT o_orderkey,
      CASE o_orderpriority WHEN '5-LOW' THEN '31/02/2000' WHEN '2-HIGH' THEN '' WHEN '3-MEDIUM' THEN NULL
           ELSE strftime(o_orderdate, '%d/%m/%Y') END AS date_text,
      CASE WHEN o_orderstatus = 'F' THEN 2018 ELSE 2022 END::INTEGER AS year,
      CASE WHEN o_orderpriority IN ('1-URGENT', '4-NOT SPECIFIED') THEN o_orderdate::DATE END AS born
    FROM orders))"""
ORACLES["band"] = """
SELECT p_partkey, nullif(p_size, 7) AS size, CASE WHEN p_size = 7 THEN 'Desconhecida'
  WHEN p_size < 10 THEN '<10' WHEN p_size <= 24 THEN '10–24' WHEN p_size <= 39 THEN '25–39'
  ELSE '40+' END AS band FROM part"""

# ---------------------------------------------------------------- counts and profiles

ORACLES["count_by"] = "SELECT l_returnflag, count(*)::BIGINT AS count FROM lineitem GROUP BY 1"
ORACLES["count_by_two"] = """
SELECT year(o_orderdate)::INTEGER AS year, o_orderpriority, count(*)::BIGINT AS count
FROM orders GROUP BY 1, 2"""
ORACLES["frequency"] = "SELECT p_name, count(*)::BIGINT AS count FROM part GROUP BY 1"
ORACLES["frequency_top"] = """
SELECT l_suppkey, count(*)::BIGINT AS count FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 30"""
ORACLES["profile_frequencies"] = """
SELECT variable, value, count, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY variable ORDER BY count DESC, value)::INTEGER AS rank FROM (
    SELECT variable, value, count(*)::BIGINT AS count FROM (
      SELECT 'o_orderkey' AS variable, o_orderkey::VARCHAR AS value FROM orders
      UNION ALL SELECT 'o_custkey', o_custkey::VARCHAR FROM orders
      UNION ALL SELECT 'o_orderstatus', o_orderstatus FROM orders
      UNION ALL SELECT 'o_orderdate', strftime(o_orderdate, '%Y-%m-%d') FROM orders
      UNION ALL SELECT 'o_orderpriority', o_orderpriority FROM orders) GROUP BY 1, 2))
WHERE rank <= 20"""
ORACLES["distinct_values"] = "SELECT DISTINCT l_partkey FROM lineitem"
ORACLES["count_flags"] = f"""
SELECT count(*) FILTER ({found("p_name", NAME_PATTERNS)})::BIGINT AS a,
  count(*) FILTER (p_type LIKE '%SMALL%')::BIGINT AS b FROM part"""
ORACLES["positives_by_period"] = f"""
WITH flagged AS (
  SELECT year(l_shipdate) AS y, {found("p_name", NAME_PATTERNS)}::INTEGER AS a,
    (p_type = 'SMALL')::INTEGER AS b
  FROM lineitem JOIN part ON l_partkey = p_partkey
  WHERE l_returnflag = 'R' AND year(l_shipdate) <> 1997),
sums AS (
  SELECT y::VARCHAR AS period, sum(a)::BIGINT AS a, sum(b)::BIGINT AS b FROM flagged
  WHERE a + b > 0 GROUP BY 1
  UNION ALL SELECT 'TOTAL', sum(a)::BIGINT, sum(b)::BIGINT FROM flagged)
SELECT period, a, b, a + b AS total FROM sums"""
ORACLES["category_summary"] = """
WITH long AS (
  SELECT 'p_type' AS variable, CASE p_type WHEN 'SMALL' THEN 'pequeno' ELSE p_type END AS category FROM part
  UNION ALL SELECT 'p_size', CASE p_size WHEN 1 THEN 'um' WHEN 7 THEN NULL ELSE p_size::VARCHAR END FROM part
  UNION ALL SELECT 'p_brand', p_brand FROM part)
SELECT variable, category, count(*)::BIGINT AS count,
  round_even(count(*) / sum(count(*)) OVER (PARTITION BY variable) * 100, 2)::DOUBLE AS percent
FROM long GROUP BY 1, 2"""


def rate_table(source: str, low: str, high: str) -> str:
    return f"""
SELECT variable, {low} AS lower, {high} AS upper, n, n_known, round(rate, 9) AS rate,
  round(rate - {Z_95}::DOUBLE * sqrt(rate * (1 - rate) / n_known), 9) AS ci_low,
  round(rate + {Z_95}::DOUBLE * sqrt(rate * (1 - rate) / n_known), 9) AS ci_high
FROM (SELECT *, hits / n_known AS rate FROM ({source}))"""


ORACLES["event_rate_by"] = f"""
SELECT variable, category, NULL::DOUBLE AS lower, NULL::DOUBLE AS upper, n, n_known,
  round(rate, 9) AS rate,
  round(rate - {Z_95}::DOUBLE * sqrt(rate * (1 - rate) / n_known), 9) AS ci_low,
  round(rate + {Z_95}::DOUBLE * sqrt(rate * (1 - rate) / n_known), 9) AS ci_high
FROM (SELECT 'l_linestatus' AS variable, l_linestatus AS category, count(*)::BIGINT AS n,
    count(*) FILTER (l_returnflag <> 'N')::BIGINT AS n_known,
    count(*) FILTER (l_returnflag = 'R') / count(*) FILTER (l_returnflag <> 'N') AS rate
  FROM lineitem GROUP BY 2)"""

HALVES = " UNION ALL ".join(
    f"""SELECT '{v}' AS variable, CASE WHEN {v} <= mid THEN low ELSE mid END AS lo,
  CASE WHEN {v} <= mid THEN mid ELSE high END AS hi, count(*)::BIGINT AS n, count(*)::BIGINT AS n_known,
  sum(label) AS hits FROM {LINES}, (SELECT min({v}) AS low, max({v}) AS high,
  quantile_cont({v}, 0.5) AS mid FROM {LINES}) GROUP BY 1, 2, 3"""
    for v in ("quantity", "fine_score", "tax")
)
ORACLES["event_rate_quantiles"] = rate_table(
    f"""{HALVES} UNION ALL SELECT 'pred', pred::DOUBLE, pred::DOUBLE, count(*)::BIGINT,
  count(*)::BIGINT, sum(label) FROM {LINES} GROUP BY pred""",
    "round(lo, 9)", "round(hi, 9)",
)
ORACLES["quantile_bins"] = """
WITH q AS (SELECT quantile_cont(c_acctbal, [i / 7 FOR i IN range(8)]) AS e FROM customer),
b AS (SELECT c_custkey, c_acctbal, e,
    greatest(1, len(list_filter(e, lambda x: x < c_acctbal))) AS i FROM customer, q)
SELECT c_custkey, c_acctbal, round(e[i], 6) AS bin_lower, round(e[i + 1], 6) AS bin_upper FROM b"""
ORACLES["missing_report"] = """
SELECT *, round(missing / n_rows, 9) AS share,
  printf('%.1f%%', missing / n_rows * 100) AS share_text FROM (
  SELECT 'flag' AS variable, count(*)::BIGINT AS n_rows,
    count(*) FILTER (l_returnflag = 'R')::BIGINT AS missing FROM lineitem
  UNION ALL SELECT 'quantity', count(*)::BIGINT, count(*) FILTER (l_quantity > 45)::BIGINT FROM lineitem
  UNION ALL SELECT 'l_orderkey', count(*)::BIGINT, 0::BIGINT FROM lineitem)"""
ORACLES["calibration_by"] = f"""
WITH q AS (SELECT quantile_cont(quantity, [0::DOUBLE, 0.25, 0.5, 0.75, 1]) AS e FROM {LINES}),
b AS (SELECT label, fine_score, e, greatest(1, len(list_filter(e, lambda x: x < quantity))) AS i
  FROM {LINES}, q),
s AS (SELECT e[i] AS lo, e[i + 1] AS hi, count(*)::BIGINT AS n, avg(label) AS r,
  avg(fine_score) AS p FROM b GROUP BY 1, 2)
SELECT 'quantity' AS variable, lo AS lower, hi AS upper, n, round(r, 9) AS observed,
  round(r - {Z_95}::DOUBLE * sqrt(r * (1 - r) / n), 9) AS ci_low,
  round(r + {Z_95}::DOUBLE * sqrt(r * (1 - r) / n), 9) AS ci_high, round(p, 9) AS predicted FROM s"""

# ---------------------------------------------------------------- encoding and weights

ORACLES["encode_binary"] = "SELECT o_orderkey, (o_orderstatus = 'F')::INTEGER AS status FROM orders"
ORACLES["encode_ordinal"] = """
SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2
  WHEN '3-MEDIUM' THEN 3 ELSE 0 END::INTEGER AS o_orderpriority FROM orders"""
ORACLES["one_hot_first"] = """
SELECT p_partkey, (p_type = 'LARGE')::INTEGER AS p_type_LARGE, (p_type = 'MEDIUM')::INTEGER AS p_type_MEDIUM,
  (p_type = 'SMALL')::INTEGER AS p_type_SMALL, (p_type = 'STANDARD')::INTEGER AS p_type_STANDARD FROM part"""
ORACLES["one_hot_named"] = """
SELECT p_partkey, p_type, (p_type = 'LARGE')::INTEGER AS p_type_LARGE,
  (p_type = 'SMALL')::INTEGER AS p_type_SMALL FROM part"""
ORACLES["decode_labels"] = """
SELECT l_linestatus AS variable, CASE WHEN l_linestatus = 'F' AND l_linenumber = 1 THEN 'um'
  WHEN l_linestatus = 'F' AND l_linenumber = 2 THEN 'dois'
  WHEN l_linestatus = 'O' AND l_linenumber = 1 THEN 'one' ELSE l_linenumber::VARCHAR END AS value,
  count(*)::BIGINT AS count FROM lineitem GROUP BY 1, 2"""
ORACLES["balanced_weights"] = """
SELECT doc_id, quality, round(count(*) OVER () / (2 * count(*) OVER (PARTITION BY quality)), 9) AS weight
FROM labels"""
ORACLES["vif_two"] = """
SELECT variable, round(1 / (1 - r * r), 6) AS vif FROM (SELECT corr(l_quantity, l_extendedprice) AS r
  FROM lineitem), (VALUES ('l_quantity'), ('l_extendedprice')) AS v(variable)"""

# ---------------------------------------------------------------- evaluation

CELLS = f"""(SELECT count(*) FILTER (label = 1 AND pred = 1)::BIGINT AS tp,
  count(*) FILTER (label = 0 AND pred = 1)::BIGINT AS fp, count(*) FILTER (label = 0 AND pred = 0)::BIGINT AS tn,
  count(*) FILTER (label = 1 AND pred = 0)::BIGINT AS fn FROM {LINES})"""
SHARES = """round((tp + tn) / (tp + fp + tn + fn), 9) AS accuracy, round(tp / (tp + fn), 9) AS sensitivity,
  round(tn / (tn + fp), 9) AS specificity, round(tp / (tp + fp), 9) AS precision,
  round(2 * tp / (2 * tp + fp + fn), 9) AS f1"""
BALANCED = "round((tp / (tp + fn) + tn / (tn + fp)) / 2, 9) AS balanced_accuracy"


def area(score: str) -> str:
    return f"""(SELECT sum(neg * (above + pos / 2)) / (sum(pos) * sum(neg)) AS a FROM (
  SELECT pos, neg, coalesce(sum(pos) OVER (ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING
    AND 1 PRECEDING), 0) AS above FROM (
    SELECT {score} AS s, sum(label)::DOUBLE AS pos, sum(1 - label)::DOUBLE AS neg FROM {LINES} GROUP BY 1)))"""


ORACLES["confusion"] = f"""
SELECT 0::INTEGER AS label, 0::INTEGER AS predicted, tn AS count FROM {CELLS}
UNION ALL SELECT 0, 1, fp FROM {CELLS} UNION ALL SELECT 1, 0, fn FROM {CELLS}
UNION ALL SELECT 1, 1, tp FROM {CELLS}"""
ORACLES["binary_metrics"] = f"SELECT tp, fp, tn, fn, {SHARES}, {BALANCED} FROM {CELLS}"
ORACLES["classification_report"] = f"""
WITH k AS (SELECT tp + fn AS n1, tn + fp AS n0, tp + fp + tn + fn AS n, tp / (tp + fp) AS p1,
    tn / (tn + fn) AS p0, tp / (tp + fn) AS r1, tn / (tn + fp) AS r0, 2 * tp / (2 * tp + fp + fn) AS f1,
    2 * tn / (2 * tn + fp + fn) AS f0, (tp + tn) / (tp + fp + tn + fn) AS acc FROM {CELLS}),
l AS (SELECT '0' AS class, p0 AS p, r0 AS r, f0 AS f, n0 AS support FROM k
  UNION ALL SELECT '1', p1, r1, f1, n1 FROM k UNION ALL SELECT 'accuracy', NULL, NULL, acc, n FROM k
  UNION ALL SELECT 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, n FROM k
  UNION ALL SELECT 'weighted avg', (p0 * n0 + p1 * n1) / n, (r0 * n0 + r1 * n1) / n,
    (f0 * n0 + f1 * n1) / n, n FROM k)
SELECT class, round(p, 9) AS precision, round(r, 9) AS recall, round(f, 9) AS f1, support FROM l"""


def curve(score: str, extra: str = "") -> str:
    return f"""
WITH g AS (SELECT {score} AS s, sum(label) AS pos, sum(1 - label) AS neg FROM {LINES} GROUP BY 1),
k AS (SELECT sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n,
    pos, neg, lead(pos) OVER w2 AS next_pos, lead(neg) OVER w2 AS next_neg FROM g
  WINDOW w AS (ORDER BY s DESC ROWS UNBOUNDED PRECEDING), w2 AS (ORDER BY s DESC))
SELECT tp::BIGINT AS tp, fp::BIGINT AS fp, round(fp / n, 9) AS fpr, round(tp / p, 9) AS tpr FROM k {extra}
UNION ALL SELECT 0::BIGINT, 0::BIGINT, 0::DOUBLE, 0::DOUBLE"""


ORACLES["roc_points"] = curve("score")
ORACLES["roc_points_fine"] = curve(
    "fine_score", "WHERE next_pos IS NULL OR next_pos <> pos OR next_neg <> neg OR (tp = pos AND fp = neg)"
)
ORACLES["auc_gini"] = f"SELECT round(a, 9) AS auc, round(2 * a - 1, 9) AS gini FROM {area('fine_score')}"
ORACLES["metrics_at_cutoff"] = f"""
SELECT tp, fp, tn, fn, {SHARES} FROM {CELLS.replace("pred = 1", "score >= 0.5").replace("pred = 0", "score < 0.5")}"""
ORACLES["cutoff_sweep"] = f"""
SELECT round(cut, 9) AS cutoff, round(count(*) FILTER (label = 1 AND fine_score >= cut)
    / count(*) FILTER (label = 1), 9) AS sensitivity,
  round(count(*) FILTER (label = 0 AND fine_score < cut) / count(*) FILTER (label = 0), 9) AS specificity
FROM {LINES}, (SELECT i::DOUBLE * 0.01::DOUBLE AS cut FROM range(101) AS r(i)) GROUP BY cut"""
ORACLES["normalise_score"] = """
SELECT c_custkey, c_acctbal, round((c_acctbal - low) / (high - low + 1e-12), 9) AS score
FROM customer, (SELECT min(c_acctbal) AS low, max(c_acctbal) AS high FROM customer)"""
ORACLES["score_fallback"] = """
SELECT 'probability' AS by, c_custkey, CASE WHEN c_nationkey > 0 THEN c_nationkey / 32 END AS score FROM customer
UNION ALL SELECT 'decision', c_custkey, round((c_acctbal - low) / (high - low + 1e-12), 9)
FROM customer, (SELECT min(c_acctbal) AS low, max(c_acctbal) AS high FROM customer)
UNION ALL SELECT 'prediction', c_custkey, (c_acctbal > 0)::INTEGER::DOUBLE FROM customer"""
ORACLES["evaluate_summary"] = f"""
SELECT tp, fp, tn, fn, {SHARES}, {BALANCED}, round(a, 9) AS auc, round(2 * a - 1, 9) AS gini, 0::BIGINT AS n_missing
FROM {CELLS}, {area('score')}"""

# ---------------------------------------------------------------- logit model

# Weights of w1 and w0 per positive and negative row turn the cells a, b, c, d into
# w1*a, w0*b, w1*c, w0*d; the model with one 0/1 predictor reproduces their odds exactly.
ORACLES["logit_table"] = f"""
WITH k AS (SELECT w1 * tp AS a, w0 * fp AS b, w0 * tn AS d, w1 * fn AS c FROM (
  SELECT *, (tp + fp + tn + fn) / (2 * (tp + fn)) AS w1, (tp + fp + tn + fn) / (2 * (tn + fp)) AS w0
  FROM {CELLS})),
e AS (SELECT 'const' AS variable, ln(c / d) AS coef, sqrt(1 / c + 1 / d) AS se FROM k
  UNION ALL SELECT 'pred', ln(a * d / (b * c)), sqrt(1 / a + 1 / b + 1 / c + 1 / d) FROM k)
SELECT variable, round(coef, 6) AS coef, round(se, 6) AS std_err, round(coef / se, 6) AS z,
  round(coef - {Z_95}::DOUBLE * se, 6) AS ci_low,
  round(coef + {Z_95}::DOUBLE * se, 6) AS ci_high, round(exp(coef), 6) AS odds_ratio,
  round(exp(coef - {Z_95}::DOUBLE * se), 6) AS or_low, round(exp(coef + {Z_95}::DOUBLE * se), 6) AS or_high
FROM e"""
LONG = """(SELECT count(*) FILTER (quality = 1 AND n_chars > 1500) AS a,
  count(*) FILTER (quality = 0 AND n_chars > 1500) AS b, count(*) FILTER (quality = 1 AND n_chars <= 1500) AS c,
  count(*) FILTER (quality = 0 AND n_chars <= 1500) AS d FROM documents JOIN labels USING (doc_id))"""
ORACLES["significant_effects"] = f"""
SELECT 'long' AS variable, round(ln(o), 3) AS coef, round(o, 3) AS odds_ratio,
  round(o, 2)::VARCHAR || ' : 1' AS odds_text, round(100 * o / (1 + o), 1) AS probability_percent
FROM (SELECT a * d / (b * c) AS o FROM {LONG})"""
ORACLES["odds_intervals"] = f"""
SELECT 'long' AS variable, round(o, 6) AS odds_ratio,
  round(o - exp(ln(o) - {Z_95}::DOUBLE * se), 6) AS error_low,
  round(exp(ln(o) + {Z_95}::DOUBLE * se) - o, 6) AS error_high
FROM (SELECT a * d / (b * c) AS o, sqrt(1 / a + 1 / b + 1 / c + 1 / d) AS se FROM {LONG})"""
ORACLES["logit_scores"] = f"""
SELECT doc_id, quality, (n_chars > 1500)::INTEGER AS long,
  round(CASE WHEN n_chars > 1500 THEN a / (a + b) ELSE c / (c + d) END, 6) AS score
FROM documents JOIN labels USING (doc_id), {LONG}"""

# ---------------------------------------------------------------- the whole analysis

ORACLES["cohort_table"] = f"""
SELECT ANO_ELEICAO, DS_CARGO, RELIGIOSOS, SEGURANCA, DS_SIT_TOT_TURNO, DS_GENERO, DS_GRAU_INSTRUCAO,
  DS_ESTADO_CIVIL, DS_COR_RACA, ESPECTRO_POL, FAIXA_ETARIA, REGIAO, count(*)::BIGINT AS n,
  sum(IDADE)::BIGINT AS ages, min(DT_NASCIMENTO_DATE) AS first_born, sum(NR_CANDIDATO)::BIGINT AS numbers
FROM {COHORT} GROUP BY ALL"""
ORACLES["feature_rows"] = f"""
SELECT DS_CARGO, (DS_SIT_TOT_TURNO = 'ELEITO')::INTEGER AS DS_SIT_TOT_TURNO,
  (DS_GENERO = 'MASCULINO')::INTEGER AS DS_GENERO,
  coalesce(DS_COR_RACA = 'BRANCA', false)::INTEGER AS DS_COR_RACA, RELIGIOSOS, SEGURANCA, ANO_ELEICAO,
  (DS_GRAU_INSTRUCAO = 'Até EM')::INTEGER AS DS_GRAU_INSTRUCAO_2,
  (DS_GRAU_INSTRUCAO = 'Até Sup.')::INTEGER AS DS_GRAU_INSTRUCAO_3,
  (FAIXA_ETARIA = '30–44')::INTEGER AS FAIXA_ETARIA_2, (FAIXA_ETARIA = '45–59')::INTEGER AS FAIXA_ETARIA_3,
  (FAIXA_ETARIA = '60+')::INTEGER AS FAIXA_ETARIA_4,
  (DS_ESTADO_CIVIL = 'CASADO(A)')::INTEGER AS DS_ESTADO_CIVIL_CASADOA,
  (DS_ESTADO_CIVIL = 'OUTRO')::INTEGER AS DS_ESTADO_CIVIL_OUTRO,
  coalesce(ESPECTRO_POL = 'Direita', false)::INTEGER AS ESPECTRO_POL_Direita,
  coalesce(ESPECTRO_POL = 'Esquerda', false)::INTEGER AS ESPECTRO_POL_Esquerda,
  (REGIAO = 'CENTRO-OESTE')::INTEGER AS REGIAO_CENTRO_OESTE, (REGIAO = 'NORDESTE')::INTEGER AS REGIAO_NORDESTE,
  (REGIAO = 'NORTE')::INTEGER AS REGIAO_NORTE, (REGIAO = 'SUL')::INTEGER AS REGIAO_SUL, count(*)::BIGINT AS n
FROM {COHORT} GROUP BY ALL"""
_PREDICTORS = [
    "DS_GENERO", "DS_COR_RACA", "RELIGIOSOS", "SEGURANCA", "DS_GRAU_INSTRUCAO_2", "DS_GRAU_INSTRUCAO_3",
    "FAIXA_ETARIA_2", "FAIXA_ETARIA_3", "FAIXA_ETARIA_4", "DS_ESTADO_CIVIL_CASADOA", "DS_ESTADO_CIVIL_OUTRO",
    "ESPECTRO_POL_Direita", "ESPECTRO_POL_Esquerda", "REGIAO_CENTRO_OESTE", "REGIAO_NORDESTE",
    "REGIAO_NORTE", "REGIAO_SUL",
]
#: Names of the feature table that SQL above gives without marks.
_MARKED = {
    "DS_ESTADO_CIVIL_CASADOA": "DS_ESTADO_CIVIL_CASADO(A)", "REGIAO_CENTRO_OESTE": "REGIAO_CENTRO-OESTE",
}
_SUMMED = " UNION ALL ".join(
    f"SELECT DS_CARGO, {text(_MARKED.get(name, name))} AS variable, {name} AS value, n FROM f"
    for name in [c.TARGET, *_PREDICTORS, c.PERIOD] if _MARKED.get(name, name) in c.LABELS
)
_LABELLED = " ".join(
    f"WHEN variable = {text(name)} AND value = {value} THEN {text(label)}"
    for name, labels in c.LABELS.items() for value, label in labels.items()
)
_PARTS = f"""(SELECT 'train' AS part, unnest([{", ".join(map(str, c.TRAIN_YEARS))}]) AS year
  UNION ALL SELECT 'test', unnest([{", ".join(map(str, c.TEST_YEARS))}]))"""
ORACLES["analysis_reports"] = f"""
WITH k AS (SELECT * FROM {COHORT}), f AS ({ORACLES["feature_rows"]}),
e AS (SELECT * FROM k WHERE DS_SIT_TOT_TURNO = 'ELEITO' AND RELIGIOSOS + SEGURANCA > 0)
SELECT DS_CARGO AS office, 'flag_counts' AS report, 'r' AS key, sum(RELIGIOSOS)::BIGINT AS n FROM k GROUP BY ALL
UNION ALL SELECT DS_CARGO, 'flag_counts', 's', sum(SEGURANCA)::BIGINT FROM k GROUP BY ALL
UNION ALL SELECT DS_CARGO, 'class_counts', DS_SIT_TOT_TURNO::VARCHAR, sum(n)::BIGINT FROM f GROUP BY ALL
UNION ALL SELECT DS_CARGO, 'elected_by_year', ANO_ELEICAO::VARCHAR, sum(RELIGIOSOS + SEGURANCA)::BIGINT FROM e GROUP BY ALL
UNION ALL SELECT DS_CARGO, 'elected_by_year', 'TOTAL', sum(RELIGIOSOS + SEGURANCA)::BIGINT FROM e GROUP BY ALL
UNION ALL SELECT DS_CARGO, 'category_summary', variable || '=' || CASE {_LABELLED} ELSE value::VARCHAR END,
  sum(n)::BIGINT FROM ({_SUMMED}) GROUP BY ALL
UNION ALL SELECT DS_CARGO, model || '_' || part, DS_SIT_TOT_TURNO::VARCHAR, sum(n)::BIGINT
FROM f JOIN {_PARTS} ON ANO_ELEICAO = year, (SELECT unnest(['forest', 'logit']) AS model) GROUP BY ALL"""
ORACLES["office_logit_totals"] = f"""
WITH f AS (SELECT * FROM ({ORACLES["feature_rows"]}) WHERE DS_CARGO = '{c.FEDERAL}'
    AND ANO_ELEICAO IN ({", ".join(map(str, c.TRAIN_YEARS))})),
w AS (SELECT sum(n) / (2 * sum(n) FILTER (DS_SIT_TOT_TURNO = 1)) AS w FROM f),
s AS (SELECT sum(n) AS const, {", ".join(f"sum(n * {name}) AS {name}" for name in _PREDICTORS)}
  FROM f WHERE DS_SIT_TOT_TURNO = 1)
SELECT variable, round(total * w, 2) AS total FROM (UNPIVOT s ON COLUMNS(*) INTO NAME variable VALUE total), w"""
_RULED = f"""(SELECT pred AS open, (quantity > 25)::INTEGER AS many, pred * (quantity > 25)::INTEGER AS wanted
  FROM {LINES})"""
ORACLES["forest_finds_rule"] = f"""
SELECT open, many, wanted, wanted AS prediction, count(*)::BIGINT AS count FROM {_RULED} GROUP BY ALL"""
ORACLES["forest_importance_of_one"] = """
SELECT unnest(['open', 'many', 'tax', 'discount']) AS feature, unnest([1, 0, 0, 0])::DOUBLE AS importance"""
ORACLES["forest_tuning_depth"] = """
SELECT 'depth=' || depth || ', max_features=all, min_leaf=1, trees=20' AS parameters, depth = 2 AS best,
  depth = 2 AS without_error FROM range(1, 3) AS r(depth)"""
ORACLES["elected_by_year"] = f"""
WITH e AS (SELECT * FROM {COHORT} WHERE DS_CARGO = '{c.STATE}' AND DS_SIT_TOT_TURNO = 'ELEITO'
    AND RELIGIOSOS + SEGURANCA > 0),
s AS (SELECT ANO_ELEICAO::VARCHAR AS ANO_ELEICAO, sum(RELIGIOSOS)::BIGINT AS RELIGIOSOS,
    sum(SEGURANCA)::BIGINT AS SEGURANCA FROM e GROUP BY 1
  UNION ALL SELECT 'TOTAL', sum(RELIGIOSOS)::BIGINT, sum(SEGURANCA)::BIGINT FROM e)
SELECT *, RELIGIOSOS + SEGURANCA AS total FROM s"""
ORACLES["unlisted_values"] = f"""
SELECT ANO_ELEICAO, ESPECTRO_POL, REGIAO, FAIXA_ETARIA, DS_GRAU_INSTRUCAO, count(*)::BIGINT AS count
FROM {COHORT} WHERE ESPECTRO_POL IS NULL OR REGIAO = 'DESCONHECIDA' OR FAIXA_ETARIA = 'Desconhecida'
  OR DS_GRAU_INSTRUCAO = 'ANALFABETO' GROUP BY ALL"""
ORACLES["stratified_folds"] = f"""
SELECT label, fold::INTEGER AS fold, (n // 5 + (fold < n % 5)::INTEGER)::BIGINT AS count
FROM (SELECT label, count(*) AS n FROM {LINES} GROUP BY 1), range(5) AS r(fold)"""
ORACLES["forest_min_split"] = f"""
WITH r AS (SELECT pred AS open, (quantity > 44)::INTEGER AS rare FROM {LINES})
SELECT 'few' AS min_split, open, rare, open * rare AS prediction, count(*)::BIGINT AS count FROM r GROUP BY ALL
UNION ALL SELECT 'many', open, rare, rare, count(*)::BIGINT FROM r GROUP BY ALL"""
ORACLES["stratum_effects"] = f"""
WITH g AS (SELECT l_linenumber AS i,
    count(*) FILTER (l_quantity > CASE WHEN l_linenumber > 4 THEN 20 ELSE 25 END)::DOUBLE AS a, count(*)::DOUBLE AS n
  FROM lineitem GROUP BY 1),
e AS (SELECT 'line_' || g.i AS variable, ln(g.a / (g.n - g.a)) - ln(r.a / (r.n - r.a)) AS b,
    sqrt(1 / g.a + 1 / (g.n - g.a) + 1 / r.a + 1 / (r.n - r.a)) AS se
  FROM g, (SELECT * FROM g WHERE i = 1) r WHERE g.i > 1),
-- The tail of the normal distribution by Simpson's rule up to 12, off by less than 1e-10.
z AS (SELECT variable, b, abs(b / se) AS z, greatest(12 - abs(b / se), 0) AS span FROM e),
t AS (SELECT variable, b, z, span / 6000 * 2 / sqrt(2 * pi()) * sum(
    CASE WHEN k IN (0, 2000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END * exp(-pow(z + k * span / 2000, 2) / 2)) AS p
  FROM z, range(2001) r(k) GROUP BY variable, b, z, span)
SELECT variable, round(b, 3) AS coef, round(p, 6) AS p_value, round(exp(b), 3) AS odds_ratio,
  round(exp(b), 2)::VARCHAR || ' : 1' AS odds_text, round(100 * exp(b) / (1 + exp(b)), 1) AS probability_percent
FROM t WHERE z > 1.959963984540054"""
ORACLES["logit_null_target"] = """
WITH k AS (SELECT count(*) FILTER (l_returnflag = 'R' AND l_quantity > 20) AS a,
    count(*) FILTER (l_returnflag = 'A' AND l_quantity > 20) AS b,
    count(*) FILTER (l_returnflag = 'R' AND l_quantity <= 20) AS c,
    count(*) FILTER (l_returnflag = 'A' AND l_quantity <= 20) AS d FROM lineitem)
SELECT 'const' AS variable, round(ln(c / d), 6) AS coef, round(sqrt(1 / c + 1 / d), 6) AS std_err FROM k
UNION ALL SELECT 'large', round(ln(a * d / (b * c)), 6), round(sqrt(1 / a + 1 / b + 1 / c + 1 / d), 6) FROM k"""
ORACLES["report_order_frequency"] = """
SELECT p_type, count(*)::BIGINT AS count, row_number() OVER (ORDER BY count(*) DESC, p_type) AS place FROM part GROUP BY 1"""
ORACLES["report_order_summary"] = """
WITH c AS (SELECT 1 AS k, 'p_size' AS variable, p_size AS v, p_size::VARCHAR AS category, count(*)::BIGINT AS count
  FROM part GROUP BY ALL UNION ALL SELECT 2, 'p_type', NULL, p_type, count(*)::BIGINT FROM part GROUP BY ALL)
SELECT variable, category, count, row_number() OVER (ORDER BY k, v, category) AS place FROM c"""
ORACLES["report_order_effects"] = """
WITH g AS (SELECT l_linenumber AS i, count(*) FILTER (l_quantity > 5 * l_linenumber)::DOUBLE AS a, count(*)::DOUBLE AS n
  FROM lineitem GROUP BY 1),
e AS (SELECT 'line_' || g.i AS variable, (g.a / (g.n - g.a)) / (r.a / (r.n - r.a)) AS o
  FROM g, (SELECT * FROM g WHERE i = 1) r WHERE g.i > 1)
SELECT variable, round(o, 6) AS odds_ratio, row_number() OVER (ORDER BY o, variable) AS place FROM e"""
ORACLES["report_order_importance"] = """
SELECT unnest(['open', 'discount', 'many', 'tax']) AS feature, unnest([1, 0, 0, 0])::DOUBLE AS importance,
  unnest([1, 2, 3, 4])::BIGINT AS place"""
ORACLES["percent_texts"] = """
SELECT p_partkey, printf('%.1f%%', p_partkey / 2000 * 100) AS one, printf('%.2f%%', p_partkey / 2000 / 8 * 100) AS two,
  printf('%.3g', p_partkey / 2000 / 7919) AS significant FROM part"""
ORACLES["evaluate_missing_scores"] = f"""
WITH k AS (SELECT *, quantity <= 40 AND tax < 8 AS whole FROM {LINES})
SELECT round(count(*) FILTER (whole AND label = pred) / count(*) FILTER (whole), 9) AS accuracy,
  round(count(*) FILTER (whole AND label = 1 AND pred = 1) / count(*) FILTER (whole AND label = 1), 9) AS sensitivity,
  count(*) FILTER (NOT whole)::BIGINT AS n_missing FROM k"""
ORACLES["extracts_mixed_order"] = f"""
SELECT ANO_ELEICAO, DS_GRAU_INSTRUCAO, count(*)::BIGINT AS n, sum(NR_CANDIDATO)::BIGINT AS numbers,
  count(DISTINCT NM_URNA_CANDIDATO)::BIGINT AS names FROM {CANDIDATES} GROUP BY 1, 2"""
