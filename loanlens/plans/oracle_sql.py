"""Reference SQL for every registered query, written for DuckDB over the same
Parquet tables.  The derived loan tables are CTEs with the same fixed
expressions as ``loanlens.sources.derived``.  Used only by the correctness
gate; nothing in the library executes it."""

from __future__ import annotations

from loanlens import schemas as S
from loanlens.operators import ensemble as E

APPLICATION = """
application AS (
  SELECT c_custkey AS SK_ID_CURR,
    CAST(CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END AS INTEGER) AS TARGET,
    CAST(-(7500 + (c_custkey*7919) % 17500) AS INTEGER) AS DAYS_BIRTH,
    CAST(CASE WHEN c_custkey % 6 = 0 THEN 365243 ELSE -((c_custkey*6151) % 12000) END AS INTEGER) AS DAYS_EMPLOYED,
    25000e0 + ((c_custkey*3571) % 4000)*1e2 AS AMT_INCOME_TOTAL,
    45000e0 + ((c_custkey*2971) % 9000)*1e2 AS AMT_CREDIT,
    CASE WHEN c_custkey % 500 = 3 THEN NULL
         ELSE (45000e0 + ((c_custkey*2971) % 9000)*1e2)*(3e-2 + ((c_custkey*1409) % 90)/1e3) END AS AMT_ANNUITY,
    CASE WHEN c_custkey % 300 = 7 THEN NULL ELSE (45000e0 + ((c_custkey*2971) % 9000)*1e2)*9e-1 END AS AMT_GOODS_PRICE,
    CAST(c_custkey % 4 AS INTEGER) AS CNT_CHILDREN,
    c_mktsegment AS NAME_EDUCATION_TYPE,
    CASE WHEN c_custkey % 50 = 11 THEN NULL ELSE r_name END AS NAME_HOUSING_TYPE,
    CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE ((c_custkey*7817) % 1000)/1e3 END AS EXT_SOURCE_1,
    CASE WHEN c_custkey % 400 = 9 THEN NULL
         ELSE (c_acctbal + 1e3)/22e3 + ((c_custkey*4729) % 1000)/2e3 END AS EXT_SOURCE_2,
    CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE ((c_custkey*6367) % 1000)/1e3 END AS EXT_SOURCE_3
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
)"""

BUREAU = """
bureau AS (
  SELECT CASE WHEN o_custkey % 7 = 0 THEN -o_custkey ELSE o_custkey END AS SK_ID_CURR,
    CASE l_returnflag WHEN 'A' THEN 'Active' WHEN 'R' THEN 'Closed' ELSE 'Sold' END AS CREDIT_ACTIVE,
    CAST(CASE WHEN l_linestatus = 'F' AND l_discount > 8e-2 THEN CAST(l_quantity AS INTEGER) ELSE 0 END AS INTEGER) AS CREDIT_DAY_OVERDUE,
    CASE WHEN l_linenumber = 7 THEN NULL ELSE l_extendedprice END AS AMT_CREDIT_SUM,
    CASE WHEN l_tax < 5e-3 THEN NULL ELSE l_extendedprice*l_discount*1e1 END AS AMT_CREDIT_SUM_DEBT
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
)"""

PREVIOUS = """
previous_application AS (
  SELECT o_orderkey AS SK_ID_PREV, CASE WHEN o_custkey % 9 = 0 THEN -o_custkey ELSE o_custkey END AS SK_ID_CURR,
    CASE o_orderstatus WHEN 'F' THEN 'Approved' WHEN 'O' THEN 'Refused' ELSE 'Canceled' END AS NAME_CONTRACT_STATUS
  FROM orders
)"""


def _row_stats(cols, ddof_sql: str, prefix=""):
    n = " + ".join(f"CAST({c} IS NOT NULL AS INTEGER)" for c in cols)
    s = " + ".join(f"coalesce({c}, 0e0)" for c in cols)
    mean = f"(({s}) / nullif({n}, 0))"
    ss = " + ".join(f"coalesce(({c} - {mean}) * ({c} - {mean}), 0e0)" for c in cols)
    std = f"CASE WHEN ({n}) > {ddof_sql} THEN sqrt(({ss}) / (({n}) - {ddof_sql})) ELSE 0e0 END"
    return mean, std


_MEAN, _STD1 = _row_stats(S.EXT_SOURCES, "1")

APP_FEATURES = f"""
app_feat AS (
  SELECT *,
    -CAST(DAYS_BIRTH AS DOUBLE) / 365.25e0 AS applicant_age,
    coalesce(-CAST(nullif(DAYS_EMPLOYED, 365243) AS DOUBLE) / 365.25e0, 0e0) AS employment_years,
    AMT_CREDIT / nullif(AMT_INCOME_TOTAL + 1, 0) AS loan_to_income_ratio,
    AMT_ANNUITY / nullif(AMT_INCOME_TOTAL + 1, 0) AS annuity_to_income_ratio,
    AMT_CREDIT / nullif(AMT_GOODS_PRICE + 1, 0) AS credit_to_goods_ratio,
    AMT_INCOME_TOTAL / nullif(CAST(CNT_CHILDREN + 2 AS DOUBLE), 0) AS income_per_person,
    AMT_ANNUITY / nullif(AMT_CREDIT + 1, 0) AS payment_rate,
    {_MEAN} AS external_source_mean,
    {_STD1} AS external_source_std
  FROM application
)"""

BUREAU_FEATURES = """
bureau_feat AS (
  SELECT SK_ID_CURR,
    count_if(CREDIT_ACTIVE = 'Active') AS bureau_loans_active,
    count_if(CREDIT_DAY_OVERDUE > 0) AS bureau_overdue_count,
    sum(coalesce(AMT_CREDIT_SUM_DEBT, 0e0)) / nullif(sum(coalesce(AMT_CREDIT_SUM, 0e0)) + 1, 0) AS bureau_debt_to_credit_ratio
  FROM bureau WHERE SK_ID_CURR IS NOT NULL GROUP BY SK_ID_CURR
)"""

PREVIOUS_FEATURES = """
prev_feat AS (
  SELECT SK_ID_CURR,
    count(SK_ID_PREV) AS prev_application_count,
    count_if(NAME_CONTRACT_STATUS = 'Approved') / nullif(count(SK_ID_PREV) + 1e-5, 0) AS prev_approved_ratio
  FROM previous_application WHERE SK_ID_CURR IS NOT NULL GROUP BY SK_ID_CURR
)"""


def feature_select(encoded: bool = True, history: bool = True) -> str:
    if encoded:
        edu = "CAST(dense_rank() OVER (ORDER BY coalesce(a.NAME_EDUCATION_TYPE, 'Unknown')) - 1 AS INTEGER)"
        hou = "CAST(dense_rank() OVER (ORDER BY coalesce(a.NAME_HOUSING_TYPE, 'Unknown')) - 1 AS INTEGER)"
    else:
        edu, hou = "a.NAME_EDUCATION_TYPE", "a.NAME_HOUSING_TYPE"
    if history:
        hist = """CAST(coalesce(b.bureau_loans_active, 0) AS DOUBLE) AS bureau_loans_active,
    CAST(coalesce(b.bureau_overdue_count, 0) AS DOUBLE) AS bureau_overdue_count,
    CAST(coalesce(p.prev_application_count, 0) AS DOUBLE) AS prev_application_count,
    coalesce(p.prev_approved_ratio, 0e0) AS prev_approved_ratio,"""
        bdr = "coalesce(b.bureau_debt_to_credit_ratio, 0e0) AS bureau_debt_to_credit_ratio"
        joins = "LEFT JOIN bureau_feat b ON a.SK_ID_CURR = b.SK_ID_CURR LEFT JOIN prev_feat p ON a.SK_ID_CURR = p.SK_ID_CURR"
    else:
        hist = """0e0 AS bureau_loans_active, 0e0 AS bureau_overdue_count,
    0e0 AS prev_application_count, 0e0 AS prev_approved_ratio,"""
        bdr = "0e0 AS bureau_debt_to_credit_ratio"
        joins = ""
    return f"""SELECT a.SK_ID_CURR, a.TARGET,
    a.applicant_age, a.AMT_INCOME_TOTAL AS income_total, a.employment_years,
    a.AMT_CREDIT AS loan_amount, a.AMT_ANNUITY AS loan_annuity, a.AMT_GOODS_PRICE AS goods_price,
    CAST(a.CNT_CHILDREN AS DOUBLE) AS num_children,
    {edu} AS NAME_EDUCATION_TYPE, {hou} AS NAME_HOUSING_TYPE,
    {hist}
    a.EXT_SOURCE_1, a.EXT_SOURCE_2, a.EXT_SOURCE_3,
    a.loan_to_income_ratio, a.annuity_to_income_ratio, a.credit_to_goods_ratio,
    a.external_source_mean, a.external_source_std, a.income_per_person, a.payment_rate,
    {bdr}
  FROM app_feat a {joins}"""


BASE = [APPLICATION, BUREAU, PREVIOUS, APP_FEATURES, BUREAU_FEATURES, PREVIOUS_FEATURES]


def text(value: str) -> str:
    """A SQL text literal."""
    return "'" + value.replace("'", "''") + "'"


def with_ctes(*extra: str) -> str:
    return "WITH " + ",".join(BASE + list(extra)) + "\n"


FEATURES = f"features AS ({feature_select(True)})"
TEXT_FEATURES = f"text_features AS ({feature_select(False)})"


def _sql_num(v: float) -> str:
    if v == float("inf"):
        return "CAST('inf' AS DOUBLE)"
    if v == -float("inf"):
        return "CAST('-inf' AS DOUBLE)"
    return f"CAST({repr(float(v))} AS DOUBLE)"


def _cond_sql(feat: str, lo: float, hi: float, null_ok: bool) -> str:
    x = f"f.{feat}"
    parts = []
    if lo != -float("inf"):
        parts.append(f"{x} > {_sql_num(lo)}")
    if hi != float("inf"):
        parts.append(f"{x} <= {_sql_num(hi)}")
    inside = " AND ".join(parts) or "TRUE"
    return f"(CASE WHEN {x} IS NULL THEN {'TRUE' if null_ok else 'FALSE'} ELSE ({inside}) END)"


def _path_sql(leaf) -> str:
    return " AND ".join(_cond_sql(feat, lo, hi, nok) for feat, lo, hi, nok, _ in leaf.path) or "TRUE"


def margin_sql(ens=None) -> str:
    """The ensemble's margin as one CASE per tree, added in tree order."""
    ens = ens or E.fixed_ensemble()
    by_tree: dict[int, list] = {}
    for lf in ens.leaves:
        by_tree.setdefault(lf.tree, []).append(lf)
    terms = [_sql_num(ens.intercept)]
    for leaves in by_tree.values():
        whens = " ".join(f"WHEN {_path_sql(lf)} THEN {_sql_num(lf.value)}" for lf in leaves)
        terms.append(f"(CASE {whens} ELSE 0e0 END)")
    return " + ".join(terms)


SCORES = f"""
scores AS (
  SELECT f.SK_ID_CURR, f.TARGET, {margin_sql()} AS margin FROM features f
)"""

SCORED = """
scored AS (
  SELECT SK_ID_CURR, TARGET, margin, round(1e0 / (1e0 + exp(-margin)), 12) AS probability FROM scores
)"""


def _shap_terms(ens=None) -> dict[str, list[str]]:
    """Closed-form TreeSHAP for paths of at most two distinct features:
    one feature: phi = w (o - z); two: phi_1 = w (o_1 - z_1)(z_2 + o_2) / 2."""
    ens = ens or E.fixed_ensemble()
    terms: dict[str, list[str]] = {}
    for lf in ens.leaves:
        feats = [(feat, f"CAST({_cond_sql(feat, lo, hi, nok)} AS DOUBLE)", _sql_num(z))
                 for feat, lo, hi, nok, z in lf.path]
        if len({f for f, _, _ in feats}) != len(feats) or len(feats) > 2:
            raise ValueError("the SQL oracle handles paths of <= 2 distinct features")
        w = _sql_num(lf.value)
        if len(feats) == 1:
            (f1, o1, z1), = feats
            terms.setdefault(f1, []).append(f"{w} * ({o1} - {z1})")
        elif len(feats) == 2:
            (f1, o1, z1), (f2, o2, z2) = feats
            terms.setdefault(f1, []).append(f"{w} * ({o1} - {z1}) * ({z2} + {o2}) / 2e0")
            terms.setdefault(f2, []).append(f"{w} * ({o2} - {z2}) * ({z1} + {o1}) / 2e0")
    return terms


def shap_sql() -> str:
    terms = _shap_terms()
    parts = []
    for i, feat in enumerate(S.FEATURES):
        phi = " + ".join(terms.get(feat, [])) or "0e0"
        parts.append(f"SELECT f.SK_ID_CURR, '{feat}' AS feature, {i} AS feature_pos, {phi} AS shap_value FROM features f")
    return "shap AS (\n  " + "\n  UNION ALL ".join(parts) + "\n)"


DISPLAY = "display_names(feature, display_name) AS (VALUES " + ", ".join(
    "('{}', '{}')".format(f, n) for f, n in S.DISPLAY_NAMES.items()) + ")"


def _text_sql(template: str) -> str:
    head, rest = template.split("{name}")
    mid, tail = rest.split("{magnitude}")
    return f"'{head}' || display_name || '{mid}' || mag || '{tail}'"


TOP_FACTORS = f"""
ranked AS (
  SELECT s.SK_ID_CURR, s.feature, s.feature_pos, s.shap_value,
    coalesce(d.display_name, s.feature) AS display_name,
    row_number() OVER (PARTITION BY s.SK_ID_CURR ORDER BY abs(s.shap_value) DESC, s.feature_pos) AS rank
  FROM shap s LEFT JOIN display_names d ON s.feature = d.feature
),
top_factors AS (
  SELECT SK_ID_CURR, rank, feature, display_name, shap_value,
    CASE WHEN shap_value > 0 THEN 'risk_increase' ELSE 'risk_decrease' END AS direction,
    CASE WHEN shap_value > 0 THEN {_text_sql(S.FACTOR_TEXT_INCREASE)} ELSE {_text_sql(S.FACTOR_TEXT_DECREASE)} END AS description
  FROM (SELECT *, CAST(round(CAST(round(abs(shap_value), 9) AS DECIMAL(20,9)), 3) AS DECIMAL(20,3))::VARCHAR AS mag FROM ranked) r
  WHERE rank <= 6
)"""


def grade_sql(p: str) -> tuple[str, str, str]:
    q = f"(CASE WHEN {p} IS NULL OR isnan({p}) THEN NULL ELSE greatest(0e0, least(1e0, {p})) END)"
    score = f"CAST(850 - floor({q} * 550e0) AS INTEGER)"
    grade = (f"CASE WHEN {q} IS NULL THEN NULL WHEN {q} <= 0.1e0 THEN 'Excellent' WHEN {q} <= 0.25e0 THEN 'Good' "
             f"WHEN {q} <= 0.5e0 THEN 'Fair' ELSE 'Poor' END")
    action = (f"CASE WHEN {q} IS NULL THEN NULL WHEN {q} <= 0.1e0 THEN 'AUTO_APPROVE' WHEN {q} <= 0.25e0 "
              f"THEN 'APPROVE_WITH_CONDITIONS' WHEN {q} <= 0.5e0 THEN 'MANUAL_REVIEW' ELSE 'REJECT' END")
    return score, grade, action


_SC, _GR, _AC = grade_sql("(value / (value + 2e2))")

LOG = f"""
inference_logs AS (
  SELECT 'pred_' || substr(sha256(CAST(e.event_id AS VARCHAR) || '|v1'), 1, 16) AS id,
    e.ts AS timestamp,
    t.applicant_age, t.income_total, t.employment_years, t.loan_amount, t.loan_annuity, t.goods_price,
    CAST(t.num_children AS INTEGER) AS num_children,
    t.NAME_EDUCATION_TYPE AS education_type, t.NAME_HOUSING_TYPE AS housing_type,
    CAST(t.bureau_loans_active AS INTEGER) AS bureau_loans_active,
    CAST(t.bureau_overdue_count AS INTEGER) AS bureau_overdue_count,
    CAST(t.prev_application_count AS INTEGER) AS prev_application_count,
    t.prev_approved_ratio,
    t.EXT_SOURCE_1 AS external_source_1, t.EXT_SOURCE_2 AS external_source_2, t.EXT_SOURCE_3 AS external_source_3,
    t.loan_to_income_ratio, t.annuity_to_income_ratio, t.credit_to_goods_ratio,
    e.value / (e.value + 2e2) AS default_probability,
    {_SC} AS credit_score, {_GR} AS risk_grade, {_AC} AS recommended_action,
    '/static/assets/shap_plots/pred_' || substr(sha256(CAST(e.event_id AS VARCHAR) || '|v1'), 1, 16) || '.png' AS shap_plot_path,
    e.event_id, e.user_id, e.event_type
  FROM events e LEFT JOIN text_features t ON e.user_id = t.SK_ID_CURR
)"""


def log_ctes(*extra: str) -> str:
    return with_ctes(TEXT_FEATURES, LOG, *extra)


def shap_ctes(*extra: str) -> str:
    return with_ctes(FEATURES, shap_sql(), *extra)


def scored_ctes(*extra: str) -> str:
    return with_ctes(FEATURES, SCORES, SCORED, *extra)


CODES = "codes AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS col, label, CAST(dense_rank() OVER (ORDER BY label) - 1 AS INTEGER) AS code "
    f"FROM (SELECT DISTINCT coalesce({c}, 'Unknown') AS label FROM application)" for c in S.CATEGORICAL) + ")"


def code_sql(col: str, label_expr: str) -> str:
    """Fitted code of a label; unseen -> 'Unknown' when fitted, else code 0."""
    return (f"coalesce((SELECT code FROM codes WHERE col = '{col}' AND label = coalesce({label_expr}, 'Unknown')),"
            f" (SELECT code FROM codes WHERE col = '{col}' AND label = 'Unknown'), 0)")
