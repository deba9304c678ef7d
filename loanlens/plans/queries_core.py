"""Registered queries: scans, features, decisions, scoring, log and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from loanlens import schemas as S
from loanlens.operators import monitoring as M
from loanlens.operators.decision import classify
from loanlens.operators.encode import fit_label_encoder
from loanlens.operators.features import application_features, bureau_features, previous_features
from loanlens.plans import book
from loanlens.plans import oracle_sql as O
from loanlens.session import materialize
from loanlens.plans.catalog import query
from loanlens.sources import derived

AS_OF = "2024-01-30 12:00:00"  # fixed "now" of the fixture log
PAGE, LIMIT, PAGE_GRADE = 2, 20, "Good"

_FEATURE_DOUBLES = [c for c in S.FEATURES if c not in S.CATEGORICAL]
_APP_RAW = ["AMT_INCOME_TOTAL", "AMT_CREDIT", "AMT_ANNUITY", "AMT_GOODS_PRICE", "EXT_SOURCE_1",
            "EXT_SOURCE_2", "EXT_SOURCE_3"]
_APP_FEAT = ["applicant_age", "employment_years", "loan_to_income_ratio", "annuity_to_income_ratio",
             "credit_to_goods_ratio", "income_per_person", "payment_rate", "external_source_mean",
             "external_source_std"]


@query("scan_application", O.with_ctes() + "SELECT * FROM application", doubles=_APP_RAW)
def scan_application(spark, sf):
    """A1: the application table."""
    return derived.application(spark, sf)


@query("feature_application", O.with_ctes() + "SELECT SK_ID_CURR, " + ", ".join(_APP_FEAT) + " FROM app_feat",
       doubles=_APP_FEAT)
def feature_application(spark, sf):
    """Row-level application features."""
    return application_features(derived.application(spark, sf)).select("SK_ID_CURR", *_APP_FEAT)


@query("feature_bureau", O.with_ctes() + "SELECT * FROM bureau_feat", doubles=["bureau_debt_to_credit_ratio"])
def feature_bureau(spark, sf):
    """F1-F2: bureau aggregates per applicant."""
    return bureau_features(derived.bureau(spark, sf))


@query("feature_previous", O.with_ctes() + "SELECT * FROM prev_feat", doubles=["prev_approved_ratio"])
def feature_previous(spark, sf):
    """previous-application aggregates per applicant."""
    return previous_features(derived.previous_application(spark, sf))


@query("features_all", O.with_ctes(O.FEATURES) + "SELECT * FROM features", doubles=_FEATURE_DOUBLES)
def features_all(spark, sf):
    """The 24-column feature table."""
    return book.book_features(spark, sf)[0]


@query("features_no_history", O.with_ctes() + O.feature_select(True, False), doubles=_FEATURE_DOUBLES)
def features_no_history(spark, sf):
    """A2-A3: absent bureau / previous tables become constant 0 columns."""
    return book.book_features(spark, sf, with_history=False)[0]


@query("label_encode", O.with_ctes() + """SELECT SK_ID_CURR,
  CAST(dense_rank() OVER (ORDER BY coalesce(NAME_EDUCATION_TYPE, 'Unknown')) - 1 AS INTEGER) AS NAME_EDUCATION_TYPE,
  CAST(dense_rank() OVER (ORDER BY coalesce(NAME_HOUSING_TYPE, 'Unknown')) - 1 AS INTEGER) AS NAME_HOUSING_TYPE
FROM application""")
def label_encode(spark, sf):
    """Label codes in sorted label order, NULL -> 'Unknown'."""
    app = derived.application(spark, sf)
    enc = fit_label_encoder(app)
    return enc.transform(app).select("SK_ID_CURR", *S.CATEGORICAL)


@query("score_leaf_table", O.with_ctes(O.FEATURES, O.SCORES)
       + "SELECT SK_ID_CURR, margin, 1e0 / (1e0 + exp(-margin)) AS probability FROM scores",
       doubles=["margin", "probability"])
def score_leaf_table(spark, sf):
    """Probability from an ensemble held as a leaf table."""
    return book.scored_book(spark, sf).select("SK_ID_CURR", "margin", "probability")


_SCg, _GRg, _ACg = O.grade_sql("default_probability")


@query("classify", O.log_ctes() + f"""SELECT id, default_probability,
  CASE WHEN default_probability IS NULL OR isnan(default_probability) THEN NULL
       ELSE greatest(0e0, least(1e0, default_probability)) END AS clamped_probability,
  {_SCg} AS credit_score, {_GRg} AS risk_grade, {_ACg} AS recommended_action,
  CASE {_GRg} WHEN 'Excellent' THEN '#10b981' WHEN 'Good' THEN '#3b82f6' WHEN 'Fair' THEN '#f59e0b'
       WHEN 'Poor' THEN '#ef4444' END AS risk_color
FROM inference_logs""", doubles=["default_probability", "clamped_probability"])
def classify_q(spark, sf):
    """Score, grade, action and colour for every logged probability."""
    log = book.inference_log(spark, sf, with_factors=False)
    out = classify(log.select("id", "default_probability"), details=True)
    return out.drop("action_description")


_LOG_COLS = ["id", "timestamp", "applicant_age", "income_total", "employment_years", "loan_amount",
             "loan_annuity", "goods_price", "num_children", "education_type", "housing_type",
             "bureau_loans_active", "bureau_overdue_count", "prev_application_count", "prev_approved_ratio",
             "external_source_1", "external_source_2", "external_source_3", "loan_to_income_ratio",
             "annuity_to_income_ratio", "credit_to_goods_ratio", "default_probability", "credit_score",
             "risk_grade", "recommended_action", "shap_plot_path"]
_LOG_DOUBLES = ["applicant_age", "income_total", "employment_years", "loan_amount", "loan_annuity",
                "goods_price", "prev_approved_ratio", "external_source_1", "external_source_2",
                "external_source_3", "loan_to_income_ratio", "annuity_to_income_ratio",
                "credit_to_goods_ratio", "default_probability"]


@query("build_inference_log", O.log_ctes() + "SELECT " + ", ".join(_LOG_COLS) + " FROM inference_logs",
       doubles=_LOG_DOUBLES)
def build_inference_log(spark, sf):
    """The inference log rows (all columns but the factor JSON text)."""
    return book.inference_log(spark, sf, with_factors=False).select(*_LOG_COLS)


_DRIFT_VIEW = ", ".join(f"{k} AS {v}" for k, v in S.LOG_TO_DRIFT.items())


@query("log_for_drift", O.log_ctes() + f"SELECT id, {_DRIFT_VIEW} FROM inference_logs",
       doubles=[v for k, v in S.LOG_TO_DRIFT.items() if k in _LOG_DOUBLES])
def log_for_drift(spark, sf):
    """The log's drift view -- 19 features renamed to model names + TARGET."""
    log = book.inference_log(spark, sf, with_factors=False)
    return log.select("id", *[F.col(k).alias(v) for k, v in S.LOG_TO_DRIFT.items()])


@query("monitoring_stats", O.log_ctes() + f"""SELECT *,
  CASE WHEN total_predictions > 0 AND risk_poor / total_predictions > {S.POOR_RATE_ALERT}e0 THEN 'WARNING' ELSE 'OK' END AS system_health,
  CASE WHEN total_predictions > 0 AND risk_poor / total_predictions > {S.POOR_RATE_ALERT}e0 THEN '{S.HIGH_DEFAULT_ALERT}' ELSE '' END AS active_alerts
FROM (SELECT count(id) AS total_predictions,
  count_if(timestamp >= date_trunc('day', TIMESTAMP '{AS_OF}')) AS today_predictions,
  coalesce(avg(default_probability), 0e0) AS avg_default_probability,
  count_if(risk_grade = 'Excellent') AS risk_excellent, count_if(risk_grade = 'Good') AS risk_good,
  count_if(risk_grade = 'Fair') AS risk_fair, count_if(risk_grade = 'Poor') AS risk_poor
FROM inference_logs) s""", doubles=["avg_default_probability"])
def monitoring_stats(spark, sf):
    """System stats with health and alerts."""
    st = M.system_stats(book.scored_events(spark, sf), AS_OF)
    return st.withColumn("active_alerts", F.array_join("active_alerts", ","))


@query("risk_distribution", O.log_ctes() + """SELECT g.risk_grade, CAST(count(l.id) AS BIGINT) AS n
FROM (VALUES ('Excellent'), ('Good'), ('Fair'), ('Poor')) g(risk_grade)
LEFT JOIN inference_logs l ON l.risk_grade = g.risk_grade GROUP BY g.risk_grade""")
def risk_distribution(spark, sf):
    """count per grade, absent grades as 0."""
    return M.risk_distribution(book.scored_events(spark, sf))


_NFAC = ("CASE WHEN event_type = 'error' "
         "OR applicant_age IS NULL THEN 0 ELSE 6 END")


@query("history_page", O.log_ctes() + f"""SELECT id AS prediction_id,
  strftime(timestamp, '%Y-%m-%dT%H:%M:%S.%fZ') AS timestamp,
  '{S.APPLICANT_NAME_PREFIX}' || right(id, 4) AS applicant_name,
  applicant_age, income_total, loan_amount, default_probability, credit_score, risk_grade,
  recommended_action, shap_plot_path AS shap_plot_url, CAST({_NFAC} AS INTEGER) AS n_top_risk_factors
FROM inference_logs WHERE risk_grade = '{PAGE_GRADE}'
ORDER BY timestamp DESC, id LIMIT {LIMIT} OFFSET {(PAGE - 1) * LIMIT}""",
       doubles=["applicant_age", "income_total", "loan_amount", "default_probability"])
def history_page(spark, sf):
    """One page of the history, newest first."""
    page = M.project_page(book.inference_log(spark, sf, pick=lambda ev: materialize(M.page_rows(ev, PAGE, LIMIT, PAGE_GRADE))))
    return page.withColumn("n_top_risk_factors", F.size("top_risk_factors")).drop("top_risk_factors")


@query("history_page_info", O.log_ctes() + f"""SELECT {PAGE} AS page, {LIMIT} AS "limit",
  count_if(risk_grade = '{PAGE_GRADE}') AS total_records, count(*) AS total_all,
  CAST(greatest(ceil(count_if(risk_grade = '{PAGE_GRADE}') / {LIMIT}), 1) AS BIGINT) AS total_pages
FROM inference_logs""")
def history_page_info(spark, sf):
    """L2, H5: filtered and unfiltered totals and page count."""
    return M.history_info(book.scored_events(spark, sf), PAGE, LIMIT, PAGE_GRADE)


@query("parse_risk_factors", O.shap_ctes(O.DISPLAY, O.TOP_FACTORS, O.TEXT_FEATURES, O.LOG) + f"""
SELECT l.id, CAST({_NFAC.replace('event_type', 'l.event_type').replace('applicant_age', 'l.applicant_age')} AS INTEGER) AS n_factors,
  CASE WHEN {_NFAC.replace('event_type', 'l.event_type').replace('applicant_age', 'l.applicant_age')} = 0 THEN NULL ELSE t.feature END AS top_feature,
  CASE WHEN {_NFAC.replace('event_type', 'l.event_type').replace('applicant_age', 'l.applicant_age')} = 0 THEN NULL ELSE t.shap_value END AS top_shap_value,
  CASE WHEN {_NFAC.replace('event_type', 'l.event_type').replace('applicant_age', 'l.applicant_age')} = 0 THEN NULL ELSE t.direction END AS top_direction
FROM inference_logs l LEFT JOIN top_factors t ON t.SK_ID_CURR = l.user_id AND t.rank = 1""",
       doubles=["top_shap_value"])
def parse_risk_factors(spark, sf):
    """A10: JSON factor text back to structs; NULL, empty or bad text -> []."""
    from loanlens.sources.readers import parse_risk_factors as parse
    log = book.inference_log(spark, sf).select("id", parse("top_risk_factors_json").alias("f"))
    first = F.get(F.col("f"), 0)
    return log.select("id", F.size("f").alias("n_factors"), first["feature"].alias("top_feature"),
                      first["shap_value"].alias("top_shap_value"), first["direction"].alias("top_direction"))


@query("daily_grade_counts", O.log_ctes() + """SELECT CAST(timestamp AS DATE) AS day, risk_grade,
  count(*) AS n, avg(default_probability) AS avg_probability
FROM inference_logs GROUP BY 1, 2""", doubles=["avg_probability"])
def daily_grade_counts(spark, sf):
    """M3 (batch twin): count and mean probability per day and grade."""
    return M.daily_grade_counts(book.scored_events(spark, sf))


@query("grade_book", O.scored_ctes() + f"""SELECT risk_grade, recommended_action, count(*) AS applicants,
  avg(p) AS avg_probability, min(credit_score) AS min_score, max(credit_score) AS max_score FROM (
  SELECT 1e0 / (1e0 + exp(-margin)) AS p,
    {O.grade_sql('(1e0 / (1e0 + exp(-margin)))')[0]} AS credit_score,
    {O.grade_sql('(1e0 / (1e0 + exp(-margin)))')[1]} AS risk_grade,
    {O.grade_sql('(1e0 / (1e0 + exp(-margin)))')[2]} AS recommended_action FROM scores)
GROUP BY risk_grade, recommended_action""", doubles=["avg_probability"])
def grade_book_q(spark, sf):
    """Flagship: book -> features -> leaf-table scores -> decisions -> count per grade."""
    from loanlens.plans.flagship import grade_book
    return grade_book(spark, sf)
