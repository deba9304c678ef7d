"""Registered queries: request validation, request features with unseen
labels, and batch scoring of requests (the batch twin of the stream)."""

from __future__ import annotations

from pyspark.sql import functions as F

from loanlens import schemas as S
from loanlens.operators import ensemble as E
from loanlens.operators.decision import classify
from loanlens.operators.encode import fit_label_encoder
from loanlens.operators.features import request_features
from loanlens.operators.validate import split_valid, validate_requests
from loanlens.plans import book
from loanlens.plans import oracle_sql as O
from loanlens.plans.catalog import query
from loanlens.sources import derived


def requests(spark, sf):
    text_feats, _ = book.book_features(spark, sf, encoded=False)
    return derived.requests(spark, sf, text_feats)


def validated(spark, sf):
    return validate_requests(requests(spark, sf))


def request_feature_table(spark, sf):
    """Valid requests -> 24 features (categories encoded with the encoder
    fitted on the application table; unseen labels fall back)."""
    enc = fit_label_encoder(derived.application(spark, sf))
    valid, _ = split_valid(validated(spark, sf))
    return request_features(valid, encoder=enc, ddof=0)


_REQUESTS = """
requests AS (
  SELECT e.event_id AS request_id, e.ts AS received_at, t.applicant_age, t.income_total,
    -CAST(t.DAYS_EMPLOYED AS DOUBLE) / 365.25e0 AS employment_years, t.loan_amount, t.loan_annuity, t.goods_price,
    CAST(t.num_children AS INTEGER) AS num_children, t.NAME_EDUCATION_TYPE AS education_type,
    t.NAME_HOUSING_TYPE AS housing_type, CAST(t.bureau_loans_active AS INTEGER) AS bureau_loans_active,
    CAST(t.bureau_overdue_count AS INTEGER) AS bureau_overdue_count,
    CAST(t.prev_application_count AS INTEGER) AS prev_application_count, t.prev_approved_ratio,
    t.EXT_SOURCE_1 AS external_source_1, t.EXT_SOURCE_2 AS external_source_2, t.EXT_SOURCE_3 AS external_source_3
  FROM events e LEFT JOIN (SELECT t.*, a.DAYS_EMPLOYED FROM text_features t JOIN application a ON t.SK_ID_CURR = a.SK_ID_CURR) t
    ON e.user_id = t.SK_ID_CURR
)"""


def _default(c: str, v) -> str:
    lit = f"'{v}'" if isinstance(v, str) else (f"{float(v)!r}e0".replace(".0e0", "e0") if isinstance(v, float) else str(v))
    return f"coalesce({c}, {lit}) AS {c}"


def _violations_sql() -> str:
    parts = [f"CASE WHEN {f} IS NULL THEN 'missing:{f}' END" for f in S.REQUIRED_FIELDS]
    for f, (lo, hi) in S.FIELD_RANGES.items():
        conds = []
        if lo is not None:
            conds.append(f"{f} < {lo}")
        if hi is not None:
            conds.append(f"{f} > {hi}")
        if dict((x.name, x.dataType.simpleString()) for x in S.REQUEST_SCHEMA.fields)[f] == "double":
            conds.append(f"isnan({f})")
        parts.append(f"CASE WHEN {f} IS NOT NULL AND ({' OR '.join(conds)}) THEN 'range:{f}' END")
    return "list_filter([" + ", ".join(parts) + "], lambda v: v IS NOT NULL)"


_DEFAULTED = ", ".join([c for c in S.REQUEST_FIELDS if c not in S.REQUEST_DEFAULTS]
                       + [_default(c, v) for c, v in S.REQUEST_DEFAULTS.items()])

_VALIDATED = f"""
defaulted AS (SELECT request_id, {_DEFAULTED} FROM requests),
validated AS (SELECT *, {_violations_sql()} AS violations FROM defaulted)"""


def _req_features_sql() -> str:
    d = S.ONLINE_DEFAULTS
    mean, std = O._row_stats(S.EXT_SOURCES, "0")
    base = f"""rq AS (
  SELECT request_id,
    CAST(coalesce(applicant_age, {d['applicant_age']}e0) AS DOUBLE) AS applicant_age,
    CAST(coalesce(income_total, {d['income_total']}e0) AS DOUBLE) AS income_total,
    CAST(coalesce(employment_years, {d['employment_years']}e0) AS DOUBLE) AS employment_years,
    CAST(coalesce(loan_amount, {d['loan_amount']}e0) AS DOUBLE) AS loan_amount,
    CAST(coalesce(loan_annuity, {d['loan_annuity']}e0) AS DOUBLE) AS loan_annuity,
    CAST(coalesce(goods_price, {d['goods_price']}e0) AS DOUBLE) AS goods_price,
    CAST(coalesce(num_children, {d['num_children']}) AS INTEGER) AS num_children,
    education_type, housing_type,
    external_source_1 AS EXT_SOURCE_1, external_source_2 AS EXT_SOURCE_2, external_source_3 AS EXT_SOURCE_3,
    coalesce(CAST(bureau_loans_active AS DOUBLE), 0e0) AS bureau_loans_active,
    coalesce(CAST(bureau_overdue_count AS DOUBLE), 0e0) AS bureau_overdue_count,
    coalesce(CAST(prev_application_count AS DOUBLE), 0e0) AS prev_application_count,
    coalesce(CAST(prev_approved_ratio AS DOUBLE), 0e0) AS prev_approved_ratio
  FROM validated WHERE len(violations) = 0
),
req_features AS (
  SELECT request_id, applicant_age, income_total, employment_years, loan_amount, loan_annuity, goods_price,
    CAST(num_children AS DOUBLE) AS num_children,
    CAST({O.code_sql('NAME_EDUCATION_TYPE', 'education_type')} AS INTEGER) AS NAME_EDUCATION_TYPE,
    CAST({O.code_sql('NAME_HOUSING_TYPE', 'housing_type')} AS INTEGER) AS NAME_HOUSING_TYPE,
    bureau_loans_active, bureau_overdue_count, prev_application_count, prev_approved_ratio,
    EXT_SOURCE_1, EXT_SOURCE_2, EXT_SOURCE_3,
    loan_amount / nullif(income_total + 1, 0) AS loan_to_income_ratio,
    loan_annuity / nullif(income_total + 1, 0) AS annuity_to_income_ratio,
    loan_amount / nullif(goods_price + 1, 0) AS credit_to_goods_ratio,
    {mean} AS external_source_mean, {std} AS external_source_std,
    income_total / nullif(CAST(num_children + 2 AS DOUBLE), 0) AS income_per_person,
    loan_annuity / nullif(loan_amount + 1, 0) AS payment_rate,
    0e0 AS bureau_debt_to_credit_ratio
  FROM rq
)"""
    return base


def request_ctes(*extra: str) -> str:
    return O.with_ctes(O.TEXT_FEATURES, _REQUESTS, _VALIDATED, O.CODES, *extra)


@query("validate_requests", request_ctes() + """SELECT request_id, len(violations) = 0 AS is_valid,
  array_to_string(violations, ',') AS violations, num_children, education_type, housing_type,
  bureau_loans_active, bureau_overdue_count, prev_application_count, prev_approved_ratio FROM validated""",
       doubles=["prev_approved_ratio"])
def validate_requests_q(spark, sf):
    """Rule violations and defaults of every request."""
    v = validated(spark, sf)
    return v.select("request_id", "is_valid", F.array_join("violations", ",").alias("violations"),
                    "num_children", "education_type", "housing_type", "bureau_loans_active",
                    "bureau_overdue_count", "prev_application_count", "prev_approved_ratio")


@query("label_encode_unseen", request_ctes() + f"""SELECT request_id, education_type, housing_type,
  CAST({O.code_sql('NAME_EDUCATION_TYPE', 'education_type')} AS INTEGER) AS education_code,
  CAST({O.code_sql('NAME_HOUSING_TYPE', 'housing_type')} AS INTEGER) AS housing_code FROM validated""")
def label_encode_unseen(spark, sf):
    """Codes of request labels; unseen -> 'Unknown' if fitted, else the
    first label."""
    enc = fit_label_encoder(derived.application(spark, sf))
    v = validated(spark, sf).select("request_id", "education_type", "housing_type")
    return enc.with_codes(v, {"education_code": ("NAME_EDUCATION_TYPE", "education_type"),
                              "housing_code": ("NAME_HOUSING_TYPE", "housing_type")})


_RF_DOUBLES = [c for c in S.FEATURES if c not in S.CATEGORICAL]


@query("score_request_features", request_ctes(_req_features_sql()) + "SELECT * FROM req_features",
       doubles=_RF_DOUBLES)
def score_request_features(spark, sf):
    """The 24 model features of every valid request (online
    defaults, population std of the external sources)."""
    return request_feature_table(spark, sf)


@query("score_requests", request_ctes(_req_features_sql()) + f""", scored_req AS (
  SELECT request_id, {O.margin_sql()} AS margin FROM req_features f)
SELECT request_id, 1e0 / (1e0 + exp(-margin)) AS probability,
  {O.grade_sql('(1e0 / (1e0 + exp(-margin)))')[0]} AS credit_score,
  {O.grade_sql('(1e0 / (1e0 + exp(-margin)))')[1]} AS risk_grade,
  {O.grade_sql('(1e0 / (1e0 + exp(-margin)))')[2]} AS recommended_action FROM scored_req""", doubles=["probability"])
def score_requests(spark, sf):
    """M1 (batch twin), G6, I1-I4: valid requests scored and decided."""
    scored = E.score(request_feature_table(spark, sf), E.fixed_ensemble())
    out = classify(scored, prob_col="probability")
    return out.select("request_id", "probability", "credit_score", "risk_grade", "recommended_action")
