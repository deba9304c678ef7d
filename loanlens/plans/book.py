"""The loan book built from the benchmark tables: features, scores, and the
inference log of scored events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanlens.operators import ensemble as E
from loanlens.operators.decision import classify, prediction_id
from loanlens.operators.encode import fit_label_encoder
from loanlens.operators.features import build_features
from loanlens.sources import derived
from loanlens.sources.readers import risk_factors_json


def raw_tables(spark: SparkSession, sf_dir: str):
    return (derived.application(spark, sf_dir), derived.bureau(spark, sf_dir),
            derived.previous_application(spark, sf_dir))


def book_features(spark: SparkSession, sf_dir: str, encoded: bool = True, with_history: bool = True,
                  users: DataFrame | None = None):
    """SK_ID_CURR, TARGET and the 24 features of every applicant, or of those in
    ``users`` (SK_ID_CURR), whose rows alone are then aggregated."""
    app, bur, prev = raw_tables(spark, sf_dir)
    enc = fit_label_encoder(app) if encoded else None
    if users is not None:
        app, bur, prev = (t.join(users, "SK_ID_CURR", "left_semi") for t in (app, bur, prev))
    if not with_history:
        bur = prev = None
    return build_features(app, bur, prev, encoder=enc), enc


def scored_book(spark: SparkSession, sf_dir: str, ens: E.Ensemble | None = None) -> DataFrame:
    feats, _ = book_features(spark, sf_dir)
    return E.score(feats, ens or E.fixed_ensemble())


def log_id(event_id: str) -> "F.Column":
    return prediction_id(event_id)


def scored_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with id, time, probability and decision: all that a report needs that
    does not show the applicant.  Reads the events only."""
    ev = derived.read_parquet(spark, f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value")
    return classify(ev.select(
        log_id("event_id").alias("id"), F.col("ts").alias("timestamp"), "user_id", "event_type",
        (F.col("value") / (F.col("value") + F.lit(2e2))).alias("default_probability"))).drop("clamped_probability")


def inference_log(spark: SparkSession, sf_dir: str, with_factors: bool = True, keep=(), pick=None) -> DataFrame:
    """Events scored against the applicant's features (27 log columns).

    The fact table (events) joins the one-row-per-applicant feature table on
    the applicant key; a hot applicant is split by AQE's skew-join handling
    instead of landing in one task.  ``keep``: extra event columns.  ``pick``
    chooses rows of the scored events first (a page, say); history is then read
    and aggregated for their applicants only."""
    ev = scored_events(spark, sf_dir)
    users = None
    if pick is not None:
        ev = pick(ev)
        users = ev.select(F.col("user_id").alias("SK_ID_CURR")).distinct()
    text_feats, _ = book_features(spark, sf_dir, encoded=False, users=users)
    df = ev.join(text_feats, ev["user_id"] == text_feats["SK_ID_CURR"], "left")
    extra = sorted({"user_id", "event_type", *keep})
    out = df.select(
        "id", "timestamp",
        "applicant_age", "income_total", "employment_years", "loan_amount", "loan_annuity",
        "goods_price", F.col("num_children").cast("int").alias("num_children"),
        F.col("NAME_EDUCATION_TYPE").alias("education_type"),
        F.col("NAME_HOUSING_TYPE").alias("housing_type"),
        F.col("bureau_loans_active").cast("int").alias("bureau_loans_active"),
        F.col("bureau_overdue_count").cast("int").alias("bureau_overdue_count"),
        F.col("prev_application_count").cast("int").alias("prev_application_count"),
        "prev_approved_ratio",
        F.col("EXT_SOURCE_1").alias("external_source_1"),
        F.col("EXT_SOURCE_2").alias("external_source_2"),
        F.col("EXT_SOURCE_3").alias("external_source_3"),
        "loan_to_income_ratio", "annuity_to_income_ratio", "credit_to_goods_ratio",
        "default_probability", "credit_score", "risk_grade", "recommended_action",
        F.concat(F.lit("/static/assets/shap_plots/"), F.col("id"), F.lit(".png")).alias("shap_plot_path"), *extra)
    if with_factors:
        out = attach_factor_json(spark, sf_dir, out)
    else:
        out = out.withColumn("top_risk_factors_json", F.lit(None).cast("string"))
    return out.drop(*[c for c in extra if c not in keep])


def attach_factor_json(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    """The stored explanation text of log rows (``user_id``, ``event_type``):
    top-6 TreeSHAP factors of the applicant as JSON.  Explanations are
    computed only for the applicants present in ``rows`` (a page needs a page
    worth of SHAP, the whole log needs every applicant once).

    Fixture rule: an 'error' event stored a truncated factor text; an applicant
    without features has no explanation (NULL)."""
    users = rows.select(F.col("user_id").alias("SK_ID_CURR")).distinct()
    feats, _ = book_features(spark, sf_dir, encoded=True, users=users)
    factors = E.top_factors(E.tree_shap(feats, E.fixed_ensemble())).select(
        F.col("SK_ID_CURR").alias("user_id"), "top_risk_factors")
    j = rows.join(factors, "user_id", "left")
    js = (F.when(F.col("event_type") == "error", F.lit("{"))
           .otherwise(risk_factors_json(F.col("top_risk_factors"))))
    return j.withColumn("top_risk_factors_json", js).drop("top_risk_factors")
