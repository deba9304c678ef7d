"""Feature engineering: application row features, bureau and previous-application
aggregates, the joined 24-column feature table, and request features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanlens import schemas as S
from loanlens.functions.exprs import nan_to_null, row_mean, row_std, safe_div, to_number

KEY = "SK_ID_CURR"


def ratio_columns(income, credit, annuity, goods, children) -> dict:
    """The five financial ratios; every denominator is offset as in training."""
    return {
        "loan_to_income_ratio": safe_div(credit, income + F.lit(1)),
        "annuity_to_income_ratio": safe_div(annuity, income + F.lit(1)),
        "credit_to_goods_ratio": safe_div(credit, goods + F.lit(1)),
        "income_per_person": safe_div(income, children + F.lit(2)),
        "payment_rate": safe_div(annuity, credit + F.lit(1)),
    }


def application_features(app: DataFrame, ddof: int = 1) -> DataFrame:
    """Row-level features on the raw application table (no shuffle)."""
    days_emp = F.nullif(F.col("DAYS_EMPLOYED"), F.lit(S.DAYS_EMPLOYED_SENTINEL))
    cols = {
        "applicant_age": -F.col("DAYS_BIRTH").cast("double") / F.lit(365.25),
        "employment_years": F.coalesce(-days_emp.cast("double") / F.lit(365.25), F.lit(0.0)),
    }
    cols.update(ratio_columns(F.col("AMT_INCOME_TOTAL"), F.col("AMT_CREDIT"), F.col("AMT_ANNUITY"),
                              F.col("AMT_GOODS_PRICE"), F.col("CNT_CHILDREN")))
    ext = [nan_to_null(c) for c in S.EXT_SOURCES]
    cols["external_source_mean"] = row_mean(ext)
    cols["external_source_std"] = row_std(ext, ddof)
    return app.withColumns(cols)


def bureau_features(bureau: DataFrame) -> DataFrame:
    """One row per applicant: active loans, overdue loans, debt/credit ratio
    (rows without an applicant key form no group).

    A single ``groupBy`` with partial (map-side) aggregation: a hot applicant
    holding a third of all bureau rows is reduced to one row per map task before
    the shuffle."""
    credit = F.coalesce(to_number(F.col("AMT_CREDIT_SUM")), F.lit(0.0))
    debt = F.coalesce(to_number(F.col("AMT_CREDIT_SUM_DEBT")), F.lit(0.0))
    agg = bureau.where(F.col(KEY).isNotNull()).groupBy(KEY).agg(
        F.count_if(F.col("CREDIT_ACTIVE") == "Active").alias("bureau_loans_active"),
        F.count_if(F.col("CREDIT_DAY_OVERDUE") > 0).alias("bureau_overdue_count"),
        F.sum(credit).alias("_credit"),
        F.sum(debt).alias("_debt"),
    )
    return agg.select(
        KEY, "bureau_loans_active", "bureau_overdue_count",
        safe_div(F.col("_debt"), F.col("_credit") + F.lit(1)).alias("bureau_debt_to_credit_ratio"))


def previous_features(prev: DataFrame) -> DataFrame:
    """One row per applicant: number of previous applications and approved share."""
    agg = prev.where(F.col(KEY).isNotNull()).groupBy(KEY).agg(
        F.count("SK_ID_PREV").alias("prev_application_count"),
        F.count_if(F.col("NAME_CONTRACT_STATUS") == "Approved").alias("_approved"))
    return agg.select(
        KEY, "prev_application_count",
        safe_div(F.col("_approved"), F.col("prev_application_count") + F.lit(1e-5)).alias("prev_approved_ratio"))


def join_history(app: DataFrame, bureau: DataFrame | None, prev: DataFrame | None) -> DataFrame:
    """Left-join the per-applicant aggregates; absent tables become constant 0.

    Both aggregates are one row per key, so the joins cannot skew; they are
    hash-partitioned on the key already and the planner reuses that
    partitioning."""
    out = app
    if bureau is not None:
        out = out.join(bureau_features(bureau), KEY, "left")
    else:
        out = out.withColumns({"bureau_loans_active": F.lit(0), "bureau_overdue_count": F.lit(0),
                               "bureau_debt_to_credit_ratio": F.lit(0.0)})
    if prev is not None:
        out = out.join(previous_features(prev), KEY, "left")
    else:
        out = out.withColumns({"prev_application_count": F.lit(0), "prev_approved_ratio": F.lit(0.0)})
    return out.withColumns({
        "bureau_loans_active": F.coalesce(F.col("bureau_loans_active").cast("long"), F.lit(0).cast("long")),
        "bureau_overdue_count": F.coalesce(F.col("bureau_overdue_count").cast("long"), F.lit(0).cast("long")),
        "bureau_debt_to_credit_ratio": F.coalesce(F.col("bureau_debt_to_credit_ratio"), F.lit(0.0)),
        "prev_application_count": F.coalesce(F.col("prev_application_count").cast("long"), F.lit(0).cast("long")),
        "prev_approved_ratio": F.coalesce(F.col("prev_approved_ratio"), F.lit(0.0)),
    })


def rename_to_model(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed(S.RAW_TO_MODEL)


def project_features(df: DataFrame, keep=(KEY, "TARGET")) -> DataFrame:
    """Key (+ label) and the 24 features in model order; non-categorical
    columns coerced to double."""
    cols = [F.col(c) for c in keep if c in df.columns]
    for c in S.FEATURES:
        if c in S.CATEGORICAL:
            cols.append(F.col(c))
        else:
            cols.append(to_number(F.col(c)).alias(c))
    return df.select(*cols)


def build_features(app: DataFrame, bureau: DataFrame | None = None, prev: DataFrame | None = None,
                   encoder=None, ddof: int = 1) -> DataFrame:
    """application (+ bureau, + previous) -> key, TARGET and the 24 features.

    With an ``encoder`` (see ``operators.encode``) the categorical columns are
    replaced by their codes, otherwise they stay as text."""
    df = join_history(application_features(app, ddof), bureau, prev)
    df = rename_to_model(df)
    if encoder is not None:
        df = encoder.transform(df)
    return project_features(df)


def request_features(req: DataFrame, encoder=None, ddof: int = 0, keep=("request_id",)) -> DataFrame:
    """Requests (16 API fields) -> the 24 model features.

    Absent numeric fields take the online defaults; the external-source
    standard deviation is the population one (``ddof=0``) as online."""
    d = S.ONLINE_DEFAULTS
    df = req.withColumnsRenamed(S.REQUEST_TO_MODEL)
    base = {
        "applicant_age": F.coalesce(F.col("applicant_age").cast("double"), F.lit(d["applicant_age"])),
        "income_total": F.coalesce(F.col("income_total").cast("double"), F.lit(d["income_total"])),
        "employment_years": F.coalesce(F.col("employment_years").cast("double"), F.lit(d["employment_years"])),
        "loan_amount": F.coalesce(F.col("loan_amount").cast("double"), F.lit(d["loan_amount"])),
        "loan_annuity": F.coalesce(F.col("loan_annuity").cast("double"), F.lit(d["loan_annuity"])),
        "goods_price": F.coalesce(F.col("goods_price").cast("double"), F.lit(d["goods_price"])),
        "num_children": F.coalesce(F.col("num_children").cast("int"), F.lit(d["num_children"])),
        "EXT_SOURCE_1": nan_to_null(F.col("EXT_SOURCE_1").cast("double")),
        "EXT_SOURCE_2": nan_to_null(F.col("EXT_SOURCE_2").cast("double")),
        "EXT_SOURCE_3": nan_to_null(F.col("EXT_SOURCE_3").cast("double")),
    }
    for c in ["bureau_loans_active", "bureau_overdue_count", "prev_application_count",
              "prev_approved_ratio"]:
        base[c] = F.coalesce(F.col(c).cast("double"), F.lit(d[c]))
    if "bureau_debt_to_credit_ratio" in df.columns:
        base["bureau_debt_to_credit_ratio"] = F.coalesce(F.col("bureau_debt_to_credit_ratio").cast("double"),
                                                         F.lit(d["bureau_debt_to_credit_ratio"]))
    else:
        base["bureau_debt_to_credit_ratio"] = F.lit(d["bureau_debt_to_credit_ratio"])
    df = df.withColumns(base)
    df = df.withColumns(ratio_columns(F.col("income_total"), F.col("loan_amount"), F.col("loan_annuity"),
                                      F.col("goods_price"), F.col("num_children")))
    ext = [F.col(c) for c in S.EXT_SOURCES]
    df = df.withColumns({"external_source_mean": row_mean(ext), "external_source_std": row_std(ext, ddof)})
    if encoder is not None:
        df = encoder.transform(df, unseen="fallback")
    else:
        df = df.withColumns({c: F.lit(0) for c in S.CATEGORICAL})
    return project_features(df, keep=keep)
