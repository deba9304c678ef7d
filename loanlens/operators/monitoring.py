"""Inference-log reporting: system stats, grade distribution, history pages,
daily grade counts.  Every report is one scan with one aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanlens import schemas as S
from loanlens.functions.exprs import iso_utc, utc_date
from loanlens.sources.readers import parse_risk_factors

MAX_PAGE_LIMIT = 100


def ts_literal(value: str, like: DataFrame, col: str = "timestamp") -> Column:
    """A literal of a UTC time in the flavour (TIMESTAMP / TIMESTAMP_NTZ) of ``col``, in any session zone."""
    if dict(like.dtypes)[col] == "timestamp_ntz":
        return F.lit(value).cast("timestamp_ntz")
    zoned = value if value.endswith("Z") or "+" in value else f"{value}Z"
    return F.lit(zoned).cast("timestamp")


def system_stats(log: DataFrame, as_of: str) -> DataFrame:
    """Totals, today's count (since midnight UTC of ``as_of``), mean probability,
    per-grade counts and the health rule -- a single global aggregate."""
    today = utc_date(ts_literal(as_of, log))
    agg = log.agg(
        F.count("id").alias("total_predictions"),
        F.count_if(utc_date("timestamp") >= today).alias("today_predictions"),
        F.coalesce(F.avg("default_probability"), F.lit(0.0)).alias("avg_default_probability"),
        *[F.count_if(F.col("risk_grade") == g).alias(f"risk_{g.lower()}") for g in S.GRADES],
    )
    poor_rate = F.try_divide(F.col("risk_poor").cast("double"), F.col("total_predictions").cast("double"))
    warn = (F.col("total_predictions") > 0) & (poor_rate > F.lit(S.POOR_RATE_ALERT))
    return agg.withColumns({
        "system_health": F.when(warn, F.lit("WARNING")).otherwise(F.lit("OK")),
        "active_alerts": F.array_compact(F.array(F.when(warn, F.lit(S.HIGH_DEFAULT_ALERT)))),
    })


def risk_distribution(log: DataFrame) -> DataFrame:
    """Count per grade, every grade present (absent ones 0)."""
    piv = log.groupBy().pivot("risk_grade", S.GRADES).agg(F.count(F.lit(1)))
    return piv.select(F.explode(F.array(*[
        F.struct(F.lit(g).alias("risk_grade"), F.coalesce(F.col(g), F.lit(0)).cast("long").alias("n"))
        for g in S.GRADES])).alias("x")).select("x.*")


def page_rows(log: DataFrame, page: int = 1, limit: int = 20, risk_grade: str | None = None) -> DataFrame:
    """The raw log rows of one page: newest first (id breaks ties), optional
    grade filter, limit/offset.  ``orderBy + offset + limit`` is planned as a
    bounded top-k (each task keeps at most ``page * limit`` rows), not a
    global sort."""
    if page < 1 or not 1 <= limit <= MAX_PAGE_LIMIT:
        raise ValueError("page >= 1 and 1 <= limit <= 100")
    df = log if risk_grade is None else log.where(F.col("risk_grade") == risk_grade)
    return df.orderBy(F.desc("timestamp"), F.asc("id")).offset((page - 1) * limit).limit(limit)


def project_page(rows: DataFrame) -> DataFrame:
    """L1: the 12 output columns of a page, newest first."""
    return rows.orderBy(F.desc("timestamp"), F.asc("id")).select(
        F.col("id").alias("prediction_id"),
        iso_utc("timestamp").alias("timestamp"),
        F.concat(F.lit(S.APPLICANT_NAME_PREFIX), F.right(F.col("id"), F.lit(4))).alias("applicant_name"),
        "applicant_age", "income_total", "loan_amount", "default_probability", "credit_score",
        "risk_grade", "recommended_action",
        F.col("shap_plot_path").alias("shap_plot_url"),
        parse_risk_factors("top_risk_factors_json").alias("top_risk_factors"),
    )


def history_page(log: DataFrame, page: int = 1, limit: int = 20, risk_grade: str | None = None) -> DataFrame:
    """One page of the history."""
    return project_page(page_rows(log, page, limit, risk_grade))


def history_page_after(log: DataFrame, after_ts, after_id: str, limit: int = 20,
                       risk_grade: str | None = None) -> DataFrame:
    """Keyset form for deep pages: rows strictly after (ts, id) in page order."""
    df = log if risk_grade is None else log.where(F.col("risk_grade") == risk_grade)
    ts = F.lit(after_ts).cast(dict(log.dtypes)["timestamp"])
    df = df.where((F.col("timestamp") < ts) | ((F.col("timestamp") == ts) & (F.col("id") > F.lit(after_id))))
    return df.orderBy(F.desc("timestamp"), F.asc("id")).limit(limit)


def history_info(log: DataFrame, page: int, limit: int, risk_grade: str | None = None) -> DataFrame:
    """Page context: filtered total, unfiltered total and page count (>= 1)."""
    cond = F.lit(True) if risk_grade is None else (F.col("risk_grade") == risk_grade)
    agg = log.agg(F.count_if(cond).alias("total_records"), F.count(F.lit(1)).alias("total_all"))
    return agg.select(
        F.lit(page).alias("page"), F.lit(limit).alias("limit"), "total_records", "total_all",
        F.greatest(F.ceil(F.col("total_records") / F.lit(limit)), F.lit(1)).cast("long").alias("total_pages"))


def daily_grade_counts(log: DataFrame) -> DataFrame:
    """Per UTC day and grade: count and mean probability (batch twin of the stream)."""
    return (log.groupBy(utc_date("timestamp").alias("day"), "risk_grade")
               .agg(F.count(F.lit(1)).alias("n"), F.avg("default_probability").alias("avg_probability")))


def with_model_info(stats: DataFrame, model_version: str, trained_at: str | None) -> DataFrame:
    """L4: stamp the stats row with the serving model's version and its real
    training time (from the saved model's metadata), instead of constants."""
    return stats.withColumns({"model_version": F.lit(model_version),
                              "model_trained_at": F.lit(trained_at).cast("timestamp")})


def model_trained_at(spark, model_path: str) -> str | None:
    """Training time recorded in a saved Spark ML model's metadata (UTC)."""
    try:
        meta = spark.read.json(f"{model_path.rstrip('/')}/metadata").first()
    except Exception:  # noqa: BLE001 - no model, no time
        return None
    if meta is None or meta["timestamp"] is None:
        return None
    import datetime as _dt
    return _dt.datetime.fromtimestamp(meta["timestamp"] / 1000, _dt.timezone.utc).strftime("%Y-%m-%d %H:%M:%S")
