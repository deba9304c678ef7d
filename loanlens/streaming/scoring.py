"""Score loan applications as they arrive and keep the daily grade counts up
to date.

The per-batch logic is the batch code itself (validation, request features,
leaf-table scoring, decisions), applied to a streaming DataFrame; only the
source, the sinks and the watermark differ.  File sinks with a checkpoint
location are exactly-once, so a lost executor or a restarted driver replays
without duplicating log rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanlens import schemas as S
from loanlens.operators import ensemble as E
from loanlens.operators.decision import classify, prediction_id
from loanlens.operators.features import request_features
from loanlens.sources.readers import risk_factors_json
from loanlens.functions.exprs import utc_date
from loanlens.operators.validate import split_valid, validate_requests

REQUEST_STREAM_SCHEMA = T.StructType(
    [T.StructField("request_id", T.LongType()), T.StructField("received_at", T.TimestampType())]
    + list(S.REQUEST_SCHEMA.fields))

LOG_WATERMARK = "1 day"


def score_requests_frame(requests: DataFrame, ens, encoder, model_version: str = "v1"):
    """(scored valid rows in log layout, quarantined rows).  Works on batch and
    streaming DataFrames alike: every step is row-local, no join.  ``ens`` is a
    leaf-table ``Ensemble`` or a fitted GBT ``PipelineModel`` (large models are
    better scored by the model itself than by one CASE branch per leaf)."""
    return _stream_scored(requests, ens, encoder, model_version)


def _stream_scored(requests: DataFrame, ens, encoder, model_version):
    """Validation, features, scores and decisions as row-local projections
    (the raw request fields ride along for the log)."""
    validated = validate_requests(requests, keep=("request_id", "received_at"))
    valid, quarantine = split_valid(validated)
    raw_cols = {f"_raw_{c}": F.col(c) for c in S.REQUEST_FIELDS}
    carried = valid.withColumns(raw_cols)
    feats = request_features(carried, encoder=encoder, ddof=0,
                             keep=("request_id", "received_at", *raw_cols.keys()))
    if isinstance(ens, E.Ensemble):
        scored = E.score(feats, ens)          # leaf table as CASE expressions
    else:
        from loanlens.operators.model import predict_proba
        scored = predict_proba(ens, feats)    # a fitted PipelineModel, scored in the JVM
    scored = classify(scored, prob_col="probability")
    explained = explain(scored, ens)
    pid = prediction_id("request_id", model_version=model_version)
    log = explained.select(
        pid.alias("id"),
        F.col("received_at").cast("timestamp").alias("timestamp"),
        *[F.col(f"_raw_{c}").alias(c) for c in S.REQUEST_FIELDS],
        "loan_to_income_ratio", "annuity_to_income_ratio", "credit_to_goods_ratio",
        F.col("probability").alias("default_probability"), "credit_score", "risk_grade", "recommended_action",
        "top_risk_factors_json", F.concat(F.lit("/static/assets/shap_plots/"), pid, F.lit(".png")).alias("shap_plot_path"))
    return log, quarantine


def explain(scored: DataFrame, ens) -> DataFrame:
    """Add ``top_risk_factors_json``: the TreeSHAP factors of every row, worked
    out row by row next to its features.  A fitted model without a leaf table
    (``model.to_ensemble``) leaves the text NULL."""
    if not isinstance(ens, E.Ensemble):
        return scored.withColumn("top_risk_factors_json", F.lit(None).cast("string"))
    return E.with_factors(scored, ens).withColumn("top_risk_factors_json", risk_factors_json("top_risk_factors")).drop("top_risk_factors")


def dedupe_predictions(log: DataFrame, watermark: str = LOG_WATERMARK) -> DataFrame:
    """M2: one row per prediction id within the watermark (replays of the same
    request produce the same id, see ``prediction_id``)."""
    return log.withWatermark("timestamp", watermark).dropDuplicatesWithinWatermark(["id"])


def start_scoring(spark: SparkSession, source_dir: str, log_dir: str, quarantine_dir: str,
                  checkpoint_root: str, ens, encoder, model_version: str = "v1",
                  available_now: bool = True, max_files_per_trigger: int | None = None, dedupe: bool = False,
                  watermark: str = LOG_WATERMARK):
    """M1: file source of request Parquet files -> scored log (Parquet,
    partitioned by day, append) and quarantine; returns the two queries.

    The file sink with its checkpoint already makes replays exactly-once;
    ``dedupe`` (M2) also drops requests re-sent by clients within the
    watermark -- at the price of dropping requests that arrive more than the
    watermark after newer ones."""
    reader = spark.readStream.schema(REQUEST_STREAM_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    requests = reader.parquet(source_dir)
    log, quarantine = _stream_scored(requests, ens, encoder, model_version)
    if dedupe:
        log = dedupe_predictions(log, watermark)
    log = log.withColumn("log_date", utc_date("timestamp"))

    def sink(df, path, name, partition=None):
        w = (df.writeStream.format("parquet").option("path", path)
               .option("checkpointLocation", f"{checkpoint_root.rstrip('/')}/{name}").outputMode("append"))
        if partition:
            w = w.partitionBy(partition)
        w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
        return w.start()

    q1 = sink(log, log_dir, "log", "log_date")
    q2 = sink(quarantine.withColumn("violations", F.array_join("violations", ",")), quarantine_dir, "quarantine")
    return q1, q2


def daily_grade_counts_stream(log: DataFrame, watermark: str = LOG_WATERMARK) -> DataFrame:
    """M3: per UTC day and grade, count and mean probability; a day is final
    once the watermark passes its end, later rows for it are dropped."""
    ts = F.col("timestamp").cast("timestamp")
    return (log.withColumn("timestamp", ts).withWatermark("timestamp", watermark)
               .groupBy(F.window("timestamp", "1 day").alias("w"), "risk_grade")
               .agg(F.count(F.lit(1)).alias("n"), F.avg("default_probability").alias("avg_probability"))
               .select(utc_date("w.start").alias("day"), "risk_grade", "n", "avg_probability"))
