"""Registered queries that run streams and stores: requests scored as files arrive, with re-sent requests and a restart;
daily counts whose late rows are dropped; a log batch written twice; and what is saved and read again.

Every stream reads files, runs until they are used up (``availableNow``) and is started again from its checkpoint when more
have come.  Folders lie below ``spark.checkpoint.dir``."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from loanlens import schemas as S
from loanlens.functions.exprs import action_label
from loanlens.operators import drift as D
from loanlens.operators import ensemble as E
from loanlens.operators.encode import LabelEncoderModel, fit_label_encoder
from loanlens.operators.sampling import stratified_split
from loanlens.plans import book
from loanlens.plans import oracle_sql as O
from loanlens.plans.catalog import query
from loanlens.plans.queries_core import _LOG_COLS, _LOG_DOUBLES
from loanlens.plans.queries_eval import TEST_FRACTION, _hash_sql
from loanlens.plans.queries_requests import _req_features_sql, request_ctes, requests
from loanlens.session import checkpoint_dir
from loanlens.sources import derived
from loanlens.sources.readers import append_log, read_log, read_reference, write_reference
from loanlens.streaming import REQUEST_STREAM_SCHEMA, daily_grade_counts_stream, start_scoring

# How the streams are fed.  Requests come in two waves, by odd and even id; those of the first wave whose id
# ends in 0 are sent twice in it and once more in the second.  Events come in four waves of eight days; an event
# of a user whose number is divisible by 17 comes one wave late.
SCORING_WATERMARK = "60 days"
WAVES, WAVE_DAYS, LATE_USERS = 4, 8, 17
FIRST_DAY = "2024-01-01"


def scratch(spark, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}/{uuid.uuid4().hex}"


@query("stream_scoring_log", request_ctes(_req_features_sql()) + f""", scored_req AS (
  SELECT request_id, {O.margin_sql()} AS margin FROM req_features f)
SELECT 'pred_' || substr(sha256(CAST(request_id AS VARCHAR) || '|v1'), 1, 16) AS id, CAST(received_at AS DATE) AS log_date,
  1e0 / (1e0 + exp(-margin)) AS default_probability, {O.grade_sql('(1e0 / (1e0 + exp(-margin)))')[0]} AS credit_score,
  {O.grade_sql('(1e0 / (1e0 + exp(-margin)))')[1]} AS risk_grade
FROM scored_req JOIN requests USING (request_id)""", doubles=["default_probability"])
def stream_scoring_log(spark, sf):
    """M1, M2: the log of a scoring stream that met re-sent requests and was stopped and started again."""
    root = scratch(spark, "streams")
    req = requests(spark, sf).select(*[F.col(f.name).cast(f.dataType) for f in REQUEST_STREAM_SCHEMA.fields])
    req.write.parquet(f"{root}/all")
    req = spark.read.schema(REQUEST_STREAM_SCHEMA).parquet(f"{root}/all")
    again = req.where("request_id % 10 = 0")
    encoder = fit_label_encoder(derived.application(spark, sf))
    for wave in ([req.where("request_id % 2 = 0"), again], [req.where("request_id % 2 = 1"), again]):
        for part in wave:
            part.write.mode("append").parquet(f"{root}/incoming")
        for q in start_scoring(spark, f"{root}/incoming", f"{root}/log", f"{root}/quarantine", f"{root}/checkpoint",
                               E.fixed_ensemble(), encoder, dedupe=True, watermark=SCORING_WATERMARK):
            q.awaitTermination()
    return spark.read.parquet(f"{root}/log").select("id", "log_date", "default_probability", "credit_score", "risk_grade")


@query("stream_daily_counts", O.log_ctes(f"""fed AS (
  SELECT timestamp, risk_grade, default_probability,
    least({WAVES - 1}, date_diff('day', DATE '{FIRST_DAY}', CAST(timestamp AS DATE)) // {WAVE_DAYS}
      + CASE WHEN user_id % {LATE_USERS} = 0 THEN 1 ELSE 0 END) AS wave FROM inference_logs
)""", """marks AS (
  SELECT w.wave, max(f.timestamp) - INTERVAL 1 DAY AS watermark FROM (SELECT DISTINCT wave FROM fed) w JOIN fed f ON f.wave < w.wave GROUP BY w.wave
)""") + """SELECT CAST(timestamp AS DATE) AS day, risk_grade, count(*) AS n, avg(default_probability) AS avg_probability
FROM fed LEFT JOIN marks USING (wave)
WHERE (watermark IS NULL OR date_trunc('day', timestamp) + INTERVAL 1 DAY > watermark)
  AND date_trunc('day', timestamp) + INTERVAL 1 DAY <= (SELECT max(timestamp) - INTERVAL 1 DAY FROM fed)
GROUP BY 1, 2""", doubles=["avg_probability"])
def stream_daily_counts(spark, sf):
    """M3: finished days of a windowed stream; rows that come after their day was finished are dropped."""
    root = scratch(spark, "streams")
    late = F.coalesce((F.col("user_id") % LATE_USERS == 0).cast("int"), F.lit(0))
    wave = F.floor(F.date_diff(F.col("timestamp").cast("date"), F.lit(FIRST_DAY).cast("date")) / WAVE_DAYS) + late
    events = book.scored_events(spark, sf).withColumn("wave", F.least(F.lit(WAVES - 1), wave).cast("int"))
    events = events.select(F.col("timestamp").cast("timestamp").alias("timestamp"), "risk_grade", "default_probability", "wave")
    events.write.partitionBy("wave").parquet(f"{root}/all")
    schema = "timestamp timestamp, risk_grade string, default_probability double"
    for k in range(WAVES):
        # a wave without rows has no folder, and brings nothing
        part = spark.read.parquet(f"{root}/all").where(F.col("wave") == k).drop("wave")
        part.write.mode("append").parquet(f"{root}/incoming")
        counts = daily_grade_counts_stream(spark.readStream.schema(schema).parquet(f"{root}/incoming"))
        (counts.writeStream.format("parquet").option("path", f"{root}/days").option("checkpointLocation", f"{root}/checkpoint")
         .outputMode("append").trigger(availableNow=True).start().awaitTermination())
    return spark.read.parquet(f"{root}/days")


@query("append_log_replayed", O.log_ctes() + "SELECT " + ", ".join(_LOG_COLS) + ", CAST(timestamp AS DATE) AS log_date FROM inference_logs",
       doubles=_LOG_DOUBLES)
def append_log_replayed(spark, sf):
    """A log written by two batches, the first of them twice, read once."""
    path = scratch(spark, "logs")
    log = book.inference_log(spark, sf, with_factors=False, keep=("user_id",)).withColumn("odd", F.crc32("id") % 2)
    log.write.parquet(f"{path}/scored")
    log = spark.read.parquet(f"{path}/scored")
    for batch in (0, 1, 0):
        append_log(log.where(F.col("odd") == batch).drop("odd", "user_id"), f"{path}/log", f"batch-{batch}")
    return read_log(spark, f"{path}/log").select(*_LOG_COLS, "log_date")


@query("reference_round_trip", O.with_ctes(O.FEATURES) + f"""SELECT f.* FROM features f JOIN (
  SELECT SK_ID_CURR, row_number() OVER (PARTITION BY TARGET ORDER BY {_hash_sql('SK_ID_CURR')}, SK_ID_CURR) AS r,
    count(*) OVER (PARTITION BY TARGET) AS n FROM application) s USING (SK_ID_CURR) WHERE r <= round(n * {TEST_FRACTION}e0)""",
       doubles=[c for c in S.FEATURES if c not in S.CATEGORICAL])
def reference_round_trip(spark, sf):
    """A4, A5: the reference sample (the validation split), written twice and read again."""
    path = scratch(spark, "reference")
    feats, _ = book.book_features(spark, sf)
    sample = stratified_split(feats, TEST_FRACTION).where("is_validation").drop("is_validation")
    for _ in range(2):
        write_reference(sample, path)
    return read_reference(spark, path)


@query("encoder_round_trip", O.with_ctes() + """SELECT SK_ID_CURR,
  CAST(dense_rank() OVER (ORDER BY coalesce(NAME_EDUCATION_TYPE, 'Unknown')) - 1 AS INTEGER) AS NAME_EDUCATION_TYPE,
  CAST(dense_rank() OVER (ORDER BY coalesce(NAME_HOUSING_TYPE, 'Unknown')) - 1 AS INTEGER) AS NAME_HOUSING_TYPE
FROM application""")
def encoder_round_trip(spark, sf):
    """Label codes by an encoder that was saved and loaded."""
    path = scratch(spark, "encoder")
    app = derived.application(spark, sf)
    fit_label_encoder(app).save(spark, path)
    return LabelEncoderModel.load(spark, path).transform(app).select("SK_ID_CURR", *S.CATEGORICAL)


@query("action_labels", O.log_ctes() + "SELECT recommended_action, CASE recommended_action "
       + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in S.ACTION_LABELS.items())
       + " ELSE recommended_action END AS action_label, count(*) AS n FROM inference_logs GROUP BY ALL")
def action_labels(spark, sf):
    """E5: display labels of the recommended actions in the log."""
    ev = book.scored_events(spark, sf)
    return ev.groupBy("recommended_action").agg(F.count(F.lit(1)).alias("n")).select(
        "recommended_action", action_label("recommended_action").alias("action_label"), "n")


@query("drift_without_reference", f"""SELECT 'ERROR' AS report_status, count(*) AS total_predictions_since_deploy,
  FALSE AS dataset_drift_detected, 0e0 AS drift_share, 0::BIGINT AS n_drifted_features, 0e0 AS predicted_default_rate_reference,
  0e0 AS predicted_default_rate_current, 'ERROR' AS target_status, {O.text(S.DRIFT_RECOMMENDATIONS["no_reference"])} AS recommendation
FROM events""")
def drift_without_reference(spark, sf):
    """The drift summary where no reference sample has been written."""
    assert read_reference(spark, scratch(spark, "reference")) is None
    return D.missing_reference_summary(book.scored_events(spark, sf))
