"""Streaming scoring equals batch scoring; dedup and daily counts."""

from pyspark.sql import functions as F

from loanlens.operators import ensemble as E
from loanlens.operators.encode import fit_label_encoder
from loanlens.plans import book
from loanlens.sources import derived
from loanlens.streaming import (REQUEST_STREAM_SCHEMA, daily_grade_counts_stream, score_requests_frame,
                                start_scoring)

SF = "/root/testdata/sf0.001"


def _requests(spark):
    text, _ = book.book_features(spark, SF, encoded=False)
    req = derived.requests(spark, SF, text)
    return req.select(*[F.col(f.name).cast(f.dataType) for f in REQUEST_STREAM_SCHEMA.fields])


def test_stream_equals_batch(spark, tmp_path):
    req = _requests(spark)
    src = str(tmp_path / "incoming")
    req.repartition(4).write.parquet(src)
    enc = fit_label_encoder(derived.application(spark, SF))
    ens = E.fixed_ensemble()
    q1, q2 = start_scoring(spark, src, str(tmp_path / "log"), str(tmp_path / "quarantine"), str(tmp_path / "ckpt"),
                           ens, enc, max_files_per_trigger=1)
    q1.awaitTermination()
    q2.awaitTermination()
    log = spark.read.parquet(str(tmp_path / "log"))
    quarantine = spark.read.parquet(str(tmp_path / "quarantine"))
    batch_log, batch_q = score_requests_frame(req, ens, enc)
    cols = ["id", "default_probability", "credit_score", "risk_grade"]
    assert sorted(log.select(*cols).collect()) == sorted(batch_log.select(*cols).collect())
    # the streamed log has all columns of the batch log, factors included, and its reports run on it
    from loanlens.operators.monitoring import history_page, system_stats
    batch = book.inference_log(spark, SF, with_factors=False)
    assert set(log.columns) - {"log_date"} == set(batch.columns)
    assert len(batch.columns) == 27
    page = history_page(log, 1, 5).collect()
    assert len(page) == 5 and all(len(r.top_risk_factors) == 6 for r in page)
    assert system_stats(log, "2024-01-31 12:00:00").first().total_predictions == log.count()
    assert sorted(log.select("id", "top_risk_factors_json").collect()) == sorted(batch_log.select("id", "top_risk_factors_json").collect())
    assert quarantine.count() == batch_q.count()
    assert log.count() + quarantine.count() == req.count()
    # a restart with the same checkpoint adds nothing (exactly-once sink)
    q1, q2 = start_scoring(spark, src, str(tmp_path / "log"), str(tmp_path / "quarantine"), str(tmp_path / "ckpt"),
                           ens, enc)
    q1.awaitTermination()
    q2.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "log")).count() == log.count()


def test_dedupe_within_watermark(spark, tmp_path):
    req = _requests(spark).where(F.col("received_at") < F.lit("2024-01-03").cast("timestamp"))
    src = str(tmp_path / "incoming")
    req.coalesce(1).write.mode("append").parquet(src)
    req.coalesce(1).write.mode("append").parquet(src)  # the same requests sent twice
    enc = fit_label_encoder(derived.application(spark, SF))
    q1, q2 = start_scoring(spark, src, str(tmp_path / "log"), str(tmp_path / "q"), str(tmp_path / "ckpt"),
                           E.fixed_ensemble(), enc, dedupe=True)
    q1.awaitTermination()
    q2.awaitTermination()
    log = spark.read.parquet(str(tmp_path / "log"))
    assert log.count() == log.select("id").distinct().count() > 0


def test_daily_counts_stream_matches_batch(spark, tmp_path):
    from loanlens.operators.monitoring import daily_grade_counts
    log = book.inference_log(spark, SF, with_factors=False).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    src = str(tmp_path / "log")
    log.write.parquet(src)
    stream = spark.readStream.schema(log.schema).parquet(src)
    q = (daily_grade_counts_stream(stream).writeStream.outputMode("complete").format("memory")
         .queryName("daily_counts_test").trigger(availableNow=True).start())
    q.awaitTermination()
    got = {(r.day, r.risk_grade): r.n for r in spark.table("daily_counts_test").collect()}
    want = {(r.day, r.risk_grade): r.n for r in daily_grade_counts(log).collect()}
    assert got == want


def test_daily_counts_drop_rows_behind_the_watermark(spark, tmp_path):
    import datetime as dt
    import time as _time
    schema = "id string, timestamp timestamp, risk_grade string, default_probability double"
    src = str(tmp_path / "log")
    first = [(f"a{i}", dt.datetime(2024, 1, 5, 10), "Good", 0.2) for i in range(3)] + \
            [(f"b{i}", dt.datetime(2024, 1, 1, 10), "Good", 0.2) for i in range(2)]
    late = [(f"c{i}", dt.datetime(2024, 1, 1, 11), "Good", 0.2) for i in range(4)]
    middle = [("m0", dt.datetime(2024, 1, 5, 12), "Good", 0.2)]
    # the file source takes files in modification order; late rows are judged
    # against the watermark of the batch before (Spark's rule for chained
    # stateful operators), so the late file comes third
    for rows in (first, middle, late):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        _time.sleep(1.1)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = (daily_grade_counts_stream(stream).writeStream.outputMode("update").format("memory")
         .queryName("late_rows_test").trigger(availableNow=True).start())
    q.awaitTermination()
    rows = spark.table("late_rows_test").collect()
    jan1 = max(r.n for r in rows if str(r.day) == "2024-01-01")
    assert jan1 == 2  # the four rows more than a day behind the newest were dropped


def test_stream_scores_with_a_fitted_model(spark, tmp_path):
    from loanlens.operators import model as MD
    from loanlens.operators.sampling import stratified_split
    feats, enc = book.book_features(spark, SF)
    model = MD.train(stratified_split(feats, 0.2), {"maxIter": 5, "maxDepth": 3})
    req = _requests(spark)
    src = str(tmp_path / "incoming")
    req.coalesce(2).write.parquet(src)
    q1, q2 = start_scoring(spark, src, str(tmp_path / "log"), str(tmp_path / "q"), str(tmp_path / "ckpt"),
                           model, enc)
    q1.awaitTermination()
    q2.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "log")).select("id", "default_probability")
    want, _ = score_requests_frame(req, model, enc)
    assert sorted(got.collect()) == sorted(want.select("id", "default_probability").collect())
