"""Decision rules: the reference's literal cases plus boundaries and nulls."""

from loanlens.operators.decision import classify, prediction_id


def decide(spark, ps):
    df = spark.createDataFrame([(i, p) for i, p in enumerate(ps)], "i int, p double")
    rows = classify(df, prob_col="p", details=True).orderBy("i").collect()
    return rows


def test_reference_cases(spark):
    r = decide(spark, [0.05, 0.15, 0.20, 0.40, 0.75])
    assert (r[0].risk_grade, r[0].recommended_action, r[0].risk_color) == ("Excellent", "AUTO_APPROVE", "#10b981")
    assert r[0].credit_score >= 750
    assert (r[1].credit_score, r[1].risk_grade, r[1].recommended_action) == (768, "Good", "APPROVE_WITH_CONDITIONS")
    assert r[2].risk_grade == "Good" and 650 <= r[2].credit_score < 750
    assert (r[3].risk_grade, r[3].recommended_action) == ("Fair", "MANUAL_REVIEW") and 500 <= r[3].credit_score < 650
    assert (r[4].risk_grade, r[4].recommended_action, r[4].risk_color) == ("Poor", "REJECT", "#ef4444")
    assert r[4].credit_score < 500


def test_clamp_and_inclusive_bounds(spark):
    r = decide(spark, [-0.1, 1.5, 0.10, 0.25, 0.50])
    assert r[0].clamped_probability == 0.0 and r[0].credit_score == 850
    assert r[1].clamped_probability == 1.0 and r[1].credit_score == 300
    assert (r[2].risk_grade, r[2].credit_score) == ("Excellent", 795)
    assert (r[3].risk_grade, r[3].credit_score) == ("Good", 713)
    assert (r[4].risk_grade, r[4].credit_score) == ("Fair", 575)


def test_null_and_nan_give_null_decision(spark):
    df = spark.createDataFrame([(0, None), (1, float("nan"))], "i int, p double")
    for row in classify(df, prob_col="p").collect():
        assert row.risk_grade is None and row.credit_score is None and row.recommended_action is None


def test_score_range_and_monotone(spark):
    ps = [i / 200 for i in range(201)]
    scores = [r.credit_score for r in decide(spark, ps)]
    assert all(300 <= s <= 850 for s in scores)
    assert all(a >= b for a, b in zip(scores, scores[1:]))


def test_prediction_id_is_deterministic(spark):
    df = spark.createDataFrame([(1,), (2,)], "k long")
    a = df.select(prediction_id("k").alias("id")).collect()
    b = df.select(prediction_id("k").alias("id")).collect()
    assert a == b and all(r.id.startswith("pred_") and len(r.id) == 21 for r in a)


def test_utc_in_another_session_zone(spark):
    from pyspark.sql import functions as F
    from loanlens.functions.exprs import iso_utc, utc_date
    from loanlens.operators.monitoring import daily_grade_counts, system_stats
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        df = spark.sql("select 'a' as id, 'Good' as risk_grade, 0.5D as default_probability, timestamp'2024-03-05 02:00:00Z' as timestamp,"
                       " timestamp_ntz'2024-03-05 02:00:00' as ntz")
        r = df.select(iso_utc("timestamp").alias("a"), iso_utc("ntz").alias("b"), utc_date("timestamp").cast("string").alias("c"),
                      utc_date("ntz").cast("string").alias("d")).first()
        assert r.a == r.b == "2024-03-05T02:00:00.000000Z" and r.c == r.d == "2024-03-05"
        for log in (df.drop("ntz"), df.drop("timestamp").withColumnRenamed("ntz", "timestamp")):
            assert system_stats(log, "2024-03-05 23:00:00").first().today_predictions == 1
            assert system_stats(log, "2024-03-06 00:30:00").first().today_predictions == 0
            assert str(daily_grade_counts(log).first().day) == "2024-03-05"
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_action_labels(spark):
    from loanlens import schemas as S
    from loanlens.functions.exprs import action_label
    rows = [(a,) for a in [*S.ACTION_LABELS, "OTHER", None]]
    got = spark.createDataFrame(rows, "a string").select("a", action_label("a").alias("l")).collect()
    assert [r.l for r in got] == [*S.ACTION_LABELS.values(), "OTHER", None]
    assert set(S.ACTION_LABELS) == {row[2] for row in S.GRADE_TABLE}
