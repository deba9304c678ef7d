"""Drift: identical samples are stable, statistics against direct formulas,
the minimum-volume and missing-reference guards."""

import math

import numpy as np
from pyspark.sql import functions as F

from loanlens.operators import drift as D


def _frames(spark, n_ref=300, n_cur=200, shift=0.0, seed=1):
    rng = np.random.default_rng(seed)

    def make(n, s, prob):
        rows = []
        for i in range(n):
            rows.append((i, float(rng.normal(s, 1)), float(rng.integers(0, 5)), str(rng.integers(0, 3)),
                         float(prob if prob is not None else rng.integers(0, 2))))
        return spark.createDataFrame(rows, "SK_ID_CURR long, applicant_age double, num_children double, "
                                           "NAME_EDUCATION_TYPE string, TARGET double")
    return make(n_ref, 0.0, None), make(n_cur, shift, 0.5)


def test_table_against_itself_is_stable(spark):
    ref, _ = _frames(spark)
    out = {r.feature: r for r in D.drift_features(ref, ref).collect()}
    for f in ("applicant_age", "num_children"):
        assert out[f].statistic == 0.0 and out[f].p_value == 1.0 and abs(out[f].psi) < 1e-12
        assert out[f].status == "STABLE"
    assert out["NAME_EDUCATION_TYPE"].statistic == 0.0 and out["NAME_EDUCATION_TYPE"].p_value == 1.0


def test_shift_is_detected_and_ks_matches_direct(spark):
    ref, cur = _frames(spark, shift=1.0)
    out = {r.feature: r for r in D.drift_features(ref, cur).collect()}
    a = np.array([r.applicant_age for r in ref.collect()])
    b = np.array([r.applicant_age for r in cur.collect()])
    grid = np.union1d(a, b)
    d = max(abs(np.searchsorted(np.sort(a), v, "right") / len(a) - np.searchsorted(np.sort(b), v, "right") / len(b))
            for v in grid)
    assert math.isclose(out["applicant_age"].statistic, d, rel_tol=1e-12)
    assert out["applicant_age"].status == "DRIFTED" and out["applicant_age"].alert == "WARNING"
    assert out["TARGET"].test == "z_test"
    s = D.drift_summary(D.drift_features(ref, cur), cur).first()
    assert s.report_status == "OK" and s.n_drifted_features >= 1
    assert math.isclose(s.predicted_default_rate_current, 0.5)


def test_minimum_volume_guard(spark):
    ref, cur = _frames(spark)
    nine, ten = cur.limit(9), cur.limit(10)
    s9 = D.drift_summary(D.drift_features(ref, nine), nine).first()
    assert s9.report_status == "NOT_ENOUGH_DATA" and s9.target_status == "NOT_ENOUGH_DATA"
    assert "(hiện có: 9)" in s9.recommendation and s9.drift_share == 0.0
    s10 = D.drift_summary(D.drift_features(ref, ten), ten).first()
    assert s10.report_status == "OK"


def test_missing_reference_and_compat_fill(spark):
    ref, cur = _frames(spark)
    s = D.missing_reference_summary(cur).first()
    assert s.report_status == "ERROR" and s.total_predictions_since_deploy == 200
    with_null = ref.withColumn("applicant_age", F.when(F.col("SK_ID_CURR") % 2 == 0, None).otherwise(F.col("applicant_age")))
    out = {r.feature: r for r in D.drift_features(with_null, cur).collect()}
    assert math.isclose(out["applicant_age"].null_share_reference, 0.5)
    compat = {r.feature: r for r in D.drift_features(with_null, cur, compat=True).collect()}
    assert compat["applicant_age"].null_share_reference == 0.0


def test_chi2_p_value_table():
    # p = 0.05 critical values for dof 1..5
    from loanlens.session import get_spark
    from loanlens.functions.stats import chi2_p_value, ks_p_value
    spark = get_spark()
    crit = [(3.841458820694124, 1), (5.991464547107979, 2), (7.814727903251178, 3), (9.487729036781154, 4),
            (11.070497693516351, 5)]
    df = spark.createDataFrame(crit, "x double, k int")
    for r in df.select(chi2_p_value(F.col("x"), F.col("k")).alias("p")).collect():
        assert abs(r.p - 0.05) < 1e-6
    ks = spark.createDataFrame([(1.3581,)], "lam double").select(
        ks_p_value(F.col("lam") / F.lit(10.0), F.lit(200), F.lit(200)).alias("p")).first().p
    assert 0 < ks < 1


def test_drift_report_record(spark):
    from loanlens.operators import drift as D
    from loanlens.plans.queries_drift import drift_inputs
    ref, cur, enc = drift_inputs(spark, "/root/testdata/sf0.001")
    r = D.drift_report(ref, cur, "2024-02-01 00:00:00", enc).first()
    assert r.report_status == "OK" and r.error is None and str(r.run_at) == "2024-02-01 00:00:00"
    assert [f.feature for f in r.features] == D.common_columns(ref, cur)
    assert sum(f.is_drifted for f in r.features) == r.n_drifted_features
    none = D.drift_report(None, cur, "2024-02-01 00:00:00").first()
    assert none.report_status == "ERROR" and none.features == [] and none.total_predictions_since_deploy == cur.count()
    # a reference whose numbers are not numbers: the failure is the report
    from pyspark.sql import functions as F
    broken = ref.withColumn("applicant_age", F.lit("not a number"))
    failed = D.drift_report(broken, cur, "2024-02-01 00:00:00", enc).first()
    assert failed.report_status == "ERROR" and failed.error and failed.features == []


def test_target_test_uses_both_variances(spark):
    """Probabilities with the mean of the labels are no drift, a pooled proportion's variance would hide a small shift."""
    import random
    from loanlens.operators import drift as D
    rng = random.Random(3)
    labels = [(float(i % 10 == 0),) for i in range(4000)]
    same = [(min(1.0, max(0.0, rng.gauss(0.1, 0.02))),) for _ in range(4000)]
    shifted = [(p + 0.012,) for (p,) in same]
    made = lambda rows: spark.createDataFrame(rows, "TARGET double")
    target = lambda a, b: D.drift_features(made(a), made(b)).where("feature = 'TARGET'").first()
    assert not target(labels, same).is_drifted and not target(same, same[::-1]).is_drifted
    assert target(labels, shifted).is_drifted and target(same, shifted).is_drifted
    z = (0.1 - sum(p for p, in same) / 4000) / ((sum((y - 0.1) ** 2 for y, in labels) / 3999
        + sum((p - sum(q for q, in same) / 4000) ** 2 for p, in same) / 3999) / 4000) ** 0.5
    assert abs(target(labels, same).statistic - z) < 1e-6
    constant = target([(0.5,)] * 5, [(0.5,)] * 7)
    assert not constant.is_drifted and target([(0.5,)] * 5, [(0.25,)] * 7).is_drifted
