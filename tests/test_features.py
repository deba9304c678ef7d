"""Feature expressions, history aggregates, request features and encoding."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loanlens import schemas as S
from loanlens.functions.exprs import row_mean, row_std
from loanlens.operators.encode import LabelEncoderModel, fit_label_encoder
from loanlens.operators.features import (application_features, bureau_features, build_features,
                                         previous_features, request_features)

# The ten sample applicants of the reference UI (money in millions), F2 in FIXTURES.md.
SAMPLES = [
    (45, 0, "Higher education", "House / apartment", 60, 15, 100, 3.5, 120, 0, 0, 2, 1.0, .85, .90),
    (35, 1, "Higher education", "House / apartment", 30, 8, 150, 7, 150, 1, 0, 1, 1.0, .65, .68),
    (28, 2, "Secondary / secondary special", "Rented apartment", 15, 3, 200, 10, 180, 2, 0, 3, .67, .45, .52),
    (24, 0, "Secondary / secondary special", "With parents", 8, 1, 300, 25, 280, 4, 2, 2, 0.0, .15, .12),
    (52, 0, "Higher education", "House / apartment", 120, 20, 250, 8.5, 300, 0, 0, 0, 0.0, .88, .85),
    (27, 0, "Higher education", "House / apartment", 40, 4, 100, 5, 100, 1, 0, 1, 1.0, .58, .72),
    (40, 3, "Secondary / secondary special", "House / apartment", 25, 6, 350, 18, 320, 3, 0, 4, .75, .38, .45),
    (33, 2, "Secondary / secondary special", "Rented apartment", 10, 2, 80, 6, 70, 2, 1, 2, .5, .22, .19),
    (48, 1, "Higher education", "House / apartment", 180, 12, 500, 15, 550, 1, 0, 3, 1.0, .82, .91),
    (22, 0, "Secondary / secondary special", "Rented apartment", 5, 0, 120, 10, 100, 5, 3, 1, 0.0, .08, .05),
]


def sample_requests(spark):
    rows = []
    for i, s in enumerate(SAMPLES):
        age, kids, edu, hou, inc, emp, loan, ann, goods, act, ovd, prev, ratio, e2, e3 = s
        rows.append((i, float(age), inc * 1e6, float(emp), loan * 1e6, ann * 1e6, goods * 1e6, kids, edu, hou,
                     act, ovd, prev, float(ratio), None, float(e2), float(e3)))
    schema = "request_id int, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in S.REQUEST_SCHEMA.fields)
    return spark.createDataFrame(rows, schema)


def test_row_stats_skip_nulls(spark):
    df = spark.createDataFrame([(1.0, None, 3.0), (None, None, None), (None, 2.0, None)], "a double, b double, c double")
    r = df.select(row_mean(["a", "b", "c"]).alias("m"), row_std(["a", "b", "c"], 1).alias("s1"),
                  row_std(["a", "b", "c"], 0).alias("s0")).collect()
    assert r[0].m == 2.0 and math.isclose(r[0].s1, math.sqrt(2)) and math.isclose(r[0].s0, 1.0)
    assert r[1].m is None and r[1].s1 == 0.0 and r[1].s0 == 0.0
    assert r[2].m == 2.0 and r[2].s1 == 0.0 and r[2].s0 == 0.0


def test_request_features_of_sample_applicants(spark):
    feats = request_features(sample_requests(spark)).orderBy("request_id").collect()
    assert len(feats) == 10
    for row, s in zip(feats, SAMPLES):
        age, kids, edu, hou, inc, emp, loan, ann, goods, act, ovd, prev, ratio, e2, e3 = s
        assert math.isclose(row.loan_to_income_ratio, loan * 1e6 / (inc * 1e6 + 1))
        assert math.isclose(row.payment_rate, ann * 1e6 / (loan * 1e6 + 1))
        assert math.isclose(row.income_per_person, inc * 1e6 / (kids + 2))
        assert math.isclose(row.external_source_mean, (e2 + e3) / 2)
        assert math.isclose(row.external_source_std, float(np.std([e2, e3])), abs_tol=1e-12)  # population, online
        assert row.bureau_debt_to_credit_ratio == 0.0 and row.NAME_EDUCATION_TYPE == 0


def test_minimal_request_uses_online_defaults(spark):
    df = spark.createDataFrame([(1, 30.0, 10000.0, 2.0, 5000.0, 500.0, 5000.0)],
                               "request_id int, applicant_age double, income_total double, employment_years double, "
                               "loan_amount double, loan_annuity double, goods_price double")
    from loanlens.operators.validate import conform
    r = request_features(conform(df)).first()
    assert r.num_children == 0 and r.bureau_loans_active == 0 and r.prev_approved_ratio == 0
    assert r.external_source_mean is None and r.external_source_std == 0.0


def test_label_encoder_codes_and_unseen(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("é",)], "NAME_EDUCATION_TYPE string")
    enc = fit_label_encoder(df, columns=("NAME_EDUCATION_TYPE",))
    labels = [r.label for r in enc.table(spark).orderBy("code").collect()]
    assert labels == sorted(["a", "b", "Unknown", "é"])
    t = spark.createDataFrame([("a",), ("zzz",), (None,)], "NAME_EDUCATION_TYPE string")
    codes = [r[0] for r in enc.transform(t, unseen="fallback").collect()]
    assert codes == [labels.index("a"), labels.index("Unknown"), labels.index("Unknown")]
    # without 'Unknown' fitted, an unseen label takes the first label's code
    enc2 = LabelEncoderModel({"NAME_EDUCATION_TYPE": ["x", "y"]})
    assert [r[0] for r in enc2.transform(t, unseen="fallback").collect()] == [0, 0, 0]
    # an unfitted column encodes as 0
    assert enc2.with_codes(t, {"c": ("NAME_HOUSING_TYPE", "NAME_EDUCATION_TYPE")}).select("c").distinct().collect() == [(0,)]


def test_encoder_save_load_roundtrip(spark, tmp_path):
    many = [f"label {i}" for i in range(500)]
    enc = LabelEncoderModel({"NAME_EDUCATION_TYPE": ["b", "a"], "NAME_HOUSING_TYPE": ["Unknown", "x", *many]})
    enc.save(spark, str(tmp_path / "enc"))
    back = LabelEncoderModel.load(spark, str(tmp_path / "enc"))
    assert sorted(back.table(spark).collect()) == sorted(enc.table(spark).collect())
    assert sorted(back.columns) == sorted(enc.columns) and back.fallback(spark, "NAME_HOUSING_TYPE") == 0


def test_history_aggregates_and_missing_tables(spark):
    app = spark.createDataFrame(
        [(1, 0, -10000, 365243, 1000.0, 5000.0, 300.0, 4500.0, 1, "H", None, None, 0.5, None),
         (2, 1, -12000, -700, 2000.0, 9000.0, None, None, 0, "S", "R", 0.2, None, float("nan"))],
        S.APPLICATION_SCHEMA)
    bur = spark.createDataFrame([(1, "Active", 3, 100.0, 50.0), (1, "Closed", 0, None, None),
                                 (1, "Active", None, 100.0, float("nan"))], S.BUREAU_SCHEMA)
    prev = spark.createDataFrame([(10, 1, "Approved"), (11, 1, "Refused"), (None, 1, "Approved")], S.PREVIOUS_SCHEMA)
    from loanlens.sources.readers import read_table  # noqa: F401  (NaN handling lives in the scan)
    b = bureau_features(bur).first()
    assert (b.bureau_loans_active, b.bureau_overdue_count) == (2, 1)
    p = previous_features(prev).first()
    assert p.prev_application_count == 2 and math.isclose(p.prev_approved_ratio, 2 / (2 + 1e-5))
    out = {r.SK_ID_CURR: r for r in build_features(app, bur, prev).collect()}
    assert out[2].bureau_loans_active == 0 and out[2].prev_approved_ratio == 0.0
    assert out[1].employment_years == 0.0
    assert math.isclose(out[2].employment_years, 700 / 365.25)
    assert math.isclose(out[1].applicant_age, 10000 / 365.25)
    none = {r.SK_ID_CURR: r for r in build_features(app, None, None).collect()}
    assert none[1].bureau_loans_active == 0 and none[1].prev_application_count == 0
    assert none[2].external_source_std == 0.0  # one valid value, sample std -> 0
    assert list(build_features(app).columns) == ["SK_ID_CURR", "TARGET", *S.FEATURES]


def test_nan_becomes_null_at_the_scan(spark, tmp_path):
    from loanlens.sources.readers import read_table
    path = str(tmp_path / "app.parquet")
    spark.createDataFrame([(1, float("nan"))], "SK_ID_CURR long, EXT_SOURCE_1 double").write.parquet(path)
    assert read_table(spark, path).first().EXT_SOURCE_1 is None


def test_csv_columns_are_found_by_name(spark, tmp_path):
    import pytest
    from loanlens.sources.readers import read_table
    for schema in (S.APPLICATION_SCHEMA, S.BUREAU_SCHEMA, S.PREVIOUS_SCHEMA):
        names = [f.name for f in schema.fields]
        shuffled = ["EXTRA_1", *reversed(names), "EXTRA_2"]
        value = lambda f, k: f"t{k}" if f.dataType.simpleString() == "string" else str(k + 1)
        cells = {f.name: value(f, k) for k, f in enumerate(schema.fields)}
        bad = {f.name: (cells[f.name] if f.dataType.simpleString() == "string" else "n/a") for f in schema.fields}
        path = tmp_path / f"{names[-1]}.csv"
        path.write_text("\n".join([",".join(shuffled)] + [",".join(["x", *(row[n] for n in reversed(names)), "y"])
                                                          for row in (cells, bad)]) + "\n")
        good, broken = read_table(spark, str(path), schema).collect()
        for k, f in enumerate(schema.fields):
            text = f.dataType.simpleString() == "string"
            assert good[f.name] == (f"t{k}" if text else k + 1)
            assert broken[f.name] == (f"t{k}" if text else None)
        path.write_text(",".join(names[1:]) + "\n")
        with pytest.raises(ValueError, match=names[0]):
            read_table(spark, str(path), schema)


def test_csv_scan_with_declared_schema(spark, tmp_path):
    from loanlens.sources.readers import read_optional, scan_application
    path = tmp_path / "application.csv"
    path.write_text("SK_ID_CURR,TARGET,DAYS_BIRTH,DAYS_EMPLOYED,AMT_INCOME_TOTAL,AMT_CREDIT,AMT_ANNUITY,"
                    "AMT_GOODS_PRICE,CNT_CHILDREN,NAME_EDUCATION_TYPE,NAME_HOUSING_TYPE,EXT_SOURCE_1,EXT_SOURCE_2,"
                    "EXT_SOURCE_3,EXTRA\n"
                    "1,0,-12000,365243,1000,5000,,4500,1,Higher education,,0.5,NaN,0.2,x\n")
    df = scan_application(spark, str(path))
    r = df.first()
    assert r.SK_ID_CURR == 1 and r.AMT_ANNUITY is None and r.EXT_SOURCE_2 is None and r.NAME_HOUSING_TYPE is None
    assert "EXTRA" not in df.columns
    assert read_optional(spark, str(tmp_path / "bureau.csv"), S.BUREAU_SCHEMA) is None
