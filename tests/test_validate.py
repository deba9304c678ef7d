"""Request validation: required fields, ranges, defaults, unknown fields."""

from loanlens import schemas as S
from loanlens.operators.validate import split_valid, validate_requests

FULL = (1, 35.5, 45000000.0, 8.0, 250000000.0, 15000000.0, 230000000.0, 1, "Higher education", "House / apartment",
        2, 0, 3, 0.67, 0.55, 0.62, 0.48)
SCHEMA = "request_id int, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in S.REQUEST_SCHEMA.fields)


def test_full_and_minimal_rows_are_valid(spark):
    df = spark.createDataFrame([FULL], SCHEMA)
    v = validate_requests(df).first()
    assert v.is_valid and v.violations == []
    minimal = spark.createDataFrame([(2, 30.0, 10000.0, 2.0, 5000.0, 500.0, 5000.0, "extra")],
                                    "request_id int, applicant_age double, income_total double, employment_years double,"
                                    " loan_amount double, loan_annuity double, goods_price double, unknown string")
    m = validate_requests(minimal).first()
    assert m.is_valid
    assert (m.num_children, m.education_type, m.housing_type, m.prev_approved_ratio) == (
        0, "Higher education", "House / apartment", 0.0)
    assert "unknown" not in validate_requests(minimal).columns


def test_violations(spark):
    bad = list(FULL)
    bad[0] = 3
    bad[1] = 17.0        # age < 18
    bad[3] = 81.0        # employment > 80
    bad[5] = None        # loan_annuity missing
    bad[13] = 1.5        # ratio > 1
    bad[15] = float("nan")
    df = spark.createDataFrame([tuple(bad), FULL], SCHEMA)
    valid, quarantine = split_valid(validate_requests(df))
    assert valid.count() == 1
    q = quarantine.first()
    assert q.violations == ["missing:loan_annuity", "range:applicant_age", "range:employment_years",
                            "range:prev_approved_ratio", "range:external_source_2"]


def test_boundaries_are_inclusive(spark):
    row = list(FULL)
    row[1], row[3], row[13], row[14] = 18.0, 80.0, 1.0, 0.0
    assert validate_requests(spark.createDataFrame([tuple(row)], SCHEMA)).first().is_valid


def test_values_of_another_type_are_quarantined(spark):
    from loanlens import schemas as S
    from loanlens.operators.validate import validate_requests
    ints = [f.name for f in S.REQUEST_SCHEMA.fields if f.dataType.simpleString() == "int"]
    doubles = [f.name for f in S.REQUEST_SCHEMA.fields if f.dataType.simpleString() == "double"]
    names = [f.name for f in S.REQUEST_SCHEMA.fields]
    rows = []
    for k, (i, d) in enumerate([("abc", "1.5"), ("1.7", "x"), ("1.0", "2"), ("1e99", "1")]):
        rows.append((k, *[i if n in ints[:1] else d if n in doubles[:1] else None for n in names]))
    df = spark.createDataFrame(rows, "request_id long, " + ", ".join(f"{n} string" for n in names))
    got = {r.request_id: r for r in validate_requests(df).collect()}
    typed = {k: sorted(v for v in r.violations if v.startswith("type:")) for k, r in got.items()}
    assert typed == {0: [f"type:{ints[0]}"], 1: sorted([f"type:{ints[0]}", f"type:{doubles[0]}"]), 2: [], 3: [f"type:{ints[0]}"]}
    assert got[2][ints[0]] == 1 and f"missing:{ints[0]}" not in got[0].violations
