"""Stats, distribution, history pages and factor JSON."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from loanlens.operators import monitoring as M
from loanlens.plans import book
from loanlens.sources.readers import parse_risk_factors

LOG_SCHEMA = "id string, timestamp timestamp, default_probability double, risk_grade string"


def _log(spark, grades, day=dt.datetime(2024, 1, 30, 9)):
    rows = [(f"pred_{i:08d}", day - dt.timedelta(hours=i), 0.1, g) for i, g in enumerate(grades)]
    return spark.createDataFrame(rows, LOG_SCHEMA)


def test_empty_log_stats(spark):
    s = M.system_stats(spark.createDataFrame([], LOG_SCHEMA), "2024-01-30 12:00:00").first()
    assert (s.total_predictions, s.avg_default_probability, s.system_health, s.active_alerts) == (0, 0.0, "OK", [])


def test_poor_share_threshold(spark):
    at = _log(spark, ["Poor"] * 7 + ["Good"] * 13)       # exactly 0.35 -> OK
    above = _log(spark, ["Poor"] * 8 + ["Good"] * 12)    # 0.40 -> WARNING
    assert M.system_stats(at, "2024-01-30 12:00:00").first().system_health == "OK"
    s = M.system_stats(above, "2024-01-30 12:00:00").first()
    assert s.system_health == "WARNING" and s.active_alerts == ["HIGH_DEFAULT_RATE_DETECTED"]
    assert s.today_predictions == 10  # 09:00 back to 00:00 of the as-of day


def test_distribution_zero_fills(spark):
    d = {r.risk_grade: r.n for r in M.risk_distribution(_log(spark, ["Good", "Good", "Fair"])).collect()}
    assert d == {"Excellent": 0, "Good": 2, "Fair": 1, "Poor": 0}


def test_pages_offset_and_keyset_agree(spark):
    log = book.inference_log(spark, "/root/testdata/sf0.001", with_factors=False)
    p1 = M.history_page(log, 1, 7).collect()
    p2 = M.history_page(log, 2, 7).collect()
    last = log.where(F.col("id") == p1[-1].prediction_id).first()
    keyset = M.history_page_after(log, last.timestamp, last.id, 7).collect()
    assert [r.prediction_id for r in p2] == [r.id for r in keyset]
    info = M.history_info(log, 1, 7, "Good").first()
    assert info.total_pages == max(1, -(-info.total_records // 7)) and info.total_all == log.count()
    with pytest.raises(ValueError):
        M.history_page(log, 0, 7)
    with pytest.raises(ValueError):
        M.history_page(log, 1, 101)


def test_factor_json_parsing(spark):
    df = spark.createDataFrame([('[{"feature":"a","display_name":"A","shap_value":0.5,"direction":"risk_increase",'
                                 '"description":"d"}]',), ("not json",), ("",), (None,)], "j string")
    sizes = [r[0] for r in df.select(F.size(parse_risk_factors("j"))).collect()]
    assert sizes == [1, 0, 0, 0]


def test_append_log_partitions_by_day(spark, tmp_path):
    from loanlens.sources.readers import append_log, read_log
    log = book.inference_log(spark, "/root/testdata/sf0.001", with_factors=False)
    path = str(tmp_path / "inference_logs")
    append_log(log, path, "one")
    append_log(log.limit(5), path, "two")  # a second append adds rows, keeps the old ones
    back = read_log(spark, path)
    assert back.count() == log.count() + 5
    today = back.where(F.col("log_date") == F.lit("2024-01-30").cast("date"))
    plan = today._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "log_date" in plan
    assert read_log(spark, str(tmp_path / "absent")) is None
