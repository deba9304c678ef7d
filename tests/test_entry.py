"""Driver contract and a DuckDB oracle smoke run on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check_oracle import TABLES, rows_of

SF = "/root/testdata/sf0.001"
FAST = ["features_all", "feature_bureau", "classify", "history_page", "monitoring_stats", "roc_auc",
        "stratified_kfold", "eda_payment_rate_quintiles", "tree_shap", "top_factors", "score_requests",
        "drift_features", "drift_summary", "grade_book"]


def test_entry_runs(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert rows and set(df.columns) >= {"risk_grade", "applicants"}


def test_every_oracle_has_a_query():
    qs, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(qs) and len(sql) >= 50


@pytest.mark.parametrize("name", FAST)
def test_oracle_smoke(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    df = entry.queries()[name](spark, SF)
    res = con.execute(entry.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(dcols)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(dcols, res.fetchall())


def test_bench_prints_one_json_line():
    import json
    import subprocess
    import sys
    env = dict(os.environ, BENCH_SF_DIR=SF, BENCH_QUERIES="monitoring_stats,feature_bureau", BENCH_CPUS="2")
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = subprocess.run([sys.executable, os.path.join(repo, "bench.py")], env=env, capture_output=True, text=True,
                         timeout=600, cwd="/tmp")
    lines = [ln for ln in out.stdout.splitlines() if ln.strip()]
    assert len(lines) == 1
    rec = json.loads(lines[0])
    assert rec["unit"] == "sec" and set(rec["queries"]) == {"monitoring_stats", "feature_bureau"}
    assert rec["value"] > 0 and "errors" not in rec
