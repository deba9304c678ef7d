"""Streams and stores behind registered queries, against DuckDB and by what they must survive."""

import duckdb
import pytest
from pyspark.sql import functions as F

from loanlens.operators import model as MD
from loanlens.plans import book, queries_stream as Q
from loanlens.plans.registry import all_queries
from loanlens.sources.readers import append_log, read_log

NAMES = ["stream_scoring_log", "stream_daily_counts", "append_log_replayed", "reference_round_trip", "encoder_round_trip",
         "action_labels", "drift_without_reference"]


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "orders", "lineitem", "events"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, sf, duck, name):
    q = all_queries()[name]
    got, want = q.fn(spark, sf).toPandas(), duck.sql(q.sql).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns) and len(got) == len(want) > 0
    def cell(v):
        if v is None or v != v:
            return "-"
        return str(v)[:10] if hasattr(v, "year") else str(round(float(v), 6) if isinstance(v, (int, float)) else v)

    rows = lambda df: sorted(tuple(map(cell, r)) for r in df[cols].astype(object).values.tolist())
    assert rows(got) == rows(want)


def test_late_rows_are_dropped_and_open_days_wait(spark, sf):
    got = Q.stream_daily_counts(spark, sf).agg(F.sum("n"), F.max("day")).first()
    events = book.scored_events(spark, sf).agg(F.count("*"), F.max("timestamp").cast("date")).first()
    assert 0 < got[0] < events[0] and got[1] < events[1]
    in_time = book.scored_events(spark, sf).where(F.col("timestamp").cast("date") <= F.lit(got[1])).count()
    assert got[0] < in_time  # not only the open days are missing


def test_a_retried_batch_replaces_itself_only(spark, sf, tmp_path):
    path = str(tmp_path / "log")
    log = book.inference_log(spark, sf, with_factors=False).cache()
    first, second = log.where(F.crc32("id") % 2 == 0), log.where(F.crc32("id") % 2 == 1)
    append_log(first, path, "a")
    append_log(second, path, "b")
    append_log(first.limit(first.count()), path, "a")
    back = read_log(spark, path)
    assert back.count() == log.count() == back.select("id").distinct().count()
    assert set(back.columns) == {*log.columns, "log_date"}


def test_loading_a_missing_model_is_a_typed_error(tmp_path):
    with pytest.raises(MD.ModelNotReady):
        MD.load(str(tmp_path / "absent"))
