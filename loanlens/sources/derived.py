"""Loan tables derived from the benchmark's TPC-H-like Parquet tables.

The expressions are fixed so that a second engine can derive the same rows:
application from customer/nation/region, bureau from lineitem/orders,
previous_application from orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


_READS: dict = {}


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """``spark.read.parquet`` once per session and path (the file listing and
    footer read are done once, as when a table is registered in a catalog)."""
    key = (spark.sparkContext.applicationId, path)
    df = _READS.get(key)
    if df is None:
        df = _READS[key] = spark.read.parquet(path)
    return df


def clear_reads() -> None:
    """Forget registered reads (call after the input files change)."""
    _READS.clear()


def load_tables(spark: SparkSession, sf_dir: str, names=None) -> dict[str, DataFrame]:
    names = names or ["region", "nation", "customer", "orders", "lineitem", "events"]
    return {n: read_parquet(spark, f"{sf_dir.rstrip('/')}/{n}.parquet") for n in names}


# The derivation of the loan tables from the benchmark tables
# (one SQL expression per output column; a second engine runs the same text).
APPLICATION_EXPRS = [
    "CAST(c_custkey AS BIGINT) AS SK_ID_CURR",
    "CAST(CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END AS INT) AS TARGET",
    "CAST(-(7500 + (c_custkey * 7919) % 17500) AS INT) AS DAYS_BIRTH",
    "CAST(CASE WHEN c_custkey % 6 = 0 THEN 365243 ELSE -((c_custkey * 6151) % 12000) END AS INT) AS DAYS_EMPLOYED",
    "25000e0 + ((c_custkey * 3571) % 4000) * 1e2 AS AMT_INCOME_TOTAL",
    "45000e0 + ((c_custkey * 2971) % 9000) * 1e2 AS AMT_CREDIT",
    "CASE WHEN c_custkey % 500 = 3 THEN NULL ELSE (45000e0 + ((c_custkey * 2971) % 9000) * 1e2)"
    " * (3e-2 + ((c_custkey * 1409) % 90) / 1e3) END AS AMT_ANNUITY",
    "CASE WHEN c_custkey % 300 = 7 THEN NULL ELSE (45000e0 + ((c_custkey * 2971) % 9000) * 1e2) * 9e-1 END"
    " AS AMT_GOODS_PRICE",
    "CAST(c_custkey % 4 AS INT) AS CNT_CHILDREN",
    "c_mktsegment AS NAME_EDUCATION_TYPE",
    "CASE WHEN c_custkey % 50 = 11 THEN NULL ELSE r_name END AS NAME_HOUSING_TYPE",
    "CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE ((c_custkey * 7817) % 1000) / 1e3 END AS EXT_SOURCE_1",
    "CASE WHEN c_custkey % 400 = 9 THEN NULL ELSE (c_acctbal + 1e3) / 22e3 + ((c_custkey * 4729) % 1000) / 2e3 END"
    " AS EXT_SOURCE_2",
    "CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE ((c_custkey * 6367) % 1000) / 1e3 END AS EXT_SOURCE_3",
]
# Some history belongs to people who did not apply (negative keys), as in real bureau data; the applicants
# with those numbers have none.  Every given row is kept.
BUREAU_EXPRS = [
    "CAST(CASE WHEN o_custkey % 7 = 0 THEN -o_custkey ELSE o_custkey END AS BIGINT) AS SK_ID_CURR",
    "CASE l_returnflag WHEN 'A' THEN 'Active' WHEN 'R' THEN 'Closed' ELSE 'Sold' END AS CREDIT_ACTIVE",
    "CAST(CASE WHEN l_linestatus = 'F' AND l_discount > 8e-2 THEN CAST(l_quantity AS INT) ELSE 0 END AS INT)"
    " AS CREDIT_DAY_OVERDUE",
    "CASE WHEN l_linenumber = 7 THEN NULL ELSE l_extendedprice END AS AMT_CREDIT_SUM",
    "CASE WHEN l_tax < 5e-3 THEN NULL ELSE l_extendedprice * l_discount * 1e1 END AS AMT_CREDIT_SUM_DEBT",
]
PREVIOUS_EXPRS = [
    "CAST(o_orderkey AS BIGINT) AS SK_ID_PREV",
    "CAST(CASE WHEN o_custkey % 9 = 0 THEN -o_custkey ELSE o_custkey END AS BIGINT) AS SK_ID_CURR",
    "CASE o_orderstatus WHEN 'F' THEN 'Approved' WHEN 'O' THEN 'Refused' ELSE 'Canceled' END AS NAME_CONTRACT_STATUS",
]


def application(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = load_tables(spark, sf_dir, ["customer", "nation", "region"])
    geo = (t["nation"].select("n_nationkey", "n_regionkey")
           .join(t["region"].select("r_regionkey", "r_name"), F.col("n_regionkey") == F.col("r_regionkey")))
    c = t["customer"].select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    df = c.join(geo, F.col("c_nationkey") == F.col("n_nationkey"))
    return df.selectExpr(*APPLICATION_EXPRS)


def bureau(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = load_tables(spark, sf_dir, ["orders", "lineitem"])
    o = t["orders"].select("o_orderkey", "o_custkey")
    li = t["lineitem"].select("l_orderkey", "l_returnflag", "l_linestatus", "l_discount",
                              "l_quantity", "l_linenumber", "l_extendedprice", "l_tax")
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).selectExpr(*BUREAU_EXPRS)


def previous_application(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load_tables(spark, sf_dir, ["orders"])["orders"]
    return o.selectExpr(*PREVIOUS_EXPRS)


def requests(spark: SparkSession, sf_dir: str, history=None) -> DataFrame:
    """Loan-application requests: one per event, carrying the applicant's
    values as a client would send them (raw employment days, so the
    "not employed" sentinel arrives as a negative number; absent history as
    NULL).  ``history``: the per-applicant feature table (text categories)."""
    ev = read_parquet(spark, f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id")
    app = application(spark, sf_dir).select("SK_ID_CURR", "DAYS_EMPLOYED")
    right = history.join(app, "SK_ID_CURR")
    j = ev.join(right, ev["user_id"] == right["SK_ID_CURR"], "left")
    return j.select(
        F.col("event_id").alias("request_id"), F.col("ts").alias("received_at"),
        "applicant_age", "income_total",
        (-F.col("DAYS_EMPLOYED").cast("double") / F.lit(365.25)).alias("employment_years"),
        "loan_amount", "loan_annuity", "goods_price",
        F.col("num_children").cast("int").alias("num_children"),
        F.col("NAME_EDUCATION_TYPE").alias("education_type"),
        F.col("NAME_HOUSING_TYPE").alias("housing_type"),
        F.col("bureau_loans_active").cast("int").alias("bureau_loans_active"),
        F.col("bureau_overdue_count").cast("int").alias("bureau_overdue_count"),
        F.col("prev_application_count").cast("int").alias("prev_application_count"),
        "prev_approved_ratio",
        F.col("EXT_SOURCE_1").alias("external_source_1"),
        F.col("EXT_SOURCE_2").alias("external_source_2"),
        F.col("EXT_SOURCE_3").alias("external_source_3"))
