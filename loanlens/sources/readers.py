"""Readers and writers.  Schemas are declared (never inferred): inference costs
a full pass at scale and drifts between files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanlens import schemas as S
from loanlens.functions.exprs import as_col, nan_to_null, utc_date


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None,
               fmt: str | None = None) -> DataFrame:
    """Scan CSV (header, declared schema) or Parquet; NaN becomes NULL in doubles.

    CSV columns are found by the names in the header, in any order and among
    other columns; a declared column that the header lacks is an error, and
    text that is not of the declared type reads as NULL."""
    fmt = fmt or ("csv" if path.lower().endswith(".csv") else "parquet")
    if fmt == "csv":
        if schema is None:
            raise ValueError("CSV scans need a declared schema")
        # all columns as text: without inference this reads the header line only
        text = spark.read.option("header", True).option("inferSchema", False).csv(path)
        missing = [f.name for f in schema.fields if f.name not in text.columns]
        if missing:
            raise ValueError(f"{path} has no column {', '.join(missing)}")
        df = text.select(*[F.trim(F.col(f"`{f.name}`")).try_cast(f.dataType).alias(f.name) if f.dataType != T.StringType()
                           else F.col(f"`{f.name}`") for f in schema.fields])
    else:
        df = spark.read.parquet(path)
        if schema is not None:
            df = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields
                             if f.name in df.columns])
    return df.select(*[nan_to_null(c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(hpath))


def read_optional(spark: SparkSession, path: str | None, schema: T.StructType | None = None,
                  fmt: str | None = None) -> DataFrame | None:
    """Scan a table that may be absent; ``None`` lets callers fall back to constants."""
    if not path or not _exists(spark, path):
        return None
    return read_table(spark, path, schema, fmt)


def scan_application(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    return read_table(spark, path, S.APPLICATION_SCHEMA, fmt)


def write_reference(df: DataFrame, path: str) -> None:
    """Reference sample (features + TARGET) for drift, overwritten atomically per run."""
    df.write.mode("overwrite").parquet(path)


def read_reference(spark: SparkSession, path: str) -> DataFrame | None:
    return read_optional(spark, path, fmt="parquet")


def append_log(log: DataFrame, path: str, batch_id: str) -> None:
    """Append scored rows to the inference log, partitioned by UTC day (the "today" and daily queries prune) and then by
    the batch that wrote them.  A batch replaces what it has written before and nothing else, so a job that is run
    again after a failure, or twice, leaves every row once."""
    (log.withColumns({"log_date": utc_date("timestamp"), "batch_id": F.lit(str(batch_id))})
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("log_date", "batch_id").parquet(path))


def read_log(spark: SparkSession, path: str) -> DataFrame | None:
    log = read_optional(spark, path, fmt="parquet")
    return log.drop("batch_id") if log is not None else None


def parse_risk_factors(c: Column | str) -> Column:
    """JSON text -> array of risk-factor structs; NULL, empty or bad text -> []."""
    parsed = F.from_json(as_col(c), S.RISK_FACTOR_TYPE, {"mode": "PERMISSIVE"})
    empty = F.array().cast(S.RISK_FACTOR_TYPE)
    return F.coalesce(parsed, empty)


def risk_factors_json(c: Column | str) -> Column:
    return F.to_json(as_col(c))
