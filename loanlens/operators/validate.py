"""Validation of loan-application requests as a rule table evaluated per row.

Each rule yields a violation label or NULL; the labels of a row are gathered
with ``array_compact``, so validation is one projection (no join, no
shuffle).  Valid rows continue to scoring; the rest go to a quarantine table
with their reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanlens import schemas as S

_FIELD_TYPES = {f.name: f.dataType for f in S.REQUEST_SCHEMA.fields}


def conform(df: DataFrame, keep=("request_id",)) -> DataFrame:
    """Keep the known request fields (absent ones as typed NULLs) and the
    key columns; unknown fields are ignored.  ``bad_types`` lists the fields
    whose value is not of their type: text that is no number, and fractions or
    numbers out of range for whole-number fields; these read as NULL."""
    cols = [F.col(k) for k in keep if k in df.columns]
    bad = []
    for name, dtype in _FIELD_TYPES.items():
        if name not in df.columns:
            cols.append(F.lit(None).cast(dtype).alias(name))
            continue
        x = F.col(name)
        value = x.try_cast(dtype)
        if dtype.simpleString() in ("int", "bigint"):
            number = x.try_cast("double")
            value = F.when(number == F.floor(number), number.try_cast(dtype))
        cols.append(value.alias(name))
        bad.append(F.when(x.isNotNull() & value.isNull(), F.lit(f"type:{name}")))
    return df.select(*cols, F.array_compact(F.array(*bad)).alias("bad_types") if bad
                     else F.array().cast("array<string>").alias("bad_types"))


def with_defaults(df: DataFrame) -> DataFrame:
    """Optional fields take their defaults."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v).cast(_FIELD_TYPES[c]))
                           for c, v in S.REQUEST_DEFAULTS.items()})


def violations(df: DataFrame) -> Column:
    """Array of violated rules: ``type:<field>`` for a value of another type,
    ``missing:<field>`` for an absent required field, ``range:<field>`` for a
    value outside its bounds (NaN included)."""
    checks = []
    wrong = F.col("bad_types") if "bad_types" in df.columns else F.array().cast("array<string>")
    for f in S.REQUIRED_FIELDS:
        checks.append(F.when(F.col(f).isNull() & ~F.array_contains(wrong, f"type:{f}"), F.lit(f"missing:{f}")))
    for f, (lo, hi) in S.FIELD_RANGES.items():
        x = F.col(f)
        bad = F.lit(False)
        if _FIELD_TYPES[f].simpleString() == "double":
            bad = bad | F.isnan(x)
        if lo is not None:
            bad = bad | (x < F.lit(lo))
        if hi is not None:
            bad = bad | (x > F.lit(hi))
        checks.append(F.when(x.isNotNull() & bad, F.lit(f"range:{f}")))
    return F.concat(wrong, F.array_compact(F.array(*checks)))


def validate_requests(df: DataFrame, keep=("request_id",)) -> DataFrame:
    """Conformed requests with defaults, ``violations`` and ``is_valid``."""
    out = with_defaults(conform(df, keep))
    out = out.withColumn("violations", violations(out)).drop("bad_types")
    return out.withColumn("is_valid", F.size("violations") == 0)


def split_valid(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, quarantined rows with their violations)."""
    return (validated.where(F.col("is_valid")).drop("violations", "is_valid"),
            validated.where(~F.col("is_valid")))
