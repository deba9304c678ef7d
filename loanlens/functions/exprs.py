"""Null-safe arithmetic, row statistics and decision expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from loanlens import schemas as S

__all__ = [
    "as_col", "nan_to_null", "safe_div", "to_number", "row_mean", "row_std",
    "clamp_probability", "credit_score", "risk_grade", "recommended_action",
    "grade_attribute", "iso_utc",
]


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c: Column | str) -> Column:
    """NaN is "missing" in the source data; in Spark it must be NULL, because
    ``NaN > 0`` is true and NaN poisons sums."""
    c = as_col(c)
    return F.nanvl(c, F.lit(None).cast("double"))


def safe_div(num: Column | str, den: Column | str) -> Column:
    """Division that yields NULL instead of raising on a zero denominator."""
    return F.try_divide(as_col(num).cast("double"), as_col(den).cast("double"))


def to_number(c: Column | str) -> Column:
    """Coerce text or numbers to double; unparsable values become NULL."""
    return F.expr(f"try_cast({c} as double)") if isinstance(c, str) else c.try_cast("double")


def _present(cols: Sequence[str | Column]) -> Column:
    return F.filter(F.array(*[as_col(c).cast("double") for c in cols]), lambda x: x.isNotNull())


def row_mean(cols: Sequence[str | Column]) -> Column:
    """Mean of the non-null values of a row; NULL when all are NULL."""
    vals = _present(cols)
    n = F.size(vals)
    total = F.aggregate(vals, F.lit(0.0), lambda acc, x: acc + x)
    return F.when(n > 0, total / n)


def row_std(cols: Sequence[str | Column], ddof: int = 1) -> Column:
    """Standard deviation of the non-null values of a row.

    ``ddof=1`` (sample) is the training definition, ``ddof=0`` (population) the
    online one.  With ``n <= ddof`` values the result is 0."""
    vals = _present(cols)
    n = F.size(vals)
    mean = F.aggregate(vals, F.lit(0.0), lambda acc, x: acc + x) / n
    ss = F.aggregate(vals, F.lit(0.0), lambda acc, x: acc + (x - mean) * (x - mean))
    return F.when(n > ddof, F.sqrt(ss / (n - ddof))).otherwise(F.lit(0.0))


def clamp_probability(p: Column | str) -> Column:
    """Clamp to [0, 1]; NULL or NaN stays NULL (never a silent reject)."""
    p = as_col(p).cast("double")
    return F.when(p.isNotNull() & ~F.isnan(p), F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)))


def credit_score(p: Column | str) -> Column:
    """300..850 score from a (clamped) default probability."""
    q = clamp_probability(p)
    return (F.lit(S.SCORE_MAX) - F.floor(q * F.lit(float(S.SCORE_SPAN)))).cast("int")


def _by_grade(p: Column | str, pick) -> Column:
    q = clamp_probability(p)
    expr = None
    for row in S.GRADE_TABLE[:-1]:
        cond = q <= F.lit(row[1])
        expr = F.when(cond, F.lit(pick(row))) if expr is None else expr.when(cond, F.lit(pick(row)))
    last = S.GRADE_TABLE[-1]
    return F.when(q.isNull(), F.lit(None).cast("string")).otherwise(expr.otherwise(F.lit(pick(last))))


def risk_grade(p: Column | str) -> Column:
    return _by_grade(p, lambda r: r[0])


def recommended_action(p: Column | str) -> Column:
    return _by_grade(p, lambda r: r[2])


def grade_attribute(p: Column | str, attribute: str) -> Column:
    idx = {"grade": 0, "action": 2, "color": 3, "description": 4}[attribute]
    return _by_grade(p, lambda r: r[idx])


def action_label(action: Column | str) -> Column:
    """Display label of a recommended action; an unknown one stays as it is, NULL stays NULL."""
    a = as_col(action)
    expr = a
    for code, label in S.ACTION_LABELS.items():
        expr = F.when(a == code, F.lit(label)).otherwise(expr)
    return expr


def utc_wall(ts: Column | str) -> Column:
    """The UTC wall clock of a timestamp, as a timestamp that any session zone
    prints as that clock.  A timestamp without zone is UTC already."""
    c = as_col(ts)
    zoned = F.typeof(c) == "timestamp"
    return F.when(zoned, F.to_utc_timestamp(c.cast("timestamp"), F.current_timezone())).otherwise(c.cast("timestamp"))


def utc_date(ts: Column | str) -> Column:
    """The UTC day of a timestamp, in any session zone."""
    return F.to_date(utc_wall(ts))


def iso_utc(ts: Column | str) -> Column:
    """ISO-8601 text of the UTC clock with a ``Z`` suffix and fixed microsecond width."""
    return F.date_format(utc_wall(ts), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
