"""Exploratory tables behind the reference charts: class shares, binned
default rates and per-class densities.  Charts are not drawn; the tables are
the product."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanlens import schemas as S
from loanlens.operators.joins import literal_frame
from loanlens.operators.rank import exact_quantiles

KDE_GRID = 200   # fixed value: evaluation points of the density curve
KDE_CUT = 3.0    # fixed value: grid extends this many bandwidths past the data


def eda_base(app: DataFrame) -> DataFrame:
    """The EDA view: age, employment years (sentinel kept NULL), payment rate,
    income per person."""
    days_emp = F.nullif(F.col("DAYS_EMPLOYED"), F.lit(S.DAYS_EMPLOYED_SENTINEL))
    return app.withColumns({
        "age": -F.col("DAYS_BIRTH").cast("double") / F.lit(365.25),
        "employment_years": -days_emp.cast("double") / F.lit(365.25),
        "payment_rate": F.try_divide(F.col("AMT_ANNUITY"), F.col("AMT_CREDIT") + F.lit(1)),
        "income_per_person": F.try_divide(F.col("AMT_INCOME_TOTAL"), (F.col("CNT_CHILDREN") + F.lit(2)).cast("double")),
    })


def class_share(df: DataFrame, label: str = "TARGET") -> DataFrame:
    """rows and percentage share per class."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = df.count()  # one number; the shares need no window over the classes
    return counts.withColumn("share_pct", F.col("n") * F.lit(100.0) / F.lit(float(total) if total else None))


def right_closed_bin(x, edges: Sequence[float], labels: Sequence[str], include_lowest: bool = False):
    """Label of the interval (e[i], e[i+1]] holding ``x``; outside -> NULL.
    ``include_lowest`` closes the first interval on the left too."""
    expr = None
    for i, lab in enumerate(labels):
        lo, hi = edges[i], edges[i + 1]
        lower = (x >= F.lit(lo)) if (include_lowest and i == 0) else (x > F.lit(lo))
        cond = lower & (x <= F.lit(hi))
        expr = F.when(cond, F.lit(lab)) if expr is None else expr.when(cond, F.lit(lab))
    return expr


def _bin_dimension(spark: SparkSession, labels: Sequence[str]) -> DataFrame:
    schema = T.StructType([T.StructField("bin", T.StringType()), T.StructField("bin_order", T.IntegerType())])
    return literal_frame(spark, [(lab, i) for i, lab in enumerate(labels)], schema)


def binned_default_rate(df: DataFrame, bin_col, labels: Sequence[str], label: str = "TARGET") -> DataFrame:
    """rows and default rate (%) per bin, every bin listed (empty bins:
    0 rows, NULL rate); rows outside every bin are dropped (C7)."""
    agg = (df.withColumn("bin", bin_col).where(F.col("bin").isNotNull())
             .groupBy("bin").agg(F.count(F.lit(1)).alias("n"),
                                 (F.avg(F.col(label).cast("double")) * F.lit(100.0)).alias("default_rate_pct")))
    dim = _bin_dimension(df.sparkSession, labels)
    return (dim.join(agg, "bin", "left")
               .select("bin", "bin_order", F.coalesce("n", F.lit(0)).cast("long").alias("n"), "default_rate_pct"))


def age_default_rate(app: DataFrame) -> DataFrame:
    b = right_closed_bin(F.col("age"), S.AGE_BIN_EDGES, S.AGE_BIN_LABELS)
    return binned_default_rate(eda_base(app), b, S.AGE_BIN_LABELS)


def payment_rate_quintiles(app: DataFrame) -> DataFrame:
    """Equal-frequency quintiles of payment rate (right-closed, lowest
    edge included) and the default rate in each."""
    base = eda_base(app)
    probs = [i / 5 for i in range(6)]
    edges = exact_quantiles(base, "payment_rate", probs).first()  # six numbers
    qs = list(edges["q"]) if edges is not None and edges["q"] else [None] * len(probs)
    q = F.array(*[F.lit(v).cast("double") for v in qs])
    b = base
    expr = None
    for i, lab in enumerate(S.PAYMENT_RATE_LABELS):
        lo, hi = q[i], q[i + 1]
        lower = (F.col("payment_rate") >= lo) if i == 0 else (F.col("payment_rate") > lo)
        cond = lower & (F.col("payment_rate") <= hi)
        expr = F.when(cond, F.lit(lab)) if expr is None else expr.when(cond, F.lit(lab))
    out = binned_default_rate(b, expr, S.PAYMENT_RATE_LABELS)
    bounds = {lab: (qs[i], qs[i + 1]) for i, lab in enumerate(S.PAYMENT_RATE_LABELS)}
    lower = F.element_at(F.create_map(*[x for lab, (lo, _) in bounds.items() for x in (F.lit(lab), F.lit(lo).cast("double"))]), F.col("bin"))
    upper = F.element_at(F.create_map(*[x for lab, (_, hi) in bounds.items() for x in (F.lit(lab), F.lit(hi).cast("double"))]), F.col("bin"))
    return out.withColumns({"lower_edge": lower, "upper_edge": upper})


def class_density(df: DataFrame, col: str, label: str = "TARGET", grid: int = KDE_GRID,
                  cut: float = KDE_CUT) -> DataFrame:
    """F8: Gaussian kernel density of ``col`` per class on a ``grid``-point
    grid, Scott bandwidth ``std * n^(-1/5)`` (sample std).

    Rows are first collapsed to (class, distinct value, weight); each distinct
    value then adds its kernel to the fixed grid (constant work per value) and
    a map-side combined ``groupBy`` sums the grid points.  No pairs of data
    rows are formed."""
    x = F.col(col).cast("double")
    d = df.where(x.isNotNull() & F.col(label).isNotNull())
    stats = d.groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.stddev_samp(x).alias("sd"),
                                 F.min(x).alias("lo"), F.max(x).alias("hi"))
    stats = stats.withColumn("bw", F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2)))
    stats = stats.withColumns({"g0": F.col("lo") - F.lit(cut) * F.col("bw"),
                               "step": (F.col("hi") - F.col("lo") + F.lit(2 * cut) * F.col("bw")) / F.lit(grid - 1)})
    vals = d.groupBy(label, x.alias("v")).agg(F.count(F.lit(1)).alias("w"))
    j = vals.join(stats.select(label, "n", "bw", "g0", "step"), label)
    norm = F.lit(1.0 / math.sqrt(2 * math.pi))
    pts = j.select(label, "n", "bw", "g0", "step", "w", "v",
                   F.posexplode(F.sequence(F.lit(0), F.lit(grid - 1))).alias("grid_index", "_i"))
    gx = F.col("g0") + F.col("grid_index") * F.col("step")
    z = (gx - F.col("v")) / F.col("bw")
    contrib = F.col("w") * norm * F.exp(F.lit(-0.5) * z * z)
    out = pts.groupBy(label, "grid_index").agg(
        F.first(gx).alias("x"),
        (F.sum(contrib) / (F.first("n") * F.first("bw"))).alias("density"))
    return out
