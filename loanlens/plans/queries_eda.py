"""Registered queries: exploratory tables, table sizes and the semi-join
reduction of the bureau table."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from loanlens import schemas as S
from loanlens.operators import eda
from loanlens.operators.sampling import sample_n
from loanlens.plans import book
from loanlens.plans import oracle_sql as O
from loanlens.plans.catalog import query
from loanlens.plans.queries_eval import SAMPLE_N, _hash_sql
from loanlens.sources import derived

_EDA = """
eda AS (
  SELECT *, -CAST(DAYS_BIRTH AS DOUBLE) / 365.25e0 AS age,
    AMT_ANNUITY / nullif(AMT_CREDIT + 1, 0) AS payment_rate
  FROM application
)"""


def _bins_values(labels) -> str:
    return "(VALUES " + ", ".join(f"('{lab}', {i})" for i, lab in enumerate(labels)) + ") d(bin, bin_order)"


@query("eda_class_share", O.with_ctes() + """SELECT TARGET, count(*) AS n,
  count(*) * 100e0 / sum(count(*)) OVER () AS share_pct FROM application GROUP BY TARGET""",
       doubles=["share_pct"])
def eda_class_share(spark, sf):
    """class shares in percent."""
    return eda.class_share(derived.application(spark, sf))


_AGE_CASE = "CASE " + " ".join(
    f"WHEN age > {lo}e0 AND age <= {hi}e0 THEN '{lab}'"
    for lo, hi, lab in zip(S.AGE_BIN_EDGES, S.AGE_BIN_EDGES[1:], S.AGE_BIN_LABELS)) + " END"


@query("eda_age_default_rate", O.with_ctes(_EDA) + f"""SELECT d.bin, CAST(d.bin_order AS INTEGER) AS bin_order,
  CAST(coalesce(a.n, 0) AS BIGINT) AS n, a.default_rate_pct
FROM {_bins_values(S.AGE_BIN_LABELS)}
LEFT JOIN (SELECT {_AGE_CASE} AS bin, count(*) AS n, avg(CAST(TARGET AS DOUBLE)) * 100e0 AS default_rate_pct
           FROM eda WHERE ({_AGE_CASE}) IS NOT NULL GROUP BY 1) a ON a.bin = d.bin""", doubles=["default_rate_pct"])
def eda_age_default_rate(spark, sf):
    """Default rate per right-closed age band."""
    return eda.age_default_rate(derived.application(spark, sf))


def _quintile_sql() -> str:
    qs = ", ".join(f"quantile_cont(payment_rate, {i / 5}e0) AS q{i}" for i in range(6))
    case = "CASE " + " ".join(
        f"WHEN payment_rate {'>=' if i == 0 else '>'} q{i} AND payment_rate <= q{i + 1} THEN '{lab}'"
        for i, lab in enumerate(S.PAYMENT_RATE_LABELS)) + " END"
    bounds = " UNION ALL ".join(f"SELECT '{lab}' AS bin, q{i} AS lower_edge, q{i + 1} AS upper_edge FROM qs"
                                for i, lab in enumerate(S.PAYMENT_RATE_LABELS))
    return f""", qs AS (SELECT {qs} FROM eda WHERE payment_rate IS NOT NULL),
binned AS (SELECT {case} AS bin, TARGET FROM eda, qs WHERE payment_rate IS NOT NULL),
bounds AS ({bounds})
SELECT d.bin, CAST(d.bin_order AS INTEGER) AS bin_order, CAST(coalesce(a.n, 0) AS BIGINT) AS n, a.default_rate_pct,
  b.lower_edge, b.upper_edge
FROM {_bins_values(S.PAYMENT_RATE_LABELS)}
LEFT JOIN (SELECT bin, count(*) AS n, avg(CAST(TARGET AS DOUBLE)) * 100e0 AS default_rate_pct FROM binned
           WHERE bin IS NOT NULL GROUP BY bin) a ON a.bin = d.bin
JOIN bounds b ON b.bin = d.bin"""


@query("eda_payment_rate_quintiles", O.with_ctes(_EDA) + _quintile_sql(),
       doubles=["default_rate_pct", "lower_edge", "upper_edge"])
def eda_payment_rate_quintiles(spark, sf):
    """Default rate per payment-rate quintile."""
    return eda.payment_rate_quintiles(derived.application(spark, sf))


_KDE = f""", st AS (
  SELECT TARGET, count(*) AS n, stddev_samp(EXT_SOURCE_3) * pow(CAST(count(*) AS DOUBLE), -0.2e0) AS bw,
    min(EXT_SOURCE_3) AS lo, max(EXT_SOURCE_3) AS hi
  FROM application WHERE EXT_SOURCE_3 IS NOT NULL AND TARGET IS NOT NULL GROUP BY TARGET),
st2 AS (SELECT *, lo - {eda.KDE_CUT}e0 * bw AS g0, (hi - lo + {2 * eda.KDE_CUT}e0 * bw) / {eda.KDE_GRID - 1}e0 AS step FROM st),
vals AS (SELECT TARGET, EXT_SOURCE_3 AS v, count(*) AS w FROM application
         WHERE EXT_SOURCE_3 IS NOT NULL AND TARGET IS NOT NULL GROUP BY 1, 2),
pts AS (SELECT v.TARGET, s.n, s.bw, s.g0, s.step, v.w, v.v, unnest(range({eda.KDE_GRID})) AS grid_index
        FROM vals v JOIN st2 s ON v.TARGET = s.TARGET)
SELECT TARGET, CAST(grid_index AS INTEGER) AS grid_index, first(g0 + grid_index * step) AS x,
  sum(w * {1 / math.sqrt(2 * math.pi)!r} * exp(-0.5e0 * ((g0 + grid_index * step - v) / bw) * ((g0 + grid_index * step - v) / bw)))
    / (first(n) * first(bw)) AS density
FROM pts GROUP BY TARGET, grid_index"""


@query("eda_ext_source_density", O.with_ctes() + _KDE.replace(", st AS (", "SELECT * FROM (WITH st AS (", 1) + ")",
       doubles=["x", "density"])
def eda_ext_source_density(spark, sf):
    """F8: Gaussian density of EXT_SOURCE_3 per class on a 200-point grid."""
    return eda.class_density(derived.application(spark, sf), "EXT_SOURCE_3").withColumn(
        "grid_index", F.col("grid_index").cast("int"))


@query("row_counts", O.with_ctes(O.FEATURES) + """SELECT 'application' AS table_name, count(*) AS n_rows, 14 AS n_columns FROM application
UNION ALL SELECT 'bureau', count(*), 5 FROM bureau
UNION ALL SELECT 'previous_application', count(*), 3 FROM previous_application
UNION ALL SELECT 'features', count(*), 26 FROM features""")
def row_counts(spark, sf):
    """rows and columns of the loan tables and the feature table."""
    app, bur, prev = book.raw_tables(spark, sf)
    feats = book.book_features(spark, sf)[0]
    parts = [(n, d) for n, d in [("application", app), ("bureau", bur), ("previous_application", prev),
                                 ("features", feats)]]
    out = None
    for name, d in parts:
        one = d.agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(name).alias("table_name"), "n_rows", F.lit(len(d.columns)).alias("n_columns"))
        out = one if out is None else out.unionByName(one)
    return out


@query("bureau_semi", O.with_ctes() + f"""SELECT b.* FROM bureau b WHERE b.SK_ID_CURR IN (
  SELECT SK_ID_CURR FROM (SELECT SK_ID_CURR, row_number() OVER (ORDER BY {_hash_sql('SK_ID_CURR')}, SK_ID_CURR) AS r
                          FROM application) WHERE r <= {SAMPLE_N})""", doubles=["AMT_CREDIT_SUM", "AMT_CREDIT_SUM_DEBT"])
def bureau_semi(spark, sf):
    """Bureau rows of the sampled applicants (left-semi join)."""
    app = derived.application(spark, sf)
    keys = sample_n(app, SAMPLE_N).select("SK_ID_CURR")
    return derived.bureau(spark, sf).join(keys, "SK_ID_CURR", "left_semi")
