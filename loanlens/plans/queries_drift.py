"""Registered queries: drift of the inference log against the reference
sample (the validation side of the stratified split, as saved at training)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from loanlens import schemas as S
from loanlens.functions.stats import AS_B, AS_P, KS_TERMS
from loanlens.operators import drift as D
from loanlens.operators.sampling import stratified_split
from loanlens.plans import book
from loanlens.plans import oracle_sql as O
from loanlens.plans.catalog import query
from loanlens.plans.queries_eval import TEST_FRACTION, _hash_sql


def drift_inputs(spark, sf):
    """(reference, current, encoder): encoded validation rows with TARGET, and
    the log's drift view (19 features + probability as TARGET)."""
    feats, enc = book.book_features(spark, sf)
    split = stratified_split(feats.select("SK_ID_CURR", "TARGET"), TEST_FRACTION)
    reference = feats.join(split.where("is_validation").select("SK_ID_CURR"), "SK_ID_CURR", "left_semi")
    log = book.inference_log(spark, sf, with_factors=False)
    current = log.select("id", *[F.col(k).alias(v) for k, v in S.LOG_TO_DRIFT.items()])
    return reference, current, enc


def _columns() -> list[str]:
    drift_cols = set(S.LOG_TO_DRIFT.values())
    return [c for c in ["TARGET", *S.FEATURES] if c in drift_cols]


COLUMNS = _columns()
NUMERIC = [c for c in COLUMNS if D.column_kind(c) == "numeric"]
CATEGORICAL = [c for c in COLUMNS if D.column_kind(c) == "categorical"]
_LOG_NAME = {v: k for k, v in S.LOG_TO_DRIFT.items()}


def _long_sql() -> str:
    parts = []
    for side, src in (("reference", "ref_rows"), ("current", "cur_rows")):
        for c in COLUMNS:
            if c in CATEGORICAL:
                parts.append(f"SELECT '{c}' AS feature, '{side}' AS side, CAST(NULL AS DOUBLE) AS x, "
                             f"CAST({c} AS VARCHAR) AS c FROM {src}")
            else:
                parts.append(f"SELECT '{c}' AS feature, '{side}' AS side, CAST({c} AS DOUBLE) AS x, "
                             f"CAST(NULL AS VARCHAR) AS c FROM {src}")
    return "\n  UNION ALL ".join(parts)


def _cur_select() -> str:
    cols = []
    for c in COLUMNS:
        src = _LOG_NAME[c]
        cols.append(f"CAST({O.code_sql(c, src)} AS INTEGER) AS {c}" if c in CATEGORICAL else f"{src} AS {c}")
    return ", ".join(cols)


_NUM_IN = ", ".join(f"'{c}'" for c in NUMERIC)


def _ks_p(d: str, n: str, m: str) -> str:
    ne = f"(CAST({n} AS DOUBLE) * {m} / ({n} + {m}))"
    lam = f"((sqrt({ne}) + 0.12e0 + 0.11e0 / sqrt({ne})) * {d})"
    series = (f"(SELECT sum(CASE WHEN k % 2 = 1 THEN 1e0 ELSE -1e0 END * exp(-2e0 * k * k * {lam} * {lam})) "
              f"FROM range(1, {KS_TERMS + 1}) t(k))")
    return f"CASE WHEN {d} <= 0 THEN 1e0 ELSE greatest(0e0, least(1e0, 2e0 * {series})) END"


def _chi2_p(x: str, k: str) -> str:
    a, h = f"({k} / 2e0)", f"({x} / 2e0)"
    lower = (f"(SELECT sum(exp(-{h} + ({a} + n) * ln({h}) - lgamma({a} + n + 1))) "
             f"FROM range(0, CAST(ceil({h} + 12e0 * sqrt({h}) + 40e0) AS BIGINT) + 1) t(n))")
    far = f"{x} > {k} + 40e0 * sqrt(2e0 * {k}) + 200e0"
    return (f"CASE WHEN {x} IS NULL OR {k} IS NULL THEN NULL WHEN {k} <= 0 OR {x} <= 0 THEN 1e0 "
            f"WHEN {far} THEN 0e0 ELSE greatest(0e0, least(1e0, 1e0 - {lower})) END")


def _phi_upper(z: str) -> str:
    """1 - Phi(|z|) by Abramowitz-Stegun 26.2.17."""
    t = f"(1e0 / (1e0 + {AS_P!r} * abs({z})))"
    b = [repr(v) for v in AS_B]
    poly = f"{t} * ({b[0]} + {t} * ({b[1]} + {t} * ({b[2]} + {t} * ({b[3]} + {t} * {b[4]}))))"
    return f"(exp(-abs({z}) * abs({z}) / 2e0) / {math.sqrt(2 * math.pi)!r} * {poly})"


_PSI_QS = "[" + ", ".join(f"{q}e0" for q in D.PSI_QUANTILES) + "]"

DRIFT_CTES = f""",
split AS (
  SELECT SK_ID_CURR, r <= round(n * {TEST_FRACTION}e0) AS is_validation FROM (
    SELECT SK_ID_CURR, row_number() OVER (PARTITION BY TARGET ORDER BY {_hash_sql('SK_ID_CURR')}, SK_ID_CURR) AS r,
      count(*) OVER (PARTITION BY TARGET) AS n FROM application)),
ref_rows AS (SELECT f.* FROM features f JOIN split s ON f.SK_ID_CURR = s.SK_ID_CURR WHERE s.is_validation),
{O.CODES},
cur_rows AS (SELECT id, {_cur_select()} FROM inference_logs),
long AS (
  {_long_sql()}
),
sizes AS (
  SELECT feature,
    count_if(side = 'reference' AND (x IS NOT NULL OR c IS NOT NULL)) AS n_reference,
    count_if(side = 'current' AND (x IS NOT NULL OR c IS NOT NULL)) AS n_current,
    avg(CASE WHEN side = 'reference' THEN x END) AS mean_reference,
    avg(CASE WHEN side = 'current' THEN x END) AS mean_current,
    var_samp(CASE WHEN side = 'reference' THEN x END) AS var_reference,
    var_samp(CASE WHEN side = 'current' THEN x END) AS var_current,
    CASE WHEN count_if(side = 'reference') > 0 THEN
      1e0 - CAST(count_if(side = 'reference' AND (x IS NOT NULL OR c IS NOT NULL)) AS DOUBLE) / count_if(side = 'reference') END AS null_share_reference,
    CASE WHEN count_if(side = 'current') > 0 THEN
      1e0 - CAST(count_if(side = 'current' AND (x IS NOT NULL OR c IS NOT NULL)) AS DOUBLE) / count_if(side = 'current') END AS null_share_current
  FROM long GROUP BY feature
),
vals AS (
  SELECT feature, x, count_if(side = 'reference') AS r, count_if(side = 'current') AS k FROM long
  WHERE x IS NOT NULL AND feature IN ({_NUM_IN}) GROUP BY feature, x
),
cum AS (
  SELECT feature, sum(r) OVER (PARTITION BY feature ORDER BY x) AS cum_r,
    sum(k) OVER (PARTITION BY feature ORDER BY x) AS cum_k FROM vals
),
ks AS (
  SELECT c.feature, max(abs(cum_r / n_reference - cum_k / n_current)) AS ks_d
  FROM cum c JOIN sizes s ON c.feature = s.feature WHERE n_reference > 0 AND n_current > 0 GROUP BY c.feature
),
cats AS (
  SELECT feature, c, count_if(side = 'reference') AS r, count_if(side = 'current') AS k FROM long
  WHERE c IS NOT NULL GROUP BY feature, c
),
cat_tot AS (SELECT feature, sum(r) AS R, sum(k) AS K, count(*) AS m FROM cats GROUP BY feature),
chi AS (
  SELECT feature, sum(CASE WHEN er > 0 THEN (r - er) * (r - er) / er ELSE 0e0 END
                    + CASE WHEN ek > 0 THEN (k - ek) * (k - ek) / ek ELSE 0e0 END) AS chi2,
    CAST(max(m) - 1 AS INTEGER) AS dof
  FROM (SELECT c.*, t.R, t.K, t.m, (c.r + c.k) * t.R / CAST(t.R + t.K AS DOUBLE) AS er,
               (c.r + c.k) * t.K / CAST(t.R + t.K AS DOUBLE) AS ek FROM cats c JOIN cat_tot t ON c.feature = t.feature)
  GROUP BY feature
),
edges AS (
  SELECT feature, list_sort(list_distinct(quantile_cont(x, {_PSI_QS}))) AS e FROM long
  WHERE side = 'reference' AND x IS NOT NULL AND feature IN ({_NUM_IN}) GROUP BY feature
),
binned AS (
  SELECT l.feature, l.side, CAST(len(list_filter(d.e, lambda v: v < l.x)) AS VARCHAR) AS bin
  FROM long l JOIN edges d ON l.feature = d.feature WHERE l.x IS NOT NULL
  UNION ALL SELECT feature, side, c FROM long WHERE c IS NOT NULL
),
bin_counts AS (SELECT feature, bin, count_if(side = 'reference') AS r, count_if(side = 'current') AS k FROM binned GROUP BY 1, 2),
bin_tot AS (SELECT feature, sum(r) AS R, sum(k) AS K FROM bin_counts GROUP BY feature),
psi AS (
  SELECT feature, sum((ks - rs) * ln(ks / rs)) AS psi FROM (
    SELECT b.feature, greatest({D.PSI_FLOOR}e0, CASE WHEN t.R > 0 THEN b.r / CAST(t.R AS DOUBLE) ELSE 0e0 END) AS rs,
                      greatest({D.PSI_FLOOR}e0, CASE WHEN t.K > 0 THEN b.k / CAST(t.K AS DOUBLE) ELSE 0e0 END) AS ks
    FROM bin_counts b JOIN bin_tot t ON b.feature = t.feature) GROUP BY feature
),
kinds(feature, feature_pos, kind) AS (VALUES {", ".join(f"('{c}', {i}, '{D.column_kind(c)}')" for i, c in enumerate(COLUMNS))}),
zt AS (
  SELECT feature, var_reference / n_reference + var_current / n_current AS var, (mean_reference - mean_current) AS diff
  FROM sizes WHERE feature = 'TARGET'
),
feat AS (
  SELECT s.feature, kd.feature_pos, kd.kind,
    CASE kd.kind WHEN 'numeric' THEN 'ks' WHEN 'categorical' THEN 'chi_square' ELSE 'z_test' END AS test,
    CASE kd.kind WHEN 'numeric' THEN ks.ks_d WHEN 'categorical' THEN chi.chi2
      ELSE CASE WHEN zt.var > 0 THEN zt.diff / sqrt(zt.var) END END AS statistic,
    CASE WHEN kd.kind = 'categorical' THEN chi.dof END AS dof,
    coalesce(CASE kd.kind WHEN 'numeric' THEN {_ks_p('ks.ks_d', 's.n_reference', 's.n_current')}
      WHEN 'categorical' THEN {_chi2_p('chi.chi2', 'chi.dof')}
      ELSE CASE WHEN zt.var > 0 THEN 2e0 * {_phi_upper('zt.diff / sqrt(zt.var)')}
                WHEN zt.var = 0 THEN CASE WHEN zt.diff = 0 THEN 1e0 ELSE 0e0 END END END, 1e0) AS p_value,
    CASE WHEN kd.kind <> 'target' THEN psi.psi END AS psi,
    s.n_reference, s.n_current, s.null_share_reference, s.null_share_current, s.mean_reference, s.mean_current
  FROM sizes s JOIN kinds kd ON s.feature = kd.feature
  LEFT JOIN ks ON ks.feature = s.feature LEFT JOIN chi ON chi.feature = s.feature
  LEFT JOIN psi ON psi.feature = s.feature LEFT JOIN zt ON zt.feature = s.feature
),
drift_features AS (
  SELECT *, p_value < {S.DRIFT_P_THRESHOLD}e0 AS is_drifted,
    CASE WHEN psi IS NULL THEN NULL WHEN psi < {S.PSI_BANDS[0]}e0 THEN 'STABLE' WHEN psi <= {S.PSI_BANDS[1]}e0 THEN 'WATCH'
         ELSE 'DRIFTED' END AS psi_band,
    CASE WHEN p_value < {S.DRIFT_P_THRESHOLD}e0 THEN 'DRIFTED' ELSE 'STABLE' END AS status,
    CASE WHEN p_value < {S.DRIFT_P_THRESHOLD}e0 THEN 'WARNING' ELSE 'OK' END AS alert
  FROM feat
)"""


def drift_ctes() -> str:
    return O.log_ctes(O.FEATURES).rstrip("\n") + DRIFT_CTES + "\n"


def _features(spark, sf):
    ref, cur, enc = drift_inputs(spark, sf)
    return D.drift_features(ref, cur, enc)


_FEATURE_DOUBLES = ["statistic", "p_value", "psi", "null_share_reference", "null_share_current",
                    "mean_reference", "mean_current"]


@query("drift_align", drift_ctes() + "SELECT * FROM cur_rows",
       doubles=[c for c in COLUMNS if c not in CATEGORICAL])
def drift_align(spark, sf):
    """The log side aligned to the reference (categories encoded with the
    fitted table, numbers as double)."""
    ref, cur, enc = drift_inputs(spark, sf)
    cols = D.common_columns(ref, cur)
    enc_cur = enc.transform(cur, unseen="fallback", columns=CATEGORICAL)
    aligned = D.align(enc_cur, cols, keep=["id"])
    return aligned.withColumns({c: F.col(c).cast("int") for c in CATEGORICAL})


@query("drift_long", drift_ctes() + """SELECT feature, side, count(*) AS n_rows,
  count_if(x IS NOT NULL OR c IS NOT NULL) AS n_values, round(sum(x), 3) AS sum_x FROM long GROUP BY feature, side""")
def drift_long(spark, sf):
    """The unpivoted long table, summarised per feature and side."""
    ref, cur, enc = drift_inputs(spark, sf)
    long, _ = D.long_table(ref, cur, enc)
    return long.groupBy("feature", "side").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("x").isNotNull() | F.col("c").isNotNull()).alias("n_values"),
        F.round(F.sum("x"), 3).alias("sum_x"))


@query("drift_ks", drift_ctes() + "SELECT feature, statistic AS ks_d, p_value FROM drift_features WHERE test = 'ks'",
       doubles=["ks_d", "p_value"])
def drift_ks(spark, sf):
    """Two-sample KS statistic and p-value of every numeric feature."""
    return _features(spark, sf).where("test = 'ks'").select("feature", F.col("statistic").alias("ks_d"), "p_value")


@query("drift_z", drift_ctes() + """SELECT feature, statistic AS z, p_value, mean_reference, mean_current
FROM drift_features WHERE test = 'z_test'""", doubles=["z", "p_value", "mean_reference", "mean_current"])
def drift_z(spark, sf):
    """Two-sample Z test, with the variances of both sides, of the reference
    default rate against the current predicted rate."""
    return _features(spark, sf).where("test = 'z_test'").select(
        "feature", F.col("statistic").alias("z"), "p_value", "mean_reference", "mean_current")


@query("drift_chi2", drift_ctes() + """SELECT feature, statistic AS chi2, dof, p_value
FROM drift_features WHERE test = 'chi_square'""", doubles=["chi2", "p_value"])
def drift_chi2(spark, sf):
    """Chi-square statistic, degrees of freedom and p-value of every
    categorical feature."""
    return _features(spark, sf).where("test = 'chi_square'").select(
        "feature", F.col("statistic").alias("chi2"), "dof", "p_value")


@query("drift_psi", drift_ctes() + "SELECT feature, psi, psi_band FROM drift_features WHERE psi IS NOT NULL",
       doubles=["psi"])
def drift_psi(spark, sf):
    """Population stability index and its band per feature."""
    return _features(spark, sf).where(F.col("psi").isNotNull()).select("feature", "psi", "psi_band")


@query("drift_features", drift_ctes() + "SELECT * FROM drift_features", doubles=_FEATURE_DOUBLES)
def drift_features(spark, sf):
    """J7 (with J3-J6): the per-feature drift table."""
    return _features(spark, sf)


def _summary_sql() -> str:
    rec = S.DRIFT_RECOMMENDATIONS
    head, tail = rec["not_enough"].split("{n}")
    return f"""SELECT CASE WHEN n >= {S.DRIFT_MIN_ROWS} THEN 'OK' ELSE 'NOT_ENOUGH_DATA' END AS report_status,
  n AS total_predictions_since_deploy,
  n >= {S.DRIFT_MIN_ROWS} AND share >= {S.DRIFT_SHARE_THRESHOLD}e0 AS dataset_drift_detected,
  CASE WHEN n >= {S.DRIFT_MIN_ROWS} THEN share ELSE 0e0 END AS drift_share,
  CAST(CASE WHEN n >= {S.DRIFT_MIN_ROWS} THEN n_drifted ELSE 0 END AS BIGINT) AS n_drifted_features,
  CASE WHEN n >= {S.DRIFT_MIN_ROWS} THEN coalesce(t_ref, 0e0) ELSE 0e0 END AS predicted_default_rate_reference,
  CASE WHEN n >= {S.DRIFT_MIN_ROWS} THEN coalesce(t_cur, 0e0) ELSE 0e0 END AS predicted_default_rate_current,
  CASE WHEN n < {S.DRIFT_MIN_ROWS} THEN 'NOT_ENOUGH_DATA' WHEN t_drift = 1 THEN 'DRIFTED' ELSE 'STABLE' END AS target_status,
  CASE WHEN n < {S.DRIFT_MIN_ROWS} THEN '{head}' || CAST(n AS VARCHAR) || '{tail}'
       WHEN share >= {S.DRIFT_SHARE_THRESHOLD}e0 THEN '{rec["dataset"]}'
       WHEN n_drifted > 0 THEN '{rec["some"]}' ELSE '{rec["stable"]}' END AS recommendation
FROM (SELECT (SELECT count(*) FROM cur_rows) AS n,
        coalesce(avg(CAST(is_drifted AS DOUBLE)), 0e0) AS share, count_if(is_drifted) AS n_drifted,
        max(CASE WHEN feature = 'TARGET' THEN CAST(is_drifted AS INTEGER) END) AS t_drift,
        max(CASE WHEN feature = 'TARGET' THEN mean_reference END) AS t_ref,
        max(CASE WHEN feature = 'TARGET' THEN mean_current END) AS t_cur
      FROM drift_features) q"""


@query("drift_summary", drift_ctes() + _summary_sql(),
       doubles=["drift_share", "predicted_default_rate_reference", "predicted_default_rate_current"])
def drift_summary(spark, sf):
    """Dataset drift, target drift with both rates, recommendation."""
    ref, cur, enc = drift_inputs(spark, sf)
    return D.drift_summary(D.drift_features(ref, cur, enc), cur)
