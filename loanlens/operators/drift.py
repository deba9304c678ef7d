"""Data drift between a reference sample and current rows, for all columns in
one job.

Both frames are aligned (J1), unpivoted into one long table
``(feature, side, x | c)`` (J2), and every statistic is an aggregation of that
table grouped by feature: Kolmogorov-Smirnov for numeric columns (J3), a
two-proportion Z test for the target rate (J4), chi-square for categorical
columns (J5) and PSI for both (J6).  Per-feature flags (J7) roll up into the
dataset summary (J8-J11)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanlens import schemas as S
from loanlens.functions.exprs import nan_to_null
from loanlens.functions.stats import chi2_p_value, ks_p_value, two_sided_normal_p
from loanlens.session import materialize
from loanlens.operators.rank import quantiles_from_cumulative, running_totals

KEYS = ("SK_ID_CURR", "id")
TARGET = "TARGET"
PSI_FLOOR = 1e-4
PSI_QUANTILES = [i / 10 for i in range(1, 10)]


def column_kind(c: str) -> str:
    if c == TARGET:
        return "target"
    return "categorical" if c in S.CATEGORICAL else "numeric"


def common_columns(reference: DataFrame, current: DataFrame) -> list[str]:
    """The columns both frames share (keys excluded), in reference order."""
    cur = set(current.columns)
    return [c for c in reference.columns if c in cur and c not in KEYS]


def align(df: DataFrame, columns, compat: bool = False, keep=()) -> DataFrame:
    """Numeric columns to double (NaN and text -> NULL; ``compat`` fills 0
    as the reference does), categorical columns to text."""
    out = [F.col(k) for k in keep]
    for c in columns:
        if column_kind(c) == "categorical":
            out.append(F.col(c).cast("string").alias(c))
        else:
            v = nan_to_null(F.col(c).try_cast("double"))
            out.append((F.coalesce(v, F.lit(0.0)) if compat else v).alias(c))
    return df.select(*out)


def to_long(df: DataFrame, side: str, columns) -> DataFrame:
    """One row per (row, column): feature, side, x (number) or c (text)."""
    num = [c for c in columns if column_kind(c) != "categorical"]
    cat = [c for c in columns if column_kind(c) == "categorical"]
    parts = []
    if num:
        parts.append(df.select(*num).unpivot([], num, "feature", "x")
                       .withColumn("c", F.lit(None).cast("string")))
    if cat:
        parts.append(df.select(*cat).unpivot([], cat, "feature", "c")
                       .withColumn("x", F.lit(None).cast("double")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("side", F.lit(side))


def long_table(reference: DataFrame, current: DataFrame, encoder=None, compat: bool = False):
    columns = common_columns(reference, current)
    if encoder is not None:
        cats = [c for c in S.CATEGORICAL if c in columns]
        current = encoder.transform(current, unseen="fallback", columns=cats)
    ref = align(reference, columns, compat)
    cur = align(current, columns, compat)
    return to_long(ref, "reference", columns).unionByName(to_long(cur, "current", columns)), columns


def _is_ref() -> Column:
    return F.col("side") == "reference"


def value_counts(long: DataFrame) -> DataFrame:
    """The one shuffle over the data: rows per (feature, value) and side.
    Map-side combined, so a value holding a third of all rows is one row per
    map task; every statistic below reads only this reduced table."""
    return long.groupBy("feature", "x", "c").agg(F.count_if(_is_ref()).alias("r"),
                                                 F.count_if(~_is_ref()).alias("k"))


def _present() -> Column:
    return F.col("x").isNotNull() | F.col("c").isNotNull()


def feature_sizes(vc: DataFrame) -> DataFrame:
    """Non-null rows, means and null shares per feature and side."""
    p, x = _present(), F.col("x")
    agg = vc.groupBy("feature").agg(
        F.sum("r").alias("_all_r"), F.sum("k").alias("_all_c"),
        F.sum(F.when(p, F.col("r")).otherwise(0)).alias("n_reference"),
        F.sum(F.when(p, F.col("k")).otherwise(0)).alias("n_current"),
        F.sum(x * F.col("r")).alias("_sx_r"), F.sum(x * F.col("k")).alias("_sx_c"),
        F.sum(x * x * F.col("r")).alias("_sxx_r"), F.sum(x * x * F.col("k")).alias("_sxx_c"),
        F.sum(F.when(x.isNotNull(), F.col("r"))).alias("_nx_r"), F.sum(F.when(x.isNotNull(), F.col("k"))).alias("_nx_c"))
    def variance(side: str) -> F.Column:
        """Of the sample; NULL for fewer than two rows."""
        n, sx = F.col(f"_nx_{side}"), F.col(f"_sx_{side}")
        return F.when(n > 1, F.greatest((F.col(f"_sxx_{side}") - sx * sx / n) / F.nullif(n - 1, F.lit(0)), F.lit(0.0)))

    return agg.select(
        "feature", F.col("n_reference").cast("long").alias("n_reference"),
        variance("r").alias("var_reference"), variance("c").alias("var_current"),
        F.col("n_current").cast("long").alias("n_current"),
        F.when(F.col("_nx_r") > 0, F.col("_sx_r") / F.col("_nx_r")).alias("mean_reference"),
        F.when(F.col("_nx_c") > 0, F.col("_sx_c") / F.col("_nx_c")).alias("mean_current"),
        F.when(F.col("_all_r") > 0, F.lit(1.0) - F.col("n_reference") / F.col("_all_r")).alias("null_share_reference"),
        F.when(F.col("_all_c") > 0, F.lit(1.0) - F.col("n_current") / F.col("_all_c")).alias("null_share_current"))


def numeric_cumulative(vc: DataFrame, sizes: DataFrame, numeric: list) -> DataFrame:
    """Per numeric feature and distinct value: counts and running counts of
    both sides (``running_totals``, no global sort), with the side totals."""
    vals = vc.where(F.col("x").isNotNull() & F.col("feature").isin(*numeric)).select("feature", "x", "r", "k")
    cum = running_totals(vals, "x", ["r", "k"], partition_cols=["feature"])
    return cum.join(sizes.select("feature", "n_reference", "n_current"), "feature")


def ks_statistics(cum: DataFrame) -> DataFrame:
    """D = max |F_ref - F_cur| over the distinct values of each numeric
    feature."""
    j = cum
    diff = F.abs(F.col("cum_r") / F.col("n_reference") - F.col("cum_k") / F.col("n_current"))
    return (j.where((F.col("n_reference") > 0) & (F.col("n_current") > 0))
             .groupBy("feature").agg(F.max(diff).alias("ks_d")))


def chi2_statistics(vc: DataFrame, sizes: DataFrame) -> DataFrame:
    """Chi-square of side x category over the categories seen on either
    side; degrees of freedom = categories - 1.  Side totals are the
    non-null counts of ``sizes``."""
    cats = vc.where(F.col("c").isNotNull()).select("feature", "c", "r", "k")
    j = cats.join(sizes.select("feature", F.col("n_reference").alias("tot_r"), F.col("n_current").alias("tot_k")),
                  "feature")
    n = (F.col("tot_r") + F.col("tot_k")).cast("double")
    er = (F.col("r") + F.col("k")) * F.col("tot_r") / n
    ek = (F.col("r") + F.col("k")) * F.col("tot_k") / n
    term = (F.when(er > 0, (F.col("r") - er) * (F.col("r") - er) / er).otherwise(F.lit(0.0))
            + F.when(ek > 0, (F.col("k") - ek) * (F.col("k") - ek) / ek).otherwise(F.lit(0.0)))
    return j.groupBy("feature").agg(F.sum(term).alias("chi2"), (F.count(F.lit(1)) - 1).cast("int").alias("dof"))


def psi_table(vc: DataFrame, cum: DataFrame, numeric: list, sizes: DataFrame) -> DataFrame:
    """PSI per feature.  Numeric bins are right-closed between the
    reference deciles (exact, from the KS running counts; duplicates
    removed); categorical bins are the categories; shares are floored at
    1e-4.  Bins cover every non-null value, so side totals come from
    ``sizes``."""
    num_vc = vc.where(F.col("x").isNotNull() & F.col("feature").isin(*numeric))
    edges = quantiles_from_cumulative(cum, "x", "r", "cum_r", "n_reference", PSI_QUANTILES, ["feature"]).select(
        "feature", F.array_sort(F.array_distinct("q")).alias("edges"))
    num = num_vc.join(edges, "feature").select(
        "feature", F.size(F.filter("edges", lambda e: e < F.col("x"))).cast("string").alias("bin"), "r", "k")
    cat = vc.where(F.col("c").isNotNull()).select("feature", F.col("c").alias("bin"), "r", "k")
    counts = num.unionByName(cat).groupBy("feature", "bin").agg(F.sum("r").alias("r"), F.sum("k").alias("k"))
    j = counts.join(sizes.select("feature", F.col("n_reference").alias("tot_r"), F.col("n_current").alias("tot_k")),
                    "feature")
    rs = F.greatest(F.lit(PSI_FLOOR), F.when(F.col("tot_r") > 0, F.col("r") / F.col("tot_r")).otherwise(F.lit(0.0)))
    ks = F.greatest(F.lit(PSI_FLOOR), F.when(F.col("tot_k") > 0, F.col("k") / F.col("tot_k")).otherwise(F.lit(0.0)))
    return j.groupBy("feature").agg(F.sum((ks - rs) * F.log(ks / rs)).alias("psi"))


def psi_band(psi: Column) -> Column:
    lo, hi = S.PSI_BANDS
    return (F.when(psi.isNull(), F.lit(None).cast("string")).when(psi < F.lit(lo), F.lit("STABLE"))
             .when(psi <= F.lit(hi), F.lit("WATCH")).otherwise(F.lit("DRIFTED")))


def drift_features(reference: DataFrame, current: DataFrame, encoder=None, compat: bool = False) -> DataFrame:
    """One row per common column with its test, statistic, p-value,
    PSI, null shares and flag."""
    long, columns = long_table(reference, current, encoder, compat)
    numeric = [c for c in columns if column_kind(c) == "numeric"]
    # Materialise the reduced table once (a reliable checkpoint in the shared
    # checkpoint folder): four statistics read it, and the cut lineage keeps
    # their plans small.
    vc = materialize(value_counts(long))
    sizes = feature_sizes(vc)
    cum = numeric_cumulative(vc, sizes, numeric)
    ks = ks_statistics(cum)
    chi = chi2_statistics(vc, sizes)
    psi = psi_table(vc, cum, numeric, sizes)
    kinds = F.create_map(*[x for c in columns for x in (F.lit(c), F.lit(column_kind(c)))])
    order = F.create_map(*[x for i, c in enumerate(columns) for x in (F.lit(c), F.lit(i))])
    j = sizes.join(ks, "feature", "left").join(chi, "feature", "left").join(psi, "feature", "left")
    kind = kinds[F.col("feature")]
    # Mean of the target on both sides.  Labels on one side and probabilities on the other have different
    # variances, so each side brings its own.
    nr, nc = F.col("n_reference").cast("double"), F.col("n_current").cast("double")
    pr, pc = F.col("mean_reference"), F.col("mean_current")
    var = F.col("var_reference") / nr + F.col("var_current") / nc
    z = F.when(var > 0, (pr - pc) / F.sqrt(var))
    stat = (F.when(kind == "numeric", F.col("ks_d")).when(kind == "categorical", F.col("chi2"))
             .otherwise(z))
    p = (F.when(kind == "numeric", ks_p_value(F.col("ks_d"), F.col("n_reference"), F.col("n_current")))
          .when(kind == "categorical", chi2_p_value(F.col("chi2"), F.col("dof")))
          .otherwise(F.when(var > 0, two_sided_normal_p(z)).when(var == 0, (pr == pc).cast("double"))))
    p = F.coalesce(p, F.lit(1.0))  # J7: a missing p-value counts as no drift
    test = (F.when(kind == "numeric", F.lit("ks")).when(kind == "categorical", F.lit("chi_square"))
             .otherwise(F.lit("z_test")))
    drifted = p < F.lit(S.DRIFT_P_THRESHOLD)
    out = j.select(
        "feature", order[F.col("feature")].alias("feature_pos"), kind.alias("kind"), test.alias("test"),
        stat.alias("statistic"), F.when(kind == "categorical", F.col("dof")).alias("dof"), p.alias("p_value"),
        F.when(kind != "target", F.col("psi")).alias("psi"),
        "n_reference", "n_current", "null_share_reference", "null_share_current",
        "mean_reference", "mean_current", drifted.alias("is_drifted"))
    return out.withColumns({
        "psi_band": psi_band(F.col("psi")),
        "status": F.when(F.col("is_drifted"), F.lit("DRIFTED")).otherwise(F.lit("STABLE")),
        "alert": F.when(F.col("is_drifted"), F.lit("WARNING")).otherwise(F.lit("OK")),
    })


def drift_summary(features: DataFrame, current_rows: DataFrame) -> DataFrame:
    """Dataset flag, drifted share, target drift with both mean
    rates, recommendation; fewer than 10 current rows -> NOT_ENOUGH_DATA."""
    tgt = F.col("feature") == TARGET
    agg = features.agg(
        F.avg(F.col("is_drifted").cast("double")).alias("_share"),
        F.count_if(F.col("is_drifted")).alias("_n_drifted"),
        F.max(F.when(tgt, F.col("is_drifted").cast("int"))).alias("_t_drift"),
        F.max(F.when(tgt, F.col("mean_reference"))).alias("_t_ref"),
        F.max(F.when(tgt, F.col("mean_current"))).alias("_t_cur"))
    j = agg.withColumn("total_predictions_since_deploy", F.lit(current_rows.count()).cast("long"))
    enough = F.col("total_predictions_since_deploy") >= F.lit(S.DRIFT_MIN_ROWS)
    share = F.coalesce(F.col("_share"), F.lit(0.0))
    dataset = share >= F.lit(S.DRIFT_SHARE_THRESHOLD)
    not_enough = F.concat(F.lit(S.DRIFT_RECOMMENDATIONS["not_enough"].split("{n}")[0]),
                          F.col("total_predictions_since_deploy").cast("string"),
                          F.lit(S.DRIFT_RECOMMENDATIONS["not_enough"].split("{n}")[1]))
    rec = (F.when(~enough, not_enough).when(dataset, F.lit(S.DRIFT_RECOMMENDATIONS["dataset"]))
            .when(F.col("_n_drifted") > 0, F.lit(S.DRIFT_RECOMMENDATIONS["some"]))
            .otherwise(F.lit(S.DRIFT_RECOMMENDATIONS["stable"])))
    return j.select(
        F.when(enough, F.lit("OK")).otherwise(F.lit("NOT_ENOUGH_DATA")).alias("report_status"),
        "total_predictions_since_deploy",
        (enough & dataset).alias("dataset_drift_detected"),
        F.when(enough, share).otherwise(F.lit(0.0)).alias("drift_share"),
        F.when(enough, F.col("_n_drifted")).otherwise(F.lit(0)).cast("long").alias("n_drifted_features"),
        F.when(enough, F.coalesce(F.col("_t_ref"), F.lit(0.0))).otherwise(F.lit(0.0)).alias("predicted_default_rate_reference"),
        F.when(enough, F.coalesce(F.col("_t_cur"), F.lit(0.0))).otherwise(F.lit(0.0)).alias("predicted_default_rate_current"),
        F.when(~enough, F.lit("NOT_ENOUGH_DATA")).when(F.col("_t_drift") == 1, F.lit("DRIFTED"))
         .otherwise(F.lit("STABLE")).alias("target_status"),
        rec.alias("recommendation"))


def missing_reference_summary(current_rows: DataFrame) -> DataFrame:
    """No reference sample -> one ERROR summary row."""
    return current_rows.agg(F.count(F.lit(1)).alias("total_predictions_since_deploy")).select(
        F.lit("ERROR").alias("report_status"), "total_predictions_since_deploy",
        F.lit(False).alias("dataset_drift_detected"), F.lit(0.0).alias("drift_share"),
        F.lit(0).cast("long").alias("n_drifted_features"),
        F.lit(0.0).alias("predicted_default_rate_reference"), F.lit(0.0).alias("predicted_default_rate_current"),
        F.lit("ERROR").alias("target_status"), F.lit(S.DRIFT_RECOMMENDATIONS["no_reference"]).alias("recommendation"))


FEATURE_ENTRY = ["feature", "test", "statistic", "p_value", "psi", "psi_band", "is_drifted", "status", "alert"]


def drift_report(reference: DataFrame | None, current: DataFrame, run_at: str, encoder=None) -> DataFrame:
    """The full report record -- the summary row with ``features`` (one entry
    per compared column, in order), ``run_at`` and ``error``.

    Without a reference sample, or when the computation fails, the record has
    the status ERROR, no features and, for a failure, its message."""
    entry = "array<struct<feature_pos:int,feature:string,test:string,statistic:double,p_value:double,psi:double," \
            "psi_band:string,is_drifted:boolean,status:string,alert:string>>"

    def record(summary: DataFrame, error: str | None) -> DataFrame:
        return summary.withColumns({"run_at": F.lit(run_at).cast("timestamp"), "error": F.lit(error).cast("string")})

    if reference is None:
        return record(missing_reference_summary(current).withColumn("features", F.array().cast(entry)), None)
    try:
        feats = materialize(drift_features(reference, current, encoder))  # one row per column
        summary = drift_summary(feats, current)
        listed = feats.agg(F.sort_array(F.collect_list(F.struct("feature_pos", *FEATURE_ENTRY))).cast(entry).alias("features"))
        both = summary.withColumn("_k", F.lit(0)).join(listed.withColumn("_k", F.lit(0)), "_k").drop("_k")  # one row each
        return record(both, None)
    except Exception as e:  # noqa: BLE001 - the report itself says what failed
        failed = missing_reference_summary(current).withColumns({
            "recommendation": F.lit(S.DRIFT_RECOMMENDATIONS.get("error", "Drift computation failed.")),
            "features": F.array().cast(entry)})
        return record(failed, f"{type(e).__name__}: {str(e)[:500]}")
