"""Tree ensembles held as leaf tables, scored as column expressions, and
explained with path-dependent TreeSHAP.

A leaf is ``(tree, leaf, value, path)`` where ``path`` is a list of
``(feature, lo, hi, null_ok, z)``: the row reaches the leaf when for every
element ``lo < x <= hi`` (or ``x`` is NULL and ``null_ok``); ``z`` is the cover
fraction of the branch (cover(child) / cover(parent)).  ``value`` is in
log-odds (margin) units; ``margin = intercept + sum of reached leaf values``.

The ensemble is a bounded model artifact (trees x leaves); it travels inside
the expression or the task closure, never as a data-sized broadcast."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanlens import schemas as S
from loanlens.operators.trees import ShapPlan, TreeArrays
from loanlens.session import ship_package

INF = float("inf")


@dataclass
class Leaf:
    tree: int
    leaf: int
    value: float
    cover: float
    path: list = field(default_factory=list)  # [(feature, lo, hi, null_ok, z)]


@dataclass
class Ensemble:
    intercept: float
    leaves: list
    features: list = field(default_factory=lambda: list(S.FEATURES))

    @property
    def n_trees(self) -> int:
        return len({lf.tree for lf in self.leaves})


def leaves_from_tree(tree_id: int, node, lo_hi=None, path=None, out=None, counter=None):
    """Flatten a nested tree spec into leaves.

    node := ("leaf", value, cover)
          | ("split", feature, threshold, missing_left, cover, left, right)
    ``x <= threshold`` goes left."""
    out = [] if out is None else out
    path = [] if path is None else path
    counter = counter if counter is not None else [0]
    if node[0] == "leaf":
        out.append(Leaf(tree_id, counter[0], float(node[1]), float(node[2]), list(path)))
        counter[0] += 1
        return out
    _, feat, thr, missing_left, cover, left, right = node
    lcover = left[2] if left[0] == "leaf" else left[4]
    rcover = right[2] if right[0] == "leaf" else right[4]
    leaves_from_tree(tree_id, left, None, path + [(feat, -INF, float(thr), bool(missing_left), lcover / cover)], out, counter)
    leaves_from_tree(tree_id, right, None, path + [(feat, float(thr), INF, not missing_left, rcover / cover)], out, counter)
    return out


# The hand-written three-tree ensemble used by the oracle-checked
# scoring and attribution queries (depth <= 2, distinct features per path).
FIXED_INTERCEPT = -1.0
FIXED_TREES = [
    ("split", "EXT_SOURCE_2", 0.35, True, 1000.0,
     ("split", "loan_to_income_ratio", 2.0, False, 300.0, ("leaf", 0.3, 120.0), ("leaf", 0.55, 180.0)),
     ("split", "bureau_overdue_count", 0.0, True, 700.0, ("leaf", -0.4, 490.0), ("leaf", -0.1, 210.0))),
    ("split", "loan_to_income_ratio", 3.0, True, 1000.0,
     ("split", "EXT_SOURCE_2", 0.5, False, 600.0, ("leaf", 0.1, 240.0), ("leaf", -0.25, 360.0)),
     ("leaf", 0.35, 400.0)),
    ("split", "bureau_overdue_count", 2.0, True, 1000.0, ("leaf", -0.05, 800.0), ("leaf", 0.45, 200.0)),
]


def fixed_ensemble() -> Ensemble:
    leaves = []
    for t, spec in enumerate(FIXED_TREES):
        leaves.extend(leaves_from_tree(t, spec))
    return Ensemble(FIXED_INTERCEPT, leaves)


# ---------------------------------------------------------------------------
# Scoring (G6): margin as a CASE expression per tree -- no join, no shuffle.
# ---------------------------------------------------------------------------
def _condition(feature: str, lo: float, hi: float, null_ok: bool) -> str:
    x = f"CAST(`{feature}` AS DOUBLE)"
    tests = ([f"{x} > {float(lo)!r}D"] if lo != -INF else []) + ([f"{x} <= {float(hi)!r}D"] if hi != INF else [])
    return f"(CASE WHEN `{feature}` IS NULL THEN {str(bool(null_ok)).upper()} ELSE {' AND '.join(tests) or 'TRUE'} END)"


def path_condition(leaf: Leaf) -> str:
    """SQL text: whether a row falls into the leaf."""
    return " AND ".join(_condition(feat, lo, hi, null_ok) for feat, lo, hi, null_ok, _ in leaf.path) or "TRUE"


def margin_expr(ens: Ensemble) -> Column:
    """Intercept plus one CASE per tree, handed to Spark as one SQL text: building
    it costs no call per leaf."""
    by_tree: dict[int, list] = {}
    for lf in ens.leaves:
        by_tree.setdefault(lf.tree, []).append(lf)
    trees = ["CASE " + " ".join(f"WHEN {path_condition(lf)} THEN {float(lf.value)!r}D" for lf in leaves) + " ELSE 0.0D END"
             for leaves in by_tree.values()]
    return F.expr(" + ".join([f"{float(ens.intercept)!r}D", *trees]))


def probability_from_margin(m: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-m))


def score(df: DataFrame, ens: Ensemble, margin_col="margin", prob_col="probability") -> DataFrame:
    m = margin_expr(ens)
    return df.withColumn(margin_col, m).withColumn(prob_col, probability_from_margin(F.col(margin_col)))


def base_value(ens: Ensemble) -> float:
    """Expected margin over the training cover (K2)."""
    total = ens.intercept
    for lf in ens.leaves:
        total += lf.value * math.prod(p[4] for p in lf.path)
    return total


# ---------------------------------------------------------------------------
# Whole models: scoring and attribution (K1) over flat arrays (``trees``).
# ---------------------------------------------------------------------------
def tree_arrays(ens: Ensemble) -> TreeArrays:
    return TreeArrays.from_leaves(ens.leaves, ens.features, ens.intercept)


def score_arrays(df: DataFrame, ens: Ensemble, margin_col: str = "margin", prob_col: str = "probability") -> DataFrame:
    """As ``score`` for ensembles of any size: the arrays are shipped once and rows descend all trees level by level in
    Arrow batches, so neither the plan nor an expression grows with the leaves.  Nothing is shuffled."""
    spark, feats = df.sparkSession, list(ens.features)
    ship_package(spark)
    shipped = spark.sparkContext.broadcast(tree_arrays(ens))  # model-sized

    @F.pandas_udf("double")
    def margin(x: pd.DataFrame) -> pd.Series:
        return pd.Series(shipped.value.margins(x[feats].to_numpy(np.float64, na_value=np.nan)))

    m = margin(F.struct(*[F.col(c).cast("double").alias(c) for c in feats]))
    return df.withColumn(margin_col, m).withColumn(prob_col, probability_from_margin(F.col(margin_col)))


LEAF_SCHEMA = ("tree int, leaf int, value double, cover double, "
               "path array<struct<feature: string, lo: double, hi: double, null_ok: boolean, share: double>>")


def save_leaves(ens: Ensemble, spark, path: str) -> None:
    """The leaf table as Parquet, a row per leaf (model-sized)."""
    flat = [p for x in ens.leaves for p in x.path]
    ends = np.cumsum([0, *(len(x.path) for x in ens.leaves)])
    names = ("feature", "lo", "hi", "null_ok", "share")
    types = (pa.string(), pa.float64(), pa.float64(), pa.bool_(), pa.float64())
    parts = pa.StructArray.from_arrays([pa.array([p[k] for p in flat], t) for k, t in enumerate(types)], names)
    rows = pa.table({"tree": pa.array([x.tree for x in ens.leaves], pa.int32()), "leaf": pa.array([x.leaf for x in ens.leaves], pa.int32()),
                     "value": pa.array([x.value for x in ens.leaves], pa.float64()),
                     "cover": pa.array([x.cover for x in ens.leaves], pa.float64()),
                     "path": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), parts)})
    spark.createDataFrame(rows, LEAF_SCHEMA).write.mode("overwrite").parquet(path)


def load_leaves(spark, path: str, intercept: float, features=None) -> Ensemble:
    """An ensemble from its leaf table (bounded by the model)."""
    rows = spark.read.schema(LEAF_SCHEMA).parquet(path).orderBy("tree", "leaf").toArrow().to_pydict()
    leaves = [Leaf(t, k, v, c, [tuple(p.values()) for p in ps])
              for t, k, v, c, ps in zip(rows["tree"], rows["leaf"], rows["value"], rows["cover"], rows["path"])]
    return Ensemble(intercept, leaves, list(features or S.FEATURES))


def shap_plan(ens: Ensemble) -> ShapPlan:
    return ShapPlan(tree_arrays(ens), base_value(ens))


def shap_matrix(X: np.ndarray, ens: Ensemble) -> np.ndarray:
    """SHAP values (rows x features) of the margin.  NaN in ``X`` = missing."""
    return shap_plan(ens).values(X)


SHAP_STRUCT = T.StructType([
    T.StructField("feature", T.StringType()),
    T.StructField("feature_pos", T.IntegerType()),
    T.StructField("shap_value", T.DoubleType()),
])


def tree_shap(df: DataFrame, ens: Ensemble, key: str = "SK_ID_CURR") -> DataFrame:
    """Per row: ``key``, ``margin_check`` (base + sum of values) and ``shap`` =
    array of (feature, feature_pos, shap_value) for all model features.

    The Shapley values are computed in Arrow batches on the executors as one
    NumPy matrix per batch (no per-row Python); names are attached in the JVM.
    Cost is rows x edges of the trees x half their depth (see ``trees``); nothing is shuffled."""
    feats = list(ens.features)
    key_type = dict(df.dtypes)[key]
    out_schema = T.StructType([
        T.StructField(key, T._parse_datatype_string(key_type)),
        T.StructField("margin_check", T.DoubleType()),
        T.StructField("_phi", T.ArrayType(T.DoubleType())),
    ])
    # the plan is model-sized: ship it once per executor, not per task
    shipped = df.sparkSession.sparkContext.broadcast(shap_plan(ens))

    def run(batches):
        plan = shipped.value
        for pdf in batches:
            X = pdf[feats].astype("float64").to_numpy(na_value=np.nan)
            phi = plan.values(X)
            yield pd.DataFrame({key: pdf[key].to_numpy(), "margin_check": phi.sum(axis=1) + plan.base,
                                "_phi": list(phi)})

    ship_package(df.sparkSession)
    cols = [F.col(key)] + [F.col(c).cast("double").alias(c) for c in feats]
    names = F.array(*[F.lit(f) for f in feats])
    out = df.select(*cols).mapInPandas(run, out_schema)
    shap = F.transform(F.col("_phi"), lambda v, i: F.struct(names[i].alias("feature"), i.cast("int").alias("feature_pos"),
                                                             v.alias("shap_value")))
    return out.select(key, "margin_check", shap.alias("shap"))


def shap_long(shap_df: DataFrame, key: str = "SK_ID_CURR") -> DataFrame:
    return shap_df.select(key, F.inline("shap"))


def _fill(template: str, name: Column, magnitude: Column) -> Column:
    head, rest = template.split("{name}")
    mid, tail = rest.split("{magnitude}")
    return F.concat(F.lit(head), name, F.lit(mid), magnitude, F.lit(tail))


def magnitude_text(v: Column) -> Column:
    """|v| with three decimals: rounded half-up from its 9-decimal value, so the
    text does not depend on binary noise in the last bits."""
    return F.round(F.round(F.abs(v), 9).cast("decimal(20,9)"), 3).cast("decimal(20,3)").cast("string")


def top_factor_array(shap: Column | str, k: int = 6) -> Column:
    """The ``k`` largest |SHAP| entries of an array of (feature, feature_pos,
    shap_value), ties in feature order, as risk-factor structs."""
    shap = F.col(shap) if isinstance(shap, str) else shap
    names = F.create_map(*[x for f, n in S.DISPLAY_NAMES.items() for x in (F.lit(f), F.lit(n))])
    ordered = F.array_sort(F.transform(
        shap, lambda s: F.struct(-F.abs(s["shap_value"]).alias("neg_abs"), s["feature_pos"].alias("pos"),
                                 s["feature"].alias("feature"), s["shap_value"].alias("v"))))

    def factor(s):
        disp = F.coalesce(names[s["feature"]], s["feature"])
        mag = magnitude_text(s["v"])
        inc = s["v"] > 0
        text = F.when(inc, _fill(S.FACTOR_TEXT_INCREASE, disp, mag)).otherwise(_fill(S.FACTOR_TEXT_DECREASE, disp, mag))
        return F.struct(s["feature"].alias("feature"), disp.alias("display_name"), s["v"].alias("shap_value"),
                        F.when(inc, F.lit("risk_increase")).otherwise(F.lit("risk_decrease")).alias("direction"),
                        text.alias("description"))

    return F.transform(F.slice(ordered, 1, k), factor)


def top_factors(shap_df: DataFrame, k: int = 6, key: str = "SK_ID_CURR") -> DataFrame:
    """Per row, the ``k`` largest |SHAP| factors -- sorted inside the row, no shuffle."""
    return shap_df.select(key, top_factor_array("shap", k).alias("top_risk_factors"),
                          F.size("shap").alias("total_features_analyzed"))


def with_factors(df: DataFrame, ens: Ensemble, k: int = 6, out: str = "top_risk_factors") -> DataFrame:
    """Add the top factors next to the columns of ``df`` (which holds the model
    features): TreeSHAP of each Arrow batch, no key and no join, so it also runs
    on a stream."""
    feats = list(ens.features)
    shipped = df.sparkSession.sparkContext.broadcast(shap_plan(ens))
    ship_package(df.sparkSession)

    @F.pandas_udf("array<double>")
    def phi(x: pd.DataFrame) -> pd.Series:
        return pd.Series(list(shipped.value.values(x[feats].astype("float64").to_numpy(na_value=np.nan))))

    names = F.array(*[F.lit(f) for f in feats])
    values = phi(F.struct(*[F.col(c).cast("double").alias(c) for c in feats]))
    shap = F.transform(F.col("_phi"), lambda v, i: F.struct(names[i].alias("feature"), i.cast("int").alias("feature_pos"),
                                                            v.alias("shap_value")))
    return df.withColumn("_phi", values).withColumn(out, top_factor_array(shap, k)).drop("_phi")
