"""Registered queries on whole-size ensembles held as leaf tables: scoring 500 trees of depth 8, and TreeSHAP of trees
of depth 5 whose paths meet the same feature again.

The trees follow a rule (no second engine trains the same ones), so the oracle can walk or expand them by itself."""

from __future__ import annotations

import itertools
import math
import uuid

from loanlens import schemas as S
from loanlens.operators import ensemble as E
from loanlens.plans import book
from loanlens.plans import oracle_sql as O
from loanlens.plans.catalog import query
from loanlens.session import checkpoint_dir

# The rule of the large ensemble.  Node i of tree t (heap numbers from 1) splits feature
# (7 t + 5 i + t i % 11) % 24 at low + (high - low) * ((37 t + 61 i) % 97) / 97; missing values go left where t + i is even;
# leaf j holds ((31 t + 17 j) % 101 - 50) / 1000 and has 1 + (13 t + 29 j) % 17 rows of cover.
TREES, DEPTH, INTERCEPT = 500, 8, 0.25
RANGES = {"applicant_age": (20, 70), "income_total": (25e3, 425e3), "employment_years": (0, 33), "loan_amount": (45e3, 945e3),
          "loan_annuity": (2e3, 1e5), "goods_price": (4e4, 85e4), "num_children": (0, 3), "NAME_EDUCATION_TYPE": (0, 4),
          "NAME_HOUSING_TYPE": (0, 4), "bureau_loans_active": (0, 20), "bureau_overdue_count": (0, 5),
          "prev_application_count": (0, 20), "loan_to_income_ratio": (0, 10), "payment_rate": (0, 0.15),
          "income_per_person": (1e4, 2e5)}
SHAP_FEATURES = ("EXT_SOURCE_1", "EXT_SOURCE_2", "loan_to_income_ratio", "bureau_overdue_count")
SHAP_TREES, SHAP_DEPTH = 4, 5


def _range(feature: str) -> tuple[float, float]:
    return tuple(map(float, RANGES.get(feature, (0, 1))))


def large_ensemble() -> E.Ensemble:
    def node(t: int, i: int, level: int):
        if level == DEPTH:
            return ("leaf", ((31 * t + 17 * i) % 101 - 50) / 1000.0, 1.0 + (13 * t + 29 * i) % 17)
        name = S.FEATURES[(7 * t + 5 * i + t * i % 11) % len(S.FEATURES)]
        low, high = _range(name)
        left, right = node(t, 2 * i, level + 1), node(t, 2 * i + 1, level + 1)
        cover = sum(c[2] if c[0] == "leaf" else c[4] for c in (left, right))
        return ("split", name, low + (high - low) * ((37 * t + 61 * i) % 97) / 97.0, (t + i) % 2 == 0, cover, left, right)
    return E.Ensemble(INTERCEPT, [x for t in range(TREES) for x in E.leaves_from_tree(t, node(t, 1, 0))])


def deep_ensemble() -> E.Ensemble:
    """A few trees over four features: every path meets one of them again."""
    def node(t: int, i: int, level: int):
        if level == SHAP_DEPTH:
            return ("leaf", ((31 * t + 17 * i) % 101 - 50) / 100.0, 1.0 + (13 * t + 29 * i) % 17)
        name = SHAP_FEATURES[(t + 3 * i + i * i % 5) % 4]
        low, high = _range(name)
        left, right = node(t, 2 * i, level + 1), node(t, 2 * i + 1, level + 1)
        cover = sum(c[2] if c[0] == "leaf" else c[4] for c in (left, right))
        return ("split", name, low + (high - low) * ((37 * t + 61 * i) % 97) / 97.0, (t + i) % 2 == 0, cover, left, right)
    return E.Ensemble(0.0, [x for t in range(SHAP_TREES) for x in E.leaves_from_tree(t, node(t, 1, 0))])


def stored(spark, ens: E.Ensemble) -> E.Ensemble:
    """The ensemble by way of its leaf table."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/leaves/{uuid.uuid4().hex}"
    E.save_leaves(ens, spark, path)
    return E.load_leaves(spark, path, ens.intercept, ens.features)


def _walk_sql() -> str:
    """Heap walk of every tree for every applicant, one level per nested SELECT."""
    xs = "[" + ", ".join(f"CAST({f} AS DOUBLE)" for f in S.FEATURES) + "]"
    lows = "[" + ", ".join(f"{_range(f)[0]!r}::DOUBLE" for f in S.FEATURES) + "]"
    highs = "[" + ", ".join(f"{_range(f)[1]!r}::DOUBLE" for f in S.FEATURES) + "]"
    f, x = "(7*t + 5*i + (t*i) % 11) % 24 + 1", "x[(7*t + 5*i + (t*i) % 11) % 24 + 1]"
    threshold = f"lo[{f}] + (hi[{f}] - lo[{f}]) * ((37*t + 61*i) % 97) / 97e0"
    sql = f"SELECT SK_ID_CURR, {xs} AS x, t, 1::BIGINT AS i, {lows} AS lo, {highs} AS hi FROM features, (SELECT unnest(range({TREES})) AS t)"
    for _ in range(DEPTH):
        sql = (f"SELECT SK_ID_CURR, x, t, lo, hi, 2*i + CASE WHEN {x} IS NULL THEN CASE WHEN (t + i) % 2 = 0 THEN 0 ELSE 1 END "
               f"WHEN {x} <= {threshold} THEN 0 ELSE 1 END AS i FROM ({sql})")
    return (f"SELECT SK_ID_CURR, {INTERCEPT} + sum(((31*t + 17*i) % 101 - 50) / 1000e0) AS margin FROM ({sql}) GROUP BY SK_ID_CURR")


def _shapley_sql() -> str:
    """Shapley values by their definition: every leaf, every subset of the other features."""
    ens, k = deep_ensemble(), len(SHAP_FEATURES)
    rows = []
    for leaf in ens.leaves:
        merged = {f: [-E.INF, E.INF, True, 1.0] for f in SHAP_FEATURES}
        for f, lo, hi, ok, z in leaf.path:
            m = merged[f]
            m[:] = [max(m[0], lo), min(m[1], hi), m[2] and ok, m[3] * z]
        cells = [f"{v!r}::DOUBLE" if abs(v) != E.INF else f"'{'-' if v < 0 else ''}infinity'::DOUBLE"
                 for f in SHAP_FEATURES for v in (merged[f][0], merged[f][1], merged[f][3])]
        rows.append("(" + ", ".join([f"{leaf.value!r}::DOUBLE", *cells, *(str(merged[f][2]).upper() for f in SHAP_FEATURES)]) + ")")
    names = ["v", *(f"{c}{j}" for j in range(k) for c in ("lo", "hi", "z")), *(f"ok{j}" for j in range(k))]
    met = ", ".join(f"CASE WHEN {f} IS NULL THEN CAST(ok{j} AS DOUBLE) WHEN {f} > lo{j} AND {f} <= hi{j} THEN 1e0 ELSE 0e0 END AS o{j}"
                    for j, f in enumerate(SHAP_FEATURES))
    parts = []
    for j, f in enumerate(SHAP_FEATURES):
        others = [i for i in range(k) if i != j]
        terms = [f"{math.factorial(n) * math.factorial(k - 1 - n) / math.factorial(k)!r} * "
                 + " * ".join(f"{'o' if i in s else 'z'}{i}" for i in others)
                 for n in range(k) for s in itertools.combinations(others, n)]
        parts.append(f"SELECT SK_ID_CURR, '{f}' AS feature, sum(v * (o{j} - z{j}) * ({' + '.join(terms)})) AS shap_value FROM met GROUP BY SK_ID_CURR")
    return O.with_ctes(O.FEATURES, f"leaves({', '.join(names)}) AS (VALUES {', '.join(rows)})",
                       f"met AS (SELECT SK_ID_CURR, leaves.*, {met} FROM features, leaves)") + " UNION ALL ".join(parts)


@query("score_tree_arrays", O.with_ctes(O.FEATURES) + _walk_sql(), doubles=["margin"])
def score_tree_arrays(spark, sf):
    """500 trees of depth 8 from their leaf table (128,000 leaves), as flat arrays."""
    feats, _ = book.book_features(spark, sf)
    return E.score_arrays(feats, stored(spark, large_ensemble())).select("SK_ID_CURR", "margin")


@query("tree_shap_deep", _shapley_sql(), doubles=["shap_value"])
def tree_shap_deep(spark, sf):
    """K1: TreeSHAP where paths of depth 5 meet their four features again, against Shapley's definition."""
    feats, _ = book.book_features(spark, sf)
    return E.shap_long(E.tree_shap(feats, stored(spark, deep_ensemble()))).where(
        "feature IN ('" + "', '".join(SHAP_FEATURES) + "')").select("SK_ID_CURR", "feature", "shap_value")
