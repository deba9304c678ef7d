"""TreeSHAP by leaves against brute-force Shapley values."""

import itertools
import math
import random

import numpy as np

from loanlens.operators import ensemble as E

FEATS = ["f0", "f1", "f2", "f3"]


def _random_tree(rng, depth, cover):
    if depth == 0 or rng.random() < 0.2:
        return ("leaf", rng.uniform(-1, 1), cover)
    f = rng.choice(FEATS)
    left = cover * rng.uniform(0.2, 0.8)
    return ("split", f, rng.uniform(-1, 1), rng.random() < 0.5, cover,
            _random_tree(rng, depth - 1, left), _random_tree(rng, depth - 1, cover - left))


def _expected(node, x, subset):
    """Path-dependent conditional expectation E[f(x) | x_S] of one tree."""
    if node[0] == "leaf":
        return node[1]
    _, f, thr, missing_left, cover, left, right = node
    if f in subset:
        v = x[FEATS.index(f)]
        go_left = missing_left if math.isnan(v) else v <= thr
        return _expected(left if go_left else right, x, subset)
    lc = left[2] if left[0] == "leaf" else left[4]
    rc = right[2] if right[0] == "leaf" else right[4]
    return (lc * _expected(left, x, subset) + rc * _expected(right, x, subset)) / cover


def _brute(trees, x):
    n = len(FEATS)
    phi = np.zeros(n)
    for i in range(n):
        others = [f for j, f in enumerate(FEATS) if j != i]
        for k in range(n):
            for sub in itertools.combinations(others, k):
                w = math.factorial(k) * math.factorial(n - k - 1) / math.factorial(n)
                s = set(sub)
                phi[i] += w * sum(_expected(t, x, s | {FEATS[i]}) - _expected(t, x, s) for t in trees)
    return phi


def test_leaf_shap_equals_brute_force():
    rng = random.Random(11)
    trees = [_random_tree(rng, 4, 100.0) for _ in range(6)]
    leaves = []
    for t, spec in enumerate(trees):
        leaves.extend(E.leaves_from_tree(t, spec))
    ens = E.Ensemble(0.3, leaves, FEATS)
    X = np.array([[rng.uniform(-1, 1) if rng.random() > 0.15 else np.nan for _ in FEATS] for _ in range(25)])
    phi = E.shap_matrix(X, ens)
    for row, p in zip(X, phi):
        assert np.allclose(p, _brute(trees, row), atol=1e-12)
        margin = ens.intercept + sum(_expected(t, row, set(FEATS)) for t in trees)
        assert math.isclose(p.sum() + E.base_value(ens), margin, abs_tol=1e-12)


def test_top_factor_text_and_order(spark):
    shap = [("applicant_age", 0, 0.0625), ("income_total", 1, -0.5), ("loan_amount", 2, 0.0), ("x_unnamed", 3, 0.5)]
    df = spark.createDataFrame([(1, [s for s in shap])], "SK_ID_CURR long, shap array<struct<feature:string,"
                                                         "feature_pos:int,shap_value:double>>")
    top = E.top_factors(df, k=3).first()
    feats = [f.feature for f in top.top_risk_factors]
    assert feats == ["income_total", "x_unnamed", "applicant_age"]  # ties by feature order
    assert top.top_risk_factors[0].direction == "risk_decrease"
    assert top.top_risk_factors[1].display_name == "x_unnamed"
    assert top.top_risk_factors[2].description.endswith("+0.063).")
    assert top.total_features_analyzed == 4
