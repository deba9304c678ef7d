"""Ensembles as flat arrays: scoring, leaf tables, TreeSHAP on deep trees, and models cut to their first trees."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from loanlens.operators import ensemble as E
from loanlens.operators import model as MD
from loanlens.operators.sampling import stratified_split
from loanlens.operators.trees import GROUP_NODES
from loanlens.plans import book, queries_trees as Q
from tests.test_shap import FEATS, _brute, _expected, _random_tree

SF = "/root/testdata/sf0.001"


def ensemble(trees, intercept=0.3):
    return E.Ensemble(intercept, [x for t, spec in enumerate(trees) for x in E.leaves_from_tree(t, spec)], FEATS)


def rows(rng, n):
    return np.array([[rng.uniform(-1, 1) if rng.random() > 0.15 else np.nan for _ in FEATS] for _ in range(n)])


def test_margins_equal_a_walk_of_each_tree():
    rng = random.Random(1)
    trees = [_random_tree(rng, 6, 100.0) for _ in range(40)] + [("leaf", 0.5, 1.0)]
    x = rows(rng, 50)
    got = E.tree_arrays(ensemble(trees)).margins(x)
    assert np.allclose(got, [0.3 + sum(_expected(t, r, set(FEATS)) for t in trees) for r in x], atol=1e-12)
    assert E.tree_arrays(E.Ensemble(0.7, [], FEATS)).margins(x).tolist() == [0.7] * 50


def test_deep_trees_that_meet_a_feature_again_equal_the_definition():
    rng = random.Random(2)
    trees = [_random_tree(rng, 9, 1000.0) for _ in range(5)] + [("leaf", 0.5, 1.0)]
    x, ens = rows(rng, 6), ensemble(trees)
    assert max(len(leaf.path) for leaf in ens.leaves) > len(FEATS)
    assert np.allclose(E.shap_matrix(x, ens), [_brute(trees, r) for r in x], atol=1e-10)


def test_many_groups_of_trees_add_up():
    rng = random.Random(3)
    trees = [_random_tree(rng, 8, 1000.0) for _ in range(120)]
    ens, x = ensemble(trees), rows(rng, 300)
    plan = E.shap_plan(ens)
    assert len(plan.groups) > 1 and all(slots <= 2 * GROUP_NODES for _, slots in plan.groups)
    got = plan.values(x)
    assert np.allclose(got.sum(1) + plan.base, E.tree_arrays(ens).margins(x), atol=1e-9)
    assert np.allclose(got[:3], sum(E.shap_matrix(x[:3], ensemble([t], 0.0)) for t in trees), atol=1e-10)


def test_leaf_table_round_trip(spark, tmp_path):
    rng = random.Random(4)
    ens = ensemble([_random_tree(rng, 5, 10.0) for _ in range(7)])
    E.save_leaves(ens, spark, str(tmp_path / "leaves"))
    back = E.load_leaves(spark, str(tmp_path / "leaves"), ens.intercept, FEATS)
    assert [(x.tree, x.leaf, x.value, x.cover, x.path) for x in back.leaves] == [(x.tree, x.leaf, x.value, x.cover, x.path) for x in ens.leaves]


def test_arrays_and_expression_agree_on_null_features(spark):
    ens = Q.deep_ensemble()
    feats, _ = book.book_features(spark, SF)
    a = E.score(feats, ens).select("SK_ID_CURR", "margin")
    b = E.score_arrays(feats, ens).select("SK_ID_CURR", F.col("margin").alias("m2"), "probability")
    worst = a.join(b, "SK_ID_CURR").agg(F.max(F.abs(F.col("margin") - F.col("m2"))), F.min("probability"), F.count("*")).first()
    assert worst[0] < 1e-12 and worst[1] > 0 and worst[2] == feats.count()


def test_cost_of_500_trees(spark):
    """The plan does not grow with the leaves, and explaining a row costs milliseconds."""
    ens = Q.large_ensemble()
    feats, _ = book.book_features(spark, SF)
    plan = E.score_arrays(feats, ens)._jdf.queryExecution().executedPlan().toString()
    assert len(plan) < 100_000 and "ArrowEvalPython" in plan
    x = rows(random.Random(5), 256)
    x = np.tile(x, (1, 6))
    shap, began = E.shap_plan(ens), time.time()
    got = shap.values(x)
    assert (time.time() - began) / len(x) < 0.1
    assert np.allclose(got.sum(1) + shap.base, E.tree_arrays(ens).margins(x), atol=1e-8)


@pytest.fixture(scope="module")
def training(spark):
    feats, _ = book.book_features(spark, "/root/testdata/sf0.01")
    data = MD.prepare(stratified_split(feats, 0.2)).cache()
    yield MD.with_class_weight(data)[0]
    data.unpersist()


def test_a_cut_model_is_the_model_of_a_shorter_fit(spark, training, tmp_path):
    params = {"maxDepth": 3, "subsamplingRate": 0.8}
    long, short = (MD.gbt_pipeline({**params, "maxIter": n}).fit(training) for n in (9, 4))
    cut = MD.first_trees(long, 4)
    assert cut.stages[-1].getNumTrees == 4 and long.stages[-1].getNumTrees == 9
    nodes = lambda m: [t.toDebugString.split("\n", 1)[1] for t in m.stages[-1].trees]
    assert nodes(cut) == nodes(short)
    assert cut.stages[-1].treeWeights == short.stages[-1].treeWeights
    key = ["SK_ID_CURR", "p"]
    score = lambda m: dict(MD.predict_proba(m, training, "p").select(*key).collect())
    want = score(short)
    assert score(cut) == want
    MD.save(cut, str(tmp_path / "cut"))
    assert score(MD.load(str(tmp_path / "cut"))) == want
    assert MD.first_trees(long, 9) is long


def test_early_stopping_fits_once(training, monkeypatch):
    fits = []
    whole = MD.gbt_pipeline
    monkeypatch.setattr(MD, "gbt_pipeline", lambda p, seed: fits.append(p["maxIter"]) or whole(p, seed))
    model, losses = MD.fit_with_patience(training.where("not is_validation"), training.where("is_validation"), {"maxIter": 8, "maxDepth": 3}, 4)
    assert fits == [8] and len(losses) == 8
    assert model.stages[-1].getNumTrees == MD.kept_trees(losses, 4)[0]
