"""Training, persistence, scoring and the model -> leaf-table conversion."""

import pytest
from pyspark.sql import functions as F

from loanlens.operators import ensemble as E
from loanlens.operators import metrics as MT
from loanlens.operators import model as MD
from loanlens.operators.sampling import stratified_kfold, stratified_split
from loanlens.plans import book
from loanlens.sources.readers import read_reference, write_reference

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def trained(spark):
    feats, _ = book.book_features(spark, SF)
    data = stratified_split(feats, 0.2).cache()
    model = MD.train(data, {"maxIter": 15, "maxDepth": 3})
    yield data, model
    data.unpersist()


def test_model_beats_chance_and_matches_leaf_table(spark, trained, tmp_path):
    data, model = trained
    scored = MD.predict_proba(model, data)
    auc = MT.roc_auc(scored.where("is_validation")).first().roc_auc
    assert auc > 0.6
    ens = MD.to_ensemble(model, spark, str(tmp_path / "m"))
    leaf = E.score(MD.prepare(data), ens).select("SK_ID_CURR", F.col("probability").alias("p2"))
    diff = scored.join(leaf, "SK_ID_CURR").agg(F.max(F.abs(F.col("probability") - F.col("p2")))).first()[0]
    assert diff < 1e-9
    shap = E.tree_shap(MD.prepare(data), ens).join(E.score(MD.prepare(data), ens), "SK_ID_CURR")
    err = shap.agg(F.max(F.abs(F.col("margin_check") - F.col("margin")))).first()[0]
    assert err < 1e-9


def test_save_load_and_missing_model(spark, trained, tmp_path):
    _, model = trained
    MD.save(model, str(tmp_path / "saved"))
    back = MD.load(str(tmp_path / "saved"))
    assert back.stages[-1].getNumTrees == model.stages[-1].getNumTrees
    with pytest.raises(MD.ModelNotReady):
        MD.load(str(tmp_path / "absent"))


def test_reference_sample_roundtrip(spark, trained, tmp_path):
    data, _ = trained
    ref = data.where("is_validation").drop("is_validation")
    write_reference(ref, str(tmp_path / "reference"))
    back = read_reference(spark, str(tmp_path / "reference"))
    assert back.count() == ref.count() and "TARGET" in back.columns
    assert read_reference(spark, str(tmp_path / "nothing")) is None


def test_random_search_and_best_trial(spark):
    feats, _ = book.book_features(spark, "/root/testdata/sf0.001")
    folds = stratified_kfold(feats, 3)
    space = MD.SearchSpace(max_iter=(3, 6, 3), max_depth=(2, 3, 1))
    trials, best = MD.random_search(folds, 2, space=space, patience=2)
    rows = trials.collect()
    assert len(rows) == 2 and all(0 <= r.mean_auc <= 1 for r in rows)
    for r in rows:
        assert len(r.fold_auc) == len(r.fold_trees) == 3 and r.mean_train_loss > 0 and r.mean_valid_loss > 0
        assert abs(r.mean_auc - sum(r.fold_auc) / 3) < 1e-12 and all(1 <= n <= r.maxIter for n in r.fold_trees)
    assert MD.search_patience(0.2) == 30 and MD.search_patience(0.01) == 150
    b = MD.best_trial(trials).first()
    assert b.mean_auc == max(r.mean_auc for r in rows)
    assert MD.sample_params(3, space, seed=1) == MD.sample_params(3, space, seed=1)


def test_a_search_killed_halfway_goes_on_from_its_log(spark, tmp_path, monkeypatch):
    feats, _ = book.book_features(spark, "/root/testdata/sf0.001")
    folds = stratified_kfold(feats, 2)
    search = dict(n_trials=2, space=MD.SearchSpace(max_iter=(3, 6, 3), max_depth=(2, 3, 1)), patience=2, parallelism=1)
    whole = sorted(map(tuple, MD.random_search(folds, **search)[0].collect()))
    path, calls, fold_result = str(tmp_path / "log"), [], MD.fold_result

    def dies(*args):
        if len(calls) == 2:
            raise RuntimeError("driver lost")
        calls.append(args[1])
        return fold_result(*args)

    monkeypatch.setattr(MD, "fold_result", dies)
    with pytest.raises(RuntimeError):
        MD.random_search(folds, **search, log_path=path)
    assert spark.read.parquet(path).count() == 2
    again = []
    monkeypatch.setattr(MD, "fold_result", lambda *a: again.append(a[1]) or fold_result(*a))
    got = sorted(map(tuple, MD.random_search(folds, **search, log_path=path)[0].collect()))
    assert got == whole and len(again) == sum(len(r[4]) for r in whole) - 2
    third = []
    monkeypatch.setattr(MD, "fold_result", lambda *a: third.append(a))
    assert sorted(map(tuple, MD.random_search(folds, **search, log_path=path)[0].collect())) == whole and not third


def test_losing_trials_stop_and_never_win(spark, monkeypatch):
    assert MD.loses([0.5, 0.6], [0.7, 0.65]) and not MD.loses([0.5, 0.66], [0.7, 0.65]) and not MD.loses([0.1], None)
    feats, _ = book.book_features(spark, "/root/testdata/sf0.001")
    folds = stratified_kfold(feats, 3)
    monkeypatch.setattr(MD, "fold_result", lambda data, f, t, *_: (0.9 if t is first else 0.4, 0.1, 0.2, 3))
    trials = MD.sample_params(3, MD.SearchSpace(max_iter=(3, 6, 3), max_depth=(2, 3, 1)))
    first = trials[0]
    monkeypatch.setattr(MD, "sample_params", lambda *_: trials)
    table, _ = MD.random_search(folds, 3)
    assert [(r.stopped, len(r.fold_auc)) for r in sorted(table.collect())] == [(False, 3), (True, 2), (True, 2)]
    assert MD.best_trial(table).first().trial == 0


def test_model_info_in_stats(spark, trained, tmp_path):
    from loanlens.operators import monitoring as M
    _, model = trained
    MD.save(model, str(tmp_path / "m"))
    when = M.model_trained_at(spark, str(tmp_path / "m"))
    assert when is not None
    stats = spark.createDataFrame([(1,)], "total_predictions long")
    row = M.with_model_info(stats, "v1", when).first()
    assert row.model_version == "v1" and row.model_trained_at is not None
    assert M.model_trained_at(spark, str(tmp_path / "none")) is None


def test_score_book_record(spark):
    """K7: one full prediction record per applicant: probability, decision and
    six explained factors whose SHAP values are ranked by magnitude."""
    import __spark_entry__ as entry
    df = entry.queries()["score_book"](spark, "/root/testdata/sf0.001")
    rows = df.collect()
    n_app = book.book_features(spark, "/root/testdata/sf0.001")[0].count()
    assert len(rows) == n_app
    for r in rows[:50]:
        assert 0.0 <= r.probability <= 1.0 and 300 <= r.credit_score <= 850
        assert r.risk_grade in {"Excellent", "Good", "Fair", "Poor"}
        mags = [abs(f.shap_value) for f in r.top_risk_factors]
        assert len(mags) == 6 and mags == sorted(mags, reverse=True)
        assert r.total_features_analyzed == 24


def test_kept_trees_follow_the_patience_rule():
    assert MD.kept_trees([5, 4, 3, 4, 5, 2], 2) == (3, True)
    assert MD.kept_trees([5, 4, 3, 4, 2, 3], 3) == (5, False)
    assert MD.kept_trees([3, 3, 3], 5) == (1, False)


def test_early_stopping_keeps_the_best_count(spark):
    feats, _ = book.book_features(spark, SF)
    data = MD.prepare(stratified_split(feats, 0.2)).cache()
    weighted, _ = MD.with_class_weight(data)
    fit, valid = weighted.where("not is_validation"), weighted.where("is_validation")
    model, losses = MD.fit_with_patience(fit, valid, {"maxIter": 12, "maxDepth": 3}, patience=3)
    kept, _ = MD.kept_trees(losses, 3)
    assert model.stages[-1].getNumTrees == kept >= 1
    again = MD.train(data, {"maxIter": 12, "maxDepth": 3}, patience=3)
    assert again.stages[-1].getNumTrees == kept
    data.unpersist()


def test_many_leaves_are_scored_and_explained(spark):
    import time
    spec = lambda d, k: ("leaf", (k % 13 - 6) / 100, 10.0) if d == 0 else (
        "split", "EXT_SOURCE_1" if d % 2 else "applicant_age", (k % 7) / 10 + d, True, 20.0, spec(d - 1, 2 * k), spec(d - 1, 2 * k + 1))
    leaves = [x for t in range(100) for x in E.leaves_from_tree(t, spec(5, t))]
    ens = E.Ensemble(0.1, leaves)
    feats, _ = book.book_features(spark, "/root/testdata/sf0.001")
    began = time.time()
    scored = E.score(MD.prepare(feats), ens).select("SK_ID_CURR", "margin")
    assert time.time() - began < 20  # no call per leaf
    err = E.tree_shap(MD.prepare(feats), ens).join(scored, "SK_ID_CURR").agg(F.max(F.abs(F.col("margin_check") - F.col("margin")))).first()[0]
    assert err < 1e-9
