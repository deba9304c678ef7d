"""Registered queries that train: the boosted-tree model on the book, its
scores, decisions and explanations, and a cross-validated random search.
No oracle (a second engine cannot train the same trees); pytest checks
them against invariants instead."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from loanlens.operators import ensemble as E
from loanlens.operators import model as MD
from loanlens.operators.decision import classify
from loanlens.operators.sampling import stratified_kfold, stratified_split
from loanlens.plans import book
from loanlens.plans.catalog import query
from loanlens.plans.queries_eval import TEST_FRACTION
from loanlens.session import checkpoint_dir, materialize

# The book model (early stopping on the validation split).
BOOK_PARAMS = {"maxIter": 60, "maxDepth": 5, "stepSize": 0.1}
# The registered search is a small instance of ``model.random_search``, whose defaults are the full
# one (50 trials x 5 folds, 200-3000 trees): a full search takes hours on one machine.
SEARCH_TRIALS = 3
SEARCH_FOLDS = 3
SEARCH_PATIENCE = 5
SEARCH_SPACE = MD.SearchSpace(max_iter=(5, 20, 5), max_depth=(2, 5, 1))


def model_dir(spark) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/models/{uuid.uuid4().hex}"


def trained_book(spark, sf):
    """(features, split flag, fitted model)."""
    feats, _ = book.book_features(spark, sf)
    # training, scoring and explanation all read the book: materialise it once
    data = materialize(stratified_split(feats, TEST_FRACTION))
    return data, MD.train(data, BOOK_PARAMS, materialize=False)


@query("score_book")
def score_book(spark, sf):
    """Train on the book, then score, decide and
    explain every applicant (full prediction record)."""
    data, model = trained_book(spark, sf)
    scored = MD.predict_proba(model, data.drop("is_validation"))
    decided = classify(scored, prob_col="probability").select(
        "SK_ID_CURR", "probability", "credit_score", "risk_grade", "recommended_action")
    ens = MD.to_ensemble(model, spark, model_dir(spark))
    factors = E.top_factors(E.tree_shap(MD.prepare(data), ens), 6)
    return decided.join(factors, "SK_ID_CURR")


@query("tree_shap_model")
def tree_shap_model(spark, sf):
    """K1 on the trained model: SHAP of every applicant and feature, with the
    additivity residual (base + sum - margin)."""
    data, model = trained_book(spark, sf)
    ens = MD.to_ensemble(model, spark, model_dir(spark))
    shap = E.tree_shap(MD.prepare(data), ens)
    margin = E.score_arrays(MD.prepare(data), ens).select("SK_ID_CURR", "margin")
    return shap.join(margin, "SK_ID_CURR").select(
        "SK_ID_CURR", F.inline("shap"), (F.col("margin_check") - F.col("margin")).alias("additivity_error"))


def _trials(spark, sf):
    feats, _ = book.book_features(spark, sf)
    folds = stratified_kfold(feats, SEARCH_FOLDS)
    return MD.random_search(folds, SEARCH_TRIALS, space=SEARCH_SPACE, patience=SEARCH_PATIENCE)[0]


@query("model_search")
def model_search(spark, sf):
    """Random search, mean fold AUC per trial."""
    return _trials(spark, sf)


@query("best_trial")
def best_trial(spark, sf):
    """The best trial of the search."""
    return MD.best_trial(_trials(spark, sf))
