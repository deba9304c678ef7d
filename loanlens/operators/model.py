"""Boosted-tree credit model: class weighting, early stopping, seeded random
search with stratified folds, scoring, persistence, and conversion of a
fitted model into a leaf-table ``Ensemble`` for TreeSHAP.

Training is Spark ML's ``GBTClassifier``: histogram (``maxBins``) splits,
one distributed pass per tree level; nothing is collected but the model."""

from __future__ import annotations

import json
import math
import random
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from threading import Lock

from pyspark import SparkContext
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanlens import schemas as S
from loanlens.operators import ensemble as E
from loanlens.session import materialize as materialize_df
from loanlens.sources.readers import read_optional

# GBT refuses NaN/NULL inputs; missing values become a sentinel far below
# every real value, so a split sends them left, as a native missing-value
# branch would.
MISSING_SENTINEL = -1e9
LABEL, WEIGHT, FEATURES_VEC, VALIDATION = "TARGET", "class_weight", "features_vec", "is_validation"


class ModelNotReady(RuntimeError):
    """The model path does not hold a saved model."""


def prepare(df: DataFrame, features=tuple(S.FEATURES)) -> DataFrame:
    """Feature columns as plain doubles with NULL -> sentinel, and without
    nominal metadata (label codes split as ordered numbers)."""
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(MISSING_SENTINEL)).alias(c, metadata={})
                           for c in features})


def with_class_weight(df: DataFrame, label: str = LABEL) -> tuple[DataFrame, float]:
    """Positives weighted by n_neg / n_pos (one aggregate, one row)."""
    row = df.agg(F.count_if(F.col(label) == 0).alias("neg"), F.count_if(F.col(label) == 1).alias("pos")).first()
    spw = (row["neg"] / row["pos"]) if row["pos"] else 1.0
    return df.withColumn(WEIGHT, F.when(F.col(label) == 1, F.lit(float(spw))).otherwise(F.lit(1.0))), spw


# The local training defaults (<= 100 trees of depth 5).
DEFAULT_PARAMS = {"maxIter": 100, "maxDepth": 5, "stepSize": 0.1, "subsamplingRate": 0.8,
                  "featureSubsetStrategy": "all", "minInstancesPerNode": 1, "minInfoGain": 0.0}


def gbt_pipeline(params: dict | None = None, seed: int = 42, features=tuple(S.FEATURES)) -> Pipeline:
    p = dict(DEFAULT_PARAMS)
    p.update(params or {})
    gbt = GBTClassifier(featuresCol=FEATURES_VEC, labelCol=LABEL, weightCol=WEIGHT, seed=seed, maxBins=64,
                        **{k: v for k, v in p.items()})
    assembler = VectorAssembler(inputCols=list(features), outputCol=FEATURES_VEC, handleInvalid="keep")
    return Pipeline(stages=[assembler, gbt])


def kept_trees(losses: list[float], patience: int) -> tuple[int, bool]:
    """(number of trees with the least validation loss, whether ``patience``
    trees after it brought nothing better)."""
    best = min(range(len(losses)), key=lambda i: (losses[i], i))
    for i in range(len(losses)):
        seen = min(range(i + 1), key=lambda k: (losses[k], k))
        if i - seen >= patience:
            return seen + 1, True
    return best + 1, False


def first_trees(model: PipelineModel, k: int) -> PipelineModel:
    """The model with its first ``k`` trees only.  Boosting is sequential, so this is the model that a fit
    stopped after ``k`` trees gives, at no further pass over the data."""
    assembler, gbt = model.stages
    if k >= gbt.getNumTrees:
        return model
    sc = SparkContext.getOrCreate()  # folds run in threads without a session of their own
    ml = sc._jvm.org.apache.spark.ml
    trees, weights = sc._gateway.new_array(ml.regression.DecisionTreeRegressionModel, k), sc._gateway.new_array(sc._jvm.double, k)
    for i, (tree, w) in enumerate(zip(gbt._java_obj.trees()[:k], gbt.treeWeights)):
        trees[i], weights[i] = tree, w
    cut = GBTClassificationModel(ml.classification.GBTClassificationModel(gbt.uid, trees, weights))
    gbt._copyValues(cut)
    cut._transfer_params_to_java()
    return PipelineModel([assembler, cut])


def fit_with_patience(train_rows: DataFrame, valid_rows: DataFrame, params: dict, patience: int, seed: int = 42):
    """(model, validation loss after each tree grown).  ``2 * patience`` trees are grown at first; only where no tree of
    the last ``patience`` ones failed to lower the validation loss twice as many are, up to ``maxIter``.  The losses of all
    stages come from one pass over the validation rows, and the model is cut to the best count, not fitted again."""
    most = int(params.get("maxIter", DEFAULT_PARAMS["maxIter"]))
    n = min(most, 2 * patience)
    while True:
        model = gbt_pipeline({**params, "maxIter": n}, seed).fit(train_rows)
        losses = list(model.stages[-1].evaluateEachIteration(model.stages[0].transform(valid_rows)))
        keep, stopped = kept_trees(losses, patience)
        if stopped or n >= most:
            return first_trees(model, keep), losses
        n = min(most, 2 * n)


def train(df: DataFrame, params: dict | None = None, early_stopping: bool = True, seed: int = 42,
          materialize: bool = True, patience: int = 30) -> PipelineModel:
    """Fit on ``df`` (features + TARGET [+ is_validation]); with early
    stopping, on the rows outside the validation split, keeping the number of
    trees that ``patience`` selects (see ``fit_with_patience``).
    ``materialize=False`` when ``df`` is already a checkpoint or a table."""
    data = prepare(df)
    if early_stopping and VALIDATION not in data.columns:
        early_stopping = False
    if early_stopping:
        data = data.withColumn(VALIDATION, F.coalesce(F.col(VALIDATION).cast("boolean"), F.lit(False)))
    # Boosting passes over the rows once per tree level and re-plans the input
    # for every pass: materialise the training set once (reliable checkpoint
    # in the shared checkpoint folder) so each pass reads it back with a
    # one-node plan instead of re-analysing and recomputing the lineage.
    data, _ = with_class_weight(materialize_df(data) if materialize else data)
    if early_stopping:
        valid = data.where(VALIDATION)
        if valid.limit(1).count():
            return fit_with_patience(data.where(~F.col(VALIDATION)), valid, params or {}, patience, seed)[0]
    return gbt_pipeline(params, seed).fit(data)


def predict_proba(model: PipelineModel, df: DataFrame, out: str = "probability") -> DataFrame:
    """Positive-class probability next to the input columns."""
    scored = model.transform(prepare(df).drop(out))
    return scored.withColumn(out, vector_to_array(F.col("probability"))[1]) if out != "probability" else \
        scored.withColumn("_p", vector_to_array(F.col("probability"))[1]).drop(
            "probability", "rawPrediction", "prediction", FEATURES_VEC).withColumnRenamed("_p", "probability")


def save(model: PipelineModel, path: str) -> None:
    """Persist (overwrite)."""
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    """Load, or raise ``ModelNotReady`` before any batch or stream runs."""
    try:
        return PipelineModel.load(path)
    except Exception as e:  # noqa: BLE001
        raise ModelNotReady(f"no saved model at {path}") from e


# ---------------------------------------------------------------------------
# Seeded random search over stratified folds
# ---------------------------------------------------------------------------
@dataclass
class SearchSpace:
    # Tuned ranges, as (low, high, step) of whole numbers or (low, high).
    max_iter: tuple = (200, 3000, 50)
    max_depth: tuple = (3, 10, 1)
    step_size: tuple = (0.01, 0.2)          # log-uniform
    subsampling_rate: tuple = (0.3, 1.0)
    feature_share: tuple = (0.3, 1.0)
    min_instances: tuple = (1, 20, 1)
    min_info_gain: tuple = (1e-3, 10.0)     # log-uniform


# Size of a full search, and the least patience of early stopping in it.
SEARCH_TRIALS, SEARCH_FOLDS, LEAST_PATIENCE = 50, 5, 30


def search_patience(step_size: float) -> int:
    """Trees to wait for a better validation loss: more for a smaller learning rate."""
    return max(LEAST_PATIENCE, int(1.5 / step_size))


def sample_params(n_trials: int, space: SearchSpace | None = None, seed: int = 42) -> list[dict]:
    sp = space or SearchSpace()
    rng = random.Random(seed)

    def stepped(lo, hi, step):
        return lo + step * rng.randrange((hi - lo) // step + 1)

    def log_uniform(lo, hi):
        return math.exp(rng.uniform(math.log(lo), math.log(hi)))

    return [{"maxIter": stepped(*sp.max_iter), "maxDepth": stepped(*sp.max_depth), "stepSize": log_uniform(*sp.step_size),
             "subsamplingRate": rng.uniform(*sp.subsampling_rate),
             "featureSubsetStrategy": f"{rng.uniform(*sp.feature_share):.4f}",
             "minInstancesPerNode": stepped(*sp.min_instances), "minInfoGain": log_uniform(*sp.min_info_gain)}
            for _ in range(n_trials)]


TRIAL_SCHEMA = T.StructType([
    T.StructField("trial", T.IntegerType()), T.StructField("mean_auc", T.DoubleType()),
    T.StructField("mean_train_loss", T.DoubleType()), T.StructField("mean_valid_loss", T.DoubleType()),
    T.StructField("fold_auc", T.ArrayType(T.DoubleType())), T.StructField("fold_trees", T.ArrayType(T.IntegerType())),
    T.StructField("maxIter", T.IntegerType()), T.StructField("maxDepth", T.IntegerType()),
    T.StructField("stepSize", T.DoubleType()), T.StructField("subsamplingRate", T.DoubleType()),
    T.StructField("featureSubsetStrategy", T.StringType()), T.StructField("minInstancesPerNode", T.IntegerType()),
    T.StructField("minInfoGain", T.DoubleType()), T.StructField("stopped", T.BooleanType()),
])
PARAM_NAMES = [f.name for f in TRIAL_SCHEMA.fields[6:-1]]
# One row per fold that has ended: what a restarted search reads instead of fitting again.
FOLD_LOG = "trial int, fold int, params string, auc double, train_loss double, valid_loss double, trees int"


class TrialLog:
    """Fold results at a path any driver reaches, each written when its fold ends.  A row counts for the same trial, fold
    and parameters only, so a log of another search is not mixed in; a fold logged twice counts once."""

    def __init__(self, spark: SparkSession, path: str | None):
        self.spark, self.path, self.done, self.lock = spark, path, {}, Lock()
        if path and read_optional(spark, path) is not None:
            for r in spark.read.schema(FOLD_LOG).parquet(path).collect():  # trials x folds rows
                self.done[r["trial"], r["fold"], r["params"]] = (r["auc"], r["train_loss"], r["valid_loss"], r["trees"])

    def result(self, trial: int, fold: int, params: dict, run) -> tuple:
        """The logged result, or that of ``run()``, which is then logged."""
        key = (trial, fold, json.dumps(params, sort_keys=True))
        if key not in self.done:
            found = run()
            with self.lock:
                self.done[key] = found
                if self.path:
                    self.spark.createDataFrame([(*key, *found)], FOLD_LOG).coalesce(1).write.mode("append").parquet(self.path)
        return self.done[key]


def loses(aucs: list[float], best: list[float] | None) -> bool:
    """Whether a trial stops before its last folds: each of its folds so far is worse than every fold of the best
    finished trial before it."""
    return best is not None and max(aucs) < min(best)


def fold_result(data: DataFrame, fold: int, params: dict, fold_col: str = "fold", patience: int | None = None,
                seed: int = 42) -> tuple[float, float, float, int]:
    """(AUC, training loss, validation loss, trees kept) of one fold, fitted with
    early stopping on the fold's own rows."""
    rows, held = data.where(F.col(fold_col) != fold), data.where(F.col(fold_col) == fold)
    model, losses = fit_with_patience(rows, held, params, patience or search_patience(params["stepSize"]), seed)
    assembler, gbt = model.stages
    ev = BinaryClassificationEvaluator(labelCol=LABEL, rawPredictionCol="rawPrediction", metricName="areaUnderROC")
    trees = gbt.getNumTrees
    return (ev.evaluate(model.transform(held)), gbt.evaluateEachIteration(assembler.transform(rows))[-1], losses[trees - 1], trees)


def random_search(df: DataFrame, n_trials: int = SEARCH_TRIALS, fold_col: str = "fold", parallelism: int = 2,
                  space: SearchSpace | None = None, seed: int = 42, patience: int | None = None, log_path: str | None = None):
    """Cross-validated random search; ``df`` carries features, TARGET and a
    stratified ``fold`` column (``sampling.stratified_kfold``).  Returns
    (trial table, model of the best trial fitted on all rows with the mean
    number of trees that its folds kept).

    Trials run one after another, their folds ``parallelism`` at a time: the first half, and the others unless the
    trial ``loses``.  With ``log_path`` every fold result is written when it ends; a search started again
    after a lost driver, with the same arguments, reads them and goes on to the same table."""
    spark = df.sparkSession
    data = materialize_df(prepare(df).withColumn(fold_col, F.col(fold_col).cast("int")))
    data, _ = with_class_weight(data)
    folds = sorted(r[0] for r in data.select(fold_col).distinct().collect())
    log, rows, best = TrialLog(spark, log_path), [], None
    trials = sample_params(n_trials, space, seed)
    half = -(-len(folds) // 2)
    with ThreadPoolExecutor(parallelism) as pool:
        for i, t in enumerate(trials):
            found: list = []
            for part in (folds[:half], folds[half:]):
                if found and loses([r[0] for r in found], best):
                    break
                jobs = [pool.submit(log.result, i, f, t, lambda f=f: fold_result(data, f, t, fold_col, patience, seed)) for f in part]
                found += [j.result() for j in jobs]
            auc, train_loss, valid_loss, trees = map(list, zip(*found))
            n, stopped = len(auc), len(auc) < len(folds)
            rows.append((i, sum(auc) / n, sum(train_loss) / n, sum(valid_loss) / n, auc, trees, *(t[p] for p in PARAM_NAMES), stopped))
            if not stopped and (best is None or sum(auc) / n > sum(best) / len(best)):
                best, chosen = auc, i
    kept = max(1, round(sum(rows[chosen][5]) / len(rows[chosen][5])))
    model = gbt_pipeline({**trials[chosen], "maxIter": kept}, seed).fit(data)
    return spark.createDataFrame(rows, TRIAL_SCHEMA), model


def best_trial(trials: DataFrame) -> DataFrame:
    """Highest mean AUC of the trials that ran all their folds, lowest trial number on ties."""
    return trials.where("not stopped").orderBy(F.desc("mean_auc"), F.asc("trial")).limit(1)


# ---------------------------------------------------------------------------
# Fitted model -> leaf table (K1 on real models)
# ---------------------------------------------------------------------------
def to_ensemble(model: PipelineModel, spark: SparkSession, path: str,
                features=tuple(S.FEATURES)) -> E.Ensemble:
    """Read the saved node table of the GBT stage (bounded by the model size)
    and flatten it into leaves with covers.  The margin in log-odds is
    2 * sum(treeWeight * leaf prediction)."""
    save(model, path)
    gbt = model.stages[-1]
    # PipelineModel writes stage i under stages/<i>_<uid>; the GBT node table
    # is the Parquet folder data/ (any file system URI works).
    base = f"{path.rstrip('/')}/stages/{len(model.stages) - 1}_{gbt.uid}"
    nodes = spark.read.parquet(f"{base}/data").collect()
    weights = list(gbt.treeWeights)
    by_tree: dict[int, dict[int, object]] = {}
    for r in nodes:
        by_tree.setdefault(r["treeID"], {})[r["nodeData"]["id"]] = r["nodeData"]
    leaves = []
    for tid, nd in sorted(by_tree.items()):
        w = 2.0 * weights[tid]

        def spec(i):
            n = nd[i]
            cover = float(n["impurityStats"][0]) if n["impurityStats"] else 1.0
            if n["leftChild"] < 0:
                return ("leaf", w * float(n["prediction"]), cover)
            thr = float(n["split"]["leftCategoriesOrThreshold"][0])
            feat = features[n["split"]["featureIndex"]]
            return ("split", feat, thr, True, cover, spec(n["leftChild"]), spec(n["rightChild"]))

        root = min(nd)
        leaves.extend(E.leaves_from_tree(tid, spec(root)))
    return E.Ensemble(0.0, leaves, list(features))
