"""Evaluation metrics against brute force."""

import itertools
import math

import numpy as np
from pyspark.sql import functions as F

from loanlens.operators import metrics as MT


def _data(spark, n=400, seed=5):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, n)
    p = np.round(np.clip(rng.normal(0.35 + 0.3 * y, 0.2), 0, 1), 2)  # rounded: many ties
    return spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, p)], "TARGET int, probability double"), y, p


def _brute_auc(y, p):
    pos, neg = p[y == 1], p[y == 0]
    s = sum(1.0 if a > b else 0.5 if a == b else 0.0 for a, b in itertools.product(pos, neg))
    return s / (len(pos) * len(neg))


def test_roc_auc_equals_mann_whitney(spark):
    df, y, p = _data(spark)
    auc = MT.roc_auc(df).first().roc_auc
    assert math.isclose(auc, _brute_auc(y, p), rel_tol=1e-12)
    flipped = MT.roc_auc(df.withColumn("probability", -F.col("probability"))).first().roc_auc
    assert math.isclose(auc + flipped, 1.0, rel_tol=1e-12)


def test_single_class_auc_is_null(spark):
    df = spark.createDataFrame([(1, 0.2), (1, 0.4)], "TARGET int, probability double")
    assert MT.roc_auc(df).first().roc_auc is None


def test_pr_auc_trapezoid(spark):
    df, y, p = _data(spark)
    thr = sorted(set(p), reverse=True)
    P = (y == 1).sum()
    pts = [(0.0, 1.0)]
    for t in thr:
        tp = ((p >= t) & (y == 1)).sum()
        fp = ((p >= t) & (y == 0)).sum()
        pts.append((tp / P, tp / (tp + fp)))
    area = sum((r2 - r1) * (q1 + q2) / 2 for (r1, q1), (r2, q2) in zip(pts, pts[1:]))
    assert math.isclose(MT.pr_auc(df).first().pr_auc, area, rel_tol=1e-12)


def test_confusion_f1_report_logloss(spark):
    df, y, p = _data(spark)
    c = MT.confusion(df).first()
    pred = (p >= 0.5).astype(int)
    assert c.tp == ((pred == 1) & (y == 1)).sum() and c.fn == ((pred == 0) & (y == 1)).sum()
    f1 = MT.f1_score(MT.confusion(df)).first().f1
    assert math.isclose(f1, 2 * c.tp / (2 * c.tp + c.fp + c.fn))
    rep = {r["class"]: r for r in MT.classification_report(MT.confusion(df)).collect()}
    assert math.isclose(rep["1"].f1_score, f1)
    assert math.isclose(rep["accuracy"].f1_score, (pred == y).mean())
    assert rep["weighted avg"].support == len(y)
    pc = np.clip(p, 1e-15, 1 - 1e-15)
    ll = -np.mean(y * np.log(pc) + (1 - y) * np.log(1 - pc))
    assert math.isclose(MT.log_loss(df).first().log_loss, ll, rel_tol=1e-12)


def test_class_balance(spark):
    df, y, _ = _data(spark)
    r = MT.class_balance(df).first()
    assert (r.n_negative, r.n_positive) == ((y == 0).sum(), (y == 1).sum())
    assert math.isclose(r.scale_pos_weight, (y == 0).sum() / (y == 1).sum())
