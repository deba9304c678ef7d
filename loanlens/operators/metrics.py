"""Binary-classifier evaluation as aggregations.

Every metric starts from one reduction of the scored rows -- a confusion
aggregate or a per-distinct-score count table -- so the heavy work is a
map-side combined ``groupBy``; curves use ``rank.running_totals`` instead of a
global window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanlens.operators.rank import running_totals
from loanlens.session import materialize

LOG_LOSS_EPS = 1e-15


def predict_label(df: DataFrame, prob_col: str = "probability", threshold: float = 0.5,
                  out: str = "prediction") -> DataFrame:
    """1 when the probability reaches the threshold."""
    return df.withColumn(out, (F.col(prob_col) >= F.lit(threshold)).cast("int"))


def class_balance(df: DataFrame, label: str = "TARGET") -> DataFrame:
    """class counts and the positive-class weight n_neg / n_pos."""
    agg = df.agg(F.count_if(F.col(label) == 0).alias("n_negative"),
                 F.count_if(F.col(label) == 1).alias("n_positive"))
    return agg.withColumn("scale_pos_weight",
                          F.try_divide(F.col("n_negative").cast("double"), F.col("n_positive").cast("double")))


def confusion(df: DataFrame, label: str = "TARGET", prob_col: str = "probability",
              threshold: float = 0.5) -> DataFrame:
    """tp, fp, tn, fn in one aggregate."""
    y, p = F.col(label), F.col(prob_col) >= F.lit(threshold)
    return df.agg(F.count_if((y == 1) & p).alias("tp"), F.count_if((y == 0) & p).alias("fp"),
                  F.count_if((y == 0) & ~p).alias("tn"), F.count_if((y == 1) & ~p).alias("fn"))


def f1_score(conf: DataFrame) -> DataFrame:
    """F1 of the positive class; 0 when undefined."""
    num = F.lit(2.0) * F.col("tp")
    den = F.lit(2.0) * F.col("tp") + F.col("fp") + F.col("fn")
    return conf.select(F.when(den > 0, num / den).otherwise(F.lit(0.0)).alias("f1"))


def _ratio(a, b):
    return F.when(b > 0, a.cast("double") / b.cast("double")).otherwise(F.lit(0.0))


def classification_report(conf: DataFrame) -> DataFrame:
    """Precision, recall, f1, support per class, accuracy, macro and
    weighted averages (0 where a denominator is 0)."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    total = tp + fp + tn + fn
    per = {
        "1": (_ratio(tp, tp + fp), _ratio(tp, tp + fn), tp + fn),
        "0": (_ratio(tn, tn + fn), _ratio(tn, tn + fp), tn + fp),
    }

    def f1(p, r):
        return F.when(p + r > 0, F.lit(2.0) * p * r / (p + r)).otherwise(F.lit(0.0))

    rows = []
    for cls in ("0", "1"):
        p, r, s = per[cls]
        rows.append(F.struct(F.lit(cls).alias("class"), p.alias("precision"), r.alias("recall"),
                             f1(p, r).alias("f1_score"), s.cast("long").alias("support")))
    acc = _ratio(tp + tn, total)
    rows.append(F.struct(F.lit("accuracy").alias("class"), F.lit(None).cast("double").alias("precision"),
                         F.lit(None).cast("double").alias("recall"), acc.alias("f1_score"),
                         total.cast("long").alias("support")))
    (p0, r0, s0), (p1, r1, s1) = per["0"], per["1"]
    rows.append(F.struct(F.lit("macro avg").alias("class"), ((p0 + p1) / 2).alias("precision"),
                         ((r0 + r1) / 2).alias("recall"), ((f1(p0, r0) + f1(p1, r1)) / 2).alias("f1_score"),
                         total.cast("long").alias("support")))

    def wavg(a, b):
        return _ratio(a * s0 + b * s1, total)

    rows.append(F.struct(F.lit("weighted avg").alias("class"), wavg(p0, p1).alias("precision"),
                         wavg(r0, r1).alias("recall"), wavg(f1(p0, r0), f1(p1, r1)).alias("f1_score"),
                         total.cast("long").alias("support")))
    return conf.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def score_counts(df: DataFrame, label: str = "TARGET", prob_col: str = "probability") -> DataFrame:
    """Positives and negatives per distinct score (ties collapse here)."""
    return (df.where(F.col(prob_col).isNotNull() & F.col(label).isNotNull())
              .groupBy(F.col(prob_col).alias("threshold"))
              .agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")))


def curve_points(df: DataFrame, label: str = "TARGET", prob_col: str = "probability") -> DataFrame:
    """Per distinct threshold (highest first) cumulative tp/fp and the
    class totals, plus the previous point's values for trapezoids."""
    # the per-score table is read three times (totals, range edges, running
    # sums): materialise the reduced table once
    sc = materialize(score_counts(df, label, prob_col))
    tot = sc.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N")).first()  # one row of class totals
    cum = running_totals(sc, "threshold", ["pos", "neg"], descending=True)
    cum = cum.withColumns({"P": F.lit(tot["P"] or 0).cast("long"), "N": F.lit(tot["N"] or 0).cast("long")})
    return cum.select("threshold", F.col("cum_pos").alias("tp"), F.col("cum_neg").alias("fp"),
                      (F.col("cum_pos") - F.col("pos")).alias("tp_prev"),
                      (F.col("cum_neg") - F.col("neg")).alias("fp_prev"), "P", "N")


def roc_curve(df: DataFrame, label: str = "TARGET", prob_col: str = "probability") -> DataFrame:
    """(threshold, fpr, tpr) for every distinct score, plus the (0, 0) start."""
    pts = curve_points(df, label, prob_col)
    body = pts.select("threshold", _ratio(F.col("fp"), F.col("N")).alias("fpr"),
                      _ratio(F.col("tp"), F.col("P")).alias("tpr"))
    start = pts.agg(F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return body.unionByName(start)


def roc_auc(df: DataFrame, label: str = "TARGET", prob_col: str = "probability") -> DataFrame:
    """Trapezoidal area under the ROC curve (exact with ties); NULL for a
    single-class input."""
    pts = curve_points(df, label, prob_col)
    area = (F.col("fp") - F.col("fp_prev")).cast("double") * (F.col("tp") + F.col("tp_prev")).cast("double") / F.lit(2.0)
    agg = pts.agg(F.sum(area).alias("_a"), F.max("P").alias("P"), F.max("N").alias("N"))
    auc = F.when((F.col("P") > 0) & (F.col("N") > 0), F.col("_a") / (F.col("P").cast("double") * F.col("N")))
    return agg.select(auc.alias("roc_auc"))


def pr_auc(df: DataFrame, label: str = "TARGET", prob_col: str = "probability") -> DataFrame:
    """Trapezoidal area under precision-recall, starting at (recall 0,
    precision 1); NULL without positives."""
    pts = curve_points(df, label, prob_col)
    prec = F.col("tp").cast("double") / (F.col("tp") + F.col("fp"))
    prev_den = F.col("tp_prev") + F.col("fp_prev")
    prec_prev = F.when(prev_den > 0, F.col("tp_prev").cast("double") / prev_den).otherwise(F.lit(1.0))
    area = (F.col("tp") - F.col("tp_prev")).cast("double") * (prec + prec_prev) / F.lit(2.0)
    agg = pts.agg(F.sum(area).alias("_a"), F.max("P").alias("P"))
    return agg.select(F.when(F.col("P") > 0, F.col("_a") / F.col("P")).alias("pr_auc"))


def log_loss(df: DataFrame, label: str = "TARGET", prob_col: str = "probability", by=()) -> DataFrame:
    """Mean binary cross-entropy with p clipped to [1e-15, 1 - 1e-15]."""
    p = F.greatest(F.lit(LOG_LOSS_EPS), F.least(F.lit(1 - LOG_LOSS_EPS), F.col(prob_col)))
    y = F.col(label).cast("double")
    ll = -(y * F.log(p) + (F.lit(1.0) - y) * F.log(F.lit(1.0) - p))
    return df.groupBy(*by).agg(F.avg(ll).alias("log_loss"), F.count(F.lit(1)).alias("n"))
