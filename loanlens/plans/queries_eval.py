"""Registered queries: class balance, seeded samples and splits, and the
evaluation metrics of the fixed leaf-table ensemble on the whole book."""

from __future__ import annotations

from pyspark.sql import functions as F

from loanlens.operators import metrics as MT
from loanlens.operators.sampling import sample_n, stratified_kfold, stratified_split
from loanlens.plans import book
from loanlens.plans import oracle_sql as O
from loanlens.plans.catalog import query
from loanlens.sources import derived

SAMPLE_N = 1000          # rows drawn by ``sample_n`` (the operator's size parameter)
TEST_FRACTION = 0.2      # validation share of the stratified split
K_FOLDS = 5
THRESHOLD = 0.5


def _hash_sql(key: str) -> str:
    return f"md5(CAST({key} AS VARCHAR) || '-42')"


def scored(spark, sf):
    """SK_ID_CURR, TARGET, probability (rounded to 12 places so that both
    engines see the same ties)."""
    s = book.scored_book(spark, sf)
    return s.select("SK_ID_CURR", "TARGET", F.round("probability", 12).alias("probability"))


@query("class_balance", O.with_ctes() + """SELECT count_if(TARGET = 0) AS n_negative, count_if(TARGET = 1) AS n_positive,
  CAST(count_if(TARGET = 0) AS DOUBLE) / nullif(count_if(TARGET = 1), 0) AS scale_pos_weight FROM application""",
       doubles=["scale_pos_weight"])
def class_balance(spark, sf):
    """class counts and scale_pos_weight."""
    return MT.class_balance(derived.application(spark, sf))


@query("sample_n", O.with_ctes() + f"""SELECT SK_ID_CURR, sample_rank FROM (
  SELECT SK_ID_CURR, CAST(row_number() OVER (ORDER BY {_hash_sql('SK_ID_CURR')}, SK_ID_CURR) AS BIGINT) AS sample_rank
  FROM application) WHERE sample_rank <= {SAMPLE_N}""")
def sample_n_q(spark, sf):
    """H8: exact-size seeded sample of the application table."""
    return sample_n(derived.application(spark, sf), SAMPLE_N).select("SK_ID_CURR", "sample_rank")


@query("stratified_split", O.with_ctes() + f"""SELECT SK_ID_CURR, TARGET,
  r <= round(n * {TEST_FRACTION}e0) AS is_validation FROM (
  SELECT SK_ID_CURR, TARGET,
    row_number() OVER (PARTITION BY TARGET ORDER BY {_hash_sql('SK_ID_CURR')}, SK_ID_CURR) AS r,
    count(*) OVER (PARTITION BY TARGET) AS n
  FROM application)""")
def stratified_split_q(spark, sf):
    """H9: stratified validation split (20%)."""
    app = derived.application(spark, sf).select("SK_ID_CURR", "TARGET")
    return stratified_split(app, TEST_FRACTION)


@query("stratified_kfold", O.with_ctes() + f"""SELECT SK_ID_CURR, TARGET, CAST((r - 1) % {K_FOLDS} AS INTEGER) AS fold FROM (
  SELECT SK_ID_CURR, TARGET,
    row_number() OVER (PARTITION BY TARGET ORDER BY {_hash_sql('SK_ID_CURR')}, SK_ID_CURR) AS r
  FROM application)""")
def stratified_kfold_q(spark, sf):
    """Stratified shuffled k-fold assignment (k = 5)."""
    app = derived.application(spark, sf).select("SK_ID_CURR", "TARGET")
    return stratified_kfold(app, K_FOLDS)


_CONF = f"""SELECT count_if(TARGET = 1 AND probability >= {THRESHOLD}e0) AS tp,
  count_if(TARGET = 0 AND probability >= {THRESHOLD}e0) AS fp,
  count_if(TARGET = 0 AND probability < {THRESHOLD}e0) AS tn,
  count_if(TARGET = 1 AND probability < {THRESHOLD}e0) AS fn FROM scored"""


@query("confusion", O.scored_ctes() + _CONF)
def confusion_q(spark, sf):
    """Thresholded predictions as a confusion aggregate."""
    return MT.confusion(scored(spark, sf), threshold=THRESHOLD)


_POINTS = """
pts AS (
  SELECT probability AS threshold, count_if(TARGET = 1) AS pos, count_if(TARGET = 0) AS neg FROM scored
  GROUP BY probability
),
cum AS (
  SELECT threshold, pos, neg,
    sum(pos) OVER (ORDER BY threshold DESC) AS tp, sum(neg) OVER (ORDER BY threshold DESC) AS fp,
    sum(pos) OVER () AS P, sum(neg) OVER () AS N
  FROM pts
)"""


@query("roc_curve", O.scored_ctes(_POINTS) + """SELECT threshold,
  CASE WHEN N > 0 THEN fp / N ELSE 0e0 END AS fpr, CASE WHEN P > 0 THEN tp / P ELSE 0e0 END AS tpr FROM cum
UNION ALL SELECT CAST('inf' AS DOUBLE), 0e0, 0e0""", doubles=["fpr", "tpr"])
def roc_curve_q(spark, sf):
    """ROC points at every distinct threshold."""
    return MT.roc_curve(scored(spark, sf))


@query("roc_auc", O.scored_ctes(_POINTS) + """SELECT CASE WHEN max(P) > 0 AND max(N) > 0 THEN
  sum(CAST(neg AS DOUBLE) * (tp + tp - pos) / 2e0) / (CAST(max(P) AS DOUBLE) * max(N)) END AS roc_auc FROM cum""",
       doubles=["roc_auc"])
def roc_auc_q(spark, sf):
    """ROC-AUC (trapezoid, exact with ties)."""
    return MT.roc_auc(scored(spark, sf))


@query("pr_auc", O.scored_ctes(_POINTS) + """SELECT CASE WHEN max(P) > 0 THEN sum(
  CAST(pos AS DOUBLE) * (CAST(tp AS DOUBLE) / (tp + fp)
    + CASE WHEN tp - pos + fp - neg > 0 THEN CAST(tp - pos AS DOUBLE) / (tp - pos + fp - neg) ELSE 1e0 END) / 2e0
  ) / max(P) END AS pr_auc FROM cum""", doubles=["pr_auc"])
def pr_auc_q(spark, sf):
    """PR-AUC (trapezoid over recall from (0, 1))."""
    return MT.pr_auc(scored(spark, sf))


@query("f1_score", O.scored_ctes() + f"""SELECT CASE WHEN 2 * tp + fp + fn > 0 THEN 2e0 * tp / (2 * tp + fp + fn) ELSE 0e0 END AS f1
FROM ({_CONF}) c""", doubles=["f1"])
def f1_score_q(spark, sf):
    """F1 on the positive class."""
    return MT.f1_score(MT.confusion(scored(spark, sf), threshold=THRESHOLD))


@query("classification_report", O.scored_ctes() + f""", conf AS ({_CONF}),
per AS (
  SELECT CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE 0e0 END AS p1,
         CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) ELSE 0e0 END AS r1,
         CASE WHEN tn + fn > 0 THEN CAST(tn AS DOUBLE) / (tn + fn) ELSE 0e0 END AS p0,
         CASE WHEN tn + fp > 0 THEN CAST(tn AS DOUBLE) / (tn + fp) ELSE 0e0 END AS r0,
         tp + fn AS s1, tn + fp AS s0, tp + fp + tn + fn AS total, tp + tn AS correct FROM conf
),
f AS (
  SELECT *, CASE WHEN p0 + r0 > 0 THEN 2e0 * p0 * r0 / (p0 + r0) ELSE 0e0 END AS f0,
            CASE WHEN p1 + r1 > 0 THEN 2e0 * p1 * r1 / (p1 + r1) ELSE 0e0 END AS f1 FROM per
)
SELECT '0' AS class, p0 AS precision, r0 AS recall, f0 AS f1_score, CAST(s0 AS BIGINT) AS support FROM f
UNION ALL SELECT '1', p1, r1, f1, CAST(s1 AS BIGINT) FROM f
UNION ALL SELECT 'accuracy', NULL, NULL, CASE WHEN total > 0 THEN CAST(correct AS DOUBLE) / total ELSE 0e0 END, CAST(total AS BIGINT) FROM f
UNION ALL SELECT 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, CAST(total AS BIGINT) FROM f
UNION ALL SELECT 'weighted avg',
  CASE WHEN total > 0 THEN (p0 * s0 + p1 * s1) / total ELSE 0e0 END,
  CASE WHEN total > 0 THEN (r0 * s0 + r1 * s1) / total ELSE 0e0 END,
  CASE WHEN total > 0 THEN (f0 * s0 + f1 * s1) / total ELSE 0e0 END, CAST(total AS BIGINT) FROM f""",
       doubles=["precision", "recall", "f1_score"])
def classification_report_q(spark, sf):
    """Per-class and averaged precision, recall, f1, support."""
    return MT.classification_report(MT.confusion(scored(spark, sf), threshold=THRESHOLD))


@query("log_loss", O.scored_ctes() + f""", split AS (
  SELECT SK_ID_CURR, r <= round(n * {TEST_FRACTION}e0) AS is_validation FROM (
    SELECT SK_ID_CURR, row_number() OVER (PARTITION BY TARGET ORDER BY {_hash_sql('SK_ID_CURR')}, SK_ID_CURR) AS r,
      count(*) OVER (PARTITION BY TARGET) AS n FROM application))
SELECT x.is_validation, avg(-(TARGET * ln(greatest(1e-15, least(1e0 - 1e-15, probability)))
  + (1 - TARGET) * ln(1e0 - greatest(1e-15, least(1e0 - 1e-15, probability))))) AS log_loss, count(*) AS n
FROM scored s JOIN split x USING (SK_ID_CURR) GROUP BY x.is_validation""", doubles=["log_loss"])
def log_loss_q(spark, sf):
    """Log-loss on the training and validation sides of the split."""
    sc = scored(spark, sf)
    split = stratified_split(sc.select("SK_ID_CURR", "TARGET"), TEST_FRACTION).select("SK_ID_CURR", "is_validation")
    return MT.log_loss(sc.join(split, "SK_ID_CURR"), by=["is_validation"])
