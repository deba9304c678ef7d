"""Decisioning: probability -> score, grade, action, colour, description."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanlens.functions.exprs import (clamp_probability, credit_score, grade_attribute,
                                      recommended_action, risk_grade)


def classify(df: DataFrame, prob_col: str = "default_probability", details: bool = False) -> DataFrame:
    """Add clamped probability, credit score, grade and action (and colour and
    description with ``details``).  NULL/NaN probabilities give NULL decisions."""
    p = F.col(prob_col)
    cols = {
        "clamped_probability": clamp_probability(p),
        "credit_score": credit_score(p),
        "risk_grade": risk_grade(p),
        "recommended_action": recommended_action(p),
    }
    if details:
        cols["risk_color"] = grade_attribute(p, "color")
        cols["action_description"] = grade_attribute(p, "description")
    return df.withColumns(cols)


def prediction_id(*key_cols, model_version: str = "v1") -> "F.Column":
    """Deterministic prediction id: 'pred_' + 16 hex digits of
    sha256(key, model version) -- identical when a task is retried."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key_cols] + [F.lit(model_version)]
    return F.concat(F.lit("pred_"), F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16))
