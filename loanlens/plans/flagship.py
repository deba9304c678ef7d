"""The minimum end-to-end slice: the loan book graded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanlens.operators.decision import classify
from loanlens.plans import book


def grade_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applicants per risk grade with mean probability and score range."""
    scored = classify(book.scored_book(spark, sf_dir.rstrip("/")), prob_col="probability")
    return (scored.groupBy("risk_grade", "recommended_action")
                  .agg(F.count(F.lit(1)).alias("applicants"),
                       F.round(F.avg("probability"), 9).alias("avg_probability"),
                       F.min("credit_score").alias("min_score"),
                       F.max("credit_score").alias("max_score")))
