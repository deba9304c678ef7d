"""loanlens: credit-risk analytics as Spark DataFrame-in / DataFrame-out functions.

Subpackages
-----------
sources    -- scans, optional tables, derived loan tables, log/reference writers
functions  -- column-expression helpers (ratios, row statistics, decisions, p-values)
operators  -- DataFrame operators (features, encoding, validation, ranking, metrics,
              drift, attribution, monitoring, EDA, model training)
plans      -- end-to-end plans composed from the operators (book scoring, reports)
streaming  -- Structured Streaming versions of the scoring and monitoring plans
"""

from loanlens.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
