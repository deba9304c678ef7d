"""Column-expression helpers.  Every function returns a ``Column`` built from
``pyspark.sql.functions`` so it stays inside whole-stage codegen."""

from loanlens.functions.exprs import *  # noqa: F401,F403
from loanlens.functions.stats import *  # noqa: F401,F403
