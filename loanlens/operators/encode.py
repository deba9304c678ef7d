"""Label encoding of categorical columns.

Codes are 0..n-1 in sorted label order (binary/code-point order) after
replacing NULL by 'Unknown'.  The fitted state is a category table
``(column, label, code)`` with one row per distinct label; it is applied by an
equi-join on the label, so it may be of any size and the planner broadcasts it
when it is measured to be small."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanlens import schemas as S
from loanlens.session import materialize

CATEGORY_SCHEMA = T.StructType([
    T.StructField("column", T.StringType(), False),
    T.StructField("label", T.StringType(), False),
    T.StructField("code", T.IntegerType(), False),
])


def _label(c):
    return F.coalesce(c.cast("string"), F.lit(S.UNKNOWN_LABEL))


def _coded(labels: DataFrame) -> DataFrame:
    """Distinct (column, label) rows with their codes."""
    order = Window.partitionBy("column").orderBy("label")
    return labels.select("column", "label", (F.row_number().over(order) - 1).cast("int").alias("code"))


class LabelEncoderModel:
    """``categories``: a category table, or ``{column: labels}`` for a few known labels."""

    def __init__(self, categories: DataFrame | dict[str, list[str]], columns=None):
        if isinstance(categories, dict):
            self._rows = [(c, lab, i) for c, labels in categories.items() for i, lab in enumerate(sorted(labels))]
            self._table = None
            self.columns = list(columns or categories)
        else:
            self._rows, self._table = None, categories
            self.columns = list(columns or [r["column"] for r in categories.select("column").distinct().collect()])
        self._fallbacks: dict[str, int] = {}

    # -- persistence (A8) -------------------------------------------------
    def table(self, spark: SparkSession) -> DataFrame:
        return self._table if self._table is not None else spark.createDataFrame(self._rows, CATEGORY_SCHEMA)

    def save(self, spark: SparkSession, path: str) -> None:
        self.table(spark).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "LabelEncoderModel":
        return cls(spark.read.parquet(path))

    # -- application ------------------------------------------------------
    def fallback(self, spark: SparkSession, column: str) -> int:
        """Code of an unseen label: that of 'Unknown' when it was fitted, else 0."""
        if column not in self._fallbacks:
            row = self.table(spark).where((F.col("column") == column) & (F.col("label") == S.UNKNOWN_LABEL)).first()
            self._fallbacks[column] = row["code"] if row else 0
        return self._fallbacks[column]

    def with_codes(self, df: DataFrame, targets: dict[str, tuple[str, str]], unseen: str = "fallback") -> DataFrame:
        """Add or replace columns ``{out: (fitted column, value column)}`` by codes.

        ``unseen='fallback'``: an unseen label maps to 'Unknown' when that label
        was fitted, else to the first label (code 0); ``'null'``: to NULL.  A
        column that was not fitted maps to 0."""
        spark = df.sparkSession
        for out, (fitted, value) in targets.items():
            if fitted not in self.columns:
                df = df.withColumn(out, F.lit(0))
                continue
            codes = (self.table(spark).where(F.col("column") == fitted)
                     .select(F.col("label").alias("_label"), F.col("code").alias("_code")))
            df = df.withColumn("_value", _label(F.col(value)))
            df = df.join(codes, F.col("_value") == F.col("_label"), "left")
            code = F.col("_code")
            if unseen == "fallback":
                code = F.coalesce(code, F.lit(self.fallback(spark, fitted)))
            df = df.withColumn(out, code.cast("int")).drop("_value", "_label", "_code")
        return df

    def transform(self, df: DataFrame, unseen: str = "null", columns=None) -> DataFrame:
        cols = columns or [c for c in self.columns if c in df.columns]
        return self.with_codes(df, {c: (c, c) for c in cols}, unseen)


def fit_label_encoder(df: DataFrame, columns=tuple(S.CATEGORICAL)) -> LabelEncoderModel:
    """Distinct labels of each column (one distributed aggregation), coded and
    materialised as a table; nothing is collected."""
    labelled = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), _label(F.col(c)).alias("label")) for c in columns])).alias("x"))
    return LabelEncoderModel(materialize(_coded(labelled.select("x.column", "x.label").distinct())), columns)
