"""Helpers shared by the operators: tables, scratch tables in the shared folder,
bounded Arrow batches, and batches of texts of bounded size."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from loanlens.session import checkpoint_dir, ship_package

# Rows per Arrow batch sent to Python: texts are a few KB, and the longest known are ~100 KB,
# so a batch stays at a few tens of MB at most.
ARROW_ROWS = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def python_stage(spark: SparkSession) -> None:
    """What every stage that runs Python on executors needs: the package there, and bounded batches."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


class Scratch:
    """Intermediate tables written to the folder all executors share (``spark.checkpoint.dir``).

    A written table cuts the lineage, survives lost executors, and is read back with
    column pruning.  ``drop`` removes a table that no later step reads."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{checkpoint_dir(spark).rstrip('/')}/tables-{uuid.uuid4().hex}"
        self.n = 0

    def write(self, df: DataFrame, name: str) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n:03d}-{name}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(df._scratch_path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def text_groups(texts, most: int = 2_000_000):
    """Indices of consecutive ``texts`` in groups of at most ``most`` characters (one longer text is a group of its own)."""
    group, size = [], 0
    for i, t in enumerate(texts):
        if group and size + len(t) > most:
            yield group
            group, size = [], 0
        group.append(i)
        size += len(t)
    if group:
        yield group
