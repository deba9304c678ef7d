"""Exact-size samples, stratified splits and stratified k-fold assignment,
reproducible from a seed and independent of partitioning (task retries and
different cluster sizes give the same rows)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanlens.operators.rank import hash_rank


def sample_n(df: DataFrame, n: int, key: str = "SK_ID_CURR", seed: int = 42) -> DataFrame:
    """``n`` rows (all when fewer), chosen by a seeded hash order of ``key``."""
    return hash_rank(df, key, seed=seed, rank_col="sample_rank", at_most=n)


def stratified_split(df: DataFrame, test_fraction: float, label: str = "TARGET",
                     key: str = "SK_ID_CURR", seed: int = 42) -> DataFrame:
    """Add ``is_validation``: per class, the first ``round(p * n_class)`` rows of
    the hash order."""
    r = hash_rank(df, key, [label], seed=seed, rank_col="_r", with_size=True)
    cut = F.round(F.col("_r_n") * F.lit(float(test_fraction)))
    return r.withColumn("is_validation", F.col("_r") <= cut).drop("_r", "_r_n")


def stratified_kfold(df: DataFrame, k: int, label: str = "TARGET", key: str = "SK_ID_CURR",
                     seed: int = 42) -> DataFrame:
    """Add ``fold`` in 0..k-1: per class, hash-order rank modulo ``k``, so fold
    sizes differ by at most one within every class."""
    r = hash_rank(df, key, [label], seed=seed, rank_col="_r")
    return r.withColumn("fold", ((F.col("_r") - 1) % k).cast("int")).drop("_r")
