"""Corpus pipeline: documents -> without toxic ones -> without shared lines -> one of each near-duplicate
group -> packed sequences.  Each stage works on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loanlens.llm import toxicity
from loanlens.llm.common import Scratch, table
from loanlens.llm.line_dedup import line_dedup
from loanlens.llm.near_dedup import near_dedup
from loanlens.llm.packing import best_fit_packing


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled rows that are not held out, does not reject."""
    model = toxicity.fit(*toxicity.training_sample(docs, table(spark, sf_dir, "labels")))
    return toxicity.score(docs, model, carry=docs.columns).where("predicted = 0").select("row.*")


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that a document with a smaller id holds too; ``n_chars`` follows the text.  A document
    that has lost all its lines goes: others hold every one of them.  Texts that were empty before stay."""
    out = line_dedup(docs).where("n_dropped = 0 or n_lines > n_dropped")
    changed = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return out.select(*[changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group linked by five-word shingles at 0.8 or more.

    A document is its id and text: two texts under one id are judged each by its own, and rows equal in both are one."""
    keyed = docs.withColumn("_key", F.xxhash64("doc_id", "text")).dropDuplicates(["_key"])
    groups = near_dedup(keyed, k=5, percent=80, id_col="_key").select("_key", "component_id")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "_key")
    first = (keyed.select("doc_id", "_key").join(groups, "_key").groupBy("component_id")
             .agg(F.min(order)["_key"].alias("_key")).select("_key"))
    return keyed.join(first, "_key", "left_semi").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all documents in sequences of at most 1,024 tokens."""
    import public_tokenizers
    return best_fit_packing(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_shared_lines), ("near_dedup", drop_near_duplicates),
          ("packing", pack)]

#: A classifier and a packing search are not SQL; tests/llm compares each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table; each is written and read again for the next."""
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
