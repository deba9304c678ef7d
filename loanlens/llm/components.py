"""Connected components of a table of links, as Spark jobs (alternating large and small stars)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from loanlens.llm.common import Scratch


def components(links: DataFrame, scratch: Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): every node of ``links`` with the smallest id it reaches, as a written table.

    Each round joins every node to the smallest neighbour it knows; groups shrink to stars in a number of
    rounds logarithmic in the diameter.  A hub with many links is one pre-aggregated row per task in the
    group by, and the join against one row per node is split by AQE.  Loops and repeated links are
    harmless, null ends are left out, and an empty table gives an empty result."""
    edges = scratch.write(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
                          .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v"))).distinct(), "edges")
    state = None
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(low.select("u", F.col("m").alias("v"))).distinct())
        new = scratch.write(small, "edges")
        now = new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        scratch.drop(edges)
        edges = new
        if now == state:
            break
        state = now
    return scratch.write(edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
                         .union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()), "components")
