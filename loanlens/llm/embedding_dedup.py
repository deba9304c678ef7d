"""Embedding near-dedup: int8 quantised tile products with rigorous per-vector error bounds.

A unit vector x is s q + e with q int8, s its scale and |e| = d known exactly.  For two of them

    x . y  <=  s t (q . r)  +  |s q| d_y  +  |t r| d_x  +  d_x d_y

so pairs whose right side is below the threshold are out for certain; only the others are worked out
again in double precision.  q . r is exact: int8 values in float32 matrix products stay below 2^24
for up to 1,024 components (longer vectors use float64)."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from loanlens.llm.common import Scratch, python_stage, table
from loanlens.llm.components import components

TILE = 2048  # vectors on one side of a matrix product
GROUP = 8192  # vectors on one side of a task, at most
SLACK = 1e-6  # covers rounding in the bounds themselves


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(int8 values, scale, length of scale * values, length of the error) of unit vectors ``x``."""
    scale = np.maximum(np.abs(x).max(1), 1e-300) / 127
    q = np.rint(x / scale[:, None]).astype(np.int8)
    near = q * scale[:, None]
    return q, scale, np.linalg.norm(near, axis=1), np.linalg.norm(x - near, axis=1)


def spanning(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest index that each of ``n`` nodes reaches by the pairs (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while not (new == new[new]).all():
            new = new[new]
        if (new == label).all():
            return label
        label = new


def tile_links(x: np.ndarray, y: np.ndarray, threshold: float, same: bool):
    """Pairs (i, j) of rows of ``x`` and ``y`` with cosine >= threshold, tile by tile; with ``same`` only i < j."""
    qx, sx, ax, dx = quantise(x)
    qy, sy, ay, dy = (qx, sx, ax, dx) if same else quantise(y)
    exact = np.float32 if x.shape[1] <= 1024 else np.float64
    for i in range(0, len(x), TILE):
        fi = qx[i:i + TILE].astype(exact)
        for j in range(i if same else 0, len(y), TILE):
            dots = fi @ qy[j:j + TILE].astype(exact).T
            # by row, with the largest scale, length and error of the tile's columns: one comparison per pair
            top = sx[i:i + TILE] * sy[j:j + TILE].max()
            room = ax[i:i + TILE] * dy[j:j + TILE].max() + ay[j:j + TILE].max() * dx[i:i + TILE] + dx[i:i + TILE] * dy[j:j + TILE].max()
            floor = (threshold - room - SLACK) / top
            r, c = np.nonzero(dots >= floor[:, None].astype(exact))
            gr, gc = r + i, c + j
            bound = (sx[gr] * sy[gc] * dots[r, c] + ax[gr] * dy[gc] + ay[gc] * dx[gr] + dx[gr] * dy[gc] + SLACK)
            maybe = (bound >= threshold) & ((gr < gc) if same else True)
            gr, gc = gr[maybe], gc[maybe]
            for k in range(0, len(gr), 200_000):
                a, b = gr[k:k + 200_000], gc[k:k + 200_000]
                hit = np.einsum("ij,ij->i", x[a], y[b]) >= threshold
                yield a[hit], b[hit]


def embedding_dedup(vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id",
                    vector_col: str = "embedding") -> DataFrame:
    """Near-duplicate vectors by cosine >= threshold: (id, n_links, component_id, kept), one row per vector.

    All pairs are compared, in blocks of groups of rows: each task takes one pair of groups (at most
    GROUP vectors a side, so its memory is bounded whatever the groups hold) and returns one row per
    linked vector, with the links counted and the smallest linked partner within the task, never
    the pairs; so a group of copies of any size gives rows in proportion to its vectors.  Components
    join those rows over all tasks.

    Vectors that are null, empty, zero or hold null, NaN or infinite components link with nothing; vectors
    of different length never link.  Rows sharing an id are one vector (the smallest array counts); rows
    with a null id are returned as they are, with no links, a null component and kept.  Very small and
    very large components are scaled before squares are taken.  An empty table gives an empty result;
    other columns are not read."""
    spark = vectors.sparkSession
    python_stage(spark)
    scratch = Scratch(spark)
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"),
                          F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    known = rows.where("id is not null").groupBy("id").agg(F.min("v").alias("v"))
    fine = F.expr("v is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))"
                  " and exists(v, x -> x <> 0)")
    good = scratch.write(known.where(F.coalesce(fine, F.lit(False))), "vectors")
    n = good.count()
    tasks = 2 * spark.sparkContext.defaultParallelism
    groups = max(1, math.ceil(n / GROUP), min(math.ceil(math.sqrt(2 * tasks)), math.ceil(n / 512)))
    group = F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int")
    # group g meets every group once: with itself, and as the lower or the higher of a pair
    paired = (good.withColumn("g", group).withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
              .select(F.least("g", "o").alias("g1"), F.greatest("g", "o").alias("g2"), "g", "id", "v"))

    def run(key, t):
        g1, g2 = (k.as_py() for k in key)
        ids, side = t.column("id").to_numpy(), t.column("g").to_numpy()
        v = t.column("v").combine_chunks()
        size = np.diff(v.offsets.to_numpy())
        flat, at = v.flatten().to_numpy(), np.concatenate([[0], np.cumsum(size)])[:-1]
        label, count = np.arange(len(ids)), np.zeros(len(ids), np.int64)
        for width in np.unique(size):
            index = np.flatnonzero(size == width)
            index = index[np.argsort(ids[index])]
            x = flat[at[index][:, None] + np.arange(width)]
            x = x / np.abs(x).max(1, keepdims=True)
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
            left = side[index] == g1
            l, r = index[left], index[left] if g1 == g2 else index[~left]
            xl, xr = x[left], x[left] if g1 == g2 else x[~left]
            if not len(l) or not len(r):
                continue
            for a, b in tile_links(xl, xr, threshold, g1 == g2):
                a, b = l[a], r[b]
                count += np.bincount(a, minlength=len(ids)) + np.bincount(b, minlength=len(ids))
                # labels go on from what earlier tiles have joined
                label = spanning(np.concatenate([a, np.arange(len(ids))]), np.concatenate([b, label]), len(ids))
        has = np.flatnonzero(count)
        return pa.table({"id": ids[has], "n": count[has], "to": ids[label[has]]})

    found = scratch.write(paired.groupBy("g1", "g2").applyInArrow(run, "id long, n long, to long"), "links")
    comp = components(found.select(F.col("id").alias("a"), F.col("to").alias("b")), scratch)
    links = found.groupBy("id").agg(F.sum("n").alias("n_links"))
    ids = rows.select("id").where("id is not null").distinct()
    out = (ids.join(links, "id", "left").join(comp.withColumnRenamed("node", "id"), "id", "left")
           .select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                   F.coalesce("component", "id").alias("component_id"),
                   (F.coalesce("component", "id") == F.col("id")).alias("kept")))
    none = rows.where("id is null").select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"),
                                           F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept"))
    return out.union(none)


def op2(spark, sf_dir: str) -> DataFrame:
    return embedding_dedup(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


OP2_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.9
), reach AS (
  SELECT vec_id, vec_id AS other FROM embeddings
  UNION
  SELECT r.vec_id, l.b FROM reach r JOIN links l ON r.other = l.a
)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, c.c AS component_id, c.c = e.vec_id AS kept
FROM (SELECT DISTINCT vec_id FROM embeddings) e
JOIN (SELECT vec_id, min(other) AS c FROM reach GROUP BY vec_id) c USING (vec_id)
LEFT JOIN (SELECT a AS vec_id, count(DISTINCT b) AS n FROM links GROUP BY a) n USING (vec_id)
"""
