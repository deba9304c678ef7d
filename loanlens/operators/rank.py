"""Global order without a single-partition window.

``Window.orderBy`` with no partition puts every row in one task.  The two
helpers here reach the same exact result with bounded tasks:

* ``running_totals`` -- cumulative sums along a value order.  Rows are range
  partitioned (Spark samples the edges and finds each row's range by binary
  search), into as many ranges as the row count asks for; per-range totals
  give each range its offset, and the exact window runs inside each range.
* ``hash_rank`` -- a reproducible random order (md5 of key and seed) with an
  exact rank, the ranges being hash prefixes (uniform by construction).

Equal order values always fall into the same range, so ties are handled
exactly.  Callers collapse duplicate values first (``groupBy(value)``), which
also removes the skew of a value that holds a third of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loanlens.session import materialize

# Rows that one exact window holds, about: the number of ranges follows from the row count,
# so every task stays this small at any size.
RANGE_ROWS = 200_000


def _ensure_key(df: DataFrame, partition_cols: Sequence[str]):
    if partition_cols:
        return df, list(partition_cols)
    return df.withColumn("_part", F.lit(0)), ["_part"]


def _ranges(df: DataFrame, buckets: int | None) -> int:
    """How many ranges ``df`` is cut into (one counting job unless given)."""
    return buckets if buckets is not None else max(1, -(-df.count() // RANGE_ROWS))


def null_safe_join(df: DataFrame, other: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` where NULL equals NULL; the keys of ``df`` are kept."""
    right = other.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    cond = F.lit(True)
    for k in keys:
        cond = cond & df[k].eqNullSafe(right[f"_right_{k}"])
    return df.join(right, cond, how).drop(*[f"_right_{k}" for k in keys])


def running_totals(df: DataFrame, order_col: str, sum_cols: Sequence[str],
                   partition_cols: Sequence[str] = (), descending: bool = False,
                   buckets: int | None = None, prefix: str = "cum_") -> DataFrame:
    """Add ``cum_<c>`` = sum of ``c`` over all rows of the same partition whose
    order value comes before or equals this row's (in the given direction;
    NULL order values come first, and a NULL partition value is a partition).

    Exact for every type that orders: the order value itself is compared, and
    equal ones share a range; only the edges of the ranges are sampled.  The
    ranged rows are checkpointed, so every later step, and every retried task, sees
    the same ranges.  A row costs the binary search, whatever the number of
    ranges; the unpartitioned pieces are tables of at most one row per range and
    partition that meets in it."""
    df, parts = _ensure_key(df, partition_cols)
    o = F.col(order_col)
    direction = o.desc_nulls_first() if descending else o.asc_nulls_first()
    n = _ranges(df, buckets)
    offsets = {}
    bucket: list[str] = []
    if n > 1:
        ranged = df.repartitionByRange(n, *[F.col(p).asc_nulls_first() for p in parts], direction)
        df = materialize(ranged.withColumn("_bkt", F.spark_partition_id()))
        bucket = ["_bkt"]
        totals = df.groupBy(*parts, "_bkt").agg(*[F.sum(c).alias(f"_t_{c}") for c in sum_cols])
        earlier = Window.partitionBy(*parts).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
        found = totals.select(*parts, "_bkt", *[
            F.coalesce(F.sum(f"_t_{c}").over(earlier), F.lit(0)).alias(f"_o_{c}") for c in sum_cols])
        df = null_safe_join(df, found, [*parts, "_bkt"])
        offsets = {c: F.col(f"_o_{c}") for c in sum_cols}
    inside = Window.partitionBy(*parts, *bucket).orderBy(direction).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    out = df.withColumns({f"{prefix}{c}": F.sum(c).over(inside) + offsets.get(c, F.lit(0)) for c in sum_cols})
    return out.drop(*bucket, *[f"_o_{c}" for c in sum_cols], *([] if partition_cols else ["_part"]))


def hash_key(key: str | Column, seed: int = 42) -> Column:
    """md5 hex of ``"<key>-<seed>"`` -- the same text in any SQL engine."""
    k = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(k.cast("string"), F.lit(f"-{seed}")))


def hash_rank(df: DataFrame, key: str, partition_cols: Sequence[str] = (), seed: int = 42,
              rank_col: str = "rank", with_size: bool = False, at_most: int | None = None,
              buckets: int | None = None) -> DataFrame:
    """Exact 1-based rank by ``(md5(key-seed), key)`` within each partition.  A
    NULL partition value is a partition; rows with a NULL key come first.

    With ``with_size`` the partition's row count is added as ``<rank_col>_n``.
    With ``at_most`` only ranks up to it are returned, and hash ranges that lie
    wholly beyond it are left out before the rows are shuffled."""
    df, parts = _ensure_key(df, partition_cols)
    n = _ranges(df, buckets)
    df = df.withColumn("_h", hash_key(key, seed))
    # the first eight hex digits cut the hash space into n equal ranges
    share = F.conv(F.substring("_h", 1, 8), 16, 10).cast("long") * F.lit(n) / F.lit(float(1 << 32))
    df = df.withColumn("_bkt", F.coalesce(F.floor(share).cast("int"), F.lit(-1)))
    counts = df.groupBy(*parts, "_bkt").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*parts).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*parts, "_bkt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"),
                            F.sum("_n").over(Window.partitionBy(*parts)).alias("_size"))
    if at_most is not None:
        offsets = offsets.where(F.col("_off") < at_most)
    df = null_safe_join(df, offsets, [*parts, "_bkt"])
    inside = Window.partitionBy(*parts, "_bkt").orderBy("_h", key)
    out = df.withColumn(rank_col, (F.col("_off") + F.row_number().over(inside)).cast("long"))
    if with_size:
        out = out.withColumn(f"{rank_col}_n", F.col("_size").cast("long"))
    if at_most is not None:
        out = out.where(F.col(rank_col) <= at_most)
    return out.drop("_h", "_bkt", "_off", "_size", *([] if partition_cols else ["_part"]))


def exact_quantiles(df: DataFrame, value_col: str, probs: Sequence[float],
                    partition_cols: Sequence[str] = (), weight_col: str | None = None,
                    out: str = "q") -> DataFrame:
    """Linear-interpolation quantiles (as pandas / ``quantile_cont``) of the
    non-null ``value_col`` per partition, exact at any size.

    Values are collapsed to (value, weight), ranked with ``running_totals`` and
    each distinct value checks which of the 2 x len(probs) target positions it
    covers -- no group's values are ever held by one task.  Returns one row per
    partition with ``out`` = array of quantiles in ``probs`` order."""
    df, parts = _ensure_key(df, partition_cols)
    w = F.col(weight_col) if weight_col else F.lit(1)
    vc = (df.where(F.col(value_col).isNotNull()).groupBy(*parts, F.col(value_col).alias("_v"))
            .agg(F.sum(w).alias("_w")).where(F.col("_w") > 0))
    if not partition_cols:
        # read for the total, the ranges and the running sums: materialise once
        vc = materialize(vc)
    cum = running_totals(vc, "_v", ["_w"], partition_cols=parts)
    if partition_cols:
        cum = null_safe_join(cum, vc.groupBy(*parts).agg(F.sum("_w").alias("_n")), parts)
    else:
        cum = cum.withColumn("_n", F.lit(vc.agg(F.sum("_w")).first()[0] or 0))
    res = quantiles_from_cumulative(cum, "_v", "_w", "cum__w", "_n", probs, parts, out)
    return res if partition_cols else res.drop("_part")


def quantiles_from_cumulative(cum: DataFrame, value_col: str, weight_col: str, cum_col: str, n_col: str,
                              probs: Sequence[float], partition_cols: Sequence[str], out: str = "q") -> DataFrame:
    """Quantiles from a table of distinct values with their weight, inclusive
    running weight and the partition total (as made by ``running_totals``)."""
    parts = list(partition_cols)
    cum = cum.where(F.col(weight_col) > 0)
    last = (F.col(n_col) - F.lit(1)).cast("double")
    targets = F.array(*[F.struct(F.lit(i).alias("qi"), (last * F.lit(float(q))).alias("h"),
                                 F.floor(last * F.lit(float(q))).alias("lo"),
                                 F.ceil(last * F.lit(float(q))).alias("hi")) for i, q in enumerate(probs)])
    start, end = F.col(cum_col) - F.col(weight_col), F.col(cum_col)

    def covers(pos):
        return (pos >= start) & (pos < end)

    hits = cum.select(*parts, F.col(value_col).alias("_v"), start.alias("_s"), end.alias("_e"), F.explode(F.filter(
        targets, lambda t: covers(t["lo"]) | covers(t["hi"]))).alias("t"))
    inside = lambda pos: (pos >= F.col("_s")) & (pos < F.col("_e"))
    per_q = hits.groupBy(*parts, F.col("t.qi").alias("qi")).agg(
        F.max(F.when(inside(F.col("t.lo")), F.col("_v"))).alias("_xlo"),
        F.max(F.when(inside(F.col("t.hi")), F.col("_v"))).alias("_xhi"),
        F.first("t.h").alias("_h"), F.first("t.lo").alias("_lo"))
    val = F.col("_xlo") + (F.col("_h") - F.col("_lo")) * (F.col("_xhi") - F.col("_xlo"))
    packed = per_q.groupBy(*parts).agg(F.array_sort(F.collect_list(F.struct("qi", val.alias("v")))).alias("_qs"))
    return packed.select(*parts, F.transform("_qs", lambda s: s["v"]).alias(out))
