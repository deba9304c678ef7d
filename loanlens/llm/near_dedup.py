"""MinHash near-dedup: SuperMinHash signatures, banding, verification on full shingle sets, components."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from loanlens.llm import superminhash as S
from loanlens.llm.common import Scratch, python_stage, table, text_groups
from loanlens.llm.components import components

# 48 bands of 7 of 256 places at 0.8: a pair at a likeness of 0.8 is missed with a chance of about 1e-5,
# one at 0.85 with 1e-8; equal sets always meet.  Lower likenesses have shorter bands (``settings``).
PLACES, BANDS, ROWS, MISSED = 256, 48, 7, 1.3e-5
# Pairs inside a bucket must also agree in the low four bits of enough of 2,048 places.  At a likeness of 0.8
# 1,664 agree on average with a deviation of at most 17.7, so 1,576 lets a pair slip with a chance below 1e-6.
FINE = 2048
ELEMENTS = 100_000  # shingles whose signatures are worked out at once


def settings(percent: int) -> tuple[int, int, int]:
    """(bands, rows, agreeing) for pairs that are ``percent`` alike: the longest bands, up to ROWS, by which such a pair
    is missed with a chance of MISSED at most, and the mean of agreeing places less five deviations.  Above 80 as at 80."""
    if not 5 <= percent <= 100:
        raise ValueError(f"percent must be 5 to 100, not {percent}")  # below, all places together miss too many
    p = min(percent, 80) / 100
    rows = max((r for r in range(1, ROWS + 1) if (1 - p ** r) ** BANDS <= MISSED), default=1)
    bands = max(BANDS, math.ceil(math.log(MISSED) / math.log(1 - p ** rows)))
    q = p + (1 - p) / 16  # places that differ have the same four bits one time in sixteen
    return bands, rows, math.ceil(FINE * q - 5 * math.sqrt(FINE * q * (1 - q)))


def _sketch(docs: DataFrame, k: int, bands_n: int, rows_n: int, id_col: str, text_col: str) -> DataFrame:
    """Per row: id, number of distinct shingles, a 128-bit hash of the set, and its band keys."""
    def run(batches):
        for b in batches:
            texts = b.column("text").to_pylist()
            size, one, two, keys = [], [], [], []
            for group in text_groups(texts):
                value, n = S.shingle_sets([texts[i] for i in group], k)
                at = np.concatenate([[0], np.cumsum(n)])
                size.append(n)
                for out, salt in ((one, 0x1234567), (two, 0x7654321)):
                    sums = np.concatenate([[S.U(0)], np.cumsum(S.mix(value + S.U(salt)))])
                    out.append(sums[at[1:]] - sums[at[:-1]])
                lo = 0
                while lo < len(n):
                    hi = max(lo + 1, int(np.searchsorted(at, at[lo] + ELEMENTS, "right")) - 1)
                    sig = S.signatures(value[at[lo]:at[hi]], n[lo:hi], PLACES)
                    keys.append(S.band_keys(sig, bands_n, rows_n))
                    lo = hi
            n, keys = np.concatenate(size), np.concatenate(keys)
            bands = pa.ListArray.from_arrays(pa.array(np.arange(0, bands_n * len(n) + 1, bands_n, dtype=np.int32)),
                                             pa.array(keys.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array(n.astype(np.int64)), pa.array(np.concatenate(one).view(np.int64)),
                 pa.array(np.concatenate(two).view(np.int64)), bands], ["id", "n", "s1", "s2", "bands"])

    return _rows(docs, id_col, text_col).mapInArrow(run, "id long, n long, s1 long, s2 long, bands array<long>")


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("id"),
                       F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))


def _fine(texts: DataFrame, k: int) -> DataFrame:
    """(id, fine): four bits of each of FINE signature places, for texts that share a bucket with others."""
    def run(batches):
        for b in batches:
            words = b.column("text").to_pylist()
            out = []
            for group in text_groups(words, 100_000):
                value, n = S.shingle_sets([words[i] for i in group], k)
                out.append(S.nibbles(S.signatures(value, n, FINE)))
            low = np.concatenate(out)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.ListArray.from_arrays(
                pa.array(np.arange(0, low.size + 1, FINE // 16, dtype=np.int32)), pa.array(low.reshape(-1).view(np.int64)))], ["id", "fine"])

    return texts.select("id", "text").mapInArrow(run, "id long, fine array<long>")


def _alike(texts_a: list[str], texts_b: list[str], k: int, percent: int) -> np.ndarray:
    """Which pairs of texts have 100 * common >= percent * union, on full shingle sets."""
    distinct = {t: i for i, t in enumerate(dict.fromkeys([*texts_a, *texts_b]))}
    every, sets = list(distinct), []
    for group in text_groups(every):
        value, n = S.shingle_sets([every[i] for i in group], k)
        sets.extend(np.split(value, np.cumsum(n)[:-1]))
    out = np.zeros(len(texts_a), bool)
    for i, (a, b) in enumerate(zip(texts_a, texts_b)):
        x, y = sets[distinct[a]], sets[distinct[b]]
        if len(x) > len(y):
            x, y = y, x
        at = np.searchsorted(y, x)
        common = int((y[np.minimum(at, len(y) - 1)] == x).sum()) if len(y) else 0
        out[i] = common > 0 and 100 * common >= percent * (len(x) + len(y) - common)
    return out


def _verified(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) that hold on their full shingle sets."""
    both = (pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
            .join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b"))

    def run(batches):
        for b in batches:
            ok = pa.array(_alike(b.column("ta").to_pylist(), b.column("tb").to_pylist(), k, percent))
            yield pa.RecordBatch.from_arrays([b.column("a").filter(ok), b.column("b").filter(ok)], ["a", "b"])

    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def near_dedup(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per input row: id, ``n_shingles``, ``component_id`` (smallest id reachable over links), ``kept``.

    Links join documents whose sets of distinct ``k``-word shingles have 100 * common >= percent * union.
    Equal sets are one class from the start, so thousands of copies cost one row each.  Classes that share
    a band key are candidates; each is checked on the full sets (64-bit hashes of the shingles of whole texts):

    1. every class against the smallest class it shares a bucket with,
    2. every class against the smallest of each of its buckets,
    3. all pairs within a bucket,

    (in step 3 only pairs whose signatures agree enough), each time only between classes that are not in one component yet, so a large group of near copies costs
    about one check per member instead of one per pair, and no component is lost.

    Texts without words (null, empty, blank) have no shingles and link with nothing.  Rows that share an id
    are looked at each by its own text, equal rows get equal results; rows with a null id are returned with
    a null component and kept.  An empty table gives an empty result; other columns are not read."""
    spark = docs.sparkSession
    bands_n, rows_n, agreeing = settings(percent)
    python_stage(spark)
    scratch = Scratch(spark)
    sketch = scratch.write(_sketch(docs, k, bands_n, rows_n, id_col, text_col), "sketch")
    with_id = sketch.where("n > 0 and id is not null")
    classes = with_id.groupBy("n", "s1", "s2").agg(F.min("id").alias("rep"))
    keyed = (sketch.join(classes.withColumnRenamed("rep", "id"), ["id", "n", "s1", "s2"]).dropDuplicates(["id", "n", "s1", "s2"])
             .select("id", "n", F.explode("bands").alias("key")))
    keyed = scratch.write(keyed, "keys")
    buckets = (keyed.groupBy("key").agg(F.min(F.struct("id", "n")).alias("hub"), F.count(F.lit(1)).alias("c"))
               .where("c > 1").select("key", F.col("hub.id").alias("hub"), F.col("hub.n").alias("hub_n")))
    members = scratch.write(keyed.join(buckets, "key"), "members")
    scratch.drop(keyed)
    involved = members.select("id").distinct()
    texts = scratch.write(_rows(docs, id_col, text_col).join(involved, "id").dropDuplicates(["id", "text"]), "texts")
    # |common| <= the smaller set and |union| >= the larger one
    stars = members.where(f"id <> hub and 100 * least(n, hub_n) >= {percent} * greatest(n, hub_n)")
    first = scratch.write(stars.groupBy(F.col("id").alias("b")).agg(F.min("hub").alias("a")).select("a", "b"), "first")
    links = scratch.write(_verified(first, texts, k, percent), "links")
    comp = components(links, scratch)

    def apart(pairs: DataFrame) -> DataFrame:
        for side in ("a", "b"):
            pairs = (pairs.join(comp.select(F.col("node").alias(side), F.col("component").alias(f"c{side}")), side, "left")
                     .withColumn(f"c{side}", F.coalesce(f"c{side}", side)))
        return pairs.where("ca <> cb").select("a", "b")

    second = stars.select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct().join(first, ["a", "b"], "left_anti")
    more = scratch.write(_verified(apart(second), texts, k, percent), "links")
    links = links.union(more)
    comp = components(links, scratch)
    inside = (members.where("id <> hub").select("key", "id", "n").join(comp.select(F.col("node").alias("id"), "component"), "id", "left")
              .select("key", "id", "n", F.coalesce("component", "id").alias("c")))
    mixed = inside.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("key")
    inside = scratch.write(inside.join(mixed, "key"), "inside")
    fine = scratch.write(_fine(texts.join(inside.select("id").distinct(), "id"), k), "fine")
    inside = inside.join(fine, "id")

    def side(x: str) -> DataFrame:
        return inside.select("key", F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("c").alias(f"c{x}"), F.col("fine").alias(f"f{x}"))

    # four bits that differ anywhere leave a bit when they are put together
    differ = ("aggregate(zip_with(fa, fb, (x, y) -> bit_count(((x ^ y) | shiftrightunsigned(x ^ y, 1) | shiftrightunsigned(x ^ y, 2)"
              " | shiftrightunsigned(x ^ y, 3)) & 1229782938247303441L)), 0, (s, v) -> s + v)")
    pairs = (side("a").join(side("b"), "key")
             .where(f"a < b and ca <> cb and 100 * least(na, nb) >= {percent} * greatest(na, nb) and {differ} <= {FINE - agreeing}")
             .select("a", "b").distinct())
    last = scratch.write(_verified(pairs, texts, k, percent), "links")
    comp = components(links.union(last), scratch)
    grouped = classes.join(comp.withColumnRenamed("node", "rep"), "rep", "left").select(
        "n", "s1", "s2", F.coalesce("component", "rep").alias("component"))
    out = sketch.select("id", "n", "s1", "s2").join(grouped, ["n", "s1", "s2"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"),
                      component.eqNullSafe(F.col("id")).alias("kept"))


def op7(spark, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), k=4, percent=80)


OP7_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i:i+3], ' ') FOR i IN range(1, len(w) - 2)]) END AS s FROM words
), inverted AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS sh FROM sets
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM inverted a JOIN inverted b ON a.sh = b.sh AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))
), reach AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION
  SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a
)
SELECT s.doc_id, len(s.s) AS n_shingles, min(r.other) AS component_id, min(r.other) = s.doc_id AS kept
FROM sets s JOIN reach r USING (doc_id) GROUP BY s.doc_id, s.s
"""
