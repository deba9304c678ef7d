"""Line dedup: explode normalised lines, hash, count distinct documents per hash,
drop lines over the threshold, reassemble by position (DataFrame functions only)."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, functions as F

ASCII_SPACE = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """ASCII white space stripped at both ends, A-Z lower-cased (other letters stay)."""
    return F.translate(F.btrim(line, F.lit(ASCII_SPACE)), string.ascii_uppercase, string.ascii_lowercase)


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               min_docs: int = 2, min_chars: int = 10) -> DataFrame:
    """Drop lines that several documents share, except in the smallest id that holds them.

    A line whose key has at least ``min_chars`` code points and stands in at least ``min_docs``
    documents loses all its occurrences except in the smallest ``id_col`` holding it.  Returns per
    input row: ``row`` (struct of all input columns, so that clashing names can't matter),
    ``n_lines``, ``n_dropped``, ``kept_text``.

    Null text: one empty line.  Rows that share an id are one document (a repeated row is counted
    once); a null id is a document too, after all others.  Ties can't occur: the holder is the
    smallest id.  An empty table gives an empty result.  Every line counts, however long.

    Plan: the shuffles carry (hash, id) pairs, then positions to drop; whole texts move once, to
    meet their own drop list.  A line that a third of all documents hold is one row per map task
    and id before the exchange, and its join against the one-row-per-hash table is split by AQE.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                       F.col(f"`{id_col}`").alias("_id"),
                       F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_text"))
    rows = rows.withColumn("_th", F.xxhash64("_text"))
    lines = (rows.select("_id", "_th", F.posexplode(F.split("_text", "\n")).alias("_pos", "_line"))
             .select("_id", "_th", "_pos", line_key(F.col("_line")).alias("_key"))
             .where(F.length("_key") >= min_chars)
             .select("_id", "_th", "_pos", F.xxhash64("_key").alias("_h1"),
                     F.xxhash64(F.lit("second"), "_key").alias("_h2")))
    shared = (lines.select("_h1", "_h2", "_id").distinct()
              .groupBy("_h1", "_h2").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_holder"))
              .where(F.col("_n") >= min_docs).select("_h1", "_h2", "_holder"))
    drops = (lines.join(shared, ["_h1", "_h2"]).where(~F.col("_id").eqNullSafe(F.col("_holder")))
             .groupBy("_id", "_th").agg(F.sort_array(F.collect_set("_pos")).alias("_drop"))
             .withColumnsRenamed({"_id": "_did", "_th": "_dth"}))
    joined = rows.join(drops, F.col("_id").eqNullSafe(F.col("_did")) & (F.col("_th") == F.col("_dth")), "left")
    # runs of lines between the dropped positions; linear in lines + drops
    kept = """flatten(transform(sequence(0, size(_d)), j -> slice(_lines,
        if(j = 0, 0, try_element_at(_d, j) + 1) + 1,
        if(j = size(_d), size(_lines), try_element_at(_d, j + 1)) - if(j = 0, 0, try_element_at(_d, j) + 1))))"""
    return (joined.withColumn("_d", F.coalesce("_drop", F.array().cast("array<int>")))
            .withColumn("_lines", F.split("_text", "\n"))
            .select("row", F.size("_lines").cast("long").alias("n_lines"), F.size("_d").cast("long").alias("n_dropped"),
                    F.when(F.size("_d") == 0, F.col("_text"))
                    .otherwise(F.array_join(F.expr(kept), "\n")).alias("kept_text")))


def op8(spark, sf_dir: str) -> DataFrame:
    """All lines of all documents; digest of what each document keeps."""
    from loanlens.llm.common import table
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup(docs).select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP8_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
), keyed AS (
  SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), shared AS (
  SELECT key, min(doc_id) AS holder FROM keyed WHERE length(key) >= 10
  GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), marked AS (
  SELECT k.doc_id, k.pos, k.line, s.key IS NOT NULL AND s.holder <> k.doc_id AS dropped
  FROM keyed k LEFT JOIN shared s USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
