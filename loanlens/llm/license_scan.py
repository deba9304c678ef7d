"""License scans by canonical digests: texts are brought to a canonical form, digested, and hash-joined to the
digests of known licence texts and notices.  DataFrame functions only."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from loanlens.llm.common import table
from loanlens.llm.license_texts import NOTICES, SPELLINGS, TEXTS

# Of a lower-cased line: a line that only says whose copyright it is.
COPYRIGHT_LINE = r"^[^a-z0-9©]*(copyright\s*(\(c\)|©|[0-9<{:\[]|by\b)|\(c\)\s|©).*$"
NOT_WORD = r"[^\p{L}\p{N}]+"


def _any_spelling() -> str:
    return r" (" + "|".join(sorted({re.escape(a).replace(r"\ ", " ") for a, _ in SPELLINGS}, key=len, reverse=True)) + ") "


def canonical_line(line: Column) -> Column:
    """Lower case, '&' as "and", no copyright line, runs of anything but letters and digits as one space, canonical
    spellings; empty if nothing is left."""
    low = F.lower(line)
    words = F.trim(F.regexp_replace(F.replace(low, F.lit("&"), F.lit(" and ")), NOT_WORD, " "))
    padded = F.concat(F.lit(" "), words, F.lit(" "))
    fixed = padded
    for a, b in SPELLINGS:
        fixed = F.replace(fixed, F.lit(f" {a} "), F.lit(f" {b} "))
    words = F.when(padded.rlike(_any_spelling()), F.trim(fixed)).otherwise(words)
    return F.when(low.rlike(COPYRIGHT_LINE), F.lit("")).otherwise(words)


def canonical_lines(text: Column) -> Column:
    """Canonical forms of a text's lines, without the empty ones."""
    return F.filter(F.transform(F.split(text, "\n"), canonical_line), lambda x: x != "")


def digest(canonical: Column) -> Column:
    return F.sha2(canonical, 256)


def known_digests(spark: SparkSession) -> DataFrame:
    """(digest, license_id, kind) of the known texts and notices: one row per canonical form."""
    rows = [(i, "text", t) for i, t in TEXTS] + [(i, "notice", t) for i, t in NOTICES]
    frame = spark.createDataFrame(rows, "license_id string, kind string, text string")
    return (frame.select("license_id", "kind", digest(F.array_join(canonical_lines(F.col("text")), " ")).alias("digest"))
            .groupBy("digest").agg(F.min("license_id").alias("license_id"), F.min("kind").alias("kind")))


def license_scan(docs: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per id: ``text_license`` (licence whose canonical text is the whole document, else null), ``n_lines`` (not empty
    in canonical form), ``n_license_lines`` (lines that are a known notice), ``licenses`` (sorted ids found as text
    or lines), ``canonical_sha256`` of the whole text.

    A copyright line never counts.  Null, empty and blank texts have no lines and no licence.  Spellings are made
    equal within a line.  Rows that share an id and text are one row; rows that share an id and not the text, and
    rows with a null id, each have their own.  An empty table gives an empty result; other columns are not read.

    The digest table has one row per known text (some dozens), so it is broadcast; texts are not shuffled, only
    the few lines that match are."""
    spark = docs.sparkSession
    known = known_digests(spark) if known is None else known
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    rows = rows.select("id", F.xxhash64("text").alias("th"), canonical_lines(F.col("text")).alias("lines"))
    whole = F.when(F.size("lines") > 0, digest(F.array_join("lines", " ")))
    each = rows.select("id", "th", F.size("lines").cast("long").alias("n_lines"), "lines", whole.alias("whole"))
    # unit 0 is the whole text, the others are its lines; a text of one line counts as both
    units = (each.select("id", "th", F.posexplode(F.concat(F.array("whole"), F.transform("lines", digest))).alias("unit", "digest"))
             .join(F.broadcast(known), "digest"))
    found = (units.groupBy("id", "th").agg(
        F.min(F.when(F.col("unit") == 0, F.col("license_id"))).alias("text_license"),
        F.countDistinct(F.when(F.col("unit") > 0, F.col("unit"))).alias("n_license_lines"),
        F.sort_array(F.collect_set("license_id")).alias("licenses")).withColumnsRenamed({"id": "fid", "th": "fth"}))
    met = (each.select("id", "th", "n_lines", "whole").distinct()
           .join(found, F.col("id").eqNullSafe(F.col("fid")) & (F.col("th") == F.col("fth")), "left"))
    return met.select(F.col("id").alias(id_col), "text_license", "n_lines",
                      F.coalesce("n_license_lines", F.lit(0)).cast("long").alias("n_license_lines"),
                      F.coalesce(F.array_join("licenses", ","), F.lit("")).alias("licenses"),
                      F.col("whole").alias("canonical_sha256"))


def op10(spark, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _sql() -> str:
    def quoted(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    def canon(x: str) -> str:
        words = f"trim(regexp_replace(replace(lower({x}), '&', ' and '), {quoted(NOT_WORD)}, ' ', 'g'))"
        fixed = f"(' ' || {words} || ' ')"
        for a, b in SPELLINGS:
            fixed = f"replace({fixed}, ' {a} ', ' {b} ')"
        return f"CASE WHEN regexp_matches(lower({x}), {quoted(COPYRIGHT_LINE)}) THEN '' ELSE trim({fixed}) END"

    def lines(x: str) -> str:
        return f"list_filter(list_transform(string_split({x}, chr(10)), lambda l: {canon('l')}), lambda l: l <> '')"

    values = ", ".join(f"({quoted(i)}, {quoted(t)})" for i, t in [*TEXTS, *NOTICES])
    return f"""
WITH given(license_id, text) AS (VALUES {values}),
known AS (SELECT sha256(array_to_string({lines('text')}, ' ')) AS digest, min(license_id) AS license_id FROM given GROUP BY 1),
docs AS (SELECT doc_id, {lines("coalesce(text, '')")} AS l FROM documents),
units AS (
  SELECT doc_id, 0 AS unit, sha256(array_to_string(l, ' ')) AS digest FROM docs WHERE len(l) > 0
  UNION ALL
  SELECT doc_id, unnest(range(1, len(l) + 1)) AS unit, sha256(unnest(l)) AS digest FROM docs
), found AS (
  SELECT doc_id, min(license_id) FILTER (unit = 0) AS text_license, count(DISTINCT unit) FILTER (unit > 0) AS n,
    string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS licenses
  FROM units JOIN known USING (digest) GROUP BY doc_id
)
SELECT d.doc_id, f.text_license, len(d.l) AS n_lines, coalesce(f.n, 0) AS n_license_lines, coalesce(f.licenses, '') AS licenses,
  CASE WHEN len(d.l) > 0 THEN sha256(array_to_string(d.l, ' ')) END AS canonical_sha256
FROM docs d LEFT JOIN found f USING (doc_id)
"""


OP10_SQL = _sql()
