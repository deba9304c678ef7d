"""Document fingerprints: Order MinHash over words, with DataFrame functions only.

Every k-mer of words is numbered by its occurrence in the text, so (k-mer, n-th time) pairs are distinct.
A hash deals the pairs into two slots for each of ``SKETCHES`` sketches; of each slot the least pair is
selected.  The pairs of a sketch are put in text order and hashed as a tuple: texts agree in a sketch when
they share the selected pairs *and* their order, so the share of agreeing sketches falls with edit
distance and with moved passages, not only with the set of words.

One shuffle moves the texts: documents go to ranges of ids (found from approximate quantiles), where each
row meets the next one by a window; all later steps group by that range and more, and so stay in place."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window, functions as F

from loanlens.llm.common import table

KMER, SKETCHES = 3, 64
RANGE_ROWS = 200_000  # documents of one range, at most about
TASK_CHARS = 4_000_000  # characters of text that one task fingerprints, about
PLACE_BITS = 28  # of a packed value, for the place in the text
OWN, EDITED = 0, 1  # what a text is to its document


def _ranges(rows: DataFrame) -> tuple[Column, int, DataFrame]:
    """(range of an id, number of tasks, table of each range's following id: follow_part, follow_id)."""
    spark = rows.sparkSession
    n, chars = rows.agg(F.count("id"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    tasks = max(spark.sparkContext.defaultParallelism, -(-chars // TASK_CHARS))
    # several ranges for each task even out their sizes
    count = max(1, min(-(-n // 16), max(-(-n // RANGE_ROWS), 4 * tasks)))
    cuts = []
    if count > 1:
        shares = json.dumps([round(i / count, 9) for i in range(1, count)])
        cuts = sorted(set(rows.agg(F.expr(
            f"percentile_approx(id, from_json('{shares}', 'array<double>'), {min(20 * count, 2_000_000)})")).first()[0]))
    size = len(cuts)
    steps = [1 << s for s in reversed(range(max(size, 1).bit_length()))]
    bounds = f"from_json('{json.dumps(cuts)}', 'array<bigint>')"  # folded to one constant
    found = F.expr(f"aggregate(array({', '.join(map(str, steps))}), 0, (at, s) -> "
                   f"if(at + s <= {size} and get({bounds}, at + s - 1) <= id, at + s, at))")
    part = F.when(F.col("id").isNotNull(), found).otherwise(-1 - F.pmod(F.xxhash64("text"), F.lit(4 * tasks)).cast("int"))
    firsts = sorted((r["part"], r["first"]) for r in rows.where("id is not null").select("id", part.alias("part"))
                    .groupBy("part").agg(F.min("id").alias("first")).collect())  # one row a range
    follow = [(p, firsts[(i + 1) % len(firsts)][1]) for i, (p, _) in enumerate(firsts)]
    return part, tasks, spark.createDataFrame(follow, "follow_part int, follow_id long")


def _in_order(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(part, seq, id, text, next_text, guest): all rows in the order of ids, each with the text after it.  The
    first document of a range is also a guest at the end of the range before, where it is only next."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"),
                       F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    part, tasks, follow = _ranges(rows)
    places = F.array(F.struct(F.col("part"), F.lit(False).alias("guest")),
                     F.struct(F.col("follow_part").alias("part"), F.lit(True).alias("guest")))
    dealt = (rows.withColumn("part", part).join(F.broadcast(follow), F.col("id") == F.col("follow_id"), "left")
             .select("id", "text", F.explode(places).alias("at")).where("at.part is not null")
             .select("at.part", "at.guest", "id", "text").repartition(tasks, "part"))
    order = Window.partitionBy("part").orderBy("guest", "id", "text")
    after = F.when(F.col("id").isNotNull(), F.lead("text").over(order))
    return dealt.select("part", "guest", "id", "text", F.row_number().over(order).alias("seq"),
                        F.coalesce(after, F.lit("")).alias("next_text"))


def _edited(text: Column, after: Column) -> Column:
    """The last floor(n / 2) code points replaced by the first as many (or all) of the text after it."""
    n = F.length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(after, F.lit(1), half))


def kmer_hashes(text: Column, k: int) -> Column:
    """Hashes of the k-mers of the text's words in text order; a text with fewer words has one, the whole."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")

    def mers(h: Column) -> Column:
        n = F.size(h)
        many = F.transform(F.slice(h, F.lit(1), F.greatest(n - (k - 1), F.lit(0))),
                           lambda x, i: F.xxhash64(x, *[F.get(h, i + j) for j in range(1, k)]))
        return F.when(n >= k, many).when(n > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<long>"))

    # the array of one array names the word hashes once, so they are not worked out again for each use
    return F.get(F.transform(F.array(F.transform(words, lambda w: F.xxhash64(w))), mers), F.lit(0))


def _prints(texts: DataFrame, k: int) -> DataFrame:
    """(part, rid, sketch, print) of texts (part, rid, text): the hash of each sketch's pairs in text order."""
    rows = texts.select("part", "rid", F.posexplode(kmer_hashes(F.col("text"), k)).alias("place", "kmer"))
    # the k-mer comes first in the window's order, so sorting compares one long for nearly all rows
    nth = F.row_number().over(Window.partitionBy("kmer", "part", "rid").orderBy("place"))
    pairs = rows.select("part", "rid", F.col("place").cast("long").alias("place"), F.xxhash64("kmer", nth).alias("h"))
    rank = F.shiftrightunsigned(F.xxhash64("h"), PLACE_BITS + 1)  # 35 bits: which pair is least, and which one it is
    least = (pairs.select("part", "rid", F.pmod("h", F.lit(2 * SKETCHES)).cast("int").alias("slot"),
                          F.shiftleft(rank, PLACE_BITS).bitwiseOR(F.col("place")).alias("packed"))
             .groupBy("part", "rid", "slot").agg(F.min("packed").alias("packed")))
    place = F.col("packed").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    turned = F.shiftleft(place, 63 - PLACE_BITS).bitwiseOR(F.shiftright("packed", PLACE_BITS))  # the place leads now
    both = (least.select("part", "rid", (F.col("slot") % SKETCHES).alias("sketch"), turned.alias("t"))
            .groupBy("part", "rid", "sketch").agg(F.min("t").alias("a"), F.max("t").alias("b")))
    pair = (1 << (63 - PLACE_BITS)) - 1
    first, second = F.col("a").bitwiseAND(F.lit(pair)), F.col("b").bitwiseAND(F.lit(pair))
    return both.select("part", "rid", "sketch",
                       F.xxhash64(first, F.when(F.col("a") != F.col("b"), second)).bitwiseAND(F.lit(0xFFFFFF)).alias("print"))


def fingerprints(docs: DataFrame, k: int = KMER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of whole texts and of their edited texts, one row per input row.

    Columns: id, ``n_chars`` (code points), ``edited_sha256``, ``fingerprint``, ``edited_fingerprint`` (for each
    filled sketch two hex digits of its number and six of its print), ``near_edited``, ``near_next``: agreeing
    sketches by sketches that at least one of the two texts fills (1 when neither has words).

    The next document is the row after this one in the order of (id, text), so rows that share an id follow
    each other and repeated rows are next to themselves; after the last row comes the first.  Rows with a
    null id come with no next document (their edited text is their first half).  Null text counts as empty;
    texts without words have empty fingerprints, short ones one k-mer (all their words).  An empty table
    gives an empty result; other columns are not read.  Very long texts are k-mers in rows, not in memory."""
    spark = docs.sparkSession
    # grouping columns that contain the range need no shuffle of their own, in joins as in aggregations
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    rows = _in_order(docs, id_col, text_col)
    own, after = F.col("text"), F.col("next_text")
    texts = rows.select("part", "seq", F.explode(F.array(
        F.struct(F.lit(OWN).alias("kind"), own.alias("text")),
        F.struct(F.lit(EDITED).alias("kind"), F.when(~F.col("guest"), _edited(own, after)).alias("text")))).alias("x"))
    texts = texts.where("x.text is not null").select(
        "part", F.shiftleft(F.col("seq").cast("long"), 1).bitwiseOR(F.col("x.kind").cast("long")).alias("rid"), F.col("x.text").alias("text"))
    of = lambda x: F.max(F.when(F.col("rid").bitwiseAND(F.lit(1)) == x, F.col("print")))
    wide = (_prints(texts, k).groupBy("part", F.shiftright("rid", 1).cast("int").alias("seq"), "sketch")
            .agg(of(OWN).alias("own"), of(EDITED).alias("edited")))
    line = Window.partitionBy("part", "sketch").orderBy("seq")
    wide = wide.withColumn("next", F.when((F.col("part") >= 0) & (F.lead("seq").over(line) == F.col("seq") + 1),
                                          F.lead("own").over(line)))
    code = lambda c: F.sort_array(F.collect_list(F.when(F.col(c).isNotNull(), F.concat(
        F.lpad(F.lower(F.hex("sketch")), 2, "0"), F.lpad(F.lower(F.hex(c)), 6, "0")))))
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    has = {c: F.col(c).isNotNull() for c in ("own", "edited", "next")}
    each = (wide.groupBy("part", "seq").agg(
        F.array_join(code("own"), "").alias("fingerprint"), F.array_join(code("edited"), "").alias("edited_fingerprint"),
        count(has["own"]).alias("n_own"),
        count(F.col("own") == F.col("edited")).alias("same_edited"), count(has["own"] | has["edited"]).alias("seen_edited"),
        count(F.col("own") == F.col("next")).alias("same_next"), count(has["own"] & has["next"]).alias("both_next"))
        .withColumnsRenamed({"part": "epart", "seq": "eseq"}))
    meta = rows.select("part", "seq", "id", "guest", F.length(own).cast("long").alias("n_chars"),
                       F.sha2(_edited(own, after), 256).alias("edited_sha256"))
    out = meta.join(each, (F.col("part") == F.col("epart")) & (F.col("seq") == F.col("eseq")), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    order = Window.partitionBy("part").orderBy("seq")
    n_next = F.when(F.col("part") >= 0, F.lead(zero("n_own")).over(order))
    out = out.withColumn("seen_next", zero("n_own") + F.coalesce(n_next, F.lit(0)) - zero("both_next")).where("not guest")
    near = lambda same, seen: F.when(seen > 0, zero(same) / seen).otherwise(F.lit(1.0))
    return out.select(F.col("id").alias(id_col), "n_chars", "edited_sha256",
                      F.coalesce("fingerprint", F.lit("")).alias("fingerprint"),
                      F.coalesce("edited_fingerprint", F.lit("")).alias("edited_fingerprint"),
                      near("same_edited", zero("seen_edited")).alias("near_edited"),
                      near("same_next", F.col("seen_next")).alias("near_next"))


def op4(spark, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))
