"""Best-fit packing of tokenised documents into sequences, with swap-based local search."""

from __future__ import annotations

import functools
import json
import re
import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window, functions as F

from loanlens.llm import best_fit
from loanlens.llm.bpe import Cache, Merges
from loanlens.llm.common import Scratch, python_stage, table, text_groups

# Fixed value: how this kind of byte-level vocabulary splits a text before merging.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# The same for texts without characters that the standard library classes in another way: there a letter is a word
# character that is neither a decimal digit nor the underscore.
PLAIN_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"""
SEGMENT = 2_000_000  # characters after which a very long text is cut at a space between two words
RANK_ROWS = 200_000  # pieces of one length that one task ranks, about
_SINGLE = re.compile(r"(?<=\S) (?=\S)")


@functools.cache
def _other() -> frozenset:
    """Characters that the two patterns class in different ways."""
    every = "".join(c for c in map(chr, range(0x110000)) if not "\ud800" <= c <= "\udfff")
    out: set = set()
    for plain, full in ((r"[^\W\d_]", r"\p{L}"), (r"\d", r"\p{N}"), (r"\s", r"\s")):
        out |= set(re.findall(plain, every)) ^ set(regex.findall(full, every))
    return frozenset(out)


def _is_plain(text: str) -> bool:
    if text.isascii():
        return not any(c in text for c in "\x1c\x1d\x1e\x1f")
    return _other().isdisjoint(text)


class TextIds:
    """Ids of texts under a byte-level BPE file, equal to what its library gives by default.

    A text is cut into pre-tokens (words with the space before them, numbers, punctuation); the ids of each are in a
    bounded cache, and new ones are merged in batches."""

    def __init__(self, text: str):
        spec = json.loads(text)
        self.merges = Merges.from_json(text)
        self.find, self.find_plain = regex.compile(SPLIT).findall, re.compile(PLAIN_SPLIT).findall
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.cache = Cache(self._merge, None, most=1_200_000)

    def _merge(self, tokens: list) -> list[bytes]:
        """A str is a pre-token, a 1-tuple a special string."""
        plain = [t for t in tokens if type(t) is str]
        ids, n = self.merges.encode([t.encode() for t in plain])
        raw, at = ids.astype("<u4").tobytes(), (4 * np.concatenate([[0], np.cumsum(n)])).astype(int).tolist()
        values = iter([raw[i:j] for i, j in zip(at, at[1:])])
        return [next(values) if type(t) is str else np.array([self.special[t[0]]], "<u4").tobytes() for t in tokens]

    def _segments(self, text: str):
        """Parts of a text that no pre-token spans, of at most about SEGMENT characters."""
        at = 0
        while len(text) - at > SEGMENT:
            cut = _SINGLE.search(text, at + SEGMENT)
            if cut is None:
                break
            yield text[at:cut.start()]
            at = cut.start()
        yield text[at:] if at else text

    def _tokens(self, text: str):
        """Lists of pre-tokens, one after the other."""
        find = self.find_plain if _is_plain(text) else self.find
        if self.special and any(x in text for x in self.special):
            for part in self.cut.split(text):
                yield from [[(part,)]] if part in self.special else map(find, self._segments(part))
        else:
            yield from map(find, self._segments(text))

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian uint32 ids of each text."""
        out, value = [b""] * len(texts), self.cache.__getitem__
        for group in text_groups(texts):
            held, new = [], []
            for i in group:
                parts = []
                for tokens in self._tokens(texts[i]):
                    parts.extend(map(value, tokens))
                held.append((parts, self.cache.missed))
                new.extend(self.cache.missed)
                self.cache.missed = []
            values = self.cache.fill(new)
            for i, (parts, missed) in zip(group, held):
                at = -1
                for u in missed:
                    at = parts.index(None, at + 1)
                    parts[at] = values[u]
                out[i] = b"".join(parts)
        return out


_ENCODERS: dict = {}


def _encoder(key, spec) -> TextIds:
    if key not in _ENCODERS:
        _ENCODERS[key] = TextIds(spec.value)
    return _ENCODERS[key]


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id",
           text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Tokenise documents and cut the long ones: (doc_id, piece, start, length, ids_crc32[, ids]).

    A document is its ids and ``end_id``; null text counts as empty (one token).  Documents of more
    than ``capacity`` tokens are cut into pieces of ``capacity``, of which the first may be shorter.
    Each row is cut by itself: repeated rows and null ids give their own pieces."""
    spark = docs.sparkSession
    python_stage(spark)
    with open(tokenizer_path, encoding="utf-8") as f:  # a bounded vocabulary file on the driver
        spec = spark.sparkContext.broadcast(f.read())
    key, tail = tokenizer_path, np.array([end_id], "<u4").tobytes()

    def run(batches):
        encoder = _encoder(key, spec)
        for b in batches:
            row, piece, start, length, crc, ids = [], [], [], [], [], []
            for k, raw in enumerate(encoder.ids(b.column("_text").to_pylist())):
                raw += tail
                n = len(raw) // 4
                first = n % capacity or capacity
                for j, end in enumerate(range(first, n + 1, capacity)):
                    begin = max(0, end - capacity)
                    part = raw[4 * begin:4 * end]
                    row.append(k)
                    piece.append(j)
                    start.append(begin)
                    length.append(end - begin)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(np.frombuffer(part, "<u4").astype(np.int32))
            cols = [b.column("_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()),
                    *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            names = ["_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                cols.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names)

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("_id"),
                       F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_text"))
    schema = "_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    return rows.mapInArrow(run, schema).withColumnRenamed("_id", id_col)


def assign(cut: DataFrame, capacity: int = 1024, id_col: str = "doc_id") -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to a *written* table of pieces (it is read three times).

    The histogram of lengths (at most ``capacity`` rows) goes to the driver and is packed there; each
    piece is ranked within its length, in buckets of about RANK_ROWS rows so that a length which a
    third of all pieces have is ranked by many tasks, and the rank finds its place in the packing."""
    hist = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    places = sorted(best_fit.placement(best_fit.pack(hist, capacity)))
    split = {length: -(-n // RANK_ROWS) for length, n in hist.items()}
    parts = F.coalesce(*[F.when(F.col("length") == x, n) for x, n in split.items() if n > 1], F.lit(1))
    dealt = cut.withColumn("_part", F.pmod(F.xxhash64(id_col, "piece", "ids_crc32"), parts).cast("int"))
    before = (dealt.groupBy("length", "_part").agg(F.count(F.lit(1)).alias("_n"))
              .select("length", "_part", (F.sum("_n").over(Window.partitionBy("length").orderBy("_part")) - F.col("_n"))
                      .alias("_before")))
    order = Window.partitionBy("length", "_part").orderBy(id_col, "piece", "ids_crc32")
    ranked = (dealt.withColumn("_nth", F.row_number().over(order) - 1)
              .join(before, ["length", "_part"]).withColumn("_rank", F.col("_before") + F.col("_nth")))
    cols = np.array(places, np.int64).reshape(-1, 5).T
    plan = ranked.sparkSession.sparkContext.broadcast(cols)  # a few rows per distinct length

    @F.pandas_udf("struct<s: long, o: long>")
    def place(length, rank):
        import pandas as pd
        ls, lo, _, first, at = plan.value
        length, rank = length.to_numpy(), rank.to_numpy()
        width = max(int(lo.max()), int(rank.max())) + 1 if len(rank) else 1
        k = np.searchsorted(ls * width + lo, length * width + rank, "right") - 1
        return pd.DataFrame({"s": first[k] + rank - lo[k], "o": at[k]})

    placed = ranked.withColumn("_place", place("length", "_rank"))
    return placed.select(*cut.columns, F.col("_place.s").alias("sequence_id"), F.col("_place.o").alias("offset"))


def best_fit_packing(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2,
                     id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Documents packed into as few sequences of at most ``capacity`` tokens as the search finds.

    One row per piece: id, piece, start, length, ids_crc32[, ids], sequence_id, offset; sequences are
    gapless from offset 0.  Ties (equal lengths) go by id and piece; repeated rows have places of their
    own; an empty table gives an empty result; columns other than id and text are not read."""
    cut = Scratch(docs.sparkSession).write(
        pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col, with_ids), "pieces")
    return assign(cut, capacity, id_col)


def op5(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return best_fit_packing(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
