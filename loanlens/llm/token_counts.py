"""Token counts: rank-synchronous array merging of batched pre-tokens.

The vocabulary lower-cases, folds white space and marks word ends; a pre-token never spans white
space, so each white-space-free unit has its own count, kept in a bounded cache per worker, and only
units not met before go through the merge rounds of ``bpe.Merges``."""

from __future__ import annotations

import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from loanlens.llm.bpe import Cache, Merges
from loanlens.llm.common import python_stage, table, text_groups

SEGMENT = 2_000_000  # characters after which a very long text is cut at the next white space
_MARKS = re.compile(r"[\x1c-\x1f]")  # white space to str.split, not to the vocabulary's pattern


class Counter:
    """Counts tokens as the tokenizer file does with default settings and no added special tokens."""

    def __init__(self, text: str):
        spec = json.loads(text)
        self.merges = Merges.from_json(text)
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.find = regex.compile(pattern).findall
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.cache = Cache(self._learn, 0)

    def _normal(self, text: str) -> str:
        if not text.isascii() and not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        return text.replace("Σ", "σ").lower()  # letter by letter: no final sigma

    def _segments(self, text: str):
        """Parts between special strings, and of those parts at most about SEGMENT characters."""
        for part in self.special.split(text) if self.special and "<|" in text else [text]:
            at = 0
            while len(part) - at > SEGMENT:
                cut = regex.compile(r"\p{White_Space}").search(part, at + SEGMENT)
                if cut is None:
                    break
                yield self._normal(part[at:cut.start()])
                at = cut.start()
            yield self._normal(part[at:] if at else part)

    def _units(self, segment: str) -> list[str]:
        return regex.split(r"\p{White_Space}+", segment) if _MARKS.search(segment) else segment.split()

    def _learn(self, units: list[str]) -> list[int]:
        tokens = [self.find(u) for u in units]
        flat = [t.encode() for ts in tokens for t in ts]
        distinct = {t: i for i, t in enumerate(dict.fromkeys(flat))}
        n = self.merges.encode(list(distinct))[1]
        per = n[np.fromiter(map(distinct.__getitem__, flat), np.int64, len(flat))]
        sums = np.concatenate([[0], np.cumsum(per)]).astype(np.int64)
        size = np.array([len(ts) for ts in tokens], np.int64)
        ends = np.cumsum(size)
        return (sums[ends] - sums[ends - size]).tolist()

    def counts(self, texts: list[str]) -> list[int]:
        out, value = [0] * len(texts), self.cache.__getitem__
        for group in text_groups(texts):
            missed = []
            for i in group:
                text, n = texts[i], 0
                if self.special and "<|" in text:
                    n += len(self.special.findall(text))
                for segment in self._segments(text):
                    n += sum(map(value, self._units(segment)))
                    if self.cache.missed:
                        missed.append((i, self.cache.missed))
                        self.cache.missed = []
                out[i] = n
            new = self.cache.fill(u for _, units in missed for u in units)
            for i, units in missed:
                out[i] += sum(map(new.__getitem__, units))
        return out


def token_counts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = 2048) -> DataFrame:
    """Per input row: id, ``n_bytes`` (UTF-8), ``n_tokens``, ``over_limit`` (n_tokens > limit).

    Null and empty texts have 0 bytes and 0 tokens; special strings inside a text count as the one
    token they stand for, as the library does by default.  Rows are independent of each other, so
    repeated rows and ids each give their own row, null ids included; an empty table gives an empty
    result; other columns are not read.  A very long text is cut at white space (which no token
    spans) and summed.  No shuffle: one pass over the scan in bounded Arrow batches."""
    spark = docs.sparkSession
    python_stage(spark)
    with open(tokenizer_path, encoding="utf-8") as f:  # a bounded vocabulary file on the driver
        spec = spark.sparkContext.broadcast(f.read())
    key = tokenizer_path

    def run(batches):
        counter = _counter(key, spec)
        for b in batches:
            n = counter.counts(b.column("_text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("n_bytes"), pa.array(n, pa.int64())],
                                             ["_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("_id"),
                       F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_text"))
    return (rows.withColumn("n_bytes", F.octet_length("_text").cast("long"))
            .mapInArrow(run, "_id long, n_bytes long, n_tokens long")
            .select(F.col("_id").alias(id_col), "n_bytes", "n_tokens",
                    (F.col("n_tokens") > limit).alias("over_limit")))


_COUNTERS: dict = {}


def _counter(key, spec) -> Counter:
    """One counter (tables and cache) per worker process and vocabulary, kept between tasks."""
    if key not in _COUNTERS:
        _COUNTERS[key] = Counter(spec.value)
    return _COUNTERS[key]


def op6(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
