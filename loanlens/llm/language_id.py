"""Language of whole texts by a linear-chain CRF over their words (``crf``), which also labels code-switched text.

Training chains are runs of words of labelled documents; half of them are joined from two documents of different
languages, so the transitions learn that a text seldom changes its language, but may."""

from __future__ import annotations

import random
import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from loanlens.llm.common import python_stage, table, text_groups
from loanlens.llm.crf import Crf, fit, marginals, span_product

DOCS, RUNS, RUN = 300, 4, 32  # training documents of a language (about), runs of words of each, words of a run
HELD = 300_000  # words whose emissions a worker keeps
LONG, SPAN = 1_000_000, 50_000  # characters of a text that is tagged span by span, words of a span
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def held_out(id_col: Column) -> Column:
    """Rows that never teach: crc32 of the id as text is divisible by 5 (a null id teaches nothing)."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def training_runs(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id",
                  most_docs: int = DOCS) -> list[tuple[str, list[str]]]:
    """(language, words): runs of ``RUN`` words, ``RUNS`` of each of about ``most_docs`` documents a language.

    Documents are picked by a hash of id and text that falls below the share wanted of their language, runs by
    a hash of their place, over the whole text; so the sample is bounded whatever the table's size."""
    python_stage(docs.sparkSession)
    ids = F.col(f"`{id_col}`")
    known = (docs.where(ids.isNotNull() & ~held_out(ids))
             .select(F.col(f"`{lang_col}`").alias("_lang"), F.col(f"`{text_col}`").alias("_text"),
                     F.xxhash64(ids, F.col(f"`{text_col}`")).alias("_hash"))
             .where("_lang is not null and _text is not null"))
    counts = known.groupBy("_lang").agg(F.count(F.lit(1)).alias("_n"))  # a row per language
    share = F.least(F.lit(1.0), F.lit(float(most_docs)) / F.col("_n"))
    some = known.join(F.broadcast(counts), "_lang").where((F.pmod("_hash", F.lit(1 << 30)) / float(1 << 30)) < share)

    def cut(batches):
        for b in batches:
            lang, run = [], []
            for k, text, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                words = words_of(text)
                starts = range(0, len(words), RUN)
                for i in sorted(starts, key=lambda s: zlib.crc32(f"{h}:{s}".encode()))[:RUNS]:
                    lang.append(k)
                    run.append(" ".join(words[i:i + RUN]))
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(run, pa.string())], ["lang", "words"])

    rows = some.select("_lang", "_text", "_hash").mapInArrow(cut, "lang string, words string").collect()
    return sorted((r["lang"], r["words"].split()) for r in rows)


def spliced(runs: list[tuple[str, list[str]]], labels: list[str], seed: int = 7) -> list[tuple[list[str], list[int]]]:
    """Training chains: every run as it is, or (half of them) its first words followed by the last ones of another."""
    rng, number = random.Random(seed), {k: i for i, k in enumerate(labels)}
    out = []
    for lang, words in runs:
        chain, marks = words, [number[lang]] * len(words)
        other, more = runs[rng.randrange(len(runs))]
        if rng.random() < 0.5 and other != lang and len(words) > 1:
            cut = rng.randrange(1, len(words))
            chain = words[:cut] + more[cut:]
            marks = marks[:cut] + [number[other]] * len(more[cut:])
        out.append((chain, marks))
    return [c for c in out if c[0]]


def learn(docs: DataFrame, **cols) -> Crf:
    runs = training_runs(docs, **cols)
    labels = sorted({k for k, _ in runs})
    return fit(spliced(runs, labels), labels)


class Tagger:
    """Language shares of texts: emissions of words are kept, the chains of a batch run side by side."""

    def __init__(self, crf: Crf, most: int = HELD):
        self.crf, self.width = crf, len(crf.labels)
        self.table = np.zeros((most + 1, self.width))
        self.place: dict[str, int] = {}
        self.most = most

    def _emissions(self, words: list[str]) -> np.ndarray:
        """Emissions of words, one row each."""
        new = [w for w in dict.fromkeys(words) if w not in self.place]
        if new:
            if len(self.place) + len(new) > self.most:
                self.place.clear()
                new = list(dict.fromkeys(words))
                if len(new) > len(self.table):
                    self.table = np.zeros((len(new), self.width))
            start = len(self.place)
            for k in range(0, len(new), 20_000):
                part = new[k:k + 20_000]
                self.table[start + k:start + k + len(part)] = self.crf.emissions(part)
            self.place.update(zip(new, range(start, start + len(new))))
        return self.table[np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))]

    def words(self, text: str) -> tuple[list[str], np.ndarray]:
        """(words, P(language) of each): the labels of a code-switched text."""
        words = words_of(text)
        return words, self.crf.marginals(self._emissions(words) if words else np.zeros((0, self.width)), np.array([len(words)]))

    def _spans(self, text: str):
        """Emissions of the words of a very long text, SPAN words at a time."""
        words: list = []
        for w in _WORD.finditer(text.lower()):
            words.append(w.group())
            if len(words) == SPAN:
                yield self._emissions(words)
                words = []
        if words:
            yield self._emissions(words)

    def _long(self, text: str) -> np.ndarray:
        """Mean marginals of a very long text, exactly as of one chain: what its spans do to each other is worked out
        first, then each span with what reaches it, so memory follows the span."""
        moves = self.crf.moves
        m = np.exp(moves - moves.max())
        products = [span_product(e, moves) for e in self._spans(text)]
        if not products:
            return np.zeros(self.width)
        enter, leave = [np.ones(self.width)], [np.ones(self.width)]
        for p in products[:-1]:
            v = enter[-1] @ p @ m
            enter.append(v / v.sum())
        for p in reversed(products[1:]):
            v = m @ (p @ leave[-1])
            leave.append(v / v.sum())
        total, n = np.zeros(self.width), 0
        for e, before, after in zip(self._spans(text), enter, reversed(leave)):
            total += marginals(e, np.array([len(e)]), moves, before, after).sum(0)
            n += len(e)
        return total / n

    def shares(self, texts: list[str]) -> np.ndarray:
        """Mean marginals of each text's words; zeros for a text without letters (or without learned languages)."""
        out = np.zeros((len(texts), self.width))
        if not self.width:
            return out
        for group in text_groups(texts, LONG):
            if len(texts[group[0]]) > LONG:  # by itself
                out[group[0]] = self._long(texts[group[0]])
                continue
            parts = [words_of(texts[i]) for i in group]
            lengths = np.array([len(p) for p in parts], np.int64)
            some = np.flatnonzero(lengths)
            flat = [w for p in parts for w in p]
            if not flat:
                continue
            p = self.crf.marginals(self._emissions(flat), lengths[some])
            starts = np.cumsum(lengths[some]) - lengths[some]
            out[np.array(group)[some]] = np.add.reduceat(p, starts) / lengths[some, None]
        return out


_TAGGERS: dict = {}


def languages(docs: DataFrame, crf: Crf, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``lang_pred`` (the language with the largest share of the text's words, by the mean of their
    marginals; ties go to the first in order), ``score`` (that share, 0 to 1).

    Null texts and texts without a letter are ``und`` with score 0, and so is every text if no language was learned.  A
    text is one chain of words, whatever its length; rows are judged by themselves, so repeated rows, null ids and
    other columns change nothing; an empty table gives an empty result.  No shuffle."""
    spark = docs.sparkSession
    python_stage(spark)
    sent, token = spark.sparkContext.broadcast(crf), uuid.uuid4().hex

    def run(batches):
        tagger = _TAGGERS.get(token)
        if tagger is None:
            _TAGGERS.clear()
            tagger = _TAGGERS[token] = Tagger(sent.value)
        names = np.array([*tagger.crf.labels, "und"], object)
        for b in batches:
            p = tagger.shares([t or "" for t in b.column(1).to_pylist()])
            p = np.hstack([np.round(p, 12), np.zeros((len(p), 1))])
            best = np.where(p.sum(1) > 0, p.argmax(1), len(names) - 1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names[best].tolist(), pa.string()),
                                              pa.array(np.minimum(p[np.arange(len(p)), best], 1.0))], ["_id", "lang_pred", "score"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{text_col}`").alias("_text"))
    return rows.mapInArrow(run, "_id long, lang_pred string, score double").withColumnRenamed("_id", id_col)


def op12(spark, sf_dir: str) -> DataFrame:
    """Languages of all documents, learned from those that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = languages(docs, learn(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
