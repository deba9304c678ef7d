import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loanlens.llm import crf as C
from loanlens.llm import language_id as L
from loanlens.llm.common import table
from tests.llm.conftest import CLASH

RNG = np.random.default_rng(3)


def enumerated(e, a):
    """Marginals by all label sequences."""
    n, w = e.shape
    out, z = np.zeros((n, w)), 0.0
    for path in itertools.product(range(w), repeat=n):
        p = np.exp(sum(e[t, k] for t, k in enumerate(path)) + sum(a[i, j] for i, j in zip(path, path[1:])))
        z += p
        for t, k in enumerate(path):
            out[t, k] += p
    return out / z, np.log(z)


def one_by_one(e, a):
    """Forward-backward over one chain, word by word."""
    f, m = [np.exp(e[0])], np.exp(a)
    for x in e[1:]:
        f.append((f[-1] / f[-1].sum()) @ m * np.exp(x))
    b = [np.ones(e.shape[1])]
    for x in e[:0:-1]:
        v = m @ (np.exp(x) * b[-1])
        b.append(v / v.sum())
    p = np.array(f) * np.array(b[::-1])
    return p / p.sum(1, keepdims=True)


def test_marginals_equal_enumeration():
    a = RNG.normal(size=(3, 3))
    lengths = [1, 4, 2, 6]
    es = [RNG.normal(size=(n, 3)) for n in lengths]
    got = C.marginals(np.vstack(es), lengths, a)
    assert np.allclose(got, np.vstack([enumerated(e, a)[0] for e in es]))
    log_z, p, pairs = C.log_partition(np.vstack(es), lengths, a)
    assert np.isclose(log_z, sum(enumerated(e, a)[1] for e in es)) and np.allclose(p, got)
    assert np.isclose(pairs.sum(), sum(n - 1 for n in lengths))


def test_long_chains_in_blocks():
    a = RNG.normal(size=(4, 4)) * 2
    lengths = [1, 64, 65, 700, 128, 3, 1300]
    es = [RNG.normal(size=(n, 4)) * 3 for n in lengths]
    got = C.marginals(np.vstack(es), lengths, a)
    assert np.allclose(got, np.vstack([one_by_one(e, a) for e in es]), atol=1e-9)


def test_gradient():
    """The step that training takes agrees with differences of its objective."""
    e, a = RNG.normal(size=(9, 2)), RNG.normal(size=(2, 2))
    _, p, pairs = C.log_partition(e, [4, 5], a)
    for i, k in ((0, 0), (3, 1), (8, 0)):
        d = np.zeros_like(e)
        d[i, k] = 1e-5
        assert np.isclose((C.log_partition(e + d, [4, 5], a)[0] - C.log_partition(e - d, [4, 5], a)[0]) / 2e-5, p[i, k], atol=1e-6)
    for i, k in itertools.product(range(2), repeat=2):
        d = np.zeros_like(a)
        d[i, k] = 1e-5
        assert np.isclose((C.log_partition(e, [4, 5], a + d)[0] - C.log_partition(e, [4, 5], a - d)[0]) / 2e-5, pairs[i, k], atol=1e-6)


def test_features_of_a_word_do_not_depend_on_the_others():
    words = ["a", "straße", "the", "日本", "thé", "x" * 300]
    who, what = C.features(words)
    for i, w in enumerate(words):
        alone = C.features([w])[1]
        assert sorted(what[who == i]) == sorted(alone)


@pytest.fixture(scope="module")
def toy():
    rng = random.Random(8)
    vocab = {"xx": ["lumo", "lumar", "lumest", "olume"], "yy": ["krat", "kratz", "unkrat", "kratum"], "zz": ["pify", "pifo", "epif", "pifal"]}
    runs = sorted((k, [rng.choice(v) for _ in range(rng.randint(3, 20))]) for k, v in vocab.items() for _ in range(40))
    labels = sorted(vocab)
    return C.fit(L.spliced(runs, labels), labels), vocab


def test_code_switched_words_get_their_own_labels(toy):
    crf, vocab = toy
    tagger = L.Tagger(crf)
    text = "Lumo, lumar lumest! Krat kratz unkrat; krat. Pifal epif"
    words, p = tagger.words(text)
    want = [next(i for i, k in enumerate(crf.labels) if w in vocab[k]) for w in words]
    assert p.argmax(1).tolist() == want
    assert (np.diag(crf.moves) > crf.moves.max(1) - 1e-9).all()  # a text seldom changes its language
    unknown = tagger.words("lumo lumar qqqq lumest")[1]
    assert unknown[2].argmax() == 0  # what stands around a word decides where its letters don't


def test_spans_of_a_very_long_text_are_one_chain(toy, monkeypatch):
    tagger = L.Tagger(toy[0])
    rng = random.Random(2)
    text = " ".join(rng.choice(rng.choice(list(toy[1].values()))) for _ in range(3000))
    whole = tagger.shares([text])[0]
    monkeypatch.setattr(L, "LONG", 1000)
    monkeypatch.setattr(L, "SPAN", 170)
    assert np.allclose(L.Tagger(toy[0]).shares([text, "krat"])[0], whole)


def test_small_cache_gives_the_same(toy):
    texts = [" ".join(v) for v in toy[1].values()] * 3
    assert np.allclose(L.Tagger(toy[0], 5).shares(texts), L.Tagger(toy[0]).shares(texts))


def test_awkward_rows(make, awkward, toy):
    rows = awkward + [(9, "12345 !!! ٣٤"), (10, "krat " * 300_000)]
    for schema in ({}, {"schema": CLASH}):
        got = sorted((tuple(r) for r in L.languages(make(rows, **schema), toy[0]).collect()), key=repr)
        assert len(got) == len(rows)
        for i, lang, score in got:
            assert 0 <= score <= 1
            assert (lang == "und") == (i in (2, 3, 4, 9)) and (score > 0) == (lang != "und")
    assert L.languages(make([]), toy[0]).collect() == []


def test_nothing_to_learn_from(make):
    crf = L.learn(make([(1, "no language is given")]))
    assert [tuple(r) for r in L.languages(make([(1, "text")]), crf).collect()] == [(1, "und", 0.0)]


def test_sample_is_bounded_and_leaves_held_out_rows(spark):
    rows = [(i, f"word{'abcdefghij'[i % 10]} text here " * 40, "xx" if i % 3 else "yy", None, None) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    runs = L.training_runs(df, most_docs=50)
    for k in ("xx", "yy"):
        assert 25 * L.RUNS <= sum(lang == k for lang, _ in runs) <= 85 * L.RUNS
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    only = spark.createDataFrame(held, df.schema)
    assert L.training_runs(only) == []


def test_query_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    out = L.op12(spark, sf).join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    rows = out.where("lang is not null").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    for k in sorted({r.lang for r in rows}):
        mine = [r for r in rows if r.held_out and r.lang == k]
        found = [r for r in rows if r.held_out and r.lang_pred == k]
        hits = sum(r.lang_pred == k for r in mine)
        assert hits >= 0.95 * len(mine) and hits >= 0.95 * len(found), k
    assert out.where(F.col("score") < 0).count() == 0
