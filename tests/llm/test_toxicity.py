import itertools
import random
import zlib

import numpy as np
import pytest

from loanlens.llm import toxicity as X
from tests.llm.conftest import CLASH


def brute_kernel(a, b, decay=X.DECAY):
    """Sum over common three-letter subsequences of decay to both spans."""
    total = 0.0
    for i in itertools.combinations(range(len(a)), 3):
        for j in itertools.combinations(range(len(b)), 3):
            if all(a[x] == b[y] for x, y in zip(i, j)):
                total += decay ** (i[2] - i[0] + 1 + j[2] - j[0] + 1)
    return total


@pytest.mark.parametrize("a,b", [("idiot", "idiot"), ("idxiot", "idiot"), ("stupid", "stoopid"), ("aaa", "aaaa"), ("ab", "abc"), ("moron", "clown")])
def test_kernel_equals_brute_force(a, b):
    got = X.subsequence_kernel(X.padded([a], -1), X.padded([b], -2))[0]
    assert got == pytest.approx(brute_kernel(a, b), rel=1e-4)


def test_kernel_of_many_pairs_is_positive_definite():
    k = X.WordKernel(["idiot", "idiotic", "moron", "loser", "clown", "stupid"])
    gram = X._gram(k)
    assert np.allclose(gram, gram.T, atol=1e-5) and np.linalg.eigvalsh(gram).min() > -1e-6


def test_letter_pair_filter_keeps_what_counts():
    marks = ["idiot", "pathetic", "worthless"]
    k = X.WordKernel(marks)
    words = ["idiot", "idoit", "idxiot", "pathetik", "worthles", "the", "banana", "idiots"]
    r, c, v = k(words)
    got = {(words[i], marks[j]): x for i, j, x in zip(r, c, v)}
    for w, m in itertools.product(words, marks):
        full = (brute_kernel(w, m) / (brute_kernel(w, w) * brute_kernel(m, m)) ** 0.5) ** X.POWER if len(w) > 2 else 0
        if (w, m) in got:
            assert got[w, m] == pytest.approx(full, rel=1e-3)
        else:
            assert full < 0.1


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    syllables = ["an", "er", "the", "ou", "in", "ti", "re", "sh", "wh", "ble", "ha", "on"]
    bad = ["blorfik", "skrellun", "vagnoth", "drimplex"]
    texts, labels = [], []
    for i in range(400):
        t = int(rng.random() < 0.25)
        words = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(5, 120))]
        if t:
            for _ in range(2):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        for k in range(7, len(words), 8):
            words[k] += "."
        texts.append(" ".join(words))
        labels.append(t)
    return texts, labels, bad


def test_held_out_accuracy_and_gapped_words(corpus):
    texts, labels, bad = corpus
    model = X.fit(texts[:300], labels[:300])
    s = model.scorer().scores(texts[300:])
    assert np.mean((s >= 0.3) == np.array(labels[300:])) > 0.97
    for w in bad:
        forms = [w, w[:3] + "x" + w[3:], ".".join(w), " ".join(w), w[:4] + w[4] + w[4:], w.upper()]
        assert (model.scorer().scores([f"an er the {f} ou in." for f in forms]) >= 0.3).all(), w
    assert (model.scorer().scores(["", "the an er ou.", "on " * 500]) < 0.3).all()


def test_cache_never_changes_a_score(corpus):
    texts, labels, _ = corpus
    model = X.fit(texts[:300], labels[:300])
    a, b = model.scorer(), X.Scorer(model, 5)
    first = a.scores(texts)
    assert np.allclose(first, b.scores(texts), atol=0.02) and np.allclose(first, a.scores(texts), atol=0.02)


def test_rows(spark, make, awkward, corpus):
    model = X.fit(*corpus[:2])
    want = sorted(((i, round(float(model.scorer().scores([t or ""])[0]), 9)) for i, t in awkward), key=repr)
    for schema in (None, CLASH):
        df = make(awkward, schema) if schema else make(awkward)
        for carry in (None, df.columns):
            got = X.score(df, model, carry=carry).collect()
            assert sorted(((r.row.doc_id, round(r.score, 9)) for r in got), key=repr) == want
    assert X.score(make([]), model).count() == 0


def test_nothing_to_learn():
    for texts, labels in (([], []), (["a b c"], [0]), (["a b c"], [1])):
        s = X.fit(texts, labels).scorer().scores(["any text", ""])
        assert ((0 <= s) & (s <= 1)).all()


def test_sample_leaves_out_held_out_rows_and_null_labels(spark, make):
    ids = list(range(200))
    labels = spark.createDataFrame([(i, 1, i % 2 if i % 10 else None) for i in ids] + [(None, 0, 1)] + [(3, 1, 0)],
                                   "doc_id long, quality int, toxic int")
    texts, toxic = X.training_sample(make([(i, f"text {i}") for i in ids] + [(None, "x")]), labels)
    want = {f"text {i}" for i in ids if i % 10 and zlib.crc32(str(i).encode()) % 4 != 2}
    assert set(texts) == want and len(texts) == len(toxic)
    assert dict(zip(texts, toxic)).get("text 3", 1) == 1  # a row labelled twice is toxic if one label says so
    few, _ = X.training_sample(make([(i, f"text {i}") for i in ids]), labels, max_toxic=5, max_clean=7)
    assert len(few) == 12


def test_query_on_held_out_rows(spark):
    d = "/root/testdata/sf0.1"
    out = {r.doc_id: r for r in X.op1(spark, d).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    assert len(out) == spark.read.parquet(f"{d}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in out.items())
    held = [i for i in labels if out[i].held_out and labels[i] is not None]
    toxic, said = [i for i in held if labels[i]], [i for i in held if out[i].predicted]
    hits = sum(out[i].predicted for i in toxic)
    assert hits >= 0.9 * len(toxic) and hits >= 0.8 * len(said)  # toxic documents are few: accuracy would say nothing


def clean_words(rng, n):
    syllables = ["an", "er", "the", "ou", "in", "ti", "re", "sh", "wh", "ble", "ha", "on"]
    return ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n)]


def test_an_insult_counts_wherever_it_stands(corpus):
    texts, labels, bad = corpus
    scorer = X.fit(texts[:300], labels[:300]).scorer()
    for w in bad:
        places = [f"an er the {w}{end} ou in re." for end in (".", "!", "?", ",", "\n", " ", "?!", "...")]
        places += [f"an er {w}", f"an er {w}.", f"{w}. an er", f"({w}) an er", f'an "{w}." er']
        assert (scorer.scores(places) >= 0.3).all(), w


def test_insults_at_the_end_of_sentences_leave_clean_documents_alone():
    """Half the sample is toxic, always with the insult right before a full stop."""
    rng = random.Random(11)
    texts = [" ".join(clean_words(rng, 30)) + (f" {rng.choice(['blorfik', 'vagnoth'])}. " if i % 2 else ". ") + " ".join(clean_words(rng, 20))
             for i in range(600)]
    labels = [i % 2 for i in range(600)]
    s = X.fit(texts[:400], labels[:400]).scorer().scores(texts[400:])
    assert (s[0::2] >= 0.3).mean() <= 0.02 and (s[1::2] >= 0.3).mean() >= 0.98


def test_as_many_landmarks_as_there_are_insults():
    rng = random.Random(12)
    insults = sorted({"".join(rng.choice("bcdfgklmprtvz") + rng.choice("aeiouy") for _ in range(rng.randint(3, 5))) + rng.choice("xkq")
                      for _ in range(120)})
    insults += ["z" + "".join(rng.choice("bdgkmptvz") + rng.choice("aou") for _ in range(25))]  # longer than a window
    texts, labels = [], []
    for i in range(2000):
        words = clean_words(rng, 25)
        if i % 2:
            for w in [insults[i // 2 % len(insults)]] + [rng.choice(insults)] * (rng.random() < 0.3):
                words.insert(rng.randrange(len(words)), w)
        texts.append(" ".join(words) + ".")
        labels.append(i % 2)
    scorer = X.fit(texts, labels).scorer()
    caught = [w for w in insults if scorer.scores([f"an er the {w} ou in."])[0] >= 0.3]
    assert caught == insults
    assert (scorer.scores([" ".join(clean_words(rng, 40)) + "." for _ in range(200)]) >= 0.3).mean() <= 0.02


def test_document_scores_equal_brute_force(corpus):
    """The score from kernels of whole words by definition, without cache, batches or filter."""
    texts, labels, _ = corpus
    model = X.fit(texts[:300], labels[:300])
    got = model.scorer().scores(texts[300:320])
    for text, score in zip(texts[300:320], got):
        worst = 0.0
        for s in X._END.split(text.lower()):
            total = 0.0
            for w in {x for x in s.split()}:
                w = "".join(filter(str.isalnum, w))
                for m, beta in zip(model.marks, model.beta):
                    if len(w) >= 3:
                        k = (brute_kernel(w, m) / (brute_kernel(w, w) * brute_kernel(m, m)) ** 0.5) ** X.POWER
                        total += beta * k if k >= X.LEAST else 0.0
            worst = max(worst, total) if total else worst
        assert abs(score - 1 / (1 + np.exp(-(model.slope * (model.bias + worst) + model.shift)))) < 0.05
