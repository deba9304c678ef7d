import hashlib
import random

import duckdb

from loanlens.llm import fingerprints as FP
from tests.llm.conftest import CLASH


def sketches(s):
    return {s[j:j + 2]: s[j + 2:j + 8] for j in range(0, len(s), 8)}


def near(a, b):
    a, b = sketches(a), sketches(b)
    both = a.keys() | b.keys()
    return sum(a.get(x) == b.get(x) for x in both) / len(both) if both else 1.0


def check(rows, got):
    """Everything but the prints themselves, from the plain definition; prints of equal texts are equal."""
    order = sorted([(i, t or "") for i, t in rows if i is not None])
    prints = {}
    assert len(got) == len(rows)
    want = []
    for k, (i, t) in enumerate(order):
        nxt = order[(k + 1) % len(order)][1]
        want.append((i, t, nxt))
    want += [(None, t or "", "") for i, t in rows if i is None]
    have = {}
    for r in got:
        have.setdefault((r.doc_id, r.n_chars, r.edited_sha256), []).append(r)
    for i, t, nxt in want:
        half = len(t) // 2
        e = t[:len(t) - half] + nxt[:half]
        r = have[i, len(t), hashlib.sha256(e.encode()).hexdigest()].pop()
        for text, p in ((t, r.fingerprint), (e, r.edited_fingerprint)):
            assert prints.setdefault(text, p) == p
            assert (p == "") == (not text.split())
        assert abs(r.near_edited - near(r.fingerprint, r.edited_fingerprint)) < 1e-12
    for r, (i, t, nxt) in ((r, w) for w in want for r in got if r.doc_id == w[0] and prints[w[1]] == r.fingerprint):
        if [w[0] for w in want].count(i) == 1 and nxt in prints:
            assert abs(r.near_next - near(r.fingerprint, prints[nxt])) < 1e-12
    return prints


def run(df):
    return FP.fingerprints(df).collect()


def test_awkward_rows(make, awkward):
    check(awkward, run(make(awkward)))
    check(awkward, run(make(awkward, CLASH)))


def test_several_ranges_and_the_circle(make, monkeypatch):
    monkeypatch.setattr(FP, "TASK_CHARS", 2000)
    rng = random.Random(1)
    rows = [(7 * i - 300, " ".join(rng.choice(["a", "b", "cc", "dd", "e"]) for _ in range(rng.randint(0, 40)))) for i in range(200)]
    rng.shuffle(rows)
    check(rows, run(make(rows)))


def test_one_document_is_next_to_itself(make):
    (r,) = run(make([(5, "one two three four five")]))
    assert r.near_next == 1.0


def test_empty_table(make):
    assert run(make([])) == []


def test_order_of_words_counts(make):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    half = words[200:] + words[:200]  # the same words and nearly the same k-mers, moved
    few = words.copy()
    for _ in range(4):
        few[rng.randrange(400)] = "new"
    repeated = ["same", "words", "here"] * 100
    rows = [(1, " ".join(words)), (2, " ".join(half)), (3, " ".join(few)), (4, " ".join(repeated)), (5, " ".join(repeated[:150]))]
    p = {r.doc_id: r.fingerprint for r in run(make(rows))}
    assert near(p[1], p[3]) > 0.8
    assert near(p[1], p[2]) < near(p[1], p[3]) - 0.2
    assert near(p[4], p[5]) < 0.8  # occurrences are numbered: a text repeated twice as often is another one


def test_likeness_falls_with_edits(make):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(500)]
    rows = [(0, " ".join(words))]
    for k, n in enumerate((5, 25, 100, 300), 1):
        e = words.copy()
        for _ in range(n):
            e[rng.randrange(500)] = f"x{rng.random()}"
        rows.append((k, " ".join(e)))
    p = {r.doc_id: r.fingerprint for r in run(make(rows))}
    line = [near(p[0], p[k]) for k in range(1, 5)]
    assert line == sorted(line, reverse=True) and line[0] > 0.85 and line[-1] < 0.2


def test_query(spark):
    d = "/root/testdata/sf0.001"
    rows = duckdb.sql(f"select doc_id, text from '{d}/documents.parquet'").fetchall()
    got = FP.op4(spark, d).collect()
    check(rows, got)
    assert "Python" not in FP.op4(spark, d)._jdf.queryExecution().toString()
    assert sum(r.near_edited > r.near_next for r in got) > 0.9 * len(got)
