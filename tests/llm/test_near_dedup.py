import random

import numpy as np
import pytest

from loanlens.llm import near_dedup as N, superminhash as S
from loanlens.llm.common import Scratch
from loanlens.llm.components import components
from tests.llm.conftest import CLASH


def shingles(text, k):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + k]) for i in range(len(words) - k + 1)) if len(words) >= k else frozenset([tuple(words)])


def brute(rows, k=4, percent=80):
    sets = [(i, shingles(t, k)) for i, t in rows]
    comp = {i: i for i, _ in sets if i is not None}
    changed = True
    while changed:
        changed = False
        for i, a in sets:
            for j, b in sets:
                if i is not None and j is not None and i != j and a and 100 * len(a & b) >= percent * len(a | b):
                    low = min(comp[i], comp[j])
                    if comp[i] != low or comp[j] != low:
                        comp[i] = comp[j] = low
                        changed = True
    return sorted(((i, len(s), comp.get(i), comp.get(i) == i) for i, s in sets), key=repr)


def run(df, **kw):
    return sorted((tuple(r) for r in N.near_dedup(df, **kw).collect()), key=repr)


def edited(rng, words, share):
    out = list(words)
    for _ in range(max(1, int(share * len(out)))):
        out[rng.randrange(len(out))] = f"w{rng.randrange(10**6)}"
    return out


def test_shingle_sets_equal_brute_force():
    rng = random.Random(1)
    texts = ["", " ", "a", "A b", "x y z", "w x y", "Ä ä b c d"] + [
        " ".join(rng.choice("abc") for _ in range(rng.randint(0, 30))) for _ in range(200)]
    for k in (1, 2, 4, 5, 11):
        value, n = S.shingle_sets(texts, k)
        assert n.tolist() == [len(shingles(t, k)) for t in texts]
        sets = [frozenset(x.tolist()) for x in np.split(value, np.cumsum(n)[:-1])]
        by = {}
        for t, s in zip(texts, sets):
            assert by.setdefault(shingles(t, k), s) == s
        assert len(set(sets)) == len(by)


def sequential(values, m):
    """The signature with one element after the other and all steps, without stopping early."""
    sig = [(1 << 64) - 1] * m
    for v in values:
        p = list(range(m))
        for j in range(m):
            r = int(S.mix(np.array([v], np.uint64) + np.uint64((j + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))[0])
            k = j + ((r & 0xFFFFFFFF) * (m - j) >> 32)
            p[j], p[k] = p[k], p[j]
            sig[p[j]] = min(sig[p[j]], j << 52 | r >> 12)
    return sig


def test_signatures_equal_one_by_one():
    rng = np.random.default_rng(3)
    size = np.array([0, 1, 2, 7, 40, 300])
    value = rng.integers(0, 1 << 63, size.sum()).astype(np.uint64)
    sig = S.signatures(value, size, 32)
    for i, part in enumerate(np.split(value, np.cumsum(size)[:-1])):
        assert sig[i].tolist() == sequential(part.tolist(), 32)


def test_nibbles_agree_where_places_do():
    rng = np.random.default_rng(4)
    size = np.array([150, 150, 3])
    value = rng.integers(0, 1 << 63, size.sum()).astype(np.uint64)
    value[150:290] = value[:140]
    sig = S.signatures(value, size, 1024)
    assert (sig < 1 << 63).all() and len(np.unique(sig[2] >> np.uint64(52))) > 1
    low = S.nibbles(sig)
    for a in range(3):
        for b in range(3):
            x = low[a] ^ low[b]
            bits = sum(bin(int((v | v >> 1 | v >> 2 | v >> 3) & 0x1111111111111111)).count("1") for v in map(int, x))
            assert 1024 - bits == int((sig[a] & np.uint64(15) == sig[b] & np.uint64(15)).sum())


def test_likeness_estimate_has_low_variance():
    rng = np.random.default_rng(5)
    errors = []
    for _ in range(60):
        both, a, b = (rng.integers(0, 1 << 63, n).astype(np.uint64) for n in (60, 20, 20))
        sig = S.signatures(np.concatenate([both, a, both, b]), np.array([80, 80]), 64)
        errors.append((sig[0] == sig[1]).mean() - 0.6)
    assert abs(np.mean(errors)) < 0.03
    assert np.var(errors) < 0.6 * 0.4 / 64  # below that of plain MinHash


@pytest.mark.parametrize("k", [4, 5])
def test_equals_brute_force(make, k):
    rng = random.Random(k)
    rows, n = [], 0
    passage = [f"p{i}" for i in range(30)]
    for _ in range(12):
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(5, 120))]
        for share in (0, 0, 0.01, 0.02, 0.04, 0.06, 0.1):
            rows.append((n, " ".join(edited(rng, base, share) if share else base)))
            n += 1
        rows.append((n, " ".join(base[:40] + passage)))
        n += 1
    rng.shuffle(rows)
    assert run(make(rows), k=k) == brute(rows, k)


def test_bands_and_filter_follow_percent(make):
    assert N.settings(80) == N.settings(95) == (48, 7, 1576)
    for percent in range(5, 81):
        bands, rows, agreeing = N.settings(percent)
        assert (1 - (percent / 100) ** rows) ** bands <= 1.3e-5 and bands * rows <= 336
        assert agreeing < 2048 * (percent / 100 + (1 - percent / 100) / 16) - 60
    for percent in (4, 101):
        with pytest.raises(ValueError):
            N.settings(percent)
    # sets of 100 words of which 75 are common: a likeness of 0.6
    rows = [(2 * i + j, " ".join(f"w{i}x{n}" for n in range(25 * j, 100 + 25 * j))) for i in range(60) for j in (0, 1)]
    assert all(r[2] == r[0] // 2 * 2 for r in run(make(rows), k=1, percent=60))
    assert all(r[2] == r[0] for r in run(make(rows), k=1, percent=61))


def test_chain_and_large_groups(make):
    rng = random.Random(9)
    base = [f"b{i}" for i in range(200)]
    rows, cur = [], base
    for i in range(40):  # neighbours are alike, the ends are not
        rows.append((1000 - i, " ".join(cur)))
        cur = cur[6:] + [f"n{i}_{j}" for j in range(6)]
    rows += [(2000 + i, " ".join(edited(rng, base, 0.03))) for i in range(120)]
    rows += [(3000 + i, "the same short text") for i in range(200)]
    assert run(make(rows), k=4) == brute(rows, 4)


def test_awkward_rows(make, awkward):
    want = brute(awkward, 4)
    assert run(make(awkward), k=4) == run(make(awkward, CLASH), k=4) == want
    assert run(make([])) == []


def test_components(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(7, 7), (None, 3), (500, 501)] * 2
    df = spark.createDataFrame(links, "a long, b long")
    got = {r.node: r.component for r in components(df, Scratch(spark)).collect()}
    nodes = {x for a, b in links if None not in (a, b) and a != b for x in (a, b)}
    comp = {x: x for x in nodes}
    for _ in nodes:
        for a, b in links:
            if a in comp and b in comp:
                comp[a] = comp[b] = min(comp[a], comp[b])
    assert got == comp
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark)).count() == 0
