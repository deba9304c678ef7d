import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from loanlens.llm import best_fit as B, packing
from tests.llm.conftest import CLASH


def fewest(lengths, capacity):
    """Fewest bins by trying all."""
    best = len(lengths)

    def go(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(lengths):
            best = len(bins)
            return
        for i in range(len(bins)):
            if bins[i] + lengths[k] <= capacity and bins[i] not in bins[:i]:
                go(k + 1, [*bins[:i], bins[i] + lengths[k], *bins[i + 1:]])
        go(k + 1, [*bins, lengths[k]])

    go(0, [])
    return best


def contents(bins):
    out = Counter()
    for kind, n in bins.items():
        for x in kind:
            out[x] += n
    return out


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 20), st.integers(1, 50), max_size=8))
def test_every_piece_once_and_no_bin_too_full(hist):
    first = B.best_fit(hist, 20)
    packed = B.local_search(first, 20)
    assert contents(first) == contents(packed) == Counter(hist)
    assert all(sum(k) <= 20 for k in packed)
    assert packed.total() <= first.total()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_near_the_fewest_bins(lengths):
    got, want = B.pack(Counter(lengths), 20).total(), fewest(lengths, 20)
    assert want <= got <= want + 1


def test_each_exchange_raises_squared_fill_and_swaps_empty_bins():
    # best fit needs 4 bins here, 3 hold all
    hist = Counter([6, 5, 5, 4, 4, 3, 3])
    first = B.best_fit(hist, 10)
    got = B.local_search(first, 10)
    square = lambda bins: sum(sum(k) ** 2 * n for k, n in bins.items())
    assert square(got) >= square(first)
    assert got.total() == 3


def test_bulk_equals_one_by_one():
    hist = {700: 5, 300: 7, 90: 13, 24: 40}
    bins = []
    for x in sorted(Counter(hist).elements(), reverse=True):
        fits = [i for i, b in enumerate(bins) if sum(b) + x <= 1024]
        if fits:
            i = max(fits, key=lambda j: sum(bins[j]))
            bins[i] = (*bins[i], x)
        else:
            bins.append((x,))
    assert B.best_fit(hist, 1024).total() == len(bins)


def test_kinds_do_not_grow_with_pieces():
    rng = np.random.default_rng(1)
    hist = Counter(rng.integers(1, 1024, 20_000).tolist())
    assert len(B.best_fit({k: 1000 * n for k, n in hist.items()}, 1024)) <= 3 * 1024


@pytest.mark.parametrize("clash", [False, True])
def test_packing_rows(spark, make, awkward, clash, monkeypatch):
    monkeypatch.setattr(packing, "RANK_ROWS", 2)  # many buckets for each length
    rows = awkward + [(100 + i, "same length here") for i in range(40)]
    df = make(rows, CLASH) if clash else make(rows)
    got = packing.best_fit_packing(df, P.path("byte_bpe_50k.json"), with_ids=True).collect()
    lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = Counter()
    for i, t in rows:
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 2]
        at = 0
        first = len(ids) % 1024 or 1024
        for j, end in enumerate(range(first, len(ids) + 1, 1024)):
            part = ids[at:end]
            want[(i, j, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), tuple(part))] += 1
            at = end
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, tuple(r.ids)) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(bins) <= -(-sum(r.length for r in got) // 1024) + 1


def test_empty_table(make):
    assert packing.best_fit_packing(make([]), P.path("byte_bpe_50k.json")).count() == 0


def test_both_patterns_cut_alike_where_the_plain_one_is_used():
    import re
    import regex
    full, plain = regex.compile(packing.SPLIT).findall, re.compile(packing.PLAIN_SPLIT).findall
    for c in map(chr, range(0x30000)):
        text = f"a{c} {c}1{c} {c}{c}. '{c}s"
        if not "\ud800" <= c <= "\udfff" and packing._is_plain(text):
            assert full(text) == plain(text), hex(ord(c))


def test_search_has_no_step_limit():
    """A hard histogram ends at the bound or where no pair of kinds has an exchange left."""
    import random
    rng = random.Random(5)
    hist = Counter(rng.choice([341, 342, 343, 205, 206, 147, 129, 257, 258, 171]) + rng.randint(-40, 40) for _ in range(3000))
    first = B.best_fit(hist, 1024)
    got = B.local_search(first, 1024)
    assert contents(got) == hist and got.total() <= first.total()
    bound = -(-sum(x * n for x, n in hist.items()) // 1024)
    if got.total() > bound:
        under = [k for k in got if sum(k) < 1024]
        assert not any(B._exchanges(r, d, 1024 - sum(r)) for d in under for r in under if sum(r) >= sum(d) and (d != r or got[d] > 1))
