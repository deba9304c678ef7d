import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from loanlens.llm import packing, sentencepieces as SP, token_counts as T
from tests.llm.conftest import CLASH

ODD = ["", " ", "a  b", "a   b ", " a", "Hello<|endoftext|> x <|startoftext|>y", "\n <|endoftext|> a\n\n b \n c\n", "aaaaaaa aaaa",
       "ΣΑΣ İx don't I'VE 12 34", "\x1cx\x1d y\x85z\xa0w", "日本語 テスト", "é é", "🙂🙂 a_b", "z" * 300]


def texts(n=400):
    rng = random.Random(5)
    marks = [" ", "\n", "a", "b", "1", "'s", ".", "　", "é", "\x1c", "\t", "the", "ing"]
    return ODD + ["".join(rng.choice(marks) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_counts_equal_the_library():
    own = T.Counter(open(P.path("word_bpe_49k.json")).read())
    lib = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = [len(e.ids) for e in lib.encode_batch(texts(), add_special_tokens=False)]
    assert own.counts(texts()) == want
    assert own.counts(texts()) == want  # from the cache
    own.cache.clear()
    own.cache.half = 10  # a cache that is always full
    assert own.counts(texts()) == want


def test_long_text_is_cut_at_white_space(monkeypatch):
    own = T.Counter(open(P.path("word_bpe_49k.json")).read())
    text = "some words of a long text, " * 400
    whole = own.counts([text])
    monkeypatch.setattr(T, "SEGMENT", 100)
    assert own.counts([text]) == whole


def test_ids_equal_the_library(monkeypatch):
    own = packing.TextIds(open(P.path("byte_bpe_50k.json")).read())
    lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = [np.array(e.ids, "<u4").tobytes() for e in lib.encode_batch(texts(), add_special_tokens=False)]
    assert own.ids(texts()) == want
    monkeypatch.setattr(packing, "SEGMENT", 10)
    assert own.ids(texts()) == want


def test_token_counts_rows(spark, make, awkward):
    path = P.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    want = sorted(((i, len((t or "").encode()), n := len(lib.encode(t or "", add_special_tokens=False).ids), n > 2048)
                   for i, t in awkward), key=repr)
    for schema in (None, CLASH):
        df = make(awkward, schema) if schema else make(awkward)
        assert sorted((tuple(r) for r in T.token_counts(df, path).collect()), key=repr) == want
    assert T.token_counts(make([]), path).count() == 0


@pytest.fixture(scope="module")
def pieces():
    return SP.Pieces(open(P.path("piece_bpe_32k.model"), "rb").read(), 4)


def lattice_library():
    """The library over the same pieces and scores, with the model type that searches the lattice."""
    raw = open(P.path("piece_bpe_32k.model"), "rb").read()
    changed = raw.replace(b"tok_v0\x18\x02", b"tok_v0\x18\x01")
    assert changed != raw
    lib = sentencepiece.SentencePieceProcessor()
    lib.load_from_serialized_proto(changed)
    return lib


def test_nbest_scores_equal_the_library(pieces):
    lib = lattice_library()
    rng = random.Random(2)
    words = ["the", "thnterble", "a", "idiot", "Geschichte", "élan", "ab", "  ", "\n", "日本"]
    for _ in range(150):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(1, 6)))
        got = [s for s, _ in pieces.encode([text])[0]]
        want = [n.score for n in lib.nbest_encode(text, nbest_size=4, return_type="proto").nbests]
        assert len(got) == len(want), text
        assert got == sorted(got, reverse=True)
        assert all(abs(a - b) <= 1e-6 * abs(a) + 0.6 for a, b in zip(got, want)), text  # the library adds in float32


def brute_segmentations(pieces, word):
    if not word:
        return [(0.0, ())]
    out = []
    for k in range(1, len(word) + 1):
        p = word[:k]
        s = pieces.scores.get(p, pieces.unknown if k == 1 else None)
        if s is not None:
            out += [(s + t, (p, *rest)) for t, rest in brute_segmentations(pieces, word[k:])]
    return out


def test_nbest_equals_brute_force(pieces):
    for text in ["a b", "ab abe", "hello", "x  y", "been in", "\nab"]:
        marked = SP.SPACE + text.replace(" ", SP.SPACE)
        want = sorted((s for s, _ in brute_segmentations(pieces, marked)), reverse=True)[:4]
        best = pieces.encode([text])[0]
        assert [s for s, _ in best] == want
        assert len({raw for _, raw in best}) == len(best)
        assert all(pieces.decode(raw) == text for _, raw in best)


def test_round_trip_rows(spark, make, awkward):
    path = P.path("piece_bpe_32k.model")
    for schema in (None, CLASH):
        df = make(awkward, schema) if schema else make(awkward)
        out = SP.encode(df, path, with_ids=True)
        rows = out.collect()
        assert len(rows) == len(awkward) and all(r.round_trip for r in rows)
        assert all(r.n_tokens == len(r.ids[0]) and r.ids_crc32 == zlib.crc32(np.array(r.ids[0], "<u4").tobytes()) for r in rows)
        assert all(list(r.scores) == sorted(r.scores, reverse=True) for r in rows)
    from pyspark.sql import functions as F
    back = SP.decode(out.select("doc_id", F.col("ids")[0].alias("ids")), path).collect()
    assert sorted(map(repr, ((r.doc_id, r.text) for r in back))) == sorted(map(repr, ((i, t or "") for i, t in awkward)))
    assert SP.encode(make([]), path).count() == 0


def test_mark_reads_as_space(pieces):
    assert pieces.encode(["a▁b"]) == pieces.encode(["a b"])


def unit_text(rng, n):
    return "".join(rng.choice(["the", "an", "schaft", "é", "日", "本", "x", "ab", "a", "9"]) for _ in range(n))


def test_long_units_equal_shared_lattices(pieces, monkeypatch):
    """The search by itself gives what the shared lattice gives, ties and characters without a piece included."""
    rng = random.Random(6)
    texts = [unit_text(rng, n) for n in (1, 2, 5, 40, 300)] + ["a" * 200, "日" * 50, "ab " * 30 + unit_text(rng, 80)]
    want = pieces.encode(texts)
    model = open(P.path("piece_bpe_32k.model"), "rb").read()
    monkeypatch.setattr(SP, "LONG", 3)
    monkeypatch.setattr(SP, "AREA", 50)
    got = SP.Pieces(model, 4).encode(texts)
    assert [[raw for _, raw in x] for x in got] == [[raw for _, raw in x] for x in want]
    assert all(np.allclose([s for s, _ in x], [s for s, _ in y]) for x, y in zip(got, want))


def test_nbest_of_long_units_equals_brute_force(pieces):
    for text in ["abab", "aaaa", "banan", "日本ab"]:
        want = sorted(brute_segmentations(pieces, SP.SPACE + text), key=lambda x: (-x[0], [-len(p) for p in reversed(x[1])]))[:4]
        got = pieces.segmentations(SP.SPACE + text)
        assert np.allclose([s for s, _ in got], [s for s, _ in want])


def test_a_very_long_unit_beside_many_words(pieces):
    """A million characters without a space and 50,000 words need tens of megabytes, not gigabytes."""
    import resource
    rng = random.Random(7)
    text = unit_text(rng, 480_000)[:1_000_000]
    words = " ".join("".join(rng.choice("abcdefgh") for _ in range(9)) for _ in range(50_000))
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    (one, two) = pieces.encode([text, words])
    grown = (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024
    assert pieces.decode(one[0][1]) == text and pieces.decode(two[0][1]) == words
    assert len(one) == 4 and len({raw for _, raw in one}) == 4
    assert grown < 700, grown
