"""Word shingles and SuperMinHash signatures of batches of texts, in numpy.

SuperMinHash gives every element one random permutation of the ``m`` signature places; its j-th place gets
the value j + r with r in 0..1, and each place keeps the least value it is given.  Values of step j
are below j + 1, so once all places of a signature are below j + 1 later steps can't change it:
all elements of a batch take step 0 at once, then the elements of signatures that are not full yet take
step 1, and so on.  Long texts end after a step or two."""

from __future__ import annotations

import numpy as np

U = np.uint64
_ERR = {"over": "ignore"}
BASE = U(0x9E6C63D0876A9A35)
INVERSE = U(pow(int(BASE), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every input bit changes about half of the output bits."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts (A-Z lower-cased, split at ASCII white space) and words per text."""
    raw = [t.encode().lower() for t in texts]
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    buf = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    space = (buf == 32) | ((buf >= 9) & (buf <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space])))
    start, end = edge[::2], edge[1::2]
    power = np.full(len(buf) + 1, BASE)
    power[0] = 1
    power = np.multiply.accumulate(power)
    total = np.concatenate([[U(0)], np.cumsum((buf.astype(U) + U(1)) * power[:-1])])
    back = np.full(len(buf) + 1, INVERSE)
    back[0] = 1
    back = np.multiply.accumulate(back)
    h = mix((total[end] - total[start]) * back[start] + (end - start).astype(U))
    first = np.cumsum(size + 1) - size - 1
    return h, np.diff(np.append(np.searchsorted(start, first), len(start)))


def shingle_sets(texts: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of ``k``-word shingles of all texts, sorted within each text, and how many each has.
    A text with fewer words has its whole sequence as one shingle; without words it has none."""
    h, words = word_hashes(texts)
    doc = np.repeat(np.arange(len(texts)), words)
    odd = [U(2 * x + 1) for x in (0x5851F42D4C957F2D, 0x14057B7EF767814F, 0x2545F4914F6CDD1D, 0x27D4EB2F165667C5,
                                  0x369DEA0F31A53F85, 0x1B03738712FAD5C9, 0x4F1BBCDCBFA53E0B, 0x61C8864680B583EB)]
    mul = [mix(np.array([odd[i % 8] + U(i // 8)]))[0] | U(1) for i in range(max(k, 1))]
    ends = np.cumsum(words)
    nth = np.arange(len(h)) - np.repeat(ends - words, words)
    left = np.repeat(words, words) - nth  # words from here to the end of the text
    full = np.flatnonzero(left >= k)
    value = np.zeros(len(full), U)
    for i in range(k):
        value += h[full + i] * mul[i]
    value, owner = mix(value + U(k)), doc[full]
    short = np.flatnonzero((words > 0) & (words < k))
    if len(short):
        few = np.zeros(len(short), U)
        for i in range(k - 1):
            has = words[short] > i
            few[has] += h[(ends - words)[short[has]] + i] * mul[i]
        value = np.concatenate([value, mix(few + words[short].astype(U))])
        owner = np.concatenate([owner, short])
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    return value[new], np.bincount(owner[new], minlength=len(texts))


def signatures(value: np.ndarray, size: np.ndarray, m: int) -> np.ndarray:
    """SuperMinHash signatures (texts, m) of ragged sets; a value holds its step in the top 12 bits.  m <= 4096."""
    n = len(size)
    sig = np.full((n, m), ~U(0))
    flat = sig.reshape(-1)
    doc = np.repeat(np.arange(n), size)
    perm = None
    for j in range(m):
        if not len(value):
            break
        r = mix(value + U((j + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
        k = j + ((r & U(0xFFFFFFFF)) * U(m - j) >> U(32)).astype(np.int64)
        if j == 0:
            place, first = k, k
        else:
            if perm is None:  # only elements that go past step 0 need their permutation
                perm = np.broadcast_to(np.arange(m, dtype=np.uint8 if m <= 256 else np.uint16), (len(value), m)).copy()
                row = np.arange(len(value))
                perm[row, 0], perm[row, first] = first, 0
            row = np.arange(len(value))
            place = perm[row, k].astype(np.int64)
            perm[row, k] = perm[row, j]
        np.minimum.at(flat, doc * m + place, U(j) << U(52) | r >> U(12))
        open_ = np.zeros(n, bool)
        live = np.unique(doc)
        open_[live] = sig[live].max(1) >> U(52) > U(j)
        keep = open_[doc]
        if not keep.all():
            value, doc, first = value[keep], doc[keep], first[keep]
            perm = None if perm is None else perm[keep]
    return sig


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(texts, bands) keys, each of ``rows`` places; places are dealt in fixed shuffled order, again from the
    start of another shuffle when all are used."""
    rng = np.random.default_rng(7)
    need = bands * rows
    places = np.concatenate([rng.permutation(sig.shape[1]) for _ in range(-(-need // sig.shape[1]))])[:need].reshape(bands, rows)
    key = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=U)), (len(sig), bands)).copy()
    for i in range(rows):
        key = mix(key * U(0x9E3779B97F4A7C15) + sig[:, places[:, i]])
    return key


def nibbles(sig: np.ndarray) -> np.ndarray:
    """The low four bits of each place of each signature, sixteen to a number."""
    low = (sig & U(15)).reshape(len(sig), -1, 16) << (U(4) * np.arange(16, dtype=U))
    return np.bitwise_or.reduce(low, axis=2)
