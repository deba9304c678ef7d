"""A linear-chain conditional random field over the words of a text: labels are languages.

    P(labels | words) ~ exp(sum of e(word_t, label_t) + sum of a(label_t, label_t+1))

``e`` adds the weights of a word's features: letter pairs and triples with the word's ends marked, beginnings and ends
of one to four letters, the word itself, and whether the lexicon of a language has it.  Features are hashed to a
fixed number of weights.  ``a`` are learned transitions.  Marginals come from forward-backward, exactly, for chains of
any length: blocks of a chain are multiplied side by side, the blocks of one chain follow one another, and then all
blocks run inside with the vectors that reach them."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BUCKETS = 1 << 18  # hashed features
BLOCK = 64  # words that are multiplied side by side
ENDS = 1, 2  # code points that stand for the beginning and the end of a word
_MIX, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x100000001B3)
AFFIX = 4


def _bucket(h: np.ndarray, salt: int) -> np.ndarray:
    h = (h ^ np.uint64(salt * 0x51ED2701)) * _MIX
    h ^= h >> np.uint64(29)
    return ((h * _MIX) >> np.uint64(64 - 18)).astype(np.int64)


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word index, bucket) of every feature but the lexicons', sorted by word within each kind."""
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    ends = np.cumsum(size)
    first = ends - size
    codes = np.empty(int(ends[-1]) if len(words) else 0, np.uint64)
    inner = np.ones(len(codes), bool)
    inner[first] = inner[ends - 1] = False
    codes[first], codes[ends - 1] = ENDS
    codes[inner] = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    owner = np.repeat(np.arange(len(words)), size)
    who, what = [], []
    pair = codes[:-1] * _STEP + codes[1:]
    same = owner[:-1] == owner[1:]
    who.append(owner[:-1][same])
    what.append(_bucket(pair[same], 2))
    if len(codes) > 2:
        triple = pair[:-1] * _STEP + codes[2:]
        same = owner[:-2] == owner[2:]
        who.append(owner[:-2][same])
        what.append(_bucket(triple[same], 3))
    whole = np.zeros(len(words), np.uint64)
    for salt, step in ((10, 1), (20, -1)):  # beginnings, then ends, one letter longer each time
        h = np.zeros(len(words), np.uint64)
        for n in range(1, AFFIX + 1):
            some = np.flatnonzero(size - 2 >= n)
            at = (first[some] + n) if step > 0 else (ends[some] - 1 - n)
            h[some] = h[some] * _STEP + codes[at] + np.uint64(n)
            who.append(some)
            what.append(_bucket(h[some], salt + n))
    if len(words):
        place = np.arange(len(codes)) - first[owner]
        powers = np.power(_STEP, np.minimum(place, 1 << 20).astype(np.uint64))
        whole = np.add.reduceat(codes * powers, first)
        who.append(np.arange(len(words)))
        what.append(_bucket(whole, 40))
    return np.concatenate(who), np.concatenate(what)


@dataclass
class Crf:
    labels: list[str]
    weights: np.ndarray  # buckets x labels
    lexicon: dict  # word -> labels whose lexicon has it
    lexical: np.ndarray  # labels x labels: weight of being in the lexicon of the first for the second
    moves: np.ndarray  # labels x labels

    def emissions(self, words: list[str]) -> np.ndarray:
        """e(word, label) of distinct words."""
        n, width = len(words), len(self.labels)
        if not n:
            return np.zeros((0, width))
        who, what = features(words)
        out = np.empty((n, width))
        picked = self.weights[what]
        for k in range(width):
            out[:, k] = np.bincount(who, picked[:, k], n)
        for i, w in enumerate(words):
            for k in self.lexicon.get(w, ()):
                out[i] += self.lexical[k]
        return out

    def marginals(self, emission: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        return marginals(emission, lengths, self.moves)


def _times(rows: np.ndarray, m: np.ndarray) -> np.ndarray:
    """rows @ m for a small square m, in this thread (a threaded product costs more than it saves here)."""
    return np.einsum("bi,ij->bj", rows, m)


def _dot(x: np.ndarray, y: np.ndarray) -> float:
    return float(np.einsum("i,i->", x, y))


def _normal(p: np.ndarray) -> np.ndarray:
    axes = tuple(range(1, p.ndim))
    return p / p.sum(axis=axes, keepdims=True)


def _products(scaled: np.ndarray, at: np.ndarray, live: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Per block the matrix that takes weights of its first word's labels to weights of its last word's."""
    width = scaled.shape[1]
    product = np.zeros((len(at), width, width))
    product[:, np.arange(width), np.arange(width)] = scaled[at[:, 0]]
    for t in range(1, BLOCK):
        k = live[t]
        if not k:
            break
        product[:k] = _normal(_times(product[:k].reshape(-1, width), m).reshape(-1, width, width) * scaled[at[:k, t]][:, None, :])
    return product


def span_product(emission: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """The same matrix for one whole run of words."""
    m = np.exp(moves - moves.max())
    scaled = np.exp(emission - emission.max(1, keepdims=True)) + 1e-30
    begin = np.arange(0, len(emission), BLOCK)
    size = np.minimum(BLOCK, len(emission) - begin)
    live = np.searchsorted(-size, -np.arange(BLOCK), "left")
    out = None
    for product in _products(scaled, begin[:, None] + np.arange(BLOCK)[None, :], live, m):
        out = product if out is None else out @ m @ product
        out = out / out.sum()
    return out


def marginals(emission: np.ndarray, lengths: np.ndarray, moves: np.ndarray, enter: np.ndarray | None = None,
              leave: np.ndarray | None = None) -> np.ndarray:
    """P(label of each word) for chains of ``lengths`` words that follow one another in ``emission`` (words x labels).

    ``enter`` and ``leave`` are what reaches a single chain's first and last word from the words around it."""
    n, width = emission.shape
    if not n:
        return np.zeros((0, width))
    lengths = np.asarray(lengths, np.int64)
    m = np.exp(moves - moves.max())
    blocks = -(-lengths // BLOCK)
    chain = np.repeat(np.arange(len(lengths)), blocks)  # of each block
    nth = np.arange(len(chain)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    begin = np.repeat(np.cumsum(lengths) - lengths, blocks) + nth * BLOCK
    size = np.minimum(BLOCK, np.repeat(lengths, blocks) - nth * BLOCK)
    order = np.argsort(-size, kind="stable")  # full blocks first: step t concerns a prefix of them
    chain, nth, begin, size = chain[order], nth[order], begin[order], size[order]
    live = np.searchsorted(-size, -np.arange(BLOCK), "left")  # blocks with more than t words
    at = begin[:, None] + np.arange(BLOCK)[None, :]
    scaled = np.exp(emission - emission.max(1, keepdims=True)) + 1e-30
    total = len(chain)
    # what each block does to a vector
    many = blocks.max() > 1
    first_in, last_out = np.ones((total, width)), np.ones((total, width))
    if enter is not None:
        first_in[nth == 0] = enter
        last_out[nth == blocks[0] - 1] = leave
    if many:
        product = _products(scaled, at, live, m)
        place = np.empty(total, np.int64)  # of block (chain, nth), in order
        starts = np.cumsum(blocks) - blocks
        place[starts[chain] + nth] = np.arange(total)
        for j in range(1, int(blocks.max())):
            here = place[starts[blocks > j] + j]
            before = place[starts[blocks > j] + j - 1]
            reach = _times(np.einsum("bi,bij->bj", first_in[before], product[before]), m)
            first_in[here] = _normal(reach)
        for j in range(int(blocks.max()) - 2, -1, -1):
            here = place[starts[blocks > j + 1] + j]
            after = place[starts[blocks > j + 1] + j + 1]
            reach = _times(np.einsum("bij,bj->bi", product[after], last_out[after]), m.T)
            last_out[here] = _normal(reach)
    forward = np.empty((BLOCK, total, width))
    vector = _normal(first_in * scaled[at[:, 0]])
    forward[0] = vector
    for t in range(1, BLOCK):
        k = live[t]
        if not k:
            break
        vector[:k] = _normal(_times(vector[:k], m) * scaled[at[:k, t]])
        forward[t, :k] = vector[:k]
    out = np.empty((n, width))
    back = last_out.copy()
    for t in range(BLOCK - 1, -1, -1):
        k = live[t]
        if not k:
            continue
        ended = live[t + 1] if t + 1 < BLOCK else 0
        if ended:  # blocks that go on: one step back from the word after this
            back[:ended] = _normal(_times(back[:ended] * scaled[at[:ended, t + 1]], m.T))
        out[at[:k, t]] = _normal(forward[t, :k] * back[:k])
    return out


def log_partition(emission: np.ndarray, lengths: np.ndarray, moves: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """(sum of log Z over chains, marginals, expected moves between labels), for training chains of like length."""
    lengths = np.asarray(lengths, np.int64)
    begin, most, width = np.cumsum(lengths) - lengths, int(lengths.max()), emission.shape[1]
    order = np.argsort(-lengths, kind="stable")
    begin, lengths = begin[order], lengths[order]
    live = np.searchsorted(-lengths, -np.arange(most + 1), "left")
    at = begin[:, None] + np.arange(most)[None, :]
    top = emission.max(1, keepdims=True)
    e, lift = np.exp(emission - top), moves.max()
    m = np.exp(moves - lift)
    log_z = float(top.sum()) + lift * float((lengths - 1).sum())
    forward = np.zeros((most, len(lengths), width))
    vector = e[at[:, 0]].copy()
    for t in range(most):
        k = live[t]
        if t:
            vector[:k] = _times(vector[:k], m) * e[at[:k, t]]
        scale = vector[:k].sum(1, keepdims=True)
        log_z += float(np.log(scale).sum())
        vector[:k] /= scale
        forward[t, :k] = vector[:k]
    back = np.ones((len(lengths), width))
    out, pairs = np.empty_like(emission), np.zeros((width, width))
    for t in range(most - 1, -1, -1):
        k, on = live[t], live[t + 1]
        if on:
            reach = back[:on] * e[at[:on, t + 1]]
            both = forward[t, :on, :, None] * m * reach[:, None, :]
            pairs += (both / both.sum((1, 2), keepdims=True)).sum(0)
            back[:on] = _normal(_times(reach, m.T))
        out[at[:k, t]] = _normal(forward[t, :k] * back[:k])
    return log_z, out, pairs


def lexicons(words: list[str], index: np.ndarray, label: np.ndarray, width: int, least: int = 3, share: float = 0.8) -> dict:
    """word -> labels: words met at least ``least`` times, and that much more often (by rate) under a label than elsewhere."""
    count = np.zeros((len(words), width))
    np.add.at(count, (index, label), 1)
    rate = count / np.maximum(count.sum(0), 1)
    part = rate / np.maximum(rate.sum(1, keepdims=True), 1e-12)
    return {words[i]: tuple(np.flatnonzero(part[i] >= share).tolist())
            for i in np.flatnonzero((count.sum(1) >= least) & (part.max(1) >= share)).tolist()}


def fit(chains: list[tuple[list[str], list[int]]], labels: list[str], rounds: int = 25, ridge: float = 0.05) -> Crf:
    """Maximise the chains' conditional likelihood (less a ridge on the weights) by limited-memory quasi-Newton steps."""
    width = len(labels)
    words = sorted({w for ws, _ in chains for w in ws})
    number = {w: i for i, w in enumerate(words)}
    index = np.array([number[w] for ws, _ in chains for w in ws], np.int64)
    label = np.array([k for _, ks in chains for k in ks], np.int64)
    lengths = np.array([len(ws) for ws, _ in chains], np.int64)
    if not len(index):
        return Crf(labels, np.zeros((BUCKETS, width)), {}, np.zeros((width, width)), np.zeros((width, width)))
    known = lexicons(words, index, label, width)
    who, what = features(words)
    extra = [(number[w], BUCKETS + k) for w, ks in known.items() for k in ks]
    if extra:
        who, what = np.append(who, [i for i, _ in extra]), np.append(what, [j for _, j in extra])
    used, what = np.unique(what, return_inverse=True)
    by_word, by_bucket = np.argsort(who, kind="stable"), np.argsort(what, kind="stable")
    word_starts = np.searchsorted(who[by_word], np.arange(len(words)))
    bucket_starts = np.searchsorted(what[by_bucket], np.arange(len(used)))
    inside, heads = what[by_word], who[by_bucket]
    ends = np.cumsum(lengths)
    go_on = np.ones(len(index), bool)
    go_on[ends - 1] = False
    moved = np.zeros((width, width))
    np.add.at(moved, (label[:-1][go_on[:-1]], label[1:][go_on[:-1]]), 1)

    def value(theta):
        w, a = theta[:len(used) * width].reshape(-1, width), theta[len(used) * width:].reshape(width, width)
        per_word = np.add.reduceat(w[inside], word_starts)
        e = per_word[index]
        log_z, p, pairs = log_partition(e, lengths, a)
        loss = log_z - e[np.arange(len(index)), label].sum() - (moved * a).sum() + ridge / 2 * _dot(theta, theta)
        p[np.arange(len(index)), label] -= 1
        back = np.stack([np.bincount(index, p[:, k], len(words)) for k in range(width)], 1)
        grad = np.concatenate([np.add.reduceat(back[heads], bucket_starts).ravel(), (pairs - moved).ravel()]) + ridge * theta
        return loss, grad

    theta = _quasi_newton(value, np.zeros(len(used) * width + width * width), rounds)
    full = np.zeros((BUCKETS + width, width))
    full[used] = theta[:len(used) * width].reshape(-1, width)
    return Crf(labels, full[:BUCKETS], known, full[BUCKETS:], theta[len(used) * width:].reshape(width, width))


def _quasi_newton(value, x: np.ndarray, rounds: int, memory: int = 6) -> np.ndarray:
    f, g = value(x)
    steps: list = []
    for _ in range(rounds):
        q, alphas = g.copy(), []
        for s, y, r in reversed(steps):
            alphas.append(r * _dot(s, q))
            q -= alphas[-1] * y
        q *= _dot(*steps[-1][:2]) / _dot(steps[-1][1], steps[-1][1]) if steps else 1 / max(1.0, np.abs(g).sum() / 100)
        for (s, y, r), a in zip(steps, reversed(alphas)):
            q += s * (a - r * _dot(y, q))
        slope, t = -_dot(g, q), 1.0
        for _ in range(20):
            new = x - t * q
            f_new, g_new = value(new)
            if f_new <= f + 1e-4 * t * slope:
                break
            t /= 2
        else:
            break
        s, y = new - x, g_new - g
        if _dot(s, y) > 1e-10:
            steps = [*steps, (s, y, 1 / _dot(s, y))][-memory:]
        done = f - f_new < 1e-5 * abs(f)
        x, f, g = new, f_new, g_new
        if done:
            break
    return x
