"""Toxicity: subsequence string-kernel SVM over sentences, with Nyström landmarks.

Kernel of two words: gap-weighted common subsequences of three letters (letters may be inserted or
left out between them, each costing a factor ``DECAY``), normalised, to the power ``POWER``.  Kernel of
two sentences: the sum over their pairs of words.  Both are positive definite, so a sentence has the
Nyström features K_LL^(-1/2) k(sentence, L) for landmark words L, and a linear SVM on them scores

    f(sentence) = b + sum over its words of g(word),   g(word) = sum over landmarks l of beta_l k(word, l)

A document is as toxic as its worst sentence; a logistic curve fitted on the same sample turns that into
0..1.  Only documents carry labels, so sentences of toxic documents get theirs by multiple-instance
rounds: those the current SVM holds toxic, at least the worst one of each document."""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from loanlens.llm.bpe import Cache
from loanlens.llm.common import python_stage, table, text_groups

DECAY, POWER, LEAST = 0.8, 3, 0.03  # kernel values under LEAST count as zero
SHARE = 0.45  # of a landmark's letter pairs, that a word must have for the kernel to be worked out
LONGEST = 32  # letters of a word; longer ones are seen in overlapping windows
ALIKE = 0.8  # sum of a clean word's kernels to toxic landmarks from which on it is a landmark too
CHANCE = 4.6  # a word is a landmark by chance in a hundredth of all training samples, at most
CHANGED = 0.3  # weight of changed forms of toxic words, as a share of that of the toxic sentences
MAX_TOXIC, MAX_CLEAN = 1000, 2500  # labelled documents of each class that the classifier is fitted on, at most
_END = re.compile(r"[.!?]+\s|\n")
_SPACED = re.compile(r"(?<!\w)\w(?:[^\w\n]{1,3}\w(?!\w)){2,}")


def subsequence_kernel(x: np.ndarray, y: np.ndarray, decay: float = DECAY) -> np.ndarray:
    """Gap-weighted count of common three-letter subsequences of row pairs: ``x`` (n, a) and ``y`` (n, b) hold
    code points, padded with -1 and -2."""
    b = y.shape[1]
    j = np.arange(b)
    gap = np.where(j[:, None] < j[None, :], decay ** np.maximum(j[None, :] - j[:, None] - 1.0, 0), 0).astype(np.float32)
    one = np.zeros(y.shape, np.float32)  # pairs of letters ending before this place, decayed
    two = np.zeros(y.shape, np.float32)
    out = np.zeros(len(x), np.float32)
    sq = np.float32(decay * decay)
    for i in range(x.shape[1]):
        same = (x[:, i:i + 1] == y).astype(np.float32) * sq
        second, third = same * one, same * two
        out += third.sum(1)
        one = decay * one + same @ gap
        two = decay * two + second @ gap
    return out


def padded(words: list[str], pad: int) -> np.ndarray:
    size = np.array([len(w) for w in words], np.int64)
    out = np.full((len(words), max(1, size.max(initial=1))), pad, np.int32)
    out[np.arange(out.shape[1])[None, :] < size[:, None]] = np.frombuffer("".join(words).encode("utf-32-le"), np.int32)
    return out


def letters(word: str) -> str:
    """Letters and digits of a lower-cased word: marks put between letters don't count."""
    return word if word.isalnum() else "".join(filter(str.isalnum, word))


def windows(word: str) -> list[str]:
    if len(word) <= LONGEST:
        return [word]
    return [word[k:k + LONGEST] for k in range(0, len(word) - LONGEST // 2, LONGEST // 2)]


class WordKernel:
    """k(word, landmark) for batches of words.  Only pairs that share at least ``SHARE`` of the landmark's letter
    pairs (adjacent or with one letter between; at least three) reach the recursion: the others are so
    unlike that their power of the normalised kernel counts as zero."""

    def __init__(self, marks: list[str]):
        self.marks = marks
        self.y = padded(marks, -2)
        self.size = np.array([len(m) for m in marks])
        self.own = subsequence_kernel(padded(marks, -1), self.y)
        alphabet = sorted(set("".join(marks)))
        self.code = np.zeros(0x110000, np.int16)
        self.code[[ord(c) for c in alphabet]] = np.arange(1, len(alphabet) + 1)
        self.width = len(alphabet) + 1
        self.has = np.zeros((-(-len(marks) // 64), self.width * self.width), np.uint64)
        self.least: list[dict[int, int]] = [{} for _ in self.has]  # shared pairs asked for -> bits of its landmarks
        for i, m in enumerate(marks):
            mine = {int(self.code[ord(a)]) * self.width + int(self.code[ord(b)]) for g in (1, 2) for a, b in zip(m, m[g:])}
            self.has[i // 64, list(mine)] |= np.uint64(1 << (i % 64))
            asked = min(15, max(3, math.ceil(SHARE * len(mine))))
            self.least[i // 64][asked] = self.least[i // 64].get(asked, 0) | 1 << (i % 64)

    def pairs(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word, landmark) indices that share enough letter pairs; 64 counters of four bits run side by side."""
        c = np.where(x >= 0, self.code[x], 0).astype(np.int64)
        rows, cols = [], []
        for lane, has in enumerate(self.has):
            planes = [np.zeros(len(x), np.uint64) for _ in range(4)]
            for gap in (1, 2):
                for i in range(x.shape[1] - gap):
                    carry = has[c[:, i] * self.width + c[:, i + gap]]
                    for k, plane in enumerate(planes):
                        planes[k], carry = plane ^ carry, plane & carry
                    planes = [plane | carry for plane in planes]  # 15 stays 15
            hits = np.zeros(len(x), np.uint64)
            for asked, bits in self.least[lane].items():
                more, same = np.zeros(len(x), np.uint64), np.full(len(x), ~np.uint64(0))
                for k in (3, 2, 1, 0):
                    if asked >> k & 1:
                        same = same & planes[k]
                    else:
                        more, same = more | same & planes[k], same & ~planes[k]
                hits |= (more | same) & np.uint64(bits)
            hit = np.flatnonzero(hits)
            r, k = np.nonzero((hits[hit, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1))
            rows.append(hit[r])
            cols.append(k + 64 * lane)
        return np.concatenate(rows), np.concatenate(cols)

    def __call__(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sparse k: (word index, landmark index, value)."""
        out = []
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        for k in range(0, len(order), 10_000):  # words of about one length share a batch
            at = np.array(order[k:k + 10_000])
            x = padded([words[i] for i in at], -1)
            r, c = self.pairs(x)
            if not len(r):
                continue
            rows, back = np.unique(r, return_inverse=True)
            norm = np.empty(len(rows), np.float32)
            for b in range(0, len(rows), 4000):
                some = x[rows[b:b + 4000]]
                norm[b:b + 4000] = subsequence_kernel(some, np.where(some < 0, -2, some))
            v = np.empty(len(r), np.float32)
            by_size = np.argsort(self.size[c], kind="stable")
            for b in range(0, len(r), 4000):
                at_b = by_size[b:b + 4000]
                v[at_b] = subsequence_kernel(x[r[at_b]], self.y[c[at_b], :self.size[c[at_b]].max()])
            v = v / np.sqrt(np.maximum(norm[back], 1e-12) * self.own[c])
            v = np.minimum(v, 1) ** POWER
            some = v >= LEAST
            out.append((at[r[some]], c[some], v[some]))
        if not out:
            return np.zeros(0, int), np.zeros(0, int), np.zeros(0, np.float32)
        return tuple(np.concatenate(z) for z in zip(*out))


def word_kernel(kernel: WordKernel, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse k of words of any length: their letters, of a very long one its likest window to each landmark."""
    parts, owner = [], []
    for i, w in enumerate(words):
        for p in windows(letters(w)):
            if len(p) >= 3:
                parts.append(p)
                owner.append(i)
    r, c, v = kernel(parts)
    if len(owner) == len(set(owner)):
        return np.array(owner, int)[r], c, v
    key = np.array(owner, int)[r] * len(kernel.marks) + c
    order = np.argsort(key, kind="stable")
    key, v = key[order], v[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, int)
    most = np.maximum.reduceat(v, first) if len(key) else v
    return key[first] // len(kernel.marks), key[first] % len(kernel.marks), most


def sentences(text: str) -> list[set[str]]:
    """Distinct words of each sentence, lower-cased; letters written apart are joined into one more word."""
    low, out = text.lower(), []
    apart = _SPACED.search(low) is not None
    for s in _END.split(low):
        words = set(s.split())
        if apart:
            words.update(letters(m) for m in _SPACED.findall(s))
        if words:
            out.append(words)
    return out


@dataclass
class Model:
    marks: list[str]
    beta: np.ndarray
    bias: float
    slope: float
    shift: float

    def scorer(self) -> "Scorer":
        return Scorer(self)


class Scorer:
    def __init__(self, model: Model, most: int = 500_000):
        self.model = model
        self.kernel = WordKernel(model.marks) if model.marks else None
        self.cache = Cache(self._learn, 0.0, most)

    def _learn(self, words: list[str]) -> list[float]:
        """g of each word."""
        if not self.kernel:
            return [0.0] * len(words)
        r, c, v = word_kernel(self.kernel, words)
        return np.round(np.bincount(r, v * self.model.beta[c], minlength=len(words)), 4).tolist()

    def values(self, texts: list[str]) -> list[float]:
        """Margin of the worst sentence of each text."""
        out, value = [self.model.bias] * len(texts), self.cache.__getitem__
        for group in text_groups(texts):
            held = []
            for i in group:
                parts = sentences(texts[i])
                words = list(set().union(*parts))
                g = list(map(value, words))
                known = {w: x for w, x in zip(words, g) if x} if any(g) else {}
                held.append((i, parts if known or self.cache.missed else [], known, self.cache.missed))
                self.cache.missed = []
            learnt = {w: g for w, g in self.cache.fill(w for *_, new in held for w in new).items() if g}
            for i, parts, known, new in held:
                known.update((w, learnt[w]) for w in new if w in learnt)
                if known:
                    out[i] = self.model.bias + max(sum(known[w] for w in sorted(s & known.keys())) for s in parts)
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        z = self.model.slope * np.array(self.values(texts)) + self.model.shift
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _landmarks(texts: list[str], toxic: list[int]) -> list[str]:
    """All words (windows of very long ones) that set toxic training documents apart, but those nearly the same as one
    taken before (kernel over 0.9), and common clean words that look like them; as many as the bounded training
    sample has."""
    count, size, met = {0: Counter(), 1: Counter()}, [0, 0], set()
    for text, t in zip(texts, toxic):
        low = text.lower()
        words = low.split()
        found = [*zip(words, ["", *words], [*words[1:], ""]),
                 *((letters(m.group()), low[max(0, m.start() - 9):m.start()], "") for m in _SPACED.finditer(low))]
        for place in found:
            key = hash((t, place))
            if key not in met:  # a word between the same two words counts once: copies and shared passages do
                met.add(key)
                size[t] += 1
                count[t].update(windows(letters(place[0])))
    # Chernoff's bound on so many places in toxic documents by chance, given the share of clean ones; all words are tried, so
    # the bound asked for falls with their number
    asked = math.log(max(1, len(count[0] | count[1]))) + CHANCE
    fit = {w: g for w, n in count[1].items() if len(w) >= 3 and n > 3 * (mean := size[1] * (count[0][w] + 0.5) / max(1, size[0]))
           and (g := n * math.log(n / mean) - (n - mean)) >= asked}
    picked: list[str] = []
    for w in sorted(fit, key=lambda w: (-fit[w], w)):
        if picked:
            others = padded(picked, -2)
            k = subsequence_kernel(padded([w] * len(picked), -1), others)
            own = subsequence_kernel(padded(picked, -1), others)
            self_ = subsequence_kernel(padded([w], -1), padded([w], -2))[0]
            if (k / np.sqrt(own * self_)).max() ** POWER > 0.9:
                continue
        picked.append(w)
    if not picked:
        return picked
    # clean words that look like toxic ones, so that the classifier can tell them
    common = sorted(w for w, n in count[0].items() if n >= 5 and len(w) >= 3 and w not in fit)
    r, _, v = WordKernel(picked)(common)
    return picked + [common[i] for i in np.flatnonzero(np.bincount(r, v, len(common)) >= ALIKE).tolist()]


class Rows:
    """Sparse rows (sentences or words x landmarks)."""

    def __init__(self, r: np.ndarray, c: np.ndarray, v: np.ndarray, n: int, width: int):
        order = np.argsort(r, kind="stable")
        self.r, self.c, self.v, self.n, self.width = r[order], c[order], v[order].astype(np.float64), n, width

    def times(self, beta: np.ndarray) -> np.ndarray:
        return np.bincount(self.r, self.v * beta[self.c], self.n)

    def gram(self, scale: np.ndarray) -> np.ndarray:
        """Sum over rows of scale x (row, 1) (row, 1)^T, from dense rows of those with a scale, some megabytes at a time."""
        out, step = np.zeros((self.width + 1, self.width + 1)), max(1, 4_000_000 // (self.width + 1))
        rows = np.flatnonzero(scale > 0)
        place = np.full(self.n, -1)
        place[rows] = np.arange(len(rows))
        r = place[self.r]
        r, c, v = r[r >= 0], self.c[r >= 0], self.v[r >= 0]
        for lo in range(0, len(rows), step):
            a, b = np.searchsorted(r, (lo, lo + step))
            dense = np.zeros((min(step, len(rows) - lo), self.width + 1), np.float32)
            dense[r[a:b] - lo, c[a:b]] = v[a:b]
            dense[:, -1] = 1
            dense *= np.sqrt(scale[rows[lo:lo + step], None]).astype(np.float32)
            out += dense.T @ dense
        return out

    def pull(self, weight: np.ndarray) -> np.ndarray:
        return np.append(np.bincount(self.c, self.v * weight[self.r], self.width), weight.sum())


def _svm(x: Rows, y: np.ndarray, weight: np.ndarray, gram: np.ndarray, near: np.ndarray | None = None, c: float = 10.0,
         rounds: int = 30) -> tuple[np.ndarray, float]:
    """L2 support vector machine in the primal: Newton steps on the squared hinge loss, from the margins of a ``near`` one.  The weights are those of the
    landmarks themselves: with K^(-1/2) k(., L) as features, w = K^(1/2) beta and |w|^2 = beta^T K beta."""
    ridge = np.zeros((x.width + 1, x.width + 1))
    values, vectors = np.linalg.eigh(gram)
    ridge[:-1, :-1] = vectors @ np.diag(np.maximum(values, 1e-3)) @ vectors.T
    ridge[-1, -1] = 1e-6
    active = np.ones(x.n, bool) if near is None else y * near < 1
    for _ in range(rounds):
        s = np.where(active, weight * c, 0)
        w = np.linalg.solve(ridge + x.gram(s), x.pull(y * s))
        now = y * (x.times(w[:-1]) + w[-1]) < 1
        if (now == active).all():
            break
        active = now
    return w[:-1], w[-1]


def fit(texts: list[str], toxic: list[int]) -> Model:
    """Fit the sentence SVM on labelled documents (multiple-instance rounds) and its logistic curve."""
    none = Model([], np.zeros(0), 0.0, 0.0, -3.0)
    if not texts or sum(toxic) == 0:
        return none
    marks = _landmarks(texts, toxic)
    if not marks:
        return none
    kernel, width = WordKernel(marks), len(marks)
    found: list = [[], [], []]  # sentence, landmark, value
    owner, plain = [], 0
    row: dict[str, tuple] = {}  # entries of words that have some
    seen: set[str] = set()
    for lo in range(0, len(texts), 100):  # a hundred documents at a time: the words of all would fill the driver
        docs = [sentences(t) for t in texts[lo:lo + 100]]
        words = sorted({w for d in docs for s in d for w in s} - seen)
        seen = seen.union(words) if len(seen) < 500_000 else set(words)
        r, c, v = word_kernel(kernel, words)
        order = np.argsort(r, kind="stable")
        r, c, v = r[order], c[order], v[order]
        cuts = np.flatnonzero(np.diff(r)) + 1
        for k, cs, vs in zip(r[np.append(0, cuts)] if len(r) else [], np.split(c, cuts), np.split(v, cuts)):
            row[words[k]] = (cs, vs)
        for d, parts in enumerate(docs, lo):
            for s in parts:
                at = s & row.keys()
                if at:
                    total = np.bincount(np.concatenate([row[w][0] for w in sorted(at)]), np.concatenate([row[w][1] for w in sorted(at)]))
                    some = np.flatnonzero(total)
                    for column, part in zip(found, (np.full(len(some), len(owner)), some, total[some].astype(np.float32))):
                        column.append(part)
                    owner.append(d)
                else:
                    plain += 1
    if not owner:
        return none
    r, c, v = map(np.concatenate, found)
    n, owner, gram = len(owner), np.array(owner), _gram(kernel)
    x = Rows(r, c, v, n + 1, width)  # the last row stands for the sentences without any likeness
    is_toxic = np.array(toxic)[owner].astype(bool)
    label, f = is_toxic.copy(), None
    for _ in range(8):
        y = np.append(np.where(label, 1.0, -1.0), -1.0)
        share = label.sum() / max(1, len(label) - label.sum() + plain)
        weight = np.append(np.where(label, 1.0, max(share, 1e-3) ** 0.5), plain * max(share, 1e-3) ** 0.5)
        beta, b = _svm(x, y, weight, gram, f)
        f = x.times(beta) + b
        worst = np.full(len(texts), -np.inf)
        np.maximum.at(worst, owner, f[:-1])
        new = is_toxic & ((f[:-1] > 0) | (f[:-1] >= worst[owner]))
        if (new == label).all():
            break
        label = new
    # words that are toxic by themselves, with a letter put in or doubled, teach how far a word may be changed
    strong = [m for m, g in zip(marks, gram @ beta) if g + b > 0]
    forms = sorted({m[:i] + z + m[i:] for m in strong for i in range(1, len(m)) for z in ("x", "q", m[i - 1])})
    fr, fc, fv = word_kernel(kernel, forms)
    part = CHANGED * weight[:-1][label].sum() / max(1, len(forms))
    both = Rows(np.append(r, fr + n + 1), np.append(c, fc), np.append(v, fv), n + 1 + len(forms), width)
    beta, b = _svm(both, np.append(y, np.ones(len(forms))), np.append(weight, np.full(len(forms), part)), gram, both.times(beta) + b)
    model = Model(marks, beta, float(b), 1.0, 0.0)
    margin = np.append(np.array(Scorer(model, 100_000).values(texts)), both.times(beta)[n + 1:] + b)
    part = CHANGED * sum(toxic) / max(1, len(forms))
    model.slope, model.shift = _logistic(margin, np.append(np.array(toxic, float), np.ones(len(forms))),
                                         np.append(np.ones(len(texts)), np.full(len(forms), part)))
    return model


def _gram(kernel: WordKernel) -> np.ndarray:
    n = len(kernel.marks)
    x = padded(kernel.marks, -1)
    g = np.empty((n, n))
    for i in range(n):
        g[i] = subsequence_kernel(np.repeat(x[i:i + 1], n, 0), kernel.y) / np.sqrt(kernel.own[i] * kernel.own)
    return np.minimum(g, 1) ** POWER


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope (never negative) and shift of P(y = 1 | x), by damped Newton steps with a small ridge."""
    a = np.stack([x, np.ones_like(x)], 1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = a.T @ (a * (weight * p * (1 - p))[:, None]) + 1e-2 * np.eye(2)
        step = np.linalg.solve(h, a.T @ (weight * (y - p)) - 1e-2 * w)
        w += np.clip(step, -2, 2)
    return max(float(w[0]), 0.0), float(w[1])


def held_out(id_col: Column) -> Column:
    """Rows that never teach: crc32 of the id as text leaves 2 when divided by 4 (a null id teaches nothing)."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> tuple[list[str], list[int]]:
    """Texts and labels of at most ``max_toxic`` + ``max_clean`` labelled documents, chosen by a hash of the id."""
    known = (labels.where(F.col("toxic").isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
             .groupBy(id_col).agg(F.max("toxic").cast("int").alias("_toxic")))
    ids = None
    for t, n in ((1, max_toxic), (0, max_clean)):
        part = known.where(F.col("_toxic") == t).orderBy(F.xxhash64(id_col), id_col).limit(n)
        ids = part if ids is None else ids.union(part)
    # at most max_toxic + max_clean ids of 12 bytes: a proven bound for the broadcast
    rows = (docs.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{text_col}`").alias("_text"))
            .where(F.col("_text").isNotNull()).join(F.broadcast(ids), id_col)
            .groupBy(id_col, "_toxic").agg(F.min("_text").alias("_text")).orderBy(id_col).collect())
    return [r["_text"] for r in rows], [r["_toxic"] for r in rows]


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text",
          carry: list[str] | None = None, threshold: float = 0.3) -> DataFrame:
    """Score whole texts: ``row`` (struct of the ``carry`` columns, by default the id), ``score`` in 0..1, ``predicted``.

    Null and empty texts score as a sentence without words.  Each row is scored by itself: repeated
    rows, null ids and clashing other columns change nothing; an empty table gives an empty result.
    Very long texts are read whole, words of any length through overlapping windows."""
    spark = docs.sparkSession
    python_stage(spark)
    sent = spark.sparkContext.broadcast(model)
    carry = carry or [id_col]
    token = uuid.uuid4().hex

    def run(batches):
        scorer = _SCORERS.get(token)
        if scorer is None:
            _SCORERS.clear()
            scorer = _SCORERS[token] = sent.value.scorer()
        for b in batches:
            texts = b.column("row").field(carry.index(text_col)) if text_col in carry else b.column("_text")
            s = scorer.scores([t or "" for t in texts.to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(s, pa.float64())], ["row", "score"])

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"),
                       *([] if text_col in carry else [F.col(f"`{text_col}`").alias("_text")]))
    out = rows.mapInArrow(run, StructType([rows.schema["row"], StructField("score", DoubleType())]))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


_SCORERS: dict = {}


def op1(spark, sf_dir: str) -> DataFrame:
    """Score all documents with a model fitted on the labelled rows that are not held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(*training_sample(docs, labels))
    out = score(docs, model)
    return out.select("row.doc_id", "score", "predicted").select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
