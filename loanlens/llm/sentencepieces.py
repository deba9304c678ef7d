"""SentencePiece encoding and decoding with N-best segmentations.

The piece lattice of a text falls apart where a space follows another character, because no piece spans
that place; so every distinct unit (spaces and the word after them) has its lattice worked out once, in
batches of numpy arrays: hashes of all substrings, their scores, and forward Viterbi scores with the best
and the second-best value of every position.

The N best segmentations of a whole text differ from the best one in at most N - 1 units, those with the
smallest gap between their best and second-best value.  Only those units are searched: backward from the
end by A*, with the forward Viterbi scores as heuristic.  That heuristic is exact, so segmentations come
out in the order of their scores.  The lists of these units are then combined into those of the text."""

from __future__ import annotations

import hashlib
import heapq
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from loanlens.llm.bpe import Cache, IntTable
from loanlens.llm.common import python_stage, table, text_groups

SPACE = "▁"  # stands for a space in pieces
UNKNOWN_PENALTY = 10.0  # below the least score of a piece, as in the library's lattice
_UNIT = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
INF = float("inf")
LONG, AREA = 4096, 1_000_000  # characters of a unit that is searched by itself; cells of a shared lattice, at most


def read_model(raw: bytes) -> list[tuple[str, float, int]]:
    """(piece, score, type) of every id in a serialised model: field 1 of the message, with the fields
    1 (string), 2 (float) and 3 (type, 1 when absent) of each entry."""
    def varint(at):
        value = shift = 0
        while True:
            b = raw[at]
            value |= (b & 127) << shift
            at, shift = at + 1, shift + 7
            if b < 128:
                return value, at

    def fields(at, end):
        while at < end:
            tag, at = varint(at)
            kind = tag & 7
            if kind == 0:
                value, at = varint(at)
            elif kind == 2:
                size, at = varint(at)
                value, at = (at, at + size), at + size
            else:
                size = 4 if kind == 5 else 8
                value, at = raw[at:at + size], at + size
            yield tag >> 3, value

    pieces = []
    for number, span in fields(0, len(raw)):
        if number == 1:
            entry = dict(fields(*span))
            lo, hi = entry[1]
            score = float(np.frombuffer(entry[2], "<f4")[0]) if 2 in entry else 0.0
            pieces.append((raw[lo:hi].decode(), score, entry.get(3, 1)))
    return pieces


class Pieces:
    """Lattices over the pieces of one model.  Types: 1 normal, 4 defined by the user, 6 a byte."""

    def __init__(self, raw: bytes, n_best: int = 4):
        self.n_best = n_best
        entries = read_model(raw)
        normal = {p: (s, i) for i, (p, s, t) in enumerate(entries) if t in (1, 4)}
        if any(SPACE in p.lstrip(SPACE) or (p.startswith(SPACE * 2) and p.strip(SPACE)) for p in normal):
            raise ValueError("a piece spans a place where a space follows another character")
        self.scores = {p: s for p, (s, _) in normal.items()}
        self.ids = {p: i for p, (_, i) in normal.items()}
        self.byte_id = {int(p[3:5], 16): i for i, (p, _, t) in enumerate(entries) if t == 6}
        self.unknown_id = next((i for i, (_, _, t) in enumerate(entries) if t == 2), 0)
        self.unknown = min(self.scores.values()) - UNKNOWN_PENALTY
        self.longest = max(map(len, normal))
        keys = np.array([self._hash(p) for p in normal], np.int64)
        if len(np.unique(keys)) < len(keys):
            raise ValueError("two pieces share a hash")
        self.find = IntTable(keys)
        self.score_of = np.array([s for s, _ in normal.values()])
        self.id_of = np.array([i for _, i in normal.values()], np.int64)
        self.bytes_of = [(bytes([int(p[3:5], 16)]) if t == 6 else b"" if t in (2, 3) else p.replace(SPACE, " ").encode())
                         for p, _, t in entries]
        self.cache = Cache(self._learn, None, most=700_000)
        self.lists: dict = {}

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * 0x9E3779B97F4A7C15 + ord(c) + 1) & (1 << 64) - 1
        return h - (1 << 64) if h >> 63 else h

    def _unknown_ids(self, char: str) -> list[int]:
        raw = char.encode()
        return [self.byte_id[b] for b in raw] if all(b in self.byte_id for b in raw) else [self.unknown_id]

    def _learn(self, units: list) -> list[tuple[bytes, float, float]]:
        """(ids of the best segmentation, its score, gap to the second best) of each unit; units of about one length
        share a lattice of bounded area."""
        words = [u[0] if type(u) is tuple else SPACE + u for u in units]
        out: list = [None] * len(words)
        order = sorted(range(len(words)), key=lambda i: -len(words[i]))
        at = 0
        while at < len(order):
            size = len(words[order[at]])
            if size > LONG:
                out[order[at]] = self._learn_long(words[order[at]])
                at += 1
                continue
            part = order[at:at + max(1, AREA // (size + 1))]
            for i, value in zip(part, self._learn_some([words[i] for i in part])):
                out[i] = value
            at += len(part)
        return out

    def _edges(self, word: str, end: int) -> list[tuple[int, float, int]]:
        """(length, score, id) of the pieces that end there, longest first; a character without a piece is its own."""
        out = []
        for k in range(min(end, self.longest), 0, -1):
            p = word[end - k:end]
            if p in self.scores:
                out.append((k, self.scores[p], self.ids[p]))
            elif k == 1:
                out.append((1, self.unknown, -2 - ord(p)))
        return out

    def _learn_long(self, word: str) -> tuple[bytes, float, float]:
        """The same for one very long unit, a character at a time: scores are kept as far back as the longest piece
        reaches, and a length and an id per character."""
        reach = self.longest + 1
        best, second = [-INF] * reach, [-INF] * reach
        best[0] = 0.0
        lengths, ids = array("H", [0]), array("q", [0])
        for end in range(1, len(word) + 1):
            b = s = -INF
            length = piece = 0
            for k, e, i in self._edges(word, end):
                before = (end - k) % reach
                c = best[before] + e
                if c > b:
                    s, b, length, piece = b, c, k, i
                elif c > s:
                    s = c
                if second[before] + e > s:
                    s = second[before] + e
            best[end % reach], second[end % reach] = b, s
            lengths.append(length)
            ids.append(piece)
        path, at = [], len(word)
        while at:
            path.append(ids[at])
            at -= lengths[at]
        path.reverse()
        top, next_best = best[len(word) % reach], second[len(word) % reach]
        return self._bytes(path), top, top - next_best

    def _learn_some(self, words: list[str]) -> list[tuple[bytes, float, float]]:
        order = sorted(range(len(words)), key=lambda i: -len(words[i]))
        size = np.array([len(words[i]) for i in order])
        start = np.cumsum(size) - size
        code = np.frombuffer("".join(words[i] for i in order).encode("utf-32-le"), np.uint32).astype(np.uint64)
        end = np.repeat(start + size, size)
        # edge[l - 1][p]: score and id of the piece of length l that starts at p
        most = min(self.longest, int(size.max()))
        edge, ids = np.full((most, len(code)), -INF), np.full((most, len(code)), -1, np.int64)
        h, at = np.zeros(len(code), np.uint64), np.arange(len(code))
        for k in range(1, most + 1):
            at = at[at + k <= end[at]]
            h = h[:len(code)]
            h[at] = h[at] * np.uint64(0x9E3779B97F4A7C15) + code[at + k - 1] + np.uint64(1)
            found = self.find(h[at].view(np.int64))
            hit = found >= 0
            edge[k - 1, at[hit]] = self.score_of[found[hit]]
            ids[k - 1, at[hit]] = self.id_of[found[hit]]
        lone = ids[0] < 0
        edge[0, lone] = self.unknown
        ids[0, lone] = -2 - code[lone].astype(np.int64)
        n = len(size)
        best, second = np.full((size[0] + 1, n), -INF), np.full((size[0] + 1, n), -INF)
        back = np.zeros((size[0] + 1, n), np.int16)
        best[0] = 0
        for i in range(1, size[0] + 1):
            on = int(np.searchsorted(-size, -i, "right"))  # units of at least this length
            b, s, p = np.full(on, -INF), np.full(on, -INF), np.zeros(on, np.int16)
            for k in range(min(i, most), 0, -1):  # of equal scores the longest last piece
                e = edge[k - 1, start[:on] + i - k]
                c = best[i - k, :on] + e
                up = c > b
                s = np.maximum(np.where(up, b, np.maximum(s, c)), second[i - k, :on] + e)
                b, p = np.where(up, c, b), np.where(up, k, p)
            best[i, :on], second[i, :on], back[i, :on] = b, s, p
        pos, paths = size.copy(), []
        who = np.arange(n)
        while len(who):
            k = back[pos[who], who].astype(np.int64)
            pos[who] -= k
            paths.append((who, ids[k - 1, start[who] + pos[who]]))
            who = who[pos[who] > 0]
        owner = np.concatenate([w for w, _ in paths])[::-1]
        flat = np.concatenate([v for _, v in paths])[::-1]
        flat = flat[np.argsort(owner, kind="stable")]
        count = np.bincount(owner, minlength=n)
        raw, cut = flat.astype("<u4").tobytes(), (4 * np.append(0, np.cumsum(count))).tolist()
        odd = set(np.flatnonzero(np.bincount(np.repeat(np.arange(n), count), flat < -1, n)).tolist())
        top = best[size, np.arange(n)]
        gap = top - second[size, np.arange(n)]
        out: list = [None] * n
        for j, i in enumerate(order):
            part = raw[cut[j]:cut[j + 1]]
            if j in odd:
                part = self._bytes(flat[cut[j] // 4:cut[j + 1] // 4].tolist())
            out[i] = (part, float(top[j]), float(gap[j]))
        return out

    def _bytes(self, path: list[int]) -> bytes:
        ids = [x for i in path for x in ([i] if i >= 0 else self._unknown_ids(chr(-2 - i)))]
        return np.array(ids, "<u4").tobytes()

    def segmentations(self, word: str) -> list[tuple[float, bytes]]:
        """The n_best best (score, ids) of one unit, best first: forward Viterbi, then backward A*.

        Forward scores are exact, so an open path's estimate is the score of its best completion, and open paths have
        no completion in common: no more of them are kept than segmentations are still wanted.  They stay in the order of
        their piece lengths from the end (longer first), which decides ties; paths share their nodes."""
        if word in self.lists:
            return self.lists[word]
        forward = array("d", [0.0])
        for end in range(1, len(word) + 1):
            forward.append(max(forward[end - k] + s for k, s, _ in self._edges(word, end)))
        before, piece = array("q", [0]), array("q", [0])  # nodes: the piece behind, and this one's id
        paths, found = [(forward[-1], len(word), 0.0, 0)], []  # estimate, place reached, score so far, node
        while paths and len(found) < self.n_best:
            first = max(range(len(paths)), key=lambda j: (paths[j][0], -j))
            _, at, done, node = paths.pop(first)
            if at == 0:
                ids = []
                while node:
                    ids.append(piece[node])
                    node = before[node]
                found.append((done, self._bytes(ids)))
                continue
            paths[first:first] = [(forward[at - k] + done + s, at - k, done + s, (node, i)) for k, s, i in self._edges(word, at)]
            wanted = self.n_best - len(found)
            if len(paths) > wanted:
                keep = sorted(sorted(range(len(paths)), key=lambda j: (-paths[j][0], j))[:wanted])
                paths = [paths[j] for j in keep]
            for j, (f, place, score, node) in enumerate(paths):
                if type(node) is tuple:
                    before.append(node[0])
                    piece.append(node[1])
                    paths[j] = (f, place, score, len(piece) - 1)
        if len(word) <= LONG:
            if len(self.lists) >= 50_000:
                self.lists.clear()
            self.lists[word] = found
        return found

    @staticmethod
    def units(text: str) -> list:
        """A str unit stands for a space and that word; a 1-tuple for just these characters."""
        if not text:
            return []
        if SPACE in text:
            text = text.replace(SPACE, " ")
        if "  " in text or text[0] == " " or text[-1] == " ":
            return [(u,) for u in _UNIT.findall(SPACE + text.replace(" ", SPACE))]
        return text.split(" ")

    def encode(self, texts: list[str]) -> list[list[tuple[float, bytes]]]:
        """The best segmentations of each text, best first: (score, little-endian uint32 ids)."""
        out: list = [None] * len(texts)
        value = self.cache.__getitem__
        for group in text_groups(texts):
            held, new = [], []
            for i in group:
                units = self.units(texts[i])
                held.append((i, units, list(map(value, units)), self.cache.missed))
                new.extend(self.cache.missed)
                self.cache.missed = []
            values = self.cache.fill(new)
            for u in new:  # very long units don't stay
                if len(u[0] if type(u) is tuple else u) > LONG:
                    self.cache.pop(u, None)
            for i, units, parts, missed in held:
                at = -1
                for u in missed:
                    at = parts.index(None, at + 1)
                    parts[at] = values[u]
                out[i] = self._combine(units, parts)
        return out

    def _combine(self, units: list, parts: list) -> list[tuple[float, bytes]]:
        ids = [p[0] for p in parts]
        total = sum(p[1] for p in parts)
        close = [(p[2], i) for i, p in enumerate(parts) if p[2] < INF]
        combined = [(0.0, ())]  # (loss, ((unit, ids), ...)), least loss first
        for _, i in heapq.nsmallest(self.n_best - 1, close):
            word = units[i][0] if type(units[i]) is tuple else SPACE + units[i]
            choices = [(parts[i][1] - s, raw) for s, raw in self.segmentations(word)]
            combined = heapq.nsmallest(self.n_best, ((loss + more, (*path, (i, raw))) for loss, path in combined
                                                     for more, raw in choices), key=lambda x: x[0])
        best = [(total, b"".join(ids))]
        for loss, path in combined[1:]:
            own = ids.copy()
            for i, raw in path:
                own[i] = raw
            best.append((total - loss, b"".join(own)))
        return best

    def decode(self, raw: bytes) -> str:
        """The text of ids: pieces with spaces for their marks, bytes put together as UTF-8 (broken ones
        replaced), without the space put before the first word."""
        joined = b"".join(map(self.bytes_of.__getitem__, np.frombuffer(raw, "<u4").tolist()))
        return joined[1:].decode("utf-8", "replace") if joined[:1] == b" " else joined.decode("utf-8", "replace")


_PIECES: dict = {}


def _pieces(key, model) -> Pieces:
    if key not in _PIECES:
        _PIECES[key] = Pieces(model.value, key[1])
    return _PIECES[key]


def _model(spark, path: str):
    python_stage(spark)
    with open(path, "rb") as f:  # a bounded vocabulary file on the driver
        return spark.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, model_path: str, n_best: int = 4, id_col: str = "doc_id", text_col: str = "text",
           with_ids: bool = False) -> DataFrame:
    """N-best segmentations of whole texts, one row per input row.

    Columns: id, ``n_bytes``, ``n_tokens`` and ``ids_crc32`` of the best segmentation, ``scores`` (up to ``n_best``,
    best first), ``nbest_crc32`` (ids of each), ``decoded_sha256`` (of the text decoded from the best ids),
    ``round_trip`` (it equals the text)[, ``ids``: the ids of each].

    Null and empty texts have one segmentation without tokens (score 0).  Of equal scores the one with longer
    last pieces comes first.  A character without a piece becomes its bytes.  The mark that stands for a space
    reads as a space, as in the library, so a text that holds it does not come back as it was.  Each row
    stands for itself: repeated rows and null ids give their own rows; an empty table gives an empty result;
    other columns are not read.  Very long texts are many units; a unit of more than LONG
    characters (text without spaces) is searched by itself in memory of some tens of bytes a character."""
    spark = docs.sparkSession
    model, key = _model(spark, model_path), (model_path, n_best)

    def run(batches):
        pieces = _pieces(key, model)
        for b in batches:
            texts = b.column("_text").to_pylist()
            every = pieces.encode(texts)
            back = [pieces.decode(e[0][1]) for e in every]
            cols = [b.column("_id"), pa.array([len(t.encode()) for t in texts], pa.int64()),
                    pa.array([len(e[0][1]) // 4 for e in every], pa.int64()),
                    pa.array([zlib.crc32(e[0][1]) for e in every], pa.int64()),
                    pa.array([[s for s, _ in e] for e in every], pa.list_(pa.float64())),
                    pa.array([[zlib.crc32(raw) for _, raw in e] for e in every], pa.list_(pa.int64())),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in back]),
                    pa.array([t == u for t, u in zip(texts, back)])]
            names = ["_id", "n_bytes", "n_tokens", "ids_crc32", "scores", "nbest_crc32", "decoded_sha256", "round_trip"]
            if with_ids:
                cols.append(pa.array([[np.frombuffer(raw, "<u4").astype(np.int32) for _, raw in e] for e in every],
                                     pa.list_(pa.list_(pa.int32()))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names)

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("_id"),
                       F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_text"))
    schema = ("_id long, n_bytes long, n_tokens long, ids_crc32 long, scores array<double>, nbest_crc32 array<long>, "
              "decoded_sha256 string, round_trip boolean" + (", ids array<array<int>>" if with_ids else ""))
    return rows.mapInArrow(run, schema).withColumnRenamed("_id", id_col)


def decode(tokens: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of each row's ids; null ids give a null text, no ids an empty one."""
    spark = tokens.sparkSession
    model, key = _model(spark, model_path), (model_path, 1)

    def run(batches):
        pieces = _pieces(key, model)
        for b in batches:
            texts = [None if x is None else pieces.decode(np.array(x, "<u4").tobytes()) for x in b.column("_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("_id"), pa.array(texts, pa.string())], ["_id", "text"])

    rows = tokens.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{ids_col}`").cast("array<int>").alias("_ids"))
    return rows.mapInArrow(run, "_id long, text string").withColumnRenamed("_id", id_col)


def op9(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
