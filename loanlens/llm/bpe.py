"""Byte-pair merging over ragged numpy arrays, all sequences in step.

A batch of pre-tokens is one flat array of symbol ids plus the start of each sequence.  In each
round every sequence looks up the rank of its adjacent pairs, takes its own lowest rank, and merges
all (left to right, non-overlapping) occurrences of that pair at once; finished sequences leave the
batch.  The tables come from a public tokenizer file (bounded: 50,000 merges), read on the driver
and shipped as a broadcast value."""

from __future__ import annotations

import json

import numpy as np

NONE = np.int64(1 << 40)  # rank of a pair that no merge has


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: printable
    Latin-1 bytes stand for themselves, the others follow from U+0100 on in byte order."""
    keep = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    spare = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(spare)) for b in range(256)]


class IntTable:
    """Places of distinct non-negative or negative int64 keys: an open-addressed hash table in numpy arrays."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(10, 2 + int(len(keys)).bit_length())
        size = 1 << self.bits
        self.keys, self.place = np.zeros(size, np.int64), np.full(size, -1, np.int64)
        slot, left, self.probes = self._slot(keys), np.arange(len(keys)), 0
        while len(left):  # each round places one key in every free slot, the others move on by one
            self.probes += 1
            free = self.place[slot[left]] < 0
            _, pick = np.unique(np.where(free, slot[left], -1 - left), return_index=True)
            pick = pick[free[pick]]
            put = left[pick]
            self.keys[slot[put]], self.place[slot[put]] = keys[put], put
            left = np.delete(left, pick)
            slot[left] = (slot[left] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 for one that is not held."""
        slot = self._slot(keys)
        place = self.place[slot]
        for _ in range(self.probes):
            off = np.flatnonzero((place >= 0) & (self.keys[slot] != keys))
            if not len(off):
                return place
            slot[off] = (slot[off] + 1) & (len(self.keys) - 1)
            place[off] = self.place[slot[off]]
        return np.where(self.keys[slot] == keys, place, -1)


class Merges:
    """Pair ranks of one vocabulary."""

    def __init__(self, vocab: dict[str, int], merges: list, end_of_word: str | None):
        chars = byte_symbols()
        self.first = np.array([vocab[c] for c in chars], np.int64)
        self.last = np.array([vocab[c + end_of_word] for c in chars], np.int64) if end_of_word else None
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        self.find = IntTable(np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], np.int64))
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)

    @classmethod
    def from_json(cls, text: str) -> "Merges":
        model = json.loads(text)["model"]
        return cls(model["vocab"], model["merges"], model.get("end_of_word_suffix") or None)

    def lookup(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged symbol) of each pair; NONE where there is no merge."""
        rank = self.find(a << 20 | b)
        return np.where(rank >= 0, rank, NONE), self.made[rank]

    def encode(self, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all ``tokens`` (each not empty) one after the other, and how many each has."""
        if not tokens:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        size = np.fromiter(map(len, tokens), np.int64, len(tokens))
        raw = np.frombuffer(b"".join(tokens), np.uint8)
        sym, ends = self.first[raw], np.cumsum(size)
        if self.last is not None:
            sym[ends - 1] = self.last[raw[ends - 1]]
        seq, start = np.arange(len(tokens)), ends - size
        rank, made = np.full(len(sym), NONE), np.zeros(len(sym), np.int64)
        rank[:-1], made[:-1] = self.lookup(sym[:-1], sym[1:])
        rank[ends - 1] = NONE
        done_seq, done_sym = [], []
        while True:
            best = np.minimum.reduceat(rank, start)
            live = best < NONE
            if not live.all():  # finished sequences leave
                mask = np.repeat(live, size)
                done_seq.append(np.repeat(seq, size)[~mask])
                done_sym.append(sym[~mask])
                sym, rank, made = sym[mask], rank[mask], made[mask]
                seq, size, best = seq[live], size[live], best[live]
                if not len(seq):
                    break
                start = np.cumsum(size) - size
            at = np.flatnonzero(rank == np.repeat(best, size))
            # of pairs that overlap (a run of one repeated symbol) every second one, from the left
            new_run = np.ones(len(at), bool)
            new_run[1:] = at[1:] != at[:-1] + 1
            nth = np.arange(len(at)) - np.maximum.accumulate(np.where(new_run, np.arange(len(at)), 0))
            at = at[nth % 2 == 0]
            sym[at] = made[at]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            rank[at] = rank[at + 1]  # an end stays an end; the rest is looked up below
            gone = np.add.reduceat((~keep).astype(np.int64), start)
            place = np.cumsum(keep) - 1
            sym, rank, made = sym[keep], rank[keep], made[keep]
            size = size - gone
            start = np.cumsum(size) - size
            is_end = np.zeros(len(sym), bool)
            is_end[start + size - 1] = True
            at = place[at]
            again = np.concatenate([at, at[at > 0] - 1])
            rank[again] = NONE
            again = again[~is_end[again]]
            if len(again):
                rank[again], made[again] = self.lookup(sym[again], sym[again + 1])
        order = np.concatenate(done_seq)
        flat = np.concatenate(done_sym)[np.argsort(order, kind="stable")]
        return flat, np.bincount(order, minlength=len(tokens))


class Cache(dict):
    """Values per unit of text for a bounded number of units; units not met before are noted in
    ``missed`` and read as ``blank``.  ``learn`` maps a list of new units to their values.

    Units live in two generations of at most half of ``most`` each: when the younger is full it becomes the older and
    replaces it, and a unit met again in the older one moves back, so what is used stays."""

    def __init__(self, learn, blank, most: int = 600_000, part: int = 50_000):
        super().__init__()
        self.learn, self.blank, self.half, self.part, self.missed = learn, blank, max(1, most // 2), part, []
        self.old: dict = {}

    def __missing__(self, unit):
        if unit in self.old:
            value = self[unit] = self.old.pop(unit)
            return value
        self.missed.append(unit)
        return self.blank

    def fill(self, units) -> dict:
        """The values of all ``units``, new ones learnt."""
        units = list(dict.fromkeys(units))
        values: dict = {}
        for k in range(0, len(units), self.part):
            part = units[k:k + self.part]
            values.update(zip(part, self.learn(part)))
        if len(self) + len(values) > self.half:
            self.old = dict(self) if len(self) <= 2 * self.half else {}
            self.clear()
        if len(values) <= self.half:
            self.update(values)
        return values
