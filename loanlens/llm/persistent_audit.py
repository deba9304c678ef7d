"""Edit strings as persistent linked nodes.

A string is a node: its last letter, its parent (the string without it), its depth, a rolling hash and
binary-lifting ancestors (1, 2, 4, ... letters back).  Strings share all their prefixes, adding a letter costs
O(log depth), and two strings are compared by a search for their longest common prefix: ancestors whose hashes
differ are followed in both.  Equal hashes are only a guess, so the prefix found is walked to the node
both share (usually at once); a collision falls back to comparing letter by letter."""

from __future__ import annotations

P61, BASE = (1 << 61) - 1, 1_000_003


class Audits:
    """An arena of edit strings; node 0 is the empty string (or, after ``trim``, what ``head`` holds)."""

    def __init__(self, modulus: int = P61):
        self.modulus, self.head = modulus, []
        self._reset()

    def _reset(self) -> None:
        self.parent, self.letter, self.depth, self.hash, self.up = [0], [""], [0], [0], [()]

    def __len__(self) -> int:
        return len(self.parent)

    def add(self, node: int, letter: str) -> int:
        """The string of ``node`` followed by ``letter``."""
        up, k = [node], 0
        while k < len(self.up[up[-1]]):  # the 2^k-th ancestor's 2^k-th ancestor is the 2^(k+1)-th
            up.append(self.up[up[-1]][k])
            k += 1
        self.parent.append(node)
        self.letter.append(letter)
        self.depth.append(self.depth[node] + 1)
        self.hash.append((self.hash[node] * BASE + ord(letter)) % self.modulus)
        self.up.append(tuple(up))
        return len(self.parent) - 1

    def pop(self) -> None:
        """Forget the node added last (a candidate that lost)."""
        for column in (self.parent, self.letter, self.depth, self.hash, self.up):
            column.pop()

    def ancestor(self, node: int, steps: int) -> int:
        k = 0
        while steps:
            if steps & 1:
                node = self.up[node][k]
            steps >>= 1
            k += 1
        return node

    def _same(self, x: int, y: int) -> bool:
        """Whether two strings of one depth are equal, by their letters up to the node that both share."""
        while x != y:
            if self.letter[x] != self.letter[y]:
                return False
            x, y = self.parent[x], self.parent[y]
        return True

    def _letters(self, node: int) -> str:
        out = []
        while node:
            out.append(self.letter[node])
            node = self.parent[node]
        return "".join(reversed(out))

    def text(self, node: int) -> str:
        return "".join(self.head) + self._letters(node)

    def less(self, a: int, b: int) -> bool:
        """Whether the string of ``a`` comes before that of ``b`` in ASCII order."""
        low = min(self.depth[a], self.depth[b])
        x, y = self.ancestor(a, self.depth[a] - low), self.ancestor(b, self.depth[b] - low)
        if self.hash[x] == self.hash[y]:
            if self._same(x, y):
                return self.depth[a] < self.depth[b]
            return self._letters(a) < self._letters(b)  # a collision
        for k in reversed(range(low.bit_length())):
            if k < len(self.up[x]):
                p, q = self.up[x][k], self.up[y][k]
                if self.hash[p] != self.hash[q]:
                    x, y = p, q
        if self._same(self.parent[x], self.parent[y]):
            return self.letter[x] < self.letter[y]
        return self._letters(a) < self._letters(b)

    def trim(self, live: list[int]) -> list[int]:
        """Keep only the strings in ``live``: what they all begin with moves to ``head`` and other nodes go.
        Returns the new nodes.  Comparisons never look behind a shared node, so none is lost."""
        low = min(self.depth[n] for n in live)
        at = [self.ancestor(n, self.depth[n] - low) for n in live]
        while len(set(at)) > 1:
            at = [self.parent[n] for n in at]
        root = at[0]
        self.head.append(self._letters(root))
        order, seen = [], {root}
        for n in live:
            path = []
            while n not in seen:
                seen.add(n)
                path.append(n)
                n = self.parent[n]
            order.extend(reversed(path))
        old_parent, old_letter = self.parent, self.letter
        self._reset()
        new = {root: 0}
        for n in order:
            new[n] = self.add(new[old_parent[n]], old_letter[n])
        return [new[n] for n in live]
