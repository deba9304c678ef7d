"""Ensembles as flat arrays: scoring and TreeSHAP for batches of rows, all trees of a group level by level.

A node is a place in parallel arrays (feature, threshold, side of missing values, children, value, share of its
parent's cover); a leaf's children are itself.  The arrays are as large as the model, are shipped once per executor
and make no expression grow with the number of leaves.

TreeSHAP.  For a leaf of value v whose path has distinct features F, with o_i = 1 where the row meets all conditions
of feature i and z_i the product of their cover shares, the Shapley weights are Beta integrals, so

    phi_j = v (o_j - z_j) * integral over s in 0..1 of  product over i in F, i != j, of  z_i (1 - s) + o_i s

which Gauss-Legendre nodes give exactly (the integrand is a polynomial of a degree below |F|).  The product is
carried down each path, so leaves share the work of their common prefix; sums over the leaves below an edge come back
up, and each edge adds what it changes for its feature.  Cost per row: edges x nodes of the quadrature (half the
number of distinct features on a path), against leaves x features^3 when each leaf is expanded by itself."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

GROUP_NODES, ROWS = 2048, 128  # nodes of the trees and rows that are worked on at once


@dataclass
class TreeArrays:
    features: list
    intercept: float
    feature: np.ndarray
    threshold: np.ndarray
    missing_left: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    share: np.ndarray
    roots: np.ndarray
    depth: int

    @classmethod
    def from_leaves(cls, leaves, features, intercept: float) -> "TreeArrays":
        """Rebuild the trees from leaf paths of (feature, lo, hi, null_ok, share)."""
        pos = {f: i for i, f in enumerate(features)}
        feature, threshold, missing, kids, value, share, roots = [], [], [], [], [], [], {}

        def node(part: float) -> int:
            feature.append(0)
            threshold.append(np.inf)
            missing.append(True)
            kids.append([-1, -1])
            value.append(0.0)
            share.append(part)
            return len(feature) - 1

        depth = 0
        for leaf in leaves:
            if leaf.tree not in roots:
                roots[leaf.tree] = node(1.0)
            at = roots[leaf.tree]
            depth = max(depth, len(leaf.path))
            for name, lo, hi, null_ok, part in leaf.path:
                side = 0 if lo == -np.inf else 1
                feature[at], threshold[at], missing[at] = pos[name], hi if side == 0 else lo, bool(null_ok) == (side == 0)
                if kids[at][side] < 0:
                    kids[at][side] = node(part)
                at = kids[at][side]
            value[at] = leaf.value
        children = np.array(kids, np.int64).reshape(-1, 2)
        own = np.arange(len(children))
        if ((children[:, 0] < 0) != (children[:, 1] < 0)).any():
            raise ValueError("a split without one of its two branches")
        return cls(list(features), float(intercept), np.array(feature, np.int64), np.array(threshold, float), np.array(missing, bool),
                   np.where(children[:, 0] < 0, own, children[:, 0]), np.where(children[:, 1] < 0, own, children[:, 1]),
                   np.array(value, float), np.array(share, float), np.array(list(roots.values()), np.int64), depth)

    def margins(self, x: np.ndarray) -> np.ndarray:
        """Intercept plus the reached leaf of every tree; NaN in ``x`` is a missing value."""
        out = np.full(len(x), self.intercept)
        step = max(1, 1_000_000 // max(1, len(self.roots)))
        for lo in range(0, len(x), step):
            part = x[lo:lo + step]
            row = np.arange(len(part))[:, None]
            at = np.broadcast_to(self.roots, (len(part), len(self.roots)))
            for _ in range(self.depth):
                v = part[row, self.feature[at]]
                goes_left = np.where(np.isnan(v), self.missing_left[at], v <= self.threshold[at])
                at = np.where(goes_left, self.left[at], self.right[at])
            # tree by tree, as a sum of one addition after another
            out[lo:lo + step] += np.add.accumulate(self.value[at], axis=1)[:, -1] if len(self.roots) else 0.0
        return out


@dataclass
class _Level:
    """Nodes of one depth in a group of trees; the two children of the k-th split above are at 2k and 2k + 1."""
    parent: np.ndarray  # place in the level above
    feature: np.ndarray  # of the split above
    threshold: np.ndarray
    missing_left: np.ndarray
    is_left: np.ndarray
    slot: np.ndarray  # where the node's cumulative indicator is kept
    up: np.ndarray  # slot of the nearest edge above with the same feature; the last slot (always 1) if there is none
    z: np.ndarray  # cumulative cover share of the feature, here and at that edge
    z_up: np.ndarray
    split: np.ndarray  # which nodes are splits
    value: np.ndarray
    onehot: np.ndarray


class ShapPlan:
    """What TreeSHAP needs of an ensemble, worked out once."""

    def __init__(self, trees: TreeArrays, base: float):
        self.base, self.width = base, len(trees.features)
        self.groups: list[tuple[list[_Level], int]] = []
        most = 1
        sizes = [len(self._nodes(trees, r)) for r in trees.roots]
        group: list[int] = []
        for r, n in zip([*trees.roots, None], [*sizes, GROUP_NODES]):
            if group and (r is None or sum(s for _, s in group) + n > GROUP_NODES):
                levels, slots, distinct = self._levels(trees, [g for g, _ in group])
                self.groups.append((levels, slots))
                most, group = max(most, distinct), []
            if r is not None:
                group.append((int(r), n))
        nodes, weights = np.polynomial.legendre.leggauss(-(-most // 2))
        self.s, self.w = (nodes + 1) / 2, weights / 2

    @staticmethod
    def _nodes(t: TreeArrays, root: int) -> list[int]:
        out, todo = [], [root]
        while todo:
            n = todo.pop()
            out.append(n)
            if t.left[n] != n:
                todo += [int(t.left[n]), int(t.right[n])]
        return out

    def _levels(self, t: TreeArrays, roots: list[int]):
        """(levels, slots, most distinct features on a path) of a group of trees."""
        now = [(r, {}) for r in roots]  # node, feature -> (slot, cumulative share)
        levels, slots, distinct = [], 0, 1
        split = np.array([t.left[r] != r for r, _ in now])
        levels.append((split, np.array([t.value[r] for r, _ in now])))
        while split.any():
            rows, nxt = [], []
            for k, (n, path) in enumerate(now):
                if t.left[n] == n:
                    continue
                f = int(t.feature[n])
                up, z_up = path.get(f, (-1, 1.0))
                for child, is_left in ((int(t.left[n]), True), (int(t.right[n]), False)):
                    z = z_up * t.share[child]
                    rows.append((k, f, t.threshold[n], t.missing_left[n], is_left, slots, up, z, z_up, t.left[child] != child, t.value[child]))
                    nxt.append((child, {**path, f: (slots, z)}))
                    distinct = max(distinct, len(nxt[-1][1]))
                    slots += 1
            cols = [np.array(c) for c in zip(*rows)]
            levels.append(_Level(*cols, np.eye(self.width)[cols[1]]))
            now, split = nxt, cols[9]
        for level in levels[1:]:
            level.up = np.where(level.up < 0, slots, level.up)
        return levels, slots, distinct

    def values(self, x: np.ndarray) -> np.ndarray:
        """SHAP values (rows x features) of the margin; NaN in ``x`` is a missing value."""
        out = np.zeros((len(x), self.width))
        for lo in range(0, len(x), ROWS):
            for levels, slots in self.groups:
                out[lo:lo + ROWS] += self._group(x[lo:lo + ROWS], levels, slots)
        return out

    def _group(self, x: np.ndarray, levels: list, slots: int) -> np.ndarray:
        n, s, w = len(x), self.s, self.w
        out = np.zeros((n, self.width))
        met = np.ones((n, slots + 1))
        product = np.ones((n, len(levels[0][0]), len(s)))
        held = []
        for level in levels[1:]:
            v = x[:, level.feature]
            left = np.where(np.isnan(v), level.missing_left, v <= level.threshold)
            o_up = met[:, level.up]
            o = o_up * (left == level.is_left)
            met[:, level.slot] = o
            here = np.maximum(level.z[:, None] * (1 - s) + o[:, :, None] * s, 1e-300)
            above = np.maximum(level.z_up[:, None] * (1 - s) + o_up[:, :, None] * s, 1e-300)
            product = product[:, level.parent] * here / above
            held.append((level, (o - level.z)[:, :, None] / here - (o_up - level.z_up)[:, :, None] / above, product))
        below = None
        for level, change, product in reversed(held):
            total = product * level.value[:, None]
            if below is not None:
                total[:, level.split] = below
            out += np.einsum("nmq,q->nm", change * total, w) @ level.onehot
            below = total[:, 0::2] + total[:, 1::2]
        return out
