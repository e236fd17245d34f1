"""Regression forests in numpy, all trees of a forest grown level by level at once, and Shapley values.

One forest costs a few dozen array operations per level, whatever its number of trees. ``trees.java`` does the same
with the same random numbers, row by row, and is what queries run; this one is for single forests and tells what it must give.
"""

from __future__ import annotations

import numpy as np


class Forest:
    """Bootstrap regression trees: squared error, all features at every split, thresholds at midpoints.

    A node is a leaf at ``max_depth``, with fewer than ``min_split`` drawn rows, or when its targets are
    equal. ``weights`` multiply the bootstrap counts.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray, weights: np.ndarray, trees: int, max_depth: int | None, min_split: int, seed):
        n, p = x.shape
        rng = np.random.default_rng(seed)
        # How often each tree draws each row.
        draws = rng.integers(0, n, (trees, n))
        count = np.zeros((trees, n))
        np.add.at(count, (np.repeat(np.arange(trees), n), draws.ravel()), 1.0)
        w = count * weights
        self.features = p
        tree = np.repeat(np.arange(trees), n)
        row = np.tile(np.arange(n), trees)
        live = w.ravel() > 0
        # Rows of weight 0 take no part, but a tree that drew only such rows falls back on its counts.
        empty = ~np.isin(np.arange(trees), tree[live])
        if empty.any():
            w[empty] = count[empty]
            live = w.ravel() > 0
        tree, row, ww, cc = tree[live], row[live], w.ravel()[live], count.ravel()[live]
        node = tree.copy()
        orders = [np.argsort(x[:, f], kind="stable").argsort(kind="stable") for f in range(p)]
        feature, threshold, left = [np.full(trees, -1)], [np.zeros(trees)], [np.full(trees, -1)]
        value, cover, rows_drawn = [], [], []
        first, width, depth = 0, trees, 0
        while True:
            local = node - first
            sw = np.bincount(local, ww, width)
            sy = np.bincount(local, ww * y[row], width)
            syy = np.bincount(local, ww * y[row] ** 2, width)
            drawn = np.bincount(local, cc, width)
            mean = sy / sw
            value.append(mean)
            cover.append(sw)
            rows_drawn.append(drawn)
            impurity = syy / sw - mean * mean
            ok = (drawn >= min_split) & (impurity > 1e-12 * np.maximum(1.0, mean * mean))
            if max_depth is not None and depth >= max_depth:
                ok[:] = False
            best = np.full(width, -np.inf)
            bf, bt = np.full(width, -1), np.zeros(width)
            if ok.any():
                part = np.flatnonzero(ok[local])
                # Equally good splits of several features are settled by lot, node by node.
                lot, drawn_lot = rng.random((p, width)), np.zeros(width)
                for f in range(p):
                    o = part[np.lexsort((orders[f][row[part]], local[part]))]
                    nd, v = local[o], x[row[o], f]
                    cw, cy = np.cumsum(ww[o]), np.cumsum(ww[o] * y[row[o]])
                    start = np.flatnonzero(np.concatenate(([True], nd[1:] != nd[:-1])))
                    size = np.diff(np.append(start, len(nd)))
                    bw = np.repeat(np.concatenate(([0.0], cw))[start], size)
                    by = np.repeat(np.concatenate(([0.0], cy))[start], size)
                    lw, ly = cw - bw, cy - by
                    rw, ry = sw[nd] - lw, sy[nd] - ly
                    cut = np.concatenate(((nd[1:] == nd[:-1]) & (v[1:] > v[:-1]), [False]))
                    with np.errstate(divide="ignore", invalid="ignore"):
                        gain = np.where(cut & (lw > 0) & (rw > 0), ly * ly / lw + ry * ry / rw, -np.inf)
                    top = np.maximum.reduceat(gain, start)
                    at = np.flatnonzero(gain == np.repeat(top, size))
                    at = at[np.concatenate(([True], nd[at][1:] != nd[at][:-1]))] if len(at) else at
                    node_at = nd[at]
                    with np.errstate(invalid="ignore"):
                        level = np.abs(gain[at] - best[node_at]) <= 1e-9 * np.maximum(1.0, np.abs(gain[at]))
                    better = np.isfinite(gain[at]) & np.where(level, lot[f, node_at] > drawn_lot[node_at], gain[at] > best[node_at])
                    at, node_at = at[better], node_at[better]
                    best[node_at], bf[node_at], drawn_lot[node_at] = gain[at], f, lot[f, node_at]
                    mid = (v[at] + v[at + 1]) / 2
                    bt[node_at] = np.where(mid < v[at + 1], mid, v[at])  # between neighbouring numbers there is none
            split = np.flatnonzero(bf >= 0)
            feature[-1][:] = bf
            threshold[-1][:] = bt
            child = np.full(width, -1)
            nxt = first + width
            child[split] = nxt + 2 * np.arange(len(split))
            left[-1][:] = child
            if not len(split):
                break
            keep = np.flatnonzero(bf[local] >= 0)
            lo = local[keep]
            node = child[lo] + (x[row[keep], bf[lo]] > bt[lo])
            row, ww, cc = row[keep], ww[keep], cc[keep]
            first, width, depth = nxt, 2 * len(split), depth + 1
            feature.append(np.full(width, -1))
            threshold.append(np.zeros(width))
            left.append(np.full(width, -1))
        self.trees = trees
        self.feature, self.threshold, self.left = (np.concatenate(a) for a in (feature, threshold, left))
        self.value, self.cover, self.drawn = np.concatenate(value), np.concatenate(cover), np.concatenate(rows_drawn)
        self.depth = depth

    def predict(self, x: np.ndarray) -> np.ndarray:
        node = np.repeat(np.arange(self.trees)[:, None], len(x), axis=1)
        cols = np.arange(len(x))[None, :]
        for _ in range(self.depth):
            f = self.feature[node]
            go = f >= 0
            node = np.where(go, self.left[node] + (x[cols, np.maximum(f, 0)] > self.threshold[node]), node)
        return self.value[node].mean(axis=0)

    def pruned_sums(self, x: np.ndarray, limits: list[tuple[int | None, int]], step: int = 200_000) -> np.ndarray:
        """(limits x rows): the sums over the trees of their predictions, were they grown to a depth and smallest split only.

        A tree grown further than that has the same nodes up to there, so that one forest serves all limits.
        """
        out = np.zeros((len(limits), len(x)))
        for t in range(self.trees):
            for s in range(0, len(x), step):
                part = x[s : s + step]
                rows = np.arange(len(part))
                node = np.full(len(part), t)
                open_ = np.ones((len(limits), len(part)), bool)
                for depth in range(self.depth + 1):
                    f = self.feature[node]
                    for k, (most, least) in enumerate(limits):
                        ends = open_[k] & ((f < 0) | (self.drawn[node] < least) | (depth >= (self.depth if most is None else most)))
                        out[k, s : s + step][ends] += self.value[node[ends]]
                        open_[k] &= ~ends
                    if not open_.any():
                        break
                    node = np.where(f >= 0, self.left[node] + (part[rows, np.maximum(f, 0)] > self.threshold[node]), node)
        return out

    def _leaves(self, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(leaf values over the number of trees, a, b): per leaf and feature, does the target's path lead
        there as far as this feature decides (0 or 1), and the share of the rows that go there."""
        p = self.features
        node = np.arange(self.trees)
        a, b = np.ones((self.trees, p)), np.ones((self.trees, p))
        values, aa, bb = [], [], []
        while len(node):
            f = self.feature[node]
            leaf = f < 0
            values.append(self.value[node[leaf]])
            aa.append(a[leaf])
            bb.append(b[leaf])
            node, a, b, f = node[~leaf], a[~leaf], b[~leaf], f[~leaf]
            if not len(node):
                break
            l_ = self.left[node]
            goes = (target[f] > self.threshold[node]).astype(float)
            at = np.arange(len(node))
            sides = []
            for side in (0, 1):
                a2, b2 = a.copy(), b.copy()
                a2[at, f] *= goes if side else 1.0 - goes
                b2[at, f] *= self.cover[l_ + side] / self.cover[node]
                sides.append((l_ + side, a2, b2))
            node, a, b = (np.concatenate(z) for z in zip(*sides))
        return np.concatenate(values) / self.trees, np.concatenate(aa), np.concatenate(bb)

    def shap(self, target: np.ndarray, pairs: list[tuple[int, int]] = ()) -> tuple[np.ndarray, np.ndarray, float]:
        """(Shapley values, interaction values of the pairs, base value) of the path-dependent expectation.

        Shapley values are integrals over [0, 1] of the derivatives of the multilinear extension, here
        a polynomial of degree p - 1, which Gauss-Legendre quadrature integrates exactly. A pair's
        value is half its interaction, as one of the two symmetric entries of the matrix.
        """
        v, a, b = self._leaves(np.asarray(target, float))
        p = self.features
        t, weight = np.polynomial.legendre.leggauss(p // 2 + 1)
        t, weight = (t + 1) / 2, weight / 2
        phi, inter = np.zeros(p), np.zeros(len(pairs))
        for tq, wq in zip(t, weight):
            m = tq * a + (1 - tq) * b
            # Products over all features but one, without dividing by what may be 0.
            fore = np.cumprod(np.column_stack((np.ones(len(m)), m[:, :-1])), axis=1)
            back = np.cumprod(np.column_stack((np.ones(len(m)), m[:, :0:-1])), axis=1)[:, ::-1]
            d = a - b
            phi += wq * (v[:, None] * d * fore * back).sum(axis=0)
            for k, (i, j) in enumerate(pairs):
                rest = np.prod(np.delete(m, (i, j), axis=1), axis=1)
                inter[k] += wq * float((v * d[:, i] * d[:, j] * rest).sum()) / 2
        return phi, inter, float((v * np.prod(b, axis=1)).sum())
