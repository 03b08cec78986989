"""Small gradient-boosted trees for a two-class score, which can be written as an SQL expression."""

from __future__ import annotations

import math

import numpy as np

Node = tuple  # (feature, threshold, left, right) or (value,)


class BoostedTrees:
    """Sum of regression trees fitted to the logistic loss with second-order steps."""

    def __init__(self, base: float, trees: list[Node]):
        self.base, self.trees = base, trees

    @classmethod
    def fit(cls, x, y, rounds: int = 40, depth: int = 3, rate: float = 0.3, l2: float = 1.0, bins: int = 24) -> BoostedTrees:
        x, y = np.asarray(x, float), np.asarray(y, float)
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
        rate_of_ones = min(max(y.mean(), 1e-3), 1 - 1e-3)
        base = math.log(rate_of_ones / (1 - rate_of_ones))
        score, trees = np.full(len(y), base), []
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)

            def grow(rows: np.ndarray, left: int) -> Node:
                g_all, h_all = g[rows].sum(), h[rows].sum()
                best = (1e-3, None)
                for f in range(x.shape[1]) if left else ():
                    values = x[rows, f]
                    for t in edges[f]:
                        low = values <= t
                        if 3 <= low.sum() <= len(rows) - 3:
                            gl, hl = g[rows[low]].sum(), h[rows[low]].sum()
                            gain = gl**2 / (hl + l2) + (g_all - gl) ** 2 / (h_all - hl + l2) - g_all**2 / (h_all + l2)
                            if gain > best[0]:
                                best = (gain, (f, float(t), low))
                if best[1] is None:
                    return (float(rate * g_all / (h_all + l2)),)
                f, t, low = best[1]
                return (f, t, grow(rows[low], left - 1), grow(rows[~low], left - 1))

            tree = grow(np.arange(len(y)), depth)
            trees.append(tree)
            score = score + np.array([cls._value(tree, r) for r in x])
            if len(tree) == 1:
                break
        return cls(base, trees)

    @staticmethod
    def _value(node: Node, row) -> float:
        while len(node) > 1:
            node = node[2] if row[node[0]] <= node[1] else node[3]
        return node[0]

    def scores(self, x) -> list[float]:
        return [self.base + sum(self._value(t, r) for t in self.trees) for r in x]

    def sql(self, row: str) -> str:
        """The score of a struct with fields f0, f1, ... as SQL."""

        def of(node: Node) -> str:
            if len(node) == 1:
                return f"{node[0]!r}D"
            return f"CASE WHEN {row}.f{node[0]} <= {node[1]!r}D THEN {of(node[2])} ELSE {of(node[3])} END"

        return "(" + " + ".join([f"{self.base!r}D", *(of(t) for t in self.trees)]) + ")"

    @staticmethod
    def calibrated_cut(scores: list[float], labels: list[int], precision: float) -> float:
        """Platt's logistic fit of held-out labels; then the lowest score whose mean chance from there up reaches the precision."""
        if not labels or len(set(labels)) < 2:
            return 0.0
        s, y = np.array(scores), np.array(labels, float)
        a, b = 1.0, 0.0
        for _ in range(50):
            p = 1 / (1 + np.exp(-(a * s + b)))
            w = np.maximum(p * (1 - p), 1e-6)
            h = np.array([[(w * s * s).sum() + 0.1, (w * s).sum()], [(w * s).sum(), w.sum() + 0.1]])
            step = np.linalg.solve(h, [((y - p) * s).sum() - 0.1 * (a - 1), (y - p).sum() - 0.1 * b])
            a, b = a + step[0], b + step[1]
        order = np.argsort(-s, kind="stable")
        chance = 1 / (1 + np.exp(-(a * s[order] + b)))
        mean = np.cumsum(chance) / np.arange(1, len(s) + 1)
        good = np.flatnonzero((mean >= precision) & (chance >= 0.5))
        at = int(good[-1]) if len(good) else 0
        below = s[order][at + 1] if at + 1 < len(s) else s[order][at]
        return float((s[order][at] + below) / 2)
