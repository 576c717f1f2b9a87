"""Gradient boosted trees for a few numeric features: fitted with numpy, read as Spark SQL."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Boosted:
    """Sums of small trees for the log odds. A tree is a value, or (feature, cut, below or at, above)."""

    features: list[str]
    start: float = 0.0
    trees: list = field(default_factory=list)

    @classmethod
    def fit(cls, features: list[str], x: np.ndarray, y: np.ndarray, trees: int = 25, depth: int = 3, rate: float = 0.3, least: int = 8) -> Boosted:
        share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
        model = cls(features, float(np.log(share / (1 - share))))
        margin = np.full(len(y), model.start)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-margin))
            tree = _grow(x, y - p, p * (1 - p), np.arange(len(y)), depth, rate, least)
            model.trees.append(tree)
            margin += np.array([_walk(tree, row) for row in x])
        return model

    def margins(self, x: np.ndarray) -> np.ndarray:
        return np.array([self.start + sum(_walk(t, row) for t in self.trees) for row in x])

    def sql(self, of: str) -> str:
        """An expression over the fields of the struct ``of``."""
        return " + ".join([f"{self.start:.6f}D", *(_sql(t, of, self.features) for t in self.trees)])


def _grow(x, g, h, rows, depth, rate, least):
    value = round(float(rate * g[rows].sum() / (h[rows].sum() + 1.0)), 6)
    if depth == 0 or len(rows) < 2 * least:
        return value
    best, split = 1e-6, None
    total_g, total_h = g[rows].sum(), h[rows].sum()
    for f in range(x.shape[1]):
        order = rows[np.argsort(x[rows, f], kind="stable")]
        v, cg, ch = x[order, f], np.cumsum(g[order]), np.cumsum(h[order])
        at = np.flatnonzero(v[:-1] < v[1:])
        at = at[(at + 1 >= least) & (len(v) - at - 1 >= least)]
        if len(at):
            gain = cg[at] ** 2 / (ch[at] + 1) + (total_g - cg[at]) ** 2 / (total_h - ch[at] + 1) - total_g**2 / (total_h + 1)
            if gain.max() > best:
                i = at[gain.argmax()]
                best, split = float(gain.max()), (f, float(v[i] + v[i + 1]) / 2)
    if split is None:
        return value
    below = x[rows, split[0]] <= split[1]
    return (*split, _grow(x, g, h, rows[below], depth - 1, rate, least), _grow(x, g, h, rows[~below], depth - 1, rate, least))


def _walk(tree, row) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def _sql(tree, of: str, features: list[str]) -> str:
    if not isinstance(tree, tuple):
        return f"{tree:.6f}D"
    f, cut, low, high = tree
    return f"IF({of}.{features[f]} <= {cut:.4f}D, {_sql(low, of, features)}, {_sql(high, of, features)})"
