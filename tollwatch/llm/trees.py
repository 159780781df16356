"""Gradient-boosted trees with monotonic constraints, as flat numpy node arrays.

Fitted on the driver on a bounded sample; scored on the executors, where all
trees of all rows step down together.
"""

import numpy as np


class Trees:
    """Node arrays of all trees: a leaf points to itself, ``roots`` are the first nodes."""

    def __init__(self, feature, threshold, left, right, value, roots, depth, base):
        self.feature, self.threshold, self.left, self.right = feature, threshold, left, right
        self.value, self.roots, self.depth, self.base = value, roots, depth, base

    def margin(self, x):
        node = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        row = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            node = np.where(x[row, self.feature[node]] <= self.threshold[node],
                            self.left[node], self.right[node])
        return self.base + self.value[node].sum(axis=1)

    def score(self, x):
        """Probability of label 1 for each row."""
        x = np.nan_to_num(np.asarray(x, float))
        parts = [self.margin(x[low:low + 4096]) for low in range(0, len(x), 4096)]
        return 1 / (1 + np.exp(-np.concatenate(parts or [np.zeros(0)])))


def _split(bins, g, h, n_bins, signs, low, high, penalty, least):
    """Best (gain, feature, bin, left value, right value) of a node, or None."""
    best = None
    total_g, total_h = g.sum(), h.sum()
    value = np.clip(-total_g / (total_h + penalty), low, high)

    def gain_of(sg, sh, v):
        return -(sg * v + 0.5 * (sh + penalty) * v * v)

    parent = gain_of(total_g, total_h, value)
    for f in range(bins.shape[1]):
        left_g = np.cumsum(np.bincount(bins[:, f], g, n_bins))[:-1]
        left_h = np.cumsum(np.bincount(bins[:, f], h, n_bins))[:-1]
        right_g, right_h = total_g - left_g, total_h - left_h
        a = np.clip(-left_g / (left_h + penalty), low, high)
        b = np.clip(-right_g / (right_h + penalty), low, high)
        gain = gain_of(left_g, left_h, a) + gain_of(right_g, right_h, b) - parent
        gain[(left_h < least) | (right_h < least) | (signs[f] * (b - a) < 0)] = -np.inf
        k = int(np.argmax(gain))
        if gain[k] > 1e-6 and (best is None or gain[k] > best[0]):
            best = (gain[k], f, k, a[k], b[k])
    return best


def fit(x, y, signs=None, trees=60, depth=3, rate=0.15, n_bins=64, penalty=1.0, least=2.0):
    """Fit to labels 0 and 1. ``signs`` has, for each feature, 1 where the score may only
    rise with it, -1 where it may only fall, 0 where it is free.

    Without both labels the score is the share of label 1, or 0.5 without rows.
    """
    x, y = np.nan_to_num(np.asarray(x, float)), np.asarray(y, float)
    signs = np.zeros(x.shape[1]) if signs is None else np.asarray(signs)
    share = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(share / (1 - share)))
    nodes = {k: [] for k in ("feature", "threshold", "left", "right", "value")}
    roots = []

    def leaf(v):
        at = len(nodes["value"])
        for key, new in (("feature", 0), ("threshold", np.inf), ("left", at), ("right", at),
                         ("value", v * rate)):
            nodes[key].append(new)
        return at

    if 0 < y.sum() < len(y):
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, n_bins)[1:-1]))
                for f in range(x.shape[1])]
        bins = np.stack([np.searchsorted(c, x[:, f], side="left")
                         for f, c in enumerate(cuts)], axis=1)
        margin = np.full(len(y), base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-margin))
            g, h = p - y, p * (1 - p)
            root = leaf(np.clip(-g.sum() / (h.sum() + penalty), -np.inf, np.inf))
            roots.append(root)
            open_nodes = [(root, np.arange(len(y)), -np.inf, np.inf)]
            for _ in range(depth):
                following = []
                for at, rows, low, high in open_nodes:
                    found = _split(bins[rows], g[rows], h[rows], n_bins, signs, low, high,
                                   penalty, least)
                    if found is None or found[2] >= len(cuts[found[1]]):
                        continue
                    _, f, k, a, b = found
                    goes_left = bins[rows, f] <= k
                    children = leaf(a), leaf(b)
                    nodes["feature"][at], nodes["threshold"][at] = f, cuts[f][k]
                    nodes["left"][at], nodes["right"][at] = children
                    middle = (a + b) / 2
                    lows = (low, middle) if signs[f] > 0 else (middle, low) if signs[f] < 0 \
                        else (low, low)
                    highs = (middle, high) if signs[f] > 0 else (high, middle) if signs[f] < 0 \
                        else (high, high)
                    following += [
                        (children[0], rows[goes_left], lows[0], highs[0]),
                        (children[1], rows[~goes_left], lows[1], highs[1])]
                open_nodes = following
            grown = Trees(*(np.array(nodes[k]) for k in nodes), np.array([root]), depth, 0.0)
            margin += grown.margin(x)
    arrays = {k: np.array(v, float if k in ("threshold", "value") else int)
              for k, v in nodes.items()}
    return Trees(*arrays.values(), np.array(roots, int), depth, base)
