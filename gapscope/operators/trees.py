"""Classification trees over counted cells of binned features: forests, one tree, boosting.

Rows that fall into the same bins of all features are alike to a tree, so trees are grown from
*cells*: a vector of bins with its numbers of negative and positive rows. A level of a tree is one
histogram over (node, feature, bin) for all its nodes, whatever their number. Everything drawn at
random (bags, rows of a boosting round, features) comes from generators seeded by the tree's own
numbers over cells in a fixed order, so the same rows give the same trees however they are stored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

#: Entries of a histogram built at a time.
HISTOGRAM = 1 << 19
#: The L2 penalty and the least Hessian of a leaf in boosting.
LEAF_PENALTY, LEAST_HESSIAN = 1.0, 1.0


@dataclass
class Tree:
    """Nodes in order of depth; ``feature`` is -1 at a leaf, the right child follows the left."""

    feature: np.ndarray
    cut: np.ndarray  # a row goes left where its bin is not above
    left: np.ndarray
    value: np.ndarray

    def leaf_values(self, bins: np.ndarray) -> np.ndarray:
        return value_sums([self], bins)


#: Nodes looked up at a time when trees are applied.
LOOKED_UP = 1 << 18


def value_sums(trees: list[Tree], bins: np.ndarray) -> np.ndarray:
    """Sum of the trees' leaf values for every row; all trees walk down together."""
    feature, cut, value = (np.concatenate([getattr(t, n) for t in trees]) for n in ("feature", "cut", "value"))
    roots = np.cumsum([0, *[len(t.feature) for t in trees[:-1]]])
    left = np.concatenate([t.left + r for t, r in zip(trees, roots)])
    out = np.zeros(len(bins))
    step = max(1, LOOKED_UP // len(trees))
    for lo in range(0, len(bins), step):
        part = bins[lo : lo + step]
        row = np.repeat(np.arange(len(part)), len(trees))
        node = np.tile(roots, len(part))
        at = np.flatnonzero(feature[node] >= 0)
        while len(at):
            here = node[at]
            node[at] = here = left[here] + (part[row[at], feature[here]] > cut[here])
            at = at[feature[here] >= 0]
        out[lo : lo + step] = value[node].reshape(len(part), len(trees)).sum(axis=1)
    return out


def _gini(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    n = a + b
    return np.divide(a * a + b * b, n, out=np.zeros_like(n), where=n > 0)


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + LEAF_PENALTY)


def _dense_splits(bins, at, node, size, widths, first, second, least, allowed):
    """Best gain and cut of every (node, feature) in boosting, -1 where there is none."""
    best, cuts = np.full((size, len(widths)), -1.0), np.zeros((size, len(widths)), dtype=np.int64)
    for f in np.flatnonzero(allowed):
        shape = (size, int(widths[f]))
        flat = node * shape[1] + bins[:, f][at]
        hist = [np.bincount(flat, s[at], minlength=shape[0] * shape[1]).reshape(shape) for s in (first, second)]
        best[:, f], cuts[:, f] = best_cuts(*hist, least)
    return best, cuts


def best_cuts(first: np.ndarray, second: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Best gain of boosting and its cut from the sums by (node, bin) of a feature."""
    below = [np.cumsum(h, axis=1)[:, :-1] for h in (first, second)]
    total = [h.sum(axis=1, keepdims=True) for h in (first, second)]
    above = [t - b for t, b in zip(total, below)]
    won = _gain(*below) + _gain(*above) - _gain(*total)
    won = np.where((below[1] >= least) & (above[1] >= least) & (won > 1e-9), won, -1.0)
    return won.max(axis=1), won.argmax(axis=1)


def _count_splits(bins, at, node, widths, first, second, least, wanted):
    """Best gain and cut of every wanted (node, feature) by class counts, -1 where there is none.

    Gains are worked out at the occupied bins only, so a level of many small nodes costs no more
    than its cells.
    """
    best, cuts = np.full(wanted.shape, -1.0), np.zeros(wanted.shape, dtype=np.int64)
    for f in np.flatnonzero(wanted.any(axis=0)):
        asked, width = np.flatnonzero(wanted[:, f]), int(widths[f])
        place = np.cumsum(wanted[:, f]) - 1
        mine = np.flatnonzero(wanted[:, f][node])
        cell = at[mine]
        flat = place[node[mine]] * width + bins[:, f][cell]
        hist = [np.bincount(flat, s[cell], minlength=len(asked) * width) for s in (first, second)]
        held = np.flatnonzero(hist[0] + hist[1])
        own = held // width
        starts = np.flatnonzero(np.diff(own, prepend=-1))
        upto = [np.cumsum(h[held]) for h in hist]
        before = [np.concatenate(([0.0], u))[starts] for u in upto]
        total = [np.append(b[1:], u[-1]) - b for b, u in zip(before, upto)]
        below = [u - b[own] for u, b in zip(upto, before)]
        above = [t[own] - b for t, b in zip(total, below)]
        won = _gini(*below) + _gini(*above) - _gini(*total)[own]
        won = np.where((below[0] + below[1] >= least) & (above[0] + above[1] >= least) & (won > 1e-9), won, -1.0)
        best[asked, f] = top = np.maximum.reduceat(won, starts)
        hit = np.flatnonzero(won == top[own])
        cuts[asked, f] = held[hit[np.flatnonzero(np.diff(own[hit], prepend=-1))]] % width
    return best, cuts


def grow(
    bins: np.ndarray, widths: np.ndarray, first: np.ndarray, second: np.ndarray, depth: int, least: float,
    boosting: bool, rng: np.random.Generator | None = None, per_node: int | None = None, allowed: np.ndarray | None = None,
) -> Tree:
    """A tree from two statistics per cell: class counts, or gradient and Hessian in boosting.

    ``least`` is the smallest number of rows (Hessian) of a leaf; ``per_node`` features are drawn at
    every node, and all are looked at where none of the drawn ones can split it; ``allowed`` limits
    the tree's features.
    """
    p, bins = bins.shape[1], np.asfortranarray(bins)
    allowed = np.ones(p, dtype=bool) if allowed is None else allowed
    feature, cut, left, sums = [np.array([-1])], [np.array([0])], [np.array([0])], [np.array([[first.sum(), second.sum()]])]
    live = np.flatnonzero((first != 0) | (second != 0))
    node = np.zeros(len(live), dtype=np.int64)  # position of the cell's node in its level
    start, size = 0, 1
    for _ in range(depth):
        chosen_f, chosen_c = np.full(size, -1), np.zeros(size, dtype=np.int64)
        step = max(1, HISTOGRAM // int(widths.max()))
        for lo in range(0, size, step):
            hi = min(lo + step, size)
            cells = slice(None) if step >= size else np.flatnonzero((node >= lo) & (node < hi))
            at, inside = live[cells], node[cells] - lo
            if boosting:
                best, cuts = _dense_splits(bins, at, inside, hi - lo, widths, first, second, least, allowed)
            else:
                a, b = sums[-1][lo:hi].T
                mixed = (a > 0) & (b > 0) & (a + b >= 2 * least)
                wanted = mixed[:, None] & allowed
                drawn = rng.random((hi - lo, p)).argsort(axis=1) < per_node if per_node is not None and per_node < p else None
                best, cuts = _count_splits(bins, at, inside, widths, first, second, least, wanted if drawn is None else wanted & drawn)
                if drawn is not None:
                    rest = wanted & (best.max(axis=1) <= 0)[:, None]
                    few = np.flatnonzero(rest[inside, :].any(axis=1))
                    other, other_cuts = _count_splits(bins, at[few], inside[few], widths, first, second, least, rest)
                    best, cuts = np.where(rest, other, best), np.where(rest, other_cuts, cuts)
            f = best.argmax(axis=1)
            row = np.arange(hi - lo)
            chosen_f[lo:hi] = np.where(best[row, f] > 0, f, -1)
            chosen_c[lo:hi] = np.where(best[row, f] > 0, cuts[row, f], 0)
        splits = chosen_f >= 0
        if not splits.any():
            break
        child = np.cumsum(splits) - 1
        feature[-1], cut[-1] = chosen_f, chosen_c
        left[-1] = np.where(splits, start + size + 2 * child, 0)
        kept = splits[node]
        live, node = live[kept], node[kept]
        right = bins[live, chosen_f[node]] > chosen_c[node]
        node = 2 * child[node] + right
        start, size = start + size, 2 * int(splits.sum())
        sums.append(np.column_stack([np.bincount(node, s[live], minlength=size) for s in (first, second)]))
        feature.append(np.full(size, -1))
        cut.append(np.zeros(size, dtype=np.int64))
        left.append(np.zeros(size, dtype=np.int64))
    a, b = np.concatenate(sums).T
    value = -a / (b + LEAF_PENALTY) if boosting else np.divide(b, a + b, out=np.zeros_like(b), where=a + b > 0)
    return Tree(
        np.concatenate(feature).astype(np.int16), np.concatenate(cut).astype(np.int16), np.concatenate(left).astype(np.int32), value
    )


def single_tree(bins, widths, neg, pos, depth: int, least: int) -> list[Tree]:
    return [grow(bins, widths, neg, pos, depth, least, False)]


def forest(bins, widths, neg, pos, depth: int, least: int, seeds: list[tuple[int, ...]]) -> list[Tree]:
    """A tree per seed, each from a bag of as many rows as there are, drawn with replacement."""
    p, counts = bins.shape[1], np.concatenate((neg, pos)).astype(float)
    total = int(counts.sum())
    trees = []
    for seed in seeds:
        rng = np.random.default_rng(seed)
        bag = rng.multinomial(total, counts / total).astype(float)
        trees.append(grow(bins, widths, bag[: len(neg)], bag[len(neg) :], depth, least, False, rng, max(1, math.isqrt(p))))
    return trees


def boosted(
    bins, widths, neg, pos, rounds: int, depth: int, rate: float, row_share: float, column_share: float, seed: tuple[int, ...],
) -> tuple[float, list[Tree]]:
    """Base log-odds and the trees of gradient boosting on the logistic loss (leaf values hold the rate)."""
    rng, p = np.random.default_rng(seed), bins.shape[1]
    base = math.log(max(pos.sum(), 0.5) / max(neg.sum(), 0.5))
    margin, trees = np.full(len(neg), base), []
    for _ in range(rounds):
        n0, n1 = neg, pos
        if row_share < 1.0:
            n0, n1 = rng.binomial(neg.astype(np.int64), row_share), rng.binomial(pos.astype(np.int64), row_share)
        allowed = np.ones(p, dtype=bool)
        if column_share < 1.0:
            allowed[:] = False
            allowed[rng.permutation(p)[: max(1, int(column_share * p))]] = True
        mu = 1.0 / (1.0 + np.exp(-margin))
        tree = grow(bins, widths, (n0 + n1) * mu - n1, (n0 + n1) * mu * (1.0 - mu), depth, LEAST_HESSIAN, True, allowed=allowed)
        tree.value = rate * tree.value
        margin = margin + tree.leaf_values(bins)
        trees.append(tree)
    return base, trees


def packed(trees: list[Tree]) -> bytes:
    """Trees as bytes: their number, their sizes, features and cuts of all nodes, values of the leaves.

    The children of the k-th split of a tree are its nodes 2k + 1 and 2k + 2, so they are not written.
    """
    sizes = np.array([len(trees), *[len(t.feature) for t in trees]], dtype="<i4")
    feature, cut, value = (np.concatenate([getattr(t, name) for t in trees]) for name in ("feature", "cut", "value"))
    kind = "<i1" if max(feature.max(), cut.max()) < 128 else "<i2"
    return b"".join([kind.encode(), sizes.tobytes(), feature.astype(kind).tobytes(), cut.astype(kind).tobytes(), value[feature < 0].tobytes()])


def unpacked(raw: bytes) -> list[Tree]:
    raw = memoryview(raw)
    kind, count = bytes(raw[:3]).decode(), int(np.frombuffer(raw[3:7], dtype="<i4")[0])
    sizes = np.frombuffer(raw, dtype="<i4", count=count, offset=7)
    nodes, at = int(sizes.sum()), 4 * count + 7
    feature, cut = np.frombuffer(raw, dtype=kind, count=2 * nodes, offset=at).reshape(2, nodes)
    value = np.zeros(nodes)
    value[feature < 0] = np.frombuffer(raw[at + feature.nbytes + cut.nbytes :], dtype="<f8")
    trees = []
    for f, c, v in zip(*[np.split(a, np.cumsum(sizes)[:-1]) for a in (feature, cut, value)]):
        trees.append(Tree(f, c, np.where(f >= 0, 2 * np.cumsum(f >= 0) - 1, 0).astype(np.int32), v))
    return trees
