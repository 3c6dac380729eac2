"""Trees grown on counted cells, inside tasks.

Rows whose features lie in the same bins take the same way through every tree, so a
tree sees only how many rows of a class a cell holds. Choice of features, gain, the
limits of a node and the merging of leaves are those of MLlib's forest.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

# Below this a node counts as pure.
PURE = 1e-16


def bin_limits(rows: Sequence[int], least: Sequence[float], most: Sequence[float], bins: int) -> list[float]:
    """At most `bins - 1` limits between ascending buckets of values, so that bins hold about equally many rows.

    All limits if there are so few buckets. Else a bucket that fills a bin has one with at
    most half a bin of its neighbours, and the others share what is left. A value belongs
    left of a limit it equals.
    """
    rows = np.asarray(rows, dtype=np.int64)
    last = len(rows) - 1
    if last < bins:
        return [_between(most[i], least[i + 1]) for i in range(last)]
    full = rows * bins >= rows.sum()
    left, open_bins = int(rows[~full].sum()), bins - int(full.sum())
    share = left / open_bins if open_bins else np.inf
    limits, held = [], 0
    for i in range(last):
        if not full[i]:
            left -= int(rows[i])
        held += int(rows[i])
        if full[i] or held >= share or (full[i + 1] and held >= max(1.0, share / 2)):
            limits.append(_between(most[i], least[i + 1]))
            if len(limits) == bins - 1:
                break
            if not full[i]:
                open_bins -= 1
                share = left / open_bins if open_bins > 0 else np.inf
            held = 0
    return limits


def _between(low: float, high: float) -> float:
    """The middle, or the lower value where there is none (infinite, unknown, or next to each other)."""
    middle = low / 2 + high / 2
    return middle if low <= middle < high else low


def bootstrap(copies: np.ndarray, r: np.random.Generator) -> np.ndarray:
    """How often the rows of each cell are drawn, if each is drawn Poisson(1) times: their sum is Poisson too."""
    return r.poisson(copies).astype(float)


def grow(
    codes: np.ndarray, label: np.ndarray, drawn: np.ndarray, depth: int, per_node: int, r: np.random.Generator
) -> dict[str, list]:
    """A tree on cells: `codes` (cells x features) are their bins, `label` is 0 or 1, `drawn` counts rows.

    Every node looks at `per_node` features chosen at random. Nodes come with their
    counts per class, gain, and where they split: a row goes left whose bin is at most `cut`.
    """
    tree = {k: [] for k in ("left", "right", "feature", "cut", "gain", "stats")}

    def add(stats: np.ndarray) -> int:
        for k, v in (("left", -1), ("right", -1), ("feature", -1), ("cut", -1), ("gain", -1.0), ("stats", stats)):
            tree[k].append(v)
        return len(tree["left"]) - 1

    bins = int(codes.max(initial=0)) + 1
    open_nodes = [add(np.bincount(label, drawn, 2))]
    # Place of each cell's node among the open ones; cells of no open node are left out.
    at = np.zeros(len(label), dtype=np.int64)
    for level in range(depth):
        if not open_nodes:
            break
        counts = [
            np.bincount((at * bins + codes[:, f]) * 2 + label, drawn, len(open_nodes) * bins * 2).reshape(-1, bins, 2)
            for f in range(codes.shape[1])
        ]
        next_open, feature, cut, places = [], np.zeros(len(open_nodes), np.int64), np.zeros(len(open_nodes), np.int64), []
        for i, node in enumerate(open_nodes):
            best = (0.0, -1, -1, None)
            for f in sorted(r.permutation(codes.shape[1])[:per_node]):
                left = np.cumsum(counts[f][i], axis=0)[:-1]
                gains = _gains(left, tree["stats"][node])
                if len(gains) and gains.max() > best[0]:
                    k = int(gains.argmax())
                    best = (float(gains[k]), int(f), k, left[k])
            places.append((-1, -1))
            if best[3] is None:
                continue
            tree["gain"][node], tree["feature"][node], tree["cut"][node], stats = best
            feature[i], cut[i] = best[1], best[2]
            below = []
            for side, part in (("left", stats), ("right", tree["stats"][node] - stats)):
                tree[side][node] = child = add(part)
                if level + 1 < depth and impurity(part) > PURE:
                    below.append(len(next_open))
                    next_open.append(child)
                else:
                    below.append(-1)
            places[i] = tuple(below)
        right = codes[np.arange(len(at)), feature[at]] > cut[at]
        at = np.array(places)[at, right.astype(np.int64)]
        kept = at >= 0
        codes, label, drawn, at = codes[kept], label[kept], drawn[kept], at[kept]
        open_nodes = next_open
    return _merged(tree)


def impurity(stats: np.ndarray) -> np.ndarray:
    """Gini impurity of counts per class, 0 of none."""
    total = stats.sum(axis=-1)
    return np.where(total > 0, 1 - (stats**2).sum(axis=-1) / np.maximum(total, 1) ** 2, 0.0)


def _gains(left: np.ndarray, stats: np.ndarray) -> np.ndarray:
    """What each split takes from the impurity; -1 where a side is empty."""
    right, total = stats - left, stats.sum()
    lower, upper = left.sum(axis=1), right.sum(axis=1)
    gain = impurity(stats) - lower / max(total, 1) * impurity(left) - upper / max(total, 1) * impurity(right)
    return np.where((lower >= 1) & (upper >= 1), gain, -1.0)


def _merged(tree: dict[str, list]) -> dict[str, list]:
    """Leaves of one parent that say the same class become one, from the bottom up; nodes numbered parents first, left before right."""
    says = [int(stats.argmax()) for stats in tree["stats"]]
    leaf = [below < 0 for below in tree["left"]]
    for node in reversed(range(len(leaf))):  # children come after their parents
        a, b = tree["left"][node], tree["right"][node]
        leaf[node] = leaf[node] or (leaf[a] and leaf[b] and says[a] == says[b])
    out = {k: [] for k in tree}

    def copy(node: int) -> int:
        new = len(out["left"])
        for k in out:
            out[k].append(tree[k][node])
        if leaf[node]:
            out["left"][new] = out["right"][new] = out["feature"][new] = out["cut"][new] = -1
            out["gain"][new] = -1.0
        else:
            out["left"][new] = copy(tree["left"][node])
            out["right"][new] = copy(tree["right"][node])
        return new

    copy(0)
    return out
