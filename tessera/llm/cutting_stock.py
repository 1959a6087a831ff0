"""Cutting stock by column generation, over a histogram of sizes.

The linear program asks for the fewest bins of a capacity such that the patterns used hold every size as
often as demanded. Its columns are generated: the duals of the patterns at hand price the sizes, an unbounded
knapsack over the capacity finds the pattern worth most, and it enters by a simplex step. Prices are drawn
towards those of the best lower bound so far, at first the sizes themselves, which spares most steps. This goes
on until no pattern is worth more than a bin, until the bins are within GAP of the lower bound or no more than it rounded
up to whole bins (which nothing can undercut), or for MOST_STEPS. The histogram has at most as many sizes as the capacity, so the work does not grow with what it counts.
"""

from __future__ import annotations

import numpy as np

GAP = 1e-5
SMOOTHING = 0.7
MOST_STEPS = 1500


def best_pattern(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Knapsack by dynamic programming: how many of each size make the most worth within the capacity."""
    use = np.flatnonzero(worth > 1e-12)
    order = use[np.argsort(sizes[use])]
    s, w = sizes[order], worth[order]
    best, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fits = np.searchsorted(s, np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if k := fits[c]:
            value = best[c - s[:k]] + w[:k]
            i = value.argmax()
            if value[i] > best[c] + 1e-15:
                best[c], took[c] = value[i], i
    counts, c = np.zeros(len(sizes)), capacity
    while c > 0:
        if took[c] < 0:
            c -= 1
        else:
            counts[order[took[c]]] += 1
            c -= s[took[c]]
    return float(best[capacity]), counts


def bounded_pattern(sizes: np.ndarray, worth: np.ndarray, most: np.ndarray, capacity: int) -> np.ndarray:
    """As best_pattern, with so many of each size at most."""
    best, taken = np.zeros(capacity + 1), []
    for i in np.flatnonzero(most)[::-1]:
        left, k = int(min(most[i], capacity // sizes[i])), 1
        while left:
            k = min(k, left)
            left -= k
            at = int(sizes[i]) * k
            if at > capacity:
                break
            other = best[: capacity + 1 - at] + worth[i] * k
            better = other > best[at:] + 1e-12
            best[at:][better] = other[better]
            taken.append((i, k, at, better))
            k *= 2
    counts, c = np.zeros(len(sizes)), capacity
    for i, k, at, better in reversed(taken):
        if c >= at and better[c - at]:
            counts[i] += k
            c -= at
    return counts


def first_patterns(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """A basis to start from: full patterns of what is left, each used until a size runs out, which is that pattern's own."""
    m, left = len(sizes), demand.copy()
    columns, bins = np.eye(m), np.zeros(m)
    worth = sizes / capacity * (1 + 0.002 * sizes / capacity)
    while (left > 1e-9).any():
        counts = bounded_pattern(sizes, worth, np.ceil(left - 1e-9).clip(0), capacity)
        used = np.flatnonzero(counts)
        times = left[used] / counts[used]
        own = used[times.argmin()]
        columns[:, own], bins[own] = counts, times.min()
        left[used] -= times.min() * counts[used]
        left[own] = 0
    return columns, bins


def inverted(square: np.ndarray) -> np.ndarray:
    """The inverse by elimination, without the threads of a linear algebra library: a driver under load may wait for those for minutes."""
    m = len(square)
    both = np.hstack([square.astype(float), np.eye(m)])
    for i in range(m):
        at = i + int(np.abs(both[i:, i]).argmax())
        both[[i, at]] = both[[at, i]]
        both[i] /= both[i, i]
        factors = both[:, i].copy()
        factors[i] = 0
        some = np.flatnonzero(factors)
        both[some] -= factors[some, None] * both[i]
    return both[:, m:]


def patterns(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, float]]:
    """(how many of each size, how many bins) for the patterns of the linear program's solution."""
    m = len(sizes)
    columns, bins = first_patterns(sizes, demand, capacity)
    inverse = inverted(columns)
    center, bound = sizes / capacity, float(sizes @ demand) / capacity
    for _ in range(MOST_STEPS):
        worth = inverse.sum(axis=0)
        if bins.sum() <= max(bound * (1 + GAP), np.ceil(bound - 1e-9)):
            break
        for near in (SMOOTHING, 0.0):
            asked = near * center + (1 - near) * worth
            value, column = best_pattern(sizes, asked, capacity)
            if value > 0 and (proven := float(asked @ demand) / max(1.0, value)) > bound:
                center, bound = asked / max(1.0, value), proven
            if worth @ column > 1 + 1e-9:
                break
        else:
            break
        step = inverse @ column
        up = np.flatnonzero(step > 1e-9)
        leave = up[np.argmin(bins[up] / step[up])]
        by = bins[leave] / step[leave]
        bins -= by * step
        bins[leave] = by
        np.maximum(bins, 0, out=bins)
        row = inverse[leave] / step[leave]
        inverse -= np.outer(step, row)
        inverse[leave] = row
        columns[:, leave] = column
    return [(columns[:, i], float(bins[i])) for i in range(m)]


def plan(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Where the pieces of each size go: (size, first rank, pieces, pieces a bin, first bin), and the number of bins.

    Patterns are rounded down; what they leave, less than a bin for each pattern, goes best-fit into further
    bins, largest first.
    """
    sizes = np.array(sorted(s for s, n in histogram.items() if n), np.int64)
    if not len(sizes):
        return [], 0
    left = np.array([histogram[s] for s in sizes.tolist()], np.int64)
    rank, out, n_bins = np.zeros(len(sizes), np.int64), [], 0
    for counts, bins in patterns(sizes, left.astype(float), capacity):
        whole = int(bins + 1e-7)
        if not whole:
            continue
        used = False
        for i in np.flatnonzero(counts):
            a = int(counts[i])
            pieces = min(a * whole, int(left[i]))
            if pieces:
                out.append((int(sizes[i]), int(rank[i]), pieces, a, n_bins))
                rank[i] += pieces
                left[i] -= pieces
                used = True
        n_bins += whole * used
    room: list[int] = []
    for i in range(len(sizes) - 1, -1, -1):
        for _ in range(int(left[i])):
            fits = [(r, b) for b, r in enumerate(room) if r >= sizes[i]]
            if fits:
                b = min(fits)[1]
            else:
                b = len(room)
                room.append(capacity)
            room[b] -= int(sizes[i])
            out.append((int(sizes[i]), int(rank[i]), 1, 1, n_bins + b))
            rank[i] += 1
    return out, n_bins + len(room)
