"""BagMinHash signatures: weighted-Jaccard sketches from hierarchical Poisson processes over discretised weights.

After O. Ertl, "BagMinHash - Minwise Hashing Algorithm for Weighted Sets" (KDD 2018). A run that a bag holds c
times weighs c: the weight axis is cut into leaves of one occurrence each. To each run belongs a Poisson process over
(time, weight axis); each of its points also draws a register, which keeps the earliest time of all points below the
runs' weights. Two bags agree in a register with probability equal to their weighted Jaccard similarity.

The axis is laid out in segments [0, 1), [1, 2), [2, 4), [4, 8) and so on, without an end, with a process each. The
first point of a segment is drawn at once; then the segment is halved, one child inherits the point, its sibling goes
on from that time by itself (the process has no memory), down to the leaves, which go on by themselves. Halving never
depends on a bag's weight, so that all bags see the same points, whatever they count: a weight only decides which
points are below it and which children can be left out. Points later than the latest register are never followed.

Points of the first segment alone are the process of the bag's distinct runs, each counted once (its support). A
signature of the support falls out on the way. All elements of a batch of bags are treated together.
"""

from __future__ import annotations

import numpy as np

from tailrace.llm.words import mix

_INV = 1.0 / (1 << 53)
_C1 = np.uint64(0x9E3779B97F4A7C15)
_C2 = np.uint64(0xD6E8FEB86659FD93)
#: Keeps times, registers and halvings of a point apart.
_TIME, _PLACE, _SIDE = np.uint64(0), np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)


def _draw(key: np.ndarray, node: np.ndarray, i: np.ndarray, what: np.uint64) -> np.ndarray:
    return mix(key + node.view(np.uint64) * _C1 + i.view(np.uint64) * _C2 + what)


def _wait(key: np.ndarray, node: np.ndarray, i: np.ndarray, size: np.ndarray) -> np.ndarray:
    h = _draw(key, node, i, _TIME)
    return -np.log1p(-((h >> np.uint64(11)).astype(np.float64) * _INV)) / size


def _register(key: np.ndarray, node: np.ndarray, i: np.ndarray, m: int) -> np.ndarray:
    h = _draw(key, node, i, _PLACE)
    return (((h >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)).astype(np.int64)


def _segments(bag: np.ndarray, key: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """(bag, key, weight, node, lo, size) of every segment that reaches below its run's weight. A node's number is its doubled middle, which no other node has."""
    parts = []
    lo, size = 0, 1
    while len(key):
        n = len(key)
        parts.append((bag, key, counts, np.full(n, 2 * lo + size, dtype=np.int64), np.full(n, lo, dtype=np.int64), np.full(n, size, dtype=np.int64)))
        lo, size = lo + size, max(1, lo + size)
        more = counts > lo
        bag, key, counts = bag[more], key[more], counts[more]
    return tuple(np.concatenate(x) for x in zip(*parts))


def signatures(bag: np.ndarray, key: np.ndarray, counts: np.ndarray, n_bags: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Two arrays of ``n_bags`` x ``m`` times: of the bags, and of their supports. Rows of empty bags stay infinite. ``bag``: index of each run's bag."""
    regs, floor = np.full(n_bags * m, np.inf), np.full(n_bags * m, np.inf)
    if not len(key):
        return regs.reshape(n_bags, m), floor.reshape(n_bags, m)
    bag, key, weight, node, lo, size = _segments(bag, key, counts.astype(np.int64))
    i = np.zeros(len(key), dtype=np.int64)
    t = _wait(key, node, i, size)
    reg = _register(key, node, i, m)
    while len(key):
        whole = lo + size <= weight
        slot = bag * m + reg
        np.minimum.at(regs, slot[whole], t[whole])
        first = lo == 0
        np.minimum.at(floor, slot[first], t[first])
        limit, floor_limit = regs.reshape(n_bags, m).max(axis=1), floor.reshape(n_bags, m).max(axis=1)
        leaf = size == 1
        # leaves go on to their next point
        k, n, j = key[leaf], node[leaf], i[leaf] + 1
        a = (bag[leaf], k, weight[leaf], n, lo[leaf], size[leaf], j, t[leaf] + _wait(k, n, j, size[leaf]), _register(k, n, j, m))
        # all others are halved: one child has the point, its sibling starts from the same time
        s = ~leaf
        k, half = key[s], size[s] >> 1
        right = (_draw(k, node[s], i[s], _SIDE) & np.uint64(1)).astype(np.int64)
        lo_has, lo_other = lo[s] + right * half, lo[s] + (1 - right) * half
        has, other = 2 * lo_has + half, 2 * lo_other + half
        zero = np.zeros(len(k), dtype=np.int64)
        b = (bag[s], k, weight[s], has, lo_has, half, zero, t[s], reg[s])
        c = (bag[s], k, weight[s], other, lo_other, half, zero, t[s] + _wait(k, other, zero, half), _register(k, other, zero, m))
        bag, key, weight, node, lo, size, i, t, reg = (np.concatenate(x) for x in zip(a, b, c))
        keep = (lo < weight) & (t <= np.where(lo == 0, floor_limit[bag], limit[bag]))
        bag, key, weight, node, lo, size, i, t, reg = (x[keep] for x in (bag, key, weight, node, lo, size, i, t, reg))
    return regs.reshape(n_bags, m), floor.reshape(n_bags, m)


def bands(regs: np.ndarray, rows: int) -> np.ndarray:
    """A signed 64-bit hash for each run of ``rows`` registers."""
    bits = regs.view(np.uint64).reshape(regs.shape[0], -1, rows)
    out = np.zeros(bits.shape[:2], dtype=np.uint64)
    for r in range(rows):
        out = mix(out * _C1 + bits[:, :, r])
    return mix(out + np.arange(bits.shape[1], dtype=np.uint64)).view(np.int64)


def bag_bands(shingles: list[np.ndarray], m: int, rows: int) -> list[list[int] | None]:
    """The band hashes of each bag of shingle hashes, of its counted runs and, where they differ, of its distinct ones; None for an empty bag."""
    kept = [(j, *np.unique(s, return_counts=True)) for j, s in enumerate(shingles) if len(s)]
    out: list[list[int] | None] = [None] * len(shingles)
    if not kept:
        return out
    bag = np.repeat(np.arange(len(kept)), [len(u) for _, u, _ in kept])
    regs, floor = signatures(bag, np.concatenate([u for _, u, _ in kept]), np.concatenate([c for _, _, c in kept]), len(kept), m)
    counted, distinct = bands(regs, rows), bands(floor, rows)
    for j, (at, _, _) in enumerate(kept):
        out[at] = np.union1d(counted[j], distinct[j]).tolist()
    return out
