"""BagMinHash: signatures whose equal share is, in expectation, the weighted Jaccard similarity of multisets.

Each element of weight w owns a Poisson process of rate 1 over time and over the weights [0, w); every point
of it falls on one of the m components, and a component keeps its earliest point. Two multisets share the
points below the smaller weight of each element, so a component agrees with exactly the probability
sum(min) / sum(max). Weights are whole numbers, so the discretisation is exact.

The process is hierarchical. [0, 1), [1, 2), [2, 4), [4, 8), ... are separate processes. A process over more
than one unit yields its first point and is then split in halves: the point belongs to either half by a coin, the
other half goes on from there. So the points of a unit are the same whatever the weight above it, and an
element costs as much as it has points, not as much as it weighs. All randomness is a hash of element and place in
the tree, so equal elements give equal points. A process is left as soon as its next point is later than the
latest component of its document, which takes one or two points for most elements of a text of some hundred words.
"""

from __future__ import annotations

import numpy as np

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31, _S24 = (np.uint64(k) for k in (30, 27, 31, 24))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the splitmix64 finaliser)."""
    x = x + _GOLDEN
    x = (x ^ (x >> _S30)) * _M1
    x = (x ^ (x >> _S27)) * _M2
    return x ^ (x >> _S31)


def processes(doc: np.ndarray, element: np.ndarray, weight: np.ndarray):
    """The dyadic processes of each element: (doc, seed, low, high, weight)."""
    levels = np.frexp(np.maximum(weight - 1, 0).astype(float))[1].astype(np.int64) + 1  # 1: weight 1, 2: 2, 3: 3 or 4, ...
    if levels.max(initial=1) == 1:
        at, j = np.arange(len(doc)), np.zeros(len(doc), np.int64)
    else:
        at = np.repeat(np.arange(len(doc)), levels)
        j = np.arange(len(at)) - np.repeat(np.cumsum(levels) - levels, levels)
    high = np.left_shift(np.int64(1), j)
    low = np.where(j == 0, 0, high >> 1)
    return doc[at], mix(element[at] ^ mix(j.astype(np.uint64))), low, high, weight[at]


def signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n_docs: int, m: int) -> np.ndarray:
    """``n_docs`` x ``m`` unsigned 64-bit components. ``doc``, ``element`` (64-bit hashes) and whole ``weight``
    list the elements of all documents, each once; documents without elements get zeros."""
    best, name = np.full((n_docs, m), np.inf), np.zeros((n_docs, m), np.uint64)
    limit = np.full(n_docs, np.inf)
    doc, seed, low, high, weight = processes(doc, element.astype(np.uint64, copy=False), weight)
    # state: 0 waits for its next point; 1 has one, from a split; 2 has one that its parent has used already
    time, draw, random, state = np.zeros(len(doc)), np.zeros(len(doc), np.uint64), np.zeros(len(doc), np.uint64), np.zeros(len(doc), np.int8)
    while len(doc):
        waits = state == 0
        draw += waits.astype(np.uint64)
        random = np.where(waits, mix(seed + draw * _GOLDEN), random)
        uniform = ((random >> _S24).astype(float) + 1.0) * 2.0**-40
        time = np.where(waits, time - np.log(uniform) / (high - low), time)
        keep = time < limit[doc]
        doc, seed, low, high, weight, time, draw, random, state = (a[keep] for a in (doc, seed, low, high, weight, time, draw, random, state))
        point = (high <= weight) & (state != 2)
        spot = doc[point] * m + (mix(random[point]) % np.uint64(m)).astype(np.int64)
        t, r = time[point], random[point]
        first = t < best.ravel()[spot]
        spot, t, r = spot[first], t[first], r[first]
        order = np.argsort(-t, kind="stable")  # of several points on one spot the earliest is stored last
        best.ravel()[spot[order]] = t[order]
        name.ravel()[spot[order]] = mix(r[order])
        touched = np.unique(spot // m)
        limit[touched] = best[touched].max(axis=1)
        wide = high - low > 1
        if not wide.any():
            state = np.zeros(len(doc), np.int8)
            continue
        c, rest = np.flatnonzero(wide), ~wide
        middle = (low[c] + high[c]) >> 1
        to_right = (mix(random[c] ^ seed[c]) & np.uint64(1)).astype(bool)
        passed = np.where((high[c] <= weight[c]) | (state[c] == 2), 2, 1)
        right = middle < weight[c]  # else the upper half lies above the weight
        halves = (
            (c, low[c], middle, mix(seed[c] ^ np.uint64(1)), np.where(to_right, 0, passed)),
            (c[right], middle[right], high[c][right], mix(seed[c][right] ^ np.uint64(2)), np.where(to_right, passed, 0)[right]),
        )
        parts = [(doc[rest], seed[rest], low[rest], high[rest], weight[rest], time[rest], draw[rest], random[rest], np.zeros(rest.sum(), np.int8))]
        for k, lo, hi, s, now in halves:
            parts.append((doc[k], s, lo, hi, weight[k], time[k], np.zeros(len(k), np.uint64), random[k], now.astype(np.int8)))
        doc, seed, low, high, weight, time, draw, random, state = (np.concatenate(a) for a in zip(*parts))
    return name


def band_keys(signature: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit key for each band of the components, distinct between bands."""
    rows = signature.reshape(len(signature), bands, -1)
    key = mix(np.broadcast_to(np.arange(bands, dtype=np.uint64), rows.shape[:2]))
    for k in range(rows.shape[2]):
        key = mix(key ^ rows[:, :, k])
    return key.view(np.int64)
