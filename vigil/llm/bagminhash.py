"""BagMinHash: signatures of weighted sets whose agreement is an unbiased estimate of weighted Jaccard similarity.

An element of weight w owns the weight levels [0, w).  Over each dyadic range of
levels runs a Poisson process whose rate is the range's length times the number
of signature entries; a point has a time, an entry and a level, all functions
of (element, range, number of the point) alone.  An entry keeps the earliest
point that an owned level receives.  Two bags agree in an entry exactly when
that point lies in a level that both own.  Points come in order of time, so
only those before the time by which all entries are filled need to be made.
Bags are handled many at a time: entry e of bag b is place b * entries + e.
"""

from __future__ import annotations

import numpy as np

from vigil.llm.common import mix64

_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _unit(x: np.ndarray) -> np.ndarray:
    """In (0, 1), from the upper 52 bits."""
    return ((x >> np.uint64(12)).astype(np.float64) + 0.5) / 2.0 ** 52


def _points(seed, weight, bag, until, low: int, high: int, entries: int, best: np.ndarray, owner: np.ndarray) -> None:
    """All points before ``until`` (per element) of the processes over levels [low, high); keeps the earliest per place."""
    rate = entries * (high - low)
    state = mix64(seed ^ np.uint64((low + 1) * int(_GOLD) % 2 ** 64))
    time = np.zeros(len(seed))
    while len(state):
        state = mix64(state + _GOLD)
        time = time - np.log(_unit(state)) / rate
        alive = np.flatnonzero(time < until)
        state, time, weight, bag, until = state[alive], time[alive], weight[alive], bag[alive], until[alive]
        mark = mix64(state ^ np.uint64(0xA24BAED4963EE407))
        t, place = time, bag * entries + (mark % np.uint64(entries)).astype(np.int64)
        if high - low > 1:
            owned = np.flatnonzero(low + _unit(mix64(mark)) * (high - low) < weight)
            t, place, mark = t[owned], place[owned], mark[owned]
        np.minimum.at(best, place, t)
        won = best[place] == t
        owner[place[won]] = mark[won]


def signatures(elements: np.ndarray, weights: np.ndarray, sizes: np.ndarray, entries: int) -> np.ndarray:
    """(bags, entries) 16-bit values.  ``elements``: the distinct 64-bit elements of all bags, one bag after
    the other, ``weights`` their whole weights >= 1, ``sizes`` the number of elements per bag.  An empty bag has all 0."""
    bags = len(sizes)
    seed, bag = mix64(elements), np.repeat(np.arange(bags), sizes)
    total = np.bincount(bag, weights=weights, minlength=bags)
    limit = (np.log(entries) + 3.0) / np.maximum(total, 1)
    out = np.zeros((bags, entries), np.uint16)
    todo = np.flatnonzero(sizes > 0)
    while len(todo):
        best, owner = np.full(bags * entries, np.inf), np.zeros(bags * entries, np.uint64)
        mine = np.flatnonzero(np.isin(bag, todo)) if len(todo) < bags else np.arange(len(seed))
        low, high = 0, 1
        while len(mine):
            _points(seed[mine], weights[mine], bag[mine], limit[bag[mine]], low, high, entries, best, owner)
            low, high = high, high * 2
            mine = mine[weights[mine] > low]
        full = np.isfinite(best).reshape(bags, entries).all(axis=1)
        done = todo[full[todo]]
        out[done] = (owner.reshape(bags, entries)[done] >> np.uint64(48)).astype(np.uint16)
        todo = todo[~full[todo]]
        limit[todo] *= 2     # some entry has no point yet
    return out
