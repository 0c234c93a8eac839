"""Lyndon arrays by the first phase of Baier's suffix sorter, and the runs that their roots extend to."""

from __future__ import annotations

import numpy as np


def lyndon_groups(symbols: list[int]) -> tuple[list[int], list[int]]:
    """(length, group) per position: the longest Lyndon word that starts there, and a number that positions share
    exactly if that word is the same.

    Suffixes begin in groups by first symbol, each with the context of one symbol.  From the greatest group down,
    every member points to the nearest position before it in a lower group; positions that k members of a group
    point to leave their own group for a new one right above it, whose context is theirs and k times the group's.
    A group is final once its turn comes.  The end counts as less than every symbol.
    """
    n = len(symbols)
    order = sorted(range(n), key=symbols.__getitem__)
    place, group = [0] * n, [0] * n
    size, context = {}, {}
    start, last = 0, None
    for at, i in enumerate(order):
        if symbols[i] != last:
            start, last = at, symbols[i]
            size[start], context[start] = 0, 1
        size[start] += 1
        group[i], place[i] = start, at
    before = list(range(-1, n - 1))
    end = n
    while end:
        g = group[order[end - 1]]
        pointed: dict[int, int] = {}
        for i in sorted(order[g:end]):
            j = before[i]
            while j >= 0 and group[j] >= g:
                j = before[j]
            before[i] = j
            if j >= 0:
                pointed[j] = pointed.get(j, 0) + 1
        moves: dict[tuple[int, int], list[int]] = {}
        for j, times in pointed.items():
            moves.setdefault((times, group[j]), []).append(j)
        for times, old in sorted(moves, key=lambda m: -m[0]):
            members = moves[times, old]
            longer = context[old] + times * context[g]
            new = old + size[old] - len(members)
            if new == old:
                context[old] = longer
                continue
            for at, j in enumerate(members, new):
                k, here = order[at], place[j]
                order[at], order[here] = j, k
                place[j], place[k] = at, here
                group[j] = new
            size[old] -= len(members)
            size[new], context[new] = len(members), longer
        end = g
    return [context[g] for g in group], group


def _agreement(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the common prefix, looked for in doubling steps."""
    n, at, step = min(len(a), len(b)), 0, 16
    while at < n:
        differ = np.flatnonzero(a[at:min(at + step, n)] != b[at:min(at + step, n)])
        if len(differ):
            return at + int(differ[0])
        at, step = at + step, step * 2
    return n


def _extended(w: np.ndarray, symbols: list[int], least: int, powers: int) -> set[tuple[int, int, int]]:
    """Runs (start, length, period) of at least ``least`` symbols and ``powers`` (2 or more) periods whose roots are
    the Lyndon words of one order."""
    n = len(w)
    lengths, groups = (np.array(x, np.int64) for x in lyndon_groups(symbols))
    here = np.arange(n)
    after = here + lengths
    repeats = np.flatnonzero(after < n)
    repeats = repeats[groups[after[repeats]] == groups[repeats]]          # the same root follows at once
    follows = np.zeros(n, bool)
    follows[repeats] = True
    continued = np.zeros(n, bool)
    continued[after[repeats]] = True
    found = set()
    for head in np.flatnonzero(follows & ~continued).tolist():
        p, tail = int(lengths[head]), head
        while follows[tail]:
            tail += p
        whole = tail + p - head
        if whole + 2 * (p - 1) < max(least, powers * p):
            continue
        right = _agreement(w[tail + p:tail + 2 * p], w[tail:tail + p])
        left = _agreement(w[max(0, head - p):head][::-1], w[max(0, head):head + p][::-1])
        length = left + whole + right
        if length >= max(least, powers * p):
            found.add((head - left, length, p))
    return found


def runs(w: np.ndarray, least: int = 24, powers: int = 3) -> list[tuple[int, int, int]]:
    """Maximal runs (start, length, smallest period) of at least ``least`` symbols and ``powers`` (3 or more) periods,
    by start and then period.

    Of each run the Lyndon roots of at least one of both orders are the longest Lyndon words at their starts, and a
    run of three periods holds two roots in a row.  Both Lyndon arrays come from the grouping itself.
    """
    found: set[tuple[int, int, int]] = set()
    for lo, hi in stretches(w, least):
        part = w[lo:hi]
        up = np.unique(part, return_inverse=True)[1]
        for symbols in (up, up.max() - up):
            found |= {(lo + s, length, p) for s, length, p in _extended(part, symbols.tolist(), least, powers)}
    return sorted(found, key=lambda r: (r[0], r[2]))


_ODD = np.uint64(0x9E3779B97F4A7C15)


def stretches(w: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Parts [lo, hi) of ``w`` that hold every run of at least ``least`` symbols and three periods, whole.

    Every run of k symbols inside such a run, for 3 * k <= least, occurs at least twice: a period of k or more leaves
    2 * period starts, a shorter one at least ``least`` - k + 1.  Starts whose k symbols (by a hash, so rarely too
    many) occur once cut the sequence.
    """
    n, k = len(w), max(1, least // 3)
    if n < least:
        return []
    h = np.zeros(n - k + 1, np.uint64)
    codes = w.astype(np.uint64) + np.uint64(1)
    for at in range(k):
        h = h * _ODD + (codes[at:n - k + 1 + at] ^ (codes[at:n - k + 1 + at] << np.uint64(29)))
        h ^= h >> np.uint64(32)
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    again = np.zeros(n - k + 3, bool)
    again[order[1:][same] + 1] = True
    again[order[:-1][same] + 1] = True
    edge = np.flatnonzero(again[1:] != again[:-1])
    return [(int(lo), int(hi) + k - 1) for lo, hi in zip(edge[0::2], edge[1::2]) if hi - lo + k - 1 >= least]
