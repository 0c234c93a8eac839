"""Suffix arrays of short segments in numpy: Larsson-Sadakane refinement and Kasai common prefixes."""

from __future__ import annotations

import numpy as np

# Bytes that the first sort sees; each takes 9 bits, 0 for "behind the segment".
_FIRST = 7


def suffix_array(text: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, rank) of all suffixes of the segments of ``text`` (uint8) that begin at ``starts``.

    A suffix ends with its segment; suffixes that are equal to their end are
    ordered by segment.  After the sort by the first bytes only groups of equal
    prefixes are sorted again, by the rank of the suffix behind the prefix,
    whose length doubles.
    """
    n = len(text)
    lengths = np.diff(np.append(starts, n))
    segment = np.repeat(np.arange(len(starts)), lengths)
    end = np.repeat(starts + lengths, lengths)
    key, place = np.zeros(n, np.int64), np.arange(n)
    coded = np.append(text.astype(np.int64) + 1, np.zeros(_FIRST, np.int64))
    for b in range(_FIRST):
        key = key << 9 | np.where(place + b < end, coded[b:n + b], 0)
    order = np.argsort(key, kind="stable")
    s = key[order]
    new = np.concatenate([[True], s[1:] != s[:-1]]) if n else np.empty(0, bool)
    head = np.maximum.accumulate(np.where(new, place, 0))
    rank = np.empty(n, np.int64)
    rank[order] = head
    width = _FIRST
    todo = np.flatnonzero(~(new & np.append(new[1:], True)))
    while len(todo):
        suffix = order[todo]
        behind = suffix + width
        second = np.where(behind < end[suffix], rank[np.minimum(behind, n - 1)], -1 - (len(starts) - segment[suffix]))
        by = np.lexsort((second, head[todo]))
        suffix, second, group = suffix[by], second[by], head[todo]
        order[todo] = suffix
        new = np.concatenate([[True], (group[1:] != group[:-1]) | (second[1:] != second[:-1])])
        head[todo] = np.maximum.accumulate(np.where(new, todo, 0))
        rank[suffix] = head[todo]
        todo = todo[~(new & np.append(new[1:], True))]
        width *= 2
    return order, rank


def common_prefixes(text: np.ndarray, starts: np.ndarray, order: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each suffix in ``order`` with the one before it.

    Kasai's scan goes through a segment from its start and keeps all but one
    byte of the prefix found before; here all segments are scanned side by side.
    """
    n = len(text)
    lengths = np.diff(np.append(starts, n))
    end = np.repeat(starts + lengths, lengths)
    common = np.zeros(n, np.int64)
    kept = np.zeros(len(starts), np.int64)
    for t in range(int(lengths.max(initial=0))):
        lanes = np.flatnonzero(lengths > t)
        i = starts[lanes] + t
        r = rank[i]
        j = order[np.maximum(r - 1, 0)]
        h = np.where(r > 0, np.maximum(kept[lanes] - 1, 0), 0)
        going = np.flatnonzero(r > 0)
        most = np.minimum(end[i] - i, end[j] - j)
        while len(going):
            going = going[h[going] < most[going]]
            going = going[text[i[going] + h[going]] == text[j[going] + h[going]]]
            h[going] += 1
        common[r] = h
        kept[lanes] = h
    return common
