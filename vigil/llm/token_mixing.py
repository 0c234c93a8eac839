"""Logistic context mixing over the bits of word codes, in numpy.

Every token of a text has a canonical Huffman code: a frequent word, the escape
that stands for any other word, the end.  Each bit of it is a node of the code
tree.  Three contexts predict it from counts of the training text: the node
alone (exact), the node after the word before, and after the two words before
(hashed tables of fixed size).  Their predictions are mixed in the logistic
domain by weights that the depth of the node selects.  Many tokens go side by
side, one bit at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SLOT_BITS = 18
SLOTS = 1 << SLOT_BITS
#: Slots of one row of counts on their way to the sums.
BLOCK = 1 << 11
ORDERS = 2
DEPTHS = 24
#: Tokens that go side by side.
STEP_TOKENS = 1 << 15
START = 0.4
#: Bits' worth of trust in the weights at the start.
PRIOR = 20.0
_NONE = np.float32(0.4)
_NODE = np.uint32(0x9E3779B1)
_SPREAD = np.uint32(0x85EBCA6B)


def code_lengths(counts: np.ndarray) -> np.ndarray:
    """Huffman code lengths of at least two counts in falling order; rare ones are raised so that none is above 32."""
    least = counts.sum() / (1 << 20)
    leaves = np.maximum(counts[::-1], least).tolist()
    n, inner, parent = len(leaves), [], [0] * (2 * len(leaves) - 1)
    a = b = 0
    for new in range(n, 2 * n - 1):
        total = 0.0
        for _ in range(2):
            if a < n and (b >= len(inner) or leaves[a] <= inner[b]):
                total, parent[a], a = total + leaves[a], new, a + 1
            else:
                total, parent[n + b], b = total + inner[b], new, b + 1
        inner.append(total)
    depth = [0] * (2 * n - 1)
    for k in range(2 * n - 3, -1, -1):
        depth[k] = depth[parent[k]] + 1
    return np.array(depth[:n][::-1], np.uint8)


class Codes:
    """Codes of words (hashes in ``wh``), the escape and the end, from their counts in training."""

    def __init__(self, wh: np.ndarray, counts: np.ndarray, escapes: int, ends: int):
        n = len(wh)
        counts = np.concatenate([counts, [max(escapes, 1), max(ends, 1)]]).astype(np.float64)
        by_count = np.lexsort((np.concatenate([wh, np.zeros(2, np.uint64)]), -counts))
        lengths = code_lengths(counts[by_count])
        by_count, lengths = by_count[np.argsort(lengths, kind="stable")], np.sort(lengths)
        per = np.bincount(lengths, minlength=34)
        first, inner, shift = 0, 1, []
        codes, nodes = np.zeros(n + 2, np.uint32), 0
        for depth in range(33):
            mine = by_count[lengths == depth]
            codes[mine] = (first + np.arange(len(mine))) << (32 - depth)
            inner = inner * 2 - int(per[depth]) if depth else 1
            shift.append(nodes - (first + len(mine)))    # from the bits so far to the node
            nodes += inner
            first = (first + len(mine)) * 2
        self.wh, self.shift, self.nodes, self.code = wh, shift, nodes, codes
        self.length = np.zeros(n + 2, np.uint8)
        self.length[by_count] = lengths
        self.order0 = np.zeros(2 * nodes)
        known = by_count[::-1]
        for depth, k, places in bit_steps(self, codes[known], lengths[::-1], []):
            self.order0 += np.bincount(places[0], counts[known[:k]], minlength=2 * nodes)


def contexts(words: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The word before and the two words before as hashes; ``starts`` are the places of the texts' first tokens."""
    w = (words >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    one = np.concatenate([np.zeros(1, np.uint32), w[:-1]])
    one[starts] = 0
    two = np.concatenate([np.zeros(1, np.uint32), one[:-1]])
    two[starts] = 0
    return one * _SPREAD, (two * np.uint32(0xC2B2AE35) ^ one) * np.uint32(0x27D4EB2F) + _SPREAD


def bit_steps(codes: Codes, code: np.ndarray, lengths: np.ndarray, before: list[np.ndarray]) -> Iterator[tuple]:
    """(depth, how many tokens, places in the tables of every order) for tokens whose lengths fall; a place is that of
    the node, or of the slot of node and context, among those of the coded bit."""
    for depth, k in enumerate(np.searchsorted(-lengths.astype(np.int16), -np.arange(1, int(lengths[0]) + 1), side="right").tolist()):
        upto = code[:k] >> np.uint32(31 - depth)
        bit = upto & np.uint32(1)
        upto >>= np.uint32(1)
        upto += np.uint32(codes.shift[depth] % (1 << 32))
        hashed, places = upto * _NODE, [upto + bit * np.uint32(codes.nodes)]
        bit <<= np.uint32(SLOT_BITS)
        for b in before:
            s = b[:k] + hashed
            s >>= np.uint32(32 - SLOT_BITS)
            s += bit
            places.append(s)
        yield depth, k, places


def _sorted(codes: Codes, leaf: np.ndarray, before: tuple[np.ndarray, ...]) -> Iterator[tuple]:
    """(which tokens, codes from the top bit, lengths, contexts) of STEP_TOKENS tokens at a time, long codes first."""
    for at in range(0, len(leaf), STEP_TOKENS):
        some = leaf[at:at + STEP_TOKENS]
        lengths = codes.length[some]
        by_length = np.argsort(np.uint8(255) - lengths, kind="stable")
        yield at + by_length, codes.code[some[by_length]], lengths[by_length], [b[at + by_length] for b in before]


def count_bits(codes: Codes, leaf: np.ndarray, before: tuple[np.ndarray, ...], total: np.ndarray) -> None:
    """Add to ``total``, (orders, 2 * SLOTS), how often each bit came in each context."""
    for at in range(0, len(leaf), 4 * STEP_TOKENS):
        some = slice(at, at + 4 * STEP_TOKENS)
        seen = [places for _, code, lengths, b in _sorted(codes, leaf[some], [b[some] for b in before]) for _, _, places in bit_steps(codes, code, lengths, b)]
        for o in range(ORDERS):
            total[o] += np.bincount(np.concatenate([p[o + 1] for p in seen]), minlength=2 * SLOTS)


class TokenMixer:
    """Counts per context and weights (DEPTHS, orders + 1) per gate."""

    def __init__(self, codes: Codes, counts: np.ndarray, weights: np.ndarray | None = None):
        self.codes, self.counts = codes, counts
        self.weights = np.full((DEPTHS, ORDERS + 1), START) if weights is None else weights
        self._tables: dict[bool, list[np.ndarray]] = {}

    def tables(self, own: bool) -> list[np.ndarray]:
        """Per order the prediction of every place, stretched towards its bit; ``own``: after words, one occurrence of
        the bit is the token's own and does not count."""
        if own not in self._tables:
            self._tables[own] = []
            for o, n in enumerate((self.codes.order0, *self.counts)):
                same, other = n.astype(np.float32), np.concatenate([n[len(n) // 2:], n[:len(n) // 2]]).astype(np.float32)
                self._tables[own].append(np.log((np.maximum(same - np.float32(own and o > 0), 0) + _NONE) / (other + _NONE)))
        return self._tables[own]

    def log10(self, leaf: np.ndarray, before: tuple[np.ndarray, ...], own: bool) -> np.ndarray:
        """log10 of the probability of each token's code; ``own``: the tokens are in the counts."""
        out = np.empty(len(leaf))
        tables, weights = self.tables(own), self.weights.astype(np.float32)
        for mine, code, lengths, sorted_before in _sorted(self.codes, leaf, before):
            inverse = np.ones(len(mine))     # at most (1 + e^14)^32
            for depth, k, places in bit_steps(self.codes, code, lengths, sorted_before):
                mixed = np.zeros(k, np.float32)
                for table, w, place in zip(tables, weights[min(depth, DEPTHS - 1)], places):
                    x = table.take(place)
                    x *= w
                    mixed -= x
                np.minimum(mixed, np.float32(14), out=mixed)
                np.exp(mixed, out=mixed)
                mixed += np.float32(1)
                inverse[:k] *= mixed
            out[mine] = -np.log10(inverse)
        return out

    def slopes(self, leaf: np.ndarray, before: tuple[np.ndarray, ...], total: np.ndarray) -> None:
        """Add to ``total``, (DEPTHS, inputs + inputs^2), gradient and curvature of the log probability of tokens in the counts."""
        n, tables, weights = ORDERS + 1, self.tables(True), self.weights.astype(np.float32)
        inputs = np.empty((n, min(len(leaf), STEP_TOKENS)), np.float32)
        for _, code, lengths, sorted_before in _sorted(self.codes, leaf, before):
            for depth, k, places in bit_steps(self.codes, code, lengths, sorted_before):
                gate, x = min(depth, DEPTHS - 1), inputs[:, :k]
                for row, table, place in zip(x, tables, places):
                    table.take(place, out=row, mode="clip")      # with another mode the output is buffered
                miss = weights[gate] @ x
                np.clip(miss, -14, 14, out=miss)
                np.exp(miss, out=miss)
                miss += np.float32(1)
                np.reciprocal(miss, out=miss)
                total[gate, :n] += x @ miss
                miss -= miss * miss
                for i in range(n):          # products of three rows are slow in BLAS
                    row = x[i] * miss
                    for j in range(i, n):
                        both = row @ x[j]
                        total[gate, n + n * i + j] += both
                        total[gate, n + n * j + i] += both * (i < j)

    def moved(self, total: np.ndarray) -> "TokenMixer":
        """The mixer after one Newton step per gate, with the weights at the start as PRIOR, none below 0; rounded,
        so that the order in which ``total`` was summed does not matter."""
        n = ORDERS + 1
        slope, curve = total[:, :n] - PRIOR * (self.weights - START), total[:, n:].reshape(-1, n, n) + PRIOR * np.eye(n)
        step = np.clip(np.linalg.solve(curve, slope[:, :, None])[:, :, 0], -1, 1)
        return TokenMixer(self.codes, self.counts, np.round(np.maximum(self.weights + step, 0), 4))
