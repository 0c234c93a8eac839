"""Logistic context mixing over the bits of words, in numpy.

A word is its bytes and a closing blank, each coded from the high bit down.
Every order has a table of bit counts, indexed by a hash of the preceding bytes
of the word and the bits of the byte so far.  The orders' predictions are mixed
in the logistic domain by weights that a gate selects (the place of the byte
and of the bit), learned online; a last table refines the mixed prediction by
what followed such predictions before.  Many words go side by side, one bit at
a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

ORDERS = (1, 2, 3, 5)
SLOTS = 1 << 16
PLACES = 8
GATES = PLACES * 8
#: Buckets of the mixed prediction, per partial byte, in the refining table.
BUCKETS = 24
RATE = 0.25
#: Words that a step needs for half its rate.
STEADY = 500
CLOSE = 0x20


def _stretch(p: np.ndarray) -> np.ndarray:
    return np.log(p / (1.0 - p))


def _squash(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -16, 16)))


def bit_steps(words: list[bytes]) -> Iterator[tuple[np.ndarray, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(which words, gate, slots per order, bit, partial byte) for every bit of every word, place by place."""
    lengths = np.array([len(w) + 1 for w in words])
    width = int(lengths.max(initial=0))
    flat = np.frombuffer(b"".join(w + b" " for w in words), np.uint8)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    for place in range(width):
        mine = np.flatnonzero(lengths > place)
        byte = flat[starts[mine] + place].astype(np.uint32)
        seed, base = np.full(len(mine), 0x9E3779B1, np.uint32), []
        for back in range(1, max(ORDERS) + 1):
            if back <= place:
                seed = (seed + flat[starts[mine] + place - back] + np.uint32(1)) * np.uint32(0x85EBCA6B)
                seed ^= seed >> np.uint32(15)
            else:   # before the word
                seed = (seed + np.uint32(300)) * np.uint32(0x85EBCA6B) if back == place + 1 else seed
            if back in ORDERS:
                base.append(seed * np.uint32(0xC2B2AE35))
        partial, base = np.ones(len(mine), np.uint32), np.stack(base)
        for k in range(8):
            bit = byte >> np.uint32(7 - k) & np.uint32(1)
            slots = base + partial * np.uint32(0x27D4EB2F)
            slots ^= slots >> np.uint32(13)
            slots *= np.uint32(0x9E3779B1)
            slots >>= np.uint32(16)
            yield mine, min(place, PLACES - 1) * 8 + k, slots, bit, partial
            partial = partial << np.uint32(1) | bit


def count_bits(words: list[bytes]) -> np.ndarray:
    """(orders, 2, SLOTS): how often bit 0 and bit 1 came in each context."""
    flat = np.zeros(len(ORDERS) * 2 * SLOTS, np.int64)
    for _, _, slots, bit, _ in bit_steps(words):
        for o in range(len(ORDERS)):
            np.add.at(flat, (o * 2 + bit.astype(np.int64)) * SLOTS + slots[o], 1)
    return flat.reshape(len(ORDERS), 2, SLOTS)


class Mixer:
    """Weights per gate and the refining table, started even."""

    def __init__(self, counts: np.ndarray, weights: np.ndarray | None = None, refined: np.ndarray | None = None):
        self.counts = counts.astype(np.float32)
        self._flat, self._first = self.counts.reshape(-1), np.arange(len(ORDERS), dtype=np.uint32)[:, None] * np.uint32(2 * SLOTS)
        self.weights = np.full((GATES, len(ORDERS) + 1), 1.2 / len(ORDERS)) if weights is None else weights
        self.weights[:, -1] *= weights is not None        # the last input is a constant
        centre = _squash((np.arange(BUCKETS) - BUCKETS / 2 + 0.5) / 1.5)
        self.refined = np.stack([np.tile(1 - centre, (256, 1)), np.tile(centre, (256, 1))]) * 20.0 if refined is None else refined
        self.bits = np.zeros(GATES)

    def _inputs(self, slots: np.ndarray, bit: np.ndarray, own: bool) -> np.ndarray:
        """(orders + 1, bits): stretched prediction per order; ``own``: the word is in the counts and is taken out."""
        x = np.empty((len(ORDERS) + 1, len(bit)), np.float32)
        at = slots + self._first
        n0, n1 = self._flat.take(at), self._flat.take(at + np.uint32(SLOTS))
        if own:
            one = bit.astype(np.float32)
            n0 -= 1 - one
            n1 -= one
            np.maximum(n0, 0, out=n0)
            np.maximum(n1, 0, out=n1)
        n0 += np.float32(0.1)
        n1 += np.float32(0.1)
        n1 /= n0
        np.log(n1, out=x[:-1])
        x[-1] = 0.3
        return x

    @staticmethod
    def _bucket(x: np.ndarray, partial: np.ndarray) -> np.ndarray:
        bucket = np.clip((x * 1.5 + BUCKETS / 2).astype(np.int64), 0, BUCKETS - 1)
        return partial.astype(np.int64) * BUCKETS + bucket

    def learn(self, words: list[bytes]) -> None:
        """One online step per bit place over ``words``, which are in the counts."""
        for _, gate, slots, bit, partial in bit_steps(words):
            x = self._inputs(slots, bit, own=True)
            mixed = self.weights[gate].astype(np.float32) @ x
            p = _squash(mixed)
            place = self._bucket(mixed, partial)
            error = bit - p
            curve = np.maximum((x * x) @ (p * (1 - p)) / len(bit), 0.02)
            step = RATE * len(bit) / (len(bit) + STEADY)   # few words, as at late places, move little
            self.weights[gate] += step * (x @ error) / len(bit) / curve
            np.add.at(self.refined.reshape(-1), place + bit.astype(np.int64) * (256 * BUCKETS), 1.0)
            self.bits[gate] += len(bit)

    def log10(self, words: list[bytes]) -> np.ndarray:
        """log10 of each word's probability, whichever words are asked together."""
        return np.concatenate([self._log10(words[at:at + 8192]) for at in range(0, len(words), 8192)] or [np.zeros(0)])

    def _log10(self, words: list[bytes]) -> np.ndarray:
        out = np.zeros(len(words))
        refined = self.refined[1] / (self.refined[0] + self.refined[1])
        for mine, gate, slots, bit, partial in bit_steps(words):
            x = self._inputs(slots, bit, own=False)
            mixed = sum(w * row for w, row in zip(self.weights[gate].astype(np.float32), x))
            p = np.clip((_squash(mixed) + refined.reshape(-1)[self._bucket(mixed, partial)]) / 2, 1e-6, 1 - 1e-6)
            out[mine] += np.log10(np.where(bit == 1, p, 1 - p))
        return out
