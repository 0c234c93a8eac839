"""Cheapest edits of role sequences: a Re-Pair grammar and one min-plus transfer matrix per rule.

A turn is a symbol: its role's initial (s, u, a or another) and its fault.  The
states say which role came last; the edits keep, rename, delete and insert move
between them at a cost.  A symbol's matrix holds for every pair of states the
cheapest edits and, among those, the ones whose initials come first in ASCII.
Matrices multiply along a sequence, so a grammar rule X -> A B has the product
of its two matrices, whatever conversation it is in.

A matrix entry is (cost, rank, way).  Two different entries of one row never
are a prefix of each other, as both hold an edit of every turn and end in one, so
their order is settled at their first difference: an entry's ``rank`` among its
row is all that later comparisons need.  ``way`` is the text of a symbol or the
state between the two parts of a rule: a rope, written out on demand.
"""

from __future__ import annotations

#: States: nothing yet, after system, after user, after assistant; an accepted sequence ends in START or ASSISTANT.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
KEPT = {("s", START): SYSTEM, ("u", START): USER, ("u", SYSTEM): USER, ("u", ASSISTANT): USER, ("a", USER): ASSISTANT}
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: Costs of the edits; a truncated turn that is not deleted adds one.
RENAME, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Inserts after the last turn that lead to an accepted end.
LAST = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}

INITIALS = "suax"
FAULTS = ("", "blank", "duplicate", "truncated")
#: First code point of the grammar's own symbols (a private-use area of 6,400).
FIRST_RULE = 0xE000

Entry = tuple[int, int, object]
Matrix = list[list[Entry | None]]


def symbol(initial: str, fault: str) -> str:
    """One letter for a role's initial and a fault."""
    return chr(ord("A") + 4 * INITIALS.index(initial if initial in INITIALS[:3] else "x") + FAULTS.index(fault))


SYMBOLS = [symbol(i, f) for i in INITIALS for f in FAULTS]


def read_symbol(letter: str) -> tuple[str, str]:
    at = ord(letter) - ord("A")
    return INITIALS[at // 4], FAULTS[at % 4]


def _ranked(row: list[tuple[int, object, object] | None]) -> list[Entry | None]:
    """A row's (cost, order, way) with the order as a rank from 0."""
    ranks = {order: k for k, order in enumerate(sorted(e[1] for e in row if e))}
    return [e and (e[0], ranks[e[1]], e[2]) for e in row]


def symbol_matrix(letter: str) -> Matrix:
    """Inserts before a turn, and then its own edit."""
    initial, fault = read_symbol(letter)
    extra = TRUNCATED if fault == "truncated" else 0
    must_go = fault in ("blank", "duplicate")
    out = []
    for i in STATES:
        best: list = [None] * 4
        state = i
        for inserts in range(4):
            if inserts:
                state = NEXT[state]
            ways = [(DELETE, "D", state)]
            if not must_go:
                ways.append((RENAME + extra, "R", NEXT[state]))
                if (initial, state) in KEPT:
                    ways.append((extra, "K", KEPT[initial, state]))
            for cost, letter_of, j in ways:
                found = (INSERT * inserts + cost, "I" * inserts + letter_of)
                if best[j] is None or found < best[j][:2]:
                    best[j] = (*found, found[1])
        out.append(_ranked(best))
    return out


def product(a: Matrix, b: Matrix) -> Matrix:
    """The matrix of two parts one after the other."""
    out = []
    for i in STATES:
        row: list = []
        for j in STATES:
            ways = [(a[i][k][0] + b[k][j][0], a[i][k][1], k) for k in STATES if a[i][k] and b[k][j]]
            if not ways:
                row.append(None)
                continue
            cost, rank, k = min(ways)
            row.append((cost, (rank, b[k][j][1]), k))
        out.append(_ranked(row))
    return out


class Grammar:
    """Rules (left, right) numbered from FIRST_RULE, each after those it uses; every rule's matrix is computed once."""

    def __init__(self, rules: list[tuple[str, str]]):
        self.rules = {chr(FIRST_RULE + k): pair for k, pair in enumerate(rules)}
        self.matrices = {s: symbol_matrix(s) for s in SYMBOLS}
        for s, (left, right) in self.rules.items():
            self.matrices[s] = product(self.matrices[left], self.matrices[right])
        self._written: dict[tuple[str, int, int], str] = {}

    def matrix(self, packed: str) -> Matrix:
        """Of a packed sequence of at least one symbol."""
        out = self.matrices[packed[0]]
        for s in packed[1:]:
            out = product(out, self.matrices[s])
        return out

    def _rope(self, s: str, i: int, j: int) -> str:
        if s not in self.rules:
            return self.matrices[s][i][j][2]
        if (s, i, j) not in self._written:
            left, right = self.rules[s]
            k = self.matrices[s][i][j][2]
            self._written[s, i, j] = self._rope(left, i, k) + self._rope(right, k, j)
        return self._written[s, i, j]

    def audit(self, packed: str, i: int, j: int) -> str:
        """Initials of the edits that lead through a packed sequence from state i to j."""
        front = [self.matrices[packed[0]]]
        for s in packed[1:]:
            front.append(product(front[-1], self.matrices[s]))
        parts = []
        for at in range(len(packed) - 1, 0, -1):
            k = front[at][i][j][2]
            parts.append(self._rope(packed[at], k, j))
            j = k
        parts.append(self._rope(packed[0], i, j))
        return "".join(reversed(parts))
