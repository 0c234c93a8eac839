"""Matrices, grammar and the registered query op13 against plain definitions."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from hypothesis import given, settings, strategies as st

from tests.conftest import SMALL
from vigil.llm import conversation_repair as cr
from vigil.llm import repair_grammar as rg

WHITE = " \t\n\x0b\x0c\r"


def plain_repair(turns):
    """(cost, audit, roles) of the cheapest edits of [(initial, fault)]: a table of the best way to every state."""
    best = {rg.START: (0, "", ())}

    def better(to, state, found):
        if state not in to or found[:2] < to[state][:2]:
            to[state] = found

    def inserted(front):
        for _ in range(3):
            for state, (cost, audit, out) in list(front.items()):
                role = "a" if state == rg.USER else "u"
                better(front, rg.USER if role == "u" else rg.ASSISTANT, (cost + 2, audit + "I", (*out, (role, None))))
        return front

    for at, (initial, fault) in enumerate(turns):
        new = {}
        for state, (cost, audit, out) in inserted(best).items():
            better(new, state, (cost + 3, audit + "D", out))
            if fault in ("blank", "duplicate"):
                continue
            extra = fault == "truncated"
            for role, to in (("s", rg.SYSTEM), ("u", rg.USER), ("a", rg.ASSISTANT)):
                if role == "s" and state != rg.START or role == "u" and state == rg.USER or role == "a" and state != rg.USER:
                    continue
                if role == initial:
                    better(new, to, (cost + extra, audit + "K", (*out, ("keep", at))))
                if role != "s":
                    better(new, to, (cost + 2 + extra, audit + "R", (*out, (role, at))))
        best = new
    best = inserted(best)
    return min(best[s] for s in (rg.START, rg.ASSISTANT) if s in best)


def every_way(turns, most=8):
    """All edit strings up to a length, by brute force."""
    found = []
    n = len(turns)
    for size in range(n, most + 1):
        for audit in itertools.product("DIKR", repeat=size):
            if size - audit.count("I") != n:
                continue
            cost, roles, at, ok = 0, "", 0, True
            for e in audit:
                if e == "I":
                    cost += 2
                    roles += "a" if roles.endswith("u") else "u"
                    continue
                initial, fault = turns[at]
                at += 1
                if e == "D":
                    cost += 3
                    continue
                ok &= fault not in ("blank", "duplicate")
                cost += fault == "truncated"
                if e == "K":
                    roles += initial
                else:
                    cost += 2
                    roles += "a" if roles.endswith("u") else "u"
            if ok and re.fullmatch(r"(s?(ua)+)?", roles):
                found.append((cost, "".join(audit)))
    return min(found)


turn_lists = st.lists(st.tuples(st.sampled_from("suax"), st.sampled_from(rg.FAULTS)), min_size=1, max_size=24)


def by_matrix(grammar, packed):
    row = grammar.matrix(packed)[rg.START]
    cost, _, j = min((row[j][0] + rg.INSERT * len(rg.LAST[j]), row[j][1], j) for j in rg.STATES if row[j])
    return cost, grammar.audit(packed, rg.START, j) + rg.LAST[j]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("sua"), st.sampled_from(["", "", "blank", "truncated"])), min_size=1, max_size=3))
def test_plain_form_is_the_cheapest_of_all(turns):
    assert plain_repair(turns)[:2] == every_way(turns)


@settings(max_examples=400, deadline=None)
@given(turn_lists)
def test_matrices(turns):
    symbols = "".join(rg.symbol(*t) for t in turns)
    assert [rg.read_symbol(s) for s in symbols] == turns
    assert by_matrix(rg.Grammar([]), symbols) == plain_repair(turns)[:2]


def test_rules_are_the_sequences_they_stand_for(spark):
    r = random.Random(6)
    lists = [[(r.choice("suax"), r.choice(rg.FAULTS)) for _ in range(r.randint(1, 30))] for _ in range(40)]
    lists += [[("u", ""), ("a", "")] * 20, [("u", "duplicate")] * 33, [("s", "")] + [("u", ""), ("a", "")] * 7] * 3
    words = ["".join(rg.symbol(*t) for t in turns) for turns in lists]
    df = spark.createDataFrame([(w, 1) for w in words], "symbols string, n long").groupBy("symbols").sum("n").toDF("symbols", "n")
    packed, rules = cr.re_pair(df)
    grammar = rg.Grammar(rules)

    def spelled(s):
        return s if s not in grammar.rules else "".join(map(spelled, grammar.rules[s]))

    rows = packed.collect()
    assert len(rows) == len(set(words)) and len(rules) > 10
    for row in rows:
        assert "".join(map(spelled, row["packed"])) == row["symbols"]
        assert by_matrix(grammar, row["packed"]) == plain_repair([rg.read_symbol(s) for s in row["symbols"]])[:2]
    assert max(len(r["packed"]) for r in rows if r["symbols"] == words[40]) == 1
    pairs = [row["packed"][i:i + 2] for row in rows for i in range(len(row["packed"]) - 1)]
    assert len(rules) == cr.ROUNDS * cr.RULES_A_ROUND or len(pairs) - len(set(pairs)) < 40


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if h == 0:
            continue
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        out += [(conv, turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    return out


def plain_report(rows):
    """The query's rows, by its definition."""
    after = {}
    for conv, turn, role, text in plain_damage(rows):
        after.setdefault(conv, []).append((turn, role, text))
    out = []
    for conv in {r[0] for r in rows}:
        turns = sorted(after.get(conv, []), key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), hashlib.sha256(t[2].encode()).digest()))
        numbers = [t[0] for t in turns if t[0] is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        seen, faults = set(), []
        for _, role, text in turns:
            bare = text.rstrip(WHITE)
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        initials = [role[:1] for _, role, _ in turns]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit, kept = plain_repair([(i if i and i in "sua" else "x", f) for i, f in zip(initials, faults)])
        name = {"u": "user", "a": "assistant"}
        lines = [(turns[at][1] if role == "keep" else name[role]) + ":" + (turns[at][2] if at is not None else "") for role, at in kept]
        out.append((conv, gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit,
                    hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def report(spark, rows, monkeypatch, extra=True):
    kind = "conv_id long, turn long, role string, text string"
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], kind + ", c string, late int") if extra else spark.createDataFrame(rows, kind)
    monkeypatch.setattr(cr, "read_table", lambda *_: df)
    return sorted(map(tuple, cr.query(spark, "").collect()), key=repr)


def test_query(spark):
    rows = [tuple(r) for r in cr.read_table(spark, SMALL, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, cr.query(spark, SMALL).collect()), key=repr) == plain_report(rows)


def test_edges(spark, monkeypatch):
    r = random.Random(11)
    texts = ["Hello.", "what", "", " \n", None, "yes!", "a ", "Fine? \t", "日本。", "x" * 20_000 + "."]
    rows = [(c, r.choice([None, *range(6)]), r.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None]), r.choice(texts))
            for c in [None, *range(25)] for _ in range(r.randint(1, 9))]
    rows += rows[::7] + [(99, None, "user", None), (98, 5, "user", "Only one."), (97, 3, "assistant", "b.")]
    assert report(spark, rows, monkeypatch) == plain_report(rows)
    assert report(spark, [], monkeypatch, extra=False) == []


@pytest.mark.parametrize("word", [1024, 7])
def test_one_long_conversation_is_many_words(spark, monkeypatch, word):
    monkeypatch.setattr(cr, "WORD", word)
    r = random.Random(5)
    roles = ["user", "assistant", "user", "assistant", "system"]
    rows = [(1, t, r.choice(roles), r.choice(["Yes.", "No", f"Turn {t}."])) for t in range(400)] + [(2, 0, "user", "Same."), (2, 1, "user", "Same.")]
    rows += [(1, 50, "user", "Again and again.")] * 60 + [(3, 8, "assistant", "Once.")] * 40
    assert report(spark, rows, monkeypatch) == plain_report(rows)


def test_no_rows_left(spark, monkeypatch):
    gone = [(c, t, "user", "Hi.") for c in range(400) for t in (0,) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0][:3]
    none = [(c, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c, *_ in gone]
    assert gone and report(spark, gone, monkeypatch) == sorted(none, key=repr)
