"""Lyndon groups, runs and the registered query op11 against plain definitions."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from tests.conftest import SMALL
from tests.llm.helpers import edge_rows, empty, frame
from vigil.llm import periodic_runs
from vigil.llm.lyndon import lyndon_groups, runs, stretches


def longest_lyndon(w):
    out = []
    for i in range(len(w)):
        j = i + 1
        while j < len(w) and w[j:] > w[i:]:
            j += 1
        out.append(j - i)
    return out


def plain_runs(w, least, powers):
    """Every maximal stretch of every period, the smallest period of each stretch."""
    found = {}
    for p in range(1, len(w) // powers + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            length = j + p - i
            if length >= max(least, powers * p):
                found[i, length] = min(p, found.get((i, length), p))
            i = max(i + 1, j)
    return sorted([(s, length, p) for (s, length), p in found.items()], key=lambda r: (r[0], r[2]))


words = st.lists(st.integers(0, 2), max_size=30)


@settings(max_examples=300, deadline=None)
@given(words, words, st.integers(0, 9), words)
def test_groups_and_runs(a, block, times, b):
    w = a + block * times + b
    lengths, groups = lyndon_groups(w)
    assert lengths == longest_lyndon(w)
    word = [tuple(w[i:i + n]) for i, n in enumerate(lengths)]
    assert len(set(zip(word, groups))) == len(set(word)) == len(set(groups))
    for least in (3, 6, 24):
        assert runs(np.array(w, np.int64), least) == plain_runs(w, least, 3)


def test_fibonacci_and_long_words():
    a, b = [0], [0, 1]
    while len(b) < 2000:
        a, b = b, b + a
    assert runs(np.array(b, np.int64)) == plain_runs(b, 24, 3)
    r = random.Random(3)
    block = [r.randrange(50) for _ in range(400)]
    w = [r.randrange(50) for _ in range(500)] + block * 4 + block[:70] + [r.randrange(50) for _ in range(500)]
    assert runs(np.array(w, np.int64)) == plain_runs(w, 24, 3)


def test_stretches_leave_unique_text_out():
    w = np.concatenate([np.arange(1000), np.tile(np.arange(2000, 2010), 4), np.arange(3000, 4000)])
    assert stretches(w, 24) == [(1000, 1040)]
    assert stretches(np.arange(500), 24) == [] and stretches(np.arange(3), 24) == []


def expected(doc_id, text):
    w = (text or "").encode().split()
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = plain_runs(w, 24, 3)
    dropped = {i for s, length, p in found for i in range(s + p, s + length)}
    best = None
    for s, length, p in found:
        if best is None or length * best[2] > best[1] * p:
            best = (s, length, p)
    lines = "".join(f"{s},{length},{p}\n" for s, length, p in found)
    kept = b" ".join(x for i, x in enumerate(w) if i not in dropped)
    return (doc_id, len(found), *(best or (None, None, None)), best and 1000 * best[1] // best[2],
            hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def order(rows):
    return sorted(map(tuple, rows), key=repr)


def test_query_against_definition(spark):
    rows = [r for r in periodic_runs.read_table(spark, SMALL, "documents").select("doc_id", "text").collect() if len(r["text"]) < 9000]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = digests(docs)
    assert order(got) == order(expected(i, t) for i, t in rows)
    assert sum(r["n_runs"] > 0 for r in got) >= 5
    assert periodic_runs.query(spark, SMALL).count() == 200


def digests(docs):
    return periodic_runs.digests(periodic_runs.periodic_runs(periodic_runs.with_periodic_tails(docs))).collect()


def test_edges(spark):
    rows = [(i, t) for i, t in edge_rows() if t is None or len(t) < 9000]
    rows += [(None, "a b " * 20), (None, None), (23, "x " * 24), (24, "x " * 23), (25, "p q r\n" * 8 + "p q"), (25, "p q r\n" * 8 + "p q")]
    assert order(digests(frame(spark, rows))) == order(expected(i, t) for i, t in rows)
    got = {r["id"]: r for r in periodic_runs.periodic_runs(frame(spark, rows)).collect()}
    assert got[23]["collapsed"] == "x" and got[25]["runs"][0].asDict() == {"start": 0, "length": 26, "period": 3}
    assert got[24]["runs"] == [] and got[1]["n_words"] == 0 and got[1]["collapsed"] == ""
    assert digests(empty(spark)) == []


def test_a_very_long_text(spark):
    text = "lorem ipsum " + "a b c d e f g h i j " * 30_000 + "end"
    row = periodic_runs.periodic_runs(frame(spark, [(1, text)])).first()
    assert [tuple(r) for r in row["runs"]] == [(2, 300_000, 10)]
    assert row["collapsed"] == "lorem ipsum a b c d e f g h i j end"


def test_ties_take_the_first():
    found = plain_runs([1] * 24 + [2] * 24, 24, 3)
    assert found == [(0, 24, 1), (24, 24, 1)]


@pytest.mark.parametrize("parts", [1, 7])
def test_partitions_do_not_matter(spark, parts):
    docs = frame(spark).repartition(parts)
    assert order(digests(docs)) == order(digests(frame(spark)))
