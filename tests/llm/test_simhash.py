"""Fingerprints, the grid and the components of op12 against plain definitions."""

import random

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.conftest import SMALL
from tests.llm.helpers import edge_rows, empty, frame
from vigil.llm import simhash


def plain_fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = lower.encode().split()
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(ids, prints, far=3):
    prints = np.array(prints, np.uint64)
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count(prints ^ prints[i]) <= far):
            root[find(i)] = find(int(j))
    least = {}
    for i, key in enumerate(ids):
        r = find(i)
        least[r] = min((x for x in (key, least.get(r)) if x is not None), default=None)
    return [least[find(i)] for i in range(len(ids))]


def expected(rows):
    prints = [plain_fingerprint(t) for _, t in rows]
    return sorted(zip([i for i, _ in rows], prints, plain_components([i for i, _ in rows], prints)), key=repr)


def result(docs, **how):
    rows = simhash.near_duplicates(docs, **how).collect()
    return sorted(((r["id"], r["fp"] % 2 ** 64, r["component_id"]) for r in rows), key=repr)


def test_edges(spark):
    rows = [(i, t if t is None or len(t) < 9000 else t[:9000]) for i, t in edge_rows()]
    rows += [(None, "Only Here now and then"), (None, "only here now and then"), (None, "never seen before at all"), (20, "ÄB Cd"), (21, "Äb CD")]
    assert result(frame(spark, rows)) == expected(rows)
    assert result(empty(spark)) == []


def test_long_text_is_hashed_in_parts(monkeypatch):
    text = " ".join(f"w{i % 701}" for i in range(5000)).encode()
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "SHINGLES_AT_ONCE", 333)
    assert simhash.fingerprint(text) == whole == plain_fingerprint(text.decode())


def test_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in simhash.read_table(spark, SMALL, "documents").select("doc_id", "text").collect()]
    want = sorted((i, f"{fp:016x}", c) for i, fp, c in expected(rows))
    assert sorted(map(tuple, simhash.query(spark, SMALL).collect())) == want


def flipped(r, x, bits):
    for b in r.sample(range(64), bits):
        x ^= 1 << b
    return x


def signed(x):
    return x - 2 ** 64 if x >= 2 ** 63 else x


@pytest.fixture(scope="module")
def clustered():
    """Random fingerprints, chains of steps of up to four bits, and one dense cluster."""
    r = random.Random(9)
    prints = [r.getrandbits(64) for _ in range(600)]
    for x in prints[:150]:
        for _ in range(r.randint(1, 4)):
            x = flipped(r, x, r.randint(1, 4))
            prints.append(x)
    centre = r.getrandbits(64)
    prints += [flipped(r, centre, r.randint(0, 4)) for _ in range(500)]
    return sorted(set(prints) | {0, 2 ** 64 - 1, 1, 2 ** 63})


@pytest.mark.parametrize("block", [8192, 40, 7])
def test_components_of_links_lose_nothing(spark, clustered, block):
    values = spark.createDataFrame([(signed(x),) for x in clustered], "fp long")
    found = simhash.links(simhash.dealt(simhash.grid(values), block)).distinct().toPandas()
    a, b = found["u"].to_numpy().view(np.uint64), found["v"].to_numpy().view(np.uint64)
    assert (np.bitwise_count(a ^ b) <= 3).all()
    at = {x: i for i, x in enumerate(clustered)}
    root = list(range(len(clustered)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for u, v in zip(a.tolist(), b.tolist()):
        root[find(at[u])] = find(at[v])
    mine = pd.Series([find(i) for i in range(len(clustered))])
    want = pd.Series(plain_components(list(range(len(clustered))), clustered))
    pairs = pd.concat([mine, want], axis=1).drop_duplicates()
    assert len(pairs) == mine.nunique() == want.nunique()


def test_a_dense_cluster_gives_few_links(spark):
    r = random.Random(2)
    centre = r.getrandbits(64)
    cluster = sorted({flipped(r, centre, r.randint(0, 2)) for _ in range(1500)})
    values = spark.createDataFrame([(signed(x),) for x in cluster], "fp long")
    n = simhash.links(simhash.dealt(simhash.grid(values))).count()
    assert n < 40 * len(cluster)


def test_segment_counts_bound_the_distance(spark):
    r = random.Random(4)
    pairs = [(x, flipped(r, x, r.randint(0, 9))) for x in (r.getrandbits(64) for _ in range(300))]
    df = spark.createDataFrame([(signed(x), signed(y)) for x, y in pairs], "x long, y long")
    got = df.select(simhash.segment_counts(F.col("x")), simhash.segment_counts(F.col("y"))).collect()
    for (x, y), (p, q) in zip(pairs, got):
        counts = [[v % 2 ** 64 >> 2 * k & 3 for k in range(32)] for v in (p, q)]
        assert counts[0] == [bin(x >> 2 * k & 3).count("1") for k in range(32)]
        assert sum(abs(s - t) for s, t in zip(*counts)) <= bin(x ^ y).count("1")
