"""op5, op6 and op7 against plain Python."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from tests.llm.helpers import edge_rows, empty, frame, prose
from vigil.llm import bagminhash, exact_dedup, near_dedup, suffix_dedup
from vigil.llm.common import shingle_words, word_hashes
from vigil.llm.components import components
from vigil.llm.suffix_array import common_prefixes, suffix_array


# ---- exact dedup ----

def exact_by_hand(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub("[\x20\x09-\x0d]", "", t or "")].append((-len(t or ""), i))
    out = []
    for norm, g in groups.items():
        n, keep = min(g)
        out += [(i, keep, len(g), i == keep and m == n, hashlib.sha256(norm.encode()).hexdigest()) for m, i in g]
    return sorted(out)


@pytest.mark.parametrize("options", [{}, {"hash_bits": 3, "shortest": 20, "longest": 60}])
def test_exact_dedup(spark, options):
    """With 3 hash bits nearly all chunks clash, and their ordinals must tell them apart."""
    out = exact_dedup.exact_dedup(frame(spark), **options)
    assert sorted(tuple(r)[:5] for r in out.collect()) == exact_by_hand(edge_rows())


def test_exact_dedup_empty_and_kept_rows(spark):
    assert exact_dedup.exact_dedup(empty(spark)).count() == 0
    kept = exact_dedup.drop_copies(frame(spark))
    assert kept.columns == frame(spark).columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({r[0] for r in exact_by_hand(edge_rows()) if r[3]})


def test_exact_dedup_null_id_is_smallest(spark):
    rows = [(3, "ab"), (None, "a b"), (2, "ab")]
    got = {r["id"]: (r["keep_id"], r["kept"]) for r in exact_dedup.exact_dedup(frame(spark, rows)).collect()}
    assert got == {None: (None, True), 2: (None, False), 3: (None, False)}


def test_recipes_resynchronise(spark):
    """An insertion changes only the chunks around it."""
    a = "".join(prose(9, 3000).split())
    rows = exact_dedup.chunk_recipes(frame(spark, [(1, a), (2, "insert" + a)])).collect()
    one, two = (set(r["hashes"]) for r in rows)
    assert len(one) > 10 and len(one & two) > len(one) // 2


# ---- near dedup ----

def test_bagminhash_is_unbiased():
    r = np.random.default_rng(3)
    for _ in range(3):
        e = r.integers(0, 2 ** 63, 200).astype(np.uint64)
        a = r.integers(0, 7, 200)
        b = np.where(r.random(200) < 0.6, a, r.integers(0, 9, 200))
        want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        agree = []
        for salt in range(12):
            s = e ^ np.uint64(salt)
            sig = [bagminhash.signatures(s[w > 0], w[w > 0], np.array([(w > 0).sum()]), 128)[0] for w in (a, b)]
            agree.append((sig[0] == sig[1]).mean())
        assert abs(np.mean(agree) - want) < 0.05


def test_signatures_do_not_depend_on_the_batch():
    bags = [np.unique(shingle_words(prose(s, 50 + 40 * s).encode()), return_counts=True) for s in range(6)]
    flat = [np.concatenate(x) for x in zip(*bags)]
    many = bagminhash.signatures(*flat, np.array([len(k) for k, _ in bags]), 80)
    for sig, (k, n) in zip(many, bags):
        assert (bagminhash.signatures(k, n, np.array([len(k)]), 80)[0] == sig).all()


def test_word_hashes():
    w = word_hashes("  one\ttwo\nthree one ".encode())
    assert len(w) == 4 and w[0] == w[3] and len(set(w.tolist())) == 3
    assert word_hashes(b"a much longer text before two")[-1] == w[1]
    assert len(word_hashes(b" \n")) == 0 and len(shingle_words(b"only three words")) == 1


def near_by_hand(rows):
    bags = [Counter(shingle_words((t or "").encode()).tolist()) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (_, a) in enumerate(rows):
        for j in range(i):
            same = (a or "").encode().split() == (rows[j][1] or "").encode().split()
            inter, union = sum((bags[i] & bags[j]).values()), sum((bags[i] | bags[j]).values())
            if same or (union and inter >= 0.8 * union):
                parent[find(i)] = find(j)
    ids = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        ids[find(k)].append(i)
    return {i: min(g) for g in ids.values() for i in g}


def test_near_duplicates(spark):
    got = {r["id"]: r["class_id"] for r in near_dedup.near_duplicates(frame(spark)).collect()}
    assert got == near_by_hand(edge_rows()) and got[6] == 0 and got[7] == 7
    assert near_dedup.near_duplicates(empty(spark)).count() == 0


def test_near_duplicates_of_a_chain_and_a_large_group(spark):
    """A group where the copies are near a base but hardly near each other, and a chain of small edits."""
    base = prose(20, 200).split()
    rows = [(0, " ".join(base))]
    for k in range(1, 60):
        w = list(base)
        for p in ((k * 7) % 190, (k * 31 + 11) % 190):
            w[p] = f"edit{k}"
        rows.append((k, " ".join(w)))
    w = list(prose(21, 200).split())
    for k in range(100, 130):
        w[(k * 5) % 200] = f"step{k}"
        rows.append((k, " ".join(w)))
    got = {r["id"]: r["class_id"] for r in near_dedup.near_duplicates(frame(spark, rows)).collect()}
    assert got == near_by_hand(rows)


def test_block_links_find_what_hubs_miss(spark, monkeypatch):
    """With tiny blocks every bucket is split over groups; the classes stay the same."""
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", 300)
    test_near_duplicates_of_a_chain_and_a_large_group(spark)


def test_small_table_classes(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.query(spark, SMALL).collect()}
    assert got == near_by_hand(rows)


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 90), (90, 95), (95, 100), (7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 90: 90, 95: 90, 100: 90}


# ---- repeated passages ----

def test_suffix_array_and_common_prefixes():
    r = np.random.default_rng(5)
    for _ in range(40):
        parts = [bytes(r.integers(0, 3, r.integers(1, 40), dtype=np.uint8)) for _ in range(r.integers(1, 6))]
        text, starts = np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0, *map(len, parts)])[:-1]
        order, rank = suffix_array(text, starts)
        suffix = [p[k:] for p in parts for k in range(len(p))]
        got = [suffix[i] for i in order]
        assert got == sorted(suffix) and (order[rank] == np.arange(len(text))).all()
        want = [0] + [next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))) for a, b in zip(got, got[1:])]
        assert common_prefixes(text, starts, order, rank).tolist() == want


def repeats_by_hand(rows):
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: -1 if r[0] is None else r[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 99):
            w = b[s:s + 100]
            if w in seen:
                gone[s:s + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def passages():
    rows = [r for r in edge_rows() if r[0] != 13]
    shared = prose(30, 40)
    rows += [(20 + k, prose(31 + k, 20 + k) + " " + shared[k:] + " " + prose(60 + k, 10)) for k in range(12)]
    rows += [(40, "ab" * 300), (41, "ba" * 120), (42, shared[:99]), (43, shared[:100]), (44, (shared[:150] + "|") * 3)]
    return rows


def test_drop_repeats(spark):
    out = suffix_dedup.drop_repeats(frame(spark, passages()))
    assert sorted((tuple(r)[:5] for r in out.collect()), key=str) == repeats_by_hand(passages())
    assert suffix_dedup.drop_repeats(empty(spark)).count() == 0


def test_drop_repeats_over_many_small_shards(spark, monkeypatch):
    """Groups that span shards are merged by binary search."""
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 200)
    test_drop_repeats(spark)


def test_drop_repeats_null_id_and_repeated_rows(spark):
    text = prose(70, 60)
    rows = [(None, text), (5, text), (5, text), (6, text[:90])]
    out = suffix_dedup.drop_repeats(frame(spark, rows)).collect()
    got = sorted(((r["id"], r["n_removed"]) for r in out), key=str)
    assert got == sorted([(None, 0), (5, len(text)), (5, len(text)), (6, 0)], key=str)


def test_small_table_repeats(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    out = suffix_dedup.query(spark, SMALL).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, out), key=str) == repeats_by_hand([tuple(r) for r in docs])


def test_drop_near_copies_keeps_columns(spark):
    docs = frame(spark).withColumn("root", F.lit("r"))
    kept = near_dedup.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(near_by_hand(edge_rows()).values()))
