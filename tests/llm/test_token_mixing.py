"""op8's mixing over all tokens: codes, counts and scores against plain Python."""

import random
import zlib
from collections import Counter

import numpy as np

from tests.llm.helpers import edge_rows, frame, prose
from vigil.llm import lm_score, token_mixing
from vigil.llm.token_mixing import Codes, TokenMixer


def held(k):
    return zlib.crc32(str(k).encode()) % 7 == 2


def some_codes(n):
    wh = np.sort(np.random.default_rng(n).integers(0, 2 ** 64, n, dtype=np.uint64))
    counts = np.array([2 + 5000 // (k + 1) for k in range(n)])
    return Codes(wh, counts, 40, 0), [*counts.tolist(), 40, 1]


def test_codes_are_complete_prefix_codes_with_exact_counts():
    for n in (0, 1, 2, 57, 3000):
        codes, counts = some_codes(n)
        bits = [format(int(c), "032b")[:k] for c, k in zip(codes.code, codes.length)]
        assert sum(2.0 ** -len(b) for b in bits) == 1 and len(set(bits)) == n + 2
        want = Counter()
        for b, c in zip(bits, counts):
            for k in range(len(b)):
                want[b[:k], b[k]] += c
        assert sorted(want.values()) == sorted(codes.order0.tolist()) and codes.nodes == n + 1


def test_every_context_has_a_distribution_that_learning_improves():
    codes, _ = some_codes(300)
    r = random.Random(4)
    leaf = np.array([r.randrange(20) if k % 2 else 299 for k in range(4000)])
    before = token_mixing.contexts(codes.wh[leaf], np.array([0]))
    counts = np.zeros((token_mixing.ORDERS, 2 * token_mixing.SLOTS), np.int64)
    token_mixing.count_bits(codes, leaf, before, counts)
    assert counts.sum(axis=1).tolist() == [codes.length[leaf].astype(int).sum()] * token_mixing.ORDERS
    mixer = TokenMixer(codes, counts)
    slopes = np.zeros((token_mixing.DEPTHS, (token_mixing.ORDERS + 1) * (token_mixing.ORDERS + 2)))
    mixer.slopes(leaf, before, slopes)
    taught = mixer.moved(slopes)
    assert taught.log10(leaf, before, True).sum() > mixer.log10(leaf, before, True).sum()
    every = np.arange(302)
    for at in (0, 1, 2, 77):
        same = [np.full(302, b[at]) for b in before]
        for m in (mixer, taught):
            assert abs((10 ** m.log10(every, same, False)).sum() - 1) < 1e-4


def test_counts_come_from_all_training_tokens(spark):
    """Counts added up by shuffles, over many partitions, are those of one process."""
    rows = edge_rows() + [(100 + k, prose(k, 40)) for k in range(60)]
    units = lm_score._units(frame(spark, rows).repartition(9), "doc_id", "text")
    raws = [(t or "").encode() for i, t in rows if not held(i)]
    wh, counts = np.unique(np.concatenate([lm_score._hashed(r) for r in raws]), return_counts=True)
    codes = Codes(wh[counts > 1], counts[counts > 1], int((counts == 1).sum()), len(raws))
    t = lm_score.Tokens(raws, lm_score.Finder(codes.wh))
    want = np.zeros((token_mixing.ORDERS, 2 * token_mixing.SLOTS), np.int64)
    token_mixing.count_bits(codes, t.leaf, t.before, want)
    got = lm_score.token_counts(units, spark.sparkContext.broadcast(codes))
    assert (got == want).all() and got.sum() > 0


def test_weights_come_from_all_training_tokens(spark):
    """Weights learned over many partitions are those of one process that reads every training document, of whatever id."""
    rows = [(k, prose(k, 40)) for k in range(90)]
    raws = [t.encode() for i, t in rows if not held(i)]
    wh, counts = np.unique(np.concatenate([lm_score._hashed(r) for r in raws]), return_counts=True)
    codes = Codes(wh[counts > 1], counts[counts > 1], int((counts == 1).sum()), len(raws))

    def taught(raws):
        t = lm_score.Tokens(raws, lm_score.Finder(codes.wh))
        total = np.zeros((token_mixing.DEPTHS, (token_mixing.ORDERS + 1) * (token_mixing.ORDERS + 2)))
        mixer.slopes(t.leaf, t.before, total)
        return mixer.moved(total).weights

    t = lm_score.Tokens(raws, lm_score.Finder(codes.wh))
    total = np.zeros((token_mixing.ORDERS, 2 * token_mixing.SLOTS), np.int64)
    token_mixing.count_bits(codes, t.leaf, t.before, total)
    mixer = TokenMixer(codes, total)
    got = lm_score.token_weights(lm_score._units(frame(spark, rows).repartition(7), "doc_id", "text"), spark.sparkContext.broadcast(mixer))
    assert np.abs(got.weights - taught(raws)).max() < 3e-4
    for k in range(7):          # no fold of ids is left out
        assert k == 2 or np.abs(got.weights - taught([t.encode() for i, t in rows if not held(i) and zlib.crc32(str(i).encode()) % 7 != k])).max() > 3e-4


def test_slopes_are_sums_over_bits():
    codes, _ = some_codes(300)
    r = random.Random(5)
    leaf = np.array([r.randrange(302) for _ in range(500)])
    before = token_mixing.contexts(codes.wh[np.minimum(leaf, 299)], np.array([0]))
    counts = np.zeros((token_mixing.ORDERS, 2 * token_mixing.SLOTS), np.int64)
    token_mixing.count_bits(codes, leaf, before, counts)
    mixer, n = TokenMixer(codes, counts), token_mixing.ORDERS + 1
    got, want = np.zeros((token_mixing.DEPTHS, n * (n + 1))), np.zeros((token_mixing.DEPTHS, n * (n + 1)))
    mixer.slopes(leaf, before, got)
    for at in range(len(leaf)):
        for depth, _, places in token_mixing.bit_steps(codes, codes.code[leaf[at:at + 1]], codes.length[leaf[at:at + 1]], [b[at:at + 1] for b in before]):
            x = np.array([t[p[0]] for t, p in zip(mixer.tables(True), places)], float)
            miss = 1 / (1 + np.exp(mixer.weights[depth] @ x))
            want[depth] += [*(x * miss), *(np.outer(x, x) * miss * (1 - miss)).ravel()]
    assert np.allclose(got, want, rtol=1e-4, atol=1e-4) and np.abs(want).max() > 1


def test_words_are_found_by_hash():
    keys = np.sort(np.random.default_rng(1).integers(0, 2 ** 64, 5000, dtype=np.uint64) >> np.uint64(8))    # many share their top bits
    wanted = np.concatenate([keys, keys + np.uint64(1), np.array([0, 2 ** 64 - 1], np.uint64)])
    place, there = lm_score.Finder(keys).find(wanted)
    assert there.tolist() == np.isin(wanted, keys).tolist() and (keys[place[there]] == wanted[there]).all()


def test_known_words_are_scored_by_the_words_before(spark):
    """Each word is followed by one of two; a held-out text in that order scores far above the same words in another order."""
    r = random.Random(3)
    words, to = [f"w{k}x" for k in range(200)], r.sample(range(200), 200)
    after = {w: (words[to[k]], words[to[k - 1]]) for k, w in enumerate(words)}

    def text(seed):
        q = random.Random(seed)
        out = [q.choice(words)]
        while len(out) < 120:
            out.append(q.choice(after[out[-1]]))
        return out

    rows, mixed_up = [(k, text(k)) for k in range(300)], set()
    asked = [k for k in range(300, 600) if held(k)][:40]
    for k in asked:
        t = text(k // 2 * 2)
        if k in asked[::2]:
            mixed_up.add(k)
            random.Random(k).shuffle(t)
        rows.append((k, t))
    out = {x["id"]: x for x in lm_score.score_documents(frame(spark, [(k, " ".join(t)) for k, t in rows])).collect()}
    assert all(out[k]["n_known"] == 121 for k in asked)
    in_order = np.mean([out[k]["score"] / 121 for k in asked if k not in mixed_up])
    shuffled = np.mean([out[k]["score"] / 121 for k in mixed_up])
    base = np.mean([out[k]["base_score"] / 121 for k in asked])
    assert in_order > shuffled + 1 and in_order > base + 1
