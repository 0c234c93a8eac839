"""op8, op10 and the pipeline: held-out accuracy, exact sums and plain Python."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.conftest import MEDIUM, SMALL
from tests.llm.helpers import edge_rows, empty, frame, prose
from vigil.llm import context_mixing, lm_score, queries, quality
from vigil.llm.quality import REPEAT


# ---- Kneser-Ney ----

TRUSTED = [("en", prose(k, 30)) for k in range(12)] + [("zh", "日本語の本 3 本 本 語 Text"), ("zh", "語の本日 本語 日日")]


def kneser_ney_by_hand(texts):
    """probability(symbols, position) of interpolated modified Kneser-Ney over the texts, with dictionaries."""
    counts = Counter()
    for t in texts:
        s = (0, 0, 0, *quality.symbols_of(t).tolist())
        counts.update(s[k - 3:k + 1] for k in range(3, len(s)))
    levels = {4: counts}
    for k in (3, 2, 1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])

    def p(gram):
        k = len(gram)
        if not k:
            return 1 / (len(levels[1]) + 1)
        rows = {g: n for g, n in levels[k].items() if g[:-1] == gram[:-1]}
        if not rows:
            return p(gram[1:])
        n = [max(1, sum(v == i for v in levels[k].values())) for i in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1])
        d = [0] + [min(max(i - (i + 1) * y * n[i] / n[i - 1], 0.05 * i), i) for i in (1, 2, 3)]
        cut = {g: d[min(v, 3)] for g, v in rows.items()}
        return (rows.get(gram, 0) - cut.get(gram, 0) + sum(cut.values()) * p(gram[1:])) / sum(rows.values())

    return p, levels


def test_kneser_ney_by_hand(spark):
    """Both ways of meeting the model give the loss of a plain-Python model, for any alphabet, and probabilities sum to one."""
    model = quality.kneser_ney(quality.ngram_counts(spark.createDataFrame(TRUSTED, "lang string, text string")))
    asked = [("en", prose(3, 30)), ("en", prose(99, 12) + " Ünseen 日 77"), ("en", ""), ("zh", "日本語 本語の 新 本 本"), ("zh", "日本語 本語の 新 本 本")]
    texts = spark.createDataFrame(asked, "lang string, text string")
    for most in (quality.MOST_BROADCAST, 0):
        got = sorted((r["lang"], r["text"], r["s"]["n"], r["s"]["loss"]) for r in
                     quality.with_loss(texts, model, quality.tables_of(model, most)).collect())
        for (lang, text, n, loss), (_, t) in zip(got, sorted(asked)):
            p, _ = kneser_ney_by_hand([x for k, x in TRUSTED if k == lang])
            s = (0, 0, 0, *quality.symbols_of(text).tolist())
            assert text == t and n == len(s) - 3
            assert abs(loss + sum(math.log(p(s[k - 3:k + 1])) for k in range(3, len(s)))) < 1e-6
    p, levels = kneser_ney_by_hand([x for k, x in TRUSTED if k == "zh"])
    for context in list(levels[4])[:5]:
        assert abs(sum(p((*context[:3], s)) for (s,) in levels[1]) + p((*context[:3], -1)) - 1) < 1e-9


def test_symbols():
    assert len(quality.symbols_of("")) == 0
    s = quality.symbols_of("the the the cat")
    assert s.tolist().count(REPEAT) == 2 and len(s) == 3 + 2 + 4
    assert quality.symbols_of("X1").tolist() == [quality.CAPITAL, quality.DIGIT]
    assert len(set(quality.symbols_of("".join(map(chr, range(0x4E00, 0x9000)))).tolist())) == 0x9000 - 0x4E00


def test_quality_joins_agree(spark):
    """The whole operator with the model broadcast and joined."""
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    a, b = ({r["id"]: (r["rejected"], round(r["loss"], 6)) for r in quality.quality_scores(docs, labels, most_broadcast=m)
             .select(F.col("row.doc_id").alias("id"), "rejected", "loss").collect()} for m in (quality.MOST_BROADCAST, 0))
    assert a == b and len(a) == docs.count()


def test_quality_on_labels(spark):
    docs, labels = (spark.read.parquet(f"{MEDIUM}/{t}.parquet") for t in ("documents", "labels"))
    out = quality.query(spark, MEDIUM).join(labels, "doc_id", "left").collect()
    assert len(out) == docs.count()
    bad = [r["kept"] for r in out if r["quality"] == 0]
    good = [r["kept"] for r in out if r["quality"] == 1]
    assert sum(good) == len(good) and sum(bad) < 0.15 * len(bad)


def test_quality_edges(spark):
    docs = frame(spark).withColumn("__n2", F.lit(1))
    labels = spark.createDataFrame([(0, 1, 0), (0, 1, 0), (7, 1, None), (None, 1, 0), (11, 0, 0)], "doc_id long, quality int, toxic int")
    out = quality.quality_scores(docs, labels).select("row.doc_id", "perplexity", "n", "rejected").collect()
    assert len(out) == len(edge_rows())
    by = {r["doc_id"]: r for r in out}
    assert by[1]["perplexity"] == 1.0 and not by[1]["rejected"] and not by[2]["rejected"] and not by[0]["rejected"]
    assert quality.keep_good(docs, labels).columns == docs.columns
    assert quality.keep_good(docs, labels.limit(0)).count() == docs.count()
    assert quality.quality_scores(empty(spark), labels).count() == 0


# ---- context mixing ----

def bits_by_hand(words):
    """Counts of (gate, bit) over all words."""
    c = Counter()
    for w in words:
        for place, byte in enumerate(w + b" "):
            for k in range(8):
                c[min(place, 7) * 8 + k, byte >> (7 - k) & 1] += 1
    return c


def test_bit_steps():
    words = [b"a", b"the", b"\xc3\xa9t", b"longerthanplaces"]
    got = Counter()
    for _, gate, slots, bit, _ in context_mixing.bit_steps(words):
        for b in bit.tolist():
            got[gate, b] += 1
        assert slots.max() < context_mixing.SLOTS and len(slots) == len(context_mixing.ORDERS)
    assert got == bits_by_hand(words)


def test_mixer_learns_and_is_a_distribution():
    words = sorted({w.encode() for w in prose(1, 4000).split()})
    seen, new = words[::2], words[1::2]
    m = context_mixing.Mixer(context_mixing.count_bits(seen))
    before = m.log10(new).mean()
    for at in range(0, len(seen), 64):
        m.learn(seen[at:at + 64])
    after = m.log10(new).mean()
    assert after > before and after > np.mean([-(len(w) + 1) * math.log10(256) for w in new]) / 2
    # The first byte's probabilities, from the words of one byte and their closing blank, sum to at most 1.
    ones = [bytes([b]) for b in range(256) if b not in (9, 10, 11, 12, 13, 32)]
    assert (10 ** m.log10(ones)).sum() <= 1.0


def base_by_hand(rows):
    tokens = {k: [w.decode() for w in re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode().translate(lm_score._LOWER))] for k, (_, t) in enumerate(rows)}
    held = {k: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for k, (i, _) in enumerate(rows)}
    c = Counter()
    for k in tokens:
        if not held[k]:
            c.update([*tokens[k], None])
    n, v = sum(c.values()), len(c)
    return [(i, held[k], len(tokens[k]) + 1, sum(c[w] > 0 for w in [*tokens[k], None]), n,
             sum(math.log10((c[w] + 1) / (n + v + 1)) for w in [*tokens[k], None])) for k, (i, _) in enumerate(rows)]


@pytest.mark.parametrize("head", [lm_score.HEAD, 5, 0])
def test_base_scores(spark, head):
    rows = edge_rows() + [(100 + k, prose(k % 40, 30)) for k in range(80)]
    out = lm_score.score_documents(frame(spark, rows), head_words=head).collect()
    got = sorted(((r["id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in out), key=str)
    assert got == sorted((tuple(x[:5]) + (round(x[5], 4),) for x in base_by_hand(rows)), key=str)
    assert all(r["score"] < 0 and r["bits_per_byte"] is None or r["bits_per_byte"] > 0 for r in out if r["n_bytes"])


def thue_morse(swap: int) -> str:
    bits = [swap]
    while len(bits) < 1024:
        bits += [1 - b for b in bits]
    return "".join("ab"[b] for b in bits)


def test_words_that_clash_in_polynomial_hashes(spark):
    """Two words of 1,024 letters whose polynomial hashes modulo 2^64 are equal, in training and held-out texts."""
    rows = [(k, " ".join([thue_morse(k % 3 == 0)] * (k % 4 + 1) + [f"w{k}"])) for k in range(40)]
    out = lm_score.score_documents(frame(spark, rows)).collect()
    got = sorted((r["id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in out)
    assert got == sorted(tuple(x[:5]) + (round(x[5], 6),) for x in base_by_hand(rows))


def test_scores_by_word_and_by_partitions(spark):
    """Joining by word instead of by hash, and other partitions and orders of the rows, change no score."""
    rows = edge_rows() + [(100 + k, prose(k, 40) + f" own{k}x " + prose(k % 9, 30)) for k in range(150)]
    docs = frame(spark, rows)
    runs = [lm_score.score_documents(d, head_words=h, by_word=w).collect()
            for d, h, w in [(docs.coalesce(1), lm_score.HEAD, False), (docs.repartition(7, "text"), lm_score.HEAD, False), (docs.repartition(40), 5, True)]]
    texts = [sorted((str(r["id"]), r["n_bytes"], round(r["score"], 8), round(r["base_score"], 8), r["n_known"]) for r in x) for x in runs]
    assert texts[0] == texts[1]
    assert all(a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-6 and a[4] == b[4] for a, b in zip(texts[0], texts[2]))


def test_head_and_join_agree(spark):
    rows = [(k, prose(k % 90, 60)) for k in range(150)]
    a, b = ({r["id"]: r["score"] for r in lm_score.score_documents(frame(spark, rows), head_words=h).collect()} for h in (lm_score.HEAD, 3))
    assert all(abs(a[k] - b[k]) < 1e-6 for k in a)


def chunks_by_hand(rows):
    """(id, chunk number) -> (n, m, hit) from counts over the other training documents."""
    seqs = {i: [x.tolist() for x in lm_score.chunk_ids(lm_score._hashed((t or "").encode()))[1:]] for i, t in rows}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in seqs}
    pairs = [(c, x, i, k + 1) for i, (h, before) in seqs.items() for k, (c, x) in enumerate(zip(before[1:], h[1:]))]
    out = {}
    for c, x, i, k in pairs:
        m = Counter(y for d, y, j, q in pairs if d == c and not held[j] and (j, q) != (i, k))
        if m:
            top = max(m.values())
            out[i, k] = (sum(m.values()), top, m[x] == top, list(m.values()).count(top))
    return out


def test_chunk_predictions(spark):
    rows = [(k, " ".join(prose(300 + (k * j) % 7, 25) for j in range(1, 5))) for k in range(40)]
    units = lm_score._units(frame(spark, rows), "doc_id", "text")
    none = spark.sparkContext.broadcast((np.empty(0, np.uint64), np.empty(0), np.empty(0)))
    names = {r["unit"]: r["doc_id"] for r in frame(spark, rows).select("doc_id", F.xxhash64(F.col("doc_id").cast("string"), "text").alias("unit")).collect()}
    got = {(names[r["unit"]], r["i"]): r for r in lm_score.compare_chunks(lm_score.chunk_rows(units, none)).collect()}
    want = chunks_by_hand(rows)
    assert got.keys() == want.keys()
    for k, (n, m, best, ties) in want.items():
        assert (got[k]["n"], got[k]["m"]) == (n, m)
        assert got[k]["hit"] == best if ties == 1 else got[k]["hit"] <= best


def test_held_out_copies_score_above_the_base(spark):
    rows = [(k, prose(k % 30, 200)) for k in range(150)] + [(200 + k, prose(500 + k, 100)) for k in range(60)]
    out = [r for r in lm_score.score_documents(frame(spark, rows)).collect() if r["held_out"]]
    copies = [r for r in out if r["id"] < 150]
    assert len(copies) > 10 and all(r["score"] > r["base_score"] / 2 for r in copies)


def test_score_edges(spark):
    assert lm_score.score_documents(empty(spark)).count() == 0
    held = next(k for k in range(99) if zlib.crc32(str(k).encode()) % 7 == 2)
    only = lm_score.score_documents(frame(spark, [(held, "some words")])).first()
    assert only["held_out"] and only["n_known"] == 0 and only["train_tokens"] == 0
    out = lm_score.score_documents(frame(spark, [(None, None), (1, "a b"), (1, "a b")])).collect()
    assert len(out) == 3 and {r["n_tokens"] for r in out} == {1, 3}


# ---- pipeline ----

def test_pipeline_stages(spark):
    """Every stage against plain Python on what its predecessor kept."""
    from tests.llm.test_dedup import exact_by_hand, near_by_hand
    from tests.llm.test_mix_shard_pack import targets_by_hand
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    before = docs
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "near dedup", "source mixing", "packing"]

    def step(name):
        nonlocal before
        out = stages[name](spark, before, SMALL)
        if name != "packing":
            assert out.columns == docs.columns
        rows = out.collect()
        was, before = [(r["doc_id"], r["text"]) for r in before.collect()], out
        return was, rows

    was, rows = step("quality classifier")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in rows}
    assert all(i in kept for i, _ in was if labels.get(i) == 1)
    assert len(kept) < len(was)
    was, rows = step("exact dedup")
    assert sorted(r["doc_id"] for r in rows) == sorted(x[0] for x in exact_by_hand(was) if x[3])
    was, rows = step("near dedup")
    assert sorted(r["doc_id"] for r in rows) == sorted(set(near_by_hand(was).values()))
    was, rows = step("source mixing")
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    words = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t in was}
    sizes, taken = Counter(), Counter()
    for i, _ in was:
        sizes[source[i]] += words[i]
    for r in rows:
        taken[r["source"]] += words[r["doc_id"]]
    want = targets_by_hand(sizes)
    assert all(abs(taken[s] - want[s]) <= max(words.values()) / 2 + 1 for s in sizes)
    was, rows = step("packing")
    pieces = Counter(r["doc_id"] for r in rows if r["piece"] == 0)
    assert pieces == Counter(i for i, _ in was)


CLASHING = ["__id", "__sha", "__n", "__t", "__lang", "__loss", "__limit", "__own", "__own_t", "__text", "__copy", "__digest", "row", "id", "t",
            "k_id", "k_epochs", "loss", "rejected", "digest", "copies", "Weird `name`.x"]


@pytest.mark.parametrize("rows", [[], [(None, None)], "edges"])
def test_pipeline_on_odd_tables(spark, monkeypatch, rows):
    """Empty tables, rows without ids or texts, repeated rows, and columns named like the operators' own."""
    from pyspark.sql import functions as F
    if rows == "edges":
        rows = [(i, t) for i, t in edge_rows() if t is None or len(t) < 9000]
        rows += [(None, prose(77, 80)), (None, prose(78, 80)), (None, prose(77, 80)), (13, prose(79, 70))]
    docs = frame(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    docs = docs.select("*", *[F.lit(k).alias(c) for k, c in enumerate(CLASHING)])
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    monkeypatch.setattr(corpus_pipeline, "read_table", lambda s, d, name: labels if name == "labels" else docs)
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, before, SMALL)
        assert out.columns == docs.columns
        had = {(r["doc_id"], r["text"]) for r in before.collect()}
        rest = out.collect()
        assert {(r["doc_id"], r["text"]) for r in rest} <= had
        assert all([r[c] for c in CLASHING] == list(range(len(CLASHING))) for r in rest)
        if name in ("exact dedup", "near dedup"):
            assert len(rest) == len({(r["doc_id"], r["text"]) for r in rest})
            kept = {(r["doc_id"], r["text"]) for r in rest}
            unlike = [(None, prose(77, 80)), (None, prose(78, 80)), (13, prose(79, 70)), (13, prose(5, 60))]
            assert not rows or len(rows) == 1 or set(unlike) <= kept
        before = out
    pieces = corpus_pipeline.run(spark, SMALL).collect()
    assert bool(pieces) == (len(rows) > 1)      # a NULL text has no words, so its source takes none
    assert Counter((r["doc_id"]) for r in pieces if r["piece"] == 0) == Counter(r["doc_id"] for r in before.collect())


def test_registered_queries():
    import __spark_entry__ as E
    assert {n: E.queries()[n] for n in queries.QUERIES} == queries.QUERIES and E.queries()["pipeline"] is corpus_pipeline.run
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_oracles(spark, duck, name):
    got = queries.QUERIES[name](spark, SMALL)
    res = duck.execute(queries.ORACLE[name])
    names = [d[0] for d in res.description]
    assert sorted(map(str, got.select(*names).collect())) and sorted(map(tuple, got.select(*names).collect())) == sorted(res.fetchall())
