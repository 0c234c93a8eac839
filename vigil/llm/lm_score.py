"""Language-model scores of documents: learned from all training documents, given to all documents.

The text is a sequence of words (ASCII lower-cased) and an end.  Every token is
coded bit by bit, each bit predicted by mixing what contexts across the words
before say in the whole training part (token_mixing).  The codes are those of
the HEAD most frequent words, the end, and an escape for all other words.  The
escape is followed by the word: one with a training count by its discounted
count among such words; what the discount leaves goes to unknown words, spelled
by mixing bit predictions of several contexts within the word (context_mixing).
Above the tokens stand content-defined chunks of words: where training text went
on after the same chunk, a bit says whether this text goes on likewise, with a
probability refined by how often such predictions held; if so, it stands for
the chunk's tokens.

Counts, contexts and spellings come from the whole training part by shuffles.
Only tables of fixed size reach every task: codes and counts of contexts, the
spelling mixer, and the reliability of chunk predictions.  All other words meet
their counts in a join.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm import context_mixing, token_mixing
from vigil.llm.common import collected, mix64, read_table, saved, text_of, word_hashes, word_hashes_of
from vigil.llm.context_mixing import ORDERS, SLOTS, Mixer
from vigil.llm.token_mixing import Codes, TokenMixer

HEAD = 1 << 18
#: A chunk ends at a word whose hash is divisible by this.
CHUNK_WORDS = 12
CONTEXT_WORDS = 4
#: Words that one spelling task learns from.
SPELL_TYPES = 400_000
#: Words of one online step.
STEP_WORDS = 4096
#: Counts up to which predictions are told apart.
CELLS = 6
#: Documents that a task looks at together.
STEP_DOCS = 300
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def split_words(raw: bytes) -> list[bytes]:
    return raw.translate(_LOWER).split()


def _hashed(raw: bytes) -> np.ndarray:
    return word_hashes(raw.translate(_LOWER))


def _hashed_all(raws: list[bytes]) -> list[np.ndarray]:
    return word_hashes_of([r.translate(_LOWER) for r in raws])


def chunk_ids(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(chunk of every word, hash of every chunk, its context).

    The context is the chunk before, together with the one before that where
    the former has under CONTEXT_WORDS words, as a frequent word alone says
    little; 0 before the first chunk."""
    if not len(words):
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64)
    last = words % np.uint64(CHUNK_WORDS) == 0
    of = np.concatenate([[0], np.cumsum(last)[:-1]]).astype(np.int64)
    starts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
    place = np.arange(len(words)) - starts[of]
    h = mix64(np.add.reduceat(mix64(words + place.astype(np.uint64) * np.uint64(0xA24BAED4963EE407)), starts))
    before = np.concatenate([np.zeros(1, np.uint64), h[:-1]])
    earlier = np.concatenate([np.zeros(1, np.uint64), before[:-1]])
    short = np.concatenate([[False], np.diff(starts) < CONTEXT_WORDS])
    return of, h, np.where(short, mix64(before * np.uint64(0x9E3779B97F4A7C15) + earlier), before)


def _units(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(unit, held, raw): ``unit`` names the id and the text together."""
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return docs.select(F.xxhash64(key, text_of(text_col)).alias("unit"), (F.crc32(F.encode(key, "UTF-8")) % 7 == 2).alias("held"),
                       F.encode(text_of(text_col), "UTF-8").alias("raw"))


def vocabulary(units: DataFrame) -> DataFrame:
    """(wh, word, c): every word of any document, its hash and its count in the training part.

    Words are told apart by their bytes, so words of one hash are rows of their own."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 1000):
                some = pdf.iloc[at:at + 1000]
                trained: Counter[bytes] = Counter()
                for raw in some["raw"][~some["held"]]:
                    trained.update(split_words(raw))
                others = dict.fromkeys(w for raw in some["raw"][some["held"]] for w in split_words(raw) if w not in trained)
                words = [*trained, *others]
                yield pd.DataFrame({"wh": word_hashes(b" ".join(words)).view(np.int64), "word": words,
                                    "c": [*trained.values(), *[0] * len(others)]})

    return units.mapInPandas(run, "wh long, word binary, c long").groupBy("wh", "word").agg(F.sum("c").alias("c"))


def _steps(batches: Iterator[pd.DataFrame]) -> Iterator[list[bytes]]:
    """The words in lists of STEP_WORDS, wherever the batches end."""
    waiting: list[bytes] = []
    for pdf in batches:
        waiting += pdf["word"].tolist()
        while len(waiting) >= STEP_WORDS:
            yield waiting[:STEP_WORDS]
            waiting = waiting[STEP_WORDS:]
    if waiting:
        yield waiting


def fit_spelling(words: DataFrame, types: int) -> Mixer:
    """The mixer, from (wh, word, c): bit counts of all training words, weights and refinement learned on those
    that came once, which unknown words resemble; tables of fixed size.

    Words are dealt and ordered by hash before learning and the tasks' results are added exactly, so that the mixer
    depends on the words alone, not on how the table is partitioned."""
    tasks = max(1, -(-types // SPELL_TYPES))
    words = words.filter("c > 0")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(ORDERS), 2, SLOTS), np.int64)
        for pdf in batches:
            for at in range(0, len(pdf), 20_000):
                total += context_mixing.count_bits(pdf["word"].iloc[at:at + 20_000].tolist())
        flat = total.ravel()
        where = np.flatnonzero(flat)
        yield pd.DataFrame({"slot": where.astype(np.int32), "n": flat[where]})

    counts = np.zeros(len(ORDERS) * 2 * SLOTS, np.int64)
    got = collected(words.select("word").coalesce(tasks).mapInPandas(count, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")))
    counts[got["slot"]] = got["n"]
    counts = counts.reshape(len(ORDERS), 2, SLOTS)
    shared = words.sparkSession.sparkContext.broadcast(counts.astype(np.int32))

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = Mixer(shared.value)
        start = m.refined.copy()
        for some in _steps(batches):
            m.learn(some)
        n, places = m.bits.repeat(len(ORDERS) + 1), m.refined.ravel() - start.ravel()
        yield pd.DataFrame({"kind": "weight", "place": np.arange(m.weights.size), "value": m.weights.ravel() * n, "n": n})
        yield pd.DataFrame({"kind": "refined", "place": np.arange(places.size), "value": places, "n": 0.0})

    exact = [F.sum(F.col(x).cast("decimal(28,10)")).cast("double").alias(x) for x in ("value", "n")]
    rare = words.filter("c = 1").select("wh", "word").repartition(tasks, "wh").sortWithinPartitions("wh", "word")
    learned = collected(rare.mapInPandas(learn, "kind string, place int, value double, n double").groupBy("kind", "place").agg(*exact))
    mixer = Mixer(counts)
    w = learned[(learned["kind"] == "weight") & (learned["n"] > 0)]
    mixer.weights.reshape(-1)[w["place"].to_numpy()] = (w["value"] / w["n"]).to_numpy()
    r = learned[learned["kind"] == "refined"]
    mixer.refined.reshape(-1)[r["place"].to_numpy()] += r["value"].to_numpy()
    return mixer


class Finder:
    """Places of hashes in a sorted array of different hashes, by their top bits where these are one hash's own."""

    BITS = 20

    def __init__(self, keys: np.ndarray):
        top = (keys >> np.uint64(64 - self.BITS)).astype(np.int64)
        self.keys, self.place = keys, np.zeros(1 << self.BITS, np.int32)
        self.place[top] = np.arange(len(keys))
        self.shared = np.bincount(top, minlength=1 << self.BITS) > 1

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, whether it is there) of every hash."""
        if not len(self.keys):
            return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
        top = (wanted >> np.uint64(64 - self.BITS)).astype(np.int64)
        place = self.place[top].astype(np.int64)
        there = self.keys[place] == wanted
        again = np.flatnonzero(~there & self.shared[top])
        if len(again):
            place[again] = np.minimum(np.searchsorted(self.keys, wanted[again]), len(self.keys) - 1)
            there[again] = self.keys[place[again]] == wanted[again]
        return place, there


class Tokens:
    """The tokens of several texts, each text's words and its end."""

    def __init__(self, raws: list[bytes], finder: Finder):
        self.words = _hashed_all(raws)
        n = np.array([len(w) + 1 for w in self.words])
        ends = np.cumsum(n) - 1
        self.of, self.is_word = np.repeat(np.arange(len(n)), n), np.ones(int(n.sum()), bool)
        self.is_word[ends] = False
        self.wh = np.zeros(len(self.is_word), np.uint64)
        self.wh[self.is_word] = np.concatenate(self.words)
        self.n, self.starts = n, ends - n + 1
        place, there = finder.find(self.wh)
        self.there = there & self.is_word
        self.leaf = np.where(self.there, place, len(finder.keys) + ~self.is_word)    # a word, the escape, the end
        self.before = token_mixing.contexts(self.wh, self.starts)


def _some(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for at in range(0, batch.num_rows, STEP_DOCS):
            yield {k: v for k, v in zip(batch.schema.names, batch.slice(at, STEP_DOCS).columns)}


def token_counts(units: DataFrame, codes) -> np.ndarray:
    """(orders, 2 * slots): counts of all training tokens' bits in their contexts, added up block by block."""
    size, block = 2 * token_mixing.SLOTS, token_mixing.BLOCK

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, finder = np.zeros((token_mixing.ORDERS, size), np.int64), Finder(codes.value.wh)
        for some in _some(batches):
            t = Tokens(some["raw"].to_pylist(), finder)
            token_mixing.count_bits(codes.value, t.leaf, t.before, total)
        total = total.reshape(-1, block)
        used = np.flatnonzero(total.any(axis=1))
        for at in range(0, len(used), 64):
            yield pa.RecordBatch.from_arrays([pa.array(used[at:at + 64].astype(np.int32)), pa.array([r.tobytes() for r in total[used[at:at + 64]]], pa.binary())],
                                             ["block", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch["block"].to_pylist(), batch["counts"].to_pylist()):
                total[k] = total.get(k, 0) + np.frombuffer(raw, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], ["block", "counts"])

    parts = units.filter("not held").select("raw").mapInArrow(count, "block int, counts binary")
    got = collected(parts.repartition("block").mapInArrow(add, "block int, counts binary"))
    out = np.zeros((token_mixing.ORDERS * size // block, block), np.int64)
    for k, raw in zip(got["block"], got["counts"]):
        out[k] = np.frombuffer(raw, np.int64)
    return out.reshape(token_mixing.ORDERS, size)


def token_weights(units: DataFrame, model) -> TokenMixer:
    """The mixer with weights from all training documents, each token's own occurrence not counted."""
    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixer, total = model.value, np.zeros((token_mixing.DEPTHS, (token_mixing.ORDERS + 1) * (token_mixing.ORDERS + 2)))
        finder = Finder(mixer.codes.wh)
        for some in _some(batches):
            t = Tokens(some["raw"].to_pylist(), finder)
            mixer.slopes(t.leaf, t.before, total)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.ravel())], ["place", "value"])

    got = collected(units.filter("not held").select("raw").mapInArrow(learn, "place int, value double").groupBy("place").agg(F.sum("value").alias("value")))
    total = np.zeros(token_mixing.DEPTHS * (token_mixing.ORDERS + 1) * (token_mixing.ORDERS + 2))
    total[got["place"]] = got["value"]
    return model.value.moved(total.reshape(token_mixing.DEPTHS, -1))


def text_rows(units: DataFrame, head, model=None, with_word: bool = False) -> DataFrame:
    """Three kinds of rows.  Per document its totals over head words and, as ``coded``, the log10 of all its tokens'
    codes (wh and context NULL); per other word and chunk its hash and, ``with_word``, the word (context NULL); per
    chunk but the first its context, hash and tokens' log10 (wh NULL).  Without a ``model`` nothing is coded."""
    names, kinds = list(_COLUMNS), [_ARROW[k] for k in _COLUMNS.values()]

    def batch_of(n: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.nulls(n, kind) if name not in columns else pa.array(columns[name], kind)
                                           for name, kind in zip(names, kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, base, in_head = head.value
        finder = Finder(keys)
        for some in _some(batches):
            raws, units_, held = some["raw"].to_pylist(), some["unit"].to_numpy(), some["held"].to_numpy(zero_copy_only=False)
            t = Tokens(raws, finder)
            score = np.zeros(len(t.leaf))
            for own in (False, True) if model is not None else ():
                mine = np.flatnonzero(held[t.of] != own)
                score[mine] = model.value.log10(t.leaf[mine], [b[mine] for b in t.before], own)
            known = t.there.copy()
            known[t.there] = in_head[t.leaf[t.there]]
            total = lambda x, of=t.of, n=len(raws): np.bincount(of, weights=x, minlength=n)
            bases = np.zeros(len(t.leaf))
            bases[known] = base[t.leaf[known]]
            yield batch_of(len(raws), unit=units_, held=held, n_tokens=t.n, known=total(known).astype(np.int64), base=total(bases), coded=total(score))
            chunk, first, parts = np.zeros(len(t.leaf), np.int32), 0, []
            for k, words in enumerate(t.words):
                of, h, before = chunk_ids(words)
                chunk[first:first + len(of)] = of
                if len(h) > 1:
                    coded = np.bincount(of, weights=score[first:first + len(of)], minlength=len(h))
                    parts.append((before[1:], h[1:], np.full(len(h) - 1, k), np.arange(1, len(h)), coded[1:]))
                first += t.n[k]
            rest = np.flatnonzero(t.is_word & ~known)
            if len(rest):
                words = {}
                if with_word:
                    all_words = [w for r in raws for w in (*split_words(r), b"")]
                    words["word"] = [all_words[k] for k in rest]
                yield batch_of(len(rest), unit=units_[t.of[rest]], wh=t.wh[rest].view(np.int64), i=chunk[rest], **words)
            if parts:
                context, h, doc, i, coded = map(np.concatenate, zip(*parts))
                yield batch_of(len(h), unit=units_[doc], held=held[doc], context=context.view(np.int64), chunk=h.view(np.int64), i=i, coded=coded)

    return units.select("unit", "held", "raw").mapInArrow(run, ", ".join(f"{c} {k}" for c, k in _COLUMNS.items()))


_COLUMNS = {"unit": "long", "held": "boolean", "wh": "long", "word": "binary", "context": "long", "chunk": "long", "i": "int", "n_tokens": "long",
            "known": "long", "base": "double", "coded": "double"}
_ARROW = {"long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(), "int": pa.int32(), "double": pa.float64()}


def chunks_of(rows: DataFrame) -> DataFrame:
    return rows.filter("context is not null").select("context", "chunk", "unit", "i", "held", "coded")


def chunk_rows(units: DataFrame, head) -> DataFrame:
    """(context, chunk, unit, i, held, coded): the chunks of every document but its first, without a model."""
    return chunks_of(text_rows(units, head))


def compare_chunks(chunks: DataFrame, stored: bool = False) -> DataFrame:
    """(unit, i, held, coded, n, m, hit): chunks whose context came in other training text ``n`` times, ``m`` of them
    with its most frequent continuation (of equally frequent ones the larger hash), which this chunk is when ``hit``;
    a training chunk does not count itself.

    Counts per (context, chunk) and then per context are partial aggregates, one row per context meets the rows in a
    plain join, which adaptive execution splits; no task holds or reads all rows of a frequent context.  Without
    itself a training chunk that is the best continuation is beaten by an equally frequent one and by no other, so
    the best needs only to know whether it is ``tied``.  ``stored``: the rows are read from a table already.
    """
    rows = chunks if stored else saved(chunks, "chunks")
    pairs = rows.groupBy("context", "chunk").agg(F.sum((~F.col("held")).cast("long")).alias("m"), F.count("*").alias("rows"))
    top = (pairs.groupBy("context").agg(F.sum("m").alias("all"), F.sum("rows").alias("rows"), F.max(F.struct("m", "chunk")).alias("best"),
                                        F.min(F.struct((-F.col("m")).alias("fewest"), "chunk")).alias("lowest"))
           .filter("all > 0 and rows > 1")
           .select("context", "all", F.col("best.chunk").alias("best"), F.col("best.m").alias("most"),
                   (F.col("best.chunk") != F.col("lowest.chunk")).alias("tied")))
    top = saved(top, "contexts")         # adaptive execution splits a join of two plain shuffles only
    is_best = F.col("chunk") == F.col("best")
    own = ~F.col("held") & is_best
    return (rows.join(top, "context")
            .select("unit", "i", "held", "coded", (F.col("all") - (~F.col("held")).cast("long")).alias("n"),
                    (F.col("most") - (own & ~F.col("tied")).cast("long")).alias("m"), (is_best & ~(own & F.col("tied"))).alias("hit"))
            .filter("n > 0 and m > 0"))


def frequent_from(words: DataFrame, *mosts: int) -> list[int | None]:
    """For each number of words the least step of counts that at most so many words reach; None if the first step has
    more.  The steps tell counts apart to 1/16 of a factor of two, so a table of under 1,100 rows decides."""
    sizes = words.filter("c > 1").groupBy(count_step().alias("step")).agg(F.count("*").alias("n")).collect()
    out = []
    for most in mosts:
        least, n = None, 0
        for r in sorted(sizes, key=lambda r: -r["step"]):
            n += r["n"]
            if n > most:
                break
            least = r["step"]
        out.append(least)
    return out


def count_step():
    return F.floor(F.log2("c") * 16).cast("int")


def _reaches(least: int | None):
    return F.lit(False) if least is None else (F.col("c") > 1) & (count_step() >= least)


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", head_words: int = HEAD,
                    by_word: bool = False) -> DataFrame:
    """One row per input row: (id, held_out, n_tokens, n_known, train_tokens, n_bytes, base_score, score, bits_per_byte).

    Documents whose crc32(id as text) mod 7 is 2 are held out, the others are
    learned from; a training document is scored by the chunks of the others.
    NULL texts are empty (one token, the end); a NULL id is the text ''.
    Repeated rows are documents of their own with equal scores.  With no
    training document every word is unknown.  Up to ``head_words``, at most HEAD,
    words meet their counts in the tasks, others in a join, by their
    hash; where two words share one (or with ``by_word``), by hash and word.
    The result does not depend on the order or the partitions of the rows.
    """
    units = _units(docs, id_col, text_col)
    words = saved(vocabulary(units), "words")
    shared = words.groupBy("wh").agg(F.count("*").alias("words")).filter("words > 1").select("wh")
    by_word = by_word or not shared.isEmpty()
    key = ["wh", "word"] if by_word else ["wh"]
    s = words.agg(F.sum("c").alias("n"), F.count(F.when(F.col("c") > 0, 1)).alias("v"), F.count(F.when(F.col("c") == 1, 1)).alias("n1"),
                  F.count(F.when(F.col("c") == 2, 1)).alias("n2")).first()
    train_docs = units.filter("not held").count()
    total, types = (s["n"] or 0) + train_docs, s["v"] + (train_docs > 0)
    base_unit = total + types + 1
    base_of = lambda c: F.log10((c + 1) / F.lit(float(base_unit)))
    # Words that share their hash have no code and are not in the head.
    alone = words.join(shared, "wh", "left_anti") if by_word else words
    least, least_head = frequent_from(alone, HEAD, min(head_words, HEAD))
    top = collected(alone.filter(_reaches(least)).select("wh", "c", F.coalesce(_reaches(least_head), F.lit(False)).alias("head")))
    top["wh"] = top["wh"].to_numpy().view(np.uint64)
    top = top.sort_values("wh")
    wh, c = top["wh"].to_numpy(), top["c"].to_numpy()
    rare, rare_types = (s["n"] or 0) - int(c.sum()), s["v"] - len(c)
    discount = min(0.9, max(0.1, s["n1"] / (s["n1"] + 2 * s["n2"]))) if s["n1"] else 0.5
    left = discount * rare_types / rare if rare else 1.0
    context = docs.sparkSession.sparkContext
    codes = Codes(wh, c, rare, train_docs)
    counted = TokenMixer(codes, token_counts(units, context.broadcast(codes)))
    model = context.broadcast(token_weights(units, context.broadcast(counted)))
    head = context.broadcast((wh, np.log10((c + 1.0) / base_unit), top["head"].to_numpy(dtype=bool)))
    mixer = fit_spelling(words, s["v"])

    def spell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 20_000):
                some = pdf.iloc[at:at + 20_000]
                yield pd.DataFrame({"wh": some["wh"], "word": some["word"], "spelled": mixer.log10(some["word"].tolist()) + np.log10(left)})

    unknown = words.filter("c = 0").select("wh", "word").mapInPandas(spell, "wh long, word binary, spelled double")
    seen = words.filter("c > 0")
    has_code = _reaches(least)
    if by_word:
        seen = seen.join(shared.withColumn("twin", F.lit(True)), "wh", "left")
        has_code = has_code & F.col("twin").isNull()
    lexicon = seen.select(*key, F.lit(True).alias("in_training"), base_of(F.col("c")).alias("w_base"),
                          F.when(has_code, 0.0).otherwise(F.log10((F.col("c") - discount) / F.lit(float(max(rare, 1))))).alias("w_score")) \
        .unionByName(unknown.select(*key, F.lit(False).alias("in_training"), F.lit(-np.log10(base_unit)).alias("w_base"), F.col("spelled").alias("w_score")))

    rows = saved(text_rows(units, head, model, by_word), "tokens")
    predicted = saved(compare_chunks(chunks_of(rows), stored=True), "predicted")
    cell = [F.least(F.floor(F.log2(x)), F.lit(CELLS)).cast("int") for x in (F.col("n"), F.col("m"))] + [(F.col("n") == F.col("m")).cast("int")]
    cells = predicted.withColumns(dict(zip(["cn", "cm", "ce"], cell)))
    # How often predictions of a kind held in training; at most 2 x (CELLS + 1)^2 kinds.
    held_true = cells.filter("not held").groupBy("cn", "cm", "ce").agg(((F.sum(F.col("hit").cast("int")) + 0.5) / (F.count("*") + 1)).alias("p"))
    p = F.coalesce(F.col("p"), F.lit(0.5))
    chunk_part = (cells.join(F.broadcast(held_true), ["cn", "cm", "ce"], "left")
                  .groupBy("unit").agg(F.sum(F.log10(F.when(F.col("hit"), p).otherwise(1 - p))).alias("bits"),
                                       F.sum(F.when(F.col("hit"), F.col("coded")).otherwise(0.0)).alias("saved"),
                                       F.collect_list(F.when(F.col("hit"), F.col("i"))).alias("hits")))
    tail = F.col("wh").isNotNull()
    parts = (rows.filter("context is null").join(lexicon, key, "left")
             .groupBy("unit").agg(F.sum((~tail).cast("int")).alias("rows"), F.max("held").alias("held"), F.sum("n_tokens").alias("n_tokens"),
                                  (F.coalesce(F.sum("known"), F.lit(0)) + F.sum(F.when(F.col("in_training"), 1).otherwise(0))).alias("known"),
                                  (F.sum("base") + F.sum(F.coalesce("w_base", F.lit(0.0)))).alias("base"),
                                  (F.sum("coded") + F.sum(F.coalesce("w_score", F.lit(0.0)))).alias("score"),
                                  F.collect_list(F.when(tail, F.struct("i", "w_score"))).alias("tails")))
    # Rows that repeat an id and a text are one unit here: sums are over `rows` equal documents.
    both = parts.join(chunk_part, "unit", "left")
    gone = F.aggregate(F.filter("tails", lambda x: F.array_contains(F.coalesce("hits", F.array().cast("array<int>")), x["i"])), F.lit(0.0),
                       lambda a, x: a + x["w_score"])
    end = np.log10((train_docs + 1) / base_unit)
    done = both.select("unit", (F.col("n_tokens") / F.col("rows")).cast("long").alias("n_tokens"),
                       ((F.col("known") / F.col("rows")).cast("long") + F.lit(int(train_docs > 0))).alias("n_known"),
                       (F.col("base") / F.col("rows") + float(end)).alias("base_score"),
                       ((F.col("score") - F.coalesce("saved", F.lit(0.0)) - gone + F.coalesce("bits", F.lit(0.0))) / F.col("rows")).alias("score"))
    name = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    ids = docs.select(F.col(id_col).alias("id"), F.xxhash64(name, text_of(text_col)).alias("unit"), F.octet_length(text_of(text_col)).cast("long").alias("n_bytes"),
                      (F.crc32(F.encode(name, "UTF-8")) % 7 == 2).alias("held_out"))
    return ids.join(done, "unit").select("id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "n_bytes", "base_score",
                                         "score", F.try_divide(-F.col("score") * float(np.log2(10)), F.col("n_bytes")).alias("bits_per_byte"))


def query(spark, sf_dir: str) -> DataFrame:
    """op8: scores of the whole ``documents`` table."""
    return score_documents(read_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
