"""Quality classifier: interpolated modified Kneser-Ney over characters, trained on trusted text.

One model per language.  Text becomes a stream of symbols: capitals are one
symbol, digits another, a word equal to the word before it is one symbol
together with the white space between them, and every other character is its
own.  The n-grams of the trusted texts are counted, discounted and smoothed by
Spark, order by order, in joins on (language, context, symbol).  A document's
log loss is the sum over its n-grams: a model of at most MOST_BROADCAST rows
meets them as a broadcast table, a larger one in shuffled joins; both give the
same numbers.  A document is rejected when its loss is above a quantile of the
trusted documents of its language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.functions.ranks import exact_quantiles
from vigil.llm.common import collected, columns_of, read_table, saved, text_of, word_hashes

ORDER = 4
#: Bits of a symbol: a code point and the FIRST_OWN symbols before them.
BITS = 21
BEGIN, REPEAT, CAPITAL, DIGIT, FIRST_OWN = range(5)
#: Rows of a model, over all languages and orders, that are broadcast (24 bytes each); symbols that its keys tell apart.
MOST_BROADCAST = 1 << 20
MOST_SYMBOLS = (1 << 16) - 1
#: Share of the trusted documents of a language that lie under its limit.
QUANTILE = 0.998
#: Above the quantile by this much of the mean log loss, as trusted text is not all there is.
MARGIN = 0.15
#: A short text's log loss is drawn to the language's mean as if by so many symbols.
PRIOR = 150
#: A language with fewer trusted documents takes the model of all languages.
LEAST_DOCS = 100
ALL = "*"
#: Up to so many ids of trusted documents are broadcast to the texts; more meet them in a shuffled join.
MOST_IDS = 1 << 20
#: Documents whose n-grams a task counts together.
COUNT_AT_ONCE = 1000

def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def _symbol_table() -> np.ndarray:
    """Symbol of every code point."""
    table = np.arange(0x110000, dtype=np.int64) + FIRST_OWN
    for c in range(0x3000):
        if chr(c).isupper():
            table[c] = CAPITAL
        elif chr(c).isdigit():
            table[c] = DIGIT
    return table


_SYMBOLS: list[np.ndarray] = []


def symbols_of(text: str) -> np.ndarray:
    """The symbols of a text; a word equal to the one before it is the symbol REPEAT."""
    if not _SYMBOLS:
        _SYMBOLS.append(_symbol_table())
    cp = code_points(text)
    out = _SYMBOLS[0][cp]
    if not len(cp):
        return out
    solid = (cp != 32) & ((cp < 9) | (cp > 13))
    edge = np.flatnonzero(np.diff(solid, prepend=False, append=False))
    starts, ends = edge[0::2], edge[1::2]
    if len(starts) > 1:
        w = word_hashes(text.encode("utf-8", "surrogatepass"))
        again = np.flatnonzero(w[1:] == w[:-1]) + 1
        if len(again):
            out[ends[again - 1]] = REPEAT   # in place of the white space before the word and the word
            level = np.zeros(len(cp) + 1, np.int32)
            np.add.at(level, ends[again - 1] + 1, 1)
            np.add.at(level, ends[again], -1)
            out = out[np.cumsum(level[:-1]) == 0]
    return out


def ngrams_of(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(context, symbol) of the n-gram that ends at each symbol, with BEGIN before the text; a context is its
    ORDER - 1 symbols of BITS bits, which fit into a long."""
    s = np.concatenate([np.full(ORDER - 1, BEGIN, np.int64), symbols])
    context = np.zeros(len(symbols), np.int64)
    for k in range(ORDER - 1):
        context = context << BITS | s[k:k + len(symbols)]
    return context, symbols


def _counted(context: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different n-grams and their counts."""
    at = np.lexsort((symbol, context))
    context, symbol = context[at], symbol[at]
    first = np.flatnonzero(np.concatenate([[True], (np.diff(context) != 0) | (np.diff(symbol) != 0)])[:len(at)])
    return context[first], symbol[first], np.diff(np.append(first, len(at)))


def _parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The batches in parts of COUNT_AT_ONCE documents."""
    for pdf in batches:
        for at in range(0, len(pdf), COUNT_AT_ONCE):
            yield pdf.iloc[at:at + COUNT_AT_ONCE]


def ngram_counts(trusted: DataFrame) -> DataFrame:
    """(lang, context, symbol, n) of the highest order, from (lang, text): of every language that is not NULL, and of
    all texts under ALL."""
    def run(batches):
        for some in _parts(batches):
            for lang, texts in some.groupby("lang", dropna=False)["text"]:
                context, symbol = map(np.concatenate, zip(*(ngrams_of(symbols_of(t)) for t in texts)))
                yield pd.DataFrame(dict(zip(["context", "symbol", "n"], _counted(context, symbol)))).assign(lang=lang if isinstance(lang, str) else None)

    counts = saved(trusted.mapInPandas(run, "lang string, context long, symbol long, n long")
                   .groupBy("lang", "context", "symbol").agg(F.sum("n").alias("n")), "ngrams")
    whole = counts.groupBy("context", "symbol").agg(F.sum("n").alias("n"))
    return counts.filter("lang is not null").unionByName(whole.withColumn("lang", F.lit(ALL)))


def kneser_ney(counts: DataFrame) -> DataFrame:
    """(lang, level, context, symbol, value): the interpolated modified Kneser-Ney model of ``counts``.

    With a symbol, value is log P(symbol | context) of an n-gram of ``level`` symbols that was seen; without, the log
    weight that the context leaves to the next lower level.  The highest level uses the counts, each lower one the
    number of different symbols before its n-gram; discounts per level come from the numbers of n-grams counted once
    to four times.  Below level 1 lie all symbols of the language and one more, for those not seen, alike (level 0).
    """
    levels = {ORDER: saved(counts, "level")}     # every table is saved, so that each plan has a few exchanges only
    for k in range(ORDER - 1, 0, -1):
        shorter = F.col("context").bitwiseAND(F.lit((1 << BITS * (k - 1)) - 1)).alias("context")
        levels[k] = saved(levels[k + 1].groupBy("lang", shorter, "symbol").agg(F.count("*").alias("n")), "level")
    uniform = saved(levels[1].groupBy("lang").agg((-F.log(F.count("*") + 1.0)).alias("value")), "uniform")
    model = [uniform.select("lang", F.lit(0).alias("level"), F.lit(0).cast("long").alias("context"), F.lit(None).cast("long").alias("symbol"), "value")]
    lower = None
    for k in range(1, ORDER + 1):
        of = levels[k].groupBy("lang").agg(*[F.greatest(F.count(F.when(F.col("n") == i, 1)), F.lit(1)).alias(f"n{i}") for i in (1, 2, 3, 4)])
        y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
        cut = [F.least(F.greatest(i - (i + 1) * y * F.col(f"n{i + 1}") / F.col(f"n{i}"), F.lit(0.05 * i)), F.lit(float(i))).alias(f"d{i}") for i in (1, 2, 3)]
        # One row per language that has a model of its own (LEAST_DOCS trusted documents), and one for ALL.
        rows = saved(levels[k].join(F.broadcast(of.select("lang", *cut)), "lang").select(
            "lang", "context", "symbol", "n", F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3")).alias("d")),
            "cut")
        contexts = saved(rows.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.sum("d").alias("left")), "contexts")
        shorter = F.col("context").bitwiseAND(F.lit((1 << BITS * max(k - 2, 0)) - 1))
        rows = rows.join(contexts, ["lang", "context"]).withColumn("shorter", shorter)
        if lower is None:
            rows = rows.join(F.broadcast(uniform.select("lang", F.exp("value").alias("p0"))), "lang")
        else:
            rows = rows.join(lower.select("lang", F.col("context").alias("shorter"), "symbol", F.col("p").alias("p0")), ["lang", "shorter", "symbol"])
        lower = saved(rows.select("lang", "context", "symbol", ((F.col("n") - F.col("d") + F.col("left") * F.col("p0")) / F.col("total")).alias("p")),
                      f"level-{k}")
        model += [lower.select("lang", F.lit(k).alias("level"), "context", "symbol", F.log("p").alias("value")),
                  contexts.select("lang", F.lit(k).alias("level"), "context", F.lit(None).cast("long").alias("symbol"),
                                  F.log(F.col("left") / F.col("total")).alias("value"))]
    out = model[0]
    for part in model[1:]:
        out = out.unionByName(part)
    return saved(out, "kneser-ney")


class Tables:
    """A model in sorted arrays: per language and level the n-grams and contexts of 16-bit symbol numbers."""

    def __init__(self, model: pd.DataFrame):
        seen = np.unique(model["symbol"].dropna().to_numpy().astype(np.int64))
        names = np.unique(np.append(seen, BEGIN))
        self.number = np.zeros(0x110000 + FIRST_OWN, np.uint16)      # 0: not seen
        self.number[names] = np.arange(1, len(names) + 1)
        self.of = {}
        for (lang, level), rows in model.groupby(["lang", "level"]):
            context, value = self._packed(rows["context"].to_numpy(np.int64), level - 1), rows["value"].to_numpy(np.float64)
            gram = rows["symbol"].notna().to_numpy()
            keys = context[gram] << np.uint64(16) | self.number[rows["symbol"].to_numpy()[gram].astype(np.int64)]
            at, to = np.argsort(keys), np.argsort(context[~gram])
            self.of[lang, level] = keys[at], value[gram][at], context[~gram][to], value[~gram][to]

    def _packed(self, context: np.ndarray, symbols: int) -> np.ndarray:
        out = np.zeros(len(context), np.uint64)
        for k in range(symbols - 1, -1, -1):
            out = out << np.uint64(16) | self.number[context >> (BITS * k) & ((1 << BITS) - 1)]
        return out

    def loss(self, lang: str, symbols: np.ndarray) -> float:
        """Negative log probability of the symbols."""
        s = np.concatenate([np.full(ORDER - 1, BEGIN, np.int64), symbols])
        ids, key = self.number[s].astype(np.uint64), np.zeros(len(symbols), np.uint64)
        for k in range(ORDER):
            key = key << np.uint64(16) | ids[k:k + len(symbols)]
        total = 0.0
        for level in range(ORDER, 0, -1):
            grams, logs, contexts, left = self.of[lang, level]
            if level < ORDER:
                key = key & np.uint64((1 << 16 * level) - 1)
            place = np.minimum(np.searchsorted(grams, key), len(grams) - 1)
            there = grams[place] == key
            total += logs[place[there]].sum()
            key = key[~there]
            if not len(key):
                return -total
            context = key >> np.uint64(16)
            place = np.minimum(np.searchsorted(contexts, context), len(contexts) - 1)
            there = contexts[place] == context
            total += left[place[there]].sum()
        return -(total + len(key) * self.of[lang, 0][3][0])


def tables_of(model: DataFrame, most: int = MOST_BROADCAST):
    """The model as broadcast ``Tables``; None if it is larger than ``most`` rows."""
    size = model.agg(F.count("*").alias("rows"), F.count_distinct("symbol").alias("symbols")).first()
    if size["rows"] > most or size["symbols"] >= MOST_SYMBOLS:
        return None
    return model.sparkSession.sparkContext.broadcast(Tables(collected(model)))


def with_loss(texts: DataFrame, model: DataFrame, shared) -> DataFrame:
    """``texts`` (lang, text and others, each lang in the model) with ``s``: struct(loss, n), the negative log
    probability of the text and its symbols; ``shared``: ``tables_of`` the model."""
    if shared is None:
        return _joined_loss(texts, model)

    @F.pandas_udf("loss double, n long")
    def score(langs: pd.Series, column: pd.Series) -> pd.DataFrame:
        loss, n = np.zeros(len(column)), np.zeros(len(column), np.int64)
        for i, (lang, text) in enumerate(zip(langs, column)):       # the symbols of one text at a time
            symbols = symbols_of(text)
            loss[i], n[i] = shared.value.loss(lang, symbols), len(symbols)
        return pd.DataFrame({"loss": loss, "n": n})

    return texts.withColumn("s", score("lang", "text"))


def _joined_loss(texts: DataFrame, model: DataFrame) -> DataFrame:
    """``with_loss`` by shuffled joins: the n-grams of different texts are counted per text, the different n-grams meet
    the model level by level, and their values return to the texts.  Frequent n-grams are one row per task before
    the shuffle; the join back is split by adaptive execution."""
    digest = F.md5(F.encode(F.concat("lang", F.lit("\0"), "text"), "UTF-8"))
    def count(batches):
        for some in _parts(batches):
            for key, lang, text in zip(some["digest"], some["lang"], some["text"]):
                yield pd.DataFrame(dict(zip(["context", "symbol", "n"], _counted(*ngrams_of(symbols_of(text)))))).assign(digest=key, lang=lang)

    distinct = texts.select(digest.alias("digest"), "lang", "text").dropDuplicates(["digest"])
    counts = saved(distinct.mapInPandas(count, "digest string, lang string, context long, symbol long, n long"), "text-ngrams")
    value = F.lit(0.0)
    grams = counts.select("lang", F.col("context").alias("whole"), "symbol").distinct().withColumn("open", F.lit(True)).withColumn("sum", value)
    for level in range(ORDER, 0, -1):
        mine = model.filter(F.col("level") == level)
        context = F.col("whole").bitwiseAND(F.lit((1 << BITS * (level - 1)) - 1))
        grams = (grams.withColumn("context", context)
                 .join(mine.filter("symbol is not null").select("lang", "context", "symbol", F.col("value").alias("log")), ["lang", "context", "symbol"], "left")
                 .join(mine.filter("symbol is null").select("lang", "context", F.col("value").alias("left")), ["lang", "context"], "left")
                 .select("lang", "whole", "symbol", (F.col("open") & F.col("log").isNull()).alias("open"),
                         (F.col("sum") + F.when(F.col("open"), F.coalesce("log", "left", F.lit(0.0))).otherwise(0.0)).alias("sum")))
    last = model.filter("level = 0").select("lang", F.col("value").alias("last"))
    grams = grams.join(F.broadcast(last), "lang").select("lang", F.col("whole").alias("context"), "symbol",
                                                         (F.col("sum") + F.when(F.col("open"), F.col("last")).otherwise(0.0)).alias("log"))
    losses = saved(counts.join(saved(grams, "ngram-values"), ["lang", "context", "symbol"]).groupBy("digest")
                   .agg(F.struct((-F.sum(F.col("n") * F.col("log"))).alias("loss"), F.sum("n").alias("n")).alias("s")), "text-losses")
    none = F.struct(F.lit(0.0).alias("loss"), F.lit(0).cast("long").alias("n"))
    return texts.withColumn("digest", digest).join(losses, "digest", "left").drop("digest").withColumn("s", F.coalesce("s", none))


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                   quantile: float = QUANTILE, margin: float = MARGIN, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """(row, loss, loss_limit, n, perplexity, rejected) per row of ``docs``, which is the struct ``row``.

    ``loss`` is the log loss per symbol, short texts drawn to their language's
    mean.  Trusted: all documents that ``labels`` (doc_id, quality) call quality
    1; counts, discounts, means and limits come from every one of them.  A
    document is rejected when its loss is above the limit.  A language without enough trusted text (NULL is one) takes
    the model and limit of all languages.  NULL and empty texts have perplexity
    1 and stay; without any trusted text the limit is NULL and everything stays.
    Repeated rows and rows without an id are scored each; an empty table gives
    no rows.
    """
    every_row = F.struct(*columns_of(docs)).alias("row")
    ids = labels.filter("quality = 1 and doc_id is not null").select(F.col("doc_id").alias("trusted_id"))
    if ids.count() <= MOST_IDS:
        ids = F.broadcast(ids)
    own = docs.select(F.col(id_col).alias("trusted_id"), F.col(lang_col).cast("string").alias("lang"), text_of(text_col).alias("text"))
    trusted = saved(own.join(ids, "trusted_id", "left_semi").filter("text <> ''").select("lang", "text"), "trusted")
    if trusted.isEmpty():
        none = F.lit(None).cast("double")
        return docs.select(every_row, none.alias("loss"), none.alias("loss_limit"), F.lit(None).cast("long").alias("n"),
                           none.alias("perplexity"), F.lit(False).alias("rejected"))
    large = [r["lang"] for r in trusted.filter("lang is not null").groupBy("lang").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_DOCS).collect()]
    # The model of all languages is made where a document takes it.
    others = not docs.filter(F.coalesce(~F.col(lang_col).cast("string").isin(large), F.lit(True))).isEmpty()
    every = trusted.filter(F.col("lang").isin(large))
    counts = ngram_counts(trusted.withColumn("lang", F.when(F.col("lang").isin(large), F.col("lang"))))
    if others or not large:
        every = every.union(trusted.withColumn("lang", F.lit(ALL)))
    else:
        counts = counts.filter(F.col("lang") != ALL)
    model = kneser_ney(counts)
    shared = tables_of(model, most_broadcast)
    fitted = saved(with_loss(every, model, shared).select("lang", "s.*"), "trusted-loss")
    means = fitted.groupBy("lang").agg((F.sum("loss") / F.sum("n")).alias("mean"))
    drawn = fitted.join(F.broadcast(means), "lang").select("lang", ((F.col("loss") + PRIOR * F.col("mean")) / (F.col("n") + PRIOR)).alias("drawn"))
    limits = (exact_quantiles(drawn, ["lang"], "drawn", [quantile]).join(means, "lang")
              .select("lang", "mean", (F.col("value_q") + margin * F.col("mean")).alias("limit")).collect())   # a row per language
    known = F.when(F.col(lang_col).isin(large), F.col(lang_col).cast("string")).otherwise(F.lit(ALL))
    by = {r["lang"]: r for r in limits}
    pick = {k: F.create_map(*[F.lit(x) for r in by.values() for x in (r["lang"], r[k])])[F.col("lang")] for k in ("mean", "limit")}
    scored = with_loss(docs.select(every_row, known.alias("lang"), text_of(text_col).alias("text")), model, shared).select("row", "lang", "s")
    loss, n = (F.col("s.loss") + PRIOR * pick["mean"]) / (F.col("s.n") + PRIOR), F.col("s.n")
    return scored.select("row", loss.alias("loss"), pick["limit"].alias("loss_limit"), n.alias("n"),
                         F.exp(F.coalesce(F.try_divide(F.col("s.loss"), n), F.lit(0.0))).alias("perplexity"),
                         F.coalesce((loss > pick["limit"]) & (n > 0), F.lit(False)).alias("rejected"))


def keep_good(docs: DataFrame, labels: DataFrame, **columns) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, every column as it was, whatever its name."""
    return quality_scores(docs, labels, **columns).filter("NOT rejected").select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    """op10: perplexity and decision for the whole ``documents`` table, trained on the trusted rows of ``labels``."""
    scored = quality_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return scored.select("row.doc_id", "row.lang", F.col("n").alias("n_symbols"), "perplexity", "loss", "loss_limit",
                         (~F.col("rejected")).alias("kept"))
