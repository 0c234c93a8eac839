"""Periodic runs of words: stretches that repeat a block of words three times or more, found through Lyndon roots.

Each text is one row and is looked at by itself, so nothing is shuffled.  Words
become numbers; stretches that could hold a run go through Baier's grouping
under both orders, and the roots that follow themselves are extended into runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import WHITE, read_table, text_of
from vigil.llm.lyndon import runs

LEAST = 24
POWERS = 3
#: Texts handed back to Spark at once.
TEXTS_AT_ONCE = 256

_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def run_list(words: list, least: int = LEAST, powers: int = POWERS) -> list[tuple[int, int, int]]:
    """Runs (start, length, period) of a list of words."""
    if len(words) < least:
        return []
    number: dict = {}
    return runs(np.array([number.setdefault(w, len(number)) for w in words], np.int64), least, powers)


def without_repeats(words: list, found: list[tuple[int, int, int]]) -> list:
    """The words that no run holds after its first period."""
    if not found:
        return words
    dropped = np.zeros(len(words) + 1, np.int64)
    for start, length, period in found:
        dropped[start + period] += 1
        dropped[start + length] -= 1
    inside = np.cumsum(dropped[:-1])
    return [words[i] for i in np.flatnonzero(inside == 0).tolist()]


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """One row per input row: (id, n_words, runs, collapsed).

    Words are runs without ASCII white space.  ``runs`` has (start, length,
    period) by start and then period: every stretch of at least ``least`` words
    and three smallest periods that no neighbour extends.  ``collapsed`` are the
    words that no run holds after its first period, joined by one space.  NULL
    and white texts have no words, no runs and an empty ``collapsed``; NULL and
    repeated ids and repeated rows are rows like any other; other columns are
    not looked at; an empty table gives no rows.
    """
    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, TEXTS_AT_ONCE):
                batch = whole.slice(at, TEXTS_AT_ONCE)
                counts, lists, texts = [], [], []
                for raw in batch.column(1).cast(pa.binary()):
                    words = raw.as_py().split()
                    found = run_list(words, least)
                    counts.append(len(words))
                    lists.append([{"start": s, "length": n, "period": p} for s, n, p in found])
                    texts.append(b" ".join(without_repeats(words, found)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(counts, pa.int64()), pa.array(lists, pa.list_(_RUN)), pa.array(texts, pa.binary())],
                    ["id", "n_words", "runs", "collapsed"])

    kind = docs.schema[id_col].dataType.simpleString()
    return (docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
            .mapInArrow(look, f"id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed binary")
            .withColumn("collapsed", F.decode("collapsed", "UTF-8")))


def strongest(found: Column) -> Column:
    """The run of the greatest length / period, compared exactly; the first of equals in (start, period) order."""
    above = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    return F.reduce(found, none, lambda best, r: F.when(above(best, r), r).otherwise(best))


def with_periodic_tails(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, text_col): about every tenth text, by CRC-32 of its id, repeats one block from some word to its end.

    With h the CRC-32 of the decimal id, g = h div 10 and n words, the text of an id with h mod 10 = 0 has word
    a + (i - a) mod p in place of every word i from a = g mod n on, p = 1 + (n - a) div (3 + g mod 8).  Other texts,
    texts without words and rows without an id stay as they are.
    """
    h = F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8"))
    g = F.floor(F.col("__h") / 10)
    words = F.filter(F.split(text_of(text_col), WHITE + "+"), lambda w: w != "")
    changed = F.transform("__words", lambda w, i: F.when(i < F.col("__a"), w).otherwise(
        F.element_at("__words", (F.col("__a") + (i - F.col("__a")) % F.col("__p") + 1).cast("int"))))
    marked = docs.select(F.col(id_col), text_of(text_col).alias(text_col), h.alias("__h"))
    chosen = (F.col("__h") % 10 == 0)
    told = (marked.withColumn("__words", F.when(chosen, words))
            .withColumn("__n", F.size("__words").cast("long"))
            .withColumn("__a", F.when(F.col("__n") > 0, g % F.col("__n")))
            .withColumn("__p", 1 + F.floor((F.col("__n") - F.col("__a")) / (3 + g % 8))))
    return told.select(id_col, F.when(F.col("__a").isNotNull(), F.array_join(changed, " ")).otherwise(F.col(text_col)).alias(text_col))


def digests(found: DataFrame) -> DataFrame:
    """Per row of ``periodic_runs``: the strongest run and SHA-256 digests of the runs and of the collapsed text."""
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))))
    return found.withColumn("best", strongest(F.col("runs"))).select(
        F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.encode(lines, "UTF-8"), 256).alias("runs_sha256"),
        F.sha2(F.encode("collapsed", "UTF-8"), 256).alias("collapsed_sha256"))


def query(spark, sf_dir: str) -> DataFrame:
    """op11: runs and collapsed texts of the whole ``documents`` table, every tenth text with a periodic tail."""
    return digests(periodic_runs(with_periodic_tails(read_table(spark, sf_dir, "documents"))))
