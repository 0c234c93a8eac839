"""Best-fit packing of tokenised documents into fixed-length sequences.

Which lengths share a sequence depends only on how many pieces there are of
each length, so the packing is planned on the histogram of lengths (at most
one row per length) and returned as runs: "pieces number r to r+n of length L
go to these sequences at this offset".  Pieces are numbered within their length
by a distributed count and meet their run by that number.

The plan: pieces above one third of the capacity go at most two to a sequence,
each matched with the longest that still fits; the smaller ones, longest first,
go where the remaining gap is tightest.
"""

from __future__ import annotations

import base64
import os
import re
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigil.llm.common import read_table, saved, text_of

CAPACITY = 2048
#: Id put after every document.
END_ID = 0
#: Rows that one window task numbers within a length.
UNIT_ROWS = 4000
#: Words whose ids a worker remembers.
REMEMBERED = 200_000

# Characters beside which a blank may not split (NUL marks the cuts), and pairs that say the same of plain white space.
_ODD = re.compile("[\0\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_PAIRS = ("  ", " \n", "\n ", " \t", "\t ", " \r", "\r ")
# Letters beyond the Latin blocks.
_BEYOND = re.compile("[^\0-\u024f]")


class WordTokenizer(dict):
    """Token ids as little-endian 32-bit words, the same as the tokenizer gives for the whole text.

    ``ranks`` may name the same vocabulary as a rank file, which encodes whole
    texts faster; special tokens and letters beyond the Latin blocks always take
    the tokenizer.  Its own pre-split never crosses a single blank between two
    other characters, so such texts are cut there and the ids of a word are
    remembered (this is the memory: word -> ids).  Texts with other blanks or
    special tokens go in whole.
    """

    def __init__(self, path: str, ranks: str | None = None):
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.quick = None
        if ranks:
            import public_tokenizers
            import tiktoken
            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.quick = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def __missing__(self, word: str) -> bytes:
        if self._is_quick(word):
            ids = self.quick.encode_ordinary(word)
        else:
            ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        out = array("I", ids).tobytes()
        if len(word) < 100 and len(self) < REMEMBERED:  # full: the frequent words are in by then
            self[word] = out
        return out

    def _is_quick(self, text: str) -> bool:
        return self.quick is not None and not _BEYOND.search(text) and not any(s in text for s in self.special)

    def encode(self, text: str) -> bytes:
        if self._is_quick(text):
            return array("I", self.quick.encode_ordinary(text)).tobytes()
        if any(p in text for p in _PAIRS) or text[:1] == " " or text[-1:] == " " or _ODD.search(text) \
                or any(s in text for s in self.special):
            return self[text]
        return b"".join(map(self.__getitem__, text.replace(" ", "\0 ").split("\0")))


# Per worker process, by path.
_TOKENIZERS: dict[str, WordTokenizer] = {}


def tokenizer_for(path: str, ranks: str | None) -> WordTokenizer:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path, ranks)
    return _TOKENIZERS[path]


def cut_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
                  capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False,
                  ranks: str | None = None) -> DataFrame:
    """Pieces (id, piece, start, length, ids_crc32[, ids]): ids of the text and then ``end_id``, cut only
    above ``capacity``; all pieces but the first are full."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t, end = tokenizer_for(tokenizer, ranks), np.array([end_id], "<u4").tobytes()
        for pdf in batches:
            rows = []
            for key, text in zip(pdf["id"], pdf["text"]):
                ids = t.encode(text) + end
                total = len(ids) // 4
                first = total % capacity or capacity
                for piece, start in enumerate([0, *range(first, total, capacity)]):
                    part = ids[4 * start:4 * (start + (first if piece == 0 else capacity))]
                    rows.append((key, piece, start, len(part) // 4, zlib.crc32(part),
                                 *([np.frombuffer(part, "<u4").astype(np.int32)] if with_ids else ())))
            yield pd.DataFrame(rows, columns=["id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids])

    schema = f"id {id_type}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).mapInPandas(run, schema)


def plan_packing(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first, n, sequence, each, offset): pieces number ``first`` to ``first + n`` of ``length``
    go ``each`` to a sequence, from ``sequence`` on, the first of them at ``offset``."""
    left = defaultdict(int, counts)
    used: dict[int, int] = defaultdict(int)
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)   # gap -> (first sequence, sequences)
    runs, opened = [], 0

    def place(length: int, n: int, sequence: int, each: int, offset: int) -> None:
        runs.append((length, used[length], n, sequence, each, offset))
        used[length] += n
        left[length] -= n

    large = sorted((k for k in counts if 3 * k > capacity and counts[k]), reverse=True)
    for i, a in enumerate(large):
        partners = iter([b for b in large[i:] if a + b <= capacity])
        b = next(partners, None)
        while left[a]:
            while b is not None and left[b] < (2 if b == a else 1):
                b = next(partners, None)
            n = left[a] if b is None else left[a] // 2 if b == a else min(left[a], left[b])
            place(a, n, opened, 1, 0)
            if b is not None:
                place(b, n, opened, 1, a)
            gaps[capacity - a - (b or 0)].append((opened, n))
            opened += n
    for s in sorted((k for k in counts if 3 * k <= capacity and counts[k]), reverse=True):
        while left[s]:
            gap = min((g for g, those in gaps.items() if g >= s and those), default=None)
            if gap is None:
                gap, first, n = capacity, opened, -(-left[s] // (capacity // s))
                opened += n
            else:
                first, n = gaps[gap].pop()
            each = min(gap // s, left[s])
            some = min(n, left[s] // each)
            place(s, some * each, first, each, capacity - gap)
            gaps[gap - each * s].append((first, some))
            if n > some:
                gaps[gap].append((first + some, n - some))
    return runs


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
                   capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False,
                  ranks: str | None = None) -> DataFrame:
    """One row per piece: (id, piece, start, length, ids_crc32[, ids], sequence_id, offset).

    NULL texts are empty and still give the end id.  Only documents above
    ``capacity`` are cut.  Pieces lie in their sequence without gaps from
    offset 0.  Repeated rows are packed each; equal lengths are told apart by a
    hash of the piece, so reruns agree.  An empty table gives no rows.
    """
    pieces = saved(cut_documents(docs, tokenizer, id_col, text_col, capacity, end_id, with_ids, ranks), "pieces")
    sizes = pieces.groupBy("length").agg(F.count("*").alias("n"))

    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        runs = plan_packing(dict(zip(pdf["length"].tolist(), pdf["n"].tolist())), capacity)
        return pd.DataFrame(runs, columns=["length", "first", "n", "sequence", "each", "offset0"])

    # One group of at most `capacity` rows; the runs are a few times as many, whatever the corpus.
    runs = saved(sizes.groupBy(F.lit(1).alias("all")).applyInPandas(
        lambda pdf: plan(pdf), "length long, first long, n long, sequence long, each long, offset0 long"), "runs")
    # Pieces that repeat (of rows that repeat an id and a text) are one counted row, in parts of at most UNIT_ROWS.
    same = pieces.groupBy(*pieces.columns).agg(F.count("*").alias("copies"))
    parts = same.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / UNIT_ROWS)))) \
        .withColumn("rows", F.least(F.lit(UNIT_ROWS), F.col("copies") - F.col("part") * UNIT_ROWS)).drop("copies")
    units = F.ceil(F.col("n") / UNIT_ROWS)
    spread = parts.join(F.broadcast(sizes), "length").withColumn("unit", F.pmod(F.xxhash64("id", "piece", "ids_crc32", "part"), units)).drop("n")
    earlier = Window.partitionBy("length").orderBy("unit").rowsBetween(Window.unboundedPreceding, -1)
    starts = (spread.groupBy("length", "unit").agg(F.sum("rows").alias("unit_rows"))
              .select("length", "unit", F.coalesce(F.sum("unit_rows").over(earlier), F.lit(0)).alias("unit_start")))
    within = Window.partitionBy("length", "unit").orderBy("id", "piece", "ids_crc32", "start", "part").rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("unit_start") + F.coalesce(F.sum("rows").over(within), F.lit(0))
    numbered = (spread.join(starts, ["length", "unit"]).withColumn("first", first)
                .withColumn("number", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("rows") - 1)))
                .drop("unit", "part", "rows", "unit_start", "first"))
    nth = F.col("p.number") - F.col("r.first")
    return (numbered.alias("p").join(F.broadcast(runs).alias("r"), (F.col("p.length") == F.col("r.length"))
                                     & (nth >= 0) & (nth < F.col("r.n")))
            .select("p.id", "p.piece", "p.start", "p.length", "p.ids_crc32", *["p.ids"] * with_ids,
                    (F.col("r.sequence") + F.floor(nth / F.col("r.each"))).cast("long").alias("sequence_id"),
                    (F.col("r.offset0") + nth % F.col("r.each") * F.col("p.length")).cast("long").alias("offset")))


def public_tokenizer(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def query(spark, sf_dir: str) -> DataFrame:
    """op4: packing of the whole ``documents`` table."""
    return pack_documents(read_table(spark, sf_dir, "documents"), public_tokenizer(),
                          ranks=public_tokenizer("byte_bpe_50k.tiktoken")).withColumnRenamed("id", "doc_id")
