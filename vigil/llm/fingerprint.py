"""Order MinHash fingerprints.

A text's k-mers are numbered by occurrence, hashed, and dealt to BINS by their
hash.  In each bin the PICK smallest are selected, put back into text order and
hashed as a tuple: one entry of the signature.  Entries agree when both the
selected k-mers and their order do, so the share of equal entries falls with
edit distance, where plain MinHash only sees the set.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import mix64, read_table, saved, text_of
from vigil.llm.quality import code_points

KMER = 12
BINS = 64
PICK = 2
_EMPTY = np.uint16(0)


def kmer_hashes(cp: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of all k-mers of code points (the whole text when it is shorter), by doubling."""
    h, width = mix64(cp + np.uint64(1)), 1
    want = min(k, len(cp))
    while width * 2 <= want:
        h = mix64(h[:-width] * np.uint64(0x9E3779B97F4A7C15) + h[width:])
        width *= 2
    if width < want:
        h = mix64(h[:len(h) - (want - width)] * np.uint64(0xD1B54A32D192ED03) + h[want - width:])
    return h


def occurrences(h: np.ndarray) -> np.ndarray:
    """How often each value came before, in order."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.empty(0, np.int64)
    n = np.arange(len(s)) - np.repeat(first, np.diff(np.append(first, len(s))))
    out = np.empty(len(s), np.uint64)
    out[order] = n
    return out


def signature(cp: np.ndarray, k: int = KMER, bins: int = BINS, pick: int = PICK) -> np.ndarray:
    """``bins`` entries of 16 bits, never 0 unless the bin holds no k-mer; all 0 for an empty text."""
    out = np.zeros(bins, np.uint16)
    if not len(cp):
        return out
    h = kmer_hashes(cp, k)
    v = mix64(h + occurrences(h) * np.uint64(0xA24BAED4963EE407))
    bits = int(bins).bit_length() - 1
    low = v >> np.uint64(bits)
    where = np.arange(len(v))
    # Only small values can be picked: cut at 12 expected per bin, and take all if a bin then has too few.
    if len(v) > bins * 24:
        some = np.flatnonzero(low < np.uint64(int(2 ** (64 - bits) * (bins * 12 / len(v)))))
        if len(some) and np.bincount((v[some] & np.uint64(bins - 1)).astype(np.int64), minlength=bins).min() >= pick:
            v, low, where = v[some], low[some], some
    bin_of = (v & np.uint64(bins - 1)).astype(np.int64)
    order = np.lexsort((low, bin_of))
    b = bin_of[order]
    first = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
    rank = np.arange(len(b)) - np.repeat(first, np.diff(np.append(first, len(b))))
    order, b = order[rank < pick], b[rank < pick]
    order = order[np.lexsort((where[order], b))]                 # back into text order within the bin
    b, v = bin_of[order], v[order]
    first = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
    rank = np.arange(len(b)) - np.repeat(first, np.diff(np.append(first, len(b))))
    entry = np.zeros(bins, np.uint64)
    for r in range(pick):
        at = rank == r
        entry[b[at]] = mix64(entry[b[at]] * np.uint64(0x9E3779B97F4A7C15) + v[at])
    full = b[first]
    out[full] = np.maximum(entry[full] >> np.uint64(48), np.uint64(1)).astype(np.uint16)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal entries among the bins that either fills; 1 for two empty texts."""
    either = (a != _EMPTY) | (b != _EMPTY)
    n = int(either.sum())
    return float(((a == b) & either).sum()) / n if n else 1.0


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = KMER, bins: int = BINS,
                 pick: int = PICK) -> DataFrame:
    """``docs`` with a ``fingerprint`` column (binary, 2 bytes a bin); NULL and empty texts have all zeros."""
    @F.pandas_udf("binary")
    def of(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: signature(code_points(t), k, bins, pick).astype("<u2").tobytes())

    return docs.withColumn("fingerprint", of(text_of(text_col)))


def edited(cp: np.ndarray, following: np.ndarray) -> np.ndarray:
    """The last quarter replaced by as many code points from the start of the text that follows (or all it has)."""
    q = len(cp) // 4
    return np.concatenate([cp[:len(cp) - q], following[:q]])


def _utf8(cp: np.ndarray) -> bytes:
    return cp.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: (id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    The next document is the one with the next larger id, the first one's after
    the last.  Texts are sorted by id over range partitions, so a document and
    the one after it lie in the same task but at the ends of a partition; those
    few rows (two per partition) are written with their texts and joined
    afterwards.  NULL texts are empty; NULL ids come first; rows that repeat
    an id follow each other by text hash; a single row is followed by itself.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    own = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    own = own.repartitionByRange("id").sortWithinPartitions("id", F.xxhash64("text"))
    columns = ["part", "role", "id", "n_chars", "edited_sha256", "fp", "edited_fp", "near_edited", "near_next", "text"]

    def finished(key, cp, fp, next_cp, next_fp) -> tuple:
        new = edited(cp, next_cp)
        new_fp = signature(new)
        return (key, len(cp), sha256(_utf8(new)).digest(), fp.astype("<u2").tobytes(), new_fp.astype("<u2").tobytes(),
                likeness(fp, new_fp), likeness(fp, next_fp), None)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, last = TaskContext.get().partitionId(), None
        for pdf in batches:
            rows = []
            for key, text in zip(pdf["id"], pdf["text"]):
                cp = code_points(text)
                fp = signature(cp)
                if last is None:
                    rows.append((part, "first", key, len(cp), None, fp.astype("<u2").tobytes(), None, None, None, text))
                else:
                    rows.append((part, "done", *finished(*last, cp, fp)))
                last = (key, cp, fp)
            yield pd.DataFrame(rows, columns=columns)
        if last is not None:
            key, cp, fp = last
            yield pd.DataFrame([(part, "last", key, len(cp), None, fp.astype("<u2").tobytes(), None, None, None,
                                 _utf8(cp).decode("utf-8", "surrogatepass"))], columns=columns)

    found = saved(own.mapInPandas(run, f"part int, role string, id {kind}, n_chars long, edited_sha256 binary, fp binary, "
                                       "edited_fp binary, near_edited double, near_next double, text string"), "fingerprints")
    parts = [r["part"] for r in found.filter("role = 'first'").select("part").orderBy("part").collect()]   # a number per partition
    out = ["id", "n_chars", "edited_sha256", "fp", "edited_fp", "near_edited", "near_next"]
    done = found.filter("role = 'done'").select(*out)
    if parts:
        after = docs.sparkSession.createDataFrame(list(zip(parts, parts[1:] + parts[:1])), "part int, next_part int")
        heads = found.filter("role = 'first'").select(F.col("part").alias("next_part"), F.col("text").alias("next_text"))
        ends = (found.filter("role = 'last'").select("part", "id", "text").join(after, "part").join(heads, "next_part")
                .select("id", "text", "next_text"))

        def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                rows = []
                for key, text, following in zip(pdf["id"], pdf["text"], pdf["next_text"]):
                    cp, next_cp = code_points(text), code_points(following)
                    rows.append(finished(key, cp, signature(cp), next_cp, signature(next_cp))[:-1])
                yield pd.DataFrame(rows, columns=out)

        done = done.unionByName(ends.mapInPandas(finish, found.select(*out).schema))
    return done.select("id", "n_chars", F.lower(F.hex("edited_sha256")).alias("edited_sha256"), F.lower(F.hex("fp")).alias("fingerprint"),
                       F.lower(F.hex("edited_fp")).alias("edited_fingerprint"), "near_edited", "near_next")


def query(spark, sf_dir: str) -> DataFrame:
    """op1: fingerprints of the whole ``documents`` table and of its edited texts."""
    return fingerprint_edits(read_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
