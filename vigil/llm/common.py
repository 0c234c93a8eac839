"""Helpers shared by the corpus operators.

Intermediate tables are parquet written under the folder the cluster names in
``spark.checkpoint.dir`` (``vigil.session`` resolves it), so every executor can
read them and a lost executor costs no recomputation of finished stages.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.session import ensure_checkpoint_dir
from vigil.sources.tables import read_table

__all__ = ["read_table", "saved", "remove_saved", "collected", "unused", "columns_of", "text_of", "crc32_of", "mix64", "shingle_words", "WHITE"]

#: ASCII white space: the bytes and code points between words.
WHITE = r"[\x20\x09-\x0D]"

_SAVED: list[str] = []


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back (cuts the lineage)."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/vigil-llm/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    _SAVED.append(path)
    return spark.read.schema(df.schema).parquet(path)


def remove_saved(spark: SparkSession) -> int:
    """Delete the tables that ``saved`` wrote in this process; results that read them become unreadable."""
    n = len(_SAVED)
    while _SAVED:
        path = spark._jvm.org.apache.hadoop.fs.Path(_SAVED.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n


def collected(df: DataFrame) -> pd.DataFrame:
    """The rows of a table of bounded size in the driver, as Arrow columns whatever the session's setting: without
    them each row is a Python object first, which takes some ten times the memory."""
    return df.toArrow().to_pandas()


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores behind those that ``df`` has already."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def columns_of(df: DataFrame) -> list[Column]:
    """All columns of ``df``, whatever characters are in their names."""
    return [df["`" + c.replace("`", "``") + "`"] for c in df.columns]


def text_of(column: str) -> Column:
    """The text with NULL as the empty string."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def crc32_of(text: Column) -> Column:
    """Unsigned CRC-32 of the UTF-8 bytes."""
    return F.crc32(F.encode(text, "UTF-8"))


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64-bit word (xor-shift and multiply rounds)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


# One random 64-bit value per byte, from a fixed seed.
_BYTE = np.random.default_rng(20240607).integers(0, 2 ** 64, 256, dtype=np.uint64)
_IS_WHITE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_ODD = np.uint64(0x9E3779B97F4A7C15)
_ODD_INVERSE = np.uint64(pow(int(_ODD), -1, 2 ** 64))
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """ODD^i and ODD^-i modulo 2^64 for i < n, kept for the next call."""
    if len(_POWERS[0]) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        for k, base in enumerate((_ODD, _ODD_INVERSE)):
            steps = np.full(size, base)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS[0][:n], _POWERS[1][:n]


#: Bits of the first k bytes of a little-endian block.
_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _block(whole: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The up to 8 bytes, at most ``left``, from every position ``at`` of the text in aligned words of 8 bytes."""
    i, shift = at >> 3, (at.astype(np.uint64) & np.uint64(7)) << np.uint64(3)
    high = (whole[i + 1] << (np.uint64(63) - shift)) << np.uint64(1)
    return (whole[i] >> shift | high) & _BYTES[np.minimum(left, 8)]


def word_hashes(raw: bytes) -> np.ndarray:
    """64-bit hashes of the words of a UTF-8 text (maximal runs without ASCII white space), in order."""
    return _hashes_at(raw)[1]


def word_hashes_of(raws: list[bytes]) -> list[np.ndarray]:
    """``word_hashes`` of every text, in one pass over all of them."""
    starts, h = _hashes_at(b" ".join(raws))
    return np.split(h, np.searchsorted(starts, np.cumsum([len(r) + 1 for r in raws[:-1]]))) if raws else []


def _hashes_at(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(start of every word, its hash).

    A word is cut into blocks of 8 bytes; every block is mixed with its place
    before they are added, so no sum of blocks is a polynomial of the bytes."""
    b = np.frombuffer(raw, np.uint8)
    solid = ~_IS_WHITE[b]
    edge = np.flatnonzero(np.diff(solid, prepend=False, append=False))
    starts, ends = edge[0::2], edge[1::2]
    if not len(starts):
        return starts, np.empty(0, np.uint64)
    whole = np.frombuffer(raw + bytes(16 - len(raw) % 8), "<u8")
    lengths = ends - starts
    total = mix64(_block(whole, starts, lengths) + _ODD)
    long = np.flatnonzero(lengths > 8)
    if len(long):
        more = (lengths[long] - 1) >> 3
        first = np.cumsum(more) - more
        place = np.arange(int(more.sum())) - np.repeat(first, more) + 1
        at = np.repeat(starts[long], more) + 8 * place
        block = _block(whole, at, np.repeat(ends[long], more) - at)
        total[long] += np.add.reduceat(mix64(mix64(block) + place.astype(np.uint64) * _ODD), first)
    return starts, mix64(total + lengths.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def shingle_words(raw: bytes, width: int = 5) -> np.ndarray:
    """Hashes of all runs of ``width`` words, repeats included; a shorter text with words is one shingle."""
    w = word_hashes(raw)
    if not len(w):
        return w
    n = max(1, len(w) - width + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(width, len(w))):
        out = mix64(out * _ODD + w[k:k + n] + np.uint64(k + 1))
    return out
