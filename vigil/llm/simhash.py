"""SimHash near-duplicates: a grid join of fingerprints embedded as bit counts of short segments.

A fingerprint is cut into 32 segments of two bits; the vector of their bit
counts differs between two fingerprints by at most as much (Manhattan distance)
as the fingerprints do in bits.  Of two vectors at distance 3 or less one half
is at distance 1 or less.  So every fingerprint stands in the grid cell of each
half's vector and visits the cells one step above it; those that meet are
verified exactly.  Only different fingerprints meet, and a cell hands out links
that join its members, not all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from vigil.llm.common import read_table, saved, text_of
from vigil.llm.components import components

WIDTH = 3
SEED = 42
FAR = 3
#: Segments of two bits: the lowest bit of each, and how many one half of a fingerprint has.
LOW_BITS = 0x5555555555555555
HALF = 16
#: Fingerprints of one cell that a task holds; a larger cell is dealt out in blocks.
BLOCK = 8192
#: Cells of up to so many rows are compared offset by offset, many cells at once.
SMALL = 16
#: Large cells that are sent to every task, 16 bytes each; more are joined.
BROADCAST_ROWS = 100_000
#: Shingles hashed, and texts handed back to Spark, at once.
SHINGLES_AT_ONCE = 65_536
TEXTS_AT_ONCE = 512


def fingerprint(raw: bytes, width: int = WIDTH) -> int:
    """SimHash of a UTF-8 text: bit b is 1 if more than half of the shingles' XXH64 have it; 0 without words."""
    words = raw.lower().split()
    n = len(words) - width + 1
    if not words:
        return 0
    if n <= 1:
        return xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    begin = [0, *accumulate(len(w) + 1 for w in words)]
    counts = np.zeros(64, np.int64)
    for at in range(0, n, SHINGLES_AT_ONCE):
        upto = min(n, at + SHINGLES_AT_ONCE)
        h = np.array([xxh64_intdigest(joined[a:b - 1], SEED) for a, b in zip(begin[at:upto], begin[at + width:upto + width])], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) per row: the 64 bits as a signed long."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, TEXTS_AT_ONCE):
                batch = whole.slice(at, TEXTS_AT_ONCE)
                fp = np.array([fingerprint(raw.as_py()) for raw in batch.column(1).cast(pa.binary())], np.uint64)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).mapInArrow(run, f"id {kind}, fp long")


def segment_counts(fp: Column) -> Column:
    """Bit counts (0 to 2) of the 32 two-bit segments, each in its own two bits."""
    low, high = fp.bitwiseAND(F.lit(LOW_BITS)), F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(LOW_BITS))
    return low.bitwiseXOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))


def grid(values: DataFrame) -> DataFrame:
    """(cell, side, fp): each fingerprint at home (side 0) in the cell of each half, and as a guest (side 1) in the cells
    with one count more in one segment.  Of two neighbouring cells the lower one's members are the guests."""
    place = values.select("fp", segment_counts(F.col("fp")).alias("counts"), F.explode(F.sequence(F.lit(0), F.lit(2 * HALF + 1))).alias("t"))
    half, step = F.col("t") % 2, F.floor(F.col("t") / 2).cast("int") - 1
    own = F.expr("shiftrightunsigned(counts, 32 * half) & 4294967295L")
    room = F.expr("step < 0 OR (shiftright(own, 2 * step + 1) & 1) = 0")
    cell = F.expr("CASE WHEN step < 0 THEN own ELSE own + shiftleft(1L, 2 * step) END + half * 4294967296L")
    return (place.withColumn("half", half).withColumn("step", step).withColumn("own", own).filter(room)
            .select(cell.alias("cell"), (F.col("step") >= 0).cast("int").alias("side"), "fp"))


def dealt(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """(cell, block, side, fp): cells with more than ``block`` at home in several blocks, every pair in exactly one.

    A fingerprint stays at home in its own block and is a guest in all lower ones; guests visit every block.
    """
    hot = saved(rows.filter("side = 0").groupBy("cell").agg(F.count("*").alias("n")).filter(F.col("n") > block)
                .select("cell", F.ceil(F.col("n") / block).cast("int").alias("blocks")), "hot-cells")
    n = hot.count()
    if not n:
        return rows.select("cell", F.lit(0).alias("block"), "side", "fp")
    rows = rows.join(F.broadcast(hot) if n <= BROADCAST_ROWS else hot, "cell", "left").fillna(1, "blocks")
    own = F.expr("CASE WHEN side = 0 THEN int(pmod(xxhash64(fp), blocks)) ELSE blocks - 1 END")
    return (rows.withColumn("own", own).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("own"))))
            .withColumn("side", F.when((F.col("side") == 0) & (F.col("block") == F.col("own")), 0).otherwise(1))
            .select("cell", "block", "side", "fp"))


class _Cell:
    """The members of one block of a cell, joined into classes as they come."""

    def __init__(self, far: int):
        self.far, self.key, self.home, self.label, self.found = far, None, [], None, []

    def _join_home(self) -> None:
        """Classes of the members at home, from each one's nearest neighbours outwards."""
        if self.label is not None:
            return
        self.home = np.concatenate(self.home) if self.home else np.empty(0, np.uint64)
        self.label = np.arange(len(self.home))
        left = np.arange(len(self.home))
        while len(left):
            todo, left = [left[0]], left[1:]
            name = todo[0]
            while todo and len(left):
                i = todo.pop()
                near = np.bitwise_count(self.home[left] ^ self.home[i]) <= self.far
                hit, left = left[near], left[~near]
                self.label[hit] = name
                self.found += [(self.home[i], self.home[j]) for j in hit]
                todo.extend(hit)

    def finish(self) -> list:
        self._join_home()
        found, self.found = self.found, []
        return found

    def take(self, key, side: np.ndarray, fp: np.ndarray) -> list:
        """Rows of one block, those at home first; the block may go on with the next call."""
        found = []
        if key != self.key:
            found = self.finish()
            self.key, self.home, self.label = key, [], None
        guests = fp[side == 1]
        if self.label is None:
            self.home.append(fp[side == 0])
        if len(guests):
            self._join_home()
            for x in guests if len(self.home) else []:
                near = np.flatnonzero(np.bitwise_count(self.home ^ x) <= self.far)
                names = np.unique(self.label[near])
                for name in names:
                    self.found.append((self.home[near[self.label[near] == name][0]], x))
                if len(names) > 1:
                    self.label[np.isin(self.label, names)] = names[0]
        return found


def links(rows: DataFrame, far: int = FAR) -> DataFrame:
    """(u, v) of fingerprints that differ in at most ``far`` bits and meet in a block; they join whatever meets there.

    Rows come sorted; a task holds the members at home of one block, guests pass by.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cell = _Cell(far)
        for pdf in batches:
            key = np.stack([pdf["cell"].to_numpy(), pdf["block"].to_numpy()], axis=1)
            side, fp = pdf["side"].to_numpy(), pdf["fp"].to_numpy().view(np.uint64)
            begin = np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(axis=1)))
            end = np.append(begin[1:], len(fp))
            whole = np.arange(len(begin))
            alone = (whole > 0) & (whole < len(begin) - 1) & (end - begin <= SMALL)
            found = []
            for a, b in zip(begin[~alone].tolist(), end[~alone].tolist()):
                found += cell.take(tuple(key[a]), side[a:b], fp[a:b])
            found, cell.found = found + cell.found, []
            upto = np.repeat(np.where(alone, end, 0), end - begin)
            at, d = np.flatnonzero(side == 0), 1
            pairs = []
            while len(at := at[at + d < upto[at]]):
                near = at[np.bitwise_count(fp[at] ^ fp[at + d]) <= far]
                pairs.append(np.stack([fp[near], fp[near + d]], axis=1))
                d += 1
            if found:
                pairs.append(np.array(found, np.uint64))
            if pairs:
                yield pd.DataFrame(np.concatenate(pairs).view(np.int64), columns=["u", "v"])
        if found := cell.finish():
            yield pd.DataFrame(np.array(found, np.uint64).view(np.int64), columns=["u", "v"])

    spread = rows.repartition("cell", "block").sortWithinPartitions("cell", "block", "side", "fp")
    return spread.mapInPandas(run, "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per input row: (id, fp, component_id), the smallest id among all rows reachable over links of fingerprints
    that differ in three bits or fewer.

    A-Z count as lower case; shingles are three words (runs without ASCII white space) joined by one space, repeats
    included; a text of fewer words is one shingle.  NULL and white texts have fingerprint zero, which links like any
    other.  Equal texts and repeated rows have one fingerprint and so one component.  NULL ids are passed over when the
    smallest id is sought; a component of NULL ids only has NULL.  Other columns are not looked at; an empty table gives
    no rows.
    """
    rows = saved(fingerprints(docs, id_col, text_col), "simhash")
    values = saved(rows.groupBy("fp").agg(F.min("id").alias("first")), "simhash-values")
    found = saved(links(dealt(grid(values.select("fp")), block)).distinct(), "simhash-links")
    member = values.join(components(found).withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    member = saved(member, "simhash-members")
    name = member.groupBy("root").agg(F.min("first").alias("component_id"))
    return rows.join(member.select("fp", "root").join(name, "root").select("fp", "component_id"), "fp").select("id", "fp", "component_id")


def query(spark, sf_dir: str) -> DataFrame:
    """op12: fingerprints and components of the whole ``documents`` table."""
    found = near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
