"""Removal of repeated passages: every byte covered by a 100-byte string that starts earlier somewhere.

Any two equal 100-byte windows hold the same least 24-byte string (their
anchor) at the same place, so only windows with the same anchor can be equal.
A document's windows fall into runs that share an anchor; a run's bytes are a
segment.  Anchors meet by hash: where an anchor's segment occurred before as a
whole, all its windows are repeats and no byte has moved.  The first
occurrences of different segments of one anchor are fetched and compared byte
by byte: shards of them get a suffix array (Larsson-Sadakane) with common
prefixes (Kasai), neighbours that share 100 bytes are one string, and a group
that spans shards is merged by binary search in the strings of its earlier ones.
Anchors with more than MOST_SEGMENTS different segments are compared window by
window instead: the windows meet by a 128-bit digest, so no task holds them all.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b, sha256

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm import common
from vigil.llm.common import mix64, read_table, saved, text_of
from vigil.llm.suffix_array import common_prefixes, suffix_array

LENGTH = 100
ANCHOR = 24
#: Bytes of segments in one suffix array.
SHARD_BYTES = 1 << 18
#: Groups of equal texts with more than 1 / HOT_PARTS of all rows are set aside first; there are at most HOT_PARTS.
HOT_PARTS = 10_000
#: Different segments of one anchor that one task compares.
MOST_SEGMENTS = 4096
#: One document in so many is looked at to find the frequent anchors, whose runs are dealt out by segment.
SAMPLE = 64
_POSITION = 26      # bits of a position within a window's key
_NO_ID = -2 ** 63


def runs_of(raw: bytes, length: int = LENGTH, anchor: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """(anchor hash, segment hash, first window, last window) of the runs of windows that share their least anchor."""
    b = np.frombuffer(raw, np.uint8)
    n = len(b)
    if n < length:
        return (np.empty(0, np.uint64),) * 2 + (np.empty(0, np.int64),) * 2
    up, down = common._powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(common._BYTE[b] * up[:-1], out=total[1:])
    grams = mix64((total[anchor:] - total[:n - anchor + 1]) * down[:n - anchor + 1])
    # Least (upper hash bits, position) of every window: minima from the left and from the right of blocks as wide.
    mask = np.uint64((1 << _POSITION) - 1)
    at = np.arange(len(grams), dtype=np.uint64)
    wide = length - anchor + 1
    windows = n - length + 1
    blocks = -(-len(grams) // wide)
    packed = np.full(blocks * wide, np.uint64(2 ** 64 - 1))
    packed[:len(grams)] = grams & ~mask | at & mask
    packed = packed.reshape(blocks, wide)
    left = np.minimum.accumulate(packed, axis=1).ravel()
    right = np.minimum.accumulate(packed[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(right[:windows], left[wide - 1:wide - 1 + windows])
    edge = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    first, last = edge, np.append(edge[1:], windows) - 1
    # The position modulo 2^26, put back by the window that it lies in.
    low = (least[first] & mask).astype(np.int64)
    place = first + (low - first) % (1 << _POSITION)
    stop = last + length
    segment = mix64((total[stop] - total[first]) * down[first] + ((stop - first) << 8 | (place - first)).astype(np.uint64))
    return grams[place], segment, first, last


def frequent_anchors(docs: DataFrame) -> np.ndarray:
    """Sorted hashes of the anchors with more than 1 / HOT_PARTS of the different runs of a sample, HOT_PARTS at most.

    They only decide where runs are compared, not with which result."""
    sample = docs.filter(F.pmod(F.xxhash64("doc", "key"), F.lit(SAMPLE)) == 0)
    counts = saved(_anchors(sample, np.empty(0, np.uint64)).filter("not again").groupBy("h").agg(F.count("*").alias("n"))
                   .filter("n > 1"), "sampled-anchors")
    total = counts.agg(F.sum("n")).first()[0] or 0
    found = counts.filter((F.col("n") > 8) & (F.col("n") * HOT_PARTS > total)).select("h").toPandas()["h"]
    return np.sort(found.to_numpy().astype(np.int64).view(np.uint64))


def _anchors(docs: DataFrame, frequent: np.ndarray) -> DataFrame:
    """(h, segment, doc, key, run, again, deal) of all runs; ``run`` is the first window << 8 | windows - 1.

    ``again``: an earlier run among the documents at hand has the same segment, so this one is a repeat whatever the
    others hold.  Such rows are dealt out by document, and a frequent anchor sends a row per task instead of all.
    Runs of a ``frequent`` anchor are dealt out by segment.  A repeated row's runs are the same runs, not repeats."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 500):
                some = pdf.iloc[at:at + 500]
                found = [runs_of(raw) for raw in some["raw"]]
                h, segment, first, last = (np.concatenate([f[k] for f in found]) for k in range(4))
                sizes = [len(f[0]) for f in found]
                doc, key, place = np.repeat(some["doc"].to_numpy(), sizes), np.repeat(some["key"].to_numpy(), sizes), first << 8 | (last - first)
                by = np.lexsort((place, key, doc, segment, h))
                h, segment, doc, key, place = (x[by] for x in (h, segment, doc, key, place))
                again = np.concatenate([[False], (h[1:] == h[:-1]) & (segment[1:] == segment[:-1])])[:len(h)]
                new = ~again
                new[1:] |= (doc[1:] != doc[:-1]) | (key[1:] != key[:-1]) | (place[1:] != place[:-1])
                deal = np.where(again, mix64(doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + place.astype(np.uint64)),
                                np.where(np.isin(h, shared.value), mix64(h + segment), h))
                yield pd.DataFrame({"h": h.view(np.int64), "segment": segment.view(np.int64), "doc": doc, "key": key, "run": place,
                                    "again": again, "deal": deal.view(np.int64)})[new]

    return docs.select("doc", "key", "raw").mapInPandas(run, "h long, segment long, doc long, key long, run long, again boolean, deal long")


def _compare_runs(anchors: DataFrame, frequent: np.ndarray) -> DataFrame:
    """(h, doc, key, run, open) of the runs of repeated anchors: open is false where the segment occurred before, and
    true for the first occurrence of a segment whose anchor has others or is ``frequent``.

    Anchors come sorted by (h, segment, doc, key, run), after those that are
    known to be repeats.  Only the first occurrence of the last segment is held
    from one batch to the next.
    """
    columns = ["h", "segment", "doc", "key", "run"]
    out = ["h", "doc", "key", "run", "open"]
    shared = anchors.sparkSession.sparkContext.broadcast(frequent.view(np.int64))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, given = None, False          # the last segment's first occurrence, and whether it was given out
        for pdf in batches:
            sure = pdf["again"].to_numpy()
            if sure.any():
                yield pdf[sure].assign(open=False)[out]
            fresh = pdf.loc[~sure, columns]
            if not len(fresh):
                continue
            rows = fresh if held is None else pd.concat([held, fresh], ignore_index=True)
            h, segment, doc, key, place = (rows[c].to_numpy() for c in columns)
            first = np.concatenate([[True], (h[1:] != h[:-1]) | (segment[1:] != segment[:-1])])
            heads = np.flatnonzero(first)
            of = heads[np.cumsum(first) - 1]
            yield rows[(doc != doc[of]) | (key != key[of]) | (place != place[of])].assign(open=False)[out]
            same = h[heads][1:] == h[heads][:-1]
            several = np.concatenate([[False], same]) | np.concatenate([same, [False]]) | np.isin(h[heads], shared.value)
            before = given
            given = bool(several[-1]) or (given and len(heads) == 1)
            several[0] &= not before
            yield rows.iloc[heads[several]].assign(open=True)[out]
            held = rows.iloc[heads[-1:]]

    dealt = anchors.repartition("deal").sortWithinPartitions(F.desc("again"), "h", "segment", "doc", "key", "run")
    return dealt.mapInPandas(run, "h long, doc long, key long, run long, open boolean")


def repeated_windows(raws: list[bytes], groups: np.ndarray, seen: list[np.ndarray] | None = None, length: int = LENGTH) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """(per segment which windows occurred before, the last group's windows).

    Segments come in order within their group; ``seen`` holds the windows that
    earlier shards found in the first group, a sorted array per shard and none
    of them twice: they are searched one by one and never merged into a copy.
    """
    text = np.frombuffer(b"".join(raws), np.uint8)
    lengths = np.array([len(r) for r in raws])
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    order, rank = suffix_array(text, starts)
    same = common_prefixes(text, starts, order, rank) >= length
    heads = np.flatnonzero(~same)
    first = np.repeat(np.minimum.reduceat(order, heads), np.diff(np.append(heads, len(order))))
    before = np.zeros(len(text), bool)
    before[order] = order != first
    whole = np.repeat(starts + lengths, lengths) - np.arange(len(text)) >= length

    def windows(group) -> tuple[np.ndarray, np.ndarray]:
        mine = np.flatnonzero(whole & ~before & (np.repeat(groups, lengths) == group))
        view = np.lib.stride_tricks.sliding_window_view(text, length)[mine] if len(mine) else np.empty((0, length), np.uint8)
        return mine, np.ascontiguousarray(view).view(f"V{length}").ravel()

    for earlier in seen or []:
        mine, own = windows(groups[0])
        if len(mine) and len(earlier):
            at = _search(earlier, own)
            before[mine[at >= 0]] = True
    keep = _text(windows(groups[-1])[1])
    keep.sort()
    keep = [*(seen or [] if groups[0] == groups[-1] else []), keep]
    return [before[s:s + n - length + 1] for s, n in zip(starts, lengths)], keep


def _text(windows: np.ndarray) -> np.ndarray:
    """Windows as fixed-width strings that compare like bytes (a closing byte keeps trailing zeros)."""
    width = windows.dtype.itemsize
    out = np.ones((len(windows), width + 1), np.uint8)
    out[:, :width] = windows.view(np.uint8).reshape(len(windows), width)
    return out.view(f"S{width + 1}").ravel()


def _search(seen: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Place of each window among the sorted ``seen``, -1 where it is not there."""
    own = _text(windows)
    at = np.minimum(np.searchsorted(seen, own), len(seen) - 1)
    return np.where(seen[at] == own, at, -1)


def _compare_bytes(segments: DataFrame) -> DataFrame:
    """(doc, key, lo, hi): first and last of consecutive windows that occurred before, from (h, doc, key, run, raw)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, size, seen = [], 0, (None, None)

        def shard(more) -> pd.DataFrame:
            nonlocal rows, size, seen
            groups = np.array([r[0] for r in rows])
            before, last = repeated_windows([r[4] for r in rows], groups, seen[1] if seen[0] == groups[0] else None)
            seen = (groups[-1], last) if more == groups[-1] else (None, None)
            out = []
            for (_, doc, key, first, _), again in zip(rows, before):
                edge = np.flatnonzero(np.diff(again, prepend=False, append=False))
                out += [(doc, key, (first >> 8) + int(a), (first >> 8) + int(b) - 1) for a, b in zip(edge[0::2], edge[1::2])]
            rows, size = [], 0
            return pd.DataFrame(out, columns=["doc", "key", "lo", "hi"])

        for pdf in batches:
            for row in zip(pdf["h"].tolist(), pdf["doc"].tolist(), pdf["key"].tolist(), pdf["run"].tolist(), pdf["raw"]):
                if size >= SHARD_BYTES:
                    yield shard(row[0])
                rows.append(row)
                size += len(row[4])
        if rows:
            yield shard(None)

    return segments.repartition("h").sortWithinPartitions("h", "doc", "key", "run").mapInPandas(run, "doc long, key long, lo long, hi long")


def _cut(needed: DataFrame) -> DataFrame:
    """The bytes of every wanted run: (h, doc, key, run, raw) from (doc, key, raw, runs)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(r["h"], doc, key, r["run"], raw[r["run"] >> 8:(r["run"] >> 8) + (r["run"] & 255) + LENGTH])
                   for doc, key, raw, runs in zip(pdf["doc"], pdf["key"], pdf["raw"], pdf["runs"]) for r in runs]
            yield pd.DataFrame(out, columns=["h", "doc", "key", "run", "raw"])

    return needed.mapInPandas(run, "h long, doc long, key long, run long, raw binary")


def _compare_windows(needed: DataFrame) -> DataFrame:
    """(doc, key, lo, hi): the windows of the ``wide`` runs of (doc, key, raw, wide) that occurred before, each by itself.

    The first place of a window is a partial aggregate, which a plain join brings back to the others."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 500):
                some = pdf.iloc[at:at + 500]
                out = [(blake2b(raw[k:k + LENGTH], digest_size=16).digest(), doc, key, k)
                       for doc, key, raw, runs in zip(some["doc"], some["key"], some["raw"], some["wide"]) for r in runs
                       for k in range(r["run"] >> 8, (r["run"] >> 8) + (r["run"] & 255) + 1)]
                yield pd.DataFrame(out, columns=["window", "doc", "key", "at"])

    wide = needed.filter(F.size("wide") > 0).select("doc", "key", "raw", "wide")
    windows = saved(wide.mapInPandas(run, "window binary, doc long, key long, at long"), "windows")
    place = F.struct("doc", "key", "at")
    first = saved(windows.groupBy("window").agg(F.count("*").alias("n"), F.min(place).alias("first")).filter("n > 1").drop("n"), "first-windows")
    return windows.join(first, "window").filter(place != F.col("first")).select("doc", "key", F.col("at").alias("lo"), F.col("at").alias("hi"))


def removed_spans(windows: list[tuple[int, int]], length: int = LENGTH) -> list[tuple[int, int]]:
    """Maximal spans [from, to) of bytes under the windows (first, last)."""
    spans: list[list[int]] = []
    for lo, hi in sorted(windows):
        if spans and lo <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], hi + length)
        else:
            spans.append([lo, hi + length])
    return [tuple(s) for s in spans]


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: (id, n_bytes, n_removed, n_spans, kept_sha256, spans).

    A byte goes when a 100-byte string over it also starts earlier: in a
    document with a smaller id, or earlier in the same one.  Ids are whole
    numbers, a NULL id comes first; NULL texts are empty; texts under 100 bytes
    lose nothing.  Rows that repeat an id and a text are one document; rows
    that repeat an id with other texts are one document each, and of these the
    one with the smaller SHA-256 (its upper 60 bits) is the earlier.  ``spans`` are the removed byte ranges [from, to).
    """
    own = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("doc"), text_of(text_col).alias("text")) \
        .withColumns({"sha": F.sha2("text", 256), "raw": F.encode("text", "UTF-8")}).drop("text") \
        .withColumn("key", F.conv(F.substring("sha", 1, 15), 16, 10).cast("long"))       # tells the texts of one id apart
    digests = saved(own.select("doc", "sha", F.octet_length("raw").cast("long").alias("n_bytes")), "digests")
    n = digests.count()
    # Copies of a hot text lose everything; the number of hot texts is bounded.
    hot = saved(digests.filter(F.col("n_bytes") >= LENGTH).groupBy("sha").agg(F.min("doc").alias("first_doc"), F.count("*").alias("rows"))
                .filter((F.col("rows") > 1) & (F.col("rows") * HOT_PARTS > n)).select("sha", "first_doc"), "hot-texts")
    cold = own.join(F.broadcast(hot), "sha", "left").filter(F.coalesce(F.col("doc") == F.col("first_doc"), F.lit(True)))
    frequent = frequent_anchors(cold)
    runs = saved(_compare_runs(_anchors(cold, frequent), frequent), "runs")
    wide = saved(runs.filter("open").groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") > MOST_SEGMENTS).select("h", F.lit(True).alias("wide")), "wide")
    marked = runs.filter("open").join(wide, "h", "left").select("doc", "key", "h", "run", F.coalesce("wide", F.lit(False)).alias("wide")) \
        .unionByName(runs.filter("not open").select("doc", "key", "h", "run", F.lit(None).cast("boolean").alias("wide")))
    per_doc = marked.groupBy("doc", "key").agg(*[F.collect_list(F.when(c, F.struct("h", "run"))).alias(name)                 # a run per byte at most
                                                 for name, c in (("runs", ~F.col("wide")), ("wide", F.col("wide")))])
    needed = saved(cold.select("doc", "key", "raw").join(per_doc, ["doc", "key"]), "repeating-texts")
    # Equal (doc, key, run) of a repeated row are one segment.
    segments = _cut(needed.select("doc", "key", "raw", "runs")).dropDuplicates(["h", "doc", "key", "run"])
    windows = saved(_compare_bytes(segments).unionByName(_compare_windows(needed)), "byte-repeats") \
        .unionByName(runs.filter("not open").select("doc", "key", F.shiftright("run", 8).alias("lo"),
                                                    (F.shiftright("run", 8) + F.col("run").bitwiseAND(255)).alias("hi")))
    spans_of = windows.groupBy("doc", "key").agg(F.collect_list(F.struct("lo", "hi")).alias("windows"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for doc, raw, windows in zip(pdf["doc"], pdf["raw"], pdf["windows"]):
                spans = removed_spans([(w["lo"], w["hi"]) for w in windows])
                at, kept = 0, sha256()
                for a, b in spans:
                    kept.update(raw[at:a])
                    at = b
                kept.update(raw[at:])
                out.append((doc, sha256(raw).hexdigest(), sum(b - a for a, b in spans), len(spans), kept.hexdigest(),
                            [{"from": a, "to": b} for a, b in spans]))
            yield pd.DataFrame(out, columns=["doc", "sha", "n_removed", "n_spans", "kept_sha256", "spans"])

    spans_type = "array<struct<from: long, to: long>>"
    changed = needed.select("doc", "key", "raw").join(spans_of, ["doc", "key"]).mapInPandas(
        cut, f"doc long, sha string, n_removed long, n_spans long, kept_sha256 string, spans {spans_type}")
    changed = changed.dropDuplicates(["doc", "sha"])
    rows = digests.join(F.broadcast(hot), "sha", "left").join(changed, ["doc", "sha"], "left")
    copy = F.col("first_doc").isNotNull() & (F.col("first_doc") != F.col("doc"))
    zero, none = F.lit(0).cast("long"), F.array().cast(spans_type)
    whole = F.array(F.struct(zero.alias("from"), F.col("n_bytes").alias("to"))).cast(spans_type)
    return rows.select(F.when(F.col("doc") != _NO_ID, F.col("doc")).alias("id"), "n_bytes",
                       F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", zero)).alias("n_removed"),
                       F.when(copy, F.lit(1).cast("long")).otherwise(F.coalesce("n_spans", zero)).alias("n_spans"),
                       F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
                       F.when(copy, whole).otherwise(F.coalesce("spans", none)).alias("spans"))


def query(spark, sf_dir: str) -> DataFrame:
    """op7: repeated passages of the whole ``documents`` table."""
    return drop_repeats(read_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id").drop("spans")
