"""Corpus operators where one group holds most rows: no task gets the whole group, results as by hand."""

from collections import Counter, defaultdict
from contextlib import contextmanager
from hashlib import sha256

from pyspark.sql import functions as F

from tests.llm.helpers import frame, prose
from vigil.llm import lm_score, near_dedup, suffix_dedup

#: Small tables count as skewed and none is broadcast.
SPLIT = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
         "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
         "spark.sql.adaptive.coalescePartitions.enabled": "false"}
CHUNKS = "context long, chunk long, unit long, i int, held boolean, coded double"


@contextmanager
def split(spark):
    for key, value in SPLIT.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key in SPLIT:
            spark.conf.unset(key)


def test_rows_of_a_frequent_context_stay_spread(spark, monkeypatch):
    """Most chunks follow one context; ties, held-out rows and contexts of one row are among them."""
    rows = [(7 if k % 10 else k, (k * k) % 13 if k % 3 else 5, k, k % 4, k % 7 == 2, -1.0) for k in range(4000)]
    rows += [(-9, c, 5000 + k, 0, False, -2.0) for k, c in enumerate([1, 1, 2, 2])]
    by = defaultdict(Counter)
    for context, chunk, _, _, held, _ in rows:
        by[context][chunk] += not held
    want = {}
    for context, chunk, unit, _, held, _ in rows:
        others = by[context] - Counter([] if held else [chunk])
        if others:
            m = max(others.values())
            # A tied best that does not count itself gives way to the other one.
            most = max(by[context].items(), key=lambda x: (x[1], x[0]))[0]
            want[unit] = (sum(others.values()), m, chunk == most and others[chunk] == m)
    monkeypatch.setattr(lm_score, "saved", lambda df, name, saved=lm_score.saved: saved(df.repartition(4), name))
    with split(spark):
        out = lm_score.compare_chunks(spark.createDataFrame(rows, CHUNKS).repartition(4)).withColumn("task", F.spark_partition_id()).collect()
    assert {r["unit"]: (r["n"], r["m"], r["hit"]) for r in out} == want
    assert len({r["task"] for r in out if r["n"] > 3000}) > 1


def repeats_in_order(rows):
    """(id, n_removed, sha256 of what stays) per row; equal rows are one document, texts of one id come by SHA-256."""
    def order(row):
        return -2 ** 63 if row[0] is None else row[0], sha256((row[1] or "").encode()).hexdigest()

    seen, out = set(), {}
    for row in sorted(set(rows), key=order):
        b = (row[1] or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 99):
            if b[s:s + 100] in seen:
                gone[s:s + 100] = b"\1" * 100
            seen.add(b[s:s + 100])
        out[row] = (row[0], sum(gone), sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    return sorted((out[r] for r in rows), key=str)


def drop_repeats(spark, rows):
    out = suffix_dedup.drop_repeats(frame(spark, rows)).collect()
    return sorted(((r["id"], r["n_removed"], r["kept_sha256"]) for r in out), key=str)


def test_texts_that_share_an_id_keep_their_own_bytes(spark):
    """Two NULL ids, one id with two texts, and a row that is there twice and nowhere else."""
    shared = prose(80, 50)
    rows = [(None, prose(81, 40) + " " + shared), (None, shared + " " + prose(82, 60)), (None, prose(83, 70)),
            (3, prose(84, 9) + shared + prose(85, 50)), (3, prose(86, 80) + shared), (3, shared + "|" + shared),
            (4, prose(87, 60)), (4, prose(87, 60)), (5, prose(87, 60)[:200])]
    assert drop_repeats(spark, rows) == repeats_in_order(rows)


def lines_in_other_texts():
    """A line that each document has in words of its own; every fifth has more than the line in common."""
    line = "this line of sixty bytes is in every document of the table "
    return [(k, prose(100 + k, 25) + " " + line * (1 + k % 2) + (prose(99, 30) if k % 5 == 0 else prose(300 + k, 25))) for k in range(150)]


def test_a_frequent_line_in_different_texts(spark, monkeypatch):
    """Windows of an anchor with many segments are compared over all tasks."""
    rows = lines_in_other_texts()
    want = repeats_in_order(rows)
    for name, value in (("MOST_SEGMENTS", 3), ("SAMPLE", 1), ("HOT_PARTS", 100)):
        monkeypatch.setattr(suffix_dedup, name, value)
        assert drop_repeats(spark, rows) == want


def test_runs_of_a_frequent_line_stay_spread(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SAMPLE", 1)
    docs = spark.createDataFrame([(k, 0, t.encode()) for k, t in lines_in_other_texts()], "doc long, key long, raw binary")
    frequent = suffix_dedup.frequent_anchors(docs)
    tasks = {}
    for name, found in (("spread", frequent), ("one", frequent[:0])):
        runs = suffix_dedup._compare_runs(suffix_dedup._anchors(docs.repartition(4), found), found).filter("open")
        runs = runs.withColumn("task", F.spark_partition_id())
        with split(spark):
            by = runs.groupBy("h").agg(F.count("*").alias("n"), F.countDistinct("task").alias("tasks")).orderBy(F.desc("n")).first()
        tasks[name] = by["n"], by["tasks"]
    assert tasks["one"][0] >= 100 and tasks["one"][1] == 1
    assert tasks["spread"][0] >= 100 and tasks["spread"][1] > 4


def test_rows_without_an_id_and_ids_with_two_texts_have_classes(spark):
    a, b, c, d = (prose(k, 120) for k in (400, 401, 402, 403))
    big = 2 ** 60 + 1
    rows = [(1, a), (1, b), (2, a + " more"), (3, b + " more"), (None, a + " end"), (None, c), (None, c + " more"), (big, d), (big, d), (5, None)]
    out = near_dedup.near_duplicates(frame(spark, rows)).collect()
    assert sorted(((r["id"], r["class_id"]) for r in out), key=str) == sorted(
        [(1, 1), (1, 1), (2, 1), (3, 1), (None, 1), (None, None), (None, None), (big, big), (big, big), (5, 5)], key=str)
    kept = [(r["doc_id"], r["text"]) for r in near_dedup.drop_near_copies(frame(spark, rows)).collect()]
    assert len(kept) == 5 and set(kept) >= {(1, a), (1, b), (big, d), (5, None)}
    assert [t for i, t in kept if i is None][0] in (c, c + " more")
