"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document gets an exponential key, -ln(u) / quality, with u from a hash of
its id.  A source whose target exceeds its size first takes whole epochs; the
fraction that is left takes its documents in key order until the words reach
it.  A source is never sorted as a whole: keys fall into monotone buckets, the
sums per (source, bucket) show the one bucket in which a source's target lies,
and only that bucket is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.llm.common import columns_of, read_table, saved, text_of, unused

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_EPOCHS = 2
#: Rows per key bucket that the sorted buckets hold on average.
BUCKET_ROWS = 2000
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def quality_weight(text: Column) -> Column:
    """Share of letters and blanks among the characters, at least 0.05; 1 for an empty text."""
    plain = F.length(F.regexp_replace(text, r"[!-@\[-`{-~]+", ""))
    return F.greatest(F.lit(0.05), F.coalesce(F.try_divide(plain.cast("double"), F.length(text)), F.lit(1.0)))


def uniform(*columns: str, seed: int) -> Column:
    """In (0, 1), from a hash of the columns."""
    return (F.shiftrightunsigned(F.xxhash64(*columns, F.lit(seed)), 12).cast("double") + 0.5) / float(2 ** 52)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE,
                   most: float = MOST_EPOCHS) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources by code point, NULL last, weigh ``weights`` in turn and share
    ``share`` of all words; no target exceeds ``most`` times its source, and
    the excess is shared again by weight.  Filled in order of size per weight,
    a source is capped exactly when the share per weight of what the earlier
    ones leave reaches its cap.  One row per source goes through one window.
    """
    every = Window.partitionBy(F.lit(1))
    order = every.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    s = sizes.withColumn("rank", F.row_number().over(order))
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                                            ((F.col("rank") - 1) % len(weights) + 1).cast("int")))
    s = s.withColumns({"cap": F.col("source_size") * float(most), "budget": F.sum("source_size").over(every) * float(share)})
    fill = every.orderBy(F.col("cap") / F.col("weight"), "rank")
    s = s.withColumns({"capped": F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
                       "open": F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing))})
    level = (F.col("budget") - F.col("capped")) / F.col("open")
    # The level at the first source that it leaves uncapped holds for all later ones.
    s = s.withColumn("level", F.max(F.when(level * F.col("weight") <= F.col("cap"), level)).over(every))
    return s.select("source", "source_size", F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_EPOCHS,
                seed: int = 0, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row per input row: (id, source, size, source_size, target, epochs, taken, digest).

    ``epochs`` is how often the mix takes the document, 0 to ``most`` times;
    ``taken`` its words in the mix.  The document at which a source reaches its
    target is taken when that ends nearer to the target.  NULL texts have no
    words; a source without words has target 0; NULL is a source of its own.
    Keys come from the id and the text's MD5, so rows without an id or with the
    same one are dealt like any others.  Repeated rows are one counted item until
    the end: they share a key, and as many of them are taken as the target asks
    for.  Reruns agree.  An empty table gives no rows.
    """
    text = text_of(text_col)
    items = (docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(text).alias("size"),
                         F.unhex(F.md5(F.encode(text, "UTF-8"))).alias("digest"), quality_weight(text).alias("quality"))
             .groupBy("id", "source", "size", "digest", "quality").agg(F.count("*").alias("copies")))
    rows = saved(items.withColumn("key", -F.ln(uniform("id", "digest", seed=seed)) / F.col("quality")).drop("quality"), "mix-rows")
    sources = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"), F.count("*").alias("n"))
    counts = saved(sources, "mix-sources")
    targets = source_targets(counts.select("source", "source_size"), weights, share, most)
    targets = (targets.alias("t").join(counts.alias("c"), F.col("t.source").eqNullSafe(F.col("c.source")))
               .select("t.*", F.col("c.n").alias("n")))
    whole = F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size"))), F.lit(0)).cast("long")
    targets = saved(targets.withColumn("whole", F.least(whole, F.lit(int(most)).cast("long")))
                    .withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
                    .withColumn("buckets", F.ceil(F.col("n") / bucket_rows)), "mix-targets")
    r = rows.alias("r").join(targets.alias("t"), F.col("r.source").eqNullSafe(F.col("t.source"))).select(
        "r.*", "t.source_size", "t.target", "t.whole", "t.rest",
        F.floor((1 - F.exp(-F.col("r.key"))) * F.col("t.buckets")).cast("long").alias("bucket"))
    words = F.col("size") * F.col("copies")
    upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = r.groupBy("source", "bucket").agg(F.sum(words).alias("words"), F.first("rest").alias("rest")) \
        .withColumn("before", F.coalesce(F.sum("words").over(upto), F.lit(0)))
    # The bucket in which the rest ends: one per source, or none when nothing is left to take.
    edge = saved(sums.filter((F.col("before") < F.col("rest")) & (F.col("before") + F.col("words") >= F.col("rest")))
                 .groupBy("source").agg(F.min(F.struct("bucket", "before")).alias("e"))
                 .select("source", F.col("e.bucket").alias("edge"), F.col("e.before").alias("before")), "mix-edges")
    r = r.alias("r").join(edge.alias("e"), F.col("r.source").eqNullSafe(F.col("e.source")), "left") \
        .select("r.*", "e.edge", "e.before")
    inside = F.col("bucket") == F.col("edge")
    by_key = Window.partitionBy("source").orderBy("key", "id", "digest").rowsBetween(Window.unboundedPreceding, -1)
    at_edge = r.filter(inside).withColumn("left", F.col("rest") - F.col("before") - F.coalesce(F.sum(words).over(by_key), F.lit(0)))
    # Nearer with a copy than without: its middle lies before the target.
    fits = F.floor(F.try_divide(F.col("left"), F.col("size")) + 0.5)
    fits = F.when(F.col("size") == 0, F.when(F.col("left") >= 0, F.col("copies")).otherwise(0)).otherwise(fits)
    at_edge = at_edge.withColumn("more", F.least(F.greatest(fits, F.lit(0)), F.col("copies")).cast("long")).drop("left")
    before = F.coalesce(F.col("bucket") < F.col("edge"), F.lit(False))
    others = r.filter(~inside | F.col("edge").isNull()).withColumn("more", F.when(before, F.col("copies")).otherwise(0).cast("long"))
    each = at_edge.unionByName(others).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    epochs = (F.col("whole") + (F.col("copy") <= F.col("more")).cast("long")).cast("long")
    return each.select("id", "source", "size", "source_size", "target", epochs.alias("epochs"), (epochs * F.col("size")).alias("taken"), "digest")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **mix) -> DataFrame:
    """The mix itself: the rows of ``docs`` as often as it takes them, every column as it was, whatever its name.

    Rows that repeat an id, a source and a text are told apart by nothing: each
    is taken as often as the one of them that the mix takes most.  NULL and empty
    texts have no words, and are taken as their key has it.  An empty table stays
    empty.
    """
    found = mix_sources(docs, id_col, text_col, source_col, **mix).filter("epochs > 0") \
        .groupBy(F.col("id").alias("k_id"), F.col("source").alias("k_source"), F.col("digest").alias("k_digest")).agg(F.max("epochs").alias("k_epochs"))
    key, source, digest, copy = unused(docs, "__id", "__source", "__digest", "__copy")
    own = docs.select(*columns_of(docs), F.col(id_col).alias(key), F.col(source_col).alias(source),
                      F.unhex(F.md5(F.encode(text_of(text_col), "UTF-8"))).alias(digest))
    on = (own[key].eqNullSafe(found["k_id"])) & own[source].eqNullSafe(found["k_source"]) & (own[digest] == found["k_digest"])
    return (own.join(found, on).withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), found["k_epochs"])))
            .select(*columns_of(docs)))


def query(spark, sf_dir: str) -> DataFrame:
    """op3: mix of the whole ``documents`` table."""
    out = mix_sources(read_table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "epochs", "source")
