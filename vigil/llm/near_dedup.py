"""Near-duplicate classes: BagMinHash signatures, banding and exact verification of multiset overlap.

A text is the multiset of its five-word shingles.  Equal texts are one node.
Nodes that agree in a band of the signature are candidates; a link is a
weighted Jaccard similarity of at least 0.8, computed on the whole multisets.
Classes are the connected components of the links.

No bucket is expanded into pairs.  First every bucket tests its members against
its hub, the member that shares most buckets, which joins a large group of
copies in one linear step.  Links inside a class change nothing, so afterwards
only members outside a bucket's main class are tested against its other
members, block against block, with the members' texts moved once per block.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.bagminhash import signatures
from vigil.llm.common import columns_of, read_table, saved, shingle_words, text_of, unused
from vigil.llm.components import components

WIDTH = 5
SIMILARITY = 0.8
BANDS, ROWS = 20, 4
#: Shingles whose texts one verification group holds on its fixed side.
BLOCK_SHINGLES = 200_000
#: Entries (of 80) in which a pair must agree to be verified: 5.6 standard deviations below the mean at 0.8.
LEAST_AGREE = 44
#: Documents signed at once.
SIGN_AT_ONCE = 256


def bag_of(text: str, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes, ascending; how often each occurs)."""
    return np.unique(shingle_words(text.encode("utf-8", "surrogatepass"), width), return_counts=True)


def _similar(a, b, size_a: int, size_b: int, least: float) -> bool:
    (ka, na), (kb, nb) = a, b
    if not len(ka) or not len(kb):
        return False
    if len(ka) < len(kb):
        ka, na, kb, nb = kb, nb, ka, na
    at = np.minimum(np.searchsorted(ka, kb), len(ka) - 1)
    same = ka[at] == kb
    shared = int(np.minimum(na[at[same]], nb[same]).sum())
    return shared >= least * (size_a + size_b - shared) - 1e-9


def signed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, t, copy_of, n, bands) per row: 128-bit keys of the text and of its word sequence, the number of shingles, the
    signature packed four entries to a band.  Ids travel as text, as pandas makes whole numbers beside NULLs floats."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for start in range(0, len(whole), SIGN_AT_ONCE):
                pdf = whole.iloc[start:start + SIGN_AT_ONCE]
                raw = [t.encode("utf-8", "surrogatepass") for t in pdf["text"]]
                bags = [np.unique(shingle_words(r, WIDTH), return_counts=True) for r in raw]
                sizes = np.array([len(k) for k, _ in bags])
                sig = signatures(np.concatenate([k for k, _ in bags]), np.concatenate([n for _, n in bags]), sizes, BANDS * ROWS)
                yield pd.DataFrame({"id": pdf["id"], "t": pdf["t"], "copy_of": [blake2b(b" ".join(r.split()), digest_size=16).digest() for r in raw],
                                    "n": [int(n.sum()) for _, n in bags], "bands": list(np.ascontiguousarray(sig).view("<i8"))})

    return (docs.select(F.col(id_col).cast("string").alias("id"), _text_key(text_col).alias("t"), text_of(text_col).alias("text"))
            .mapInPandas(run, "id string, t binary, copy_of binary, n long, bands array<bigint>")
            .withColumn("id", F.col("id").cast(kind)))


def _text_key(text_col: str):
    return F.unhex(F.md5(F.encode(text_of(text_col), "UTF-8")))


def _links(rows: DataFrame, keys: list[str], kind: str, least: float) -> DataFrame:
    """Links (u, v) between the fixed (side 0) and the passing (side 1) members of every group ``keys``.

    Rows: the keys, side, id, n, text, and for buckets also class, band and
    bands.  A group's fixed members are read first and held, bounded by
    BLOCK_SHINGLES (or one document); the passing ones stream by.  In a bucket
    a pair is verified in its first common band only, and pairs that the links
    found so far already join are passed over.
    """
    buckets = "band" in rows.columns
    where = [*keys, "side", "id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, fixed, marks, root = None, [], None, {}

        def find(c):
            while root.get(c, c) != c:
                c = root[c]
            return c

        for pdf in batches:
            found = []
            bands = np.stack(pdf["bands"].to_numpy()).astype("<i8") if buckets else None
            for i, (key, side, doc, n, text) in enumerate(zip(zip(*[pdf[k] for k in keys]), pdf["side"], pdf["id"], pdf["n"], pdf["text"])):
                if key != group:
                    group, fixed, marks, root = key, [], None, {}
                if side == 0:
                    fixed.append((doc, n, bag_of(text), pdf["class"].iat[i] if buckets else doc, bands[i] if buckets else None))
                    continue
                if not fixed:
                    continue
                own, mine = None, pdf["class"].iat[i] if buckets else doc
                if buckets:
                    if marks is None:
                        marks = np.stack([f[4] for f in fixed])
                    band = int(pdf["band"].iat[i])
                    earlier = (marks[:, :band] == bands[i][:band]).any(axis=1)
                    agree = (marks.view("<u2") == bands[i].view("<u2")).sum(axis=1)
                    maybe = np.flatnonzero(~earlier & (agree >= LEAST_AGREE))
                else:
                    maybe = range(len(fixed))
                for k in maybe:
                    other, size, bag, theirs, _ = fixed[k]
                    if other == doc or min(n, size) < least * max(n, size) - 1e-9 or find(mine) == find(theirs):
                        continue
                    own = own or bag_of(text)
                    if _similar(own, bag, n, size, least):
                        found.append((doc, other))
                        root[find(mine)] = find(theirs)
            yield pd.DataFrame(found, columns=["u", "v"])

    spread = rows.repartition(*keys).sortWithinPartitions(*where)
    return spread.mapInPandas(run, f"u {kind}, v {kind}")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY,
                    text_key: bool = False) -> DataFrame:
    """One row per input row: (id, class_id, kept, n_shingles); ``class_id`` is the smallest id of the class, and its
    row stays.

    Words are runs without ASCII white space; a text of fewer than five words
    is one shingle, and texts with equal words are always one class, empty and
    NULL texts among them.  Texts are told apart by their words, not by their
    id: rows that repeat an id share a class if their texts are near.  Of several
    rows with the class's id the text with the smallest MD5 stays (rows that
    repeat an id and a text are one document).  A NULL id comes after all
    others, and is the class's where it has no other.  ``text_key`` adds the text's MD5 as ``t``.  The banding misses a pair at exactly 0.8 once in 40,000, closer pairs less.
    """
    rows = saved(signed(docs, id_col, text_col), "signed")
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "t"))
    # From here on a node's ``id`` is the key of its words; ``first`` is the row that stands for it.
    nodes = saved(rows.groupBy("copy_of").agg(first.alias("first"), F.first("n").alias("n"), F.first("bands").alias("bands"))
                  .withColumnRenamed("copy_of", "id"), "nodes")
    kind = "binary"
    members = nodes.filter("n > 0").select("id", "n", F.posexplode("bands").alias("band", "key"))
    sizes = members.groupBy("band", "key").agg(F.count("*").alias("members")).filter("members > 1")
    shared = saved(members.join(sizes, ["band", "key"]), "shared")
    wanted = nodes.join(shared.select("id").distinct(), "id", "left_semi").select("id", F.col("first.id").alias("doc"), F.col("first.t").alias("t"))
    own = docs.select(F.col(id_col).alias("own_doc"), _text_key(text_col).alias("own_t"), text_of(text_col).alias("text"))
    texts = wanted.join(own, F.col("doc").eqNullSafe(F.col("own_doc")) & (F.col("t") == F.col("own_t")))
    texts = saved(texts.select("id", "text").dropDuplicates(["id"]), "shared-texts")

    # One hub per bucket: the member with most company, ties by hash and then id.
    company = saved(shared.groupBy("id").agg(F.sum("members").alias("company")), "company")
    hubs = (shared.join(company, "id").groupBy("band", "key")
            .agg(F.max(F.struct("company", F.xxhash64("id").alias("h"), "id", "n")).alias("hub")))
    hubs = saved(hubs, "hubs")
    tests = (shared.join(hubs.select("band", "key", F.col("hub.id").alias("hub"), F.col("hub.n").alias("hub_n")), ["band", "key"])
             .filter((F.col("id") != F.col("hub")) & (F.least("n", "hub_n") >= least * F.greatest("n", "hub_n") - 1e-9))
             .select("hub", "hub_n", "id", "n").distinct())
    tests = saved(tests.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(64)).cast("int")), "tests")
    fixed = tests.select("hub", "block", F.lit(0).alias("side"), F.col("hub").alias("id"), F.col("hub_n").alias("n")).distinct()
    passing = tests.select("hub", "block", F.lit(1).alias("side"), "id", "n")
    links = saved(_links(fixed.union(passing).join(texts, "id"), ["hub", "block"], kind, least), "hub-links")
    classes = saved(components(links), "hub-classes")

    # What a bucket has outside its main class, against all that it has.
    known = shared.filter("members > 2").join(classes.select(F.col("node").alias("id"), "root"), "id", "left") \
        .withColumn("class", F.coalesce("root", "id")).drop("root")
    known = saved(known, "known")
    per_class = known.groupBy("band", "key", "class").agg(F.sum("n").alias("shingles"))
    split = (per_class.groupBy("band", "key").agg(F.max(F.struct("shingles", "class")).alias("main"), F.sum("shingles").alias("all"),
                                                  F.count("*").alias("classes"))
             .filter("classes > 1").select("band", "key", F.col("main.class").alias("main"),
                                           F.ceil((F.col("all") - F.col("main.shingles")) / BLOCK_SHINGLES).alias("fixed_blocks"),
                                           F.ceil(F.col("all") / (4 * BLOCK_SHINGLES)).alias("passing_blocks")))
    open_ = saved(known.join(saved(split, "split"), ["band", "key"]), "open")
    block = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    columns = ["band", "key", "fixed_block", "passing_block", "side", "id", "n", "class"]
    fixed = open_.filter(F.col("class") != F.col("main")).withColumns({"fixed_block": block("fixed_blocks", 1), "side": F.lit(0)}) \
        .withColumn("passing_block", every("passing_blocks")).select(*columns)
    passing = open_.withColumns({"passing_block": block("passing_blocks", 2), "side": F.lit(1)}) \
        .withColumn("fixed_block", every("fixed_blocks")).select(*columns)
    full = fixed.unionByName(passing).join(texts, "id").join(nodes.select("id", "bands"), "id")
    more = _links(full, ["band", "key", "fixed_block", "passing_block"], kind, least)
    classes = saved(components(links.union(saved(more, "block-links"))), "classes")

    member = saved(nodes.select("id", "first").join(classes.select(F.col("node").alias("id"), "root"), "id", "left")
                   .select("id", "first", F.coalesce("root", "id").alias("root")), "members")
    stays = saved(member.groupBy("root").agg(F.min("first").alias("stays")), "stays")
    of_node = saved(member.join(stays, "root").select(F.col("id").alias("copy_of"), "stays"), "class-of")
    return (rows.select("id", "t", "copy_of", "n").join(of_node, "copy_of")
            .select("id", F.col("stays.id").alias("class_id"),
                    (F.col("id").eqNullSafe(F.col("stays.id")) & (F.col("t") == F.col("stays.t"))).alias("kept"),
                    F.col("n").alias("n_shingles"), *([F.col("t")] if text_key else [])))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of every class, every column as it was, whatever its name.

    As in ``near_duplicates``: texts with equal words (empty and NULL ones among them) are one class, the row with the
    smallest id stays, NULL behind all others; of rows that repeat an id and a text one stays.  An empty table stays
    empty.
    """
    key, own_t = unused(docs, "__id", "__t")
    kept = near_duplicates(docs, id_col, text_col, text_key=True).filter("kept").select(F.col("id").alias("k_id"), F.col("t").alias("k_t")).distinct()
    own = docs.select(*columns_of(docs), F.col(id_col).alias(key), _text_key(text_col).alias(own_t)).dropDuplicates([key, own_t])
    return own.join(kept, own[key].eqNullSafe(kept["k_id"]) & (own[own_t] == kept["k_t"]), "left_semi").drop(key, own_t)


def query(spark, sf_dir: str) -> DataFrame:
    """op5: near-duplicate classes of the whole ``documents`` table."""
    return near_duplicates(read_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
