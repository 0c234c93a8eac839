"""Exact dedup by content-defined chunk recipes, in DataFrame functions only.

A text without its white space is cut into chunks whose ends depend on the
content alone.  The distinct chunks travel once, to verify that a chunk's hash
names one chunk; chunks that share a hash get an ordinal beside it.  A text is
then its recipe, the ordered list of its chunk identifiers, and texts are equal
when their recipes are: groups, winners and the join back move identifier
lists, never texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.llm.common import WHITE, columns_of, read_table, saved, text_of, unused

MIN_CHUNK, MAX_CHUNK = 400, 4000
#: A chunk ends after such three letters once it is long enough; a text without them is cut at MAX_CHUNK.
CUT = "[aeiou][lnrst][bcdfgh]"


def normalised(text: Column) -> Column:
    """The text after every ASCII white-space character is deleted."""
    return F.regexp_replace(text, WHITE + "+", "")


def _chunks(norm: Column, shortest: int, longest: int) -> Column:
    rule = f"(?s).{{{shortest},{longest - 3}}}?{CUT}|(?s).{{1,{longest}}}"
    return F.regexp_extract_all(norm, F.lit(rule), F.lit(0))


def chunk_recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = MIN_CHUNK,
                  longest: int = MAX_CHUNK, hash_bits: int = 64) -> DataFrame:
    """(id, n_chars, sha, hashes, ordinals) per row: the text's recipe of verified chunk identifiers.

    A chunk's identifier is its hash and, where several chunks share that hash,
    its ordinal among them.  ``hash_bits`` exists so that tests can force such
    clashes.  NULL and empty texts have the empty recipe.
    """
    norm = normalised(text_of(text_col))

    def hashed(c: Column) -> Column:
        return F.shiftrightunsigned(F.xxhash64(c), 64 - hash_bits) if hash_bits < 64 else F.xxhash64(c)

    chunks = _chunks(norm, shortest, longest)
    recipes = saved(docs.select(F.col(id_col).alias("id"), F.length(text_of(text_col)).cast("long").alias("n_chars"),
                                F.sha2(norm, 256).alias("sha"), F.transform(chunks, hashed).alias("hashes")), "recipes")
    distinct = (docs.select(F.explode(chunks).alias("chunk"))
                .groupBy(hashed(F.col("chunk")).alias("h"), "chunk").agg(F.count("*").alias("uses")))
    clashes = saved(distinct.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h"), "clashes")
    none = F.array().cast("array<int>")
    if clashes.isEmpty():
        return recipes.withColumn("ordinals", none)
    # Rare: chunks that share a hash are numbered per hash, and the recipes that hold them get the ordinals.
    c = docs.select(F.sha2(norm, 256).alias("sha"), F.posexplode(chunks).alias("pos", "chunk")) \
        .withColumn("h", hashed(F.col("chunk"))).join(clashes, "h", "left_semi")
    rank = c.select("h", "chunk").distinct().withColumn(
        "ordinal", F.row_number().over(Window.partitionBy("h").orderBy("chunk")))  # a group: chunks of one 64-bit hash
    marks = (c.distinct().join(rank, ["h", "chunk"]).groupBy("sha")
             .agg(F.array_sort(F.collect_list(F.struct("pos", "ordinal"))).alias("marks")))
    return (recipes.join(marks, "sha", "left")
            .withColumn("ordinals", F.coalesce(F.flatten(F.transform("marks", lambda m: F.array(m["pos"], m["ordinal"]))), none))
            .drop("marks"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **chunking) -> DataFrame:
    """One row per input row: (id, keep_id, group_size, kept, text_sha256, n_chars).

    Texts are equal when equal without ASCII white space.  The row with the
    most code points in the original text stays, then the smallest id (a NULL
    id is the smallest).  NULL counts as empty; empty texts are one group.
    Rows that repeat an id and a text are one document and share its decision.
    Other columns are ignored.  Group sizes and winners come from a partial
    aggregation, so a hot group is one row per task before the shuffle; the
    join back is a plain sort-merge join, which adaptive execution splits.
    """
    recipes = chunk_recipes(docs, id_col, text_col, **chunking)
    best = F.min(F.struct((-F.col("n_chars")).alias("fewest"), F.col("id").alias("id")))
    groups = recipes.groupBy("hashes", "ordinals").agg(best.alias("best"), F.count("*").alias("group_size"))
    return (recipes.join(groups, ["hashes", "ordinals"])
            .select(F.col("id"), F.col("best.id").alias("keep_id"), "group_size",
                    (F.col("id").eqNullSafe(F.col("best.id")) & (F.col("n_chars") == -F.col("best.fewest"))).alias("kept"),
                    F.col("sha").alias("text_sha256"), "n_chars"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, every column as it was, whatever its name.

    As in ``exact_dedup``: NULL and empty texts are one group, of equal texts the longest original stays and then the
    smallest id, NULL before all others; of rows that repeat an id and a text one stays.  An empty table stays empty.
    """
    found = exact_dedup(docs, id_col, text_col)
    key, sha, n = unused(docs, "__key", "__sha", "__n")
    # Structs compare their NULLs as equal, so one exchange by the key serves the repeats and the join, and texts move
    # once; of repeated rows every task sends one.  The join is an inner one, as a semi-join is planned below the aggregate.
    kept = found.filter("kept").select(F.struct("id").alias(key), F.col("text_sha256").alias(sha), F.col("n_chars").alias(n)).distinct()
    own = docs.select(*columns_of(docs), F.struct(F.col(id_col).alias("id")).alias(key),
                      F.coalesce(F.sha2(normalised(text_of(text_col)), 256), F.lit("")).alias(sha),    # never NULL: no filter hashes again
                      F.length(text_of(text_col)).cast("long").alias(n))
    return own.dropDuplicates([key, sha, n]).join(kept, [key, sha, n]).drop(key, sha, n)


# ---- the registered query ----

ORACLE_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_chars,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept,
       sha256(norm) AS text_sha256
FROM t
WINDOW w AS (PARTITION BY norm ORDER BY n_chars DESC, doc_id)
"""


def query(spark, sf_dir: str) -> DataFrame:
    """op6: exact dedup of the whole ``documents`` table."""
    found = exact_dedup(read_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")
