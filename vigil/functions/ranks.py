"""Order statistics without single-task windows.

Rank-based operators (exact quantiles, two-sample KS, Mann-Whitney, AUC,
Spearman) all need, per group (feature), the cumulative count of rows up to
each distinct value.  A ``Window.partitionBy(feature).orderBy(value)`` does
this in one task per feature -- a feature *is* a third (or all) of the rows.

``cumulative`` instead works on the collapsed table of (group, value, counts)
(a hot value is one row after the map-side partial aggregation) and splits
every group into value buckets cut at approximate quantiles:

1. the cells are written once to the shared folder and counted; their number
   gives the number of buckets (CELLS_PER_BUCKET cells each), and a table that
   fits one bucket takes the plain window at once;
   bounds per group: ``percentile_approx`` of the values (one small row per
   group), written too, so that every later branch sees the same cuts;
2. per (group, bucket) totals -> running offsets over the small bucket table;
3. per (group, bucket) running sums ordered by value -- each task holds one
   bucket, about 1/B of a group;
4. cumulative = local running sum + bucket offset.

With ``buckets=1`` it is the plain window (fine for small groups).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigil.session import cut_lineage


# Cells (distinct values of a group) that one bucket holds on average.
CELLS_PER_BUCKET = 100_000


def _sized(cells: DataFrame, buckets: int | None) -> tuple[DataFrame, int]:
    """The cells, computed once, and the number of buckets that their count asks for."""
    if buckets is not None:
        return cells, buckets
    cells = cut_lineage(cells)
    return cells, max(1, -(-cells.count() // CELLS_PER_BUCKET))


def cumulative(cells: DataFrame, keys: list[str], value: str, counts: list[str],
               buckets: int | None = None, accuracy: int = 10000, with_next: bool = False,
               max_groups: int | None = None) -> DataFrame:
    """Add ``cum_<c>`` (inclusive running sum ordered by ``value`` within ``keys``)
    for every count column ``c`` of a table with one row per (keys, value).
    ``with_next`` also adds ``next_value``: the next larger value of the group.
    ``max_groups``: a bound on the number of groups known to the caller (e.g. the number of
    unpivoted columns); without it the groups are counted."""
    cells, b = _sized(cells, buckets)
    if b <= 1:
        w = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
        extra = [F.lead(value).over(Window.partitionBy(*keys).orderBy(value)).alias("next_value")] if with_next else []
        return cells.select("*", *[F.sum(c).over(w).alias(f"cum_{c}") for c in counts], *extra)

    tagged, side = _bucket_cells(cells, keys, value, b, accuracy, max_groups)
    tot = tagged.groupBy(*keys, "_bk").agg(*[F.sum(c).alias(f"_t_{c}") for c in counts],
                                           F.min(value).alias("_mn"))
    wo = Window.partitionBy(*keys).orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
    wn = Window.partitionBy(*keys).orderBy("_bk")
    off = tot.select(*keys, "_bk", *[F.coalesce(F.sum(f"_t_{c}").over(wo), F.lit(0)).alias(f"_o_{c}")
                                     for c in counts],
                     F.lead("_mn").over(wn).alias("_next_mn"))
    wl = Window.partitionBy(*keys, "_bk").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    extra = [F.lead(value).over(Window.partitionBy(*keys, "_bk").orderBy(value)).alias("_lead")] if with_next else []
    local = tagged.select("*", *[F.sum(c).over(wl).alias(f"_l_{c}") for c in counts], *extra)
    out = join_null_safe(local, side(off), [*keys, "_bk"])
    nxt = [F.coalesce("_lead", "_next_mn").alias("next_value")] if with_next else []
    return out.select(*cells.columns,
                      *[(F.col(f"_l_{c}") + F.col(f"_o_{c}")).alias(f"cum_{c}") for c in counts], *nxt)


def value_cells(long: DataFrame, keys: list[str], value: str,
                label: str | None = None, labels: tuple = ()) -> DataFrame:
    """Collapse a long table to one row per (keys, value) with a count per label
    (``n_<label>``) and the total ``n``."""
    aggs = [F.count("*").alias("n")]
    for lab in labels:
        aggs.append(F.count_if(F.col(label) == F.lit(lab)).alias(f"n_{lab}"))
    return long.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(*aggs)


def exact_quantiles(long: DataFrame, keys: list[str], value: str, probs: list[float],
                    buckets: int | None = None, max_groups: int | None = None) -> DataFrame:
    """Exact linear-interpolation quantiles (pandas / ``quantile_cont``) per group.
    Returns one row per (keys, q) with column ``value_q``."""
    return quantiles_from_cells(value_cells(long, keys, value), keys, value, probs, buckets, max_groups)


# Side tables with up to this many rows (groups x buckets) are broadcast; above it they join
# by shuffle (AQE may still broadcast them at run time if they turn out small).
BROADCAST_ROWS = 200_000


def _bucket_cells(cells: DataFrame, keys: list[str], value: str, b: int, accuracy: int = 10000,
                  max_groups: int | None = None):
    """Tag every cell with ``_bk``: its value bucket, cut at ``percentile_approx`` bounds
    (checkpointed: every branch sees the same cuts).  Also returns how per-(group, bucket)
    side tables join: broadcast when groups x buckets is within ``BROADCAST_ROWS`` (groups are
    usually features or segments): the caller's bound ``max_groups`` or, without one, a count
    of the small checkpointed bounds table."""
    qs = [i / b for i in range(1, b)]
    # the sketch's error must stay below a bucket
    bounds = cut_lineage(cells.groupBy(*keys).agg(
        F.percentile_approx(F.col(value).cast("double"), qs, max(accuracy, 10 * b)).alias("_bounds")))
    small = (max_groups if max_groups is not None else bounds.count()) * b <= BROADCAST_ROWS
    side = F.broadcast if small else (lambda d: d)
    v = F.col(value).cast("double")
    # number of bounds below the value, by binary search: steps of falling powers of two
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(b.bit_length()))])
    below = F.aggregate(steps, F.lit(0), lambda at, step: at + F.when(F.get("_bounds", at + step - 1) < v, step).otherwise(0))
    tagged = join_null_safe(cells, side(bounds), keys).withColumn("_bk", below).drop("_bounds")
    return tagged, side


def quantiles_from_cells(cells: DataFrame, keys: list[str], value: str, probs: list[float],
                         buckets: int | None = None, max_groups: int | None = None) -> DataFrame:
    """Quantiles from (keys, value, n) cells: the value at 0-based index i is the one with
    cum_before <= i < cum; linear interpolation between indices floor(pos) and ceil(pos).

    Selection rather than a full running sum: per-(group, bucket) totals give each bucket's
    index range, so only the buckets that hold a wanted index (at most two per quantile) are
    sorted -- a small share of the cells when the bucket count is large."""
    cells, b = _sized(cells, buckets)
    if b <= 1:
        return _quantiles_full(cells, keys, value, probs, b)
    tagged, side = _bucket_cells(cells, keys, value, b, max_groups=max_groups)
    tot = tagged.groupBy(*keys, "_bk").agg(F.sum("n").alias("_t"))
    wo = Window.partitionBy(*keys).orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
    off = tot.select(*keys, "_bk", "_t", F.coalesce(F.sum("_t").over(wo), F.lit(0)).alias("_o"),
                     F.sum("_t").over(Window.partitionBy(*keys)).alias("_N"))  # (group, bucket) rows
    qs = off.select(*keys, "_bk", "_t", "_o", "_N",
                    F.explode(F.array(*[F.lit(float(q)) for q in probs])).alias("q"))
    qs = qs.withColumn("_pos", F.col("q") * (F.col("_N") - 1)) \
        .withColumn("_i0", F.floor("_pos")).withColumn("_i1", F.ceil("_pos"))
    inside = lambda i: (F.col("_o") <= F.col(i)) & (F.col(i) < F.col("_o") + F.col("_t"))
    want = qs.where(inside("_i0") | inside("_i1")).select(*keys, "_bk", "_o", "q", "_pos", "_i0", "_i1")
    # groups x quantiles x 2 rows at most
    sel = join_null_safe(tagged, side(want.select(*keys, "_bk", "_o").distinct()), [*keys, "_bk"])
    wl = Window.partitionBy(*keys, "_bk").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    c = sel.select(*keys, "_bk", F.col(value).cast("double").alias("_v"),
                   (F.sum("n").over(wl) + F.col("_o")).alias("_hi"), "n")
    c = c.withColumn("_lo", F.col("_hi") - F.col("n"))
    return _pick(join_null_safe(c, side(want.drop("_o")), [*keys, "_bk"]), keys)


def _pick(j: DataFrame, keys: list[str]) -> DataFrame:
    hit0 = (F.col("_lo") <= F.col("_i0")) & (F.col("_i0") < F.col("_hi"))
    hit1 = (F.col("_lo") <= F.col("_i1")) & (F.col("_i1") < F.col("_hi"))
    picked = (j.where(hit0 | hit1)
              .groupBy(*keys, "q", "_pos", "_i0")
              .agg(F.max(F.when(hit0, F.col("_v"))).alias("_v0"), F.max(F.when(hit1, F.col("_v"))).alias("_v1")))
    return picked.select(*keys, "q", (F.col("_v0") + (F.col("_v1") - F.col("_v0")) * (F.col("_pos") - F.col("_i0")))
                         .alias("value_q"))


def _quantiles_full(cells: DataFrame, keys: list[str], value: str, probs: list[float], b: int) -> DataFrame:
    cum = cumulative(cells, keys, value, ["n"], b)
    tot = cells.groupBy(*keys).agg(F.sum("n").alias("_N"))
    qrows = tot.select(*keys, "_N", F.explode(F.array(*[F.lit(float(q)) for q in probs])).alias("q"))
    qrows = qrows.select(*keys, "q", (F.col("q") * (F.col("_N") - 1)).alias("_pos"))
    qrows = qrows.select(*keys, "q", "_pos", F.floor("_pos").alias("_i0"), F.ceil("_pos").alias("_i1"))
    c = cum.select(*keys, F.col(value).cast("double").alias("_v"),
                   (F.col("cum_n") - F.col("n")).alias("_lo"), F.col("cum_n").alias("_hi"))
    return _pick(join_null_safe(c, qrows, keys), keys)  # groups x quantiles rows


def range_slices(df: DataFrame, keys: list[str], order: list, partitions: int | None = None) -> DataFrame:
    """Rows range-partitioned on (keys, order) and tagged with their slice ``_p`` (slices are
    contiguous in that order); checkpointed, so every consumer and every retry sees the same
    slices.  A hot key spans many slices."""
    by = [*[F.col(k) for k in keys], *order]
    x = df.repartitionByRange(*([partitions] if partitions else []), *by).withColumn("_p", F.spark_partition_id())
    return cut_lineage(x)


def ordered_running_sums(df: DataFrame, keys: list[str], order: list, flags: list[str],
                         partitions: int | None = None) -> DataFrame:
    """Inclusive running sums ``cum_<f>`` of the numeric columns ``flags`` within ``keys``
    in a composite ``order`` (a list of columns; the last one must make the order total,
    e.g. an item id).  ``row_number()`` is the running sum of a column of ones.

    ``cumulative`` buckets on one numeric value; here the order is composite and one key
    (or one tie of the leading order column) may hold a large share of the rows, so the
    rows are range-partitioned on (keys, order).  Spark samples the composite key for the
    range bounds, so a hot key spans many slices.  Each row is tagged with its slice and
    the tagged rows are checkpointed (both branches below read the same slices; retries
    cannot move a row to another slice).  Running sums run per (keys, slice) -- at most one
    range partition per task -- and a small per-(keys, slice) table of preceding totals
    completes them."""
    x = range_slices(df, keys, order, partitions)
    w = Window.partitionBy(*keys, "_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = x.select("*", *[F.sum(f).over(w).alias(f"_l_{f}") for f in flags])
    tot = x.groupBy(*keys, "_p").agg(*[F.sum(f).alias(f"_t_{f}") for f in flags])
    wo = Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    # one row per (key, slice): at most (#keys + #slices) rows; a hot key has one row per slice
    off = tot.select(*keys, "_p", *[F.coalesce(F.sum(f"_t_{f}").over(wo), F.lit(0)).alias(f"_o_{f}")
                                    for f in flags])
    out = join_null_safe(local, off, [*keys, "_p"])  # NULL is a key like any other
    return out.select(*df.columns, *[(F.col(f"_l_{f}") + F.col(f"_o_{f}")).alias(f"cum_{f}") for f in flags])


def join_null_safe(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``on`` where NULL keys match (the right copies of the keys are dropped)."""
    r = right.withColumnsRenamed({c: f"_r_{c}" for c in on})
    cond = None
    for c in on:
        e = F.col(c).eqNullSafe(F.col(f"_r_{c}"))
        cond = e if cond is None else cond & e
    out = left.join(r, cond, how)
    return out if how in ("left_semi", "left_anti") else out.drop(*[f"_r_{c}" for c in on])


def ordered_previous(df: DataFrame, keys: list[str], order: list, cols: list[str],
                     partitions: int | None = None) -> DataFrame:
    """``lag``: adds ``prev_<c>`` (the value of ``c`` on the previous row within ``keys`` in the
    total ``order``; NULL on a key's first row) and ``pos`` (1-based row number).

    Positions come from ``ordered_running_sums``; the previous row is found by an equi-join
    on (keys, pos) = (keys, pos + 1).  Positions are unique within a key, so the join is
    spread evenly however large a key is."""
    pos = ordered_running_sums(df.withColumn("_one", F.lit(1)), keys, order, ["_one"], partitions) \
        .withColumnRenamed("cum__one", "pos").drop("_one")
    prev = pos.select(*keys, (F.col("pos") + 1).alias("pos"), *[F.col(c).alias(f"prev_{c}") for c in cols])
    return join_null_safe(pos, prev, [*keys, "pos"], "left")


def ordered_last_non_null(df: DataFrame, keys: list[str], order: list, cols: list[str],
                          partitions: int | None = None) -> DataFrame:
    """Forward fill: every column of ``cols`` replaced by its last non-NULL value so far within
    ``keys`` in the total ``order`` (ascending columns).  Inside a range slice a window carries
    the value; the value carried into a slice is the last non-NULL one of the key's earlier
    slices, from a table with one row per (key, slice).  Every join and window is per
    (key, slice)."""
    x = range_slices(df, keys, order, partitions)
    w = Window.partitionBy(*keys, "_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = x.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in cols})
    last_in = x.groupBy(*keys, "_p").agg(
        *[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.struct(*order))).alias(f"_l_{c}") for c in cols])
    wc = Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    carry = last_in.select(*keys, "_p", *[F.last(f"_l_{c}", ignorenulls=True).over(wc).alias(f"_c_{c}")
                                          for c in cols])
    y = join_null_safe(local, carry, [*keys, "_p"], "left")
    return y.select(*[F.coalesce(F.col(c), F.col(f"_c_{c}")).alias(c) if c in cols else F.col(c)
                      for c in df.columns])
