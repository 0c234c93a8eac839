"""Feature preparation and reproducible splits (h01-h23).

Splits are deterministic functions of a keyed hash (``md5_uniform``), so a
row lands in the same split whatever the partitioning or retry.  Exact
per-class quotas use distributed cumulative counts instead of a
``row_number`` window over a whole class (a class is half the table).
Statistics needed by a transform (means, bounds, quantiles) are one
aggregate row consumed through a scalar subquery.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.functions.exprs import md5_uniform, safe_div
from vigil.functions.ranks import (BROADCAST_ROWS, cumulative, exact_quantiles, join_null_safe,
                                  ordered_last_non_null, ordered_running_sums, range_slices)
from vigil.session import cut_lineage


# --------------------------------------------------------------------------- imputation

def mean_impute(df: DataFrame, cols: list[str], fit_on: DataFrame | None = None) -> DataFrame:
    """h01: NULL -> column mean.  ``fit_on`` (e.g. the training split) avoids the
    reference's leakage of computing the means before the split."""
    src = fit_on if fit_on is not None else df
    means = src.agg(F.struct(*[F.avg(c).alias(c) for c in cols])).scalar()  # one subquery
    return df.withColumns({c: F.coalesce(F.col(c), means.getField(c)).cast("double") for c in cols})


# --------------------------------------------------------------------------- splits

def _positions(df: DataFrame, key: str, strata: str | None, seed: int) -> DataFrame:
    """Per-stratum position (1-based) in keyed-hash order (a NULL stratum is one of its own; NULL keys share the
    hash 0)."""
    base, cum, _ = _hash_cells(df, key, strata, seed)
    before = cum.select("_s", "_u", (F.col("cum_n") - F.col("n")).alias("_before"))
    out = join_null_safe(base, before, ["_s", "_u"])
    # rows sharing a hash value (practically never) are ordered by key inside the cell
    w = Window.partitionBy("_s", "_u").orderBy(key)
    return out.withColumn("_pos", F.col("_before") + F.row_number().over(w)).drop("_before")


def _hash_cells(df: DataFrame, key: str, strata: str | None, seed: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows with stratum ``_s`` and hash ``_u``, running counts per (stratum, hash), stratum sizes)."""
    s = F.col(strata) if strata else F.lit("all")
    base = df.withColumn("_s", s.cast("string")).withColumn("_u", F.coalesce(md5_uniform(key, seed), F.lit(0.0)))
    # one row per (stratum, u): hashes are distinct per key
    cells = cut_lineage(base.groupBy("_s", "_u").agg(F.count("*").alias("n")))
    sizes = cells.groupBy("_s").agg(F.sum("n").alias("_n"))
    return base, cumulative(cells, ["_s"], "_u", ["n"]), sizes


def _first_rows(df: DataFrame, key: str, strata: str | None, shares: list[float], seed: int) -> DataFrame:
    """Flags ``_in0``, ``_in1``...: the row is among the first round(share * n) of its stratum in keyed-hash order.

    The rows are not numbered: the hash of the last row inside each quota is found on the cells, and every row
    compares its own hash with it.  Only rows of a cell that a quota cuts (equal keys) are ordered."""
    base, cum, sizes = _hash_cells(df, key, strata, seed)
    t = join_null_safe(cum, sizes, ["_s"]).withColumn("_before", F.col("cum_n") - F.col("n"))
    aggs = []
    for i, share in enumerate(shares):
        quota = F.round(F.col("_n") * share)
        last = (F.col("_before") < quota) & (quota <= F.col("cum_n"))
        aggs += [F.max(F.when(last, F.col("_u"))).alias(f"_u{i}"), F.max(F.when(last, quota - F.col("_before"))).alias(f"_need{i}"),
                 F.max(F.when(last, F.col("n"))).alias(f"_cell{i}")]
    cuts = cut_lineage(t.groupBy("_s").agg(*aggs))   # one row per stratum
    cut_cells = F.greatest(*[F.coalesce(F.col(f"_cell{i}") - F.col(f"_need{i}"), F.lit(0)) for i in range(len(shares))], F.lit(0))
    partial = not cuts.where(cut_cells > 0).isEmpty()
    x = join_null_safe(base, F.broadcast(cuts) if cuts.count() <= BROADCAST_ROWS else cuts, ["_s"])
    if partial:
        at_cut = F.coalesce(F.greatest(*[(F.col("_u") == F.col(f"_u{i}")).cast("int") for i in range(len(shares))], F.lit(0)), F.lit(0)) == 1
        number = F.row_number().over(Window.partitionBy("_s", "_u").orderBy(key))
        x = x.where(~at_cut).withColumn("_at", F.lit(0)).unionByName(x.where(at_cut).withColumn("_at", number))
    else:
        x = x.withColumn("_at", F.lit(0))
    inside = [F.coalesce((F.col("_u") < F.col(f"_u{i}")) | ((F.col("_u") == F.col(f"_u{i}")) & (F.col("_at") <= F.col(f"_need{i}"))),
                         F.lit(False)).alias(f"_in{i}") for i in range(len(shares))]
    return x.select(*[F.col(f"`{c}`") for c in df.columns], *inside)


def stratified_holdout(df: DataFrame, key: str, label: str | None, test_size: float = 0.2,
                       seed: int = 42) -> DataFrame:
    """h02 / h03: ``split`` = 'test' for the first round(test_size * n_class) rows of each
    class in hash order, else 'train'; without ``label`` the whole table is one stratum.
    Stratifies only when there is more than one class (as the reference)."""
    if label is not None:
        n_classes = df.agg(F.count_distinct(F.struct(label))).scalar()   # NULL is a class
        strat = F.when(n_classes > 1, F.col(label).cast("string")).otherwise(F.lit("all"))
        df = df.withColumn("_strat", strat)
    p = _first_rows(df, key, "_strat" if label is not None else None, [test_size], seed)
    out = p.withColumn("split", F.when(F.col("_in0"), "test").otherwise("train"))
    return out.drop("_in0", *(["_strat"] if label is not None else []))


def three_way_split(df: DataFrame, key: str, fractions=(0.7, 0.15, 0.15), label: str | None = None,
                    seed: int = 42) -> DataFrame:
    """h04: train / validation / test by position cut points (per class when ``label``)."""
    p = _first_rows(df, key, label, [fractions[0], fractions[0] + fractions[1]], seed)
    return p.withColumn("split", F.when(F.col("_in0"), "train").when(F.col("_in1"), "validation")
                        .otherwise("test")).drop("_in0", "_in1")


def temporal_split(df: DataFrame, date_col: str, t1, t2=None) -> DataFrame:
    """h05: <= t1 train, (t1, t2] validation, > t2 test."""
    d = F.col(date_col)
    expr = F.when(d <= F.lit(t1).cast("date"), "train")
    if t2 is not None:
        expr = expr.when(d <= F.lit(t2).cast("date"), "validation")
    return df.withColumn("split", expr.otherwise("test"))


def time_series_folds(df: DataFrame, date_col: str, n_splits: int = 5) -> DataFrame:
    """h06: expanding-window folds at day granularity.

    Days are ordered; a day's segment is floor(rows before it / test_size) capped
    at n_splits, test_size = n // (n_splits + 1).  Fold i trains on segments < i
    and tests on segment i (i = 1..n_splits).  Returns (date, segment) per day; the
    day table is tiny, so its running sum is an ordinary window.
    """
    days = df.groupBy(F.col(date_col).alias("day")).agg(F.count("*").alias("n"))
    n = days.agg(F.sum("n")).scalar()
    w = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)  # one row per day
    before = F.coalesce(F.sum("n").over(w), F.lit(0))
    size = F.floor(n / (n_splits + 1))
    return days.select("day", "n", F.least(F.floor(before / size), F.lit(n_splits)).cast("int").alias("segment"))


def fold_roles(segments: DataFrame, n_splits: int = 5) -> DataFrame:
    """h06 long form: (fold, role, day) for every fold that uses the day."""
    folds = F.sequence(F.lit(1), F.lit(n_splits))
    x = segments.select("*", F.explode(folds).alias("fold"))
    role = F.when(F.col("segment") < F.col("fold"), "train").when(F.col("segment") == F.col("fold"), "test")
    return x.select("fold", role.alias("role"), "day", "n").where(F.col("role").isNotNull())


def stratified_kfold(df: DataFrame, key: str, label: str, k: int = 5, seed: int = 42) -> DataFrame:
    """h07: fold = (position in class, hash order) - 1 mod k; feeds CrossValidator(foldCol=...)."""
    p = _positions(df, key, label, seed)
    return p.withColumn("fold", ((F.col("_pos") - 1) % k).cast("int")).drop("_s", "_u", "_pos")


# --------------------------------------------------------------------------- behavioural features

def rfm(tx: DataFrame, customer: str, ts: str, amount: str, as_of, windows=(30, 60, 90)) -> DataFrame:
    """h08 / h09: recency days, frequency, monetary, and counts / sums over trailing windows
    relative to ``as_of`` -- one grouped aggregate with conditional sums."""
    asof = F.lit(as_of).cast("date")
    d = F.to_date(ts)
    aggs = [F.datediff(asof, F.max(d)).alias("recency_days"), F.count("*").alias("frequency"),
            F.sum(amount).alias("monetary")]
    for w in windows:
        inside = (d > F.date_sub(asof, w)) & (d <= asof)
        aggs += [F.count_if(inside).alias(f"n_{w}d"),
                 F.coalesce(F.sum(F.when(inside, F.col(amount))), F.lit(0.0)).alias(f"amount_{w}d")]
    return tx.where(F.to_date(ts) <= asof).groupBy(customer).agg(*aggs)


def rolling_point_in_time(tx: DataFrame, customer: str, ts: str, amount: str, key: str,
                          days: int = 30) -> DataFrame:
    """h09 point-in-time variant: per row, the customer's amount and count over the preceding
    ``days`` (inclusive range on day number; all rows of a day are peers) and days since the
    previous transaction in (day, ts, key) order.

    A range frame on the day number covers whole days, so the windows run on one row per
    (customer, day) -- map-side aggregated, at most one row per calendar day however many
    rows a customer has.  The previous transaction of a day's first row is the previous day
    with data; later rows of the same day have 0.

    The day values go back to the rows through range slices of (customer, day, ts, key): the
    small table of (customer, day, slice) triples takes the day values, and rows join it on
    (customer, day, slice), so one customer-day with a third of all rows is still split."""
    dn = F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date"))
    x = range_slices(tx.withColumn("_dn", dn), [customer, "_dn"], [F.col(ts), F.col(key)])
    cells = x.groupBy(customer, "_dn").agg(F.sum(amount).alias("_a"), F.count("*").alias("_n"),
                                           F.min(F.struct(F.col(ts), F.col(key))).alias("_first"))
    w = Window.partitionBy(customer).orderBy("_dn").rangeBetween(-(days - 1), 0)
    roll = cells.select(customer, "_dn", "_first", F.sum("_a").over(w).alias(f"amount_{days}d"),
                        F.sum("_n").over(w).alias(f"n_{days}d"),
                        F.lag("_dn").over(Window.partitionBy(customer).orderBy("_dn")).alias("_prev"))
    parts = x.select(customer, "_dn", "_p").distinct()  # (#cells + #slices) rows at most
    by_slice = join_null_safe(parts, roll, [customer, "_dn"])  # NULL days are kept
    out = join_null_safe(x, by_slice, [customer, "_dn", "_p"]).drop("_p")
    first = F.struct(F.col(ts), F.col(key)) == F.col("_first")
    return out.withColumn("days_since_last", F.when(first, F.col("_dn") - F.col("_prev")).otherwise(F.lit(0))) \
        .drop("_dn", "_first", "_prev")


def calendar_parts(df: DataFrame, ts: str) -> DataFrame:
    """h10."""
    return df.withColumns({f"{ts}_weekday": F.dayofweek(ts), f"{ts}_month": F.month(ts),
                           f"{ts}_quarter": F.quarter(ts), f"{ts}_year": F.year(ts)})


def fixed_bands(df: DataFrame, col: str, cuts: list[float], name: str | None = None) -> DataFrame:
    """h11: fixed bands [cut_i, cut_i+1) -> band index (as MLlib Bucketizer, JVM-side)."""
    from pyspark.ml.feature import Bucketizer
    splits = [float("-inf"), *cuts, float("inf")]
    b = Bucketizer(splits=splits, inputCol=col, outputCol=name or f"{col}_band", handleInvalid="keep")
    return b.transform(df.withColumn(col, F.col(col).cast("double")))


def quantile_bins(df: DataFrame, col: str, q: int = 4) -> DataFrame:
    """h11: quartile (q-tile) bin from exact cut points: bin = 1 + number of cuts <= value."""
    long = df.select(F.lit(col).alias("feature"), F.col(col).cast("double").alias("value"))
    cuts = exact_quantiles(long, ["feature"], "value", [i / q for i in range(1, q)], max_groups=1)
    arr = cuts.groupBy("feature").agg(F.array_sort(F.collect_list("value_q")).alias("c")).select("c").scalar()
    v = F.col(col).cast("double")
    b = F.lit(1)
    for i in range(1, q):
        b = b + (v >= F.element_at(arr, i)).cast("int")
    return df.withColumn(f"{col}_q{q}", F.when(v.isNull(), F.lit(None)).otherwise(b))


def ratio_features(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """h12: a*b interactions and a/b ratios (NULL on zero division)."""
    cols = {}
    for a, b in pairs:
        cols[f"{a}_x_{b}"] = F.col(a) * F.col(b)
        cols[f"{a}_per_{b}"] = safe_div(a, b)
    return df.withColumns(cols)


def label_encode(df: DataFrame, col: str) -> tuple[DataFrame, DataFrame]:
    """h13: index by frequency desc, ties by value asc (StringIndexer's frequencyDesc order).
    Returns (encoded table, level table).  The level table has one row per level."""
    levels = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias("freq"))
    # row number over the level table in (freq desc, value) order: range slices, not one task
    # (a categorical column can have millions of levels)
    ranked = ordered_running_sums(levels.withColumn("_one", F.lit(1)), [], [F.col("freq").desc(), F.col(col)],
                                  ["_one"])
    levels = ranked.select(col, "freq", (F.col("cum__one") - 1).cast("double").alias(f"{col}_index"))
    levels = cut_lineage(levels)
    codes = levels.select(col, f"{col}_index")
    return df.join(F.broadcast(codes) if codes.count() <= BROADCAST_ROWS else codes, col, "left"), levels


def one_hot(df: DataFrame, col: str, levels: list[str]) -> DataFrame:
    """h13: one 0/1 column per known level (drop-last off)."""
    return df.withColumns({f"{col}_is_{lv}": (F.col(col) == F.lit(lv)).cast("int") for lv in levels})


def target_encode(df: DataFrame, col: str, target: str, smoothing: float = 0.0,
                  fold_col: str | None = None) -> DataFrame:
    """h14: (smoothed) target mean per level.  With ``fold_col`` each row is encoded from the
    other folds only (out-of-fold): level totals minus the row's own fold totals."""
    prior = df.agg(F.avg(target)).scalar()
    m = F.lit(float(smoothing))
    enc = lambda s, n: safe_div(s + m * prior, n + m)
    if fold_col is None:
        lv = df.groupBy(col).agg(F.sum(target).alias("_s"), F.count(target).alias("_c"))
        return df.join(lv.select(col, enc(F.col("_s"), F.col("_c")).alias(f"{col}_te")), col, "left")
    per = df.groupBy(col, fold_col).agg(F.sum(target).alias("_sf"), F.count(target).alias("_cf"))
    lv = per.groupBy(col).agg(F.sum("_sf").alias("_s"), F.sum("_cf").alias("_c"))
    oof = per.join(lv, col).select(col, fold_col,
                                   F.coalesce(enc(F.col("_s") - F.col("_sf"), F.col("_c") - F.col("_cf")), prior)
                                   .alias(f"{col}_te"))
    return df.join(oof, [col, fold_col], "left")


def scale(df: DataFrame, cols: list[str], method: str = "standard") -> DataFrame:
    """h15: standard (sample std), min-max, or robust (median / IQR, exact) scaling."""
    if method == "robust":
        from vigil.operators.profile import long_numeric, quartiles
        q = quartiles(long_numeric(df, cols), max_groups=len(cols))
        st = q.agg(*[F.max(F.when(F.col("feature") == c, F.struct("p25", "p50", "p75"))).alias(c)
                     for c in cols]).select(F.struct(*cols)).scalar()
        return df.withColumns({c: safe_div(F.col(c) - st.getField(c).getField("p50"),
                                           st.getField(c).getField("p75") - st.getField(c).getField("p25"))
                               for c in cols})
    if method == "minmax":
        st = df.agg(F.struct(*[F.struct(F.min(c).alias("lo"), F.max(c).alias("hi")).alias(c)
                               for c in cols])).scalar()
        return df.withColumns({c: safe_div(F.col(c) - st.getField(c).getField("lo"),
                                           st.getField(c).getField("hi") - st.getField(c).getField("lo"))
                               for c in cols})
    st = df.agg(F.struct(*[F.struct(F.avg(c).alias("mu"), F.stddev_samp(c).alias("sd")).alias(c)
                           for c in cols])).scalar()
    return df.withColumns({c: safe_div(F.col(c) - st.getField(c).getField("mu"), st.getField(c).getField("sd"))
                           for c in cols})


def missing_indicators(df: DataFrame, cols: list[str]) -> DataFrame:
    """h16."""
    return df.withColumns({f"{c}_missing": F.col(c).isNull().cast("int") for c in cols})


def iqr_clip(df: DataFrame, cols: list[str], k: float = 1.5) -> DataFrame:
    """h17: clip to [Q1 - k IQR, Q3 + k IQR] (exact quartiles)."""
    from vigil.operators.profile import long_numeric, quartiles
    q = quartiles(long_numeric(df, cols), (0.25, 0.75), max_groups=len(cols))
    st = q.agg(*[F.max(F.when(F.col("feature") == c, F.struct(
        (F.col("p25") - k * (F.col("p75") - F.col("p25"))).alias("lo"),
        (F.col("p75") + k * (F.col("p75") - F.col("p25"))).alias("hi")))).alias(c) for c in cols]) \
        .select(F.struct(*cols)).scalar()
    return df.withColumns({c: F.least(F.greatest(F.col(c).cast("double"), st.getField(c).getField("lo")),
                                      st.getField(c).getField("hi")) for c in cols})


def zscore_filter(df: DataFrame, cols: list[str], z: float = 3.0) -> DataFrame:
    """h17: keep rows with |z| <= limit on every column (NULLs kept)."""
    st = df.agg(F.struct(*[F.struct(F.avg(c).alias("mu"), F.stddev_samp(c).alias("sd")).alias(c)
                           for c in cols])).scalar()
    cond = F.lit(True)
    for c in cols:
        zc = F.abs(safe_div(F.col(c) - st.getField(c).getField("mu"), st.getField(c).getField("sd")))
        cond = cond & F.coalesce(zc <= z, F.lit(True))
    return df.where(cond)


def fill_categorical(df: DataFrame, cols: list[str], strategy: str = "mode") -> DataFrame:
    """h18: NULL -> most frequent value (ties by smallest) or 'Unknown'."""
    if strategy != "mode":
        return df.fillna("Unknown", cols)
    from vigil.operators.profile import long_string
    vc = long_string(df, cols).where(F.col("value").isNotNull()).groupBy("feature", "value").count()
    modes = vc.groupBy("feature").agg(F.min_by("value", F.struct((-F.col("count")).alias("c"),
                                                                 F.col("value").alias("v"))).alias("mode"))
    st = modes.agg(*[F.max(F.when(F.col("feature") == c, F.col("mode"))).alias(c) for c in cols]) \
        .select(F.struct(*cols)).scalar()
    return df.withColumns({c: F.coalesce(F.col(c).cast("string"), st.getField(c)) for c in cols})


def fill_numeric_median(df: DataFrame, cols: list[str]) -> DataFrame:
    """h18: NULL -> exact median."""
    from vigil.operators.profile import long_numeric, quartiles
    q = quartiles(long_numeric(df, cols), (0.5,), max_groups=len(cols))
    st = q.agg(*[F.max(F.when(F.col("feature") == c, F.col("p50"))).alias(c) for c in cols]) \
        .select(F.struct(*cols)).scalar()
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), st.getField(c)) for c in cols})


def _forward_fill_ranked(df: DataFrame, cols: list[str], entity: str, order: list[str]) -> DataFrame:
    """Forward fill over range slices of (entity, order) (``ordered_last_non_null``): a window per
    (entity, slice) plus the value carried in from the entity's earlier slices.  ``order`` must
    be total (end with a unique key)."""
    return ordered_last_non_null(df, [entity], [F.col(o) for o in order], cols)


def forward_fill(df: DataFrame, cols: list[str], entity: str, order: list[str]) -> DataFrame:
    """h18: last non-NULL value of the entity so far, over range slices of the order: no task holds a whole entity."""
    return _forward_fill_ranked(df, cols, entity, order)


def correlated_drop_list(corr: DataFrame, limit: float = 0.95) -> DataFrame:
    """h19: for each pair with |r| > limit (a < b), drop b."""
    return (corr.where((F.col("feature_a") < F.col("feature_b")) & (F.abs("r") > limit))
            .groupBy(F.col("feature_b").alias("drop")).agg(F.min("feature_a").alias("because_of"),
                                                           F.max(F.abs("r")).alias("abs_r")))


def log_skewed(df: DataFrame, cols: list[str], limit: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """h20: log1p of features whose (population) skewness exceeds ``limit``."""
    sk = df.agg(F.struct(*[F.skewness(c).alias(c) for c in cols])).scalar()
    out = df.withColumns({c: F.when(sk.getField(c) > limit, F.log1p(F.col(c))).otherwise(F.col(c).cast("double"))
                          for c in cols})
    report = df.agg(*[F.skewness(c).alias(c) for c in cols]).unpivot([], cols, "feature", "skewness") \
        .withColumn("transformed", F.col("skewness") > limit)
    return out, report


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """h21: balanced weight n / (k * n_class) per class."""
    c = df.groupBy(label).agg(F.count("*").alias("n_class"))
    s = c.agg(F.sum("n_class").alias("n"), F.count("*").alias("k"))
    n, k = s.select("n").scalar(), s.select("k").scalar()
    return c.withColumn("weight", n / (k * F.col("n_class")))


def undersample(df: DataFrame, key: str, label: str, seed: int = 42) -> DataFrame:
    """h21: keep each class with probability n_min / n_class by keyed hash (deterministic).  NULL is a class; the
    counts are broadcast up to BROADCAST_ROWS classes."""
    c = cut_lineage(df.groupBy(label).agg(F.count("*").alias("_nc")))
    n_min = c.agg(F.min("_nc")).scalar()
    counts = F.broadcast(c) if c.count() <= BROADCAST_ROWS else c
    u = md5_uniform(F.coalesce(F.col(key).cast("string"), F.lit("")), seed)    # a NULL key draws like an empty one
    return join_null_safe(df, counts, [label]).where(u < n_min / F.col("_nc")).drop("_nc")


def reweighing(df: DataFrame, group: str, label: str) -> DataFrame:
    """h21: weight n_group n_label / (n n_group_label) per (group, label), under which label and group are independent.

    One partial aggregate to (group, label) cells; sums of cells give the rest.  NULL is a group and a label.
    """
    cells = cut_lineage(df.groupBy(group, label).agg(F.count("*").alias("n_cell")))
    n = cells.agg(F.sum("n_cell")).scalar()
    by_group = cells.groupBy(group).agg(F.sum("n_cell").alias("n_group"))
    by_label = cells.groupBy(label).agg(F.sum("n_cell").alias("n_label"))
    out = join_null_safe(join_null_safe(cells, by_group, [group]), by_label, [label])
    return out.select(group, label, "n_cell", (F.col("n_group") * F.col("n_label") / (n * F.col("n_cell"))).alias("weight"))


def silver_normalise(df: DataFrame, casts: dict[str, str], text_cols: list[str], date_cols: list[str]) -> DataFrame:
    """h22: snake-case column names, try-casts (a bad value is NULL), trimmed lower-case text, dates.  The columns
    may be given by their old or new names."""
    def new(c: str) -> str:
        return re.sub(r"[^0-9a-zA-Z]+", "_", c).strip("_").lower()

    out = df.toDF(*[new(c) for c in df.columns])
    exprs = {new(c): F.col(new(c)).cast("string").try_cast(t) for c, t in casts.items()}
    exprs |= {new(c): F.lower(F.trim(F.col(new(c)))) for c in text_cols}
    exprs |= {new(c): F.col(new(c)).cast("string").try_cast("timestamp").cast("date") for c in date_cols}
    return out.withColumns(exprs)


def tfidf(docs: DataFrame, text: str, num_features: int = 1 << 18) -> DataFrame:
    """h23: tokens -> hashed term frequencies -> IDF (fitted over the whole corpus)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
    p = Pipeline(stages=[RegexTokenizer(inputCol=text, outputCol="_tok", pattern=r"\W+", minTokenLength=2),
                         HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=num_features),
                         IDF(inputCol="_tf", outputCol="tfidf")])
    return p.fit(docs).transform(docs).drop("_tok", "_tf")


def tfidf_terms(docs: DataFrame, doc_id: str, text: str, min_len: int = 2) -> DataFrame:
    """h23, exact long form: one row per (document, term) with tf (raw count), df (documents
    containing the term), idf = ln((N + 1) / (df + 1)) (MLlib's smoothed IDF) and tf x idf.

    Tokens are maximal runs of ASCII word characters (the same in every engine), lowercased,
    at least ``min_len`` long; whole texts.  Term counts and document frequencies are hash
    aggregates with map-side combine, so a frequent term is one partial row per task."""
    tok = F.explode(F.split(F.col(text), "[^A-Za-z0-9_]+")).alias("_w")
    words = docs.select(doc_id, tok).where(F.length("_w") >= min_len).select(doc_id, F.lower("_w").alias("term"))
    tf = words.groupBy(doc_id, "term").agg(F.count("*").alias("tf"))
    n_docs = docs.agg(F.count("*")).scalar()
    # Reads tf (never 0), so that both sides plan the same aggregate and its rows are shuffled once for both.
    dfreq = tf.groupBy("term").agg(F.count(F.when(F.col("tf") > 0, 1)).alias("df"))
    idf = F.ln((n_docs + 1) / (F.col("df") + 1))
    return tf.join(dfreq, "term").select(doc_id, "term", "tf", "df", idf.alias("idf"),
                                         (F.col("tf") * idf).alias("tfidf"))
