"""Aggregation operators.

All are hash aggregates with a map-side partial step, so a hot group is
pre-summed in every task before the shuffle and never sits in one task as
raw rows. Where a result is joined back (shares, weights) the join side
is an aggregate; AQE broadcasts it at run time when it measures small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicframe.operators.windows import numbered, numbered_many


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def sum_by(df: DataFrame, group_cols, value, out: str = "total") -> DataFrame:
    """A1: sum of durations (or any value) per group."""
    return df.groupBy(*group_cols).agg(F.sum(_c(value)).alias(out))


def two_level_mean(df: DataFrame, inner_keys, outer_keys, value, total: str = "total",
                   mean: str = "mean_total", count: str = "n") -> DataFrame:
    """A2: sum per inner group (e.g. per day), then the mean of those sums per
    outer group (e.g. per weekday). ``outer_keys`` must be columns of the
    inner result (derive them from the inner keys first)."""
    inner = df.groupBy(*inner_keys).agg(F.sum(_c(value)).alias(total))
    return inner.groupBy(*outer_keys).agg(F.avg(total).alias(mean), F.count(F.lit(1)).alias(count))


def describe_by(df: DataFrame, group_cols, cols) -> DataFrame:
    """A3: mean, min and max of several columns per group."""
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"avg_{c}"), F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}")]
    return df.groupBy(*group_cols).agg(*aggs)


def frequency(df: DataFrame, cols, out: str = "n") -> DataFrame:
    """A5: frequency table, most common first (ties by value)."""
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias(out)) \
        .orderBy(F.desc(out), *[F.asc_nulls_last(c) for c in cols])


def repeated_groups(df: DataFrame, cols, out: str = "n") -> DataFrame:
    """Groups with more than one row (HAVING count > 1)."""
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias(out)).where(F.col(out) > 1)


def collapse(df: DataFrame, group_cols, value_col, out: str, sep: str = ", ",
             distinct: bool = True) -> DataFrame:
    """A group's values as one sorted string. Only for value sets with a
    known small bound per group (years, categories): the set is built in the
    aggregate buffer."""
    v = _c(value_col).cast("string")
    coll = F.collect_set(v) if distinct else F.collect_list(v)
    return df.groupBy(*group_cols).agg(F.array_join(F.array_sort(coll), sep).alias(out))


def share_of_total(df: DataFrame, parent_keys, child_keys, value, out_total: str = "total",
                   out_share: str = "share") -> DataFrame:
    """Each child's share of its parent's total. The value is
    summed to (parent, child) first; the parent totals are a second partial
    aggregate of that table, joined back on the parent (no window, so a
    parent with very many children is not gathered in one task; AQE
    broadcasts the totals when they measure small)."""
    t = df.groupBy(*parent_keys, *child_keys).agg(F.sum(_c(value)).alias(out_total))
    if not parent_keys:
        whole = t.agg(F.sum(out_total)).first()[0]
        return t.withColumn(out_share, F.col(out_total) / F.lit(whole))
    p = t.groupBy(*parent_keys).agg(F.sum(out_total).alias("_parent_total"))
    cond = [t[k].eqNullSafe(p[k]) for k in parent_keys]
    return t.join(p, cond, "inner").select(t["*"], (t[out_total] / p["_parent_total"]).alias(out_share))


def correlation(df: DataFrame, group_cols, x: str, y: str, out: str = "r") -> DataFrame:
    """A10: Pearson correlation per group."""
    return df.groupBy(*group_cols).agg(F.corr(x, y).alias(out))


def rank_correlation(df: DataFrame, group_cols, x: str, y: str, tie_key, out: str = "rho") -> DataFrame:
    """A10: correlation of row-number ranks (Spearman with ties broken by
    ``tie_key``, which must make rows unique, as R's row order does).
    Both rankings come from one range exchange (:func:`numbered_many`), which
    never puts one group in one task."""
    tie = [tie_key] if isinstance(tie_key, str) else list(tie_key)
    r = numbered_many(df.select(*group_cols, x, y, *tie), {"_rx": [(x, True)], "_ry": [(y, True)]}, group_cols, tie)
    return r.groupBy(*group_cols).agg(F.corr(F.col("_rx").cast("double"), F.col("_ry").cast("double")).alias(out))


def linear_fit(df: DataFrame, group_cols, x: str, y: str) -> DataFrame:
    """Least-squares line per group (ggplot ``method = "lm"``)."""
    return df.groupBy(*group_cols).agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r2"), F.regr_count(y, x).alias("n"))


def histogram(df: DataFrame, value: str, bins: int = 30, group_cols=()) -> DataFrame:
    """ggplot's default histogram: ``bins`` bins of width
    (max - min) / (bins - 1), the first centred on the minimum, closed on the
    right. Every bin is listed, empty ones with count 0.

    Without facets the range is a one-row partial aggregate read once and
    used as literals; with facets it is an aggregate with one row per facet,
    joined on the facet (AQE broadcasts it when it measures small)."""
    g = list(group_cols)
    vals = df.select(*g, value).where(F.col(value).isNotNull())
    raw = F.ceil((F.col(value) - F.col("_origin")) / F.col("_w"))
    b = F.when(F.col("_w") == 0, F.lit(1)).otherwise(F.least(F.greatest(raw, F.lit(1)), F.lit(bins))).cast("int")
    if not g:
        lo, hi = vals.agg(F.min(value), F.max(value)).first()
        if lo is None:
            return df.sparkSession.createDataFrame([], "bin int, xmin double, xmax double, count long")
        w = (hi - lo) / (bins - 1)
        origin = lo - w / 2
        consts = {"_w": F.lit(w).cast("double"), "_origin": F.lit(origin).cast("double")}
        counts = vals.withColumns(consts).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
        grid = df.sparkSession.range(1, bins + 1).select(F.col("id").cast("int").alias("bin")).withColumns(consts)
        out = grid.join(counts, "bin", "left")
    else:
        rng = vals.groupBy(*g).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
        rng = rng.withColumn("_w", (F.col("_hi") - F.col("_lo")) / F.lit(bins - 1)) \
                 .withColumn("_origin", F.col("_lo") - F.col("_w") / 2)
        counts = vals.join(rng, g, "inner").groupBy(*g, b.alias("bin")) \
            .agg(F.count(F.lit(1)).alias("count"))
        grid = rng.select(*g, "_origin", "_w", F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"))
        out = grid.join(counts, g + ["bin"], "left")
    return out.select(*g, "bin",
                      (F.col("_origin") + (F.col("bin") - 1) * F.col("_w")).alias("xmin"),
                      (F.col("_origin") + F.col("bin") * F.col("_w")).alias("xmax"),
                      F.coalesce(F.col("count"), F.lit(0)).cast("long").alias("count"))


def series_gaps(df: DataFrame, key_col: str, series_col: str, value_col: str, a: str, b: str) -> DataFrame:
    """Per key (year), value of series ``a`` minus series ``b`` and the
    relative gap; keys present in both series only."""
    wide = df.groupBy(key_col).pivot(series_col, [a, b]).agg(F.first(value_col))
    return (wide.where(F.col(a).isNotNull() & F.col(b).isNotNull())
            .select(key_col, F.col(a).alias(f"{a}"), F.col(b).alias(f"{b}"),
                    (F.col(a) - F.col(b)).alias("gap"),
                    ((F.col(a) - F.col(b)) / F.col(b)).alias("rel_gap")))


def largest_gap(gaps: DataFrame, key_col: str) -> DataFrame:
    """The key with the largest absolute gap (ties: earliest key)."""
    best = F.min(F.struct(-F.abs(F.col("gap")), F.col(key_col)))
    return gaps.agg(best.alias("_b")).select(F.col("_b").getField(key_col).alias(key_col),
                                             (-F.col("_b").getField("col1")).alias("abs_gap"))


def shortfall(df: DataFrame, group_cols, value, target: float, out: str = "debt") -> DataFrame:
    """Sum of (target - value), e.g. sleep debt against 7 hours."""
    return df.groupBy(*group_cols).agg(F.sum(F.lit(target) - _c(value)).alias(out))


def majority_class(df: DataFrame, area_cols, class_col: str, weight=None,
                   out: str = "majority", out_n: str = "n") -> DataFrame:
    """The most common (or heaviest) class per area; ties go to the
    alphabetically first class. Two partial aggregates, no window."""
    w = F.count(F.lit(1)) if weight is None else F.sum(_c(weight))
    per = df.groupBy(*area_cols, class_col).agg(w.alias("_n"))
    best = F.min(F.struct((-F.col("_n")).alias("neg"), F.col(class_col).alias("cls")))
    return per.groupBy(*area_cols).agg(best.alias("_b")).select(
        *area_cols, F.col("_b.cls").alias(out), (-F.col("_b.neg")).alias(out_n))


def areal_interpolation(values: DataFrame, blocks: DataFrame, source_key: str, target_key: str,
                        pop_col: str, value_col: str, out: str = "estimate") -> DataFrame:
    """Move a value from source areas to target areas through blocks,
    weighting each block by its share of the source area's population.

    ``blocks`` has (block, source_key, target_key, pop). Weights: block pop
    over source pop (a partial aggregate joined back), then
    sum(value * weight) per target."""
    src_pop = blocks.groupBy(source_key).agg(F.sum(pop_col).alias("_src_pop"))
    w = blocks.join(src_pop, source_key).withColumn("_w", F.col(pop_col) / F.col("_src_pop"))
    return (w.join(values.select(source_key, value_col), source_key)
            .groupBy(target_key).agg(F.sum(F.col(value_col) * F.col("_w")).alias(out)))


def overlay_interpolation(values: DataFrame, blocks: DataFrame, targets: DataFrame, source_key: str, pop_col: str,
                          value_col: str, id_col: str = "id", out: str = "estimate") -> DataFrame:
    """A17 from geometry: (target id, estimate). A block's share of its source
    area's population is dealt to the target areas by the share of the block's
    area that lies in each (:func:`civicframe.operators.spatial.overlay`). If
    the targets cover every block without overlap, totals are preserved."""
    from civicframe.operators.spatial import overlay
    parts = overlay(blocks, targets, id_col=id_col)
    pieces = (blocks.select(F.col(id_col).alias("l"), source_key, pop_col).join(parts, "l")
              .select(source_key, F.col("r").alias("_target"), (F.col(pop_col) * F.col("share")).alias("_part")))
    src = blocks.groupBy(source_key).agg(F.sum(pop_col).alias("_src_pop"))
    return (pieces.join(src, source_key).join(values.select(source_key, value_col), source_key)
            .groupBy(F.col("_target").alias(id_col)).agg(F.sum(F.col(value_col) * F.col("_part") / F.col("_src_pop")).alias(out)))


def two_way_class(df: DataFrame, a: str, b: str, tie_key: str, k: int = 3, out: str = "risk_class") -> DataFrame:
    """``ntile(k)`` of ``a`` and of ``b`` over all rows, combined into a
    label such as ``"3-1"``. Tiles come from distributed row numbers, not an
    unpartitioned window (which would run in one task)."""
    from civicframe.operators.windows import ntile_from_number
    n = df.count()
    ra = numbered(df, [F.col(a), F.col(tie_key)], (), "_ra")
    rb = numbered(ra, [F.col(b), F.col(tie_key)], (), "_rb")
    return (rb.withColumn(f"{a}_tile", ntile_from_number("_ra", F.lit(n), k))
              .withColumn(f"{b}_tile", ntile_from_number("_rb", F.lit(n), k))
              .withColumn(out, F.concat_ws("-", F.col(f"{a}_tile").cast("string"), F.col(f"{b}_tile").cast("string")))
              .drop("_ra", "_rb"))
