"""Window operators (W1-W6) and the row numbering they rest on.

A window partitioned by a data key sends each key to one task. Where a key
may hold a large share of all rows (a third, say) the operators here avoid
that: whole-group values are computed with a partial aggregate and joined
back, and row numbers are computed from a range-partitioned sort whose
partitions have bounded size whatever the keys look like.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from civicframe.session import cut_lineage


def _cols(cols) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in (cols or [])]


def _names(cols) -> list[str]:
    return [c for c in (cols or [])]


def group_extremes(df: DataFrame, group_cols, value_col: str, out_min: str, out_max: str) -> DataFrame:
    """Attach the group's first and last value (e.g. first and last year
    a variable appears) to every row.

    Partial ``min``/``max`` per group, then an equi-join back on the group.
    AQE turns the join into a broadcast at run time when the aggregate is
    small and splits a hot group's partition when it is not.
    """
    ext = df.groupBy(*group_cols).agg(F.min(value_col).alias(out_min), F.max(value_col).alias(out_max))
    cond = [df[c].eqNullSafe(ext[c]) for c in group_cols]
    return df.join(ext, cond, "left").select(df["*"], ext[out_min], ext[out_max])


def year_span_label(first_col, last_col, backdate: dict | None = None, parens_single: bool = True) -> Column:
    """``(2005-2023)``; a single year gives ``(2005)`` (or ``2005`` with
    ``parens_single=False``). ``backdate`` maps a first year to the year the
    span really starts, e.g. ``{2012: 2010}`` where the 2010 and 2011 lists
    lack the concept: a span from 2012 then reads ``(2010-2023)``."""
    f, l = (F.col(first_col) if isinstance(first_col, str) else first_col,
            F.col(last_col) if isinstance(last_col, str) else last_col)
    start = f
    for old, new in (backdate or {}).items():
        start = F.when(f == old, F.lit(new)).otherwise(start)
    single = F.format_string("(%d)", f) if parens_single else f.cast("string")
    return F.when(f == l, single).otherwise(F.format_string("(%d-%d)", start, l))


def numbered(df: DataFrame, order_cols, group_cols=(), out: str = "rn",
             num_partitions: int | None = None) -> DataFrame:
    """``row_number() OVER (PARTITION BY group ORDER BY order)`` for groups of
    any size.

    ``order_cols`` must make the order total (end with a unique key) so the
    numbering is deterministic. Steps: range-partition and sort on
    (group, order) so every partition has bounded size even when one group
    holds most rows; take each row's position inside its partition; write
    that once to the checkpoint folder; count rows per (partition, group) -- a table of
    partitions x groups, tiny -- and turn the counts into offsets with a
    window on that small table; join the offsets back.

    The checkpoint is what makes this correct: the counts and the rows are
    two readers of the range-partitioned data, and without a materialised
    copy each may re-plan the range shuffle (its own sample, its own
    bounds), so positions would not line up. Read back from the shared
    checkpoint folder, both see the same partitions, also after a lost
    executor. (Measured: without it the numbering is wrong and slower.)
    """
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = _cols(group_cols) + _cols(order_cols)
    mask = (1 << 33) - 1
    ranged = (df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
              .withColumn("_mid", F.monotonically_increasing_id())
              .withColumn("_pid", F.shiftright("_mid", 33))
              .withColumn("_pos", F.col("_mid").bitwiseAND(F.lit(mask)))
              .drop("_mid"))
    ranged = cut_lineage(ranged)
    g = _names(group_cols)
    counts = ranged.groupBy("_pid", *g).agg(F.count(F.lit(1)).alias("_n"), F.min("_pos").alias("_start"))
    # Over the counts table only: one row per (partition, group) present, so
    # even without groups (one window partition) it holds at most as many
    # rows as there are range partitions.
    before = Window.partitionBy(*g).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    cond = [ranged["_pid"] == offsets["_pid"]] + [ranged[c].eqNullSafe(offsets[c]) for c in g]
    return (ranged.join(offsets, cond, "inner")
            .select(ranged["*"], (offsets["_off"] + ranged["_pos"] - offsets["_start"] + 1).alias(out))
            .drop("_pid", "_pos"))


def numbered_many(df: DataFrame, rankings: dict, group_cols, key_cols, num_partitions: int | None = None) -> DataFrame:
    """Several ``row_number`` rankings of the same rows by one range
    exchange: (group, key, one column a ranking).

    ``rankings``: name -> list of (column, ascending) pairs, which with
    ``key_cols`` after them order the rows; nulls come first ascending and last
    descending. Rows get a number of their own, written once, which is the last
    tie key (rows equal in every key stay apart). They become one narrow row a
    ranking, are numbered together by :func:`numbered` and put side by side
    again by that number. Numbers, dates, times and strings can be ranked,
    strings upwards only.
    """
    types = dict(df.dtypes)
    g, k = list(group_cols), list(key_cols)
    depth = max(len(o) for o in rankings.values())

    def value(order, i):
        # one place of a sort key: null's place, then the value in the column of its kind
        if i >= len(order):
            return F.struct(F.lit(0).alias("n"), F.lit(None).cast("double").alias("d"), F.lit(None).cast("long").alias("l"),
                            F.lit(None).cast("string").alias("s"))
        name, up = order[i]
        c, kind = F.col(name), types[name]
        n = F.when(c.isNull(), 0 if up else 1).otherwise(1 if up else 0)
        d = l = s = F.lit(None)
        if kind in ("double", "float"):
            d = c.cast("double") if up else -c.cast("double")
        elif kind == "string":
            if not up:
                raise ValueError(f"{name}: strings are ranked upwards only")
            s = c
        else:
            whole = F.datediff(c, F.lit("1970-01-01").cast("date")) if kind == "date" else F.unix_micros(c.cast("timestamp")) if kind.startswith("timestamp") else c
            l = whole.cast("long") if up else -whole.cast("long")
        return F.struct(n.alias("n"), d.cast("double").alias("d"), l.cast("long").alias("l"), s.cast("string").alias("s"))

    rows = []
    for r, order in enumerate(rankings.values()):
        rows.append(F.struct(F.lit(r).alias("_r"), *(value(order, i).alias(f"_o{i}") for i in range(depth))))
    named = dict.fromkeys([*g, *k, *(c for o in rankings.values() for c, _ in o)])
    own = cut_lineage(df.select(*named, F.monotonically_increasing_id().alias("_id")))
    long = own.select("_id", *g, *k, F.inline(F.array(*rows)))
    rn = numbered(long, [*(f"_o{i}" for i in range(depth)), *k, "_id"], [*g, "_r"], "_rn", num_partitions)
    side = rn.groupBy("_id").agg(*(F.max(F.when(F.col("_r") == r, F.col("_rn"))).alias(name) for r, name in enumerate(rankings)))
    keep = [c for c in dict.fromkeys([*g, *k]) if c not in rankings]
    return own.select("_id", *keep).join(side, "_id").drop("_id")


def ntile_from_number(rn, n, k: int) -> Column:
    """``ntile(k)`` from a 1-based row number and the group size, the
    way SQL defines it (the first ``n % k`` tiles get one extra row)."""
    rn = F.col(rn) if isinstance(rn, str) else rn
    n = F.col(n) if isinstance(n, str) else n
    q = F.floor(n / k)
    r = n % k
    big = (q + 1) * r
    return F.when(rn <= big, F.floor((rn - 1) / (q + 1)) + 1) \
        .otherwise(r + F.floor((rn - 1 - big) / q) + 1).cast("int")


def fill_up(df: DataFrame, group_cols, order_cols, fill_cols, num_partitions: int | None = None) -> DataFrame:
    """Fill nulls from the next non-null value in the group (tidyr
    ``fill(.direction = "up")``), ordered explicitly by columns (names).

    A two-level scan so no group lands in one task: range-partition on
    (group, order); fill inside each (partition, group) with a window
    whose frame runs to the end of that piece; then for every piece find
    the first non-null value of the pieces after it (a window over the small
    table of pieces) and use it for rows still null. The ranged rows are
    written once to the checkpoint folder, for the reason given in
    :func:`numbered` (two readers must see the same pieces).
    """
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    g = _names(group_cols)
    keys = _cols(group_cols) + _cols(order_cols)
    ranged = (df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
              .withColumn("_mid", F.monotonically_increasing_id())
              .withColumn("_pid", F.shiftright("_mid", 33))
              .drop("_mid"))
    ranged = cut_lineage(ranged)
    # "The next non-null value" is the last one seen going backwards: a frame
    # that only grows, so the window is linear in the rows of a piece. (A frame
    # from the current row to the end is computed anew for every row.)
    back = [F.col(c).desc() for c in _names(order_cols)]
    ahead = Window.partitionBy("_pid", *g).orderBy(*back).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = ranged.select("*", *[F.last(c, ignorenulls=True).over(ahead).alias(f"_loc_{c}") for c in fill_cols])
    # First non-null per piece: min_by over the piece in order, as a struct min.
    order_struct = F.struct(*_cols(order_cols))
    piece = ranged.groupBy("_pid", *g).agg(*[
        F.min_by(F.col(c), F.when(F.col(c).isNotNull(), order_struct)).alias(f"_head_{c}") for c in fill_cols])
    later = Window.partitionBy(*g).orderBy(F.desc("_pid")).rowsBetween(Window.unboundedPreceding, -1)
    carry = piece.select("_pid", *g, *[F.last(f"_head_{c}", ignorenulls=True).over(later).alias(f"_carry_{c}")
                                        for c in fill_cols])
    cond = [local["_pid"] == carry["_pid"]] + [local[c].eqNullSafe(carry[c]) for c in g]
    joined = local.join(carry, cond, "left")
    out_cols = []
    for c in df.columns:
        if c in fill_cols:
            out_cols.append(F.coalesce(local[c], local[f"_loc_{c}"], carry[f"_carry_{c}"]).alias(c))
        else:
            out_cols.append(local[c])
    return joined.select(*out_cols)


def rows_at_group_extreme(df: DataFrame, group_cols, value_col: str, which: str = "min") -> DataFrame:
    """Every row holding its group's min (or max) value; ties are all
    kept (``slice_min``/``rank() == 1``, not ``row_number``).

    Partial aggregate of the extreme per group, then a semi join on
    (group, value) -- no window, so no group is sorted in one task.
    """
    agg = F.min(value_col) if which == "min" else F.max(value_col)
    ext = df.groupBy(*group_cols).agg(agg.alias("_ext"))
    cond = [df[c].eqNullSafe(ext[c]) for c in group_cols] + [df[value_col] == ext["_ext"]]
    return df.join(ext, cond, "left_semi")


def _pieces(df: DataFrame, group_cols, order_col: str, num_partitions: int | None) -> tuple[DataFrame, list]:
    """``df`` range-partitioned on (group, order) and written once, each row
    with the number ``_pid`` of its piece; and the window over a piece."""
    n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = _cols(group_cols) + [F.col(order_col)]
    ranged = cut_lineage(df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
                         .withColumn("_pid", F.shiftright(F.monotonically_increasing_id(), 33)))
    return ranged, Window.partitionBy("_pid", *group_cols)


def local_linear_trend(df: DataFrame, group_cols, x_col: str, y_col: str, half_width: int,
                       out: str = "trend", num_partitions: int | None = None) -> DataFrame:
    """Fitted value of a straight line through the points within
    ``half_width`` of x (range frame), evaluated at x.

    A group may hold all rows: it is cut into pieces by x, and a piece gets
    copies of its neighbours' rows within ``half_width`` of its ends (the
    halo), so each frame lies in one piece. Only groups that are cut have
    several pieces, at most two a partition, which is what is broadcast."""
    ranged, piece = _pieces(df, group_cols, x_col, num_partitions)
    ends = ranged.where(F.col(x_col).isNotNull()).groupBy(*group_cols, "_pid").agg(F.min(x_col).alias("_from"), F.max(x_col).alias("_to"))
    g = [F.col(c).alias(f"_g{i}") for i, c in enumerate(group_cols)]
    many = ends.groupBy(*group_cols).agg(F.collect_list(F.struct("_pid", "_from", "_to")).alias("_ends")).where(F.size("_ends") > 1)
    cut = many.select(*g, F.inline("_ends").alias("_to_pid", "_from", "_to"))
    same = [F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(group_cols)]
    near = (F.col("_pid") != F.col("_to_pid")) & (F.col(x_col) >= F.col("_from") - half_width) & (F.col(x_col) <= F.col("_to") + half_width)
    for c in same:
        near = near & c
    halo = ranged.join(F.broadcast(cut), near).select(*df.columns, F.col("_to_pid").alias("_pid"), F.lit(False).alias("_own"))
    w = piece.orderBy(F.col(x_col)).rangeBetween(-half_width, half_width)
    slope = F.regr_slope(F.col(y_col), F.col(x_col)).over(w)
    icpt = F.regr_intercept(F.col(y_col), F.col(x_col)).over(w)
    both = ranged.select(*df.columns, "_pid", F.lit(True).alias("_own")).union(halo)
    return both.withColumn(out, icpt + slope * F.col(x_col)).where("_own").drop("_own", "_pid")


def change_from_prior(df: DataFrame, group_cols, order_col: str, value_col: str, out: str = "change",
                      num_partitions: int | None = None) -> DataFrame:
    """Difference from the previous row of the group (``lag``).

    A group may hold all rows: it is cut into pieces by ``order_col``, and the
    first row of a piece takes the last value of the group's piece before it, from a
    table with one row a piece. Orders must be unique in a group for a
    defined result, as with ``lag``; rows of one order stay in one piece."""
    ranged, piece = _pieces(df, group_cols, order_col, num_partitions)
    w = piece.orderBy(order_col)
    last = ranged.groupBy("_pid", *group_cols).agg(F.max_by(F.struct(F.col(value_col).alias("v")), F.struct(F.col(order_col).isNotNull(), F.col(order_col))).alias("_v"))
    carry = last.select("_pid", *group_cols, F.lag("_v").over(Window.partitionBy(*group_cols).orderBy("_pid"))["v"].alias("_carry"))
    r = ranged.withColumns({"_first": F.row_number().over(w) == 1, "_prior": F.lag(value_col).over(w)})
    cond = [r["_pid"] == carry["_pid"]] + [r[c].eqNullSafe(carry[c]) for c in group_cols]
    prior = F.when(r["_first"], carry["_carry"]).otherwise(r["_prior"])
    return r.join(carry, cond, "left").select(*(r[c] for c in df.columns), (r[value_col] - prior).alias(out))
