"""Aggregate, window and reshape plans on orders / lineitem / part."""

from __future__ import annotations

from pyspark.sql import functions as F

from civicframe.functions import strings as X
from civicframe.operators import aggregate as A
from civicframe.operators import columns as C
from civicframe.operators import ordering as O
from civicframe.operators import reshape as R
from civicframe.operators import windows as W
from civicframe.plans.registry import register, table


@register("priority_frequency", ("A5", "O1"), """
SELECT o_orderpriority, COUNT(*) AS n FROM orders GROUP BY 1
""")
def priority_frequency(spark, sf_dir):
    return A.frequency(table(spark, sf_dir, "orders"), ["o_orderpriority"])


@register("status_priority_pairs", ("A7", "F11"), """
SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders
""")
def status_priority_pairs(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderpriority").distinct()


@register("customer_order_years", ("A8",), """
SELECT o_custkey, string_agg(DISTINCT CAST(year(o_orderdate) AS VARCHAR), ', '
                             ORDER BY CAST(year(o_orderdate) AS VARCHAR)) AS years
FROM orders GROUP BY 1
""")
def customer_order_years(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", F.year("o_orderdate").alias("y"))
    return A.collapse(o, ["o_custkey"], "y", "years")


@register("returnflag_share", ("A9",), """
WITH t AS (SELECT CAST(year(l_shipdate) AS INTEGER) AS ship_year, l_returnflag, SUM(l_extendedprice) AS total
           FROM lineitem GROUP BY 1, 2)
SELECT ship_year, l_returnflag, ROUND(total, 2) AS total,
       ROUND(total / SUM(total) OVER (PARTITION BY ship_year), 8) AS share FROM t
""")
def returnflag_share(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.year("l_shipdate").alias("ship_year"), "l_returnflag",
                                                 "l_extendedprice")
    s = A.share_of_total(li, ["ship_year"], ["l_returnflag"], "l_extendedprice")
    return s.select("ship_year", "l_returnflag", F.round("total", 2).alias("total"), F.round("share", 8).alias("share"))


@register("price_quantity_corr", ("A10", "W3"), """
WITH r AS (
  SELECT l_returnflag, l_quantity, l_extendedprice,
    row_number() OVER (PARTITION BY l_returnflag ORDER BY l_quantity, l_orderkey, l_linenumber, l_partkey,
                       l_suppkey, l_discount, l_tax, l_linestatus, l_shipdate) AS rx,
    row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice, l_orderkey, l_linenumber, l_partkey,
                       l_suppkey, l_discount, l_tax, l_linestatus, l_shipdate) AS ry
  FROM lineitem)
SELECT l_returnflag, ROUND(corr(l_extendedprice, l_quantity), 8) AS r,
       ROUND(corr(CAST(rx AS DOUBLE), CAST(ry AS DOUBLE)), 8) AS rho FROM r GROUP BY 1
""")
def price_quantity_corr(spark, sf_dir):
    """Ties in the ranks are broken by every other column: the order key and
    line number alone are not unique in this table."""
    li = table(spark, sf_dir, "lineitem")
    r = A.correlation(li, ["l_returnflag"], "l_extendedprice", "l_quantity")
    tie = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_discount", "l_tax", "l_linestatus", "l_shipdate"]
    rho = A.rank_correlation(li, ["l_returnflag"], "l_quantity", "l_extendedprice", tie)
    return r.join(rho, "l_returnflag").select("l_returnflag", F.round("r", 8).alias("r"), F.round("rho", 8).alias("rho"))


@register("price_fit", ("A11",), """
SELECT l_returnflag, ROUND(regr_slope(l_extendedprice, l_quantity), 6) AS slope,
       ROUND(regr_intercept(l_extendedprice, l_quantity), 6) AS intercept,
       ROUND(regr_r2(l_extendedprice, l_quantity), 8) AS r2, CAST(regr_count(l_extendedprice, l_quantity) AS BIGINT) AS n
FROM lineitem GROUP BY 1
""")
def price_fit(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity", "l_extendedprice")
    f = A.linear_fit(li, ["l_returnflag"], "l_quantity", "l_extendedprice")
    return f.select("l_returnflag", F.round("slope", 6).alias("slope"), F.round("intercept", 6).alias("intercept"),
                    F.round("r2", 8).alias("r2"), F.col("n").cast("long").alias("n"))


@register("totalprice_histogram", ("A12",), """
WITH r AS (SELECT MIN(o_totalprice) AS lo, MAX(o_totalprice) AS hi FROM orders),
p AS (SELECT lo, (hi - lo) / 29 AS w, lo - ((hi - lo) / 29) / 2 AS origin FROM r),
b AS (SELECT CAST(CASE WHEN p.w = 0 THEN 1
                       ELSE least(greatest(ceil((o.o_totalprice - p.origin) / p.w), 1), 30) END AS INTEGER) AS bin
      FROM orders o, p WHERE o.o_totalprice IS NOT NULL),
c AS (SELECT bin, COUNT(*) AS cnt FROM b GROUP BY 1),
g AS (SELECT CAST(i AS INTEGER) AS bin FROM range(1, 31) t(i))
SELECT g.bin, ROUND(p.origin + (g.bin - 1) * p.w, 4) AS xmin, ROUND(p.origin + g.bin * p.w, 4) AS xmax,
       CAST(coalesce(c.cnt, 0) AS BIGINT) AS count
FROM g CROSS JOIN p LEFT JOIN c ON g.bin = c.bin
""")
def totalprice_histogram(spark, sf_dir):
    h = A.histogram(table(spark, sf_dir, "orders"), "o_totalprice", 30)
    return h.select("bin", F.round("xmin", 4).alias("xmin"), F.round("xmax", 4).alias("xmax"), "count")


_YEARLY = """
WITH y AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, o_orderstatus, SUM(o_totalprice) AS total
           FROM orders GROUP BY 1, 2)"""


@register("status_year_gap", ("A13",), _YEARLY + """
SELECT f.year, ROUND(f.total, 2) AS F, ROUND(o.total, 2) AS O, ROUND(f.total - o.total, 2) AS gap,
       ROUND((f.total - o.total) / o.total, 8) AS rel_gap
FROM (SELECT * FROM y WHERE o_orderstatus = 'F') f JOIN (SELECT * FROM y WHERE o_orderstatus = 'O') o
  ON f.year = o.year
""")
def status_year_gap(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    y = o.groupBy(F.year("o_orderdate").alias("year"), "o_orderstatus").agg(F.sum("o_totalprice").alias("total"))
    g = A.series_gaps(y, "year", "o_orderstatus", "total", "F", "O")
    return g.select("year", F.round("F", 2).alias("F"), F.round("O", 2).alias("O"), F.round("gap", 2).alias("gap"),
                    F.round("rel_gap", 8).alias("rel_gap"))


@register("status_year_largest_gap", ("A13",), _YEARLY + """,
g AS (SELECT f.year, f.total - o.total AS gap
      FROM (SELECT * FROM y WHERE o_orderstatus = 'F') f JOIN (SELECT * FROM y WHERE o_orderstatus = 'O') o
        ON f.year = o.year)
SELECT year, ROUND(abs(gap), 2) AS abs_gap FROM g ORDER BY abs(gap) DESC, year LIMIT 1
""")
def status_year_largest_gap(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    y = o.groupBy(F.year("o_orderdate").alias("year"), "o_orderstatus").agg(F.sum("o_totalprice").alias("total"))
    best = A.largest_gap(A.series_gaps(y, "year", "o_orderstatus", "total", "F", "O"), "year")
    return best.select("year", F.round("abs_gap", 2).alias("abs_gap"))


@register("status_year_change", ("W6",), _YEARLY + """
SELECT year, o_orderstatus, ROUND(total, 2) AS total,
       ROUND(total - lag(total) OVER (PARTITION BY o_orderstatus ORDER BY year), 2) AS change FROM y
""")
def status_year_change(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    y = o.groupBy(F.year("o_orderdate").alias("year"), "o_orderstatus").agg(F.sum("o_totalprice").alias("total"))
    c = W.change_from_prior(y, ["o_orderstatus"], "year", "total")
    return c.select("year", "o_orderstatus", F.round("total", 2).alias("total"), F.round("change", 2).alias("change"))


@register("order_year_span", ("W1",), """
WITH o AS (SELECT o_orderkey, o_custkey, CAST(year(o_orderdate) AS INTEGER) AS y FROM orders),
s AS (SELECT o_custkey, MIN(y) AS first_year, MAX(y) AS last_year FROM o GROUP BY 1)
SELECT o.o_orderkey, o.o_custkey, s.first_year, s.last_year,
  CASE WHEN s.first_year = s.last_year THEN printf('(%d)', s.first_year)
       ELSE printf('(%d-%d)', s.first_year, s.last_year) END AS year_range
FROM o JOIN s ON o.o_custkey = s.o_custkey
""")
def order_year_span(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("y"))
    e = W.group_extremes(o, ["o_custkey"], "y", "first_year", "last_year")
    return e.select("o_orderkey", "o_custkey", "first_year", "last_year",
                    W.year_span_label("first_year", "last_year").alias("year_range"))


@register("order_ranks", ("W3", "O1"), """
SELECT o_orderkey, o_orderstatus,
  row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS price_rank,
  row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey) AS date_rank
FROM orders
""")
def order_ranks(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    r = W.numbered_many(o, {"price_rank": [("o_totalprice", False)], "date_rank": [("o_orderdate", True)]}, ["o_orderstatus"], ["o_orderkey"])
    return r.select("o_orderkey", "o_orderstatus", "price_rank", "date_rank")


@register("largest_orders_per_customer", ("W4",), """
SELECT o_orderkey, o_custkey, o_totalprice FROM orders o
WHERE o_totalprice = (SELECT MAX(o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)
""")
def largest_orders_per_customer(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return W.rows_at_group_extreme(o, ["o_custkey"], "o_totalprice", "max")


@register("region_year_long", ("R1", "R2", "J1"), """
WITH o AS (
  SELECT r.r_name AS region, CAST(year(o.o_orderdate) AS INTEGER) AS y, o.o_totalprice
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey)
SELECT region, 'T1_' || CAST(y - 1994 AS VARCHAR) AS variable,
       CAST(round(SUM(o_totalprice)) AS BIGINT) AS est, COUNT(*) AS moe
FROM o GROUP BY region, y
""")
def region_year_long(spark, sf_dir):
    """Yearly order value per region spread wide (``T1_est1`` = first year,
    ``T1_moe1`` = its order count), then back to long with ``wide_to_long``."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_totalprice")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    r = table(spark, sf_dir, "region").select("r_regionkey", F.col("r_name").alias("region"))
    j = o.join(c, o.o_custkey == c.c_custkey).join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")) \
        .join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))
    line = (F.year("o_orderdate") - 1994).cast("string")
    per = j.groupBy("region", line.alias("line")).agg(
        F.round(F.sum("o_totalprice")).cast("long").alias("est"), F.count(F.lit(1)).alias("moe"))
    # the years come from the data, one column each
    lines = sorted((r["line"] for r in per.select("line").distinct().collect()), key=int)
    est = R.long_to_wide(per.select("region", "line", "est"), ["region"], "line", "est", lines)
    moe = R.long_to_wide(per.select("region", "line", "moe"), ["region"], "line", "moe", lines)
    wide = est.toDF("region", *[f"T1_est{x}" for x in lines]).join(moe.toDF("region", *[f"T1_moe{x}" for x in lines]), "region")
    long = R.wide_to_long(wide, ["region"])
    return long.where(F.col("est").isNotNull() | F.col("moe").isNotNull())


@register("brand_codes", ("R3", "R4", "X10", "X2"), """
SELECT p_partkey, substr(p_brand, 1, 6) AS brand_prefix, substr(p_brand, 7, 2) AS brand_no,
  concat_ws(' | ', p_type, p_name) AS label,
  array_to_string(list_transform(string_split(lower(p_name), ' '),
                  lambda x: upper(substr(x, 1, 1)) || substr(x, 2)), ' ') AS title
FROM part
""")
def brand_codes(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    pre, no = R.split_fixed("p_brand", [6, 2])
    return p.select("p_partkey", pre.alias("brand_prefix"), no.alias("brand_no"),
                    X.concat_ws_skip_null(" | ", "p_type", "p_name").alias("label"),
                    X.title_case("p_name").alias("title"))


@register("newest_orders", ("O2", "O3"), """
SELECT o_orderkey, o_orderdate, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 10
""")
def newest_orders(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    return O.newest(o, 10, "o_orderdate", "o_orderkey")


@register("customer_page", ("O4", "O1"), """
SELECT c_custkey, c_name, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 12 OFFSET 24
""")
def customer_page(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    return O.page(c, 3, "-c_acctbal", "c_custkey")


@register("part_word_counts", ("O3",), """
SELECT w AS category, COUNT(*) AS n
FROM (SELECT DISTINCT p_partkey, unnest(string_split(p_name, ' ')) AS w FROM part) GROUP BY 1
""")
def part_word_counts(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.split("p_name", " ").alias("cats"))
    return O.category_counts(p, "cats")


@register("parts_in_category", ("O3",), """
SELECT p_partkey, p_name FROM part WHERE list_contains(string_split(p_name, ' '), 'gear')
""")
def parts_in_category(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", F.split("p_name", " ").alias("cats"))
    return O.having_category(p, "cats", "gear").select("p_partkey", "p_name")


@register("lineitem_columns", ("F1", "F3", "F4", "F7", "F8", "X14"), """
SELECT l_orderkey, l_linenumber, round(l_quantity, 1) AS l_quantity, round(l_extendedprice, 1) AS l_extendedprice,
  round(l_discount, 1) AS l_discount, round(l_tax, 1) AS l_tax,
  (l_discount + l_tax) / 2 AS mean_rate,
  CASE WHEN l_returnflag = 'R' THEN 'returned' WHEN l_returnflag IS NULL THEN 'missing' ELSE 'kept' END AS status,
  'lineitem' AS dataset
FROM lineitem
""")
def lineitem_columns(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    d = C.select_spec(li, "l_orderkey", "l_linenumber", "l_quantity:l_tax", "l_returnflag")
    d = d.withColumn("mean_rate", X.row_mean("l_discount", "l_tax"))
    d = C.across(d, lambda c: F.round(c, 1), cols=C.column_range(d, "l_quantity", "l_tax"))
    d = d.withColumn("status", C.if_else(F.col("l_returnflag") == "R", "returned", "kept", "missing"))
    d = C.tag(d, "dataset", "lineitem").drop("l_returnflag")
    return C.relocate(d, ["l_orderkey", "l_linenumber"])
