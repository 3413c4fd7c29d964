"""Plans on customer / nation / region / supplier: shares, majority
classes, interpolation, risk classes, joins and the path tree."""

from __future__ import annotations

from pyspark.sql import functions as F

from civicframe.operators import aggregate as A
from civicframe.operators import columns as C
from civicframe.operators import joins as J
from civicframe.operators import reshape as R
from civicframe.plans.registry import register, table


def customers_geo(spark, sf_dir):
    """J1 + J5: customers with nation and region names (the two small
    dimension tables are broadcast: 25 and 5 rows by definition)."""
    c = table(spark, sf_dir, "customer")
    n = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "region")
    cn = J.left_join_keys(c, n, "c_nationkey", "n_nationkey", small_right=True)
    return J.left_join_keys(cn, r, "n_regionkey", "r_regionkey", small_right=True)


@register("customer_geo", ("J1", "J5"), """
SELECT c.c_custkey, c.c_name, n.n_name, r.r_name
FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
LEFT JOIN region r ON n.n_regionkey = r.r_regionkey
""")
def customer_geo(spark, sf_dir):
    return customers_geo(spark, sf_dir).select("c_custkey", "c_name", "n_name", "r_name")


@register("segment_share", ("A15", "A9"), """
WITH t AS (SELECT c_nationkey, c_mktsegment, SUM(c_acctbal) AS total FROM customer GROUP BY 1, 2)
SELECT c_nationkey, c_mktsegment, ROUND(total, 2) AS total,
       ROUND(total / SUM(total) OVER (PARTITION BY c_nationkey), 8) AS share FROM t
""")
def segment_share(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    s = A.share_of_total(c, ["c_nationkey"], ["c_mktsegment"], "c_acctbal")
    return s.select("c_nationkey", "c_mktsegment", F.round("total", 2).alias("total"), F.round("share", 8).alias("share"))


@register("majority_segment", ("A16",), """
WITH t AS (SELECT c_nationkey, c_mktsegment, COUNT(*) AS n FROM customer GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, c_mktsegment) AS rn FROM t)
SELECT c_nationkey, c_mktsegment AS majority, n FROM r WHERE rn = 1
""")
def majority_segment(spark, sf_dir):
    return A.majority_class(table(spark, sf_dir, "customer"), ["c_nationkey"], "c_mktsegment")


@register("segment_interpolation", ("A17",), """
WITH v AS (SELECT s_nationkey AS nation, SUM(s_acctbal) AS value FROM supplier GROUP BY 1),
b AS (SELECT c_custkey, c_nationkey AS nation, c_mktsegment AS segment, 1.0 AS pop FROM customer),
sp AS (SELECT nation, SUM(pop) AS src_pop FROM b GROUP BY 1)
SELECT b.segment, ROUND(SUM(v.value * b.pop / sp.src_pop), 4) AS estimate
FROM b JOIN sp ON b.nation = sp.nation JOIN v ON b.nation = v.nation GROUP BY 1
""")
def segment_interpolation(spark, sf_dir):
    """Supplier balance per nation moved to market segments, weighting each
    customer (the "block") by its share of its nation's customers."""
    s = table(spark, sf_dir, "supplier")
    values = s.groupBy(F.col("s_nationkey").alias("nation")).agg(F.sum("s_acctbal").alias("value"))
    blocks = table(spark, sf_dir, "customer").select(
        "c_custkey", F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"),
        F.lit(1.0).alias("pop"))
    est = A.areal_interpolation(values, blocks, "nation", "segment", "pop", "value")
    return est.select("segment", F.round("estimate", 4).alias("estimate"))


@register("nation_risk_class", ("A18",), """
WITH a AS (SELECT c_nationkey, AVG(c_acctbal) AS mean_balance,
                  AVG(CASE WHEN c_acctbal < 0 THEN 1.0 ELSE 0.0 END) AS debt_share FROM customer GROUP BY 1),
t AS (SELECT *, ntile(3) OVER (ORDER BY mean_balance, c_nationkey) AS mean_balance_tile,
             ntile(3) OVER (ORDER BY debt_share, c_nationkey) AS debt_share_tile FROM a)
SELECT c_nationkey, ROUND(mean_balance, 4) AS mean_balance, ROUND(debt_share, 6) AS debt_share,
       CAST(mean_balance_tile AS INTEGER) AS mean_balance_tile, CAST(debt_share_tile AS INTEGER) AS debt_share_tile,
       CAST(mean_balance_tile AS VARCHAR) || '-' || CAST(debt_share_tile AS VARCHAR) AS risk_class FROM t
""")
def nation_risk_class(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    a = c.groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("mean_balance"),
                                     F.avg((F.col("c_acctbal") < 0).cast("double")).alias("debt_share"))
    t = A.two_way_class(a, "mean_balance", "debt_share", "c_nationkey")
    return t.select("c_nationkey", F.round("mean_balance", 4).alias("mean_balance"),
                    F.round("debt_share", 6).alias("debt_share"), "mean_balance_tile", "debt_share_tile", "risk_class")


@register("status_full_join", ("J3", "J2"), """
WITH a AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, o_orderstatus AS status, COUNT(*) AS n_orders
           FROM orders GROUP BY 1, 2),
b AS (SELECT CAST(year(l_shipdate) AS INTEGER) AS year, l_linestatus AS status, COUNT(*) AS n_lines
      FROM lineitem GROUP BY 1, 2)
SELECT coalesce(a.year, b.year) AS year, coalesce(a.status, b.status) AS status, a.n_orders, b.n_lines
FROM a FULL JOIN b ON a.year IS NOT DISTINCT FROM b.year AND a.status IS NOT DISTINCT FROM b.status
""")
def status_full_join(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    li = table(spark, sf_dir, "lineitem")
    a = o.groupBy(F.year("o_orderdate").alias("year"), F.col("o_orderstatus").alias("status")) \
        .agg(F.count(F.lit(1)).alias("n_orders"))
    b = li.groupBy(F.year("l_shipdate").alias("year"), F.col("l_linestatus").alias("status")) \
        .agg(F.count(F.lit(1)).alias("n_lines"))
    return J.natural_join(a, b, "full")


@register("segment_natural_left", ("J2",), """
WITH a AS (SELECT c_nationkey, c_mktsegment, COUNT(*) AS n FROM customer GROUP BY 1, 2),
b AS (SELECT c_nationkey, c_mktsegment, ROUND(AVG(c_acctbal), 6) AS mean_balance
      FROM customer WHERE c_acctbal > 5000 GROUP BY 1, 2)
SELECT a.c_nationkey, a.c_mktsegment, a.n, b.mean_balance FROM a LEFT JOIN b
  ON a.c_nationkey IS NOT DISTINCT FROM b.c_nationkey AND a.c_mktsegment IS NOT DISTINCT FROM b.c_mktsegment
""")
def segment_natural_left(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    a = c.groupBy("c_nationkey", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
    b = c.where(F.col("c_acctbal") > 5000).groupBy("c_nationkey", "c_mktsegment") \
        .agg(F.round(F.avg("c_acctbal"), 6).alias("mean_balance"))
    return J.natural_join(a, b, "left")


@register("segment_query", ("F12", "F5"), """
SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE lower(c_mktsegment) = 'building' AND c_nationkey = 3
""")
def segment_query(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey")
    return C.request_query(c, c_mktsegment="BuIlDiNg", c_nationkey=3).drop("c_nationkey")


@register("event_day_query", ("F12", "T9"), """
SELECT event_id, user_id, event_type, ts FROM events
WHERE lower(event_type) = 'click' AND CAST(ts AS DATE) = DATE '2024-01-05'
""")
def event_day_query(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")
    return C.request_query(e, date_cols=("ts",), event_type="CLICK", ts="2024-01-05")


@register("nation_not_in", ("F5", "F6"), """
SELECT n_nationkey, n_name FROM nation
WHERE NOT coalesce(n_regionkey IN (1, 3), false) AND regexp_matches(n_name, '_1')
""")
def nation_not_in(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    return n.where(C.not_in("n_regionkey", [1, 3]) & C.matches("n_name", "_1")).select("n_nationkey", "n_name")


@register("geo_tree", ("R8", "R4"), """
WITH RECURSIVE p AS (
  SELECT DISTINCT string_split(r.r_name || '/' || n.n_name || '/' || c.c_mktsegment, '/') AS parts
  FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey),
nodes AS (SELECT DISTINCT parts[1:d] AS key, CAST(d AS INTEGER) AS depth
          FROM p, range(1, len(parts) + 1) t(d)),
nn AS (SELECT key, depth, key[depth] AS name, CASE WHEN depth > 1 THEN key[1:depth - 1] ELSE [] END AS parent
       FROM nodes),
fl AS (SELECT nn.*, name = max(name) OVER (PARTITION BY parent) AS is_last FROM nn),
kids AS (SELECT parent AS key, COUNT(*) AS children FROM nn GROUP BY 1),
pads AS (SELECT f.key, string_agg(CASE WHEN a.is_last THEN '    ' ELSE '│' || chr(160) || chr(160) || ' ' END, '' ORDER BY a.depth) AS pad
         FROM fl f JOIN fl a ON a.depth < f.depth AND a.key = f.key[1:a.depth] GROUP BY f.key)
SELECT array_to_string(fl.key, '/') AS path, fl.key, fl.depth, fl.name, CAST(coalesce(k.children, 0) AS BIGINT) AS children,
       fl.is_last, coalesce(pads.pad, '') || CASE WHEN fl.is_last THEN '└── ' ELSE '├── ' END || fl.name AS line
FROM fl LEFT JOIN kids k ON fl.key = k.key LEFT JOIN pads ON fl.key = pads.key
""")
def geo_tree(spark, sf_dir):
    g = customers_geo(spark, sf_dir)
    paths = g.select(F.concat_ws("/", "r_name", "n_name", "c_mktsegment").alias("path"))
    return R.path_tree(paths)
