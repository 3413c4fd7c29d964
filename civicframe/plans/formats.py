"""Plans for the scalar, date and reshape helpers: parsing and zones, year
labels, number formats, positional renames, label standardising and
union by name."""

from __future__ import annotations

from pyspark.sql import functions as F

from civicframe.functions import strings as X
from civicframe.functions import times as T
from civicframe.operators import columns as C
from civicframe.operators import ordering as O
from civicframe.operators import reshape as R
from civicframe.plans.registry import register, table

# Standard label and concept of each part type (R5 lookup).
TYPE_LABELS = [("ECONOMY", "Economy", "Price tier"), ("PROMO", "Promotion", "Price tier"),
               ("STANDARD", "Standard", "Price tier"), ("SMALL", "Small", "Size"), ("LARGE", "Large", "Size")]


@register("order_date_text", ("T1", "T2", "X1"), """
WITH o AS (SELECT o_orderkey, o_orderdate, strftime(o_orderdate, '%m/%d/%Y %I:%M:%S %p') AS date_text FROM orders)
SELECT o_orderkey, date_text, strptime(date_text, '%m/%d/%Y %I:%M:%S %p') AS parsed,
       timezone('US/Central', timezone('UTC', o_orderdate)) AS central, lower(date_text) AS lowered
FROM o
""")
def order_date_text(spark, sf_dir):
    """Dates written the 311 way (``03/09/2024 07:27:09 AM``) and parsed
    back; the instant shown on a US/Central clock."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    o = o.withColumn("date_text", F.date_format("o_orderdate", T.MDY_HMS))
    return o.select("o_orderkey", "date_text", T.parse_timestamp("date_text", T.MDY_HMS).alias("parsed"),
                    T.to_zone("o_orderdate", "US/Central").alias("central"), X.lower("date_text").alias("lowered"))


@register("five_year_windows", ("T11", "A5"), """
WITH y AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, COUNT(*) AS n FROM orders GROUP BY 1),
m AS (SELECT MAX(year) AS max_year FROM y)
SELECT year, CAST(year - 4 AS VARCHAR) || '-' || CAST(year AS VARCHAR) AS period, n
FROM y, m WHERE (max_year - year) % 5 = 0
""")
def five_year_windows(spark, sf_dir):
    y = table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.count(F.lit(1)).alias("n"))
    # the newest year: a one-row aggregate, used as a literal
    max_year = y.agg(F.max("year")).first()[0]
    return y.where(T.non_overlapping_five_year("year", F.lit(max_year))) \
        .select("year", T.five_year_label("year").alias("period"), "n")


@register("priority_totals_text", ("X12", "X13", "X10"), r"""
SELECT o_orderpriority, format('{:,}', CAST(round(SUM(o_totalprice)) AS BIGINT)) AS total_text,
       CAST(round(SUM(o_totalprice)) AS BIGINT) AS total
FROM orders GROUP BY 1
""")
def priority_totals_text(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    t = o.groupBy("o_orderpriority").agg(F.round(F.sum("o_totalprice")).cast("long").alias("total"))
    return t.select("o_orderpriority", X.thousands("total").alias("total_text"), "total")


@register("event_prop_numbers", ("X13", "X5"), r"""
SELECT event_id, TRY_CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS INTEGER) AS k,
       regexp_replace(props, '[0-9]', '') AS props_first_digit_removed
FROM events
""")
def event_prop_numbers(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "props")
    k = X.to_number(F.regexp_extract("props", r'"k": ([0-9]+)', 1), "int")
    return e.select("event_id", k.alias("k"), X.remove_first("props", "[0-9]").alias("props_first_digit_removed"))


@register("conversation_columns", ("F2", "F9", "X3", "X11"), r"""
SELECT conv_id AS conversation, turn AS turn_no, role AS speaker,
       nullif(trim(regexp_replace(text, '\s+', ' ', 'g')), '') AS body,
       CAST(length(text) AS INTEGER) AS n_chars
FROM conversations
""")
def conversation_columns(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    c = C.rename_positional(c, ["conversation", "turn_no", "speaker"])
    c = c.withColumn("n_chars", X.text_length("text")).withColumn("body", X.squish("text"))
    return C.blank_to_null(c, ["body"]).drop("text")


@register("part_type_labels", ("R5", "R6", "J5"), """
WITH lk AS (SELECT * FROM (VALUES """ + ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in TYPE_LABELS) + """)
            t(raw, label, concept)),
p AS (SELECT p_partkey, p_type, string_split(p_name, ' ') AS w FROM part)
SELECT p.p_partkey, coalesce(lk.label, p.p_type) AS p_type, lk.concept AS concept,
       p.p_type AS universe, concat_ws('!!', w[1], w[2]) AS label
FROM p LEFT JOIN lk ON p.p_type = lk.raw
""")
def part_type_labels(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_type", F.split("p_name", " ").alias("w"))
    lk = spark.createDataFrame(TYPE_LABELS, "raw string, label string, concept string")
    std = R.standardise_labels(p.withColumn("description_1", F.col("p_type")), "p_type", lk)
    d = std.select("p_partkey", "p_type", "concept", "description_1", F.col("w")[0].alias("description_2"),
                   F.col("w")[1].alias("description_3"), F.lit(None).cast("string").alias("description_4"),
                   F.lit(None).cast("string").alias("description_5"))
    return R.universe_and_label(d).select("p_partkey", "p_type", "concept", "universe", "label")


@register("yearly_union_by_name", ("O5", "J3"), """
SELECT CAST(year(o_orderdate) AS INTEGER) AS year, COUNT(*) AS n_orders, 'orders' AS dataset FROM orders GROUP BY 1
UNION ALL BY NAME
SELECT CAST(year(l_shipdate) AS INTEGER) AS year, COUNT(*) AS n_lines, 'lineitem' AS dataset FROM lineitem GROUP BY 1
""")
def yearly_union_by_name(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("year")) \
        .agg(F.count(F.lit(1)).alias("n_orders")).withColumn("dataset", F.lit("orders"))
    li = table(spark, sf_dir, "lineitem").groupBy(F.year("l_shipdate").alias("year")) \
        .agg(F.count(F.lit(1)).alias("n_lines")).withColumn("dataset", F.lit("lineitem"))
    return O.union_by_name(o, li)
