"""Plans over the intake of pages: the orders of each year are a set of pages,
landed by Spark in two waves that overlap."""

from __future__ import annotations

from pyspark.sql import functions as F

from civicframe.operators import windows as W
from civicframe.plans.registry import register, table
from civicframe.session import scratch_path
from civicframe.streaming import page_intake as P

_COLS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")


def order_pages(spark, sf_dir):
    """(set, offset, data): a set a year of orders, with the empty page that
    ends it; and the records' type."""
    o = table(spark, sf_dir, "orders").select(F.coalesce(F.year("o_orderdate"), F.lit(0)).cast("string").alias("set"), *_COLS)
    record = o.select(*_COLS).schema
    n = W.numbered(o, list(_COLS), ["set"])
    offset = (F.col("rn") - 1 - (F.col("rn") - 1) % P.PAGE_SIZE).cast("long")
    # a page is at most PAGE_SIZE records
    pages = n.groupBy("set", offset.alias("offset")).agg(F.collect_list(F.struct(*_COLS)).alias("data"))
    ends = pages.groupBy("set").agg((F.max("offset") + P.PAGE_SIZE).alias("offset")) \
        .select("set", "offset", F.array().cast("array<string>").alias("data"))
    ends = ends.withColumn("data", F.from_json(F.lit("[]"), pages.schema["data"].dataType))
    return pages.unionByName(ends), record


def _take_in(spark, waves, record, landed):
    out, checkpoint = scratch_path(spark, "intake"), scratch_path(spark, "intake-state")
    for i, wave in enumerate(waves):
        wave.write.json(f"{landed}/wave={i}", ignoreNullFields=False)
        P.start_page_intake(spark, f"{landed}/*", record, out, "order_pages", checkpoint=checkpoint).awaitTermination()
    return out


@register("order_page_intake", ("S4", "A7"), f"SELECT DISTINCT {', '.join(_COLS)} FROM orders")
def order_page_intake(spark, sf_dir):
    """Two thirds of the pages, then all of them again."""
    pages, record = order_pages(spark, sf_dir)
    first = pages.where(F.floor(F.col("offset") / P.PAGE_SIZE) % 3 < 2)
    out = _take_in(spark, [first, pages], record, scratch_path(spark, "landed"))
    return P.intake_rows(spark, out, record)


@register("order_page_sets", ("S4",), f"""
WITH s AS (SELECT coalesce(year(o_orderdate), 0) AS y, COUNT(*) AS n FROM orders GROUP BY 1),
p AS (SELECT y, n, CAST(ceil(n / {P.PAGE_SIZE}.0) AS BIGINT) AS pages FROM s),
g AS (SELECT *, y % 2 = 0 AND pages > 1 AS gap, y % 3 <> 0 AS ended,
             CASE WHEN pages = 2 THEN n - {P.PAGE_SIZE} ELSE {P.PAGE_SIZE} END AS second FROM p)
SELECT CAST(y AS VARCHAR) AS set, pages - CAST(gap AS BIGINT) AS n_pages, n - CASE WHEN gap THEN second ELSE 0 END AS n_rows,
       CASE WHEN ended THEN pages * {P.PAGE_SIZE} END AS end_offset,
       CAST(gap AND (ended OR pages > 2) AS BIGINT) AS n_missing, CAST(0 AS BIGINT) AS n_short, ended AND NOT gap AS complete
FROM g
""")
def order_page_sets(spark, sf_dir):
    """Even years lack their second page, years that three divides their end."""
    pages, record = order_pages(spark, sf_dir)
    year = F.col("set").cast("int")
    filled = F.size("data") > 0
    come = F.when(filled, (year % 2 != 0) | (F.col("offset") != P.PAGE_SIZE)).otherwise(year % 3 != 0)
    landed = pages.where(come)
    out = _take_in(spark, [landed, landed.where(filled)], record, scratch_path(spark, "landed"))
    return P.page_sets(spark, out, record)
