"""Plans that go through the sources and sinks: CSV round trip and the
idempotent partitioned cache, on data derived from the driver's tables.

Files go under the session's shared checkpoint folder
(``spark.checkpoint.dir``), one new sub-folder per call.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from civicframe.session import scratch_path
from civicframe.sources import readers as S
from civicframe.sources import sinks as K
from civicframe.plans.registry import register, table


@register("orders_csv_round_trip", ("K1", "S1"), "SELECT * FROM orders")
def orders_csv_round_trip(spark, sf_dir):
    """The whole table to CSV and back, times to the microsecond."""
    out = scratch_path(spark, "orders-csv")
    o = table(spark, sf_dir, "orders")
    K.write_csv(o, out)
    return S.read_csv(spark, out, o.schema)


@register("daily_event_cache", ("K3", "K4", "K2", "S8"), """
WITH d AS (SELECT CAST(year(ts) AS INTEGER) AS year, CAST(month(ts) AS INTEGER) AS month,
                  CAST(ts AS DATE) AS day, event_type, COUNT(*) AS n, ROUND(SUM(value), 2) AS total
           FROM events GROUP BY 1, 2, 3, 4),
m AS (SELECT MAX(year) AS y FROM d)
SELECT d.* FROM d, m WHERE d.year = m.y
""")
def daily_event_cache(spark, sf_dir):
    """Daily totals per event type appended to a cache partitioned by year
    and month -- twice, the second time adding nothing -- then read through
    the cache for the newest year."""
    path = scratch_path(spark, "event-cache")
    e = table(spark, sf_dir, "events")
    d = e.groupBy(F.year("ts").alias("year"), F.month("ts").alias("month"), F.to_date("ts").alias("day"),
                  "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))
    keys = ("year", "month", "day", "event_type")
    K.append_to_cache(d, path, keys=keys, partition_by=("year", "month"))
    K.append_to_cache(d, path, keys=keys, partition_by=("year", "month"))
    return K.read_cache(spark, path).select("year", "month", "day", "event_type", "n", "total")
