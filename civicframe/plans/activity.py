"""Time-stamped activity plans (the sleep analysis of P3 on ``events``).

``events.value`` is read as a duration in seconds; ``ts`` is the time it
was recorded. A "day" is the calendar day of ``ts`` per user.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from civicframe.functions import times as T
from civicframe.operators import aggregate as A
from civicframe.operators import windows as W
from civicframe.plans.registry import register, table

# Fixed value: clock cut of the page; times at or before 18:00 count as
# the next day when sorting bed times.
BED_CUT = 64800
# Fixed value: 7 hours, the nightly target of the sleep-debt sum.
TARGET_SECONDS = 25200
# Days off besides weekends (US federal holidays, Jan 2024).
HOLIDAYS = ["2024-01-01", "2024-01-15"]


def daily(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("user_id", "ts", "value")
    return ev.groupBy("user_id", T.day("ts").alias("day")).agg(
        F.sum("value").alias("total"),
        F.min(T.clock_seconds("ts", BED_CUT)).alias("bed"),
        F.max(T.clock_seconds("ts", BED_CUT)).alias("rise"))


@register("duration_by_weekday", ("A1", "A2", "T3", "T8"), """
WITH daily AS (
  SELECT user_id, CAST(ts AS DATE) AS day, SUM(value) AS total FROM events GROUP BY 1, 2)
SELECT CAST(dayofweek(day) + 1 AS INTEGER) AS weekday, strftime(day, '%a') AS weekday_label,
       COUNT(*) AS n_days,
       CAST((2 * SUM(CAST(round(total * 100) AS BIGINT)) * 100 + COUNT(*)) // (2 * COUNT(*)) AS DOUBLE) / 10000
         AS mean_seconds,
       printf('%dH %dM %dS', (SUM(CAST(round(total * 100) AS BIGINT)) // (COUNT(*) * 100)) // 3600,
              ((SUM(CAST(round(total * 100) AS BIGINT)) // (COUNT(*) * 100)) % 3600) // 60,
              (SUM(CAST(round(total * 100) AS BIGINT)) // (COUNT(*) * 100)) % 60) AS readable
FROM daily GROUP BY 1, 2
""")
def duration_by_weekday(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("user_id", "ts", "value")
    d = ev.select("user_id", T.day("ts").alias("day"), "value")
    d = d.groupBy("user_id", "day").agg(F.sum("value").alias("total"))
    d = d.select("total", T.weekday("day").alias("weekday"), T.weekday_label("day").alias("weekday_label"))
    out = d.groupBy("weekday", "weekday_label").agg(
        F.count(F.lit(1)).alias("n_days"), F.sum(F.round(F.col("total") * 100).cast("long")).alias("cents"))
    whole_seconds = F.expr("cents div (n_days * 100)")
    return out.select("weekday", "weekday_label", "n_days", fixed_point_mean("cents", "n_days", 100, 4).alias("mean_seconds"),
                      T.readable_duration(whole_seconds).alias("readable"))


def fixed_point_mean(total_units, n, units_per_one: int, decimals: int):
    """Mean of values held as whole units (e.g. cents), rounded half up to
    ``decimals`` with integer arithmetic only, so every engine that sums the
    same integers prints the same number."""
    scale = 10 ** decimals
    num = F.lit(2) * F.col(total_units) * F.lit(scale // units_per_one if scale >= units_per_one else 1) + F.col(n)
    return (F.floor(num / (F.lit(2) * F.col(n))).cast("long").cast("double") / F.lit(scale))


@register("weekly_stats", ("A3", "T3", "T5"), f"""
WITH ev AS (
  SELECT user_id, CAST(ts AS DATE) AS day, value,
         hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS s FROM events),
daily AS (
  SELECT user_id, day, SUM(value) AS total,
         MIN(CASE WHEN s <= {BED_CUT} THEN s + 86400 ELSE s END) AS bed FROM ev GROUP BY 1, 2)
SELECT CAST(floor((dayofyear(day) - 1) / 7) + 1 AS INTEGER) AS week,
       ROUND(AVG(total), 4) AS avg_total, ROUND(MIN(total), 4) AS min_total, ROUND(MAX(total), 4) AS max_total,
       ROUND(AVG(bed), 4) AS avg_bed, CAST(MIN(bed) AS INTEGER) AS min_bed, CAST(MAX(bed) AS INTEGER) AS max_bed
FROM daily GROUP BY 1
""")
def weekly_stats(spark, sf_dir):
    d = daily(spark, sf_dir).withColumn("week", T.week_number("day"))
    s = A.describe_by(d, ["week"], ["total", "bed"])
    return s.select("week", *[F.round(c, 4).alias(c) for c in ("avg_total", "min_total", "max_total", "avg_bed")],
                    "min_bed", "max_bed")


@register("monthly_means", ("A4", "T5"), f"""
WITH ev AS (
  SELECT user_id, CAST(ts AS DATE) AS day, value,
         hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS s FROM events),
daily AS (
  SELECT user_id, day, SUM(value) AS total,
         MIN(CASE WHEN s <= {BED_CUT} THEN s + 86400 ELSE s END) AS bed,
         MAX(CASE WHEN s <= {BED_CUT} THEN s + 86400 ELSE s END) AS rise FROM ev GROUP BY 1, 2),
m AS (SELECT CAST(year(day) AS INTEGER) AS year, CAST(month(day) AS INTEGER) AS month,
             AVG(total) AS t, AVG(bed) AS b, AVG(rise) AS r FROM daily GROUP BY 1, 2)
SELECT year, month, ROUND(t, 4) AS mean_total,
       ROUND(CASE WHEN b >= 86400 THEN b - 86400 ELSE b END, 4) AS mean_bed,
       ROUND(CASE WHEN r >= 86400 THEN r - 86400 ELSE r END, 4) AS mean_rise
FROM m
""")
def monthly_means(spark, sf_dir):
    d = daily(spark, sf_dir)
    m = d.groupBy(F.year("day").alias("year"), F.month("day").alias("month")).agg(
        F.avg("total").alias("t"), F.avg("bed").alias("b"), F.avg("rise").alias("r"))
    return m.select("year", "month", F.round("t", 4).alias("mean_total"),
                    F.round(T.unwrap_clock("b"), 4).alias("mean_bed"),
                    F.round(T.unwrap_clock("r"), 4).alias("mean_rise"))


@register("sleep_debt", ("A14", "A1"), f"""
WITH daily AS (SELECT user_id, CAST(ts AS DATE) AS day, SUM(value) AS total FROM events GROUP BY 1, 2)
SELECT user_id, ROUND(SUM({TARGET_SECONDS} - total), 2) AS debt, COUNT(*) AS n_days FROM daily GROUP BY 1
""")
def sleep_debt(spark, sf_dir):
    d = daily(spark, sf_dir)
    return d.groupBy("user_id").agg(F.round(F.sum(F.lit(TARGET_SECONDS) - F.col("total")), 2).alias("debt"),
                                    F.count(F.lit(1)).alias("n_days"))


_HOL_SQL = ", ".join(f"(DATE '{h}')" for h in HOLIDAYS)


@register("work_off_days", ("T10", "J4"), f"""
WITH daily AS (SELECT user_id, CAST(ts AS DATE) AS day, SUM(value) AS total FROM events GROUP BY 1, 2),
hol AS (SELECT * FROM (VALUES {_HOL_SQL}) t(day)),
flag AS (
  SELECT d.*, CASE WHEN dayofweek(d.day) IN (0, 6) OR h.day IS NOT NULL THEN 'offwork' ELSE 'work' END AS off_work
  FROM daily d LEFT JOIN hol h ON d.day = h.day)
SELECT off_work, COUNT(*) AS n_days, ROUND(AVG(total), 4) AS mean_total FROM flag GROUP BY 1
""")
def work_off_days(spark, sf_dir):
    d = daily(spark, sf_dir)
    hol = spark.createDataFrame([(h,) for h in HOLIDAYS], "d string") \
        .select(F.to_date("d").alias("day"), F.lit(True).alias("holiday"))
    j = d.join(F.broadcast(hol), "day", "left")
    j = j.withColumn("off_work", F.when(T.is_off_day("day", "holiday"), "offwork").otherwise("work"))
    return j.groupBy("off_work").agg(F.count(F.lit(1)).alias("n_days"), F.round(F.avg("total"), 4).alias("mean_total"))


@register("bed_rise_times", ("T5", "W4"), f"""
WITH ev AS (
  SELECT user_id, CAST(ts AS DATE) AS day, event_id,
         hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS s0 FROM events),
sh AS (SELECT *, CASE WHEN s0 <= {BED_CUT} THEN s0 + 86400 ELSE s0 END AS s FROM ev),
m AS (SELECT user_id, day, MIN(s) AS mn FROM sh GROUP BY 1, 2)
SELECT sh.user_id, sh.day, sh.event_id,
       CAST(CASE WHEN sh.s >= 86400 THEN sh.s - 86400 ELSE sh.s END AS INTEGER) AS bed_clock
FROM sh JOIN m ON sh.user_id = m.user_id AND sh.day = m.day AND sh.s = m.mn
""")
def bed_rise_times(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    sh = ev.select("user_id", T.day("ts").alias("day"), "event_id", T.clock_seconds("ts", BED_CUT).alias("s"))
    first = W.rows_at_group_extreme(sh, ["user_id", "day"], "s", "min")
    return first.select("user_id", "day", "event_id", T.unwrap_clock("s").cast("int").alias("bed_clock"))


@register("daily_trend", ("W5", "A1"), """
WITH d AS (
  SELECT event_type, CAST(ts AS DATE) AS day, SUM(value) AS total FROM events GROUP BY 1, 2),
x AS (SELECT *, CAST(day - DATE '2024-01-01' AS INTEGER) AS x FROM d)
SELECT event_type, day, ROUND(total, 4) AS total,
  ROUND(regr_intercept(total, x) OVER w + regr_slope(total, x) OVER w * x, 4) AS trend
FROM x WINDOW w AS (PARTITION BY event_type ORDER BY x RANGE BETWEEN 7 PRECEDING AND 7 FOLLOWING)
""")
def daily_trend(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("event_type", "ts", "value")
    d = ev.groupBy("event_type", T.day("ts").alias("day")).agg(F.sum("value").alias("total"))
    d = d.withColumn("x", F.datediff("day", F.to_date(F.lit("2024-01-01"))))
    t = W.local_linear_trend(d, ["event_type"], "x", "total", 7)
    return t.select("event_type", "day", F.round("total", 4).alias("total"), F.round("trend", 4).alias("trend"))


@register("orders_per_running_week", ("T7", "T3", "A5"), """
WITH o AS (SELECT CAST(floor((dayofyear(o_orderdate) - 1) / 7) + 1 AS INTEGER)
                   + 52 * (CAST(year(o_orderdate) AS INTEGER) - 1995) AS running_week FROM orders)
SELECT running_week, COUNT(*) AS n FROM o GROUP BY 1
""")
def orders_per_running_week(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(T.running_week("o_orderdate", 1995).alias("running_week"))
    return o.groupBy("running_week").agg(F.count(F.lit(1)).alias("n"))


@register("night_dates", ("T6", "T4", "T9"), """
WITH e AS (
  SELECT event_id, ts AS start_ts,
         ts + to_microseconds(CAST(round(value * 3600) AS BIGINT) * 1000000) AS end_ts,
         ts + to_microseconds(CAST(round(value * 1000) AS BIGINT) * 1000000) AS created_ts FROM events)
SELECT event_id,
  CASE WHEN CAST(created_ts AS DATE) - CAST(start_ts AS DATE) >= 2 THEN CAST(end_ts AS DATE)
       ELSE CAST(created_ts AS DATE) END AS night,
  CAST(date_diff('second', start_ts, end_ts) AS BIGINT) AS seconds,
  CAST(start_ts AS DATE) = DATE '2024-01-05' AS on_jan5
FROM e
""")
def night_dates(spark, sf_dir):
    """Each event as an interval: it lasts ``value`` hours and is written
    ``value`` * 1000 seconds after it starts (so some are written days
    later, which the night-date rule repairs)."""
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "value")
    e = ev.select("event_id", F.col("ts").alias("start_ts"),
                  F.timestamp_add("SECOND", F.round(F.col("value") * 3600).cast("long"), "ts").alias("end_ts"),
                  F.timestamp_add("SECOND", F.round(F.col("value") * 1000).cast("long"), "ts").alias("created_ts"))
    return e.select("event_id", T.night_date("created_ts", "start_ts", "end_ts").alias("night"),
                    T.duration_seconds("start_ts", "end_ts").alias("seconds"),
                    T.same_day("start_ts", "2024-01-05").alias("on_jan5"))


@register("activity_rank_correlations", ("A10", "W3", "T10", "T5"), f"""
WITH ev AS (
  SELECT user_id, CAST(ts AS DATE) AS day, value,
         hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS s FROM events),
d AS (
  SELECT user_id, day, SUM(value) AS total,
         MIN(CASE WHEN s <= {BED_CUT} THEN s + 86400 ELSE s END) AS bed,
         MAX(CASE WHEN s <= {BED_CUT} THEN s + 86400 ELSE s END) AS rise FROM ev GROUP BY 1, 2),
hol AS (SELECT * FROM (VALUES {_HOL_SQL}) t(day)),
f AS (SELECT d.*, CASE WHEN dayofweek(d.day) IN (0, 6) OR h.day IS NOT NULL THEN 'offwork' ELSE 'work' END AS off_work
      FROM d LEFT JOIN hol h ON d.day = h.day),
r AS (SELECT off_work,
        row_number() OVER (PARTITION BY off_work ORDER BY total DESC, day, user_id) AS total_rank,
        row_number() OVER (PARTITION BY off_work ORDER BY bed, day, user_id) AS bed_rank,
        row_number() OVER (PARTITION BY off_work ORDER BY rise, day, user_id) AS rise_rank FROM f)
SELECT off_work, COUNT(*) AS n_days,
       ROUND(corr(CAST(total_rank AS DOUBLE), CAST(bed_rank AS DOUBLE)), 8) AS total_vs_bed,
       ROUND(corr(CAST(bed_rank AS DOUBLE), CAST(rise_rank AS DOUBLE)), 8) AS bed_vs_rise,
       ROUND(corr(CAST(total_rank AS DOUBLE), CAST(rise_rank AS DOUBLE)), 8) AS total_vs_rise
FROM r GROUP BY 1
""")
def activity_rank_correlations(spark, sf_dir):
    """The sleep page's ranking (most sleep, earliest bed, earliest rise;
    row numbers, ties by night then user) per work / off-day group, and
    the correlations between the ranks."""
    d = daily(spark, sf_dir)
    hol = spark.createDataFrame([(h,) for h in HOLIDAYS], "d string") \
        .select(F.to_date("d").alias("day"), F.lit(True).alias("holiday"))
    f = d.join(F.broadcast(hol), "day", "left") \
        .withColumn("off_work", F.when(T.is_off_day("day", "holiday"), "offwork").otherwise("work")) \
        .select("user_id", "day", "total", "bed", "rise", "off_work")
    r = W.numbered_many(f, {"total_rank": [("total", False)], "bed_rank": [("bed", True)], "rise_rank": [("rise", True)]},
                        ["off_work"], ["day", "user_id"])
    c = lambda a, b: F.round(F.corr(F.col(a).cast("double"), F.col(b).cast("double")), 8)
    return r.groupBy("off_work").agg(F.count(F.lit(1)).alias("n_days"), c("total_rank", "bed_rank").alias("total_vs_bed"),
                                     c("bed_rank", "rise_rank").alias("bed_vs_rise"),
                                     c("total_rank", "rise_rank").alias("total_vs_rise"))
