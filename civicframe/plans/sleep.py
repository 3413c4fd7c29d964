"""Health-export XML to nightly sleep summaries.

Input is the export's ``<Record>`` elements; everything downstream is one
DataFrame plan. Shuffles: the per-night sums, the per-weekday means and
the per-night extremes (partial aggregates).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicframe.functions import times as T
from civicframe.operators import aggregate as A
from civicframe.operators import windows as W
from civicframe.sources.readers import read_xml_records

# The record attributes read, and the prefixes dropped from
# type and value codes.
RECORD_ATTRS = ["type", "sourceName", "sourceVersion", "creationDate", "startDate", "endDate", "value", "unit"]
TYPE_PREFIX = "HK(Category|Quantity)TypeIdentifier"
VALUE_PREFIX = "HKCategoryValue(SleepAnalysis)?"
ZONE = "US/Central"
CLOCK_CUT = 64800          # 18:00; earlier clock times count as the next day
TARGET_SECONDS = 25200     # 7 hours


def records(spark: SparkSession, path: str) -> DataFrame:
    """S3 + T1 + T2 + X5: records with parsed local times and short codes."""
    r = read_xml_records(spark, path, RECORD_ATTRS)
    dates = {c: T.to_zone(T.parse_timestamp(c, T.ISO_WITH_OFFSET), ZONE) for c in ("creationDate", "startDate", "endDate")}
    return r.withColumns(dates).withColumns({
        "type": F.regexp_replace("type", TYPE_PREFIX, ""),
        "value": F.regexp_replace("value", VALUE_PREFIX, ""),
    })


def sleep_records(recs: DataFrame) -> DataFrame:
    """F5 + F1: sleep rows without the type and unit columns."""
    return recs.where(F.col("type") == "SleepAnalysis").drop("type", "unit")


def asleep(sleep: DataFrame) -> DataFrame:
    """Asleep stages only; stage name without the ``Asleep`` prefix; the
    night (``creationDate``) repaired for records written two or more days
    late (T6); source columns dropped."""
    a = sleep.where(F.col("value").contains("Asleep"))
    a = a.withColumns({
        "value": F.regexp_replace("value", "^(.*?)Asleep", "$1"),
        "creationDate": T.night_date("creationDate", "startDate", "endDate"),
    })
    return a.drop(*[c for c in a.columns if c.startswith("source")])


def with_duration(a: DataFrame, out: str = "seconds") -> DataFrame:
    return a.withColumn(out, T.duration_seconds("startDate", "endDate"))


def nightly_totals(a: DataFrame) -> DataFrame:
    """A1: seconds asleep per night."""
    return A.sum_by(with_duration(a), ["creationDate"], "seconds", "daily_sleep")


def sleep_by_weekday(a: DataFrame) -> DataFrame:
    """A2 + T3 + T8: mean night per weekday, readable."""
    n = nightly_totals(a)
    n = n.select("daily_sleep", T.weekday("creationDate").alias("wday"),
                 F.date_format("creationDate", "EEEE").alias("wday_label"))
    m = n.groupBy("wday", "wday_label").agg(F.avg("daily_sleep").alias("wday_sleep"))
    return m.withColumn("readable", T.readable_duration("wday_sleep"))


def stage_by_night(a: DataFrame) -> DataFrame:
    """A1: seconds per night and stage."""
    return A.sum_by(with_duration(a), ["creationDate", "value"], "seconds", "cycle_amount")


def stage_shares(a: DataFrame, exclude=("Unspecified",)) -> DataFrame:
    """Each stage's share of all sleep, without unspecified sleep."""
    s = with_duration(a).where(~F.col("value").isin(list(exclude)))
    return A.share_of_total(s, [], ["value"], "seconds", "seconds", "share")


def cycle_activity(a: DataFrame, cut: int = CLOCK_CUT) -> DataFrame:
    """T5: start and end clock times, times at or before the cut moved to
    the next day so a night reads as one block."""
    return a.withColumns({"start_time": T.clock_seconds("startDate", cut),
                          "end_time": T.clock_seconds("endDate", cut)})


def sleep_start_end(a: DataFrame, cut: int = CLOCK_CUT) -> tuple[DataFrame, DataFrame]:
    """Per night the record(s) with the earliest start and the latest
    end (ties kept)."""
    c = cycle_activity(a, cut)
    return (W.rows_at_group_extreme(c, ["creationDate"], "start_time", "min"),
            W.rows_at_group_extreme(c, ["creationDate"], "end_time", "max"))


def monthly_summary(a: DataFrame, cut: int = CLOCK_CUT) -> DataFrame:
    """A4: per month the mean night and mean bed / rise clock time."""
    n = nightly_totals(a)
    c = cycle_activity(a, cut).groupBy("creationDate").agg(F.min("start_time").alias("bed"),
                                                           F.max("end_time").alias("rise"))
    j = n.join(c, "creationDate")
    m = j.groupBy(F.year("creationDate").alias("year"), F.month("creationDate").alias("month")).agg(
        F.avg("daily_sleep").alias("mean_sleep"), F.avg("bed").alias("mean_bed"), F.avg("rise").alias("mean_rise"))
    return m.withColumns({"readable": T.readable_duration("mean_sleep"),
                          "mean_bed": T.unwrap_clock("mean_bed"), "mean_rise": T.unwrap_clock("mean_rise")})


def heatmap(a: DataFrame, base_year: int | None = None) -> DataFrame:
    """Nightly totals by weekday and running week."""
    n = nightly_totals(a)
    if base_year is None:
        # One row per night: the first year is a tiny aggregate.
        base_year = n.agg(F.min(F.year("creationDate"))).first()[0]
    return n.withColumns({"wday": T.weekday_label("creationDate"), "year": F.year("creationDate"),
                          "week": T.running_week("creationDate", base_year)})


def sleep_debt(a: DataFrame, target: int = TARGET_SECONDS) -> DataFrame:
    """Hours of sleep debt over all nights."""
    n = nightly_totals(a)
    return n.agg((F.sum(F.lit(target) - F.col("daily_sleep")) / 3600).alias("debt_hours"))


def weekly_again(a: DataFrame, off_days: DataFrame, cut: int = 48000) -> DataFrame:
    """T10 + J4 + X14: per night total, first start and last end (ties
    removed before joining), work/off label and mid-sleep time."""
    n = nightly_totals(a)
    c = cycle_activity(a, cut)
    first = c.groupBy("creationDate").agg(F.min("start_time").alias("start_time"))
    last = c.groupBy("creationDate").agg(F.max("end_time").alias("end_time"))
    j = n.join(first, "creationDate", "left").join(last, "creationDate", "left") \
        .join(F.broadcast(off_days), "creationDate", "left")
    return j.withColumns({
        "week": T.week_number("creationDate"),
        "off_work": F.when(T.is_off_day("creationDate", "holiday"), "offwork").otherwise("work"),
        "mid_sleep": (F.col("start_time") + F.col("end_time")) / 2,
    }).drop("holiday")


def rank_correlations(weekly: DataFrame) -> DataFrame:
    """A10 + W3: per work/off group the five row-number ranks of the script
    and the eight correlations it prints.

    R's ``arrange`` is stable and each ranking re-sorts the previous one,
    so ties fall back on the previous order; the tie keys below spell that
    chain out (the night last, standing for the original row order).
    All five come from one range exchange."""
    total, bed, rise = ("daily_sleep", False), "start_time", "end_time"
    r = W.numbered_many(weekly.select("off_work", "creationDate", "daily_sleep", "start_time", "end_time"), {
        "total_sleep_rank": [total],
        "early_bed_rank": [(bed, True), total],
        "early_rise_rank": [(rise, True), (bed, True), total],
        "late_rise_rank": [(rise, False), (bed, True), total],
        "late_bed_rank": [(bed, False), (rise, False), (bed, True), total],
    }, ["off_work"], ["creationDate"])
    pairs = [("total_sleep_rank", "early_bed_rank"), ("early_bed_rank", "early_rise_rank"),
             ("total_sleep_rank", "early_rise_rank"), ("late_rise_rank", "early_bed_rank"),
             ("late_rise_rank", "total_sleep_rank"), ("late_bed_rank", "total_sleep_rank"),
             ("late_bed_rank", "early_rise_rank"), ("late_bed_rank", "late_rise_rank")]
    return r.groupBy("off_work").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{a[:-5]}_vs_{b[:-5]}") for a, b in pairs])


def weekly_clock_summary(weekly: DataFrame) -> DataFrame:
    """A3: per week mean start and end, earliest start and latest end,
    shown as clock times."""
    s = weekly.groupBy("week").agg(F.avg("start_time").alias("avg_start_time"), F.avg("end_time").alias("avg_end_time"),
                                   F.min("start_time").alias("earliest_time"), F.max("end_time").alias("latest_time"))
    return s.withColumns({c: T.unwrap_clock(c) for c in ("avg_start_time", "avg_end_time", "earliest_time", "latest_time")})


def fit_by_group(weekly: DataFrame, x: str = "mid_sleep") -> DataFrame:
    """Straight line of total sleep on ``x`` per work/off group."""
    return A.linear_fit(weekly, ["off_work"], x, "daily_sleep")


def start_histogram(weekly: DataFrame, bins: int = 30) -> DataFrame:
    """Histogram of start times per work/off group."""
    return A.histogram(weekly, "start_time", bins, ["off_work"])


# --- the pipeline on the driver's tables ------------------------------------

from civicframe.plans.registry import register, table  # noqa: E402

# How event types stand in for sleep stages.
STAGE_OF_EVENT = {"click": "AsleepCore", "view": "AsleepDeep", "purchase": "AsleepREM",
                  "signup": "AsleepUnspecified", "error": "InBed"}
OTHER_STAGE = "AsleepUnspecified"  # any other event type


def events_as_export(spark, sf_dir, path: str) -> None:
    """Write ``events`` as a health export: one ``<Record>`` per event; the
    stage from the event type, the interval ``value`` minutes long from the
    event's second, written ``event_id % 3`` days after it ended."""
    e = table(spark, sf_dir, "events")
    stage = F.lit(OTHER_STAGE)
    for k, v in STAGE_OF_EVENT.items():
        stage = F.when(F.col("event_type") == k, F.lit(v)).otherwise(stage)
    start = F.date_trunc("second", F.col("ts"))
    end = F.timestamp_add("SECOND", F.round(F.col("value") * 60).cast("long"), start)
    created = F.timestamp_add("DAY", (F.col("event_id") % 3).cast("int"), end)
    fmt = "yyyy-MM-dd HH:mm:ss '+0000'"
    rec = e.select(
        F.lit("HKCategoryTypeIdentifierSleepAnalysis").alias("_type"),
        F.when(F.col("user_id") % 2 == 0, "Watch").otherwise("Phone").alias("_sourceName"),
        F.lit("10.1").alias("_sourceVersion"),
        F.date_format(created, fmt).alias("_creationDate"), F.date_format(start, fmt).alias("_startDate"),
        F.date_format(end, fmt).alias("_endDate"),
        F.concat(F.lit("HKCategoryValueSleepAnalysis"), stage).alias("_value"))
    rec.write.mode("overwrite").format("xml").option("rowTag", "Record").option("rootTag", "HealthData").save(path)


_STAGE_SQL = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STAGE_OF_EVENT.items())


@register("sleep_nights_from_xml", ("S3", "T1", "T2", "T6", "T4", "A1"), f"""
WITH e AS (
  SELECT event_id, CASE event_type {_STAGE_SQL} ELSE '{OTHER_STAGE}' END AS stage,
         date_trunc('second', ts) AS s, CAST(round(value * 60) AS BIGINT) AS secs FROM events),
i AS (SELECT event_id, stage, secs, s AS start_utc, s + to_seconds(secs) AS end_utc,
             s + to_seconds(secs) + to_days(CAST(event_id % 3 AS INTEGER)) AS created_utc FROM e),
l AS (SELECT stage, secs,
             CAST(timezone('US/Central', timezone('UTC', start_utc)) AS DATE) AS start_day,
             CAST(timezone('US/Central', timezone('UTC', end_utc)) AS DATE) AS end_day,
             CAST(timezone('US/Central', timezone('UTC', created_utc)) AS DATE) AS created_day FROM i)
SELECT CASE WHEN created_day - start_day >= 2 THEN end_day ELSE created_day END AS creationDate,
       CAST(SUM(secs) AS BIGINT) AS daily_sleep
FROM l WHERE stage LIKE '%Asleep%' GROUP BY 1
""")
def sleep_nights_from_xml(spark, sf_dir):
    """Seconds asleep per night, read back from the XML export of the
    events (written under the session's checkpoint folder)."""
    return nightly_totals(exported_sleep(spark, sf_dir))


def exported_sleep(spark, sf_dir) -> DataFrame:
    """The sleep records of the events' export, read back from its XML."""
    from civicframe.session import scratch_path
    path = scratch_path(spark, "health-export")
    events_as_export(spark, sf_dir, path)
    return asleep(sleep_records(records(spark, path)))


# Days off besides weekends (US federal holidays, early 2024).
OFF_DAYS = [("2024-01-01", "New Year"), ("2024-01-15", "Martin Luther King Day")]


def _clock(x: str, cut: int) -> str:
    sec = f"(hour({x}) * 3600 + minute({x}) * 60 + CAST(second({x}) AS BIGINT))"
    return f"CASE WHEN {sec} <= {cut} THEN {sec} + 86400 ELSE {sec} END"


_SLEEP_SQL = f"""
WITH e AS (
  SELECT event_id, CASE event_type {_STAGE_SQL} ELSE '{OTHER_STAGE}' END AS stage,
         date_trunc('second', ts) AS s, CAST(round(value * 60) AS BIGINT) AS secs FROM events),
i AS (SELECT event_id, stage, secs, s AS start_utc, s + to_seconds(secs) AS end_utc,
             s + to_seconds(secs) + to_days(CAST(event_id % 3 AS INTEGER)) AS created_utc FROM e),
l AS (SELECT stage, secs, timezone('US/Central', timezone('UTC', start_utc)) AS s, timezone('US/Central', timezone('UTC', end_utc)) AS e,
             CAST(timezone('US/Central', timezone('UTC', created_utc)) AS DATE) AS created_day FROM i WHERE stage LIKE '%Asleep%'),
a AS (SELECT regexp_replace(stage, '^(.*?)Asleep', '\\1') AS stage, secs, s, e,
             CASE WHEN created_day - CAST(s AS DATE) >= 2 THEN CAST(e AS DATE) ELSE created_day END AS night FROM l),
n AS (SELECT night, SUM(secs) AS daily_sleep, MIN({_clock("s", 48000)}) AS start_time, MAX({_clock("e", 48000)}) AS end_time,
             MIN({_clock("s", CLOCK_CUT)}) AS bed, MAX({_clock("e", CLOCK_CUT)}) AS rise FROM a GROUP BY 1)
"""


@register("sleep_weekly_again", ("J4", "T10", "X14", "T5"), _SLEEP_SQL + f"""
SELECT night AS "creationDate", CAST(daily_sleep AS BIGINT) AS daily_sleep, CAST(start_time AS BIGINT) AS start_time, CAST(end_time AS BIGINT) AS end_time,
  CAST(floor((dayofyear(night) - 1) / 7) + 1 AS INTEGER) AS week,
  CASE WHEN dayofweek(night) IN (0, 6) OR night IN ({", ".join(f"DATE '{d}'" for d, _ in OFF_DAYS)}) THEN 'offwork' ELSE 'work' END AS off_work,
  (start_time + end_time) / 2 AS mid_sleep
FROM n
""")
def sleep_weekly_again(spark, sf_dir):
    return _weekly(spark, sf_dir).withColumns({c: F.col(c).cast("long") for c in ("start_time", "end_time")})


def _weekly(spark, sf_dir) -> DataFrame:
    off = spark.createDataFrame(OFF_DAYS, "d string, what string").select(F.to_date("d").alias("creationDate"), F.lit(True).alias("holiday"))
    return weekly_again(exported_sleep(spark, sf_dir), off)


@register("sleep_months", ("A4", "T5", "T8"), _SLEEP_SQL + """
, m AS (SELECT CAST(year(night) AS INTEGER) AS year, CAST(month(night) AS INTEGER) AS month, AVG(daily_sleep) AS t, AVG(bed) AS b, AVG(rise) AS r FROM n GROUP BY 1, 2)
SELECT year, month, ROUND(t, 4) AS mean_sleep, ROUND(CASE WHEN b >= 86400 THEN b - 86400 ELSE b END, 4) AS mean_bed,
       ROUND(CASE WHEN r >= 86400 THEN r - 86400 ELSE r END, 4) AS mean_rise FROM m
""")
def sleep_months(spark, sf_dir):
    m = monthly_summary(exported_sleep(spark, sf_dir))
    return m.select("year", "month", *[F.round(c, 4).alias(c) for c in ("mean_sleep", "mean_bed", "mean_rise")])


@register("sleep_first_and_last", ("W4",), _SLEEP_SQL + f"""
, c AS (SELECT night, secs, {_clock("s", CLOCK_CUT)} AS st, {_clock("e", CLOCK_CUT)} AS en FROM a)
SELECT 'first' AS part, c.night AS "creationDate", c.secs AS seconds FROM c JOIN n ON c.night = n.night AND c.st = n.bed
UNION ALL SELECT 'last', c.night, c.secs FROM c JOIN n ON c.night = n.night AND c.en = n.rise
""")
def sleep_first_and_last(spark, sf_dir):
    first, last = sleep_start_end(with_duration(exported_sleep(spark, sf_dir)))
    return first.select(F.lit("first").alias("part"), "creationDate", "seconds") \
        .union(last.select(F.lit("last"), "creationDate", "seconds"))


@register("sleep_stage_shares", ("A9",), _SLEEP_SQL + """
SELECT stage AS value, CAST(SUM(secs) AS BIGINT) AS seconds, ROUND(SUM(secs) / SUM(SUM(secs)) OVER (), 8) AS share
FROM a WHERE stage <> 'HKCategoryValueSleepAnalysisUnspecified' AND stage <> 'Unspecified' GROUP BY 1
""")
def sleep_stage_shares(spark, sf_dir):
    return stage_shares(exported_sleep(spark, sf_dir)).select("value", "seconds", F.round("share", 8).alias("share"))


@register("sleep_debt_hours", ("A14",), _SLEEP_SQL + f"SELECT ROUND(SUM({TARGET_SECONDS} - daily_sleep) / 3600, 6) AS debt_hours FROM n")
def sleep_debt_hours(spark, sf_dir):
    return sleep_debt(exported_sleep(spark, sf_dir)).select(F.round("debt_hours", 6).alias("debt_hours"))


@register("sleep_week_clocks", ("A3", "T5"), _SLEEP_SQL + """
, w AS (SELECT CAST(floor((dayofyear(night) - 1) / 7) + 1 AS INTEGER) AS week, AVG(start_time) AS a1, AVG(end_time) AS a2, MIN(start_time) AS b1, MAX(end_time) AS b2 FROM n GROUP BY 1)
SELECT week, ROUND(CASE WHEN a1 >= 86400 THEN a1 - 86400 ELSE a1 END, 4) AS avg_start_time, ROUND(CASE WHEN a2 >= 86400 THEN a2 - 86400 ELSE a2 END, 4) AS avg_end_time,
  CAST(CASE WHEN b1 >= 86400 THEN b1 - 86400 ELSE b1 END AS BIGINT) AS earliest_time, CAST(CASE WHEN b2 >= 86400 THEN b2 - 86400 ELSE b2 END AS BIGINT) AS latest_time FROM w
""")
def sleep_week_clocks(spark, sf_dir):
    w = weekly_clock_summary(_weekly(spark, sf_dir))
    return w.select("week", *[F.round(c, 4).alias(c) for c in ("avg_start_time", "avg_end_time")],
                    *[F.col(c).cast("long").alias(c) for c in ("earliest_time", "latest_time")])


_OFF_WORK_SQL = f"""CASE WHEN dayofweek(night) IN (0, 6) OR night IN ({", ".join(f"DATE '{d}'" for d, _ in OFF_DAYS)}) THEN 'offwork' ELSE 'work' END AS off_work"""
_RANKS = {"total": "daily_sleep DESC", "early_bed": "start_time, daily_sleep DESC", "early_rise": "end_time, start_time, daily_sleep DESC",
          "late_rise": "end_time DESC, start_time, daily_sleep DESC", "late_bed": "start_time DESC, end_time DESC, start_time, daily_sleep DESC"}


@register("sleep_rank_group_sizes", ("W3", "A10"), _SLEEP_SQL + f"SELECT {_OFF_WORK_SQL}, COUNT(*) AS n FROM n GROUP BY 1")
def sleep_rank_group_sizes(spark, sf_dir):
    """Sizes of the groups that ``sleep_rank_correlations`` ranks."""
    return rank_correlations(_weekly(spark, sf_dir)).select("off_work", "n")


def _corr_sql(a: str, b: str) -> str:
    name = lambda x: "total_sleep" if x == "total" else x
    return f"ROUND(corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)), 8) AS {name(a)}_vs_{name(b)}"


@register("sleep_rank_correlations", ("W3", "A10"), _SLEEP_SQL + f"""
, o AS (SELECT *, {_OFF_WORK_SQL} FROM n),
r AS (SELECT off_work, {", ".join(f"row_number() OVER (PARTITION BY off_work ORDER BY {o}, night) AS {k}" for k, o in _RANKS.items())} FROM o)
SELECT off_work, COUNT(*) AS n, {_corr_sql("total", "early_bed")}, {_corr_sql("early_bed", "early_rise")}, {_corr_sql("total", "early_rise")},
  {_corr_sql("late_rise", "early_bed")}, {_corr_sql("late_rise", "total")}, {_corr_sql("late_bed", "total")}, {_corr_sql("late_bed", "early_rise")},
  {_corr_sql("late_bed", "late_rise")} FROM r GROUP BY 1
""")
def sleep_rank_correlations(spark, sf_dir):
    """The five ranks and eight correlations of the script."""
    r = rank_correlations(_weekly(spark, sf_dir))
    return r.select("off_work", "n", *(F.round(c, 8).alias(c) for c in r.columns[2:]))
