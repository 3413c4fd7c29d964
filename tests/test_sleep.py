"""Sleep analysis from a made-up health export."""

import datetime as dt

from pyspark.sql import functions as F

from civicframe.plans import sleep as P

REC = ('<Record type="HKCategoryTypeIdentifierSleepAnalysis" sourceName="{src}" sourceVersion="9.1" '
       'creationDate="{c}" startDate="{s}" endDate="{e}" value="HKCategoryValueSleepAnalysis{v}"/>')


def export(path):
    recs = [
        # night of Jan 2 (starts before midnight, Central time = UTC-6)
        ("Watch", "2024-01-03 07:00:00 -0600", "2024-01-02 23:00:00 -0600", "2024-01-03 01:00:00 -0600", "AsleepCore"),
        ("Watch", "2024-01-03 07:00:00 -0600", "2024-01-03 01:00:00 -0600", "2024-01-03 03:00:00 -0600", "AsleepDeep"),
        ("Watch", "2024-01-03 07:00:00 -0600", "2024-01-03 03:00:00 -0600", "2024-01-03 06:30:00 -0600", "AsleepREM"),
        ("Watch", "2024-01-03 07:00:00 -0600", "2024-01-02 22:30:00 -0600", "2024-01-02 23:00:00 -0600", "InBed"),
        # written three days late: belongs to the day it ended
        ("Watch", "2024-01-08 09:00:00 -0600", "2024-01-04 23:30:00 -0600", "2024-01-05 06:00:00 -0600", "AsleepUnspecified"),
        # over the year end
        ("Phone", "2024-01-01 08:00:00 -0600", "2023-12-31 23:00:00 -0600", "2024-01-01 07:00:00 -0600", "AsleepCore"),
    ]
    body = "\n".join(REC.format(src=s, c=c, s=st, e=e, v=v) for s, c, st, e, v in recs)
    other = '<Record type="HKQuantityTypeIdentifierStepCount" sourceName="Phone" creationDate="2024-01-03 07:00:00 -0600" value="120" unit="count"/>'
    with open(path, "w") as f:
        f.write(f"<?xml version=\"1.0\"?>\n<HealthData>\n{body}\n{other}\n</HealthData>\n")


def test_records_and_asleep(spark, scratch):
    path = f"{scratch}/export.xml"
    export(path)
    recs = P.records(spark, path)
    assert recs.count() == 7
    assert set(recs.columns) == set(P.RECORD_ATTRS)
    sleep = P.sleep_records(recs)
    assert sleep.count() == 6 and "unit" not in sleep.columns
    a = P.asleep(sleep)
    assert a.count() == 5
    assert sorted(r.value for r in a.collect()) == ["Core", "Core", "Deep", "REM", "Unspecified"]
    nights = {r.creationDate: r.daily_sleep for r in P.nightly_totals(a).collect()}
    assert nights[dt.date(2024, 1, 3)] == 7.5 * 3600
    assert nights[dt.date(2024, 1, 5)] == 6.5 * 3600     # repaired night date
    assert nights[dt.date(2024, 1, 1)] == 8 * 3600


def test_weekday_and_debt(spark, scratch):
    path = f"{scratch}/export.xml"
    export(path)
    a = P.asleep(P.sleep_records(P.records(spark, path)))
    wd = {r.wday_label: r.readable for r in P.sleep_by_weekday(a).collect()}
    assert wd["Wednesday"] == "7H 30M 0S"
    debt = P.sleep_debt(a).first().debt_hours
    assert abs(debt - (3 * 7 - (7.5 + 6.5 + 8))) < 1e-9
    shares = {r.value: r.share for r in P.stage_shares(a).collect()}
    assert "Unspecified" not in shares and abs(sum(shares.values()) - 1) < 1e-9


def test_start_end_and_heatmap(spark, scratch):
    path = f"{scratch}/export.xml"
    export(path)
    a = P.asleep(P.sleep_records(P.records(spark, path)))
    start, end = P.sleep_start_end(a)
    s = {r.creationDate: r.start_time for r in start.collect()}
    assert s[dt.date(2024, 1, 3)] == 23 * 3600          # 23:00 stays; 01:00 would be 90000
    e = {r.creationDate: r.end_time for r in end.collect()}
    assert e[dt.date(2024, 1, 3)] == 6.5 * 3600 + 86400
    h = {r.creationDate: r.week for r in P.heatmap(a).collect()}
    assert h[dt.date(2024, 1, 1)] == 1 and h[dt.date(2024, 1, 3)] == 1


def test_weekly_and_ranks(spark, scratch):
    path = f"{scratch}/export.xml"
    export(path)
    a = P.asleep(P.sleep_records(P.records(spark, path)))
    off = spark.createDataFrame([(dt.date(2024, 1, 1), True)], "creationDate date, holiday boolean")
    w = P.weekly_again(a, off)
    labels = {r.creationDate: r.off_work for r in w.collect()}
    assert labels[dt.date(2024, 1, 1)] == "offwork" and labels[dt.date(2024, 1, 3)] == "work"
    assert P.rank_correlations(w).count() == 2
    assert P.start_histogram(w, 5).where(F.col("off_work") == "work").count() == 5
    assert P.weekly_clock_summary(w).count() >= 1
    assert P.monthly_summary(a).count() == 1


def test_rank_correlations_brute_force(spark):
    import random
    rnd = random.Random(3)
    base = dt.date(2023, 6, 1)
    rows = [(base + dt.timedelta(days=i), float(rnd.choice([25000, 26000, 27000, 28000])),
             rnd.choice([80000, 82000, 84000]), rnd.choice([110000, 112000]), "work" if i % 3 else "offwork")
            for i in range(40)]
    w = spark.createDataFrame(rows, "creationDate date, daily_sleep double, start_time int, end_time int, off_work string")
    got = {r.off_work: r for r in P.rank_correlations(w).collect()}
    for label in ("work", "offwork"):
        g = [r for r in rows if r[4] == label]
        def rank(key):
            order = sorted(range(len(g)), key=key)
            out = [0] * len(g)
            for pos, i in enumerate(order):
                out[i] = pos + 1
            return out
        tot = rank(lambda i: (-g[i][1], g[i][0]))
        eb = rank(lambda i: (g[i][2], -g[i][1], g[i][0]))
        lb = rank(lambda i: (-g[i][2], -g[i][3], -g[i][1], g[i][0]))
        def corr(a, b):
            n = len(a); ma, mb = sum(a) / n, sum(b) / n
            cov = sum((x - ma) * (y - mb) for x, y in zip(a, b))
            return cov / (sum((x - ma) ** 2 for x in a) * sum((y - mb) ** 2 for y in b)) ** 0.5
        assert abs(got[label].total_sleep_vs_early_bed - corr(tot, eb)) < 1e-12
        assert abs(got[label].late_bed_vs_total_sleep - corr(lb, tot)) < 1e-12
        assert got[label].n == len(g)
