"""Window operators against brute force, including one hot group that holds
most of the rows."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from civicframe.operators import windows as W


def skewed(spark, n=3000, seed=7):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        g = "hot" if i % 3 != 0 else f"g{i % 17}"
        v = rnd.choice([None, None, rnd.randint(0, 50)])
        rows.append((i, g, rnd.randint(0, 30), v))
    return spark.createDataFrame(rows, "id long, g string, x int, v int")


def test_numbered_matches_row_number(spark):
    df = skewed(spark)
    got = W.numbered(df, [F.col("x").desc(), F.col("id")], ["g"], "rn", num_partitions=7)
    w = Window.partitionBy("g").orderBy(F.col("x").desc(), F.col("id"))
    want = df.withColumn("rn", F.row_number().over(w))
    assert sorted(got.select("id", "rn").collect()) == sorted(want.select("id", "rn").collect())


def test_numbered_without_groups(spark):
    df = skewed(spark, 500)
    got = W.numbered(df, [F.col("x"), F.col("id")], (), "rn", num_partitions=5)
    want = df.withColumn("rn", F.row_number().over(Window.orderBy("x", "id")))
    assert sorted(got.select("id", "rn").collect()) == sorted(want.select("id", "rn").collect())


def test_fill_up_matches_window(spark):
    df = skewed(spark)
    got = W.fill_up(df, ["g"], ["id"], ["v"], num_partitions=6)
    w = Window.partitionBy("g").orderBy("id").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    want = df.withColumn("v", F.first("v", ignorenulls=True).over(w))
    assert sorted(got.collect()) == sorted(want.select(*df.columns).collect())


def test_ntile_matches_sql(spark):
    df = spark.range(0, 23).withColumn("n", F.lit(23))
    got = df.select("id", W.ntile_from_number(F.col("id") + 1, F.col("n"), 3).alias("t"))
    want = df.select("id", F.ntile(3).over(Window.orderBy("id")).alias("t"))
    assert sorted(got.collect()) == sorted(want.collect())


def test_extremes_keep_ties(spark):
    df = spark.createDataFrame([(1, "a", 5), (2, "a", 5), (3, "a", 7), (4, "b", 1)], "id int, g string, x int")
    got = W.rows_at_group_extreme(df, ["g"], "x", "min")
    assert sorted(r.id for r in got.collect()) == [1, 2, 4]


def test_group_extremes_and_label(spark):
    df = spark.createDataFrame([("v", 2005), ("v", 2023), ("w", 2005)], "name string, year int")
    e = W.group_extremes(df, ["name"], "year", "a", "b").select("name", W.year_span_label("a", "b").alias("r"))
    assert sorted(set(tuple(r) for r in e.collect())) == [("v", "(2005-2023)"), ("w", "(2005)")]


def test_halo_windows_on_a_group_in_many_pieces(spark):
    import random

    from pyspark.sql import Window
    rnd = random.Random(5)
    rows = [("hot", x, float(rnd.randint(0, 99))) for x in range(0, 600, 2)] + [("hot", 7, 1.5), (None, 3, 2.0), (None, 5, 4.0), ("one", 1, 1.0)]
    df = spark.createDataFrame([r for r in rows], "g string, x int, y double").repartition(5)
    for h in (3, 40, 10_000):
        w = Window.partitionBy("g").orderBy("x").rangeBetween(-h, h)
        want = df.withColumn("trend", F.regr_intercept("y", "x").over(w) + F.regr_slope("y", "x").over(w) * F.col("x"))
        got = W.local_linear_trend(df, ["g"], "x", "y", h, num_partitions=9)
        assert got.columns == want.columns
        key = lambda r: (str(r.g), r.x, r.y)
        for a, b in zip(sorted(got.collect(), key=key), sorted(want.collect(), key=key), strict=True):
            assert key(a) == key(b) and (a.trend is None) == (b.trend is None) and (a.trend is None or abs(a.trend - b.trend) < 1e-6)
    series = df.dropDuplicates(["g", "x"]).withColumn("y", F.when(F.col("x") % 5 != 0, F.col("y")))
    w = Window.partitionBy("g").orderBy("x")
    want = series.withColumn("change", F.col("y") - F.lag("y").over(w))
    got = W.change_from_prior(series, ["g"], "x", "y", num_partitions=9)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_many_rankings_at_once(spark):
    import datetime as dt
    import random

    from pyspark.sql import Window
    rnd = random.Random(2)
    rows = [("a" if i % 3 else None, i, rnd.choice([None, 1.5, 2.5, -1.0]), rnd.choice([None, 4, 9]), rnd.choice(["x", "é", None]),
             dt.date(2024, 1, rnd.randint(1, 28)), dt.datetime(2024, 1, 1, rnd.randint(0, 23))) for i in range(120)]
    df = spark.createDataFrame(rows, "g string, k int, d double, n int, s string, day date, ts timestamp").repartition(4)
    rankings = {"r1": [("d", True), ("day", False)], "r2": [("n", False), ("s", True)], "r3": [("ts", False)], "r4": [("d", False)]}
    got = {r.k: r for r in W.numbered_many(df, rankings, ["g"], ["k"], 7).collect()}
    for name, order in rankings.items():
        w = Window.partitionBy("g").orderBy(*[F.col(c).asc() if up else F.col(c).desc() for c, up in order], "k")
        for r in df.withColumn("rn", F.row_number().over(w)).collect():
            assert got[r.k][name] == r.rn
    twice = df.union(df)
    rn = sorted(r.r3 for r in W.numbered_many(twice, {"r3": [("ts", True)]}, [], ["k"]).collect())
    assert rn == list(range(1, 241))
