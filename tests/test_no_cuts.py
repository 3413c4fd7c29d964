"""Nothing is dropped: years, segments and event types outside those of the
driver's tables, null keys, broken runs."""

import pytest
from pyspark.sql import functions as F

from civicframe import session
from civicframe.plans import all_plans, chas  # noqa: F401
from civicframe.plans.registry import PLANS, table
from civicframe.sources import sinks as K

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def changed(spark, tmp_path_factory):
    """The driver's tables with a year, a segment and an event type they lack."""
    d = str(tmp_path_factory.mktemp("sf"))
    o = table(spark, SF, "orders")
    o.withColumn("o_orderdate", F.when(F.col("o_orderkey") % 3 == 0, F.timestamp_add("YEAR", F.lit(8), F.col("o_orderdate")))
                 .otherwise(F.col("o_orderdate"))).write.parquet(f"{d}/orders.parquet")
    c = table(spark, SF, "customer")
    c.withColumn("c_mktsegment", F.when(F.col("c_custkey") % 4 == 0, "SHIPPING").otherwise(F.col("c_mktsegment"))).write.parquet(f"{d}/customer.parquet")
    e = table(spark, SF, "events")
    e.withColumn("event_type", F.when(F.col("event_id") % 5 == 0, "share").otherwise(F.col("event_type"))).write.parquet(f"{d}/events.parquet")
    for t in ("nation", "region"):
        table(spark, SF, t).write.parquet(f"{d}/{t}.parquet")
    return d


def test_every_year_is_counted(spark, changed):
    n = spark.read.parquet(f"{changed}/orders.parquet").count()
    assert PLANS["region_year_long"](spark, changed).agg(F.sum("moe")).first()[0] == n


def test_every_segment_and_year_reaches_the_tidy_table(spark, changed):
    t = PLANS["chas_from_driver_tables"](spark, changed)
    got = {r.universe: r.total for r in t.where("universe = 'Orders'").groupBy("universe").agg(F.sum("moe").alias("total")).collect()}
    assert got["Orders"] == spark.read.parquet(f"{changed}/orders.parquet").count()
    seg = {r.label: r.n for r in t.where("universe = 'Customers'").groupBy("label").agg(F.sum("est").alias("n")).collect()}
    want = {r[0]: r[1] for r in spark.read.parquet(f"{changed}/customer.parquet").groupBy("c_mktsegment").count().collect()}
    assert seg.pop("SHIPPING") == want.pop("SHIPPING") and {k.upper(): v for k, v in seg.items()} == want


def test_other_event_types_keep_their_seconds(spark, changed):
    e = spark.read.parquet(f"{changed}/events.parquet").where("event_type <> 'error'")
    want = e.agg(F.sum(F.round(F.col("value") * 60).cast("long"))).first()[0]
    assert PLANS["sleep_nights_from_xml"](spark, changed).agg(F.sum("daily_sleep")).first()[0] == want


def test_variable_with_a_universe_only_stays(spark):
    d = spark.createDataFrame([("T1_est1", "All", None, None, None, None)],
                              "variable string, description_1 string, description_2 string, description_3 string, description_4 string, description_5 string")
    labels = spark.createDataFrame([("x", "X", None)], "raw string, label string, concept string")
    assert [tuple(r) for r in chas.variable_labels(d, labels).collect()] == [("T1_1", "All", "", "Total")]


def test_cache_takes_null_keys_once_and_refuses_conflicts(spark, scratch):
    rows = spark.createDataFrame([(2020, 40, None, "v", 1), (2020, 40, "47", None, 2), (2020, 40, "47", None, 2)],
                                 "year int, geography int, geoid string, variable string, est int")
    path = f"{scratch}/cache"
    for _ in range(3):
        K.append_to_cache(rows, path)
    assert K.read_cache(spark, path).count() == 2
    with pytest.raises(ValueError):
        K.append_to_cache(rows.union(rows.withColumn("est", F.col("est") + 1)), f"{scratch}/other")


def test_newest_year_comes_from_the_folders(spark, scratch):
    assert K.newest_partition(spark, f"{scratch}/none") is None and K.read_cache(spark, f"{scratch}/none") is None
    for y in (2019, 2021, 2020):
        K.append_to_cache(spark.createDataFrame([(y, 1, "a", "v")], "year int, geography int, geoid string, variable string"), f"{scratch}/c")
    assert K.newest_partition(spark, f"{scratch}/c") == 2021
    assert [r.year for r in K.read_cache(spark, f"{scratch}/c").collect()] == [2021]


def test_half_filled_cache_is_completed(spark):
    root = session.scratch_path(spark, "chas-half")
    chas.land_driver_tables(spark, SF, root)
    whole = chas.get_chas(spark, root, "state", year=2020).count()
    again = session.scratch_path(spark, "chas-half")
    chas.land_driver_tables(spark, SF, again)
    # a run that broke off: some rows, no marker
    part = chas.get_chas(spark, root, "state", year=2020).limit(12)
    K.append_to_cache(part, f"{again}/cache")
    assert not K.is_complete(spark, f"{again}/cache", year=2020, geography=40)
    assert chas.get_chas(spark, again, "state", year=2020).count() == whole


def test_no_local_folder_on_a_cluster(monkeypatch):
    class Fake:
        class conf:
            get = staticmethod(lambda k, d=None: None)

        class sparkContext:
            master = "spark://somewhere:7077"
            getCheckpointDir = staticmethod(lambda: None)
    with pytest.raises(ValueError):
        session.checkpoint_dir(Fake)


def test_every_part_is_in_the_catalogue(spark, scratch):
    key = F.col("id") * 501 + 1  # to 5,011: every code above 1,000 but two
    spark.range(11).select(key.alias("p_partkey"), F.lit("STANDARD TIN").alias("p_type")).write.parquet(f"{scratch}/part.parquet")
    top = {k for k in range(1, 5012, 501) if k % 4 and k % 7}
    for name in ("catalogue_year_ranges_all_parts", "catalogue_years_per_concept_all_parts"):
        got = {r.name for r in PLANS[name](spark, scratch).collect()}
        assert got == {("C" if k % 5 == 0 else "B") + f"25{k:03d}_001" for k in top}


def test_two_writers_leave_each_key_once(spark, scratch):
    import threading
    schema = "year int, geography int, geoid string, variable string, est int"
    errors = []

    def write(lo, hi):
        rows = spark.createDataFrame([(2020 + i % 2, 40, str(i), "v", i) for i in range(lo, hi)], schema)
        try:
            K.append_to_cache(rows, f"{scratch}/c")
        except Exception as e:  # noqa: BLE001
            errors.append(e)
    threads = [threading.Thread(target=write, args=x) for x in ((0, 60), (0, 60), (30, 90), (0, 90))]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors
    got = K.read_cache(spark, f"{scratch}/c", year=2020).union(K.read_cache(spark, f"{scratch}/c", year=2021)).collect()
    assert sorted(int(r.geoid) for r in got) == list(range(90))
    write(0, 90)
    assert K.read_cache(spark, f"{scratch}/c", year=2020).count() == 45


def test_killed_append_leaves_nothing_visible(spark, scratch, monkeypatch):
    schema = "year int, geography int, geoid string, variable string, est int"
    rows = spark.createDataFrame([(2020, 40, "1", "v", 1)], schema)
    later = spark.createDataFrame([(2021, 40, "1", "v", 1), (2020, 40, "2", "v", 2)], schema)
    K.append_to_cache(rows, f"{scratch}/c")

    def killed(*a):
        raise KeyboardInterrupt
    with monkeypatch.context() as m:
        m.setattr(K, "_publish", killed)
        with pytest.raises(KeyboardInterrupt):
            K.append_to_cache(later, f"{scratch}/c")
    assert K.read_cache(spark, f"{scratch}/c").count() == 1 and K.newest_partition(spark, f"{scratch}/c") == 2020
    K.append_to_cache(later, f"{scratch}/c")
    assert K.read_cache(spark, f"{scratch}/c", year=2020).count() == 2 and K.newest_partition(spark, f"{scratch}/c") == 2021
