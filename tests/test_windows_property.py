"""Property checks of the distributed window helpers against Spark's own
window functions, on random inputs with random skew and partition counts."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from civicframe.operators import windows as W

rows_strategy = st.lists(
    st.tuples(st.sampled_from(["hot", "hot", "hot", "a", "b", None]), st.integers(0, 5),
              st.one_of(st.none(), st.integers(-3, 3))),
    min_size=1, max_size=120)

SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@SETTINGS
@given(rows=rows_strategy, parts=st.integers(1, 9))
def test_numbered_property(spark, rows, parts):
    df = spark.createDataFrame([(i, g, x, v) for i, (g, x, v) in enumerate(rows)], "id long, g string, x int, v int")
    got = W.numbered(df, [F.col("x").desc(), F.col("id")], ["g"], "rn", num_partitions=parts)
    want = df.withColumn("rn", F.row_number().over(Window.partitionBy("g").orderBy(F.col("x").desc(), "id")))
    assert sorted(got.select("id", "rn").collect()) == sorted(want.select("id", "rn").collect())


@SETTINGS
@given(rows=rows_strategy, parts=st.integers(1, 9))
def test_fill_up_property(spark, rows, parts):
    df = spark.createDataFrame([(i, g, x, v) for i, (g, x, v) in enumerate(rows)], "id long, g string, x int, v int")
    got = W.fill_up(df, ["g"], ["x", "id"], ["v"], num_partitions=parts)
    w = Window.partitionBy("g").orderBy("x", "id").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    want = df.withColumn("v", F.first("v", ignorenulls=True).over(w))
    assert sorted(got.collect()) == sorted(want.select(*df.columns).collect())
