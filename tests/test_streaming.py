"""Streaming cache fill: new files are added once, replays add nothing."""

import json
import os

from pyspark.sql import functions as F
from pyspark.sql import types as T

from civicframe.streaming.cache_fill import start_cache_fill

SCHEMA = T.StructType([T.StructField("incident_number", T.StringType()),
                       T.StructField("creation_date", T.StringType()),
                       T.StructField("department", T.StringType())])


def land(folder, name, recs):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w") as f:
        f.write("\n".join(json.dumps(r) for r in recs))


def to_cache(df):
    return df.select("incident_number", "department",
                     F.year(F.to_timestamp("creation_date")).alias("year"))


def run(spark, src, cache, name):
    q = start_cache_fill(spark, src, SCHEMA, cache, to_cache, keys=["year", "incident_number"],
                         partition_by=["year"], name=name)
    q.awaitTermination(120)


def test_stream_fill(spark, scratch):
    src, cache = f"{scratch}/landed", f"{scratch}/cache"
    land(src, "p1.json", [{"incident_number": str(i), "creation_date": "2024-03-0%dT07:00:00" % (1 + i % 5),
                           "department": "Code Enforcement"} for i in range(6)])
    run(spark, src, cache, "fill_a")
    assert spark.read.parquet(cache).count() == 6
    # a new page overlapping the old one: only new incidents are added
    land(src, "p2.json", [{"incident_number": str(i), "creation_date": "2024-03-01T07:00:00",
                           "department": "Code Enforcement"} for i in range(4, 9)])
    run(spark, src, cache, "fill_a")
    assert spark.read.parquet(cache).count() == 9
    # a fresh stream over the same files (as after losing its checkpoint) adds nothing
    run(spark, src, cache, "fill_b")
    assert spark.read.parquet(cache).count() == 9
