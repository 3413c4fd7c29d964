"""Sources and sinks: round trips in a scratch folder."""

import json
import os

from pyspark.sql import functions as F
from pyspark.sql import types as T

from civicframe.operators import columns as C
from civicframe.sources import readers as R
from civicframe.sources import sinks as K


def test_csv_and_parquet_round_trip(spark, scratch):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, s string")
    K.write_csv(df, f"{scratch}/csv")
    back = R.read_csv(spark, f"{scratch}/csv", "id int, s string")
    assert sorted(back.collect()) == sorted(df.collect())
    K.write_parquet(df, f"{scratch}/pq", partition_by=["id"])
    assert spark.read.parquet(f"{scratch}/pq").count() == 2


def test_json_pages_dedup(spark, scratch):
    os.makedirs(f"{scratch}/pages")
    recs = [{"incident_number": str(i), "division": "x"} for i in range(5)]
    with open(f"{scratch}/pages/p1.json", "w") as f:
        f.write("\n".join(json.dumps(r) for r in recs[:3]))
    with open(f"{scratch}/pages/p2.json", "w") as f:
        f.write("\n".join(json.dumps(r) for r in recs[2:]))
    schema = T.StructType([T.StructField("incident_number", T.StringType()), T.StructField("division", T.StringType())])
    assert R.read_json_pages(spark, f"{scratch}/pages", schema).count() == 5


def test_requests_scan_pushes_filter(spark, scratch):
    df = spark.createDataFrame([("Code Enforcement", "1"), ("Solid Waste", "2")], "DEPARTMENT string, INCIDENT_NUMBER string")
    df.write.parquet(f"{scratch}/req")
    r = R.read_requests(spark, f"{scratch}/req", columns=["INCIDENT_NUMBER"])
    plan = r._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(DEPARTMENT), EqualTo(DEPARTMENT,Code Enforcement)]" in plan
    assert [x.INCIDENT_NUMBER for x in r.collect()] == ["1"]


def test_request_query(spark):
    df = spark.createDataFrame([("Code Enforcement", "2024-03-09T07:27:09.000"), ("code enforcement", "2024-03-10T01:00:00.000"),
                                ("Solid Waste", "2024-03-09T02:00:00.000")], "department string, creation_date string")
    assert C.request_query(df).count() == 3
    assert C.request_query(df, department="CODE ENFORCEMENT").count() == 2
    assert C.request_query(df, date_cols=("creation_date",), department="code enforcement",
                           creation_date="2024-03-09").count() == 1


def test_years_and_lines(spark, scratch):
    for y in (2021, 2022):
        spark.createDataFrame([(f"v{y}",)], "name string").write.parquet(f"{scratch}/vars/year={y}")
    assert R.read_years(spark, f"{scratch}/vars", [2022]).collect()[0].name == "v2022"
    K.write_lines(R.read_years(spark, f"{scratch}/vars"), "name", f"{scratch}/lines")
    assert sorted(r.value for r in spark.read.text(f"{scratch}/lines").collect()) == ["v2021", "v2022"]


def test_layer_read(spark, scratch):
    os.makedirs(f"{scratch}/layer")
    with open(f"{scratch}/layer/a.json", "w") as f:
        f.write(json.dumps({"id": "1", "name": "Shelby", "attrs": {"NAME": "Shelby"},
                            "rings": [[{"x": 0, "y": 0}, {"x": 2, "y": 0}, {"x": 2, "y": 3}, {"x": 0, "y": 0}]]}))
    lay = R.read_layers(spark, [(f"{scratch}/layer", "counties")])
    r = lay.first()
    assert (r.layer, r.xmin, r.xmax, r.ymin, r.ymax) == ("counties", 0.0, 2.0, 0.0, 3.0)
    assert lay.where(F.col("attrs")["NAME"] == "Shelby").count() == 1


def test_add_rows_and_lookup(spark):
    df = spark.createDataFrame([(2019, 5)], "year int, estimate long")
    out = R.add_rows(df, spark, [(2020, 6, "PEP")], "year int, estimate long, dataset string")
    assert out.count() == 2 and "dataset" in out.columns


def test_get_requests_api(spark):
    from civicframe.plans.requests import REQUEST_COLUMNS, get_requests, parse_request_dates
    cols = [c for c in REQUEST_COLUMNS if c != "location1"]
    base = {c: None for c in cols}
    rows = []
    for i, (dept, day) in enumerate([("Code Enforcement", "2024-03-09T07:27:09.000"),
                                      ("CODE ENFORCEMENT", "2024-03-09T23:59:59.000"),
                                      ("Code Enforcement", "2024-03-10T00:00:00.000"), ("Solid Waste", "2024-03-09T08:00:00.000")]):
        r = dict(base, department=dept, creation_date=day, incident_number=str(i))
        rows.append(tuple(r[c] for c in cols))
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in cols))
    shuffled = df.select(*reversed(df.columns))
    out = get_requests(shuffled, department="code enforcement", creation_date="2024-03-09")
    assert out.columns == cols
    assert sorted(r.incident_number for r in out.collect()) == ["0", "1"]
    assert get_requests(df).count() == 4
    assert parse_request_dates(df).schema["creation_date"].dataType.typeName() == "timestamp"
