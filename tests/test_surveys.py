"""Golden results of the yearly-series comparison."""

import os

from pyspark.sql import functions as F

from civicframe.plans import surveys as P
from tests.conftest import FIXTURES


def series(spark):
    return P.load_series(spark, os.path.join(FIXTURES, "ACS1.csv"), os.path.join(FIXTURES, "ACS5.csv"),
                         os.path.join(FIXTURES, "PEP.csv"))


def test_thirty_seven_rows(spark):
    s = series(spark)
    assert s.count() == 37
    assert {r.dataset: r.n for r in s.groupBy("dataset").agg(F.count("*").alias("n")).collect()} == \
        {"ACS1": 12, "ACS5": 12, "PEP": 13}


def test_gaps(spark):
    g = {r.year: r.gap for r in P.gaps(series(spark)).collect()}
    assert g[2022] == 6
    big = max(g.items(), key=lambda kv: abs(kv[1]))
    assert big == (2016, 1882)


def test_acs1_falls(spark):
    c = P.changes(series(spark)).where((F.col("dataset") == "ACS1") & (F.col("change") < 0))
    assert sorted(r.year for r in c.collect()) == [2011, 2017, 2021]


def test_label(spark):
    lab = P.with_labels(series(spark)).where((F.col("dataset") == "ACS1") & (F.col("year") == 2022)).first().label
    assert lab == "<b>ACS1<br>Year: </b>2022<br>402,687"
