"""Variable catalogue: category codes and the path tree (goldens)."""

import os

from pyspark.sql import functions as F
from pyspark.sql import types as T

from civicframe.operators import reshape as R
from civicframe.plans import acs_catalog as P
from civicframe.sources.readers import read_csv
from tests.conftest import FIXTURES


def test_category_codes_golden(spark):
    schema = T.StructType([T.StructField("v_start", T.StringType()), T.StructField("category", T.StringType())])
    cats = R.category_codes(read_csv(spark, os.path.join(FIXTURES, "v_acs_categories.csv"), schema))
    rows = {r.v_start: r.category for r in cats.collect()}
    assert len(rows) == 31
    assert rows["B02 & C02"] == "Race"
    assert rows["B01"] == "Population Overview"
    assert rows["B25 & C25"] == "Housing"
    assert rows["B10"] == "Grandparents"


def golden_tree():
    lines = open(os.path.join(FIXTURES, "acs1_tree.txt"), encoding="utf-8").read().split("\n")
    body = [l for l in lines[1:] if l and not l.startswith("300 directories")]
    paths, stack = [], []
    for l in body:
        i = max(l.find("├── "), l.find("└── "))
        depth = i // 4
        name = l[i + 4:]
        stack = stack[:depth] + [name]
        paths.append("/".join(stack))
    return body, paths


def test_path_tree_reproduces_golden(spark):
    body, paths = golden_tree()
    assert len(body) == 299  # plus the root: "300 directories"
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    nodes = R.path_tree(df).orderBy("key").collect()
    assert [n.line for n in nodes] == body
    leaves = [n for n in nodes if n.children == 0]
    assert len(leaves) == 161


def test_catalog_to_tree(spark):
    rows = [
        ("B25003_001", "Estimate!!Total", "TENURE", 2005),
        ("B25003_001", "Estimate!!Total", "TENURE", 2023),
        ("B25003A_001", "Estimate!!Total", "TENURE (WHITE ALONE HOUSEHOLDER)", 2023),
        ("B25065_001", "Estimate!!Aggregate gross rent", "AGGREGATE GROSS RENT", 2010),
        ("B25028_001", "Estimate!!Total", None, 2010),
        ("B25028_001", "Estimate!!Total", None, 2011),
        ("B25029_001", "Estimate!!Total", None, 2010),
        ("B25029_001", "Estimate!!Total", "TENURE BY YEAR HOUSEHOLDER MOVED INTO UNIT", 2012),
        ("B25119_001", "Estimate!!Median", "MEDIAN HOUSEHOLD INCOME IN THE PAST 12 MONTHS (IN 2019 INFLATION-ADJUSTED DOLLARS)", 2019),
        ("B25119_001", "Estimate!!Median", "MEDIAN HOUSEHOLD INCOME THE PAST 12 MONTHS (IN 2021 INFLATION-ADJUSTED DOLLARS)", 2021),
        ("C25002_001", "Estimate!!Total", "OCCUPANCY STATUS", 2006),
        ("B01001_001", "Estimate!!Total", "SEX BY AGE", 2010),
    ]
    cat = spark.createDataFrame(rows, "name string, label string, concept string, year int")
    filled = {(r.name, r.year): r.concept for r in P.fill_concepts(P.top_level(P.housing_variables(cat))).collect()}
    assert ("B25003A_001", 2023) not in filled
    assert ("B25065_001", 2010) not in filled
    assert filled[("B25028_001", 2010)] == "Tenure By Year Structure Built"
    assert filled[("B25029_001", 2010)] == "Tenure By Year Householder Moved Into Unit"
    paths = sorted(r.path for r in P.file_strings(P.year_ranges(P.fill_concepts(P.top_level(cat)))).collect())
    assert "Tenure/B25003-(2005-2023)" in paths
    assert "Occupancy-Status/C25002-(2006)" in paths
    assert "Median-Household-Income-In-The-Past-12-Months/B25119-(2019-2021)" in paths
    tree = P.variable_tree(cat)
    assert tree.where(F.col("depth") == 1).count() >= 3


def test_changed_variables_and_spans(spark):
    rows = [("B25026", "Units In Structure By Residence Status", 2012), ("B25026", "Units In Structure By Residence Status", 2015),
            ("B25026", "Total Population By Tenure", 2018), ("B25027", "Mortgage Status", 2012),
            ("B25027", "Mortgage Status", 2019), ("B25010", "Household Size", 2014), ("B25010", None, 2010)]
    top = spark.createDataFrame(rows, "name string, concept string, year int")
    assert sorted({r.name for r in P.changed_variables(top).collect()}) == ["B25026"]
    spans = {(r.name, r.concept): r.years for r in P.year_spans_backdated(top).collect()}
    assert spans[("B25027", "Mortgage Status")] == "(2010-2019)"
    assert spans[("B25026", "Total Population By Tenure")] == "2018"
    assert spans[("B25026", "Units In Structure By Residence Status")] == "(2010-2015)"
    yrs = {(r.name, r.concept): r.years for r in P.years_per_concept(top).collect()}
    assert yrs[("B25027", "Mortgage Status")] == "2012, 2019"
