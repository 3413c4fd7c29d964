"""P5: three yearly series of one estimate, stacked and compared."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from civicframe.functions import strings as X
from civicframe.operators import aggregate as A
from civicframe.operators import joins as J
from civicframe.operators import windows as W
from civicframe.sources import readers as S

SERIES_SCHEMA = T.StructType([
    T.StructField("year", T.IntegerType()), T.StructField("GEOID", T.StringType()),
    T.StructField("NAME", T.StringType()), T.StructField("variable", T.StringType()),
    T.StructField("estimate", T.LongType()), T.StructField("moe", T.LongType()),
    T.StructField("dataset", T.StringType())])
PEP_SCHEMA = T.StructType(SERIES_SCHEMA.fields[:5])

# The population-estimate rows the page adds for 2020-2022.
PEP_ADDED = [(2020, "47157", "Shelby County, Tennessee", "HUEST", 400285),
             (2021, "47157", "Shelby County, Tennessee", "HUEST", 401393),
             (2022, "47157", "Shelby County, Tennessee", "HUEST", 402681)]


def load_series(spark: SparkSession, acs1: str, acs5: str, pep: str, acs_variable: str = "B25001_001",
                pep_variable: str = "HUEST") -> DataFrame:
    """S1 + F8 + F5 + S10 + J3/O5: the three series in one table. The
    datasets never share a row, so the natural full join is a union by
    name."""
    a1 = S.read_csv(spark, acs1, SERIES_SCHEMA).withColumn("dataset", F.lit("ACS1")) \
        .where(F.col("variable") == acs_variable)
    a5 = S.read_csv(spark, acs5, SERIES_SCHEMA).withColumn("dataset", F.lit("ACS5")) \
        .where(F.col("variable") == acs_variable)
    p = S.read_csv(spark, pep, PEP_SCHEMA).withColumn("dataset", F.lit("PEP")).where(F.col("variable") == pep_variable)
    p = S.add_rows(p, spark, [r + ("PEP",) for r in PEP_ADDED],
                   T.StructType(PEP_SCHEMA.fields + [T.StructField("dataset", T.StringType())]))
    return J.stack_tables([p, a1, a5])


def with_labels(series: DataFrame) -> DataFrame:
    """X10 + X12: hover label ``<b>ACS1<br>Year: </b>2010<br>398,395``."""
    return series.withColumn("label", F.concat(F.lit("<b>"), F.col("dataset"), F.lit("<br>Year: </b>"),
                                               F.col("year").cast("string"), F.lit("<br>"), X.thousands("estimate")))


def gaps(series: DataFrame, a: str = "ACS1", b: str = "PEP") -> DataFrame:
    """Per year, series ``a`` minus series ``b``."""
    return A.series_gaps(series, "year", "dataset", "estimate", a, b)


def changes(series: DataFrame) -> DataFrame:
    """Change from the previous available year per series."""
    return W.change_from_prior(series, ["dataset"], "year", "estimate")
