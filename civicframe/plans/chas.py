"""Wide CHAS tables to one tidy, labelled, cached long table.

Raw layout (landed files; downloading is not part of the library):
``{root}/raw/{year}/{geography}/Table*.csv`` with id columns ``geoid, name,
st, cnty, sumlevel`` and measures ``T1_est1, T1_moe1, ...``; a dictionary
``{root}/raw/{year}/dictionary.csv`` (variable, description_1..5) and a
label lookup ``{root}/labels.csv`` (raw, label, concept).
Cache: ``{root}/cache`` as Parquet partitioned by year and geography.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicframe.operators import reshape as R
from civicframe.sources import sinks as K
from civicframe.sources.readers import read_wide_tables

# Geographies offered (the source also has "remainders",
# which a cluster can take as well).
GEOGRAPHIES = ["state", "county", "tract", "place", "counties by place", "mcd", "consolidated cities", "remainders"]
ID_COLS = ["geoid", "name", "st", "cnty", "sumlevel"]
OUT_COLS = ["year", "geography", "geoid", "name", "st", "cnty", "variable", "universe", "label", "concept", "est", "moe"]


def list_files(spark: SparkSession, folder: str, suffix: str = ".csv") -> list[str]:
    """File names under a folder through Hadoop's file system (works the same
    on a local disk, HDFS or an object store)."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(folder)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    return sorted(str(s.getPath().toString()) for s in fs.listStatus(p) if str(s.getPath().getName()).endswith(suffix))


def variable_labels(dictionary: DataFrame, labels: DataFrame) -> DataFrame:
    """R5 + R6 + R4: per variable code the universe, the standardised label
    (parts joined with ``!!``) and the concept (parts joined with `` by ``;
    ``Total`` when there is none). Only estimate rows of the dictionary are
    kept; the code ``T1_est1`` becomes ``T1_1``."""
    d = dictionary.where(F.col("variable").rlike(r"_est\d+$")) \
        .withColumn("variable", F.regexp_replace("variable", r"_est(\d+)$", "_$1"))
    parts = d.select("variable", F.col("description_1").alias("universe"),
                     F.posexplode(F.array("description_2", "description_3", "description_4", "description_5"))
                     .alias("pos", "raw"))
    lk = labels.select(F.col("raw").alias("_raw"), F.col("label").alias("_label"), F.col("concept").alias("_concept"))
    std = parts.join(lk, parts["raw"] == lk["_raw"], "left").select(
        "variable", "universe", "pos", F.coalesce("_label", "raw").alias("part"), F.col("_concept").alias("concept"))
    g = std.groupBy("variable", "universe").agg(F.array_sort(F.collect_list(F.struct("pos", "part", "concept"))).alias("p"))
    # empty descriptions are skipped here, so that a variable with a universe only stays
    label = F.array_join(F.filter(F.transform("p", lambda s: s["part"]), lambda x: x.isNotNull()), R.PART_SEP)
    concept = F.array_join(F.filter(F.transform("p", lambda s: s["concept"]), lambda c: c.isNotNull()), " by ")
    return g.select("variable", "universe", label.alias("label"),
                    F.when(concept == "", F.lit("Total")).otherwise(concept).alias("concept"))


def tidy_tables(spark: SparkSession, table_paths, dictionary: DataFrame, labels: DataFrame, year: int,
                state: str | None = None, county: str | None = None) -> DataFrame:
    """S5 + R1 + J5: wide tables to long rows with labels attached. The
    state / county filter is applied on the wide rows, before they are
    turned long."""
    long = read_wide_tables(spark, table_paths, ID_COLS, {k: v for k, v in (("st", state), ("cnty", county)) if v is not None}).drop("source_file")
    out = long.join(variable_labels(dictionary, labels), "variable", "left")
    return out.withColumns({"year": F.lit(year), "geography": F.col("sumlevel").cast("int")}).select(*OUT_COLS)


def get_chas(spark: SparkSession, root: str, geography: str, year: int | None = None,
             state: str | None = None, county: str | None = None) -> DataFrame:
    """Tidy CHAS data of one geography (``get_chas``): from the cache when
    the year is there, else from the raw tables, which are then added to
    the cache. With no year, the newest year available."""
    if geography not in GEOGRAPHIES:
        raise ValueError(f"geography must be one of {GEOGRAPHIES}")
    cache = f"{root}/cache"
    if year is None:
        years = [int(p.rstrip("/").rsplit("/", 1)[-1]) for p in list_files(spark, f"{root}/raw", "")
                 if p.rstrip("/").rsplit("/", 1)[-1].isdigit()]
        year = max(years)
    folder = f"{root}/raw/{year}/{geography}"
    tables = [p for p in list_files(spark, folder, ".csv")]
    sumlevel = spark.read.option("header", True).csv(tables[0]).select(F.first("sumlevel").cast("int")).first()[0] \
        if tables else None
    cached = K.read_cache(spark, cache, year=year, geography=sumlevel) if sumlevel is not None else None
    # a cache that a broken run has filled in part has rows but no marker
    if sumlevel is not None and not K.is_complete(spark, cache, year=year, geography=sumlevel):
        dictionary = spark.read.option("header", True).csv(f"{root}/raw/{year}/dictionary.csv")
        labels = spark.read.option("header", True).csv(f"{root}/labels.csv")
        tidy = tidy_tables(spark, tables, dictionary, labels, year)
        K.append_to_cache(tidy, cache, complete=True)
        cached = K.read_cache(spark, cache, year=year, geography=sumlevel)
    out = cached
    if state is not None:
        out = out.where(F.col("st") == state)
    if county is not None:
        out = out.where(F.col("cnty") == county)
    return out.select(*OUT_COLS)


# --- the pipeline on the driver's tables ------------------------------------

from civicframe.plans.registry import register, table  # noqa: E402

# Label lookup of the driver-table run (segment names).
SEGMENT_LABELS = [("AUTOMOBILE", "Automobile"), ("BUILDING", "Building"), ("FURNITURE", "Furniture"),
                  ("HOUSEHOLD", "Household"), ("MACHINERY", "Machinery")]


def _values(df: DataFrame, col: str) -> list:
    """All values, which become columns of a wide table."""
    return sorted(r[0] for r in df.select(col).where(F.col(col).isNotNull()).distinct().collect())


def land_driver_tables(spark, sf_dir, root: str, year: int = 2020) -> None:
    """Lands wide CSV tables built from the driver's tables in the raw layout:
    Table1 = order value (est) and order count (moe) per nation and order
    year; Table2 = customers (est) and customers in debt (moe) per nation and
    market segment. Plus the dictionary and the label lookup."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_totalprice")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    ids = [F.col("n_nationkey").cast("string").alias("geoid"), F.col("n_name").alias("name"),
           F.col("n_regionkey").cast("string").alias("st"), F.lit(None).cast("string").alias("cnty"),
           F.lit("040").alias("sumlevel")]
    oc = o.join(c, o.o_custkey == c.c_custkey).select("c_nationkey", F.year("o_orderdate").alias("y"), "o_totalprice")
    # wide columns: all years and segments there are, in order
    YEARS = _values(oc, "y")
    segs = _values(c, "c_mktsegment")
    t1 = oc.groupBy("c_nationkey").pivot("y", YEARS).agg(F.round(F.sum("o_totalprice")).cast("long").alias("est"),
                                                          F.count(F.lit(1)).alias("moe"))
    t1 = t1.join(F.broadcast(n), t1.c_nationkey == n.n_nationkey).select(
        *ids, *[F.col(f"{y}_{m}").alias(f"T1_{m}{i}") for i, y in enumerate(YEARS, 1) for m in ("est", "moe")])
    t2 = c.groupBy("c_nationkey").pivot("c_mktsegment", segs).agg(
        F.count(F.lit(1)).alias("est"), F.sum((F.col("c_acctbal") < 0).cast("long")).alias("moe"))
    t2 = t2.join(F.broadcast(n), t2.c_nationkey == n.n_nationkey).select(
        *ids, *[F.col(f"{s}_{m}").alias(f"T2_{m}{i}") for i, s in enumerate(segs, 1) for m in ("est", "moe")])
    base = f"{root}/raw/{year}"
    t1.write.mode("overwrite").option("header", True).csv(f"{base}/state/Table1.csv")
    t2.write.mode("overwrite").option("header", True).csv(f"{base}/state/Table2.csv")
    dict_rows = [(f"T1_est{i}", "Orders", f"Ordered in {y}", None, None, None) for i, y in enumerate(YEARS, 1)] + \
                [(f"T2_est{i}", "Customers", s, None, None, None) for i, s in enumerate(segs, 1)]
    spark.createDataFrame(dict_rows, "variable string, description_1 string, description_2 string, "
                                     "description_3 string, description_4 string, description_5 string") \
        .write.mode("overwrite").option("header", True).csv(f"{base}/dictionary.csv")
    spark.createDataFrame([(s, lab, "Market Segment") for s, lab in SEGMENT_LABELS], "raw string, label string, concept string") \
        .write.mode("overwrite").option("header", True).csv(f"{root}/labels.csv")


_SEG_SQL = " ".join(f"WHEN '{s}' THEN '{lab}'" for s, lab in SEGMENT_LABELS)
_SEG_IN = ", ".join(f"'{s}'" for s, _ in SEGMENT_LABELS)


@register("chas_from_driver_tables", ("S5", "S6", "R1", "R4", "R5", "R6", "J5", "K3", "K4"), f"""
WITH oc AS (SELECT c.c_nationkey AS nk, CAST(year(o.o_orderdate) AS INTEGER) AS y, o.o_totalprice
            FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey),
a1 AS (SELECT nk, y, CAST(round(SUM(o_totalprice)) AS BIGINT) AS est, COUNT(*) AS moe FROM oc GROUP BY nk, y),
years AS (SELECT y, row_number() OVER (ORDER BY y) AS i FROM (SELECT DISTINCT y FROM oc WHERE y IS NOT NULL)),
g1 AS (SELECT nk, y, i FROM (SELECT DISTINCT nk FROM oc), years),
t1 AS (SELECT g1.nk, 'T1_' || CAST(g1.i AS VARCHAR) AS variable, 'Orders' AS universe,
              'Ordered in ' || CAST(g1.y AS VARCHAR) AS label, 'Total' AS concept, a1.est, a1.moe
       FROM g1 LEFT JOIN a1 ON g1.nk = a1.nk AND g1.y = a1.y),
a2 AS (SELECT c_nationkey AS nk, c_mktsegment AS seg, COUNT(*) AS est,
              CAST(SUM(CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END) AS BIGINT) AS moe
       FROM customer GROUP BY 1, 2),
segs AS (SELECT seg, row_number() OVER (ORDER BY seg) AS i FROM (SELECT DISTINCT c_mktsegment AS seg FROM customer WHERE c_mktsegment IS NOT NULL)),
g2 AS (SELECT nk, seg, i FROM (SELECT DISTINCT c_nationkey AS nk FROM customer), segs),
t2 AS (SELECT g2.nk, 'T2_' || CAST(g2.i AS VARCHAR) AS variable,
              'Customers' AS universe, CASE g2.seg {_SEG_SQL} ELSE g2.seg END AS label,
              CASE WHEN g2.seg IN ({_SEG_IN}) THEN 'Market Segment' ELSE 'Total' END AS concept, a2.est, a2.moe
       FROM g2 LEFT JOIN a2 ON g2.nk = a2.nk AND g2.seg = a2.seg),
t AS (SELECT * FROM t1 UNION ALL SELECT * FROM t2)
SELECT 2020 AS year, 40 AS geography, CAST(n.n_nationkey AS VARCHAR) AS geoid, n.n_name AS name,
       CAST(n.n_regionkey AS VARCHAR) AS st, CAST(NULL AS VARCHAR) AS cnty, t.variable, t.universe, t.label, t.concept,
       t.est, t.moe
FROM t JOIN nation n ON t.nk = n.n_nationkey
""")
def chas_from_driver_tables(spark, sf_dir):
    """``get_chas`` over wide tables landed from the driver's tables (under
    the session's checkpoint folder): the first call tidies and caches, the
    second reads through the cache. An empty cell of a wide table stays a
    row with null ``est``/``moe``, as R's ``pivot_longer`` keeps NA."""
    from civicframe.session import scratch_path
    root = scratch_path(spark, "chas")
    land_driver_tables(spark, sf_dir, root)
    get_chas(spark, root, "state")
    return get_chas(spark, root, "state", year=2020)
