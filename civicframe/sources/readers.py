"""Sources (S1-S10). No reader runs an inference pass over the data: each
takes a schema, reads text columns by header, or takes Parquet's own schema."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path, schema, header: bool = True) -> DataFrame:
    """CSV with a header row and a declared schema."""
    return spark.read.schema(schema).option("header", header).option("mode", "PERMISSIVE").csv(path)


def read_requests(spark: SparkSession, path: str, department: str | None = "Code Enforcement",
                  columns=None) -> DataFrame:
    """Parquet scan with the department filter and the projection
    declared before anything else, so both reach the scan
    (``PushedFilters: EqualTo(DEPARTMENT, ...)``, narrow ``ReadSchema``)."""
    df = spark.read.parquet(path)
    if department is not None:
        df = df.where(F.col("DEPARTMENT") == department)
    return df.select(*columns) if columns else df


def read_xml_records(spark: SparkSession, path: str, attrs, row_tag: str = "Record") -> DataFrame:
    """S3: each ``<Record .../>`` a row, the chosen attributes as string
    columns (missing attribute: null). The schema is all strings: left to
    inference Spark would turn values into numbers and dates."""
    schema = T.StructType([T.StructField(f"_{a}", T.StringType()) for a in attrs])
    df = spark.read.format("xml").option("rowTag", row_tag).option("attributePrefix", "_").schema(schema).load(path)
    return df.select(*[F.col(f"_{a}").alias(a) for a in attrs])


def read_json_pages(spark: SparkSession, path: str, schema) -> DataFrame:
    """Landed JSON pages of an API (one record per line), duplicates
    that overlapping pages repeat removed."""
    return spark.read.schema(schema).json(path).distinct()


def _csv_fields(line: str):
    """Fields of one line of CSV; a quoted field may hold commas and doubled
    quotes, but no line break."""
    found = F.regexp_extract_all(F.concat(F.lit(","), F.col(line)), F.lit(r',(?:"(?:[^"]|"")*"|[^,]*)'), F.lit(0))

    def plain(f):
        f = F.substring(f, F.lit(2), F.char_length(f))
        return F.when(f.startswith('"'), F.replace(F.substring(f, F.lit(2), F.char_length(f) - 2), F.lit('""'), F.lit('"'))).otherwise(f)
    return F.transform(found, plain)


def read_wide_tables(spark: SparkSession, paths, id_cols, equals: dict | None = None,
                     measure: str = r"^(T\w+?)_(est|moe)(\d+)$") -> DataFrame:
    """Many wide CSV files of one data set into one long table (R1):
    (id columns, variable, est, moe, source_file).

    The files are read in one pass as lines, and each line meets its own
    file's header (the line that has all the id columns' names), so files may differ in
    their columns and have any number of them: no column of the plan stands
    for a variable. ``T1_est1`` and ``T1_moe1`` of a line become one row ``T1_1``; an empty
    cell is a row with a null. ``equals``: id columns to be filtered on before lines are
    turned long.
    """
    table_of = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+\.csv)", 1)
    lines = spark.read.text([str(p) for p in paths]).select(F.regexp_replace("value", "^\ufeff", "").alias("value"), table_of.alias("source_file"))
    cells = lines.select("source_file", _csv_fields("value").alias("f"))
    is_header = F.forall(F.array(*[F.lit(c) for c in id_cols]), lambda c: F.array_contains("f", c))
    headers = cells.where(is_header).groupBy("source_file").agg(F.max("f").alias("h"))
    rows = cells.where(~is_header).join(headers, "source_file")
    rows = rows.select("source_file", "h", "f", *(F.nullif(F.get("f", (F.array_position("h", c) - 1).cast("int")), F.lit("")).alias(c) for c in id_cols))
    for c, v in (equals or {}).items():
        rows = rows.where(F.col(c) == v)
    # numbered before they are taken apart
    rows = rows.withColumn("_row", F.monotonically_increasing_id())
    each = rows.select("_row", "source_file", *id_cols, F.explode(F.arrays_zip("h", "f")).alias("x")).where(F.col("x.h").rlike(measure))
    part = [F.regexp_extract("x.h", measure, i) for i in (1, 2, 3)]
    # a line's cells are in one task, so the shuffle moves finished rows
    each = each.select("_row", "source_file", *id_cols, F.concat_ws("_", part[0], part[2]).alias("variable"), part[1].alias("_kind"),
                       F.nullif(F.col("x.f"), F.lit("")).cast("long").alias("_v"))
    got = each.groupBy("_row", "source_file", *id_cols, "variable").agg(
        F.max(F.when(F.col("_kind") == "est", F.col("_v"))).alias("est"), F.max(F.when(F.col("_kind") == "moe", F.col("_v"))).alias("moe"))
    return got.select(*id_cols, "variable", "est", "moe", "source_file")


def read_dictionary(spark: SparkSession, path: str, names, positions=None) -> DataFrame:
    """Data dictionary sheet (saved as CSV, all text), columns renamed by
    position (the first ones, or those in ``positions``)."""
    from civicframe.operators.columns import rename_positional
    return rename_positional(spark.read.option("header", True).csv(path), names, positions)


RING_SCHEMA = T.ArrayType(T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()),
                                                    T.StructField("y", T.DoubleType())])))
LAYER_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("name", T.StringType()),
    T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
    T.StructField("rings", RING_SCHEMA)])


def with_bbox(df: DataFrame, rings: str = "rings") -> DataFrame:
    """Bounding box columns of a polygon (all rings: it may have several parts)."""
    pts = F.flatten(F.col(rings))
    return df.withColumns({
        "xmin": F.array_min(F.transform(pts, lambda p: p["x"])),
        "xmax": F.array_max(F.transform(pts, lambda p: p["x"])),
        "ymin": F.array_min(F.transform(pts, lambda p: p["y"])),
        "ymax": F.array_max(F.transform(pts, lambda p: p["y"])),
    })


def read_layer(spark: SparkSession, path: str, layer: str) -> DataFrame:
    """Polygon layer stored as JSON lines (id, name, attrs, rings);
    bounding box added."""
    df = spark.read.schema(LAYER_SCHEMA).json(path).withColumn("layer", F.lit(layer))
    return with_bbox(df)


def read_layers(spark: SparkSession, items) -> DataFrame:
    """Several layers (e.g. one per state) stacked."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True),
                  [read_layer(spark, p, name) for p, name in items])


def read_years(spark: SparkSession, base: str, years=None, fmt: str = "parquet") -> DataFrame:
    """Yearly snapshots stored as ``base/year=YYYY/``: one partitioned
    read, the year kept as a column and used for partition pruning."""
    df = spark.read.format(fmt).option("header", True).load(base)
    return df.where(F.col("year").isin(list(years))) if years else df


def lookup(spark: SparkSession, rows, schema) -> DataFrame:
    """Small inline table (patterns, holidays, added rows)."""
    return spark.createDataFrame(list(rows), schema)


def add_rows(df: DataFrame, spark: SparkSession, rows, schema) -> DataFrame:
    """R ``add_row``: literal rows appended, missing columns null."""
    return df.unionByName(spark.createDataFrame(list(rows), schema), allowMissingColumns=True)
