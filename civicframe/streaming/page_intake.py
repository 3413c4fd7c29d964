"""Intake of an API's pages as they land.

A page is a line of JSON, ``{"set": ..., "offset": ..., "data": [records]}``;
a file holds any number of them. The pages of a set (one request) start at
offset 0 and follow each other by ``page_size``; a page without records ends
the set. Pages may land in any order, several times, and overlap.

One Structured Streaming job takes the pages apart into records and page
marks, drops what was taken in before by a digest kept in the state store
(RocksDB: on disk, checkpointed to the shared folder; one digest for each
distinct record, kept for good, as a replay may come at any time), and appends
the rest through Spark's own file sink, which writes each batch once.
:func:`page_sets` tells from the marks which sets are whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from civicframe.session import checkpoint_dir

# Fixed value: records in a full page.
PAGE_SIZE = 1000

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _page_schema(record: T.StructType) -> T.StructType:
    return T.StructType([T.StructField("set", T.StringType()), T.StructField("offset", T.LongType()),
                         T.StructField("data", T.ArrayType(record))])


def _event_schema(record: T.StructType) -> T.StructType:
    return T.StructType([T.StructField("set", T.StringType()), T.StructField("offset", T.LongType()),
                         T.StructField("n_records", T.LongType()), T.StructField("record", record), T.StructField("kind", T.StringType())])


def _digest(c: Column) -> Column:
    return F.sha2(F.to_json(c, {"ignoreNullFields": "false"}), 256)


def page_events(pages: DataFrame, record: T.StructType) -> DataFrame:
    """Pages as one mark each and their records: (set, offset, n_records,
    record, kind, digest). A line that is no page, or has no ``data``, is a mark
    with a null count; null entries of ``data`` are counted but are no records."""
    null = F.lit(None)
    whole = F.col("set").isNotNull() & F.col("offset").isNotNull()
    n = F.when(whole & F.col("data").isNotNull(), F.size("data").cast("long"))
    mark = F.struct(F.col("set"), F.col("offset"), n.alias("n_records"), null.cast(record).alias("record"), F.lit("page").alias("kind"))
    rows = F.transform(F.filter("data", lambda r: r.isNotNull()), lambda r: F.struct(
        null.cast("string").alias("set"), null.cast("long").alias("offset"), null.cast("long").alias("n_records"),
        r.alias("record"), F.lit("row").alias("kind")))
    events = pages.select(F.explode(F.concat(F.array(mark), F.when(n.isNotNull(), rows).otherwise(F.array().cast(T.ArrayType(_event_schema(record)))))).alias("e"))
    return events.select("e.*", _digest(F.col("e")).alias("digest"))


def start_page_intake(spark: SparkSession, landed: str, record: T.StructType, out: str, name: str,
                      max_files_per_trigger: int = 100, available_now: bool = True, checkpoint: str | None = None):
    """Start the job; returns the ``StreamingQuery``. Its checkpoint is
    ``checkpoint``, else a folder by its name in the shared folder: started again
    with it, the job goes on where it stopped. ``out`` belongs to one checkpoint."""
    pages = spark.readStream.schema(_page_schema(record)).option("maxFilesPerTrigger", max_files_per_trigger).json(landed)
    new = page_events(pages, record).dropDuplicates(["digest"]).drop("digest")
    w = (new.writeStream.format("parquet").partitionBy("kind").outputMode("append").queryName(name)
         .option("path", out).option("checkpointLocation", checkpoint or f"{checkpoint_dir(spark).rstrip('/')}/streams/{name}"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    before = spark.conf.get(_STORE, None)
    # taken over by the job when it starts
    spark.conf.set(_STORE, _ROCKSDB)
    try:
        return w.start()
    finally:
        spark.conf.set(_STORE, before) if before else spark.conf.unset(_STORE)


def _taken_in(spark: SparkSession, out: str, record: T.StructType, kind: str) -> DataFrame:
    return spark.read.schema(_event_schema(record)).parquet(out).where(F.col("kind") == kind)


def intake_rows(spark: SparkSession, out: str, record: T.StructType) -> DataFrame:
    """The distinct records of all pages so far."""
    return _taken_in(spark, out, record, "row").select("record.*")


def page_sets(spark: SparkSession, out: str, record: T.StructType, page_size: int = PAGE_SIZE) -> DataFrame:
    """One row a set: n_pages and n_rows taken in, end_offset (of the first
    page without records after all others; null if it has not come), n_missing
    (pages that lack before the end, or before the last one), n_short (pages
    that are not full although others follow) and complete (ended, none
    missing, none short). An offset that came with different counts has the
    largest; one between two pages' places does not count as a page. Lines
    that are no pages make a row with a null set, which is never complete."""
    at = _taken_in(spark, out, record, "page").groupBy("set", "offset").agg(F.max("n_records").alias("n"))
    placed = F.col("offset") % page_size == 0
    full = at.withColumn("filled", F.coalesce((F.col("n") > 0) & placed, F.lit(False)))
    last = F.max(F.when(F.col("filled"), F.col("offset")))
    # both aggregates are partial: no set is gathered in one task
    ends = full.groupBy("set").agg(F.coalesce(last, F.lit(-page_size).cast("long")).alias("last"))
    j = full.alias("a").join(ends.alias("b"), F.col("a.set").eqNullSafe(F.col("b.set"))) \
        .select("a.*", F.col("b.last"))
    got = j.groupBy("set", "last").agg(
        F.count_if("filled").alias("n_pages"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.min(F.when((F.col("n") == 0) & (F.col("offset") > F.col("last")), F.col("offset"))).alias("end_offset"),
        F.count_if(F.col("filled") & (F.col("n") < page_size) & (F.col("offset") < F.col("last"))).alias("n_short"))
    until = F.coalesce("end_offset", F.col("last") + page_size)
    missing = F.ceil(until / page_size) - F.col("n_pages")
    whole = F.col("set").isNotNull() & F.col("end_offset").isNotNull() & (F.col("n_missing") == 0) & (F.col("n_short") == 0)
    return got.withColumn("n_missing", missing).select("set", "n_pages", "n_rows", "end_offset", "n_missing", "n_short", whole.alias("complete"))
