"""Incremental fill of a partitioned cache from landed files.

The reference has no stream operators; what it does incrementally is add
newly fetched data to a partitioned cache without duplicating what is
already there (K3). As a Structured Streaming job: a file source picks up
each newly landed page or table once, and ``foreachBatch`` appends the
batch through the same idempotent anti join as the batch sink, so a batch
that is replayed after a failure adds nothing. The checkpoint must live in
the shared checkpoint folder of the session.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from civicframe.session import checkpoint_dir
from civicframe.sources.sinks import append_to_cache


def start_cache_fill(spark: SparkSession, source_dir: str, schema, cache_path: str,
                     transform: Callable[[DataFrame], DataFrame], keys, partition_by,
                     fmt: str = "json", name: str = "cache_fill", max_files_per_trigger: int = 100,
                     available_now: bool = True):
    """Start the stream; returns the ``StreamingQuery``.

    ``transform`` turns raw landed rows into cache rows (e.g. request
    narrowing, or wide-to-long for tables). With ``available_now`` the query
    processes what has landed and stops (a scheduled job); otherwise it keeps
    running and picks up new files as they land.
    """
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
    if fmt == "csv":
        reader = reader.option("header", True)
    raw = reader.format(fmt).load(source_dir)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        append_to_cache(transform(batch), cache_path, keys=keys, partition_by=partition_by)

    ckpt = f"{checkpoint_dir(spark).rstrip('/')}/streams/{name}"
    w = raw.writeStream.foreachBatch(write_batch).option("checkpointLocation", ckpt).queryName(name)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()
