"""Session construction and the few settings every plan relies on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings the library depends on for correct results (UTC clock) and for
# runtime re-planning at scale (AQE coalescing and skew-join splitting).
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def get_session(master: str | None = None, app: str = "civicframe",
                shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the library's required settings.

    On a cluster ``master`` stays ``None`` so spark-submit decides; locally
    (tests, bench) pass ``local[N]``. The UI is always off: no extra port.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(REQUIRED_CONF)
    conf["spark.ui.enabled"] = "false"
    conf["spark.ui.showConsoleProgress"] = "false"
    # Reliable checkpoints (row numbering, tree nodes) are removed once no
    # DataFrame refers to them, so the shared folder does not fill up.
    conf["spark.cleaner.referenceTracking.cleanCheckpoints"] = "true"
    conf["spark.sql.execution.arrow.pyspark.enabled"] = "true"
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    for k, v in REQUIRED_CONF.items():
        spark.conf.set(k, v)
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster it must be set by whoever runs the job (a shared file system
    path): a folder of our own would lie on each machine's own disk, so the
    library raises. Only in local mode (tests, local bench), where driver and
    tasks are one process, is a scratch folder made when none is set.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        d = tempfile.mkdtemp(prefix="civicframe-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    spark.sparkContext.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path for intermediate files, below one folder per application in
    the shared folder; that folder is deleted when the driver's JVM ends."""
    top = f"{checkpoint_dir(spark).rstrip('/')}/civicframe-{spark.sparkContext.applicationId}"
    p = spark._jvm.org.apache.hadoop.fs.Path(top)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    return f"{top}/{name}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df):
    """Write ``df`` once to the shared folder as Parquet and read it back
    (survives executor loss, unlike a local checkpoint; columnar and compressed,
    and later reads take only the columns they need)."""
    path = scratch_path(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
