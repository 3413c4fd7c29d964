"""Sinks (K1-K5) and the partitioned read-through cache."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: rows per cache file.
MAX_ROWS_PER_FILE = 1_000_000


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K1."""
    df.write.mode(mode).option("header", True).csv(path)


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite", partition_by=None) -> None:
    """K2."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_lines(df: DataFrame, col: str, path: str, mode: str = "overwrite") -> None:
    """K5: one string column as text lines."""
    df.select(F.col(col).cast("string").alias("value")).write.mode(mode).text(path)


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _commits(spark: SparkSession, path: str) -> list[str]:
    """Ids of the published commits, oldest first."""
    fs, p = _fs(spark, f"{path}/_commits")
    if not fs.exists(p):
        return []
    names = sorted(s.getPath().getName() for s in fs.listStatus(p))
    out = []
    for n in names:
        if n[0].isdigit():
            text = fs.open(_fs(spark, f"{path}/_commits/{n}")[1])
            try:
                out.append(bytes(text.readAllBytes()).decode())
            finally:
                text.close()
    return out


def _publish(spark: SparkSession, path: str, version: int, commit: str) -> bool:
    """Create the manifest of a version, whole and at once; False if another
    writer has it already."""
    fs, own = _fs(spark, f"{path}/_commits/.{commit}")
    out = fs.create(own, True)
    out.write(bytearray(commit.encode()))
    out.close()
    _, name = _fs(spark, f"{path}/_commits/{version:012d}")
    jvm = spark._jvm
    try:
        if fs.getScheme() == "file":
            # a hard link fails where the name exists; a local rename would replace it
            file = lambda p: jvm.java.nio.file.Paths.get(p.toUri().getPath(), spark.sparkContext._gateway.new_array(jvm.java.lang.String, 0))
            jvm.java.nio.file.Files.createLink(file(name), file(own))
        else:
            how = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
            how[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(own, name, how)
        return True
    except Py4JJavaError as e:
        if "FileAlreadyExists" not in e.java_exception.getClass().getName():
            raise
        return False
    finally:
        fs.delete(own, False)


def _read(spark: SparkSession, path: str, commits: list[str]) -> DataFrame | None:
    """The cache as a table as of some commits, None if there are none. Any
    other trouble (a broken file, a schema that does not fit) is raised."""
    if not commits:
        return None
    return spark.read.parquet(path).where(F.col("commit").isin(commits)).drop("commit")


def _existing(spark: SparkSession, path: str):
    return _read(spark, path, _commits(spark, path))


def append_to_cache(df: DataFrame, path: str, keys=("year", "geography", "geoid", "variable"),
                    partition_by=("year", "geography"), complete: bool = False) -> None:
    """K3: add rows to the partitioned cache, at most a million rows a file.

    Rows whose key is already cached are skipped first (anti join on the
    natural key, null matching null, against the incoming partitions only), so
    a re-run adds nothing. Rows that repeat a key with equal values are taken
    once; different values for one key are an error, as no rule says which is
    right. ``rebalance`` on the partition columns spreads a large partition
    over several tasks.

    Any number of writers: rows are staged in a folder of the writer's own,
    moved into their partitions as ``commit=<id>`` (a rename a partition), and become visible
    when the manifest of the next version is created, which one writer can do.
    A writer that finds the version taken compares its rows with what
    was committed since and tries the next one. What a killed writer leaves
    behind is in no manifest and never read.

    ``complete``: the rows are all there is for their partitions; a marker per
    partition is written last (see :func:`is_complete`).
    """
    spark = df.sparkSession
    keys, parts = list(keys), list(partition_by)
    new = df.distinct()
    clash = new.groupBy(*keys).count().where("count > 1").limit(1).collect()
    if clash:
        raise ValueError(f"different values for one key: {clash[0].asDict()}")
    wanted = df.select(*[F.col(c).alias(f"_w_{c}") for c in parts]).distinct()
    while True:
        commits = _commits(spark, path)
        commit = f"c{uuid.uuid4().hex}"
        if _stage(_unseen(new, _read(spark, path, commits), wanted, keys, parts), path, commit, parts):
            if _publish(spark, path, len(commits) + 1, commit):
                break
            _drop(spark, path, commit, len(parts))
        else:
            break
    if complete:
        # partitions (years by geographies) are few by construction
        for row in df.select(*parts).distinct().collect():
            fs, p = _fs(spark, _marker(path, row.asDict()))
            fs.create(p, True).close()


def _unseen(new: DataFrame, old: DataFrame | None, wanted: DataFrame, keys, parts) -> DataFrame:
    if old is None:
        return new
    seen = old.join(wanted, [old[c].eqNullSafe(F.col(f"_w_{c}")) for c in parts], "left_semi") \
        .select(*[F.col(c).alias(f"_k_{c}") for c in keys])
    return new.join(seen, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in keys], "left_anti")


def _stage(rows: DataFrame, path: str, commit: str, parts) -> bool:
    """Write the rows and move them to their partitions, still invisible;
    False if there are none."""
    spark = rows.sparkSession
    top = f"{path}/_staged/{commit}"
    (rows.hint("rebalance", *[F.col(c) for c in parts]).write.partitionBy(*parts)
         .option("maxRecordsPerFile", MAX_ROWS_PER_FILE).parquet(top))
    fs, staged = _fs(spark, top)
    found = False
    for folder in _partitions(fs, staged, len(parts)):
        inside = folder.toUri().getPath().split(f"/_staged/{commit}/", 1)[1]
        _, goal = _fs(spark, f"{path}/{inside}/commit={commit}")
        fs.mkdirs(goal.getParent())
        if not fs.rename(folder, goal):
            raise OSError(f"{folder} could not be moved to {goal}")
        found = True
    fs.delete(staged, True)
    return found


def _partitions(fs, top, depth: int) -> list:
    """Folders ``depth`` levels of ``name=value`` below ``top``."""
    level = [top]
    for _ in range(depth):
        level = [s.getPath() for p in level for s in fs.listStatus(p) if s.isDirectory() and "=" in s.getPath().getName()]
    return level


def _drop(spark: SparkSession, path: str, commit: str, depth: int) -> None:
    """Remove the rows of a commit of one's own that was not published."""
    fs, p = _fs(spark, path)
    for folder in _partitions(fs, p, depth):
        fs.delete(_fs(spark, f"{folder.toString()}/commit={commit}")[1], True)


def _marker(path: str, part: dict) -> str:
    return f"{path}/_complete/" + ",".join(f"{k}={v}" for k, v in sorted(part.items()))


def is_complete(spark: SparkSession, path: str, **part) -> bool:
    """Whether a partition was filled to the end."""
    fs, p = _fs(spark, _marker(path, part))
    return fs.exists(p)


def newest_partition(spark: SparkSession, path: str, name: str = "year") -> int | None:
    """Largest value of the first partition column among the folders that hold
    a published commit."""
    fs, p = _fs(spark, path)
    commits = set(_commits(spark, path))
    if not commits:
        return None
    values = []
    for s in fs.listStatus(p):
        f = s.getPath().getName()
        if f.startswith(f"{name}=") and f.split("=", 1)[1].lstrip("-").isdigit() and _holds(fs, s.getPath(), commits):
            values.append(int(f.split("=", 1)[1]))
    return max(values, default=None)


def _holds(fs, folder, commits: set[str]) -> bool:
    names = [s.getPath() for s in fs.listStatus(folder) if s.isDirectory()]
    return any(n.getName().removeprefix("commit=") in commits or _holds(fs, n, commits) for n in names)


def read_cache(spark: SparkSession, path: str, year: int | None = None, **equals) -> DataFrame | None:
    """K4: read through the cache; with no year the newest cached year, read
    from the folder names. Filters on partition columns prune whole folders."""
    df = _existing(spark, path)
    if df is None:
        return None
    if year is None:
        year = newest_partition(spark, path)
    out = df.where(F.col("year") == year)
    for k, v in equals.items():
        if v is not None:
            out = out.where(F.col(k) == v)
    return out
