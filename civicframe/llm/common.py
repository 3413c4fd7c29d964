"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicframe.session import scratch_path

# Byte table: A-Z to a-z, digits, a-z and all bytes from 0x80 kept, the rest
# (controls, punctuation) to a space. Words of the class
# [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ are then the space-separated tokens of the
# UTF-8 bytes, because every byte of a non-ASCII character is 0x80 or more.
WORD_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
    for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased words of a UTF-8 text (see ``WORD_TABLE``)."""
    return text.translate(WORD_TABLE).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder, deleted with all others
    of the application when the driver ends."""
    return scratch_path(spark, name)


def land(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage
    there, so a lost executor costs its own tasks and not the whole chain."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | Iterable[pa.RecordBatch]],
              schema: str) -> DataFrame:
    """``mapInArrow`` with a function of one batch."""
    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            if b.num_rows:
                out = fn(b)
                if isinstance(out, pa.RecordBatch):
                    yield out
                else:
                    yield from out
    return df.mapInArrow(run, schema)


def utf8(text_col) -> F.Column:
    """The text's UTF-8 bytes, null as empty."""
    c = F.col(text_col) if isinstance(text_col, str) else text_col
    return F.coalesce(c.cast("string"), F.lit("")).cast("binary")


def aside(df: DataFrame, names: list[str]):
    """``df`` with columns of these names (in any case) under private ones, and
    a function that gives them back to a result that has the private ones."""
    taken = {n.lower() for n in names}
    private = {c: f"_own_{i}_{uuid.uuid4().hex[:8]}" for i, c in enumerate(df.columns) if c.lower() in taken}
    return df.withColumnsRenamed(private), lambda out: out.withColumnsRenamed({v: k for k, v in private.items()})


def connect(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """Smallest index reachable from each of ``n`` items over links a-b, by
    min-label hooking and pointer jumping. ``label`` continues earlier links."""
    lab = np.arange(n) if label is None else label
    while len(a):
        la, lb = lab[a], lab[b]
        apart = la != lb
        if not apart.any():
            break
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(lab, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            nxt = lab[lab]
            if np.array_equal(nxt, lab):
                break
            lab = nxt
    return lab


def merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Labels after the links a-b, and a link from each group's old smallest
    member to its new one: never more links than groups that were merged."""
    roots = np.unique(np.concatenate([label[a], label[b]]))
    label = connect(len(label), a, b, label)
    moved = roots[label[roots] != roots]
    return label, moved, label[moved]


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected links: (node, comp), comp the
    smallest node reachable. Nodes are longs; self links and nulls are ignored.

    Alternating large-star and small-star steps. Each node's smallest
    neighbour is a partial aggregate joined back, so a hub is never gathered
    in one task (AQE splits its side of the join); every round is written to
    the shared folder. Only a row count and a checksum reach the driver.
    """
    e = (links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
         .where("u > v").distinct())
    e = land(e, "links")
    seen = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large star: every larger neighbour of u hangs on u's minimum
        large = (both.where("v > u").join(low, "u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct())
        # small star: u and its smaller neighbours hang on u's minimum
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(low2, "u")
        e = land(hung.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(low2.select("u", F.col("m").alias("v"))).distinct(), "stars")
        now = tuple(e.agg(F.count(F.lit(1)),
                          F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first())
        if now == seen or not now[0]:
            break
        seen = now
    return (e.select(F.col("u").alias("node"), F.col("v").alias("comp"))
            .union(e.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct()))
