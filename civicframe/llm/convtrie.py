"""Prefix trie of conversations, screened by a count-min sketch.

Every sequence of first ``d`` turns of a conversation is a node of depth d.
The digest of a prefix is a sum over its turns (five 32-bit lanes of SHA-256
of place, role and text), so that it comes from running sums that need no
conversation in one task. Sketch: ``ROWS`` rows of cells count the digests of
all prefixes; an estimate of one proves that a prefix has a single member, and
with it everything below. Such tails are emitted where they stand. Only prefixes that may be
shared (a larger estimate, true or not) shuffle to be grouped exactly. The
sketch reaches the tasks as one bit a cell (two or more); it has at least
``CELLS`` cells a row for each prefix, up to ``MOST_CELLS`` a row. Past that
more prefixes are grouped, with equal results.

Sums over subtrees need no walk: a conversation *owns* the nodes of which it is the smallest
member, and these are the end of its path, from some depth on. So with each
conversation's first owned depth, what a node has below it is a sum over
its members: children and leaves are counted by their owners, and a member
that does not own the node saves the text between the node and its own first one.
All of it is partial aggregates over rows (conversation, depth).

The list of members that end at a node is hashed in order: tasks render
runs of it (range partitioned, so a node with very many members is cut), and only rendered
runs meet in one task, which streams them.

Defined cases: null roles and texts are empty; equal turn numbers are ordered
by role and text; rows with a null conv_id belong to no conversation and are ignored; repeated
rows are turns of their own; an empty table gives no node, not even a root; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from civicframe.operators.windows import numbered

from .common import land

ROWS = 4
CELLS = 4
MOST_CELLS = 1 << 24
RUN = 8192
LANES = 5
BITS = 1 << 15        # of one bitmap of Spark's bitmap functions


def in_order(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, role, text), pos from 1."""
    t = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                             F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where("conv_id IS NOT NULL")
    return numbered(t, ["turn", "role", "text"], ["conv_id"], out="pos").select("conv_id", F.col("pos").cast("long").alias("pos"), "role", "text")


def rebuilt(turns: DataFrame, modulus: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Each conversation c with the first h turns of conversation c - c % modulus in
    place of its own first h, h = crc32(decimal c) % most: (conv_id, depth,
    role, text), and all conv_ids."""
    n = turns.groupBy("conv_id").agg(F.max("pos").alias("n"))
    c = n.select("conv_id", (F.col("conv_id") - F.col("conv_id") % modulus).alias("base"),
                 F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(most)).cast("long").alias("h"))
    c = (c.join(n.select(F.col("conv_id").alias("base"), F.col("n").alias("nb")), "base", "left")
         .withColumn("k", F.least("h", F.coalesce("nb", F.lit(0)))))
    own = (turns.join(c.select("conv_id", "h", "k"), "conv_id").where("pos > h")
           .select("conv_id", (F.col("pos") - F.col("h") + F.col("k")).alias("depth"), "role", "text"))
    # at most ``modulus`` conversations take turns from one, at most most - 1 each
    start = turns.where((F.col("pos") < most) & (F.col("conv_id") % modulus == 0)).withColumnRenamed("conv_id", "base")
    taken = c.select("conv_id", "base", "k").join(start, "base").where("pos <= k").select("conv_id", F.col("pos").alias("depth"), "role", "text")
    return own.union(taken), c.select("conv_id")


def running_sums(df: DataFrame, group: str, order: str, cols: list[str]) -> DataFrame:
    """Running sums ``s_<col>`` within groups of any size: sums in pieces of a
    range-partitioned table, and the pieces' totals carried on."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = land(df.repartitionByRange(n, group, order).sortWithinPartitions(group, order)
                  .withColumn("_pid", F.shiftright(F.monotonically_increasing_id(), 33)), "ranged")
    here = Window.partitionBy("_pid", group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    pieces = ranged.groupBy("_pid", group).agg(*(F.sum(c).alias(c) for c in cols))
    before = Window.partitionBy(group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    carry = pieces.select("_pid", group, *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"c_{c}") for c in cols))
    return (ranged.select("*", *(F.sum(c).over(here).alias(f"h_{c}") for c in cols)).join(carry, ["_pid", group])
            .select(*df.columns, *((F.col(f"h_{c}") + F.col(f"c_{c}")).alias(f"s_{c}") for c in cols)))


def digest(lanes: list[Column]) -> Column:
    return F.unhex(F.md5(F.concat_ws(",", *lanes).cast("binary")))


def prefixes(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv_id, depth, key, pkey, len, before, last, total) of every prefix,
    the root included: digests of the prefix and of its parent, code points of its last
    text and of those before it; depth and code points of the conversation."""
    h = F.sha2(F.concat_ws(":", "depth", F.octet_length("role"), F.concat("role", "text")).cast("binary"), 256)
    lanes = [f"l{i}" for i in range(LANES)]
    t = rows.select("conv_id", "depth", F.char_length("text").cast("long").alias("len"), h.alias("h"))
    t = t.select("conv_id", "depth", "len", *(F.conv(F.substring("h", 8 * i + 1, 8), 16, 10).cast("long").alias(c) for i, c in enumerate(lanes)))
    t = running_sums(t, "conv_id", "depth", ["len", *lanes])
    root = digest([F.lit(0)] * LANES)
    t = t.select("conv_id", "depth", digest([F.col(f"s_{c}") for c in lanes]).alias("key"),
                 digest([F.col(f"s_{c}") - F.col(c) for c in lanes]).alias("pkey"), "len", (F.col("s_len") - F.col("len")).alias("before"))
    zero = F.lit(0).cast("long")
    t = t.union(convs.select("conv_id", zero, root, F.lit(None).cast("binary"), zero, zero))
    whole = t.groupBy("conv_id").agg(F.max("depth").alias("last"), F.sum("len").alias("total"))
    t = t.join(whole, "conv_id")
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return land(t.repartitionByRange(n, "conv_id", "depth").sortWithinPartitions("conv_id", "depth"), "prefixes")


def cells(key: str, width: int) -> Column:
    return F.array(*(F.pmod(F.xxhash64(F.lit(r), key), F.lit(width)) + r * width for r in range(ROWS)))


def sketch(rows: DataFrame, width: int) -> np.ndarray:
    """Which cells count two or more prefixes; at most ``ROWS * MOST_CELLS``
    bits reach the driver."""
    full = rows.select(F.explode(cells("key", width)).alias("cell")).groupBy("cell").count().where("count > 1")
    one = (F.col("cell") + 1).cast("long")
    maps = full.groupBy(F.bitmap_bucket_number(one).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(one)).alias("m")).collect()
    bits = np.zeros(-(-ROWS * width // BITS) * BITS // 8, np.uint8)
    for r in maps:
        at = (r["b"] - 1) * BITS // 8
        bits[at:at + BITS // 8] = np.frombuffer(bytes(r["m"]), np.uint8)
    return bits


def screened(rows: DataFrame, width: int | None = None) -> DataFrame:
    """``rows`` with ``tail`` (a single member is proven) and ``first`` (of a
    tail, as far as the task can tell; a first row is only looked up more)."""
    if width is None:
        width = 1 << 12
        n = rows.count()
        while width < min(CELLS * n, MOST_CELLS):
            width *= 2
    bits = sketch(rows, width)

    def run(batches):
        conv, open_tail = None, False
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            c = b.column(0).to_numpy()
            cell = b.column(b.num_columns - 1).flatten().to_numpy()
            shared = ((bits[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1).reshape(n, ROWS).all(axis=1)
            start = np.concatenate([[c[0] != conv], c[1:] != c[:-1]])
            place = np.arange(n)
            run_from = np.maximum.accumulate(np.where(start, place, -1))
            single = np.maximum.accumulate(np.where(shared, -1, place))
            tail = (single >= run_from) & (single >= 0)
            if open_tail:
                tail |= run_from < 0
            first = tail & np.concatenate([[start[0] or not open_tail], ~tail[:-1] | start[1:]])
            conv, open_tail = c[-1], bool(tail[-1])
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(b.num_columns - 1)), pa.array(tail), pa.array(first)],
                                             names=[*b.schema.names[:-1], "tail", "first"])
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return land(rows.withColumn("cells", cells("key", width)).mapInArrow(run, f"{schema}, tail boolean, first boolean"), "screened")


def ends(rows: DataFrame) -> DataFrame:
    """(key, sha): digest of the ascending conv_ids of each key, rendered in
    runs by many tasks and hashed as a stream."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def render(batches):
        for b in batches:
            keys, ids = b.column(0).to_pylist(), b.column(1).to_pylist()
            out, i = [], 0
            while i < len(keys):
                j = i + 1
                while j < len(keys) and j - i < RUN and keys[j] == keys[i]:
                    j += 1
                out.append((keys[i], ids[i], ",".join(map(str, ids[i:j]))))
                i = j
            if out:
                k, f, t = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(k, pa.binary()), pa.array(f, pa.int64()), pa.array(t)], names=["key", "lead", "ids"])

    def hashed(batches):
        key, sha = None, None
        for b in batches:
            out = []
            for k, t in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                if k == key:
                    sha.update(b"," + t.encode())
                    continue
                if key is not None:
                    out.append((key, sha.hexdigest()))
                key, sha = k, hashlib.sha256(t.encode())
            if out:
                x, y = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()), pa.array(y)], names=["key", "sha"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([sha.hexdigest()])], names=["key", "sha"])

    runs = (rows.select("key", "conv_id").repartitionByRange(n, "key", "conv_id").sortWithinPartitions("key", "conv_id")
            .mapInArrow(render, "key binary, lead long, ids string"))
    return runs.repartition(n, "key").sortWithinPartitions("key", "lead").mapInArrow(hashed, "key binary, sha string")


def trie(rows: DataFrame, convs: DataFrame, width: int | None = None) -> DataFrame:
    """Nodes of the trie of ``rows`` (conv_id, depth, role, text; depths from 1
    without gaps) and of all ``convs``, turnless ones included. ``width``:
    cells a row of the sketch, for tests."""
    got = screened(prefixes(rows, convs), width)
    shared, tails = got.where("NOT tail"), got.where("tail")
    basic = [F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.count(F.lit(1)).alias("n_convs"),
             F.max("last").alias("deepest"), F.max("before").alias("before"), F.max("pkey").alias("pkey")]
    nodes = land(shared.groupBy("key").agg(*basic), "nodes")
    # what each conversation owns: its first node, and whether its last is a leaf
    owned = (nodes.select("conv_id", "depth", "before", (F.col("depth") == F.col("deepest")).alias("leaf"))
             .union(tails.select("conv_id", "depth", "before", F.col("depth") == F.col("last"))))
    owned = land(owned.groupBy("conv_id").agg(F.min("depth").alias("q"), F.min("before").alias("q_before"),
                                              F.max(F.col("leaf").cast("int")).alias("leaf")), "owned")
    member = shared.join(owned, "conv_id", "left")
    sums = member.groupBy("key").agg(
        F.sum(F.when((F.col("last") > F.col("depth")) & (F.col("q") <= F.col("depth") + 1), 1).otherwise(0)).alias("n_children"),
        F.sum(F.coalesce("leaf", F.lit(0))).alias("n_leaves"),
        F.sum(F.when(F.col("q") <= F.col("depth"), 0).otherwise(F.coalesce("q_before", "total") - F.col("before"))).alias("saved_tokens"))
    sha = ends(shared.where("depth = last"))
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    inner = (nodes.join(sums, "key").join(sha, "key", "left").join(owned.select("conv_id", "q"), "conv_id")
             .select("conv_id", "depth", "pkey", (F.col("q") == F.col("depth")).alias("head"), "n_convs", "n_children", "n_leaves", "saved_tokens",
                     F.coalesce("sha", nothing).alias("ends_sha256")))
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    # a tail's parent is in the same tail, but for its first row
    outer = tails.select("conv_id", "depth", "pkey", F.col("first").alias("head"), one.alias("n_convs"),
                         F.when(F.col("last") > F.col("depth"), one).otherwise(none).alias("n_children"), one.alias("n_leaves"),
                         none.alias("saved_tokens"), F.when(F.col("last") > F.col("depth"), nothing)
                         .otherwise(F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).alias("ends_sha256"))
    every = inner.union(outer)
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    local = every.where("NOT head OR depth = 0").withColumn(
        "parent_conv_id", F.when(F.col("depth") > 0, F.col("conv_id")))
    # a head's parent has other members, so it was grouped; else it is the head's own
    heads = (every.where("head AND depth > 0").join(nodes.select(F.col("key").alias("pkey"), F.col("conv_id").alias("above")), "pkey", "left")
             .withColumn("parent_conv_id", F.coalesce("above", "conv_id")))
    return local.select(*names).unionByName(heads.select(*names)).select(
        *(F.col(c).cast("long").alias(c) for c in names[:-1]), "ends_sha256")


def conversation_trie(conversations: DataFrame, width: int | None = None) -> DataFrame:
    rows, convs = rebuilt(in_order(conversations))
    return trie(rows, convs, width)
