"""Mixing sources to target weights by Pfair scheduling, in DataFrame and SQL
functions only.

Rows of a source are put in a fixed pseudo-random order (MD5 of seed and id)
and cut into blocks of ``block`` rows. Block j (1, 2, ...) of a source with
weight q / W gets the release time floor((j - 1) W / q)
and the deadline ceil(j W / q). Slot by slot, of the released blocks the one
with the earliest deadline runs (ties: lower source rank). Every block then lies in its window, so
at any time each source has had its share of the slots, give or take less
than one block.

By default q and W are the whole weights and their sum, divided by
their greatest common divisor: the shares are the weights themselves. With a number of slots
W is that number and q the weight rounded to whole slots, and the bound
holds against the rounded share: a source whose share is rounded to 0 gets no
slot, and rounding adds up over the periods.

All windows repeat after W slots (where every source is exactly even), so one
table of W slots, folded once by a SQL ``aggregate`` over the slots in pieces of
``PIECE``, holds the whole schedule: block j runs at slot
W * ((j - 1) div q) + slot of ((j - 1) mod q) + 1. The table has W rows (by
``root_weights`` at most the root of sources times rows) and is broadcast; the
fold takes one task, and time by W and the number of blocks that wait at
once (one of each source at most). Row numbers inside a source come from counts by
(source, MD5 prefix), so a source that holds most rows is spread over all
tasks. No row is dropped or repeated: once a source has run dry its slots stay
empty and ``mixed`` is false from the first slot any source can no longer fill.

Defined cases: null sources are a source of their own ('' sorts before it);
null ids are ordered as empty; rows repeating an id are ordered by
``tie_cols`` and, if those are equal too, any order gives the same result;
an empty table gives an empty result; a weight of 0, or a source without a
weight, gets no slot: its rows keep null slots and ``mixed`` false; extra
columns are kept, those that have the names of added ones are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import aside

SLOTS = 1000  # W: the resolution of rounded weights
PIECE = 1024  # slots folded before their order is appended
BLOCK = 16    # rows of a block
SEED = 42
PREFIX = 4    # hex digits of the MD5 prefix
COARSE = 2    # and of its first part


def root_weights(docs: DataFrame, source: str = "source") -> DataFrame:
    """(source, weight): the whole part of the square root of each source's
    row count, which tempers sources that hold much of the rows."""
    return docs.groupBy(source).agg(F.floor(F.sqrt(F.count(F.lit(1)))).alias("weight"))


def quotas(weights: DataFrame, slots: int | None = SLOTS, source: str = "source") -> DataFrame:
    """(source, rank, q, period): slots of each source in a period; rank is the
    source's place in name order, null first. With ``slots`` whole slots of that
    period by largest remainder (ties: lower rank), else the exact weights.
    ``weight`` is a whole number. One row per source."""
    w = weights.select(F.col(source).alias("source"), F.col("weight").cast("long").alias("weight")).where("weight > 0")
    everything, by_name = Window.partitionBy(), Window.orderBy(F.col("source").asc_nulls_first())
    total = F.sum("weight").over(everything)
    share = w.withColumn("total", total).withColumn("rank", F.row_number().over(by_name))
    if slots is None:
        # Euclid's algorithm on two longs ends within 92 steps
        divisor = w.agg(F.expr("""
            aggregate(collect_set(weight), 0L, (g, x) ->
              aggregate(sequence(1, 92), named_struct('a', x, 'b', g),
                (s, i) -> if(s.b = 0, s, named_struct('a', s.b, 'b', s.a % s.b)), s -> s.a))""").alias("d"))
        return (share.withColumn("d", divisor.scalar())
                .select("source", "rank", F.expr("weight div d").alias("q"), F.expr("total div d").alias("period")))
    share = share.withColumn("q0", F.expr(f"weight * {slots}L div total")).withColumn("rest", F.expr(f"weight * {slots}L % total"))
    left = F.lit(slots) - F.sum("q0").over(everything)
    more = F.row_number().over(Window.orderBy(F.desc("rest"), "rank")) <= left
    return share.select("source", "rank", (F.col("q0") + more.cast("int")).alias("q"), F.lit(slots).cast("long").alias("period"))


def schedule(quota: DataFrame) -> DataFrame:
    """(rank, nth, at): slot of the nth block of each source in one period.

    The fold holds the released blocks that wait, as one long of deadline and
    rank, sorted. The q of all sources add up to the period, so none is empty.
    """
    block = (quota.where("q > 0").select("rank", "q", "period", F.explode(F.expr("sequence(0L, q - 1)")).alias("j"))
             .select(F.expr("j * period div q").alias("t"),
                     F.expr(f"((j + 1) * period + q - 1) div q * {1 << 31}L + rank").alias("key")))
    batch = block.groupBy("t").agg(F.collect_list("key").alias("new"))
    times = (quota.where("q > 0").agg(F.max("period").alias("period")).where("period > 0")
             .select(F.explode(F.expr("sequence(0L, period - 1)")).alias("t")))
    piece = (times.join(batch, "t", "left").select("t", F.coalesce("new", F.expr("cast(array() as array<bigint>)")).alias("new"))
             .groupBy(F.expr(f"t div {PIECE}").alias("p")).agg(F.sort_array(F.collect_list(F.struct("t", "new"))).alias("batches")))
    run = piece.agg(F.sort_array(F.collect_list(F.struct("p", "batches"))).alias("pieces")).select(F.expr("""
        aggregate(pieces, named_struct('wait', cast(array() as array<bigint>), 'order', cast(array() as array<bigint>)),
          (acc, p) -> transform(array(
            aggregate(p.batches, named_struct('wait', acc.wait, 'order', cast(array() as array<bigint>)),
              (a, b) -> transform(array(if(size(b.new) = 0, a.wait, array_sort(concat(a.wait, b.new)))),
                w -> named_struct('wait', slice(w, 2, size(w)), 'order', concat(a.order, slice(w, 1, 1))))[0])),
            x -> named_struct('wait', x.wait, 'order', concat(acc.order, x.order)))[0],
          acc -> acc.order)""").alias("run"))
    return (run.select(F.posexplode("run").alias("at", "key")).select(F.expr(f"cast(key % {1 << 31}L as int)").alias("rank"), "at")
            .withColumn("nth", F.row_number().over(Window.partitionBy("rank").orderBy("at"))))


def mix(docs: DataFrame, weights: DataFrame | None = None, slots: int | None = None, block: int = BLOCK, seed: int = SEED,
        source: str = "source", id_col: str = "doc_id", tie_cols: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` with n_in_source, block, release, deadline, slot and mixed added;
    columns that have these names are replaced.

    Order by (slot, n_in_source) to read the mixture. ``slots`` None: exact weights.
    """
    added = ("n_in_source", "block", "release", "deadline", "slot", "mixed")
    docs = docs.drop(*(c for c in docs.columns if c.lower() in added and c not in (source, id_col)))
    docs, given_back = aside(docs, ["_key", "_part", "_s", "_p", "_rn", "_before", "_qs", "_rank", "_q", "_w", "_r", "_nth", "_at", "_nth1", "_until"])
    weights = root_weights(docs, source) if weights is None else weights
    quota = quotas(weights, slots, source if source in weights.columns else "source")
    key = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(f":{seed}")).cast("binary"))
    src = F.col(source)
    keyed = docs.withColumn("_key", key).withColumn("_part", F.substring("_key", 1, PREFIX))
    # rows before each part of a source: 16^PREFIX counts a source at most, summed
    # in two levels, so that a window holds 16^COARSE rows whatever the data
    sizes = (docs.select(src.alias("_s"), F.substring(key, 1, PREFIX).alias("_p")).groupBy("_s", "_p").count()
             .withColumn("_c", F.substring("_p", 1, COARSE)))
    first = Window.partitionBy("_s").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    second = Window.partitionBy("_s", "_c").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    tops = (sizes.groupBy("_s", "_c").agg(F.sum("count").alias("_n0")).withColumn("_top", F.coalesce(F.sum("_n0").over(first), F.lit(0)))
            .select(F.col("_s").alias("_s0"), F.col("_c").alias("_c0"), "_top"))
    sizes = (sizes.withColumn("_low", F.coalesce(F.sum("count").over(second), F.lit(0)))
             .join(tops, F.col("_s").eqNullSafe(F.col("_s0")) & (F.col("_c") == F.col("_c0")))
             .select("_s", "_p", (F.col("_top") + F.col("_low")).alias("_before")))
    inside = Window.partitionBy(source, "_part").orderBy("_key", id_col, *tie_cols)
    ranked = (keyed.withColumn("_rn", F.row_number().over(inside))
              .join(sizes, src.eqNullSafe(F.col("_s")) & (F.col("_part") == F.col("_p")), "left")
              .withColumn("n_in_source", (F.col("_rn") + F.col("_before")).cast("long"))
              .withColumn("block", F.expr(f"(n_in_source - 1) div {block} + 1")))
    # a row per source, and a row per slot of a period
    q = quota.select(F.col("source").alias("_qs"), F.col("rank").alias("_rank"), F.col("q").alias("_q"), F.col("period").alias("_w"))
    plan = schedule(quota).select(F.col("rank").alias("_r"), F.col("nth").alias("_nth"), F.col("at").alias("_at"))
    # first slot that a source whose blocks have run out cannot fill
    runs_out = (docs.groupBy(source).count().select(src.alias("_cs"), F.expr(f"(count + {block - 1}) div {block}").alias("_n"))
                .join(F.broadcast(q), F.col("_cs").eqNullSafe(F.col("_qs"))).where("_q > 0")
                .withColumn("_nth", F.expr("_n % _q + 1"))
                .join(F.broadcast(plan.withColumnRenamed("_nth", "_n2")), (F.col("_rank") == F.col("_r")) & (F.col("_nth") == F.col("_n2")))
                .agg(F.min(F.expr("_w * (_n div _q) + _at")).alias("_until")))
    placed = (ranked.join(F.broadcast(q), src.eqNullSafe(F.col("_qs")), "left")
              .withColumn("_nth1", F.when(F.col("_q") > 0, F.expr("(block - 1) % _q + 1")))
              .join(F.broadcast(plan), (F.col("_rank") == F.col("_r")) & (F.col("_nth1") == F.col("_nth")), "left")
              .withColumn("_until", runs_out.scalar()))
    on = F.col("_q") > 0
    return given_back(placed.select(
        *docs.columns, "n_in_source", "block",
        F.when(on, F.expr("(block - 1) * _w div _q")).alias("release"),
        F.when(on, F.expr("(block * _w + _q - 1) div _q")).alias("deadline"),
        F.when(on, F.expr("_w * ((block - 1) div _q) + _at")).alias("slot"),
        F.coalesce(F.when(on, F.expr("_w * ((block - 1) div _q) + _at < _until")), F.lit(False)).alias("mixed")))
