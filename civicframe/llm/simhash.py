"""SimHash near-duplicates over a Gray-order hierarchical index.

Fingerprint: each distinct place of a 4-word shingle votes with its XXH64
(seed 42); a bit is 1 if set in over half. Documents link when their
fingerprints differ in at most ``MAX_BITS`` bits; groups are the connected
components.

Index: the 64 bits are cut into 6 blocks. Two fingerprints at 4 or fewer
differing bits agree in at least two whole blocks, so each fingerprint goes
to one bucket for each of the 15 pairs of blocks, and no link is lost. The
buckets are sorted by the fingerprints' Gray rank and dealt out by range, so a
large bucket is cut into pieces of bounded size. Inside a piece, neighbours in
Gray order form nodes that keep the bits all their members share (a mask and
a pattern); nodes of nodes are built the same way. Two nodes are compared on
their shared bits only, the differences found higher up being carried down:
over the limit the whole pair of groups is pruned; if even all open bits
could not exceed the limit, all members link at once; groups already connected
need no descent. Pieces of one bucket are compared as upper nodes first (their
shared bits come from two aggregates) and only the pairs that may link are
read together.

Only the links of a spanning forest leave a task, never all pairs of a group.

Defined cases: null and empty texts have no shingle and fingerprint zero,
linked like any other; repeated rows share a fingerprint; a null doc_id takes
part and gets the component of its fingerprint, but names none, unless
all ids of the component are null (then the component id is null); empty tables
give empty results; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import aside, components, land, map_arrow, merge, utf8

SHINGLE = 4
MAX_BITS = 4
SEED = 42
BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))  # (lowest bit, width)
FAN = 8
# Node pairs expanded at once.
CHUNK = 1 << 15
VOTES_AT_ONCE = 1 << 16


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of a UTF-8 text, unsigned."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    size = min(shingle, len(words))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:len(words) - size + 1].tolist()
    ends = ends[size - 1:].tolist()
    votes = np.zeros(64, np.int64)
    h = xxhash.xxh64_intdigest
    for at in range(0, len(starts), VOTES_AT_ONCE):
        hs = np.array([h(joined[a:b], SEED) for a, b in zip(starts[at:at + VOTES_AT_ONCE], ends[at:at + VOTES_AT_ONCE])],
                      dtype="<u8")
        bits = np.unpackbits(hs.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int32)
    return int(sum(1 << i for i in np.flatnonzero(2 * votes > len(starts)).tolist()))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_hash, fp): fp the fingerprint as a signed long."""
    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(t) for t in b.column(2).to_pylist()], dtype=np.uint64)
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps.view(np.int64))], names=["doc_id", "text_hash", "fp"])
    t = utf8(text)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(t).alias("text_hash"), t.alias("t"))
    return map_arrow(src, run, "doc_id long, text_hash long, fp long")


def gray_rank(c):
    """Position of a code word in the reflected Gray order (64 bits, signed)."""
    for s in (1, 2, 4, 8, 16, 32):
        c = c.bitwiseXOR(F.shiftrightunsigned(c, s))
    return c


def _pop(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int16)


class Tree:
    """Nodes over fingerprints in Gray order: level 0 the fingerprints, each
    node above covers up to ``FAN`` nodes with the bits they all share."""

    def __init__(self, f: np.ndarray):
        self.levels = [(np.full(len(f), ~np.uint64(0)), f)]
        while len(self.levels[-1][0]) > 1:
            mask, bits = self.levels[-1]
            cut = np.arange(0, len(mask), FAN)
            # a bit is shared if all masks have it and all patterns agree
            ones = np.bitwise_and.reduceat(bits & mask, cut)
            zeros = np.bitwise_and.reduceat(~bits & mask, cut)
            self.levels.append((ones | zeros, ones))

    def top(self) -> int:
        return len(self.levels) - 1

    def members(self, level: int, node: np.ndarray, n: int):
        size = FAN ** level
        return node * size, np.minimum((node + 1) * size, n)


def link_search(f: np.ndarray, g: np.ndarray | None, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (index a, index b) that connect what is connected in f, or in f
    and g (numbered after f), at ``limit`` or fewer differing bits: a spanning
    forest, whose ends need not be neighbours themselves."""
    own = g is None
    ta, tb = Tree(f), Tree(f) if own else Tree(g)
    shift = 0 if own else len(f)
    n = len(f) + (0 if own else len(g))
    out_a, out_b, label = [], [], np.arange(n)
    zero = np.zeros(1, np.int64)
    # a stack of chunks: level of each tree, nodes, masks compared so far, differences so far
    stack = [(ta.top(), tb.top(), zero, zero, np.zeros(1, np.uint64), np.zeros(1, np.int16))]

    def link(a, b):
        nonlocal label
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
        if not len(a):
            return
        label, u, v = merge(label, a, b)
        out_a.append(u)
        out_b.append(v)

    while stack:
        la, lb, a, b, seen, diff = stack.pop()
        ma, pa_ = ta.levels[la]
        mb, pb = tb.levels[lb]
        common = ma[a] & mb[b]
        diff = diff + _pop((pa_[a] ^ pb[b]) & common & ~seen)
        may = diff <= limit
        if own and la == lb:
            may &= a <= b
        a, b, common, diff = a[may], b[may], common[may], diff[may]
        if not len(a):
            continue
        sa, ea = ta.members(la, a, len(f))
        sb, eb = tb.members(lb, b, len(f) if own else len(g))
        sb, eb = sb + shift, eb + shift
        if not la and not lb:
            link(sa, sb)
            continue
        # groups that already are one component have nothing to add
        open_ = ~((label[sa] == label[sb]) & _uniform(label, sa, ea) & _uniform(label, sb, eb))
        # even if all bits open here differed, every member would link
        sure = open_ & (diff + _pop(~common) <= limit)
        for i in np.flatnonzero(sure):
            m = np.concatenate([np.arange(sa[i], ea[i]), np.arange(sb[i], eb[i])])
            link(m[:-1], m[1:])
        open_ &= ~sure
        a, b, common, diff = a[open_], b[open_], common[open_], diff[open_]
        down_a, down_b = la >= lb and la > 0, lb >= la and lb > 0
        ka = _children(a, len(ta.levels[la - 1][0])) if down_a else a[:, None]
        kb = _children(b, len(tb.levels[lb - 1][0])) if down_b else b[:, None]
        aa = np.repeat(ka, kb.shape[1], axis=1).ravel()
        bb = np.tile(kb, (1, ka.shape[1])).ravel()
        each = ka.shape[1] * kb.shape[1]
        cc, dd = np.repeat(common, each), np.repeat(diff, each)
        ok = (aa >= 0) & (bb >= 0)
        aa, bb, cc, dd = aa[ok], bb[ok], cc[ok], dd[ok]
        for at in range(0, len(aa), CHUNK):
            s = slice(at, at + CHUNK)
            stack.append((la - down_a, lb - down_b, aa[s], bb[s], cc[s], dd[s]))
    if not out_a:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(out_a), np.concatenate(out_b)


def _children(node: np.ndarray, n: int) -> np.ndarray:
    kids = node[:, None] * FAN + np.arange(FAN)
    return np.where(kids < n, kids, -1)


def _uniform(label: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whether all of label[start:end] are equal, for each range."""
    steps = np.concatenate(([0], np.cumsum(label[1:] != label[:-1])))
    return steps[end - 1] == steps[start]


def _bucket_links(fp: np.ndarray, bucket: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside the buckets of a piece sorted by (bucket, Gray rank)."""
    cut = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
    size = np.diff(np.append(cut, len(bucket)))
    a, b = [], []
    # pairs: one comparison of all buckets at once
    two = cut[size == 2]
    near = two[_pop(fp[two] ^ fp[two + 1]) <= limit]
    a.append(fp[near])
    b.append(fp[near + 1])
    for s, n in zip(cut[size > 2].tolist(), size[size > 2].tolist()):
        f = fp[s:s + n]
        i, j = link_search(f, None, limit)
        a.append(f[i])
        b.append(f[j])
    return np.concatenate(a), np.concatenate(b)


def links(fps: DataFrame, limit: int = MAX_BITS) -> DataFrame:
    """Spanning links (a, b) between the distinct fingerprints of ``fps``
    (column fp) at ``limit`` (at most 4) or fewer differing bits."""
    if limit > len(BLOCKS) - 2:
        raise ValueError("the 6 blocks find links of at most 4 differing bits")
    fp = F.col("fp")
    cuts = [F.shiftrightunsigned(fp, lo).bitwiseAND(F.lit((1 << w) - 1).cast("long")) for lo, w in BLOCKS]
    keys = [F.shiftleft(F.lit(t).cast("long"), 24).bitwiseOR(F.shiftleft(cuts[i], 11)).bitwiseOR(cuts[j])
            for t, (i, j) in enumerate(combinations(range(len(BLOCKS)), 2))]
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    entries = (fps.select("fp").distinct().select("fp", gray_rank(fp).alias("gray"), F.explode(F.array(*keys)).alias("bucket"))
               .repartitionByRange(n, "bucket", "gray").sortWithinPartitions("bucket", "gray").select("bucket", "fp"))

    def inside(batches):
        """Links inside this piece's buckets (kind 0), and the fingerprints of
        its first and last bucket, which may go on in other pieces (kind 1)."""
        piece = TaskContext.get().partitionId()
        held_b, held_f = np.empty(0, np.int64), np.empty(0, np.int64)
        first = True
        for b in batches:
            held_b = np.concatenate([held_b, np.asarray(b.column(0))])
            held_f = np.concatenate([held_f, np.asarray(b.column(1))])
            cut = np.searchsorted(held_b, held_b[-1]) if len(held_b) else 0
            if cut:
                if first:
                    yield _ends(held_b, held_f, held_b[:cut] == held_b[0], piece)
                    first = False
                yield _links_batch(held_b[:cut], held_f[:cut].view(np.uint64), limit, piece)
                held_b, held_f = held_b[cut:], held_f[cut:]
        if len(held_b):
            yield _ends(held_b, held_f, np.ones(len(held_b), bool), piece)
            yield _links_batch(held_b, held_f.view(np.uint64), limit, piece)

    found = land(entries.mapInArrow(inside, "kind int, bucket long, piece int, a long, b long"), "gray")

    # Upper nodes: a bucket's part in each piece. Two pieces are read together
    # only if their shared bits differ in at most the limit.
    ends = found.where("kind = 1").select("bucket", "piece", F.col("a").alias("fp"))
    nodes = (ends.groupBy("bucket", "piece")
             .agg(F.bit_and("fp").alias("ones"), F.bit_and(F.bitwise_not("fp")).alias("zeros")))
    x, y = nodes.alias("x"), nodes.alias("y")
    clash = F.col("x.ones").bitwiseAND(F.col("y.zeros")).bitwiseOR(F.col("x.zeros").bitwiseAND(F.col("y.ones")))
    sides = (x.join(y, (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.piece") < F.col("y.piece")))
             .where(F.bit_count(clash) <= limit)
             .select(F.col("x.bucket").alias("bucket"), F.col("x.piece").alias("p"), F.col("y.piece").alias("q"))
             .select("bucket", "p", "q", F.explode(F.array("p", "q")).alias("piece")))

    def across(df: pd.DataFrame) -> pd.DataFrame:
        f, left = df.fp.to_numpy().view(np.uint64), (df.piece == df.p).to_numpy()
        u, v = _by_gray(f[left]), _by_gray(f[~left])
        i, j = link_search(u, v, limit)
        w = np.concatenate([u, v]).view(np.int64)
        return pd.DataFrame({"a": w[i], "b": w[j]})

    crossing = ends.join(sides, ["bucket", "piece"]).groupBy("bucket", "p", "q").applyInPandas(across, "a long, b long")
    return (found.where("kind = 0").select("a", "b").union(crossing)
            .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())


def _ends(bucket: np.ndarray, fp: np.ndarray, which: np.ndarray, piece: int) -> pa.RecordBatch:
    which = np.flatnonzero(which)
    return _found(1, bucket[which], piece, fp[which], fp[which])


def _links_batch(bucket: np.ndarray, fp: np.ndarray, limit: int, piece: int) -> pa.RecordBatch:
    a, b = _bucket_links(fp, bucket, limit)
    return _found(0, np.zeros(len(a), np.int64), piece, a.view(np.int64), b.view(np.int64))


def _found(kind: int, bucket: np.ndarray, piece: int, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    n = len(bucket)
    cols = [np.full(n, kind, np.int32), bucket, np.full(n, piece, np.int32), a, b]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["kind", "bucket", "piece", "a", "b"])


def _gray(f: np.ndarray) -> np.ndarray:
    f = f.copy()
    for s in (1, 2, 4, 8, 16, 32):
        f ^= f >> np.uint64(s)
    return f


def _by_gray(f: np.ndarray) -> np.ndarray:
    return f[np.argsort(_gray(f))]


def groups(docs: DataFrame, limit: int = MAX_BITS, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``."""
    f = land(fingerprints(docs, id_col, text).select("doc_id", "fp"), "fps")
    reps = f.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    comp = components(links(reps, limit)).withColumnRenamed("node", "fp")
    named = reps.join(comp, "fp", "left").withColumn("comp", F.coalesce("comp", "fp"))
    lows = named.groupBy("comp").agg(F.min("rep").alias("component_id"))
    return f.join(named.join(lows, "comp").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame, limit: int = MAX_BITS, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id): one row per row of ``docs``."""
    g = groups(docs, limit, id_col, text)
    return g.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, limit: int = MAX_BITS) -> DataFrame:
    """One row of each group: the smallest doc_id (null only if all ids of the
    group are null), then the smallest text hash. Of rows equal in both the one
    with the smallest hash of the other columns (as JSON) stays. Columns of any
    type and name are kept; texts of any length are read whole."""
    columns = docs.columns
    docs, given_back = aside(docs, ["_keep", "_kept_hash", "_hash", "_row", "_rn"])
    f = land(fingerprints(docs), "fps")
    reps = f.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash")).alias("rep"))
    reps = land(reps, "reps")
    comp = components(links(reps, limit)).withColumnRenamed("node", "fp")
    # a doc_id and text have one fingerprint, so a pair names one group only
    keep = (reps.join(comp, "fp", "left").groupBy(F.coalesce("comp", "fp").alias("comp")).agg(F.min("rep").alias("rep"))
            .select(F.col("rep.doc_id").alias("_keep"), F.col("rep.text_hash").alias("_kept_hash")))
    rest = [c for c in docs.columns if c != "doc_id"]
    as_text = F.to_json(F.struct(*(F.col(c) for c in rest))) if rest else F.lit("")
    w = Window.partitionBy("doc_id", "_hash").orderBy("_row")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_keep")) & (F.col("_hash") == F.col("_kept_hash"))
    kept = (docs.withColumn("_hash", F.xxhash64(utf8("text"))).join(keep, same, "left_semi").withColumn("_row", F.sha2(as_text, 256))
            .withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_hash", "_row"))
    return given_back(kept).select(*columns)
