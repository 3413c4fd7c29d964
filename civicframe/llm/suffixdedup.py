"""Suffix-array dedup: remove every byte covered by a long repeated string.

A string of ``LENGTH`` bytes that starts at two places (of one or two texts)
is removed at both. Matches never cross texts.

1. Places that could share such a string are found by minimisers: of every
   ``SPAN`` consecutive ``GRAM``-byte strings those with the smallest hash are
   anchors. Two equal strings of ``LENGTH`` bytes hold an anchor at the same
   offset, so they meet in the anchor's group (its gram hash). Grams are
   counted with partial aggregates.
2. An anchor's context is all bytes that a ``LENGTH``-byte string around the
   gram can reach. Contexts that occur twice are repeated whole. The others
   are compared within their group: only distinct contexts of groups with
   several contexts are shuffled with their bytes.
3. In a task the contexts' right parts, as symbols of 25 bytes, form one
   text, whose suffix array is built by linear grouping (``gsaca``). Its order
   gives every context's longest right match as a range minimum; walking left
   byte by byte splits each group into classes of equal left bytes, and a
   string that goes t bytes left is repeated if t bytes plus the longest right
   match in the class reach ``LENGTH``.
   Groups with more than ``HOT`` distinct contexts (about 0.3 GB in a task) are
   counted string by string instead (``_strings``), with partial aggregates,
   so that no group is gathered in one task whatever its size.
4. The repeated strings' places return to their texts. Only texts that may have
   some are shuffled, compressed; the others are done where they are read.

The suffix array over symbols, not over bytes of whole texts: linear grouping
is a sequential algorithm, and at 6 to 10 microseconds a symbol in Python it
would take 7 to 10 times the CPU allowed if each byte of the corpus were a symbol.
Steps 1 and 2 leave it the contexts that a hash cannot decide.

Repeated grams are marked in bit maps of fixed size, which are broadcast: the
second pass emits only anchors whose bit is set. A false positive costs a row
(or sends a group the other, equally exact, way) and changes nothing.

Defined cases: null and empty texts, and texts shorter than ``LENGTH``, keep
all bytes; equal texts (also repeated rows, whatever their ids) of at least ``LENGTH`` bytes are removed
whole; an empty table gives an empty result; texts of any length are read whole; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import land, utf8
from .gsaca import suffix_array

LENGTH = 200
GRAM = 50
SPAN = LENGTH - GRAM + 1      # gram starts within a string; 151
LEFT = SPAN - 1               # bytes a string can reach left of an anchor
RIGHT = LENGTH - GRAM         # and right of its gram
PIECE = 25                    # bytes of a symbol
HOT = 100_000                 # distinct contexts of a group compared in one task
BITS = 26                     # log2 of the bits of a map (8 MB)
CHUNK = 17                    # log2 of the bytes of a map's chunk
BUFFER = 1 << 18              # bytes hashed at once
ROWS = 20_000                 # contexts of one suffix array, about
BATCH_ROWS = 500              # texts of an Arrow batch

BASE = np.uint64(0x9E3779B97F4A7C15)
BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def _slide(x: np.ndarray, width: int, fn, fill) -> np.ndarray:
    """fn over every ``width`` consecutive values."""
    n = len(x)
    y = np.full(-(-n // width) * width, fill, np.uint64)
    y[:n] = x
    y = y.reshape(-1, width)
    up = fn.accumulate(y, axis=1).ravel()
    down = np.ascontiguousarray(fn.accumulate(y[:, ::-1], axis=1)[:, ::-1]).ravel()
    return fn(down[:n - width + 1], up[width - 1:n])


class Powers:
    """Powers of the hash base and of its inverse."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, n: int):
        if len(self.up) < n:
            size = max(n, 2 * BUFFER)
            self.up, self.down = np.full(size, BASE), np.full(size, BACK)
            self.up[0] = self.down[0] = 1
            self.up, self.down = np.cumprod(self.up), np.cumprod(self.down)
        return self.up, self.down


def anchors(texts: list[bytes], powers: Powers):
    """(text number, place, gram hash, context hash) of all anchors."""
    buf = np.frombuffer(b"".join(texts), np.uint8)
    n = len(buf)
    sizes = np.array([len(t) for t in texts])
    start = np.cumsum(sizes) - sizes
    up, down = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((buf + np.uint64(1)) * up[:n], out=total[1:])
    h = _mix((total[GRAM:] - total[:-GRAM]) * down[:n - GRAM + 1])
    text = np.repeat(np.arange(len(texts)), sizes)
    inside = text[:n - GRAM + 1] == text[GRAM - 1:]
    # an anchor is smallest in some run of SPAN grams that lies in one text
    low = _slide(np.where(inside, h, TOP), SPAN, np.minimum, TOP)
    whole = text[:len(low)] == text[LENGTH - 1:]
    low = np.where(whole, low, np.uint64(0))
    edge = np.zeros(SPAN - 1, np.uint64)
    high = _slide(np.concatenate([edge, low, edge]), SPAN, np.maximum, np.uint64(0))
    at = np.flatnonzero((high == h) & inside & (h > 0))
    of = text[at]
    a = np.maximum(at - LEFT, start[of])
    b = np.minimum(at + LENGTH, start[of] + sizes[of])
    c = _mix((total[b] - total[a]) * down[a]) ^ _mix(((at - a) << 20 | (b - at)).astype(np.uint64))
    return of, at - start[of], h[at].view(np.int64), c.view(np.int64)


def _batches(texts: pa.Array):
    """(numbers, texts) of those of LENGTH or more bytes, about BUFFER bytes at
    a time; the others are not taken out of the Arrow batch."""
    held, size = [], 0
    for i, n in enumerate(pc.binary_length(texts).to_pylist()):
        if n >= LENGTH:
            held.append(i)
            size += n
            if size >= BUFFER:
                yield held, texts.take(pa.array(held)).to_pylist()
                held, size = [], 0
    if held:
        yield held, texts.take(pa.array(held)).to_pylist()


@contextmanager
def small_batches(spark, rows: int = BATCH_ROWS):
    """Arrow batches of few rows while a job runs: texts may be long, and a
    batch stands in the JVM's and in the worker's memory at once."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(name)
    spark.conf.set(name, min(rows, int(old)) if int(old) > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(name, old)


def gram_counts(docs: DataFrame) -> DataFrame:
    """(g, n, lo, hi): occurrences of each gram, its smallest and largest context hash."""
    def run(batches):
        powers = Powers()
        for b in batches:
            for _, texts in _batches(b.column(0)):
                _, _, g, c = anchors(texts, powers)
                yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(c)], names=["g", "c"])
    return (docs.select("t").mapInArrow(run, "g long, c long").groupBy("g")
            .agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("lo"), F.max("c").alias("hi")))


def bit_map(grams: DataFrame) -> np.ndarray:
    """Fixed-size bit map of the grams' low bits, as bytes. At most 2^BITS
    distinct bits are gathered, 2^(CHUNK + 3) in a group."""
    def pack(t: pa.Table) -> pa.Table:
        bits = np.asarray(t["bit"])
        m = np.zeros(1 << (CHUNK + 3), np.uint8)
        m[bits & (len(m) - 1)] = 1
        return pa.table({"chunk": pa.array([int(bits[0] >> (CHUNK + 3))], pa.int32()),
                         "bits": pa.array([np.packbits(m, bitorder="little").tobytes()], pa.binary())})
    bit = F.col("g").bitwiseAND(F.lit((1 << BITS) - 1)).cast("int")
    rows = (grams.select(bit.alias("bit")).distinct().groupBy(F.shiftright("bit", CHUNK + 3).alias("chunk"))
            .applyInArrow(pack, "chunk int, bits binary").collect())
    out = np.zeros(1 << (BITS - 3), np.uint8)
    for r in rows:
        out[r["chunk"] << CHUNK:(r["chunk"] + 1) << CHUNK] = np.frombuffer(r["bits"], np.uint8)
    return out


def _set(bits: np.ndarray, g: np.ndarray) -> np.ndarray:
    low = g & ((1 << BITS) - 1)
    return (bits[low >> 3] >> (low & 7).astype(np.uint8) & 1).astype(bool)


PLACES = "k1 long, k2 long, p long, g long, c long, n long, left binary, right binary"


def places(docs: DataFrame, repeated: np.ndarray, mixed: np.ndarray) -> DataFrame:
    """Rows of two kinds for anchors whose gram is marked: places (k1, k2 the
    text's key, p, g, c; of equal texts in a task one's), and the contexts of
    mixed grams: (g, c, n: how often, left bytes reversed, bytes right of the
    gram). A context's bytes leave a task once; later ones are only counted."""
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast((repeated, mixed))

    def place_rows(k1, k2, p, g, c):
        none = pa.nulls(len(p), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(k1), pa.array(k2), pa.array(p), pa.array(g), pa.array(c),
                                           pa.nulls(len(p), pa.int64()), none, none], names=_names(PLACES))

    def context_rows(gc, n, left, right):
        zero = pa.nulls(len(n), pa.int64())
        return pa.RecordBatch.from_arrays([zero, zero, zero, pa.array(gc[:, 0]), pa.array(gc[:, 1]), pa.array(n),
                                           pa.array(left, pa.binary()), pa.array(right, pa.binary())], names=_names(PLACES))

    def run(batches):
        rep, mix = shared.value
        powers = Powers()
        met: set[tuple[int, int]] = set()
        more: dict[tuple[int, int], int] = {}
        for b in batches:
            k1, k2 = np.asarray(b.column(0)), np.asarray(b.column(1))
            for some, own in _batches(b.column(2)):
                of, p, g, c = anchors(own, powers)
                keep = _set(rep, g)
                of, p, g, c = of[keep], p[keep], g[keep], c[keep]
                rows = np.array(some)
                new = np.zeros(len(rows), bool)
                for i, key in enumerate(zip(k1[rows].tolist(), k2[rows].tolist())):
                    if key not in met:
                        met.add(key)
                        new[i] = True
                first = np.flatnonzero(new[of])
                rows = rows[of[first]]
                yield place_rows(k1[rows], k2[rows], p[first], g[first], c[first])
                wanted = np.flatnonzero(_set(mix, g))
                if not len(wanted):
                    continue
                gc, first, n = np.unique(np.stack([g[wanted], c[wanted]], 1), axis=0, return_index=True, return_counts=True)
                fresh, left, right = [], [], []
                for k, (key, i, m) in enumerate(zip(map(tuple, gc.tolist()), wanted[first].tolist(), n.tolist())):
                    if key in more:
                        more[key] += m
                        continue
                    more[key] = 0
                    fresh.append(k)
                    t, at = own[of[i]], int(p[i])
                    left.append(t[max(0, at - LEFT):at][::-1])
                    right.append(t[at + GRAM:at + LENGTH])
                if fresh:
                    yield context_rows(gc[fresh], n[fresh].astype(np.int64), left, right)
        again = [(g, c, n) for (g, c), n in more.items() if n]
        if again:
            t = np.array(again, np.int64)
            yield context_rows(t[:, :2], np.ascontiguousarray(t[:, 2]), [None] * len(t), [None] * len(t))
    return docs.select("k1", "k2", "t").mapInArrow(run, PLACES)


def marked(rows: DataFrame, key: str, bits: np.ndarray, wanted: bool) -> DataFrame:
    """Rows whose key's bit is set, or is not."""
    shared = rows.sparkSession.sparkContext.broadcast(bits)

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(_set(shared.value, np.asarray(b.column(key))) == wanted))
    return rows.mapInArrow(run, rows.schema)


def _names(ddl: str) -> list[str]:
    return [x.split()[0] for x in ddl.split(", ")]


def _matrix(parts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes plus one, 0 beyond the end; and the lengths."""
    size = np.array([len(x) for x in parts], np.int64)
    out = np.zeros((len(parts), width), np.uint16)
    flat = np.frombuffer(b"".join(parts), np.uint8)
    row = np.repeat(np.arange(len(parts)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat + np.uint16(1)
    return out, size


def repeated_strings(g: np.ndarray, left: list[bytes], right: list[bytes]) -> np.ndarray:
    """For distinct contexts of grams g (sorted): (rows, SPAN) flags, whether
    the string that goes t bytes left of the anchor occurs in another context."""
    n = len(g)
    lm, _ = _matrix(left, LEFT)
    rm, rsize = _matrix(right, RIGHT)
    # symbols: a gram's number, then the ranks of its right part's pieces
    pieces = -(-RIGHT // PIECE)
    wide = np.zeros((n, pieces * PIECE), ">u2")
    wide[:, :RIGHT] = rm
    words = np.ascontiguousarray(wide).reshape(n * pieces, PIECE).view(f"S{2 * PIECE}").ravel()
    rank = np.unique(words, return_inverse=True)[1].reshape(n, pieces)
    number = np.cumsum(np.concatenate(([0], g[1:] != g[:-1])))
    text = np.empty((n, pieces + 1), np.int64)
    text[:, 1:] = rank + 1
    text[:, 0] = number + rank.max() + 2
    sa = np.array(suffix_array(np.append(text.ravel(), 0)))
    row = sa[sa % (pieces + 1) == 0] // (pieces + 1)
    row = row[row < n]
    g, lm, rm, rsize = g[row], lm[row], rm[row], rsize[row]
    # longest right match of neighbours, in bytes from the anchor
    differs = rm[1:] != rm[:-1]
    match = np.where(differs.any(1), differs.argmax(1), RIGHT)
    match = GRAM + np.minimum(match, np.minimum(rsize[1:], rsize[:-1]))
    match = np.where(g[1:] == g[:-1], match, 0)
    table = [match]
    while 1 << len(table) <= len(match):
        half = 1 << (len(table) - 1)
        table.append(np.minimum(table[-1][:-half], table[-1][half:]))
    flags = np.zeros((n, SPAN), bool)
    at = np.arange(n)
    cls = np.cumsum(np.concatenate(([0], g[1:] != g[:-1])))
    for t in range(SPAN):
        if t:
            byte = lm[at, t - 1].astype(np.int64)
            has = byte > 0
            at, key = at[has], cls[has] * 257 + byte[has]
            order = np.argsort(key, kind="stable")
            at, key = at[order], key[order]
            cls = np.cumsum(np.concatenate(([0], key[1:] != key[:-1]))) if len(key) else key
        if len(at) < 2:
            break
        same = cls[1:] == cls[:-1]
        near = np.zeros(len(at) - 1, np.int64)
        u, v = at[:-1][same], at[1:][same]
        near[same] = _lowest(table, u, v)
        best = np.maximum(np.concatenate(([0], near)), np.concatenate((near, [0])))
        flags[at, t] = t + best >= LENGTH
        mate = np.concatenate(([False], same)) | np.concatenate((same, [False]))
        at, cls = at[mate], cls[mate]
    out = np.empty_like(flags)
    out[row] = flags
    return out


def _lowest(table: list[np.ndarray], u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Smallest match between neighbours u..v (u < v)."""
    width = v - u
    level = np.frexp(width.astype(float))[1] - 1
    out = np.empty(len(u), np.int64)
    for k in np.unique(level).tolist():
        s = level == k
        out[s] = np.minimum(table[k][u[s]], table[k][v[s] - (1 << k)])
    return out


STRINGS = "g long, c long, strings binary"


def _compared(contexts: DataFrame) -> DataFrame:
    """(g, c, strings): a bit per t; null strings: all. Contexts that occur
    twice are all repeated, the others as ``repeated_strings`` says."""
    def run(batches):
        held: list = []

        def flush(parts):
            t = pa.Table.from_batches(parts)
            g, c, n = (np.asarray(t[x]) for x in ("g", "c", "n"))
            bare = np.asarray(t["left"].is_null())
            order = np.lexsort((bare, c, g))  # of equal contexts one with its bytes first
            g, c, n = g[order], c[order], n[order]
            new = np.concatenate(([True], (g[1:] != g[:-1]) | (c[1:] != c[:-1])))
            first = np.flatnonzero(new)
            times = np.add.reduceat(n, first)
            g, c, pick = g[first], c[first], order[first]
            left, right = (t[x].take(pa.array(pick)).to_pylist() for x in ("left", "right"))
            flags = repeated_strings(g, left, right)
            some = (times > 1) | flags.any(1)
            bits = [None if m > 1 else x.tobytes() for m, x in zip(times[some].tolist(), np.packbits(flags[some], axis=1))]
            return pa.RecordBatch.from_arrays([pa.array(g[some]), pa.array(c[some]), pa.array(bits, pa.binary())],
                                              names=["g", "c", "strings"])
        size = 0
        for b in batches:
            # rows come sorted by g: cut between groups
            g = np.asarray(b.column("g"))
            if size >= ROWS:
                last = held[-1].column("g")[-1].as_py()
                cut = int(np.searchsorted(g, last, side="right"))
                if cut < len(g):
                    held.append(b.slice(0, cut))
                    yield flush(held)
                    held, size, b = [], 0, b.slice(cut)
            held.append(b)
            size += b.num_rows
        if held:
            yield flush(held)
    return (contexts.select("g", "c", "n", "left", "right").repartition("g").sortWithinPartitions("g")
            .mapInArrow(run, STRINGS))


def _strings(contexts: DataFrame) -> DataFrame:
    """The same for groups of any size: each string's hash is counted."""
    def run(batches):
        for b in batches:
            g, c, n = (np.asarray(b.column(x)) for x in ("g", "c", "n"))
            rows, ts, hs = [], [], []
            for i, (left, right) in enumerate(zip(b.column("left").to_pylist(), b.column("right").to_pylist())):
                whole = left[::-1] + b"\0" * GRAM + right
                for t in range(max(0, RIGHT - len(right)), min(LEFT, len(left)) + 1):
                    rows.append(i)
                    ts.append(t)
                    d = hashlib.blake2b(whole[len(left) - t:len(left) - t + LENGTH], digest_size=16, salt=b"%d" % t).digest()
                    hs.append(d)
            yield pa.RecordBatch.from_arrays([pa.array(g[rows]), pa.array(c[rows]), pa.array(n[rows]), pa.array(ts, pa.int32()),
                                              pa.array(hs, pa.binary())], names=["g", "c", "n", "t", "h"])
    each = (contexts.groupBy("g", "c").agg(F.sum("n").alias("n"), F.first("left", ignorenulls=True).alias("left"),
                                          F.first("right", ignorenulls=True).alias("right"))
            .mapInArrow(run, "g long, c long, n long, t int, h binary"))
    shared = each.groupBy("g", "h").agg(F.sum("n").alias("all")).where("all > 1")
    hit = each.join(shared, ["g", "h"]).groupBy("g", "c").agg(F.collect_set("t").alias("ts"), F.max("n").alias("n"))

    def pack(batches):
        for b in batches:
            out = []
            for ts, n in zip(b.column("ts").to_pylist(), b.column("n").to_pylist()):
                m = np.zeros(SPAN, bool)
                m[ts] = True
                out.append(None if n > 1 else np.packbits(m).tobytes())
            yield pa.RecordBatch.from_arrays([b.column("g"), b.column("c"), pa.array(out, pa.binary())], names=["g", "c", "strings"])
    return hit.select("g", "c", "ts", "n").mapInArrow(pack, STRINGS)


def removed(n: int, places, strings) -> np.ndarray:
    """Flags of the bytes of a text of n bytes covered by repeated strings."""
    diff = np.zeros(n + 1, np.int64)
    for p, s in zip(places, strings):
        t = np.flatnonzero(np.unpackbits(np.frombuffer(s, np.uint8))[:SPAN]) if s is not None else np.arange(SPAN)
        a = p - t
        a = a[(a >= 0) & (a + LENGTH <= n)]
        np.add.at(diff, a, 1)
        np.add.at(diff, a + LENGTH, -1)
    return np.cumsum(diff[:-1]) > 0


def dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", keep_text: bool = False, hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) per row of ``docs``,
    and ``kept`` (binary), the bytes that stay, if ``keep_text``."""
    t = utf8(text)
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(t).alias("k1"),
                        F.xxhash64(F.lit(1), t, F.length(t)).alias("k2"), t.alias("t"))
    with small_batches(docs.sparkSession):
        grams = land(gram_counts(keyed).where("n > 1"), "grams")
        mixed = grams.where("lo <> hi")
        found = land(places(keyed, bit_map(grams), bit_map(mixed)), "places", compression="zstd")
    places_of, contexts = found.where("k1 is not null").select("k1", "k2", "p", "g", "c"), found.where("k1 is null")
    contexts = contexts.select("g", "c", "n", "left", "right")

    # groups of very many contexts apart; a whole group always goes one way
    large = bit_map(contexts.groupBy("g").agg(F.count_distinct("c").alias("m")).where(F.col("m") > hot))
    small, big = marked(contexts, "g", large, False), marked(contexts, "g", large, True)
    one = grams.where("lo = hi").select("g", F.col("lo").alias("c"), F.lit(None).cast("binary").alias("strings"))
    hits = one.union(_compared(small)).union(_strings(big))

    # few rows repeat a place by now (one text's in each task), so one exchange serves both groupings
    marks = (places_of.join(hits, ["g", "c"]).repartition("k1", "k2").groupBy("k1", "k2", "p").agg(F.first("strings").alias("strings"))
             .groupBy("k1", "k2").agg(F.collect_list(F.struct("p", "strings")).alias("marks")))
    marks = land(marks, "marks", compression="zstd")
    bits = bit_map(marks.select(F.col("k1").alias("g")))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    names = _names(schema)

    def result(ids, rows):
        cols = list(zip(*rows))
        types = [pa.int64()] * 3 + [pa.string(), pa.binary()]
        return pa.RecordBatch.from_arrays([ids, *(pa.array(c, y) for c, y in zip(cols, types))], names=names)

    def clean(batches):
        for b in batches:
            if b.num_rows:
                yield result(b.column("doc_id"), [(len(x), 0, 0, hashlib.sha256(x).hexdigest(), x if keep_text else None)
                                                  for x in b.column("t").to_pylist()])

    def pack(batches):
        zip_ = zstandard.ZstdCompressor(level=3)
        for b in batches:
            z = pa.array([zip_.compress(x) for x in b.column("t").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("k1"), b.column("k2"), z], names=["doc_id", "k1", "k2", "z"])

    def cut(batches):
        unzip = zstandard.ZstdDecompressor()
        for b in batches:
            rows = []
            for z, m in zip(b.column("z").to_pylist(), b.column("marks").to_pylist()):
                x = unzip.decompress(z)
                gone = removed(len(x), [y["p"] for y in m or ()], [y["strings"] for y in m or ()])
                kept = np.frombuffer(x, np.uint8)[~gone].tobytes()
                rows.append((len(x), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + gone[:1].sum()),
                             hashlib.sha256(kept).hexdigest(), kept if keep_text else None))
            if rows:
                yield result(b.column("doc_id"), rows)
    texts = marked(keyed, "k1", bits, True).mapInArrow(pack, "doc_id long, k1 long, k2 long, z binary")
    both = texts.join(marks, ["k1", "k2"], "left").select("doc_id", "z", "marks")
    out = marked(keyed, "k1", bits, False).mapInArrow(clean, schema).union(both.mapInArrow(cut, schema))
    return out if keep_text else out.drop("kept")
