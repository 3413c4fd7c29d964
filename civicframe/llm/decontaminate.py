"""Benchmark decontamination: one Aho-Corasick automaton over the normalised
test items, each text scanned once, offsets mapped back to the original.

Defined cases: a null or empty text has no words and hits nothing; a null or
wordless item has no window; repeated items and rows give the same answers
again; an item without an id marks words but is not listed; an empty benchmark
leaves every document clean; texts of any length are scanned whole. ``scan``
keeps extra columns and replaces those that have the names of its own;
``drop_contaminated`` keeps all columns and their values.
"""

from __future__ import annotations

import hashlib
import re
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import aside, land, utf8, words_of

WINDOW = 10
# Bytes of item text per automaton (about 60 bytes of memory for each byte in the
# worst case). More items mean more passes, each with an automaton of this
# size; nothing is left out.
BLOCK_BYTES = 8 << 20
PAIR_BITS = 20    # of a bit map of neighbouring words; a false one costs a scan
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
RESULT = ("n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, "
          "hit_spans array<struct<start:int,end:int>>, items array<long>")
STATE = "_words array<int>, _items array<long>"


class Windows:
    """The items' windows as one automaton over word numbers: a window is a
    sequence of at most ``window`` symbols, whatever the length of its words."""

    def __init__(self, items, window: int):
        import ahocorasick
        self.number: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set] = {}
        for item_id, text in items:
            w = [self.number.setdefault(x, len(self.number) + 1) for x in words_of(text)]
            n = min(window, len(w))
            for i in range(len(w) - n + 1 if n else 0):
                ids = found.setdefault(tuple(w[i:i + n]), set())
                if item_id is not None:
                    ids.add(item_id)
        #: windows of one word are looked up, longer ones scanned for
        self.single = {k[0]: ids for k, ids in found.items() if len(k) == 1}
        longer = {k: ids for k, ids in found.items() if len(k) > 1}
        self.least = min(map(len, longer), default=0)
        self.auto = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        self.pairs = np.zeros(1 << PAIR_BITS, bool)
        for k, ids in longer.items():
            self.auto.add_word(k, (len(k), ids))
            w = np.array(k)
            self.pairs[self.pair(w[:-1], w[1:])] = True
        if longer:
            self.auto.make_automaton()

    @staticmethod
    def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return ((a * 0x9E3779B1 + b) & 0xFFFFFFFF) * 0x85EBCA6B >> 7 & ((1 << PAIR_BITS) - 1)

    def find(self, words: list[bytes]) -> tuple[np.ndarray, set]:
        """Indexes of the hit words and the ids of the items found. The
        automaton runs over stretches in which every two neighbours may be neighbours in some window."""
        ids: set = set()
        mark = np.zeros(len(words) + 1, np.int32)
        w = np.fromiter(map(self.number.get, words, repeat(0)), np.int64, len(words))
        if self.single:
            for i in np.flatnonzero(np.isin(w, list(self.single))).tolist():
                mark[i] += 1
                mark[i + 1] -= 1
                ids |= self.single[int(w[i])]
        if self.least and len(w) >= self.least:
            known = self.pairs[self.pair(w[:-1], w[1:])] & (w[:-1] > 0) & (w[1:] > 0)
            edge = np.flatnonzero(np.diff(np.concatenate([[0], known.astype(np.int8), [0]])))
            for start, stop in zip(edge[::2].tolist(), edge[1::2].tolist()):
                if stop - start + 1 < self.least:
                    continue
                for end, (n, found) in self.auto.iter(tuple(w[start:stop + 1].tolist())):
                    mark[start + end - n + 1] += 1
                    mark[start + end + 1] -= 1
                    ids |= found
        return np.flatnonzero(np.cumsum(mark)).astype(np.int32), ids


def word_spans(text: bytes, hit: list[int]) -> list[dict]:
    """Runs of hit words as code point spans of the original text."""
    if not len(hit):
        return []
    at = [m.span() for m in WORD.finditer(re.sub("[A-Z]+", lambda m: m[0].lower(), text.decode("utf-8", "replace")))]
    out: list[dict] = []
    before = None
    for i in hit:
        if before is not None and i == before + 1:
            out[-1]["end"] = at[i][1]
        else:
            out.append({"start": at[i][0], "end": at[i][1]})
        before = i
    return out


def scan(docs: DataFrame, items: DataFrame, window: int = WINDOW, text: str = "text", item_id: str = "item_id",
         item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with the columns of ``RESULT`` added.

    The items' size is measured first; they are cut into blocks of at most
    about ``block_bytes`` and each block is one automaton. One block (the
    usual case) is a single pass without a shuffle. With more, each pass adds
    its hits to two columns and is written to the shared folder.
    """
    spark = docs.sparkSession
    items = items.select(F.col(item_id).cast("long").alias("id"), utf8(item_text).alias("t"))
    size = items.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = -(-size // block_bytes) or 1
    kept = [c for c in docs.columns if c not in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated",
                                                 "hit_spans", "items")]
    cur = docs.select(*kept, F.array().cast("array<int>").alias("_words"), F.array().cast("array<long>").alias("_items"))
    for k in range(blocks):
        part = items.where(F.pmod(F.xxhash64("t"), F.lit(blocks)) == k) if blocks > 1 else items
        windows = spark.sparkContext.broadcast([(r["id"], bytes(r["t"])) for r in part.distinct().collect()])
        last = k == blocks - 1
        schema = T.StructType([*cur.select(*kept).schema, *T.StructType.fromDDL(RESULT if last else STATE)])
        cur = _pass(cur, windows, kept, schema, window, text, last)
        if not last:
            cur = land(cur, "decontam")
    return cur


def _pass(cur: DataFrame, shared, kept: list[str], schema: T.StructType, window: int, text: str, last: bool) -> DataFrame:
    def run(batches):
        auto = Windows(shared.value, window)
        for b in batches:
            words, found, rows = [], [], []
            texts = b.column(text).cast(pa.binary())
            for t, w0, i0 in zip(texts.to_pylist(), b.column("_words").to_pylist(), b.column("_items").to_pylist()):
                t = t or b""
                own = words_of(t)
                hit, ids = auto.find(own)
                if w0:
                    hit = np.union1d(hit, np.array(w0, np.int32))
                ids = ids | set(i0)
                if not last:
                    words.append(hit.tolist())
                    found.append(sorted(ids))
                    continue
                named = ",".join(sorted(map(str, ids)))
                rows.append({"n_words": len(own), "n_hit": len(hit), "n_items": len(ids),
                             "items_sha256": hashlib.sha256(named.encode()).hexdigest(), "contaminated": len(hit) > 0,
                             "hit_spans": word_spans(t, hit.tolist()), "items": sorted(ids)})
            if last:
                span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
                types = {"n_words": pa.int64(), "n_hit": pa.int64(), "n_items": pa.int64(), "items_sha256": pa.string(),
                         "contaminated": pa.bool_(), "hit_spans": span, "items": pa.list_(pa.int64())}
                added = {k: pa.array([r[k] for r in rows], t) for k, t in types.items()}
            else:
                added = {"_words": pa.array(words, pa.list_(pa.int32())), "_items": pa.array(found, pa.list_(pa.int64()))}
            names = [*kept, *added]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *added.values()], names=names)
    return cur.mapInArrow(run, schema)


def drop_contaminated(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """The documents no item window occurs in, with their own columns."""
    own = [f.name for f in T.StructType.fromDDL(f"{RESULT}, {STATE}")]
    hidden, given_back = aside(docs, own)
    clean = scan(hidden, items, **how).where("not contaminated").select(*hidden.columns)
    return given_back(clean).select(*docs.columns)
