"""Quality classifier by importance resampling.

Hashed n-gram generative models are counted over all documents (raw text) and
over the labelled target documents: of words and word pairs (lower case), and of the
words' shapes (case, digits, signs; a word equal to the one before is a shape
of its own) and shape pairs. A document's log importance weight is the sum over its n-grams of
log(p_target / p_raw). Gumbel top-k keeps the k documents with the largest
weight / temperature + Gumbel noise, a sample without replacement with
probabilities that follow the weights.

The ratio of a bucket is smoothed by ``PRIOR`` pseudo-counts at the raw rate
and taken as 1 where the target count differs from the rate of the raw text
by less than ``MIN_Z`` standard errors, so that rare n-grams add no noise to
long texts. k is the number of rows whose weight is above the cut that best separates
the labelled rows, as long as ``KEEP`` of the good ones stay (or what the caller gives). Counts, weights and the cut use
all rows; only the bucket counts (of fixed number) reach the driver.

Toxic rows are kept out by a second ratio, log(p_toxic / p_labelled) of single words
by the labelled rows they occur in. A text's toxicity is that of its worst
word, so that good text around it doesn't dilute it; the cut is chosen like the first, with toxic rows as
the rejects. Words that are harmless one by one are not seen.

Defined cases: null and empty texts have no n-gram and weight 0; without any
target row all weights are 0; without labels of both kinds k is the number of
rows, and without toxic labels no row is toxic; repeated rows are scored alike, their noise being drawn from (doc_id,
text hash), and ties at the k-th place go by doc_id and then text hash (rows
equal in both are kept together); an empty table stays empty; extra columns
are kept by ``keep_good``.
"""

from __future__ import annotations

import re
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import aside, land, utf8

BUCKETS = 1 << 16        # for words, and as many for pairs
SHAPES = 1 << 12         # for shapes, and as many for pairs
MODELS = tuple(np.cumsum([0, BUCKETS, BUCKETS, SHAPES, SHAPES]).tolist())
PRIOR = 2.0
MIN_Z = 4.0
TEMPERATURE = 0.05
KEEP = 0.995
SEED = 42
TOXIC_PRIOR = 10.0
# Labelled target rows the target model is fitted on, at most: those with the
# smallest hashes. Their ids (8 bytes each) are broadcast. The raw model, the
# weights, the cut and the selection use all rows.
TARGET_ROWS = 100_000
SEPARATE = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


CLASS = bytes(65 if 65 <= c <= 90 else 97 if 97 <= c <= 122 or c >= 128 else 48 if 48 <= c <= 57 else c for c in range(256))
RUN = re.compile(rb"(.)\1\1+", re.S)
GOLD, SILVER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _hashed(h: np.ndarray, bits: int, start: int) -> list[np.ndarray]:
    """Buckets of the items and of their neighbouring pairs."""
    down = np.uint64(64 - bits)
    return [((h * GOLD) >> down) + np.uint64(start), ((h[:-1] * GOLD + h[1:] * SILVER) >> down) + np.uint64(start + (1 << bits))]


class Grams:
    """Bucket numbers of a text's n-grams; remembers the shapes met so far."""

    def __init__(self):
        self.shapes: dict[bytes, int] = {}
        self.words = np.empty(0, np.uint64)  # word hashes of the last text

    def shape(self, token: bytes) -> int:
        s = self.shapes.get(token)
        if s is None:
            if len(self.shapes) > 100_000:
                self.shapes.clear()
            s = self.shapes[token] = crc32(RUN.sub(rb"\1\1", token))
        return s

    def __call__(self, text: bytes) -> np.ndarray:
        raw = text.split()
        shapes = list(map(self.shape, text.translate(CLASS).split()))
        # 1 stands for a word that repeats the one before
        shapes[1:] = [1 if a == b else s for a, b, s in zip(raw, raw[1:], shapes[1:])]
        for p in (b".", b",", b";", b":", b"!", b"?"):
            text = text.replace(p, b" ")
        words = text.translate(SEPARATE).split()
        h = self.words = np.fromiter(map(crc32, words), np.uint64, len(words))
        s = np.array(shapes, np.uint64)
        return np.concatenate(_hashed(h, 16, 0) + _hashed(s, 12, MODELS[2])).astype(np.int32)


def counts(docs: DataFrame, text: str = "text", target: str = "target") -> DataFrame:
    """(bucket, raw, target): n-gram counts over all rows and over the target
    rows. Every task sums its rows before the shuffle."""
    def run(batches):
        total = np.zeros((2, MODELS[-1]), np.int64)
        grams = Grams()
        for b in batches:
            for t, is_target in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                g = grams(t)
                np.add.at(total[0], g, 1)
                if is_target:
                    np.add.at(total[1], g, 1)
        used = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[0][used]), pa.array(total[1][used])],
                                         names=["bucket", "raw", "target"])
    src = docs.select(utf8(text).alias("t"), F.coalesce(F.col(target), F.lit(False)).alias("target"))
    return (src.mapInArrow(run, "bucket int, raw long, target long")
            .groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")))


def log_ratios(raw: np.ndarray, target: np.ndarray, prior: float = PRIOR, min_z: float = MIN_Z) -> np.ndarray:
    """log(p_target / p_raw) per bucket; words, pairs, shapes and shape pairs are
    models of their own."""
    out = np.zeros(MODELS[-1])
    for s in map(slice, MODELS[:-1], MODELS[1:]):
        r, t = raw[s].astype(float), target[s].astype(float)
        if not r.sum() or not t.sum():
            continue
        expect = r * (t.sum() / r.sum())
        ratio = np.log((t + prior) / (expect + prior))
        out[s] = np.where(np.abs(t - expect) >= min_z * np.sqrt(expect + 1), ratio, 0.0)
    return out


def toxic_words(docs: DataFrame, text: str = "text", toxic: str = "toxic", prior: float = TOXIC_PRIOR, min_z: float = MIN_Z) -> tuple[np.ndarray, np.ndarray]:
    """(sorted word hashes, ratios) of the words that toxic rows have more often
    than all rows of ``docs``; a row counts a word once."""
    def run(batches):
        grams = Grams()
        for b in batches:
            h, t = [], []
            for x, is_toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                grams(x)
                h.append(np.unique(grams.words))
                t.append(np.full(len(h[-1]), is_toxic, np.int64))
            if h:
                u, at = np.unique(np.concatenate(h), return_inverse=True)
                n, bad = np.bincount(at, minlength=len(u)), np.bincount(at, np.concatenate(t), len(u))
                yield pa.RecordBatch.from_arrays([pa.array(u.astype(np.int64)), pa.array(n.astype(np.int64)), pa.array(bad.astype(np.int64))],
                                                 names=["word", "n", "bad"])
    share = docs.agg(F.avg(F.col(toxic).cast("double"))).first()[0]
    if not share or share == 1:
        return np.empty(0, np.uint64), np.empty(0)
    expect = F.col("n") * share
    got = (docs.select(utf8(text).alias("t"), toxic).mapInArrow(run, "word long, n long, bad long")
           .groupBy("word").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
           .where(F.col("bad") - expect >= min_z * F.sqrt(expect + 1))
           .select("word", F.log((F.col("bad") + prior) / (expect + prior)).alias("ratio"))
           .collect())     # each has four toxic rows at least, of the labelled rows it is fitted on
    got = sorted((r["word"], r["ratio"]) for r in got)
    return np.array([w for w, _ in got], np.uint64), np.array([r for _, r in got], float)


def weights(docs: DataFrame, ratios: np.ndarray, id_col: str = "doc_id", text: str = "text",
            bad_words: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """(doc_id, text_hash, n_grams, log_weight, toxicity) per row."""
    shared = docs.sparkSession.sparkContext.broadcast((ratios, bad_words))

    def run(batches):
        (table, bad_words), grams = shared.value, Grams()
        known, ratio = bad_words or (np.empty(0, np.uint64), np.empty(0))
        for b in batches:
            n, w, tox = [], [], []
            for t in b.column(2).to_pylist():
                g = grams(t)
                n.append(len(g))
                w.append(float(table[g].sum()))
                worst = 0.0
                if len(known) and len(grams.words):
                    at = np.minimum(np.searchsorted(known, grams.words), len(known) - 1)
                    worst = float(np.where(known[at] == grams.words, ratio[at], 0.0).max())
                tox.append(worst)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(w, pa.float64()), pa.array(tox, pa.float64())],
                                             names=["doc_id", "text_hash", "n_grams", "log_weight", "toxicity"])
    t = utf8(text)
    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(t).alias("text_hash"), t.alias("t"))
            .mapInArrow(run, "doc_id long, text_hash long, n_grams long, log_weight double, toxicity double"))


def best_cut(scored: DataFrame, keep: float = KEEP) -> float | None:
    """Cut on log_weight with the best balanced accuracy on rows labelled
    (good true or false), of the cuts that accept ``keep`` of the good rows. From a histogram of fixed size; None without both kinds."""
    lab = scored.where("good is not null")
    # signed log scale, so that a few very long rows don't set the bin width
    x = F.signum("log_weight") * F.log1p(F.abs("log_weight"))
    hist = (lab.groupBy(F.floor(x * 200).alias("bin"))
            .agg(F.sum(F.col("good").cast("long")).alias("g"), F.count(F.lit(1)).alias("n")).orderBy("bin").collect())
    if not hist:
        return None
    g = np.array([r["g"] for r in hist], float)
    bad = np.array([r["n"] for r in hist], float) - g
    if not g.sum() or not bad.sum():
        return None
    # cut below bin i: rows from bin i on are accepted
    accepted = np.cumsum(g[::-1])[::-1] / g.sum()
    rejected = np.concatenate(([0], np.cumsum(bad)[:-1])) / bad.sum()
    best = int(np.argmax(np.where(accepted >= keep, accepted + rejected, 0)))
    if not best:
        return float("-inf")
    # in the middle of the gap below the lowest accepted bin
    edge = (hist[best - 1]["bin"] + 1 + hist[best]["bin"]) / 400
    return float(np.sign(edge) * np.expm1(abs(edge)))


def gumbel(seed: int = SEED):
    """Standard Gumbel noise drawn from (doc_id, text_hash)."""
    u = (F.pmod(F.xxhash64("doc_id", "text_hash", F.lit(seed)), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    return -F.log(-F.log(u))


def top_k(scored: DataFrame, k: int, key: str = "key") -> DataFrame:
    """Rows of ``scored`` (landed) with the k largest keys; ties by doc_id,
    then text_hash. The k-th place is found by counting in narrower and narrower ranges; no
    row set is gathered and nothing is sorted as a whole."""
    if k <= 0:
        return scored.limit(0)
    lo, hi, n = scored.agg(F.min(key), F.max(key), F.count(F.lit(1))).first()
    if n is None or k >= n:
        return scored
    above, bins = 0, 1024
    while True:
        width = (hi - lo) / bins
        if not width > abs(hi) * 1e-15:
            break
        b = F.least(F.floor((F.col(key) - lo) / width), F.lit(bins - 1))
        hist = dict(scored.where(F.col(key).between(lo, hi)).groupBy(b.alias("b")).count().collect())
        for i in range(bins - 1, -1, -1):
            if above + hist.get(i, 0) >= k:
                break
            above += hist.get(i, 0)
        lo2, hi2 = scored.where(F.col(key).between(lo, hi) & (b == i)).agg(F.min(key), F.max(key)).first()
        if (lo2, hi2) == (lo, hi) or hist[i] <= 1000:
            lo, hi = lo2, hi2
            break
        lo, hi = lo2, hi2
    band = F.col(key).between(lo, hi)
    last = (scored.where(band).select(key, "doc_id", "text_hash").orderBy(F.desc(key), "doc_id", "text_hash")
            .limit(k - above).orderBy(key, F.desc("doc_id"), F.desc("text_hash")).first())
    v, d, h = last
    tie = F.col(key) == v
    at_id = (F.coalesce(F.col("doc_id") < d, F.col("doc_id").isNull()) if d is not None else F.lit(False))
    same_id = F.col("doc_id").eqNullSafe(F.lit(d))
    return scored.where((F.col(key) > v) | (tie & (at_id | (same_id & (F.col("text_hash") <= h)))))


def classify(docs: DataFrame, labels: DataFrame, k: int | None = None, temperature: float = TEMPERATURE,
             seed: int = SEED, target_rows: int = TARGET_ROWS) -> DataFrame:
    """(doc_id, text_hash, n_grams, log_weight, toxicity, good, toxic, key, accepted) per row.

    ``labels``: doc_id, quality and toxic (0 or 1). Target rows have quality 1
    and are not toxic (good); rows of quality 0 are not good; toxic rows of
    quality 1 are neither and don't move the cut on weights; all toxic rows are the rejects of the cut on toxicity. Of several labels of an id the
    lowest quality and the highest toxicity hold.
    """
    lab = (labels.where("doc_id is not null").groupBy("doc_id")
           .agg(F.when(F.min("quality") == 0, F.lit(False))
                .when((F.min("quality") == 1) & ~F.max("toxic").eqNullSafe(1), F.lit(True)).alias("good"),
                F.max("toxic").eqNullSafe(1).alias("toxic")))
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    chosen = (lab.where("good").select("doc_id").orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(target_rows)
              .withColumn("target", F.lit(True)))
    def some(which):
        return lab.where(which).select("doc_id", "toxic").orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(target_rows)
    judged = named.join(F.broadcast(some("toxic").union(some("not toxic"))), "doc_id")
    marked = named.join(F.broadcast(chosen), "doc_id", "left")
    c = counts(marked).collect()
    raw, target = np.zeros(MODELS[-1], np.int64), np.zeros(MODELS[-1], np.int64)
    for b, r, t in c:
        raw[b], target[b] = r, t
    scored = land(weights(named, log_ratios(raw, target), bad_words=toxic_words(judged)).join(lab, "doc_id", "left")
                  .withColumn("key", F.col("log_weight") / temperature + gumbel(seed)), "weights")
    harm = -F.col("toxicity")
    limit = best_cut(scored.select(harm.alias("log_weight"), F.when(F.col("toxic"), False).when(F.col("good"), True).alias("good")))
    clean = scored if limit is None else scored.where(harm >= limit)
    if k is None:
        cut = best_cut(scored)
        k = clean.count() if cut is None else clean.where(F.col("log_weight") >= cut).count()
    chosen = top_k(clean, k).select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h")).distinct()
    return (scored.join(chosen, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_hash") == F.col("_h")), "left")
            .withColumn("accepted", F.col("_h").isNotNull()).drop("_d", "_h"))


def keep_good(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The accepted rows with their own columns, whatever their names."""
    columns = docs.columns
    docs, given_back = aside(docs, ["_d", "_h"])
    bad = (classify(docs, labels, **how).where("not accepted")
           .select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h")).distinct())
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_d")) & (F.xxhash64(utf8("text")) == F.col("_h"))
    return given_back(docs.join(bad, same, "left_anti")).select(*columns)
