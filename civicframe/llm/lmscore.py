"""Language-model scores of texts by a sharded Elias-Fano trie of word pairs.

Tokens are words (lower-case A-Z, split at ASCII white space) and one end per
text. The model is trained on the texts whose crc32(id) mod ``FOLDS`` is not
``HELD``, on all their pairs, without a cut:

    P1(w)   = (c(w) + 1/2) / (N + (V + 1) / 2)
    P2(w|v) = c(vw) / (c(v) + MU) + MU / (c(v) + MU) * P1(w)

The base score takes P1 alone, the score P2.

Texts are gathered into blocks of up to ``BLOCK`` tokens, each with a
dictionary of its own, written once to the shared folder. A block sends every
distinct pair once, with its count in training texts, to the shard of its first
word. A shard merges them into a trie (``eliasfano.Trie``: a compact buffer
with quantised shares c(vw) / (c(v) + MU), read in place) and answers all blocks from
it, one code a pair. Every word is the first of one pair at each place where it
stands, so the shard's roots are the counts of single words too, and one exchange
gives a block all it needs. Answers go back to the blocks, where each
token's probability is put together and summed per text.

Hot words: a word that holds over ``SHARE`` of all words is on a list of at
most 4 / (3 SHARE) entries. Its count is summed beforehand and its pairs are
dealt by the second word too, to as many shards as it fills.

Words are told apart by 64-bit hashes. Per-text sums are over the tokens in order.

Defined cases: a null or empty text has one token, its end; a null id counts as
the empty string, in training; repeated rows are texts of their own; an empty
table gives an empty result; other columns are ignored. Texts of any length are
scored whole; one longer than a block is a block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import land, utf8
from .eliasfano import Trie, probability

FOLDS, HELD = 5, 1
MU = 16.0
BLOCK = 1 << 21
SHARD = 1 << 21
SHARE = 1 / (1 << 16)
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
# symbols of every block's dictionary that are no words
START, END = 0, 1
MARKS = np.array([1, 2], np.uint64)

BLOCKS = "blk long, ids array<long>, held array<boolean>, n_words array<long>, words binary, tokens binary, often array<long>, often_n array<long>"


def squeeze(a: np.ndarray) -> bytes:
    """An array as compressed bytes, one plane of bytes after the other."""
    a = np.ascontiguousarray(a)
    return zstandard.compress(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes(), 1)


def expand(b: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(b), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).reshape(-1).view(kind)


def is_held(id_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD


def blocks(docs: DataFrame) -> DataFrame:
    """Texts as arrays of places in their block's dictionary (most frequent
    first); ``often``: hashes and training counts of words that could be hot."""
    def run(batches):
        from pyspark import TaskContext
        part, made = TaskContext.get().partitionId(), 0
        ids, held, n_words, toks, index, size = [], [], [], [], {}, 0

        def close():
            nonlocal ids, held, n_words, toks, index, size, made
            flat = np.concatenate(toks) if toks else np.zeros(0, np.int32)
            count = np.bincount(flat, minlength=len(index))
            order = np.argsort(-count, kind="stable")
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in index), np.uint64, len(index))
            trained = np.bincount(flat, np.repeat(~np.array(held, bool), n_words), minlength=len(index)).astype(np.int64)
            starts = len(held) - sum(held)
            trained, names = np.concatenate([[starts], trained]), np.concatenate([MARKS[:1], hashes])
            many = trained >= max(1, SHARE / 4 * trained.sum())
            out = (part << 33 | made, ids, held, n_words, squeeze(hashes[order]) if len(order) else b"",
                   squeeze(place[flat].astype(np.int32)) if len(flat) else b"", names[many].view(np.int64), trained[many])
            ids, held, n_words, toks, index, size = [], [], [], [], {}, 0
            made += 1
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.binary(), pa.binary(),
                     pa.list_(pa.int64()), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(out, kinds)], names=[f.split()[0] for f in BLOCKS.split(", ")])

        for b in batches:
            for i, h, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                w = t.as_py().translate(LOWER).split()
                if size and size + len(w) + 1 > BLOCK:
                    yield close()
                ids.append(i)
                held.append(h)
                n_words.append(len(w))
                at = index.setdefault
                toks.append(np.fromiter((at(x, len(index)) for x in w), np.int32, len(w)))
                size += len(w) + 1
        if ids:
            yield close()
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), is_held("doc_id").alias("held"), utf8("text").alias("t"))
    return keyed.mapInArrow(run, BLOCKS)


class Entries:
    """Distinct pairs of a block, dealt to shards. ``at``: the entry of each
    token (the one before it and itself)."""

    def __init__(self, row: dict, shards: int, hot: np.ndarray, parts: np.ndarray):
        words = expand(row["words"], np.uint64) if row["words"] else np.zeros(0, np.uint64)
        tokens = expand(row["tokens"], np.int32) if row["tokens"] else np.zeros(0, np.int32)
        self.names = np.concatenate([MARKS, words])
        n_words = np.array(row["n_words"], np.int64)
        self.n_tokens = n_words + 1
        self.first = np.cumsum(self.n_tokens) - self.n_tokens
        # every text's words and its end; before them its start and the words
        last = self.first + n_words
        self.token = np.full(self.n_tokens.sum(), END, np.int64)
        inside = np.ones(len(self.token), bool)
        inside[last] = False
        self.token[inside] = tokens
        self.token[inside] += len(MARKS)
        before = np.empty_like(self.token)
        before[1:] = self.token[:-1]
        before[self.first] = START
        n = len(self.names)
        pairs, self.at = np.unique(before * n + self.token, return_inverse=True)
        del before
        self.u, self.v = pairs // n, pairs % n
        held = np.repeat(np.array(row["held"], bool), self.n_tokens)
        self.count = np.bincount(self.at, ~held, minlength=len(pairs)).astype(np.int64)
        # shard of the first word; a hot one is dealt by the second word too
        of = np.ones(n, np.int64)
        if len(hot):
            place = np.minimum(np.searchsorted(hot, self.names), len(hot) - 1)
            of = np.where(hot[place] == self.names, parts[place], 1)
        mixed = ((self.names * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64)
        shard = (mixed[self.u] + mixed[self.v] % of[self.u]) % shards
        order = np.argsort(shard, kind="stable")
        cut = np.flatnonzero(np.diff(shard[order])) + 1
        #: shard and its entries, in the order of u, v
        self.dealt = [(int(shard[p[0]]), p) for p in np.split(order, cut) if len(p)]

    def heads(self, part: np.ndarray) -> np.ndarray:
        """Which entries of a shard's part start a root."""
        u = self.u[part]
        return np.concatenate([[True], u[1:] != u[:-1]])


def rows_of(batches):
    for b in batches:
        for i in range(b.num_rows):
            yield b.slice(i, 1).to_pylist()[0]


def queries(landed: DataFrame, shards: int, hot: np.ndarray, parts: np.ndarray) -> DataFrame:
    """(shard, blk, load): a part's symbols and its entries as a small trie."""
    def run(batches):
        for row in rows_of(batches):
            e = Entries(row, shards, hot, parts)
            for shard, p in e.dealt:
                root = e.heads(p)
                used, place = np.unique(np.concatenate([e.u[p][root], e.v[p]]), return_inverse=True)
                n = root.sum()
                per_root = np.diff(np.append(np.flatnonzero(root), len(p)))
                load = [squeeze(e.names[used]), *(squeeze(x.astype(np.int32)) for x in (place[:n], per_root, place[n:], e.count[p]))]
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([row["blk"]], pa.int64()), pa.array([load], pa.list_(pa.binary()))],
                                                 names=["shard", "blk", "load"])
    return landed.select("blk", "held", "n_words", "words", "tokens").mapInArrow(run, "shard int, blk long, load array<binary>")


def answers(asked: DataFrame, shards: int, hot: np.ndarray, hot_n: np.ndarray) -> DataFrame:
    """(blk, shard, codes, n_roots) for each load: its roots' counts and its
    pairs' codes. n_roots: trained words of the shard that are not hot, on one
    row of a shard."""
    def run(table: pa.Table) -> pa.Table:
        blks = table.column("blk").to_pylist()
        loads = [[x.as_py() for x in load.values] for load in table.column("load")]
        names = np.unique(np.concatenate([expand(x[0], np.uint64) for x in loads]))
        m = len(names)
        parts, counts = [], []
        for x in loads:
            sym = np.searchsorted(names, expand(x[0], np.uint64))
            u, nu, v = (expand(y, np.int32) for y in x[1:4])
            parts.append((sym[u], nu, np.repeat(sym[u], nu) * m + sym[v]))
            counts.append(expand(x[4], np.int32))
        del loads
        pairs, place = np.unique(np.concatenate([p[2] for p in parts]), return_inverse=True)
        n = np.bincount(place, np.concatenate(counts), len(pairs)).astype(np.int64)
        del place, counts
        pairs, n = pairs[n > 0], n[n > 0]

        def whole(roots, counts):
            if not len(hot):
                return counts
            at = np.minimum(np.searchsorted(hot, names[roots]), len(hot) - 1)
            return np.where(hot[at] == names[roots], hot_n[at], counts)
        trie = Trie(Trie.pack(m, pairs // m, pairs % m, n, whole, MU))
        del pairs, n
        roots = names[trie.roots.get(np.arange(trie.roots.n))]
        n_roots = int((~np.isin(roots, np.concatenate([hot, MARKS]))).sum())
        out = []
        for u, nu, uv in parts:
            r = trie.roots.find(u)
            q = trie.below(np.repeat(r, nu), uv % m)
            got = lambda a, i: np.where(i >= 0, a[i], 0) if len(a) else np.zeros(len(i), a.dtype)
            out.append([squeeze(got(trie.counts, r)), squeeze(got(trie.share, q))])
        return pa.table([pa.array(blks, pa.int64()), pa.array(out, pa.list_(pa.binary())),
                         pa.array([n_roots, *[0] * (len(blks) - 1)], pa.int64())], names=["blk", "codes", "n_roots"])

    def one(key, table):
        got = run(table)
        return got.append_column("shard", pa.array([key[0].as_py()] * got.num_rows, pa.int32())).select(["blk", "shard", "codes", "n_roots"])
    # a task for each shard or two, however many there are
    return asked.repartition(2 * shards, "shard").groupBy("shard").applyInArrow(one, "blk long, shard int, codes array<binary>, n_roots long")


def scores(landed: DataFrame, answered: DataFrame, shards: int, hot: np.ndarray, hot_n: np.ndarray, parts: np.ndarray, n_texts: int, total: int,
           distinct: int) -> DataFrame:
    """A row per text from its block and the block's answers."""
    def run(batches):
        for row in rows_of(batches):
            e = Entries(row, shards, hot, parts)
            told = {x["shard"]: x["codes"] for x in row.pop("answers")}
            share = np.zeros(len(e.u), np.uint8)
            counts = np.zeros(len(e.names), np.int64)
            for shard, p in e.dealt:
                share[p] = expand(told[shard][1], np.uint8)
                counts[e.u[p][e.heads(p)]] = expand(told[shard][0], np.int64)
            if len(hot):      # a part of a hot word's pairs does not show its count
                place = np.minimum(np.searchsorted(hot, e.names), len(hot) - 1)
                counts = np.where(hot[place] == e.names, hot_n[place], counts)
            counts[END] = n_texts
            c = counts[e.token]
            p1 = (c + 0.5) / (total + 0.5 * (distinct + 1))
            p2 = probability(share)[e.at] + (MU / (counts[e.u] + MU))[e.at] * p1
            cut = lambda x: np.add.reduceat(x, e.first)
            yield pa.RecordBatch.from_arrays(
                [pa.array(row["ids"], pa.int64()), pa.array(row["held"]), pa.array(e.n_tokens), pa.array(cut((c > 0).astype(np.int64))),
                 pa.array(np.full(len(e.first), total)), pa.array(cut(np.log10(p1))), pa.array(cut(np.log10(p2)))], names=names)
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    told = answered.groupBy("blk").agg(F.collect_list(F.struct("shard", "codes")).alias("answers"))
    return (landed.select("blk", "ids", "held", "n_words", "words", "tokens").repartition(2 * shards, "blk").join(told, "blk")
            .mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"))


def score(docs: DataFrame, shard_tokens: int = SHARD) -> DataFrame:
    """Per text ``doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score, score`` (log10)."""
    landed = land(blocks(docs.select("doc_id", "text")), "blocks", "uncompressed")
    trained = F.aggregate(F.arrays_zip("held", "n_words"), F.lit(0).cast("long"), lambda s, x: s + F.when(x["held"], 0).otherwise(x["n_words"] + 1))
    texts = F.size(F.filter("held", lambda h: ~h)).cast("long")
    size = landed.agg(F.sum(trained), F.sum(texts), F.sum(F.aggregate("n_words", F.lit(0).cast("long"), lambda s, x: s + x + 1))).first()
    total, n_texts, n_all = (int(x or 0) for x in size)
    shards = max(1, -(-n_all // shard_tokens))
    # a word with over SHARE of all words has three quarters of them listed
    listed = (landed.select(F.explode(F.arrays_zip("often", "often_n")).alias("x")).groupBy(F.col("x.often").alias("h")).agg(F.sum("x.often_n").alias("n"))
              .where(F.col("n") >= 0.75 * SHARE * max(total, 1)).toArrow())
    hot = listed.column("h").to_numpy().view(np.uint64)
    hot = np.sort(hot)
    hot_n = exact_counts(landed, hot)
    parts = np.minimum(shards, np.maximum(1, np.ceil(hot_n * 2 * shards / max(total, 1)).astype(np.int64)))
    answered = land(answers(queries(landed, shards, hot, parts), shards, hot, hot_n), "answers", "uncompressed")
    distinct = int(answered.agg(F.sum("n_roots")).first()[0] or 0) + int((hot_n[~np.isin(hot, MARKS)] > 0).sum()) + (1 if n_texts else 0)
    return scores(landed, answered, shards, hot, hot_n, parts, n_texts, total, distinct)


def exact_counts(landed: DataFrame, hot: np.ndarray) -> np.ndarray:
    """Training counts of the listed words over all blocks."""
    def run(batches):
        for row in rows_of(batches):
            held = np.array(row["held"], bool)
            names = np.concatenate([MARKS, expand(row["words"], np.uint64) if row["words"] else np.zeros(0, np.uint64)])
            tokens = expand(row["tokens"], np.int32) if row["tokens"] else np.zeros(0, np.int32)
            n = np.zeros(len(names), np.int64)
            n[len(MARKS):] = np.bincount(tokens, np.repeat(~held, np.array(row["n_words"], np.int64)), len(names) - len(MARKS))
            n[START] = (~held).sum()
            order = np.argsort(names)
            of = order[np.minimum(np.searchsorted(names[order], hot), len(names) - 1)]
            there = names[of] == hot
            yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(there)), pa.array(n[of[there]])], names=["i", "n"])
    out = np.zeros(len(hot), np.int64)
    for r in landed.select("held", "n_words", "words", "tokens").mapInArrow(run, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).collect():
        out[r["i"]] = r["n"]
    return out
