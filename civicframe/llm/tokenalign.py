"""Alignment of two tokenizers' tokens over a corpus, by an identity map.

Each text is encoded by A (a byte-level BPE file) and by B (a sentencepiece
model that puts a space before the text). Byte offsets where a token of A and
a token of B both end cut the text into groups; a token of A and one of B are
linked where their bytes overlap. How many documents hold an id pair linked
decides which B id an A id goes with.

The fast path: ``identity`` maps an A id to the B id of the same bytes, made
once from the two vocabularies. An exact one-to-one group links an A id to its
identity, so its document count needs no pair: every task adds it to a vector of
A's vocabulary length. Only links of irregular groups become pairs (a pair
that is linked both ways in a document counts once, in the vector). Per task
they are counted before they are shuffled.

Counts come back to the documents in two ways, both exact: the vectors and the
most frequent pairs (at most ``HOT_PAIRS``, those above a power of two that
is found from a histogram of the counts) are small and go to every task; all
other pairs are joined, and none of them is frequent, so no key is hot.

Units. White space before a word starts a token in both vocabularies, so a
text is cut before each space that follows a non-space, and a unit's tokens,
groups and links are worked out once and kept (at most ``KEEP_UNITS`` a task).
This is checked from the files: A must be plain byte-level BPE, and no piece
of B may hold a space after anything else. Otherwise the unit is the text.

Defined cases: a null or empty text, and one whose joined token bytes of A or B
differ from the text's with a space before it, has no tokens: zeros and ''.
Repeated rows are documents of their own; a null doc_id is a document like any
other; an empty table gives an empty result; other columns are ignored, whatever
their names. Texts of any length are encoded whole.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import land, utf8
from .tokencount import byte_alphabet, fast_encoder

HOT_PAIRS = 1 << 16
KEEP_UNITS = 1 << 18
FLUSH_PAIRS = 1 << 21
CHUNK_BYTES = 1 << 21

ENCODED = ("kind int, key long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
           "same array<int>, same_n array<int>, pair array<long>, pair_n array<int>")
BREAK = re.compile(r"(?<=\S)(?= )")


class Vocabularies:
    """Ids, bytes and encoders of both files."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.a_fast = fast_encoder(path_a)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        alphabet = byte_alphabet()
        names = {i: t for t, i in self.a.get_vocab(with_added_tokens=True).items()}
        self.size_a, self.size_b = max(names) + 1, self.b.vocab_size()
        self.bytes_a = [b""] * self.size_a
        for i, t in names.items():
            self.bytes_a[i] = bytes(alphabet[c] for c in t) if all(c in alphabet for c in t) else t.encode()
        self.bytes_b = []
        for i in range(self.size_b):
            p = self.b.id_to_piece(i)
            hexa = re.fullmatch(r"<0x([0-9A-Fa-f]{2})>", p)
            self.bytes_b.append(bytes([int(hexa[1], 16)]) if hexa else p.replace("▁", " ").encode())
        self.len_a = [len(x) for x in self.bytes_a]
        self.len_b = [len(x) for x in self.bytes_b]
        #: A id -> B id of the same bytes (the first one), -1 without one
        first = {}
        for i in reversed(range(self.size_b)):
            first[self.bytes_b[i]] = i
        self.identity = np.array([first.get(x, -1) for x in self.bytes_a])
        # a piece with a space after something else could cross a unit's start
        self.cut = self.a_fast is not None and not any(re.search(r"[^▁]▁", self.b.id_to_piece(i))
                                                       for i in range(self.size_b) if not self.b.is_byte(i))

    def ids_a(self, text: str) -> list[int]:
        if self.a_fast is not None:
            try:
                return self.a_fast.encode_ordinary(text)
            except BaseException as e:  # noqa: BLE001  its regex engine gives up on some texts by a panic
                if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                    raise
        return self.a.encode(text, add_special_tokens=False).ids

    def ids(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of texts that start with the space, by A and by B."""
        return [self.ids_a(t) for t in texts], self.b.encode([t[1:] for t in texts], num_threads=1)


def align(ids_a: list[int], ids_b: list[int], len_a: list[int], len_b: list[int], size_b: int) -> tuple[list[int], str, int]:
    """Codes ``a * size_b + b`` of the links, the groups as text and their
    number. The tokens cover the same bytes, each at least one."""
    links, text = [], []
    i = j = gi = gj = 0
    end_a, end_b = len_a[ids_a[0]], len_b[ids_b[0]]
    while True:
        a, b = ids_a[i], ids_b[j]
        links.append(a * size_b + b)
        if end_a < end_b:
            i += 1
            end_a += len_a[ids_a[i]]
        elif end_b < end_a:
            j += 1
            end_b += len_b[ids_b[j]]
        else:
            if i == gi and j == gj:
                text.append(f"{a}|{b}")
            else:
                text.append(",".join(map(str, ids_a[gi:i + 1])) + "|" + ",".join(map(str, ids_b[gj:j + 1])))
            i += 1
            j += 1
            if i == len(ids_a):
                return links, ";".join(text), len(text)
            gi, gj = i, j
            end_a, end_b = len_a[ids_a[i]], len_b[ids_b[j]]


class Units:
    """What is known of the units met so far, as flat arrays."""

    def __init__(self, v: Vocabularies):
        self.v = v
        self.clear()

    def clear(self):
        self.index: dict[str, int] = {}
        self.text: list[str] = []
        self.new_rows: list[tuple] = []      # n_a, n_b, n_groups, n_links, fits
        self.new_links: list[int] = []       # a * size_b + b of every link
        self.rows, self.links, self.start = np.zeros((1024, 5), np.int64), np.zeros(4096, np.int64), np.zeros(1025, np.int64)
        self.n = self.size = 0

    def add(self, units: list[str]) -> None:
        v = self.v
        for unit, a, b in zip(units, *v.ids(units)):
            raw = unit.encode()
            if b"".join([v.bytes_a[i] for i in a]) == raw and b"".join([v.bytes_b[i] for i in b]) == raw:
                links, text, groups = align(a, b, v.len_a, v.len_b, v.size_b)
                self.new_rows.append((len(a), len(b), groups, len(links), 1))
                self.new_links += links
            else:
                text = ""
                self.new_rows.append((0, 0, 0, 0, 0))
            self.index[unit] = len(self.text)
            self.text.append(text)
        self.settle()

    def settle(self) -> None:
        """New units go into arrays that double when they are full."""
        new = np.array(self.new_rows, np.int64).reshape(-1, 5)
        m, k = self.n + len(new), self.size + len(self.new_links)
        if m > len(self.rows):
            self.rows, self.start = np.resize(self.rows, (2 * m, 5)), np.resize(self.start, 2 * m + 1)
        if k > len(self.links):
            self.links = np.resize(self.links, 2 * k)
        self.rows[self.n:m], self.links[self.size:k] = new, self.new_links
        self.start[self.n + 1:m + 1] = self.size + np.cumsum(new[:, 3])
        self.n, self.size, self.new_rows, self.new_links = m, k, [], []

    def of(self, texts: list[list[str]]) -> list[list[int]]:
        index = self.index
        missing = [*{u: 0 for t in texts for u in t if u not in index}]
        if missing:
            self.add(missing)
        return [[index[u] for u in t] for t in texts]


def per_document(units: Units, docs: list[list[int]]):
    """Links of the documents: (document, code, occurrences), one row for each
    pair of a document, ordered by document and code."""
    links, start = units.links, units.start
    at = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    unit = np.fromiter((i for d in docs for i in d), np.int64, len(at))
    n_units = units.n
    both, times = np.unique(at * n_units + unit, return_counts=True)
    at, unit = both // n_units, both % n_units
    n = start[unit + 1] - start[unit]
    first = np.cumsum(n) - n
    place = np.arange(n.sum()) - np.repeat(first, n) + np.repeat(start[unit], n)
    code = np.repeat(at, n) * (units.v.size_a * units.v.size_b) + links[place]
    order = np.argsort(code, kind="stable")
    code, weight = code[order], np.repeat(times, n)[order]
    if not len(code):
        return code, code, code
    head = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
    weight = np.add.reduceat(weight, head)
    code = code[head]
    size = units.v.size_a * units.v.size_b
    return code // size, code % size, weight


def lists(values: np.ndarray, at: np.ndarray, n: int, kind) -> pa.ListArray:
    """``values`` dealt to ``n`` lists by the ascending ``at``."""
    offsets = np.searchsorted(at, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def encode(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """One row per document (kind 0) and, at the end of a task, its vector of
    identity counts (kind 1) and its counted pairs (kind 2)."""
    def run(batches):
        v = Vocabularies(path_a, path_b)
        units = Units(v)
        vector = np.zeros(v.size_a, np.int64)
        pending, n_pending, merged = [], 0, [np.zeros(0, np.int64), np.zeros(0, np.int64)]
        names = [f.split()[0] for f in ENCODED.split(", ")]

        def batch(**cols):
            n = len(next(iter(cols.values())))
            kinds = {"kind": pa.int32(), "groups_sha256": pa.string(), "same": pa.list_(pa.int32()), "same_n": pa.list_(pa.int32()),
                     "pair": pa.list_(pa.int64()), "pair_n": pa.list_(pa.int32())}
            return pa.RecordBatch.from_arrays(
                [cols[c] if c in cols else pa.nulls(n, kinds.get(c, pa.int64())) for c in names], names=names)

        def count():
            nonlocal pending, n_pending, merged
            codes, n = np.unique(np.concatenate([merged[0], *pending]), return_inverse=True)
            weight = np.concatenate([merged[1], np.ones(len(n) - len(merged[1]), np.int64)])
            merged = [codes, np.bincount(n, weight, len(codes)).astype(np.int64)]
            pending, n_pending = [], 0

        def counted():
            nonlocal merged
            code, n = merged
            merged = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
            for i in range(0, len(code), 1 << 16):
                piece, k = code[i:i + (1 << 16)], n[i:i + (1 << 16)]
                one = np.zeros(len(piece), np.int64)
                yield batch(kind=pa.array([2], pa.int32()), pair=lists(piece, one, 1, pa.int64()), pair_n=lists(k, one, 1, pa.int32()))

        def chunk(keys, ids, texts):
            nonlocal n_pending
            if units.n > KEEP_UNITS:
                units.clear()
            whole = [" " + t.decode("utf-8", "replace") for t in texts]
            dealt = units.of([[] if len(t) == 1 else BREAK.split(t) if v.cut else [t] for t in whole])
            # a unit that does not fit: the joined bytes of the whole text decide
            odd = [i for i, d in enumerate(dealt) if len(d) > 1 and not units.rows[d, 4].all()]
            for i, d in zip(odd, units.of([[whole[i]] for i in odd])):
                dealt[i] = d
            sums = np.array([units.rows[d].sum(axis=0) for d in dealt]).reshape(-1, 5)
            dealt = [d if s[0] else [] for d, s in zip(dealt, sums)]
            sha = [hashlib.sha256(";".join([units.text[i] for i in d]).encode()).hexdigest() if d else "" for d in dealt]
            at, code, n = per_document(units, dealt)
            same = v.identity[code // v.size_b] == code % v.size_b
            np.add.at(vector, code[same] // v.size_b, 1)
            pending.append(code[~same])
            n_pending += len(pending[-1])
            out = batch(kind=pa.array(np.zeros(len(ids)), pa.int32()), key=keys, doc_id=ids,
                        n_a=pa.array(sums[:, 0]), n_b=pa.array(sums[:, 1]), n_groups=pa.array(sums[:, 2]),
                        n_links=pa.array(sums[:, 3]), groups_sha256=pa.array(sha),
                        same=lists(code[same] // v.size_b, at[same], len(ids), pa.int32()), same_n=lists(n[same], at[same], len(ids), pa.int32()),
                        pair=lists(code[~same], at[~same], len(ids), pa.int64()), pair_n=lists(n[~same], at[~same], len(ids), pa.int32()))
            if n_pending > FLUSH_PAIRS:
                count()
            return out

        any_row = False
        for b in batches:
            any_row = any_row or b.num_rows > 0
            texts, i = b.column(2).to_pylist(), 0
            while i < len(texts):
                j, size = i, 0
                while j < len(texts) and (j == i or size + len(texts[j]) <= CHUNK_BYTES):
                    size += len(texts[j])
                    j += 1
                yield chunk(b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), texts[i:j])
                if len(merged[0]) > FLUSH_PAIRS:
                    yield from counted()
                i = j
        if any_row:
            count()
            yield from counted()
            held = np.flatnonzero(vector)
            one = np.zeros(len(held), np.int64)
            yield batch(kind=pa.array([1], pa.int32()), pair=lists(held, one, 1, pa.int64()), pair_n=lists(vector[held], one, 1, pa.int32()))

    keyed = docs.select(F.monotonically_increasing_id().alias("key"), F.col("doc_id").cast("long").alias("doc_id"), utf8("text").alias("t"))
    return keyed.mapInArrow(run, ENCODED)


def counted(encoded: DataFrame, kind: int, name: str) -> DataFrame:
    """(name, n): summed counts of the rows of one kind."""
    return (encoded.where(F.col("kind") == kind).select(F.explode(F.arrays_zip("pair", "pair_n")).alias("x"))
            .groupBy(F.col("x.pair").alias(name)).agg(F.sum("x.pair_n").alias("n")))


def threshold(counts: DataFrame, most: int) -> int:
    """The smallest power of two that at most ``most`` counts reach."""
    bits = counts.groupBy(F.length(F.bin("n")).alias("b")).count().collect()    # at most 64 rows
    total = 0
    for b, n in sorted(((r["b"], r["count"]) for r in bits), reverse=True):
        total += n
        if total > most:
            return 1 << b
    return 1


def alignment(docs: DataFrame, path_a: str, path_b: str, hot_pairs: int = HOT_PAIRS) -> tuple[DataFrame, DataFrame]:
    """(documents, pairs): per document ``doc_id, n_a, n_b, n_groups, n_links,
    n_best, count_sum, groups_sha256``; per linked id pair ``a, b, n, best``.

    ``path_a``, ``path_b``: vocabulary files, present on all machines.
    """
    spark = docs.sparkSession
    v = Vocabularies(path_a, path_b)
    size_a, size_b, identity = v.size_a, v.size_b, v.identity
    encoded = land(encode(docs.select("doc_id", "text"), path_a, path_b), "aligned", "zstd")
    # vectors of A's vocabulary length: at most size_a rows reach the driver
    same_n = np.zeros(size_a, np.int64)
    for r in counted(encoded, 1, "a").collect():
        same_n[r["a"]] = r["n"]
    pairs = land(counted(encoded, 2, "pair"), "pairs")
    most = same_n.copy()
    for r in pairs.groupBy(F.expr(f"pair div {size_b}").alias("a")).agg(F.max("n").alias("n")).collect():
        most[r["a"]] = max(most[r["a"]], r["n"])
    least = threshold(pairs, hot_pairs)
    hot = pairs.where(F.col("n") >= least).toArrow()
    hot_code, hot_n = hot.column("pair").to_numpy(), hot.column("n").to_numpy()
    order = np.argsort(hot_code)
    hot_code, hot_n = hot_code[order], hot_n[order]

    def look_up(batches):
        for b in batches:
            n = b.num_rows
            same, same_k, pair, pair_k = (b.column(i) for i in (7, 8, 9, 10))
            best, total = np.zeros(n, np.int64), np.zeros(n, np.int64)

            def add(at, count, top, times):
                # exact integer sums
                np.add.at(total, at, count * times)
                np.add.at(best, at, np.where(count == top, times, 0))

            at = np.repeat(np.arange(n), np.diff(same.offsets.to_numpy()))
            ids = same.flatten().to_numpy()
            add(at, same_n[ids], most[ids], same_k.flatten().to_numpy().astype(np.int64))
            at = np.repeat(np.arange(n), np.diff(pair.offsets.to_numpy()))
            code, k = pair.flatten().to_numpy(), pair_k.flatten().to_numpy().astype(np.int64)
            place = np.minimum(np.searchsorted(hot_code, code), max(len(hot_code) - 1, 0))
            known = hot_code[place] == code if len(hot_code) else np.zeros(len(code), bool)
            add(at[known], hot_n[place[known]], most[code[known] // size_b], k[known])
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i) for i in range(7)), pa.array(best), pa.array(total),
                 lists(code[~known], at[~known], n, pa.int64()), lists(k[~known], at[~known], n, pa.int32())],
                names=[*(b.schema.names[:7]), "n_best", "count_sum", "pair", "pair_n"])

    meta = "key long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
    names = [f.split()[0] for f in meta.split(", ")]
    known = land(encoded.where("kind = 0").select(*names, "same", "same_n", "pair", "pair_n")
                 .mapInArrow(look_up, f"{meta}, n_best long, count_sum long, pair array<long>, pair_n array<int>"), "known", "zstd")
    top = spark.createDataFrame(pa.table({"a": np.arange(size_a), "top": most}))    # A's vocabulary, no more
    rated = (pairs.withColumn("a", F.expr(f"pair div {size_b}")).join(F.broadcast(top), "a")
             .select("pair", "a", (F.col("pair") % size_b).alias("b"), "n", (F.col("n") == F.col("top")).alias("best")))
    rest = (known.select("key", F.explode(F.arrays_zip("pair", "pair_n")).alias("x")).select("key", "x.pair", "x.pair_n")
            .join(rated.where(F.col("n") < least).select("pair", "n", "best"), "pair")
            .select("key", F.when(F.col("best"), F.col("pair_n")).otherwise(0).cast("long").alias("n_best"),
                    (F.col("n") * F.col("pair_n")).alias("count_sum")))
    blank = [F.lit(None).cast("string" if c == "groups_sha256" else "long").alias(c) for c in names[1:]]
    both = known.select(*names, "n_best", "count_sum").union(rest.select("key", *blank, "n_best", "count_sum"))
    per_doc = (both.groupBy("key").agg(*(F.max(c).alias(c) for c in names[1:]), F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
               .select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"))
    ids = np.flatnonzero(same_n)
    exact = spark.createDataFrame(pa.table({"a": ids, "b": identity[ids].astype(np.int64), "n": same_n[ids], "best": same_n[ids] == most[ids]}))
    return per_doc, rated.select("a", "b", "n", "best").union(exact)
