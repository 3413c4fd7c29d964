"""Token counts through a digest cache.

The cache is a table of (tokenizer, digest, n_tokens) in a shared folder:
``tokenizer`` digests the vocabulary file and the counting rules' version,
``digest`` is the SHA-256 of the normalised content (null as empty, UTF-8;
nothing that could change the tokens). A run joins the documents' digests to
the cache, encodes one text of each digest that is missing, appends these
counts and reads all counts back by one more join. Appending twice (a
repeated job) leaves equal rows, which the read takes as one.

Texts cross the network only where they must. Digests are counted first; those
that occur more than once or are cached set a bit of a screen of fixed size
(``SCREEN`` bits, sent to all tasks). A clear bit proves a text that is missing
and occurs once: it is encoded where it is scanned. The other texts leave a
task once a digest and are grouped exactly. The larger the corpus, the more
bits are set by others' digests and the more texts take the second way; the
counts are the same.

Byte-level BPE files are encoded with a rank-based encoder over the file's own
vocabulary, which gives the library's tokens about three times faster; texts
that it refuses, and files of any other kind, go through the library itself.
Special strings inside texts become special tokens, as is the library's default.

A digest that holds ``HOT`` of all rows or more is one of at most 1 / ``HOT``,
so its count is broadcast at the end; no task gets all rows of it.

Defined cases: null and empty texts have 0 bytes and 0 tokens; repeated rows
and equal texts share a count; a null doc_id is counted like any other; empty
tables give an empty result and append nothing; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import land, utf8

LIMIT = 1024
VERSION = "1"
# bits of the screen (16 MB)
SCREEN = 1 << 27
HOT = 1 / 1024
# digests that a task remembers to have sent; more are sent again
SENT = 1 << 16
CACHE = "tokenizer string, digest string, n_tokens long"
# Fixed value: the split pattern of byte-level BPE files whose pre-tokenizer
# is ByteLevel with use_regex.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def tokenizer_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(VERSION.encode() + f.read()).hexdigest()


def byte_alphabet() -> dict[str, int]:
    """Character that stands for each byte in byte-level BPE files: printable
    Latin-1 characters stand for themselves, the rest for those from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def fast_encoder(path: str):
    """A rank-based encoder of a plain byte-level BPE file, or None."""
    import tiktoken
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
    plain = (pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
             and not spec.get("normalizer") and model.get("type", "BPE") == "BPE" and not model.get("dropout")
             and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix")
             and not model.get("ignore_merges"))
    added = spec.get("added_tokens") or []
    if not plain or any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or t.get("normalized") and not t.get("special")
                        for t in added):
        return None
    byte = byte_alphabet()
    special = {t["content"]: t["id"] for t in added}
    try:
        ranks = {bytes(byte[c] for c in k): v for k, v in model["vocab"].items() if k not in special}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        # merge order must be the order of ids
        order = [model["vocab"]["".join(m)] for m in merges]
    except KeyError:
        return None
    if order != sorted(order):
        return None
    return tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special)


class Counter:
    def __init__(self, path: str):
        self.path, self.library = path, None
        self.fast = fast_encoder(path)

    def slow(self, text: str) -> int:
        if self.library is None:
            from tokenizers import Tokenizer
            self.library = Tokenizer.from_file(self.path)
            self.library.no_truncation()
            self.library.no_padding()
        return len(self.library.encode(text, add_special_tokens=False).ids)

    def __call__(self, text: str) -> int:
        if self.fast is not None:
            try:
                return len(self.fast.encode(text, allowed_special="all"))
            except BaseException as e:  # noqa: BLE001  the encoder's regex engine gives up on some texts by a panic
                if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                    raise
        return self.slow(text)


def slots(digests) -> np.ndarray:
    """The bit of each digest (hex) in the screen."""
    return np.array([int(d[:14], 16) for d in digests], np.int64) % SCREEN


def screen(digests: DataFrame) -> bytes:
    """The bits of all digests, put together by words of 64: the driver gets
    at most ``SCREEN`` / 64 of them."""
    slot = F.conv(F.substring("digest", 1, 14), 16, 10).cast("long") % SCREEN
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (slot % 64).cast("int"))
    words = digests.groupBy(F.floor(slot / 64).cast("long").alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    out = np.zeros(-(-SCREEN // 64), np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return out.tobytes()


def passes(bits: np.ndarray, digests) -> np.ndarray:
    """Which digests have their bit set."""
    at = slots(digests)
    return (bits[at >> 3] >> (at & 7) & 1).astype(bool)


def encode_singles(keyed: DataFrame, path: str, bits) -> DataFrame:
    """(digest, t) -> (digest, n_tokens) of the texts that the screen proves
    missing and single."""
    def run(batches):
        count, own = None, np.frombuffer(bits.value, np.uint8)
        for b in batches:
            count = count or Counter(path)
            single = np.flatnonzero(~passes(own, b.column(0).to_pylist()))
            n = [count(b.column(1)[i].as_py().decode("utf-8", "replace")) for i in single.tolist()]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(single)), pa.array(n, pa.int64())], names=["digest", "n_tokens"])
    return keyed.select("digest", "t").mapInArrow(run, "digest string, n_tokens long")


def other_texts(keyed: DataFrame, bits) -> DataFrame:
    """(digest, t) of the other texts, mostly once a task and digest."""
    def run(batches):
        own, sent = np.frombuffer(bits.value, np.uint8), set()
        for b in batches:
            names, keep = b.column(0).to_pylist(), []
            for i in np.flatnonzero(passes(own, names)).tolist():
                if names[i] not in sent:
                    keep.append(i)
                    if len(sent) < SENT:
                        sent.add(names[i])
            yield b.take(pa.array(keep, pa.int64()))
    return keyed.select("digest", "t").mapInArrow(run, "digest string, t binary")


def encode(texts: DataFrame, path: str) -> DataFrame:
    """(digest, t) -> (digest, n_tokens)."""
    def run(batches):
        count = None
        for b in batches:
            count = count or Counter(path)
            n = [count(t.decode("utf-8", "replace")) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=["digest", "n_tokens"])
    return texts.select("digest", "t").mapInArrow(run, "digest string, n_tokens long")


def token_counts(docs: DataFrame, path: str, cache: str, limit: int = LIMIT, id_col: str = "doc_id",
                 text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) per row of ``docs``.

    ``path``: vocabulary file, present on all machines; ``cache``: shared folder.
    """
    spark = docs.sparkSession
    tok = tokenizer_digest(path)
    # the folder exists from here on, also on the first run
    spark.createDataFrame([], CACHE).write.mode("append").parquet(cache)
    known = lambda: (spark.read.schema(CACHE).parquet(cache).where(F.col("tokenizer") == tok)
                     .groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")))
    t = utf8(text)
    keyed = docs.select(F.sha2(t, 256).alias("digest"), t.alias("t"))
    sizes = land(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.sha2(t, 256).alias("digest"),
                             F.octet_length(t).cast("long").alias("n_bytes")), "sizes")
    counted = land(sizes.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).join(known(), "digest", "left"), "digests")
    bits = spark.sparkContext.broadcast(screen(counted.where("n > 1 OR n_tokens IS NOT NULL")))
    # a bit that another digest set leads a single text here, too
    missing = counted.where("n_tokens IS NULL").select("digest")
    others = other_texts(keyed, bits).join(missing, "digest", "left_semi").groupBy("digest").agg(F.max("t").alias("t"))
    found = encode_singles(keyed, path, bits).unionByName(encode(others, path))
    found.select(F.lit(tok).alias("tokenizer"), "digest", "n_tokens").write.mode("append").parquet(cache)
    bits.unpersist()
    total = sizes.count()
    # one of 1 / HOT digests at most
    hot = counted.where(F.col("n") >= HOT * total).select("digest")
    often = F.broadcast(known().join(F.broadcast(hot), "digest", "left_semi").withColumnRenamed("n_tokens", "often"))
    marked = sizes.join(often, "digest", "left")
    rest = marked.where("often IS NULL").join(known(), "digest", "left")
    done = marked.where("often IS NOT NULL").withColumn("n_tokens", F.col("often")).unionByName(rest)
    return done.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
