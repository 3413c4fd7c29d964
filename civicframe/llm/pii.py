"""Personal data: exact base patterns plus a character BiLSTM-CRF.

The model is trained in numpy on the driver from labelled spans: a bounded
sample of windows of the documents, labelled by the base patterns, and
generated lines by rule that also hold forms the base patterns miss (phones
without a plus, numbers split by dots). Every window of a text that holds a
digit or an @ is decoded; windows overlap by half. Any other window needs no decoding: a
span without a digit or @ is none of the four kinds, and ``valid`` would
drop it. A span seen in several windows is taken from the window where it
lies farthest from an edge; the spans left are reconciled over the whole text:
base spans stay, and of overlapping model spans the one with the larger margin
wins.

Defined cases: null and empty texts have no span; equal texts have equal spans;
offsets are code points, end exclusive; long texts are cut into as many windows as needed; repeated rows
give repeated results; an empty table trains on the generated lines alone;
extra columns are ignored by ``find`` and kept by ``mask``.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import charlstm
from .common import aside, utf8

KINDS = ("email", "ip", "card", "phone")
WINDOW, STRIDE = 64, 32
AROUND = 2
# Bound of the training sample: windows of the documents, and generated lines.
TRAIN_WINDOWS, GENERATED = 1000, 600
EPOCHS = 10

# The base patterns. They are matched by the functions below in
# one pass each, whatever the text holds.
EMAIL_LOCAL = "[A-Za-z0-9._%+-]"
EMAIL_REST = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP_CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_NOT_SIGN = bytes(c for c in range(256) if not (48 <= c <= 57 or c == 64))


def may_hold(text: bytes) -> bool:
    """Whether a text has a digit or an @."""
    return bool(text.translate(None, _NOT_SIGN))


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches: the run before each @, cut at the match before."""
    out, end = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = EMAIL_REST.match(text, at) if start < at else None
        if m:
            out.append((start, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    return out


def ips(text: str) -> list[tuple[int, int]]:
    """Four numbers at a time of each chain of dotted numbers."""
    out = []
    for m in IP_CHAIN.finditer(text):
        runs, at = [], m.start()
        for r in m[0].split("."):
            runs.append((at, r))
            at += len(r) + 1
        for i in range(0, len(runs) - 3, 4):
            four = runs[i:i + 4]
            if all(len(r.lstrip("0")) <= 3 and int(r.lstrip("0") or 0) <= 255 for _, r in four):
                out.append((four[0][0], four[3][0] + len(four[3][1])))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return re.sub("[^0-9]", "", s)


def cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in CARD.finditer(text):
        d = _digits(m[0]) if m.end() - m.start() <= 37 else ""
        if 14 <= len(d) <= 19 and luhn(d):
            out.append(m.span())
    return out


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end), by start and then kind."""
    found = (emails(text), ips(text), cards(text), phones(text))
    return sorted((s, k, e) for k, spans in enumerate(found) for s, e in spans)


def valid(kind: int, s: str) -> bool:
    """The check a model span must pass."""
    d = _digits(s)
    if kind == 0:
        user, _, host = s.partition("@")
        return bool(user) and "." in host.strip(".")
    if kind == 1:
        parts = re.split(r"\D+", s)
        return len(parts) == 4 and all(p and len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == 2:
        return 14 <= len(d) <= 19 and luhn(d)
    return 10 <= len(d) <= 15 and s.strip() == s


def window_starts(cls: np.ndarray) -> np.ndarray:
    """Starts (multiples of ``STRIDE``) of the windows that hold a digit or @."""
    sign = np.flatnonzero((cls == charlstm.DIGIT) | (cls == charlstm.OTHER + 1 + charlstm.SIGNS.index("@")))
    if not len(sign):
        return sign
    first = np.maximum(sign - WINDOW, -1) // STRIDE + 1
    last = sign // STRIDE
    return np.unique(np.concatenate([first, last, *(np.minimum(first + i, last) for i in range(1, WINDOW // STRIDE))])) * STRIDE


def decoded_starts(cls: np.ndarray) -> np.ndarray:
    """Windows that are decoded: those with a sign and ``AROUND`` windows on
    both sides, as a span may go on where no sign is."""
    starts = window_starts(cls)
    if not len(starts):
        return starts
    near = np.unique(starts[:, None] + np.arange(-AROUND, AROUND + 1) * STRIDE)
    return near[(near >= 0) & (near < max(len(cls), 1))]


def cut_windows(cls: np.ndarray, starts: np.ndarray) -> np.ndarray:
    padded = np.concatenate([cls, np.zeros(WINDOW, np.int8)])
    return padded[starts[:, None] + np.arange(WINDOW)]


def tags_of(n: int, spans) -> np.ndarray:
    """BIO tags of a text; of overlapping spans the first by (start, kind)."""
    tags, end = np.zeros(n, np.int8), 0
    for s, k, e in spans:
        if s >= end:
            tags[s:e] = 2 + 2 * k
            tags[s] = 1 + 2 * k
            end = e
    return tags


def spans_of(tags: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, kind, end) runs of tags."""
    out = []
    for i in np.flatnonzero(tags % 2 == 1).tolist():
        k, e = (int(tags[i]) - 1) // 2, i + 1
        while e < len(tags) and tags[e] == 2 + 2 * k:
            e += 1
        out.append((i, k, e))
    return out


def generated(n: int = GENERATED, seed: int = 42) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Labelled lines by rule, each with one span of a kind in turn."""
    r = np.random.default_rng(seed)

    def word(lo=2, hi=9):
        return "".join(r.choice(list("abcdefghijklmnopqrstuvwxyz"), r.integers(lo, hi)))

    def num(k):
        return "".join(map(str, r.integers(0, 10, k)))
    out = []
    for i in range(n):
        kind = i % 5
        if kind == 0:
            s = f"{word()}{r.choice(['.', '_', '', '-'])}{word(1, 6)}{num(r.integers(0, 3))}@{word()}{r.choice(['', num(1)])}.{word(2, 5)}"
            s += r.choice(["", ".com", ".org"])
        elif kind == 1:
            s = ".".join(str(x) for x in r.integers(0, 256, 4))
        elif kind == 2:
            d = num(r.integers(13, 19))
            d += next(c for c in "0123456789" if luhn(d + c))
            gap = r.choice(["", "", " ", "-"])
            s = gap.join(d[j:j + 4] for j in range(0, len(d), 4))
        elif kind == 3:
            plus = r.choice(["+", "+", "", "00"])
            a, b, c, d = num(r.integers(1, 3)), num(3), num(3), num(4)
            s = plus + r.choice([f"{a} ({b}) {c}-{d}", f"{a}-{b}-{c}-{d}", f"{a}.{b}.{c}.{d}", f"{a} {b} {c} {d}"])
        else:
            s = r.choice([num(r.integers(1, 8)), f"{num(2)}.{num(2)}", f"v{num(1)}.{num(1)}.{num(2)}", f"{num(4)}-{num(2)}-{num(2)}",
                          f"{num(2)}:{num(2)}", "@" + word(), f"{word()}={num(3)}{word()}{num(5)}"])
        before = " ".join(word() for _ in range(r.integers(0, 4)))
        before += " " if before else ""
        line = f"{before}{s}{r.choice(['', '.', ',', ';'])} {word()} {word()}"
        out.append((line, [] if kind == 4 else [(len(before), kind, len(before) + len(s))]))
    return out


def training_windows(docs: DataFrame, text: str = "text", limit: int = TRAIN_WINDOWS, seed: int = 42) -> DataFrame:
    """(win binary, tags binary): the ``limit`` sign windows with the smallest hashes."""
    def run(batches):
        for b in batches:
            wins, tags = [], []
            for t in b.column(0).to_pylist():
                if may_hold(t):
                    s = t.decode("utf-8", "replace")
                    cls = charlstm.classes(s)
                    starts = window_starts(cls)
                    tag = np.concatenate([tags_of(len(cls), base_spans(s)), np.zeros(WINDOW, np.int8)])
                    for a, w in zip(starts.tolist(), cut_windows(cls, starts)):
                        y = tag[a:a + WINDOW].copy()
                        # a span cut by the window's left edge has no B here
                        if y[0] and y[0] % 2 == 0:
                            run_end = int(np.argmin(np.append(y == y[0], False)))
                            y[:run_end] = 0
                        wins.append(w.tobytes())
                        tags.append(y.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(wins, pa.binary()), pa.array(tags, pa.binary())], names=["win", "tags"])
    return (docs.select(utf8(text).alias("t")).mapInArrow(run, "win binary, tags binary")
            .orderBy(F.xxhash64("win", F.lit(seed)), "win", "tags").limit(limit))


def fit(docs: DataFrame, text: str = "text", limit: int = TRAIN_WINDOWS, seed: int = 42) -> dict[str, np.ndarray]:
    rows = [(bytes(r["win"]), bytes(r["tags"])) for r in training_windows(docs, text, limit, seed).collect()]
    wins = [np.frombuffer(w, np.int8) for w, _ in rows]
    tags = [np.frombuffer(t, np.int8) for _, t in rows]
    for line, spans in generated(seed=seed):
        cls = charlstm.classes(line)
        wins.append(cut_windows(cls, np.zeros(1, np.int64))[0])
        tags.append(np.concatenate([tags_of(len(line), spans), np.zeros(WINDOW, np.int8)])[:WINDOW])
    return charlstm.train(np.stack(wins), np.stack(tags), len(KINDS), EPOCHS, seed=seed)


def reconcile(text: str, base, proposed) -> list[tuple[int, int, int]]:
    """Base spans and the model spans (start, kind, end) that are valid and
    overlap none of them or of each other."""
    busy = bytearray(len(text))
    for s, _, e in base:
        busy[s:e] = b"\1" * (e - s)
    out = list(base)
    for s, k, e in sorted(set(proposed)):
        if not any(busy[s:e]) and valid(k, text[s:e]):
            out.append((s, k, e))
            busy[s:e] = b"\1" * (e - s)
    return sorted(out)


def text_spans(model, texts: list[str]) -> list[tuple[list, list]]:
    """(base spans, all spans) of each text. Windows of all texts are scored
    together; where windows overlap each character takes its scores from the one
    in which it is farther from an edge, and one pass decodes each stretch of
    overlapping windows, so a span may be of any length."""
    base, wins, first, last, begin, text = [], [], [], [], [], []
    for i, s in enumerate(texts):
        cls = charlstm.classes(s)
        a = decoded_starts(cls)
        base.append(base_spans(s))
        if not len(a):
            continue
        wins.append(cut_windows(cls, a))
        new = np.concatenate([[True], np.diff(a) > STRIDE])
        end = np.append(new[1:], True)
        margin = (WINDOW - STRIDE) // 2
        first.append(np.where(new, 0, margin))
        last.append(np.minimum(np.where(end, WINDOW, WINDOW - margin), len(cls) - a))
        # the last window of a text may lie in what the one before it gives
        last[-1] = np.maximum(last[-1], first[-1])
        begin += a[new].tolist()
        text += [(i, bool(x)) for x in new]
    proposed: list[list] = [[] for _ in texts]
    if wins:
        run = np.cumsum([x for _, x in text]) - 1
        owner = [i for i, x in text if x]
        for i, at, y in zip(owner, begin, charlstm.decode_runs(model, np.concatenate(wins), np.concatenate(first), np.concatenate(last), run, len(KINDS))):
            if y.any():
                proposed[i] += [(at + s, k, at + e) for s, k, e in spans_of(y)]
    return [(b, reconcile(s, b, p)) for s, b, p in zip(texts, base, proposed)]


SPANS = "array<struct<start:int,kind:string,end:int>>"


def find(docs: DataFrame, model=None, text: str = "text") -> DataFrame:
    """``docs`` with ``base`` and ``found`` (arrays of start, kind, end) added;
    columns that have these names are replaced."""
    model = model or fit(docs, text)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c not in ("base", "found")]
    span = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.string()), ("end", pa.int32())]))
    # windows of so many texts with a sign are decoded together
    group = 256

    def run(batches):
        model = shared.value
        for b in batches:
            col = b.column(text)
            base = [[] for _ in range(b.num_rows)]
            found = [[] for _ in range(b.num_rows)]
            held: list[tuple[int, str]] = []

            def flush():
                for (i, _), (x, y) in zip(held, text_spans(model, [s for _, s in held])):
                    base[i] = [{"start": s, "kind": KINDS[k], "end": e} for s, k, e in x]
                    found[i] = [{"start": s, "kind": KINDS[k], "end": e} for s, k, e in y]
                held.clear()
            size = 0
            for i, t in enumerate(col.cast(pa.binary()).to_pylist()):
                if t and may_hold(t):
                    held.append((i, t.decode("utf-8", "replace")))
                    size += len(t)
                    if len(held) >= group or size > 4 << 20:
                        flush()
                        size = 0
            flush()
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(base, span), pa.array(found, span)],
                                             names=[*kept, "base", "found"])
    schema = T.StructType([*docs.select(*kept).schema, *T.StructType.fromDDL(f"base {SPANS}, found {SPANS}")])
    return docs.select(*kept).mapInArrow(run, schema)


def mask(docs: DataFrame, model=None) -> DataFrame:
    """``docs`` with every span of its text replaced by ``<KIND>`` and n_chars
    counted anew where there is such a column. Null texts stay null, and other
    columns keep their values whatever their names."""
    cols = docs.columns
    hidden, given_back = aside(docs, ["base", "found"])
    found = find(hidden, model)
    # text between spans: from the end of one to the start of the next
    s = F.col("found")
    n = F.size(s)
    part = F.transform(s, lambda x, i: F.concat(
        F.lit("<"), F.upper(x["kind"]), F.lit(">"),
        F.substring(F.col("text"), x["end"] + 1,
                    F.coalesce(F.try_element_at(s, i + 2)["start"], F.char_length("text")) - x["end"])))
    masked = F.when(n == 0, F.col("text")).otherwise(
        F.concat(F.substring(F.col("text"), F.lit(1), F.try_element_at(s, F.lit(1))["start"]), F.array_join(part, "")))
    out = found.withColumn("text", F.when(F.col("text").isNull(), F.col("text")).otherwise(masked))
    if "n_chars" in cols:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars"))
                             .otherwise(F.char_length("text").cast(docs.schema["n_chars"].dataType)))
    return given_back(out.drop("base", "found")).select(*cols)
