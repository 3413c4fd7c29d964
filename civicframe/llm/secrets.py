"""Secret scans: exact base patterns plus assignment-aware lexing.

The lexer reads the assignment syntaxes of source and configuration files
(``name = literal``, ``name: literal``, ``"name": "literal"``, ``name := ...``,
``name => ...``, ``export NAME=...``, XML and command line attributes) into
(name, expression) pairs. An expression is a chain of quoted literals, bare
words and names joined by ``+`` or ``.``; names are replaced by the literals
bound to them earlier in the text, through any number of steps, so a secret is
reported where its literal stands, under every name it reaches. Each
literal is scored by the most sensitive name it is assigned to, and by the
look of the whole value there (length, variety of characters, no placeholder
words). Only what the look needs is kept of a joined value, and scores go back
from a value to its parts once, so values of any length and any number of
parts and steps take time in proportion to the text.

Base patterns are matched only in texts that have their fixed signs (``=`` or
``:``, ``AKIA``, a run of 32 hex digits), which every match needs.

Defined cases: null and empty texts have no span; repeated rows repeat their
results; offsets are code points, end exclusive; unbalanced quotes end at the
line; a name bound again takes the later literal from there on, cycles cannot
arise as only earlier bindings are seen; texts of any length are read whole; extra columns are kept.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "literal")

_HEX_BYTES = bytes(120 if 48 <= c <= 57 or 97 <= c <= 102 else 32 for c in range(256))
_RUN = b"x" * 32

SIGN = re.compile(r":=|=>|[:=]")
NAME_BEFORE = re.compile(r"[A-Za-z_$][A-Za-z0-9_.$-]*\Z")
NOT_NAME = re.compile(r"[^A-Za-z0-9_.$-]")
OPERAND = re.compile(r"""\x20*(?:"((?:[^"\\\n]|\\.)*)"|'((?:[^'\\\n]|\\.)*)'|([A-Za-z0-9_$][A-Za-z0-9+/_.$=-]*))""")
JOIN = re.compile(r"\x20*[+.]\x20*(?=[\"'A-Za-z_$])")

# How much a part of a name, or two neighbouring parts, say that its value is secret.
SENSITIVE = {"password": 1.0, "passwd": 1.0, "pwd": 0.9, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.9,
             "credentials": 0.9, "private": 0.6, "key": 0.5, "auth": 0.6, "bearer": 0.8, "signature": 0.5, "salt": 0.5, "cert": 0.4,
             "privatekey": 0.95, "signingkey": 0.95, "accesskey": 0.95, "authkey": 0.95, "encryptionkey": 0.95}
PLACEHOLDER = re.compile(r"example|changeme|placeholder|your[_-]?|dummy|xxxx|\*\*\*|<.*>|\$\{", re.I)
EDGE = 10  # a placeholder word over the seam of two parts lies within so many characters of it
# Low enough for the weakest name with a literal of mixed characters, and for
# the strong names with digits or small letters only.
MIN_SCORE = 0.35
MIN_LENGTH = 8
HUGE = 1 << 200


def assigns(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in ASSIGN.finditer(text) if len(m[2]) >= 8]


def accesses(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]


def hexes(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in HEX.finditer(text)]


def name_weight(name: str) -> float:
    """Largest weight of a name's parts (cut at signs and capitals)."""
    parts = re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+", name)
    words = [p.lower() for p in parts] + [re.sub("[^a-z]", "", name.lower())]
    words += [a + b for a, b in zip(words, words[1:])]
    return max((SENSITIVE.get(w, 0.0) for w in words), default=0.0)


def kind(c: str) -> str:
    """Kind of a character; the signs that join the words of a name are none."""
    return "0" if "0" <= c <= "9" else "a" if "a" <= c <= "z" else "A" if "A" <= c <= "Z" else "" if c in "-_." else "."


class Look:
    """What the score needs of a value; looks of joined values add up."""

    __slots__ = ("n", "chars", "head", "tail", "open", "close", "never")

    def __init__(self, s: str = ""):
        self.n, self.chars, self.head, self.tail = len(s), Counter(s), s[:EDGE], s[-EDGE:]
        self.open, self.close = "<" in s, ">" in s
        self.never = bool(PLACEHOLDER.search(s)) or any(c.isspace() for c in self.chars)

    def add(self, o: Look):
        self.never |= o.never or (self.open and o.close) or bool(PLACEHOLDER.search(self.tail + o.head))
        self.open |= o.open
        self.close |= o.close
        self.n += o.n
        self.chars.update(o.chars)
        self.head = self.head if len(self.head) == EDGE else (self.head + o.head)[:EDGE]
        self.tail = (self.tail + o.tail)[-EDGE:]
        if self.n > HUGE:  # only the shares matter
            self.chars = Counter({c: max(1, k >> 100) for c, k in self.chars.items()})
            self.n = self.chars.total()

    def weight(self) -> float:
        """0 to 1: how much the value looks like a secret."""
        if self.n < MIN_LENGTH or self.never:
            return 0.0
        n = self.n
        bits = -sum(c / n * math.log2(c / n) for c in self.chars.values())
        kinds = {kind(c) for c in self.chars} - {""}
        return min(1.0, bits / 3.0) * (1.0 if len(kinds) >= 2 else 0.5)


def literal_weight(s: str) -> float:
    """0 to 1: how much a literal looks like a secret."""
    return Look(s).weight()


class Value:
    """What a name is assigned: literals (start, end) and earlier values."""

    __slots__ = ("name", "look", "literals", "values")

    def __init__(self, name: str):
        self.name, self.look, self.literals, self.values = name, Look(), [], []


def name_before(text: str, end: int) -> str | None:
    """The name that stands before a sign, of any length: looked for in
    stretches that double until the name's start is seen."""
    width = 128
    while True:
        low = max(0, end - width)
        left = text[low:end].rstrip(" ")
        if left[-1:] in ("\"", "'", "`"):
            left = left[:-1]
            if not left and low:
                width *= 2
                continue
        if not low or NOT_NAME.search(left):
            nm = NAME_BEFORE.search(left)
            return nm[0] if nm else None
        width *= 2


def assigned(text: str) -> list[Value]:
    """Every assignment of literals to a name, in order, constants propagated."""
    bound: dict[str, Value] = {}
    out = []
    at = 0
    while m := SIGN.search(text, at):
        at = m.end()
        name = name_before(text, m.start())
        if name is None:
            continue
        got, pos = Value(name), m.end()
        while o := OPERAND.match(text, pos):
            pos = o.end()
            k = next(i for i in (1, 2, 3) if o[i] is not None)
            v = o[k]
            if k == 3 and v in bound:
                got.values.append(bound[v])
                got.look.add(bound[v].look)
            elif k < 3 or not re.fullmatch(r"[A-Za-z_$]+(?:\.[A-Za-z_$]+)*", v) or name_weight(got.name) >= 1.0:
                got.literals.append(o.span(k))
                got.look.add(Look(v))
            j = JOIN.match(text, pos)
            if not j:
                break
            pos = j.end()
        if not got.literals and not got.values:
            continue
        bound[got.name] = got
        out.append(got)
        # the right side may itself be a pair (``x: token = ...``): go on after the sign
    return out


def scored(text: str) -> list[tuple[int, int, float, str]]:
    """(start, end, score, name) of each literal, by its most sensitive name."""
    best: dict[tuple[int, int], tuple[float, str]] = {}
    reached: dict[int, tuple[float, str]] = {}
    values = assigned(text)
    for v in reversed(values):  # a value is used by later ones only
        w = name_weight(v.name)
        top = max((w * v.look.weight() if w else 0.0, v.name), reached.get(id(v), (0.0, "")), key=lambda x: x[0])
        if not top[0]:
            continue
        for used in v.values:
            if top[0] > reached.get(id(used), (0.0, ""))[0]:
                reached[id(used)] = top
        for place in v.literals:
            if place[1] > place[0] and top[0] > best.get(place, (0.0, ""))[0]:
                best[place] = top
    return sorted((s, e, sc, n) for (s, e), (sc, n) in best.items())


def spans(text: bytes, min_score: float = MIN_SCORE):
    """(base spans, added spans) as (start, kind number, end), sorted."""
    signs, key, run = b"=" in text or b":" in text, b"AKIA" in text, _RUN in text.translate(_HEX_BYTES)
    if not (signs or key or run):
        return [], []
    s = text.decode("utf-8", "replace")
    found = [assigns(s) if signs else [], accesses(s) if key else [], hexes(s) if run else []]
    base = sorted((a, k, b) for k, places in enumerate(found) for a, b in places)
    if not signs:
        return base, []
    added, end = [], 0
    cover = sorted((a, b) for a, _, b in base)
    i = 0
    for a, b, score, _ in scored(s):
        while i < len(cover) and cover[i][0] <= a:
            end = max(end, cover[i][1])
            i += 1
        if score >= min_score and b > end:  # else it lies in a base span
            added.append((a, 3, b))
    return base, added


SPANS = "array<struct<start:int,kind:string,end:int>>"


def find(docs: DataFrame, min_score: float = MIN_SCORE, text: str = "text") -> DataFrame:
    """``docs`` with ``base`` and ``found`` (arrays of start, kind, end) added;
    columns that have these names are replaced."""
    kept = [c for c in docs.columns if c not in ("base", "found")]
    span = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.string()), ("end", pa.int32())]))

    def run(batches):
        for b in batches:
            base, found = [], []
            for t in b.column(text).cast(pa.binary()).to_pylist():
                x, y = spans(t, min_score) if t else ([], [])
                base.append([{"start": s, "kind": KINDS[k], "end": e} for s, k, e in x])
                found.append([{"start": s, "kind": KINDS[k], "end": e} for s, k, e in sorted(x + y)])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(base, span), pa.array(found, span)],
                                             names=[*kept, "base", "found"])
    schema = T.StructType([*docs.select(*kept).schema, *T.StructType.fromDDL(f"base {SPANS}, found {SPANS}")])
    return docs.select(*kept).mapInArrow(run, schema)
