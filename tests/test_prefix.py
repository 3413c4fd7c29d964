"""The look-ahead on how matches start, and marks around matches, change no result."""

import random
import re

import pytest
from pyspark.sql import functions as F

from civicframe.functions import note_lookups as L
from civicframe.functions.regex import alternation, first_char_prefilter, java_regex, match_starts, prefix_prefilter
from civicframe.operators.text import CLOSE, OPEN, extract_and_strip

TABLES = {"status": L.STATUS_TAGS, "visits": L.VISIT_TYPES, "contacts": L.CONTACTS, "inspectors": L.inspector_pairs()}


def notes(pairs, n=400):
    """Texts of words of the patterns, whole and cut, in random order."""
    rng = random.Random(7)
    words = sorted({w for p, _ in pairs for w in re.findall(r"[a-z0-9]+", p)}) + [" ", "é", "1", "-", ""]
    out = []
    for _ in range(n):
        got = [rng.choice(words) for _ in range(rng.randint(0, 25))]
        got = [w[:rng.randint(1, 9)] if w and rng.random() < 0.1 else w for w in got]
        out.append(rng.choice([" ", " ", "  ", ""]).join(got))
    return out


def phrases(pairs):
    """Texts that the patterns match: optional parts taken and left out."""
    out = []
    for p, _ in pairs:
        for keep in (True, False):
            t = p
            while True:
                new = re.sub(r"\(([^()]*)\)(\?)?", lambda m: (m[1].split("|")[0] if keep or not m[2] else ""), t)
                if new == t:
                    break
                t = new
            out.append(re.sub(r"\\b|\.\*|\?|\^|\$|\[|\]|\+", "", t))
    return out


@pytest.mark.parametrize("name", sorted(TABLES))
def test_same_matches(spark, name):
    pairs = TABLES[name]
    plain = java_regex(alternation([p for p, _ in pairs]))
    ahead = prefix_prefilter(plain)
    assert ahead != plain
    texts = notes(pairs) + phrases(pairs) + [" and ".join(phrases(pairs))]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", F.regexp_extract_all("t", F.lit(plain), 0).alias("a"), F.regexp_extract_all("t", F.lit(ahead), 0).alias("b")).collect()
    assert sum(len(r.a) for r in got) > len(pairs) / 2
    for r in got:
        assert r.a == r.b, r.t


def test_starts():
    assert match_starts("ab(c|d)e?f") == {"abcef", "abcf", "abdef", "abdf"}
    assert match_starts(r"\bnj\b|n(o)?t") == {"nj", "nt", "not"}
    assert match_starts("sh[le]+by") == {"shl", "she"}
    assert match_starts("a{2,3}b") == {"a"}
    assert match_starts("(x )?") is None and match_starts(r"\d+a") is None and match_starts("[^a]b") is None
    assert prefix_prefilter(r"(?U)\d+") == r"(?U)\d+"


@pytest.mark.parametrize("patterns", [L.STATUS_TAGS, L.PHONE, L.DATE])
def test_extract_and_strip_reads_off_marks(spark, patterns):
    """Equal to a scan for matches and one for the rest, also for null and
    empty text and text that holds the marks."""
    many = not isinstance(patterns, str)
    base = ["no violation found", "", None, "the yard is cut no one home", "901-555-0134 on 3/14/2023 no", "nothing here",
            f"vacant lot{OPEN} 555-0199", f"{CLOSE}no response{OPEN}x{CLOSE}nj", f"{OPEN}only marks{CLOSE}", "4/5/22 4/6/22"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(base)], "i int, t string")
    alt = java_regex(alternation([p for p, _ in patterns]) if many else patterns)
    alt = first_char_prefilter(spark, alt)
    want = df.select("i", F.coalesce(F.regexp_extract_all("t", F.lit(alt), 0), F.array().cast("array<string>")).alias("x"),
                     F.trim(F.regexp_replace(F.regexp_replace("t", F.lit(alt), F.lit("")), r"(?U)\s+", " ")).alias("t"))
    got = extract_and_strip(df, "t", patterns, "x", map_outputs=False, drop_empty=False).select("i", "x", "t")
    assert sorted(got.collect(), key=lambda r: r.i) == sorted(want.collect(), key=lambda r: r.i)
