"""Free-text extraction operators (N1-N11 building blocks).

Everything is a column expression over the whole text: no Python per row,
no truncation. A long ordered pattern chain is gated by one alternation
test, so text that matches none of the patterns pays for one scan instead
of one per pattern.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicframe.functions.regex import alternation, first_char_prefilter, java_regex, prefix_prefilter, required_literals
from civicframe.functions.strings import squish


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def fold_replace(col, pairs) -> Column:
    """X7 on one value: each (pattern, output) replacement sees the result
    of the previous one."""
    return reduce(lambda acc, pr: F.regexp_replace(acc, F.lit(java_regex(pr[0])), F.lit(pr[1])), pairs, _c(col))


# Literals shorter than this are in too many texts to be worth a test of their
# own; their (short) patterns are tested as they stand.
LONG_LITERAL = 4


def may_match(col, patterns) -> Column:
    """False only for texts that no pattern matches: a text must hold one of
    the literals that a pattern's matches cannot do without (``contains``, no
    regular expression), or match one of the patterns that have no such
    literal. The optional words around the core, which make Java's matcher
    try many ways at every position, are not looked at."""
    c = _c(col)
    words, rest = set(), []
    for p in patterns:
        need = required_literals(p)
        if need and min(map(len, need)) >= LONG_LITERAL:
            words |= need
        else:
            rest.append(p)
    # a literal inside another makes the longer one needless
    words = {w for w in words if not any(v != w and v in w for v in words)}
    tests = [c.contains(w) for w in sorted(words)]
    if rest:
        tests.append(c.rlike(java_regex(alternation(rest))))
    return F.coalesce(reduce(lambda a, b: a | b, tests), F.lit(False))


# Two noncharacters of Unicode, put around matches.
OPEN, CLOSE = "\ufdd0", "\ufdd1"


def extract_and_strip(df: DataFrame, text_col: str, patterns, out: str, map_outputs: bool = True,
                      drop_empty: bool = True) -> DataFrame:
    """Pull every match of ``patterns`` out of ``text_col`` into ``out``
    (``array<string>``), map each match to its standard output, remove the
    matches from the text and squish it. An emptied text is ``""``; with
    ``drop_empty`` such rows are dropped (R: blank to NA, then filter).

    ``patterns`` is a regular expression or a list of (pattern, output)
    pairs; with pairs the alternation is tried left to right at each
    position, like the R original, and each match is mapped with the ordered
    replacement chain.

    Needed literals (:func:`may_match`) gate the step: text without one is
    only squished. Other text is scanned once: each match is put between two
    marks, and matches and remaining text are read off the marked text. A text
    that holds a mark itself is scanned for each of the two. The alternation
    carries a look-ahead on how matches start (:func:`prefix_prefilter`,
    or :func:`first_char_prefilter` where that is unknown), which skips
    positions no match can start at. Chained calls pass ``drop_empty=False``
    and drop once at the end with :func:`drop_emptied`.
    """
    if isinstance(patterns, str):
        alt, pairs = java_regex(patterns), None
        # a scan for one character class where the pattern cannot do without a digit
        gate = _c(text_col).rlike(r"(?U)\d") if r"\d" in patterns and not required_literals(patterns) else F.lit(True)
    else:
        pairs = list(patterns)
        alt = java_regex(alternation([p for p, _ in pairs]))
        gate = may_match(text_col, [p for p, _ in pairs])
    ahead = prefix_prefilter(alt)
    alt = ahead if ahead != alt else first_char_prefilter(df.sparkSession, alt)
    text, marked = F.col(text_col), F.col("_marked")
    own_marks = text.contains(OPEN) | text.contains(CLOSE)
    between = f"{OPEN}([^{CLOSE}]*){CLOSE}"
    found = F.when(own_marks, F.regexp_extract_all(text, F.lit(alt), 0)).otherwise(F.regexp_extract_all(marked, F.lit(between), 1))
    if pairs and map_outputs:
        found = F.transform(found, lambda s: fold_replace(s, pairs))
    left = F.when(own_marks, F.regexp_replace(text, F.lit(alt), F.lit(""))).otherwise(F.regexp_replace(marked, F.lit(between), F.lit("")))
    # null where there is no match, so that such text is only squished
    scan = F.regexp_replace(text, F.lit(alt), F.lit(f"{OPEN}$0{CLOSE}"))
    res = df.withColumn("_marked", F.when(gate, scan)) \
        .withColumn("_marked", F.when(marked.contains(OPEN) | own_marks, marked)).withColumns({
            out: F.when(marked.isNotNull(), found).otherwise(F.array().cast("array<string>")),
            text_col: F.when(marked.isNotNull(), squish(left)).otherwise(squish(text)),
        }).drop("_marked")
    return drop_emptied(res, text_col) if drop_empty else res


def gated_fold_replace(col, pairs) -> Column:
    """:func:`fold_replace`, run only on text that may match one of the
    patterns. A replacement cannot make a later pattern match in a text that
    held none of the needed literals: it never ran."""
    c = _c(col)
    return F.when(may_match(c, [p for p, _ in pairs]), fold_replace(c, pairs)).otherwise(c)


def drop_emptied(df: DataFrame, text_col: str) -> DataFrame:
    """Drop rows whose text is null or empty.

    A ``where`` here would be pushed by Catalyst below every cleaning step,
    with each step's expression substituted into the condition, so the
    whole regex chain would run twice (once in the filter, once in the
    projections). Emitting each row through ``inline`` of a zero-or-one
    element array drops the row in place, after the chain ran once.
    """
    keep = F.when(F.coalesce(F.col(text_col) != F.lit(""), F.lit(False)),
                  F.array(F.struct(*[F.col(c) for c in df.columns])))
    return df.select(F.inline(keep))
