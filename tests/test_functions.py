"""Scalar functions: regex dialect, title case, times."""

import datetime as dt

from pyspark.sql import functions as F

from civicframe.functions import strings as X
from civicframe.functions import times as T
from civicframe.functions.regex import alternation, java_regex


def one(spark, expr, rows, schema="s string"):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


def test_posix_classes_translate():
    assert java_regex("[:punct:]", unicode=False) == r"\p{P}"
    assert java_regex("[[:punct:]]x", unicode=False) == r"[\p{P}]x"
    assert java_regex("[:symbol:]|;") == r"(?U)\p{S}|;"
    assert alternation(["a", "^b$"]) == "(?:a)|(?:^b$)"


def test_punct_class_does_not_eat_letters(spark):
    # Java reads a bare "[:punct:]" as the letters ":punct"; translated it must
    # leave "call" alone.
    out = one(spark, F.regexp_replace("s", java_regex("[:punct:]"), ""), [("call, now!",)])
    assert out == ["call now"]


def test_title_case(spark):
    out = one(spark, X.title_case("s"), [("(WHITE ALONE) family-owned",), ("homeowner's vacancy",), (None,)])
    assert out == ["(White Alone) Family-Owned", "Homeowner's Vacancy", None]


def test_squish_and_blank(spark):
    out = one(spark, X.squish("s"), [("  a \n\t b  ",)])
    assert out == ["a b"]
    out = one(spark, X.blank_to_null("s"), [("",), ("x",)])
    assert out == [None, "x"]


def test_replace_chain_order(spark):
    pairs = [("a", "b"), ("b", "c")]
    assert one(spark, X.replace_chain("s", pairs), [("ab",)]) == ["cc"]


def test_unicode_word_classes(spark):
    # ICU semantics: an accented letter is a word character, so a leading
    # "^\W+" strip keeps it (plain Java regex would remove it).
    assert one(spark, X.remove_all("s", r"^\W+"), [("... été",)]) == ["été"]
    assert one(spark, X.remove_all("s", r"^\W+"), [("é",)]) == ["é"]


def test_remove_first(spark):
    assert one(spark, X.remove_first("s", "o"), [("foo boo",)]) == ["fo boo"]


def test_week_number_is_not_iso(spark):
    rows = [(dt.date(2024, 1, 1),), (dt.date(2024, 1, 7),), (dt.date(2024, 1, 8),), (dt.date(2024, 12, 31),)]
    assert one(spark, T.week_number("d"), rows, "d date") == [1, 1, 2, 53]


def test_clock_cut_and_unwrap(spark):
    rows = [(dt.datetime(2024, 1, 1, 23, 0, 0),), (dt.datetime(2024, 1, 2, 1, 30, 0),), (dt.datetime(2024, 1, 2, 18, 0, 0),)]
    s = one(spark, T.clock_seconds("t", 64800), rows, "t timestamp")
    assert s == [82800, 5400 + 86400, 64800 + 86400]
    assert one(spark, T.unwrap_clock(F.col("x")), [(91800,), (82800,)], "x int") == [5400, 82800]


def test_readable_duration(spark):
    assert one(spark, T.readable_duration("x"), [(28994.7,)], "x double") == ["8H 3M 14S"]


def test_night_date(spark):
    rows = [(dt.datetime(2024, 1, 5, 8), dt.datetime(2024, 1, 2, 23), dt.datetime(2024, 1, 3, 6)),
            (dt.datetime(2024, 1, 3, 8), dt.datetime(2024, 1, 2, 23), dt.datetime(2024, 1, 3, 6))]
    out = one(spark, T.night_date("c", "s", "e"), rows, "c timestamp, s timestamp, e timestamp")
    assert out == [dt.date(2024, 1, 3), dt.date(2024, 1, 3)]


def test_parse_mdy(spark):
    out = one(spark, T.parse_timestamp("s"), [("03/09/2024 07:27:09 PM",), ("junk",)])
    assert out == [dt.datetime(2024, 3, 9, 19, 27, 9), None]


def test_five_year_label(spark):
    assert one(spark, T.five_year_label("y"), [(2019,)], "y int") == ["2015-2019"]


def test_first_char_prefilter_keeps_matches(spark):
    from civicframe.functions import note_lookups as L
    from civicframe.functions.regex import first_char_prefilter
    texts = [("per a marlow: the tenant said no one home; 2nd attempt made. ja, wrong address given",),
             ("  été: 901-555-1234 on 3/4/24 uncooperative; this sr is cancelled",), ("",), (None,)]
    df = spark.createDataFrame(texts, "s string")
    for pairs in (L.STATUS_TAGS, L.VISIT_TYPES, L.inspector_pairs(), L.CONTACTS, [(L.PHONE, "")], [(L.DATE, "")]):
        alt = java_regex(alternation([p for p, _ in pairs]))
        pre = first_char_prefilter(spark, alt)
        a = [r[0] for r in df.select(F.regexp_extract_all("s", F.lit(alt), 0)).collect()]
        b = [r[0] for r in df.select(F.regexp_extract_all("s", F.lit(pre), 0)).collect()]
        assert a == b
    lb = java_regex("(?<=this )compliant")
    assert first_char_prefilter(spark, lb) == lb


def test_required_literals_are_in_every_match():
    """Strings drawn from the tables' own patterns hold one of the literals."""
    import random
    import re

    from civicframe.functions import note_lookups as L
    from civicframe.functions.regex import required_literals

    assert required_literals("no( )?one (was )?home") == {"one "}
    assert required_literals("a|b") == {"a", "b"} and required_literals("(x)?") is None and required_literals("[ab]+") is None
    random.seed(4)

    def draw(p):
        """A match of a pattern: choices made at random, innermost groups first."""
        p = p.replace(r"\b", "").replace("(?<=this )", "")
        p = re.sub(r"\[([a-z]+)\](\{3,\}|\+)?", lambda m: "".join(random.choice(m[1]) for _ in range(3 if m[2] else 1)), p).replace(".*", "")
        group = re.compile(r"\(([^()]*)\)([?+*]?)")
        while m := group.search(p):
            inner = random.choice(m[1].split("|"))
            inner = re.sub(r"(.)\?", lambda x: random.choice([x[1], ""]), inner)
            p = p[:m.start()] + ("" if m[2] == "?" and random.random() < 0.5 else inner) + p[m.end():]
        return re.sub(r"(.)\?", lambda x: random.choice([x[1], ""]), p)
    for table in (L.TYPOS, L.VISIT_TYPES, L.STATUS_TAGS, L.CONTACTS, L.inspector_pairs()):
        for p, _ in table:
            need = required_literals(p)
            for _ in range(40):
                s = draw(p)
                assert re.search(p.replace("(?<=this )", ""), s), (p, s)
                assert need and any(w in s for w in need), (p, s, need)
