"""Smaller operators: positional labels, address matching, regex semi join,
layer catalog, column helpers."""

import pytest
from pyspark.sql import functions as F

from civicframe.operators import columns as C
from civicframe.operators import joins as J
from civicframe.plans.boundaries import layer_catalog, zip_prefix
from civicframe.sources.readers import with_bbox


def test_label_by_position(spark):
    df = spark.createDataFrame([(1, 10), (3, 30), (4, 40)], "i int, v int")
    out = {r.i: r.year for r in C.label_by_position(df, "i", ["2019", "2020", "2021"], "year").collect()}
    assert out == {1: "2019", 3: "2021", 4: None}


def test_address_to_parcel(spark):
    req = spark.createDataFrame([("r1", "123 North Main Street"), ("r2", "9 Oak Ave."), ("r3", "1 Nowhere Rd")],
                                "req string, addr string")
    par = spark.createDataFrame([("p1", "123 N MAIN ST"), ("p2", "9 OAK AVENUE")], "parcel string, paddr string")
    out = {r.req: r.parcel for r in J.address_to_parcel(req, par, "addr", "paddr").collect()}
    assert out == {"r1": "p1", "r2": "p2", "r3": None}


def test_keep_matching_any(spark):
    names = spark.createDataFrame([("B25003_001",), ("B25003A_001",), ("B01001_001",)], "name string")
    pats = spark.createDataFrame([("^B25003",), ("^C25",)], "p string")
    assert sorted(r.name for r in J.keep_matching_any(names, "name", pats, "p").collect()) == ["B25003A_001", "B25003_001"]
    lit = spark.createDataFrame([("B01001_001",)], "p string")
    assert [r.name for r in J.keep_matching_any(names, "name", lit, "p", literal=True).collect()] == ["B01001_001"]


def test_semi_join_contains_matches_brute_force(spark):
    texts = ["the quick brown fox", "lazy dog", None, "über straße", "", "a  b c d", "one two three four five", "xone two three four fivex",
             "one  two three four five", "item1 item2", "abcdefghijkl", "two three"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    for items in ([None], [""], ["brown f", "straße"], ["one two three four five", "  b c "], ["e two three four f", "abcdefghij", "z"],
                  ["two three", "a", "dog"], [" ", "item1", "hijkl"], ["a  b c d"]):
        it = spark.createDataFrame([(i,) for i in items] * 2, "t string")
        got = sorted(r.id for r in J.semi_join_contains(docs, "text", it, "t", "id").collect())
        want = [i for i, t in enumerate(texts) if t is not None and any(x is not None and x in t for x in items)]
        assert got == want, items


def test_layer_catalog_and_zip(spark):
    schema = "id string, name string, rings array<array<struct<x:double,y:double>>>"
    sq = [[{"x": 0.0, "y": 0.0}, {"x": 1.0, "y": 0.0}, {"x": 1.0, "y": 1.0}, {"x": 0.0, "y": 0.0}]]
    zips = with_bbox(spark.createDataFrame([("1", "38103", sq), ("2", "72301", sq)], schema))
    tracts = with_bbox(spark.createDataFrame([("3", "Tract 1", sq)], schema))
    assert zip_prefix(zips, "name", ["38", "72"]).count() == 2
    cat = layer_catalog([("ZCTAs", zip_prefix(zips, "name", "381"), "name", False), ("Tracts", tracts, "name", True)])
    rows = sorted((r.group, r.label, r.visible) for r in cat.collect())
    assert rows == [("Tracts", "Tract 1", True), ("ZCTAs", "38103", False)]


def test_select_spec_and_positional(spark):
    df = spark.createDataFrame([(1, 2, 3, 4, 5)], "a int, RESOLUTION_CODE int, b int, RESOLUTION_SUMMARY int, c_DATE int")
    assert C.select_spec(df, "a", "RESOLUTION_CODE:RESOLUTION_SUMMARY", "_DATE$").columns == \
        ["a", "RESOLUTION_CODE", "b", "RESOLUTION_SUMMARY", "c_DATE"]
    assert C.rename_positional(df, ["x", "y"]).columns[:3] == ["x", "y", "b"]
    assert C.rename_positional(df, ["x", "y", "z"], [1, 2, 5]).columns == ["x", "y", "b", "RESOLUTION_SUMMARY", "z"]
    assert C.rename_positional(df, ["only"], [2]).columns[1] == "only"
    assert C.drop_matching(df, prefix="RESOLUTION_").columns == ["a", "b", "c_DATE"]
    assert C.relocate(df, ["c_DATE"], after="a").columns == ["a", "c_DATE", "RESOLUTION_CODE", "b", "RESOLUTION_SUMMARY"]


def test_not_in_keeps_null(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "s string")
    assert sorted((r.s or "NA") for r in df.where(C.not_in("s", ["a"])).collect()) == ["NA", "b"]
    assert df.where(C.matches("s", "[:alpha:]")).count() == 2


def test_if_else_missing(spark):
    df = spark.createDataFrame([(1,), (-1,), (None,)], "x int")
    out = [r.y for r in df.select(C.if_else(F.col("x") > 0, "pos", "neg", "missing").alias("y")).collect()]
    assert out == ["pos", "neg", "missing"]


def test_pattern_lists_of_any_size(spark, monkeypatch):
    import re
    texts = [f"doc {i} mentions item{i % 7} in part {i * 31 % 97}" for i in range(60)] + [None, "", "line\nbreak x", "AbC", "aa bb aa", "tab\there", "a(b)c"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    lists = (["item[13] in", "item5.*part 4\\d$"], ["^$"], ["(a|b)b?c*", "mentions (item2|item3) in part"], [r"(\w+) bb \1", "[xyz]$", None],
             ["(?i)abc", "zzz"], [r"a\(b\)c", "item6? in part 9"], ["nowhere at all in any text"], [], ["x+y*|tab"], [f"part {i}\\b" for i in range(60)])
    for size in (1 << 16, 3):
        monkeypatch.setattr(J, "PATTERN_BLOCK_BYTES", size)
        for pats in lists:
            table = spark.createDataFrame([(p,) for p in pats] * 2, "p string")
            want = [i for i, t in enumerate(texts) if t is not None and any(p is not None and re.search(p, t) for p in pats)]
            assert sorted(r.id for r in J.keep_matching_any(docs, "text", table, "p").collect()) == want, pats


def test_required_literal(spark):
    import re
    cases = {"^B25003": "B25003", "ab?c": "c", "ab+cd": "cd", "a|b": None, "(x|y)long word": "long word", "[abc]{2}tail": "tail", r"\d+ Main St\.": " Main St",
             r"\x41b": None, "(?i)abc": None, "x{0,2}yz": "yz", ".*": None, "ab*?c": "c", "((a)(b(c)))d": "d", r"\(lit\)": "lit", r"\Qa.b\E": None}
    df = spark.createDataFrame([(p,) for p in cases], "p string")
    got = {r.p: r.lit for r in df.select("p", J.required_literal("p").alias("lit")).collect()}
    assert {p: v and v.strip() for p, v in got.items()} == {p: v and v.strip() for p, v in cases.items()}
    for p, lit in got.items():
        if lit:
            for t in ("B25003x", "c abc ac", "abbbcd", "xlong word", "aatail", "12 Main St.", "xyz yz", "abbc c", "abcd", "(lit)"):
                assert not re.search(p, t) or lit in t


def test_containment_keeps_rows_by_text_and_not_by_id(spark):
    rows = [(1, "it holds the needle here"), (1, "it does not"), (None, "the needle too"), (None, None), (2, "the needle too")]
    docs = spark.createDataFrame(rows, "id int, text string")
    items = spark.createDataFrame([("needle",)], "t string")
    got = sorted(map(str, J.semi_join_contains(docs, "text", items, "t", "id").collect()))
    assert got == sorted(map(str, docs.where("text like '%needle%'").collect()))


def test_containment_is_linear_in_the_text(spark):
    import time

    import numpy as np
    r = np.random.default_rng(0)
    words = [f"w{i}" for i in range(3000)]
    items = spark.createDataFrame([(" ".join(r.choice(words, 8)),) for _ in range(50)] + [("zzzz qq",)], "t string").cache()

    def seconds(n):
        docs = spark.createDataFrame([(i, " ".join(r.choice(words, n))) for i in range(4)], "id int, text string").cache()
        docs.count()
        best = 1e9
        for _ in range(2):
            t = time.time()
            J.semi_join_contains(docs, "text", items, "t", "id").count()
            best = min(best, time.time() - t)
        return best
    seconds(500)
    assert seconds(20_000) < 4.5 * max(seconds(5_000), 0.8)


def test_small_aggregates(spark):
    from civicframe.operators import aggregate as A
    df = spark.createDataFrame([("u1", "d1", 1, 10.0), ("u1", "d1", 1, 20.0), ("u1", "d2", 2, 30.0),
                                ("u2", "d3", 1, 40.0)], "user string, day string, wd int, v double")
    m = {r.wd: (r.mean_total, r.n) for r in A.two_level_mean(df, ["user", "day", "wd"], ["wd"], "v").collect()}
    assert m == {1: (35.0, 2), 2: (30.0, 1)}
    assert {r.user: r.debt for r in A.shortfall(df, ["user"], "v", 25.0).collect()} == {"u1": 15.0, "u2": -15.0}
    f = A.frequency(df, ["user"]).collect()
    assert [(r.user, r.n) for r in f] == [("u1", 3), ("u2", 1)]
    assert [r.user for r in A.repeated_groups(df, ["user"]).collect()] == ["u1"]


def test_estimate_dictionary_join_golden(spark):
    """The page's example: estimates joined to the variable list on
    variable = name, estimate and moe moved after the concept."""
    est = spark.createDataFrame([("01", "Alabama", "B01001A_029", 202185, 591), ("02", "Alaska", "B01001A_029", 21447, 201),
                                 ("04", "Arizona", "B01001A_029", 323192, 1049), ("05", "Arkansas", "B01001A_029", 132389, 444)],
                                "GEOID string, NAME string, variable string, estimate long, moe long")
    v21 = spark.createDataFrame([("B01001A_029", "Estimate!!Total:!!Female:!!65 to 74 years", "SEX BY AGE (WHITE ALONE)",
                                  "block group"), ("B01001A_030", "Estimate!!Total:!!Female:!!75 to 84 years",
                                                   "SEX BY AGE (WHITE ALONE)", "block group")],
                                "name string, label string, concept string, geography string")
    joined = J.left_join_keys(est, v21.drop("geography"), "variable", "name", small_right=True)
    joined = C.relocate(joined, ["estimate", "moe"], after="concept")
    assert joined.columns == ["GEOID", "NAME", "variable", "label", "concept", "estimate", "moe"]
    rows = sorted(tuple(r) for r in joined.collect())
    assert rows[0] == ("01", "Alabama", "B01001A_029", "Estimate!!Total:!!Female:!!65 to 74 years",
                       "SEX BY AGE (WHITE ALONE)", 202185, 591)
    assert [r[0] for r in rows] == ["01", "02", "04", "05"]


def test_nearest_address_against_brute_force(spark):
    import random
    r = random.Random(4)
    streets = ["Union Avenue", "Poplar Ave", "Jackson Street", "Madison Rd", "North Parkway", "Lamar", "Elm", "Popular Ave"]

    def wrong(s):
        i = r.randrange(len(s))
        return r.choice([s[:i] + s[i + 1:], s[:i] + "q" + s[i:], s])
    parcels = [(i, f"{r.randint(1, 6)} {r.choice(streets)}") for i in range(60)] + [(100, "no number"), (101, None), (102, "")]
    reqs = [(i, wrong(f"{r.randint(1, 7)} {r.choice(streets)}")) for i in range(80)] + [(200, None), (200, "3 Elm"), (200, "3 Elm")]
    p = spark.createDataFrame([(*x, "t") for x in parcels], "pid int, paddr string, kind string")
    q = spark.createDataFrame(reqs, "rid int, addr string")
    norm = {x.a: x.n for x in q.select(F.col("addr").alias("a")).union(p.select("paddr")).select("a", J.normalise_address("a").alias("n")).distinct().collect()}

    def split(a):
        n, _, s = (norm[a] or "").partition(" ")
        return (n, s) if n.isdigit() and s else (None, None)

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]
    want = []
    for rid, a in reqs:
        n, s = split(a)
        best = min(((edits(s, t), pid) for pid, b in parcels for m, t in [split(b)] if n and m == n
                    and {s[i:i + 3] for i in range(len(s) - 2)} & {t[i:i + 3] for i in range(len(t) - 2)} and edits(s, t) <= 0.25 * len(s)), default=(None, None))
        want.append((rid, a, best[1], "t" if best[1] is not None else None, best[0]))
    got = J.nearest_address(q, p, "addr", "paddr", "pid")
    assert got.columns == ["rid", "addr", "pid", "kind", "distance"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_nearest_address_of_one_busy_number(spark):
    """Very many streets of one house number with a long ending in common: the
    work grows with the rows, not with their pairs (which took minutes), and streets more
    edits off are found in later rounds."""
    import random
    import time
    r = random.Random(2)
    names = sorted({"".join(r.choice("ABCDEFGHIJKLM") for _ in range(9)) for _ in range(5000)})
    tail = " FOREST HILL SQUARE"
    p = spark.createDataFrame([(i, f"7 {n}{tail}") for i, n in enumerate(names * 2)], "pid int, paddr string")
    reqs = [(i, f"7 {n[:2]}{n[3:]}{tail}") for i, n in enumerate(names * 2)]
    far = [(-1, f"7 {names[5]} FARST HELL SQARE", (5, 4)), (-2, f"7 {names[9]} FARST HELL SQRE", (9, 5)), (-3, "7 ZZZZ", (None, None)), (-4, "7 FO", (None, None))]
    q = spark.createDataFrame(reqs + [x[:2] for x in far], "rid int, addr string")
    start = time.time()
    got = {x.rid: (x.pid, x.distance) for x in J.nearest_address(q, p, "addr", "paddr", "pid").collect()}
    assert time.time() - start < 90
    assert len(got) == len(reqs) + len(far) and all(got[x[0]] == x[2] for x in far), [got[x[0]] for x in far]
    assert all(got[i][1] == 1 and got[i][0] < len(names) for i, _ in reqs)


def test_patterns_of_one_literal_stand_in_blocks(spark, monkeypatch):
    """Many patterns with the same literal: candidates are a text with a block
    of patterns, not each of its pairs; own group names and numbers keep to their pattern."""
    texts = spark.createDataFrame([(i, f"w{i % 50} box LARGE Brand#7 no {i}") for i in range(300)] + [(900, "aa LARGE Brand#7 no aa")], "id int, text string")
    pats = [f"^w{j} [a-z]+ LARGE Brand#7 no [0-9]*{d}$" for j in range(40) for d in range(5)] + [r"^(?<x>a)[a-z] LARGE Brand#7 no (?<y>a)a", r"^(?<x>b) LARGE Brand#7 no 1"]
    sizes, candidates = [], J._candidates

    def counted(*args):
        got = candidates(*args)
        sizes.append(got.count())
        return got
    monkeypatch.setattr(J, "_candidates", counted)
    got = sorted(r.id for r in J.keep_matching_any(texts, "text", spark.createDataFrame([(x,) for x in pats], "p string"), "p").collect())
    assert got == [i for i in range(300) if i % 50 < 40 and i % 10 < 5] + [900]
    assert sum(sizes) <= 2 * 301, sizes
