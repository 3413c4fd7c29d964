"""CHAS tidying on made-up wide tables whose first rows are the page's."""

import os


from civicframe.operators.reshape import wide_to_long
from civicframe.plans import chas as P


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


def make_root(root):
    write(f"{root}/raw/2020/state/Table1.csv",
          "geoid,name,st,cnty,sumlevel,T1_est1,T1_moe1,T1_est2,T1_moe2,T1_est3,T1_moe3\n"
          "47,Tennessee,47,,040,2639455,6787,1756535,10833,313750,4887\n"
          "28,Mississippi,28,,040,1100000,4000,760000,5000,120000,3000\n")
    write(f"{root}/raw/2020/state/Table2.csv",
          "geoid,name,st,cnty,sumlevel,T2_est1,T2_moe1\n47,Tennessee,47,,040,88340,2492\n"
          "28,Mississippi,28,,040,40000,1500\n")
    write(f"{root}/raw/2020/dictionary.csv",
          "variable,description_1,description_2,description_3,description_4,description_5\n"
          "T1_est1,Occupied housing units,All,,,\n"
          "T1_moe1,Occupied housing units,All,,,\n"
          "T1_est2,Owners,All,,,\n"
          "T1_est3,Owners,has 1 or more of the 4 housing unit problems,,,\n"
          "T2_est1,Owners,has 1 or more of the 4 housing unit problems,household income is less-than or = 30% of HAMFI,,\n")
    write(f"{root}/labels.csv",
          "raw,label,concept\nAll,All,\n"
          "has 1 or more of the 4 housing unit problems,1 or more housing problems,Housing Problems\n"
          "household income is less-than or = 30% of HAMFI,0-30% HAMFI,Household Income\n")


def test_wide_to_long_pairs(spark):
    df = spark.createDataFrame([("a", 1, 2, 3, 4)], "geoid string, T1_est1 long, T1_moe1 long, T18C_est12 long, T18C_moe12 long")
    rows = sorted(tuple(r) for r in wide_to_long(df, ["geoid"]).collect())
    assert rows == [("a", "T18C_12", 3, 4), ("a", "T1_1", 1, 2)]


def test_get_chas_first_rows(spark, scratch):
    make_root(scratch)
    tn = P.get_chas(spark, scratch, "state", state="47")
    rows = {r.variable: r for r in tn.collect()}
    r1 = rows["T1_1"]
    assert (r1.year, r1.geography, r1.geoid, r1.name, r1.universe, r1.label, r1.concept, r1.est, r1.moe) == \
        (2020, 40, "47", "Tennessee", "Occupied housing units", "All", "Total", 2639455, 6787)
    assert rows["T1_3"].label == "1 or more housing problems" and rows["T1_3"].concept == "Housing Problems"
    assert rows["T2_1"].label == "1 or more housing problems!!0-30% HAMFI"
    assert rows["T2_1"].concept == "Housing Problems by Household Income"
    assert len(rows) == 4


def test_cache_is_idempotent(spark, scratch):
    make_root(scratch)
    a = P.get_chas(spark, scratch, "state").count()
    # second call reads the cache; forcing another append adds nothing
    from civicframe.sources.sinks import append_to_cache, read_cache
    again = P.tidy_tables(spark, P.list_files(spark, f"{scratch}/raw/2020/state"),
                          spark.read.option("header", True).csv(f"{scratch}/raw/2020/dictionary.csv"),
                          spark.read.option("header", True).csv(f"{scratch}/labels.csv"), 2020)
    append_to_cache(again, f"{scratch}/cache")
    assert read_cache(spark, f"{scratch}/cache").count() == a == 8
    assert P.get_chas(spark, scratch, "state", year=2020).count() == 8
    assert os.path.isdir(f"{scratch}/cache/year=2020/geography=40")


def test_read_wide_tables_and_dictionary(spark, scratch):
    from civicframe.sources.readers import read_dictionary, read_wide_tables
    make_root(scratch)
    paths = P.list_files(spark, f"{scratch}/raw/2020/state")
    long = read_wide_tables(spark, paths, ["geoid", "name"])
    assert long.count() == 8
    assert set(long.columns) == {"geoid", "name", "variable", "est", "moe", "source_file"}
    d = read_dictionary(spark, f"{scratch}/raw/2020/dictionary.csv", ["code", "universe"])
    assert d.columns[:2] == ["code", "universe"] and d.count() == 5


def test_wide_files_of_any_width_and_header(spark, scratch):
    import os
    from civicframe.sources.readers import read_wide_tables
    os.makedirs(f"{scratch}/w")
    n = 5000
    heads = {"Table1.csv": ["geoid", "name", *(f"T1_{k}{i}" for i in range(1, n // 2 + 1) for k in ("est", "moe"))],
             "Table2.csv": ["name", "T2_moe1", "geoid", "T2_est1", "T2_est2", "note"], "Table3.csv": ["geoid", "name", "other"]}
    rows = {"Table1.csv": [[str(g), f"Area {g}", *(str(g * 10000 + i) if i % 7 else "" for i in range(n))] for g in range(3)],
            "Table2.csv": [['"Comma, ""quoted"""', "1", "7", "2", "", "x"], ["", "5", "8", "", "6", '"a,b"']], "Table3.csv": [["1", "n", "z"]]}
    for f, h in heads.items():
        with open(f"{scratch}/w/{f}", "w") as out:
            out.write("\n".join(",".join(r) for r in [h, *rows[f]]) + "\n")
    got = read_wide_tables(spark, [f"{scratch}/w/{f}" for f in heads], ["geoid", "name"]).collect()
    want = {}
    for g in range(3):
        for i in range(n // 2):
            a, b = rows["Table1.csv"][g][2 + 2 * i:4 + 2 * i]
            want["Table1.csv", str(g), f"Area {g}", f"T1_{i + 1}"] = (int(a) if a else None, int(b) if b else None)
    want["Table2.csv", "7", 'Comma, "quoted"', "T2_1"], want["Table2.csv", "7", 'Comma, "quoted"', "T2_2"] = (2, 1), (None, None)
    want["Table2.csv", "8", None, "T2_1"], want["Table2.csv", "8", None, "T2_2"] = (None, 5), (6, None)
    assert len(got) == len(want) and {(r.source_file, r.geoid, r["name"], r.variable): (r.est, r.moe) for r in got} == want
    some = read_wide_tables(spark, [f"{scratch}/w/Table2.csv"], ["geoid", "name"], {"geoid": "8"})
    assert {r.variable for r in some.collect()} == {"T2_1", "T2_2"}
