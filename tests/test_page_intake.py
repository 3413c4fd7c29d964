"""Pages that land late, twice, overlapping or broken: each record is taken in
once, and sets that are not whole are told."""

import json
import os
import uuid

from pyspark.sql import types as T

from civicframe.streaming import page_intake as P

RECORD = T.StructType([T.StructField("id", T.LongType()), T.StructField("note", T.StringType())])


def land(folder, pages):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, uuid.uuid4().hex + ".json"), "w") as f:
        f.write("\n".join(p if isinstance(p, str) else json.dumps(p) for p in pages))


def page(s, offset, ids):
    return {"set": s, "offset": offset, "data": [{"id": i, "note": None if i % 2 else f"n{i}"} for i in ids]}


def run(spark, src, out, name):
    P.start_page_intake(spark, src, RECORD, out, name).awaitTermination()


def rows(spark, out):
    return sorted((r.id, r.note) for r in P.intake_rows(spark, out, RECORD).collect())


def sets(spark, out):
    return {r.set: (r.n_pages, r.n_rows, r.end_offset, r.n_missing, r.n_short, r.complete)
            for r in P.page_sets(spark, out, RECORD, page_size=3).collect()}


def test_late_replayed_and_overlapping_pages(spark, scratch):
    src, out, name = f"{scratch}/in", f"{scratch}/out", "pages_" + uuid.uuid4().hex
    land(src, [page("a", 6, [6]), page("a", 0, [0, 1, 2]), page("a", 9, [])])
    run(spark, src, out, name)
    assert rows(spark, out) == sorted((i, None if i % 2 else f"n{i}") for i in (0, 1, 2, 6))
    assert sets(spark, out) == {"a": (2, 4, 9, 1, 0, False)}
    # the lacking page, one replayed and another set that shares records
    land(src, [page("a", 3, [3, 4, 5]), page("a", 0, [0, 1, 2]), page("b", 0, [2, 3, 7])])
    run(spark, src, out, name)
    assert [i for i, _ in rows(spark, out)] == list(range(8))
    assert sets(spark, out) == {"a": (3, 7, 9, 0, 0, True), "b": (1, 3, None, 0, 0, False)}
    land(src, [page("b", 3, [])])
    run(spark, src, out, name)
    run(spark, src, out, name)
    assert sets(spark, out)["b"] == (1, 3, 3, 0, 0, True)
    assert len(rows(spark, out)) == 8


def test_short_grown_broken_and_empty(spark, scratch):
    src, out, name = f"{scratch}/in", f"{scratch}/out", "pages_" + uuid.uuid4().hex
    land(src, [page("short", 0, [1, 2]), page("short", 3, [4, 5, 6]), page("short", 6, []),
               # ended once, then grew and ended again
               page("grown", 3, []), page("grown", 0, [7, 8, 9]), page("grown", 3, [10]), page("grown", 6, []),
               page("none", 0, []), page("odd", 1, [11]), page("odd", 0, [12, 13, 14]), page("odd", 3, []),
               '{"set": "open", "offset": 0, "data"', "not a page", '{"set": "nodata", "offset": 0}',
               '{"set": "x", "offset": 0, "data": [null, {"id": 15}, {"id": 15}]}'])
    run(spark, src, out, name)
    got = sets(spark, out)
    assert got["short"] == (2, 5, 6, 0, 1, False)
    assert got["grown"] == (2, 4, 6, 0, 0, True)
    assert got["none"] == (0, 0, 0, 0, 0, True)
    assert got["odd"][0] == 1 and got["odd"][2:] == (3, 0, 0, True)
    assert got["nodata"][0] == 0 and got["nodata"][-1] is False
    assert got["x"] == (1, 3, None, 0, 0, False)
    assert got[None][-1] is False
    assert [i for i, _ in rows(spark, out)] == [1, 2, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15]


def test_nothing_landed(spark, scratch):
    os.makedirs(f"{scratch}/in")
    run(spark, f"{scratch}/in", f"{scratch}/out", "pages_" + uuid.uuid4().hex)
    assert rows(spark, f"{scratch}/out") == [] and sets(spark, f"{scratch}/out") == {}
