"""Within / intersects on hand-made shapes (sf semantics: boundary contact
counts for intersects; within allows a shared boundary)."""

from fractions import Fraction

from pyspark.sql import functions as F

from civicframe.operators import spatial as S
from civicframe.sources.readers import with_bbox


def poly(*rings):
    return [[{"x": float(x), "y": float(y)} for x, y in r] for r in rings]


ANCHOR = poly([(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)], [(6, 6), (8, 6), (8, 8), (6, 8), (6, 6)])
SHAPES = {
    "inside": poly([(1, 1), (3, 1), (3, 3), (1, 3), (1, 1)]),
    "crossing": poly([(8, 1), (12, 1), (12, 3), (8, 3), (8, 1)]),
    "shared_edge_in": poly([(0, 0), (2, 0), (2, 2), (0, 2), (0, 0)]),
    "shared_edge_out": poly([(10, 0), (12, 0), (12, 2), (10, 2), (10, 0)]),
    "touch_point": poly([(10, 10), (11, 10), (11, 11), (10, 11), (10, 10)]),
    "in_hole": poly([(6.5, 6.5), (7.5, 6.5), (7.5, 7.5), (6.5, 7.5), (6.5, 6.5)]),
    "covers_hole": poly([(5, 5), (9, 5), (9, 9), (5, 9), (5, 5)]),
    "concave_out": poly([(11, 0), (14, 0), (14, 4), (13, 4), (13, 1), (12, 1), (12, 4), (11, 4), (11, 0)]),
    "outside": poly([(20, 20), (21, 20), (21, 21), (20, 21), (20, 20)]),
    "larger": poly([(-1, -1), (11, -1), (11, 11), (-1, 11), (-1, -1)]),
    "bar_across": poly([(-2, 4), (12, 4), (12, 5), (-2, 5), (-2, 4)]),
}


def layers(spark):
    schema = "id string, rings array<array<struct<x:double,y:double>>>"
    layer = with_bbox(spark.createDataFrame(list(SHAPES.items()), schema))
    anchor = with_bbox(spark.createDataFrame([("a", ANCHOR)], schema))
    return layer, anchor


def test_within(spark):
    layer, anchor = layers(spark)
    got = {r.id for r in S.select_by_location(layer, anchor, "within", cell=3.0).collect()}
    assert got == {"inside", "shared_edge_in"}


def test_intersects(spark):
    layer, anchor = layers(spark)
    got = {r.id for r in S.select_by_location(layer, anchor, "intersects", cell=3.0).collect()}
    assert got == {"inside", "crossing", "shared_edge_in", "shared_edge_out", "touch_point", "covers_hole",
                   "larger", "bar_across"}


def test_within_subset_of_intersects_any_cell(spark):
    layer, anchor = layers(spark)
    for cell in (1.0, 4.0, 50.0):
        w = {r.id for r in S.select_by_location(layer, anchor, "within", cell=cell).collect()}
        i = {r.id for r in S.select_by_location(layer, anchor, "intersects", cell=cell).collect()}
        assert w <= i and w == {"inside", "shared_edge_in"}


U = poly([(0, 0), (10, 0), (10, 10), (7, 10), (7, 4), (3, 4), (3, 10), (0, 10)])


def pick(spark, shapes, anchor, predicate):
    schema = "id string, rings array<array<struct<x:double,y:double>>>"
    layer = with_bbox(spark.createDataFrame(list(shapes.items()), schema))
    return {r.id for r in S.select_by_location(layer, with_bbox(spark.createDataFrame([("a", anchor)], schema)), predicate, cell=4.0).collect()}


def box(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]


def test_concave_and_holed(spark):
    shapes = {"notch_filled": poly(box(3, 4, 7, 10)), "full_square": poly(box(0, 0, 10, 10)), "left_arm": poly(box(0, 0, 3, 10)),
              "across_notch": poly(box(1, 5, 9, 6)), "base": poly(box(0, 0, 10, 4)), "same": U,
              "around_notch": poly([(1, 9), (3, 4), (7, 4), (9, 9), (8, 1), (2, 1)]),
              "vertex_exit": poly([(1, 9), (3, 4), (7, 4), (9, 9), (5, 1)]), "vertex_chord": poly([(0, 10), (10, 10), (5, 1)]),
              "in_notch": poly(box(4, 5, 6, 9))}
    assert pick(spark, shapes, U, "within") == {"left_arm", "base", "same", "around_notch"}
    assert pick(spark, shapes, U, "intersects") == set(shapes) - {"in_notch"}
    hole = {"exact_hole": poly(box(6, 6, 8, 8)), "ring_around": poly(box(5, 5, 9, 9), box(6, 6, 8, 8)), "inside_hole": poly(box(6.5, 6.5, 7, 7))}
    assert pick(spark, hole, ANCHOR, "within") == {"ring_around"}
    assert pick(spark, hole, ANCHOR, "intersects") == {"exact_hole", "ring_around"}


def test_several_parts(spark):
    two = poly(box(0, 0, 4, 4), box(10, 10, 14, 14), box(11, 11, 13, 13))  # two parts, the second with a hole
    shapes = {"first": poly(box(1, 1, 2, 2)), "second": poly(box(10, 10, 11, 14)), "between": poly(box(5, 5, 9, 9)), "in_hole": poly(box(11.5, 11.5, 12, 12)),
              "both": poly(box(1, 1, 2, 2), box(13, 10, 14, 14)), "one_out": poly(box(1, 1, 2, 2), box(6, 6, 7, 7)), "bridge": poly(box(3, 3, 12, 12))}
    assert pick(spark, shapes, two, "within") == {"first", "second", "both"}
    assert pick(spark, shapes, two, "intersects") == {"first", "second", "both", "one_out", "bridge"}


def test_point_position(spark):
    df = spark.createDataFrame([(5.0, 5.0), (7.0, 7.0), (10.0, 3.0), (11.0, 3.0)], "x double, y double")
    a = spark.createDataFrame([(1, ANCHOR)], "k int, r array<array<struct<x:double,y:double>>>")
    pts = df.withColumn("k", F.lit(1)).join(a, "k").orderBy("x", "y")
    out = [r.p for r in pts.select(S.position(F.col("x"), F.col("y"), S.edges_of(F.col("r"))).alias("p")).collect()]
    assert out == [2, 0, 1, 0]  # sorted by x: (5,5) (7,7) (10,3) (11,3)


# --- brute force in exact fractions ------------------------------------------

def _edges(rings):
    out = []
    for r in rings:
        pts = [(p["x"], p["y"]) for p in r]
        out += [(a, b) for a, b in zip(pts, pts[1:] + pts[:1]) if a != b]
    return [tuple((Fraction(x), Fraction(y)) for x, y in e) for e in out]


def _meet(e, f):
    (ax, ay), (bx, by), (cx, cy), (dx, dy) = *e, *f
    rx, ry, sx, sy, qx, qy = bx - ax, by - ay, dx - cx, dy - cy, cx - ax, cy - ay
    den, off, length = rx * sy - ry * sx, qx * ry - qy * rx, rx * rx + ry * ry
    if den:
        t, u = (qx * sy - qy * sx) / den, off / den
        return [t] if 0 <= t <= 1 and 0 <= u <= 1 else []
    if off:
        return []
    ends = [(qx * rx + qy * ry) / length, ((dx - ax) * rx + (dy - ay) * ry) / length]
    inside = [t for t in ends if 0 <= t <= 1]
    return inside + ([Fraction(0), Fraction(1)] if min(ends) <= 0 and max(ends) >= 1 else [])


def _place(x, y, edges):
    odd = False
    for (ax, ay), (bx, by) in edges:
        if (bx - ax) * (y - ay) == (by - ay) * (x - ax) and min(ax, bx) <= x <= max(ax, bx) and min(ay, by) <= y <= max(ay, by):
            return 1
        if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
            odd = not odd
    return 2 if odd else 0


def _mids(e, others):
    ts = sorted({Fraction(0), Fraction(1), *(t for f in others for t in _meet(e, f))})
    (ax, ay), (bx, by) = e
    return [(ax + (bx - ax) * (s + t) / 2, ay + (by - ay) * (s + t) / 2) for s, t in zip(ts, ts[1:])]


def _brute_within(a, b):
    if not a or any(_place(*m, b) == 0 for e in a for m in _mids(e, b)) or any(_place(*m, a) == 2 for f in b for m in _mids(f, a)):
        return False
    ys = sorted({p[1] for e in a for p in e})
    for lo, hi in zip(ys, ys[1:]):
        y = (lo + hi) / 2
        xs = sorted((bx - ax) * (y - ay) / (by - ay) + ax for (ax, ay), (bx, by) in a if (ay > y) != (by > y))
        if any(_place((u + v) / 2, y, b) == 0 for u, v in zip(xs[::2], xs[1::2])):
            return False
    return True


def _brute_intersects(a, b):
    return any(_meet(e, f) for e in a for f in b) or any(_place(*e[0], b) for e in a) or any(_place(*e[0], a) for e in b)


def test_random_polygons_against_brute_force(spark):
    import random
    r = random.Random(11)

    def star(cx, cy, size, n):
        import math
        turns = sorted(r.random() for _ in range(n))
        return [(cx + round(size * r.uniform(0.4, 1) * math.cos(2 * math.pi * t)), cy + round(size * r.uniform(0.4, 1) * math.sin(2 * math.pi * t))) for t in turns]
    layer = {f"s{i}": poly(star(r.randint(0, 60), r.randint(0, 60), r.choice([2, 4, 9]), r.randint(3, 9))) for i in range(60)}
    layer |= {f"b{i}": poly(box(x := r.randint(0, 50), y := r.randint(0, 50), x + r.randint(1, 9), y + r.randint(1, 9))) for i in range(60)}
    anchors = {"big": poly(box(5, 5, 50, 50), box(20, 20, 30, 30), box(22, 22, 27, 27)), "star": poly(star(30, 30, 30, 14)), "two": poly(box(0, 0, 12, 12), box(40, 40, 60, 60)),
               "small": poly(box(21, 21, 24, 24)), "b0": layer["b0"]}
    layer |= {"hole": poly(box(20, 20, 30, 30)), "isle": poly(box(22, 22, 27, 27)), "round": poly(box(18, 18, 32, 32), box(20, 20, 30, 30))}
    schema = "id string, rings array<array<struct<x:double,y:double>>>"
    lf, af = (with_bbox(spark.createDataFrame(list(x.items()), schema)) for x in (layer, anchors))
    b = [_edges(x) for x in anchors.values()]
    for name, rule in (("within", _brute_within), ("intersects", _brute_intersects)):
        want = {i for i, x in layer.items() if any(rule(_edges(x), e) for e in b)}
        got = [x.id for x in S.select_by_location(lf, af, name).collect()]
        assert len(got) == len(set(got)) and set(got) == want, (name, set(got) ^ want)


def test_anchor_of_very_many_vertices(spark):
    import math
    n = 100_000
    ring = [(100 * math.cos(2 * math.pi * i / n) * (1 + 0.001 * (i % 2)), 100 * math.sin(2 * math.pi * i / n) * (1 + 0.001 * (i % 2))) for i in range(n)]
    shapes = {"in": poly(box(0, 0, 10, 10)), "out": poly(box(75, 75, 80, 80)), "edge": poly(box(99, -5, 110, 5)), "far": poly(box(200, 200, 201, 201))}
    assert pick(spark, shapes, poly(ring), "within") == {"in"}
    assert pick(spark, shapes, poly(ring), "intersects") == {"in", "edge"}


def test_overlap_areas(spark):
    shapes = {"box": poly(box(1, 1, 4, 5)), "holed": poly(box(0, 0, 10, 10), box(2, 2, 4, 4)), "parts": poly(box(0, 0, 2, 2), box(3, 3, 6, 6)),
              "triangle": poly([(0, 0), (6, 0), (0, 6)]), "far": poly(box(50, 50, 51, 51))}
    schema = "id string, rings array<array<struct<x:double,y:double>>>"
    df = with_bbox(spark.createDataFrame(list(shapes.items()), schema))
    got = {(r.l, r.r): (round(r.area, 9), round(r.share, 9)) for r in S.overlay(df, df, cell=3.0).collect()}
    want = {("box", "box"): 12, ("holed", "holed"): 96, ("parts", "parts"): 13, ("triangle", "triangle"): 18, ("far", "far"): 1,
            ("box", "holed"): 8, ("box", "parts"): 3, ("box", "triangle"): 8.0 - 0.0, ("holed", "parts"): 12, ("holed", "triangle"): 18 - 4 + 0.0, ("parts", "triangle"): 4}
    # under x + y = 6: the box loses the triangle over the line, the hole all of its square but its far corner's half
    want["box", "triangle"] = 12 - 4.5
    want["holed", "triangle"] = 18 - (4 - 2.0)
    for (a, b), v in want.items():
        assert got[a, b][0] == v and got[b, a][0] == v, (a, b, got[a, b])
        assert abs(got[a, b][1] - v / want[a, a]) < 1e-9
    assert ("box", "far") not in got


def test_overlay_interpolation_keeps_totals(spark):
    from civicframe.operators import aggregate as A
    schema = "id string, rings array<array<struct<x:double,y:double>>>, source string, pop int"
    blocks = with_bbox(spark.createDataFrame([("a", poly(box(0, 0, 4, 4)), "s1", 3), ("b", poly([(4, 0), (8, 0), (6, 6)]), "s1", 1), ("c", poly(box(2, 5, 5, 9)), "s2", 5)], schema))
    zones = with_bbox(spark.createDataFrame([(f"{i}{j}", poly(box(3 * i, 3 * j, 3 * i + 3, 3 * j + 3))) for i in range(3) for j in range(3)],
                                            "id string, rings array<array<struct<x:double,y:double>>>"))
    values = spark.createDataFrame([("s1", 100.0), ("s2", 40.0)], "source string, value double")
    got = {r.id: r.estimate for r in A.overlay_interpolation(values, blocks, zones, "source", "pop", "value").collect()}
    assert abs(sum(got.values()) - 140) < 1e-9 and abs(got["00"] - 75 * 9 / 16) < 1e-9


def test_overlay_works_out_each_area_once(spark):
    """Shares over zones that cover the plane add up to one for concave and
    holed polygons, and the plan holds the area of a pair once (a
    filter on it held it twice)."""
    import math
    import random
    r = random.Random(5)

    def star(low, high):
        n = r.randint(5, 9)
        return [(6 + r.uniform(low, high) * math.cos(2 * math.pi * i / n), 6 + r.uniform(low, high) * math.sin(2 * math.pi * i / n)) for i in range(n)]
    shapes = {f"p{i}": poly(star(2.9, 5.5), *[box(5.5, 5.5, 6.5, 6.25)][:i % 2]) for i in range(25)}
    schema = "id string, rings array<array<struct<x:double,y:double>>>"
    layer = with_bbox(spark.createDataFrame(list(shapes.items()), schema))
    zones = {f"l{i}{j}": poly([(3 * i, 3 * j), (3 * i + 3, 3 * j), (3 * i + 3, 3 * j + 3)]) for i in range(4) for j in range(4)}
    zones |= {f"u{i}{j}": poly([(3 * i, 3 * j), (3 * i + 3, 3 * j + 3), (3 * i, 3 * j + 3)]) for i in range(4) for j in range(4)}
    got = S.overlay(layer, with_bbox(spark.createDataFrame(list(zones.items()), schema)))
    total = {}
    for x in got.collect():
        total[x.l] = total.get(x.l, 0.0) + x.share
    assert set(total) == set(shapes) and all(abs(v - 1) < 1e-9 for v in total.values()), total
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert sum("lambdafunction" in line for line in plan.splitlines() if "Generate explode(" in line) == 1
    assert not any("Filter" in line and "aggregate(" in line for line in plan.splitlines())
