"""Spatial layer selection (J8, J9) with Spark expressions only.

A polygon is ``rings: array<array<struct<x,y>>>`` plus bbox columns
``xmin .. ymax``. Rings are closed or not and count by the even-odd rule: a
shell, its holes, further parts (multipolygons) and islands in holes may stand
in any order.

Candidate pairs come from an equi-join on grid cells: each bbox is
exploded into the cells it covers (ids and boxes only, never the rings),
both sides are joined on the cell, and a pair is kept only in the one cell
that holds the lower-left corner of the two boxes' overlap, so no ``distinct``
is needed. A hot cell is a skewed join key; AQE's skew join splits it.

The exact test is joins over single edges. Edges are dealt to the grid cells they
cross, and only edges that share a cell are held against each other. Points are
located by the even-odd rule in the horizontal bands of a polygon, of which
each holds few edges. So a polygon with very many vertices is never one row's work.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicframe.session import cut_lineage


def edges_of(rings: Column) -> Column:
    """All edges ``struct<a,b>`` of all rings (points of no length left out)."""
    def of_ring(r):
        n = F.size(r)
        return F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(
            F.element_at(r, i).alias("a"), F.element_at(r, (i % n) + 1).alias("b")))
    every = F.flatten(F.transform(F.filter(rings, lambda r: F.size(r) > 0), of_ring))
    return F.filter(every, lambda e: (e["a"]["x"] != e["b"]["x"]) | (e["a"]["y"] != e["b"]["y"]))


def _cross(ax, ay, bx, by) -> Column:
    return ax * by - ay * bx


def _on_edge(px, py, e: Column) -> Column:
    a, b = e["a"], e["b"]
    return ((_cross(b["x"] - a["x"], b["y"] - a["y"], px - a["x"], py - a["y"]) == 0)
            & (px >= F.least(a["x"], b["x"])) & (px <= F.greatest(a["x"], b["x"]))
            & (py >= F.least(a["y"], b["y"])) & (py <= F.greatest(a["y"], b["y"])))


def _crossing_x(e: Column, y) -> Column:
    """x where the line of an edge is at height y."""
    a, b = e["a"], e["b"]
    return (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"]


def position(px, py, edges: Column) -> Column:
    """2 = inside, 1 = on the boundary, 0 = outside, by the even-odd rule; of a
    point and a polygon's edges in one row."""
    def crosses(e):
        return F.when((e["a"]["y"] > py) != (e["b"]["y"] > py), px < _crossing_x(e, py)).otherwise(F.lit(False))
    odd = F.aggregate(edges, F.lit(False), lambda acc, e: acc != crosses(e))
    return F.when(F.exists(edges, lambda e: _on_edge(px, py, e)), 1).when(odd, 2).otherwise(0)


def _contacts(e: Column, f: Column) -> Column:
    """Places (0 to 1) on edge e where edge f meets it."""
    a, b, c, d = e["a"], e["b"], f["a"], f["b"]
    rx, ry, sx, sy = b["x"] - a["x"], b["y"] - a["y"], d["x"] - c["x"], d["y"] - c["y"]
    qx, qy = c["x"] - a["x"], c["y"] - a["y"]
    den, off, length = _cross(rx, ry, sx, sy), _cross(qx, qy, rx, ry), rx * rx + ry * ry
    t, u = _cross(qx, qy, sx, sy) / den, off / den
    tc, td = (qx * rx + qy * ry) / length, ((d["x"] - a["x"]) * rx + (d["y"] - a["y"]) * ry) / length
    none = F.array().cast("array<double>")
    return (F.when(den != 0, F.when((t >= 0) & (t <= 1) & (u >= 0) & (u <= 1), F.array(t)).otherwise(none))
            .when(off == 0, F.filter(F.array(tc, td), lambda v: (v >= 0) & (v <= 1))).otherwise(none))


def _along(e: Column, f: Column, t) -> Column:
    """Edge f lies along edge e at place t."""
    a, b, c, d = e["a"], e["b"], f["a"], f["b"]
    rx, ry = b["x"] - a["x"], b["y"] - a["y"]
    length = rx * rx + ry * ry
    tc, td = ((c["x"] - a["x"]) * rx + (c["y"] - a["y"]) * ry) / length, ((d["x"] - a["x"]) * rx + (d["y"] - a["y"]) * ry) / length
    return ((_cross(rx, ry, c["x"] - a["x"], c["y"] - a["y"]) == 0) & (_cross(rx, ry, d["x"] - a["x"], d["y"] - a["y"]) == 0)
            & (t >= F.least(tc, td)) & (t <= F.greatest(tc, td)))


BOX = ("xmin", "ymin", "xmax", "ymax")
# Shares of an edge that are one place but for rounding.
ROUNDED = 1e-9


def _cells(df: DataFrame, size: float, prefix: str, id_col: str) -> DataFrame:
    p = prefix
    thin = df.select(*[F.col(c).alias(p + c) for c in (id_col, *BOX)])
    cx = F.explode(F.sequence(F.floor(F.col(p + "xmin") / size), F.floor(F.col(p + "xmax") / size)))
    cy = F.explode(F.sequence(F.floor(F.col(p + "ymin") / size), F.floor(F.col(p + "ymax") / size)))
    return thin.select("*", cx.alias("_cx")).select("*", cy.alias("_cy"))


def candidate_pairs(left: DataFrame, right: DataFrame, cell: float, id_col: str = "id") -> DataFrame:
    """Ids and boxes of the pairs whose closed bboxes overlap, each pair once.
    Columns of the left side get ``l_``, of the right side ``r_``."""
    lc = _cells(left, cell, "l_", id_col)
    rc = _cells(right, cell, "r_", id_col)
    overlap = (F.col("l_xmin") <= F.col("r_xmax")) & (F.col("l_xmax") >= F.col("r_xmin")) & \
              (F.col("l_ymin") <= F.col("r_ymax")) & (F.col("l_ymax") >= F.col("r_ymin"))
    ref_x = F.floor(F.greatest("l_xmin", "r_xmin") / cell)
    ref_y = F.floor(F.greatest("l_ymin", "r_ymin") / cell)
    return lc.join(rc, ["_cx", "_cy"]).where(overlap & (F.col("_cx") == ref_x) & (F.col("_cy") == ref_y)) \
        .drop("_cx", "_cy")


def grid_cell_size(layer: DataFrame) -> float:
    """Cell size for the candidate join: twice the approximate median of the
    layer's box sides, so a typical feature falls in one to four cells and a
    large anchor in many (anchors are few). One small aggregate."""
    side = F.greatest(F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin"))
    v = layer.agg(F.percentile_approx(side, 0.5, 1000)).first()[0]
    return 2.0 * float(v) if v and v > 0 else 1.0


def edge_table(df: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, lo, hi, nb, p, ring, k, n, e): every edge of every polygon (those of
    no length left out): its place p in the polygon and k in its ring, the ring's
    number of edges n, the polygon's lowest and highest y and number of
    horizontal bands. A polygon has a band for every eight edges, so a band
    holds few."""
    of_ring = ("filter(transform(sequence(1, size(r)), i -> named_struct('a', element_at(r, i), 'b', element_at(r, (i % size(r)) + 1))), "
               "e -> e.a.x <> e.b.x OR e.a.y <> e.b.y)")
    rings = df.select(F.col(id_col).alias("id"), F.expr(f"transform(filter(rings, r -> size(r) > 0), r -> {of_ring})").alias("_r"))
    flat = rings.select("id", F.expr("flatten(transform(_r, (r, j) -> transform(r, (e, k) -> named_struct('ring', j, 'k', k, 'n', size(r), 'e', e))))").alias("_e"))
    # a select of its own, so that no row carries the array after it is taken apart
    boxed = flat.where(F.size("_e") > 0).select(
        "id", "_e", F.expr("array_min(transform(_e, x -> least(x.e.a.y, x.e.b.y)))").alias("lo"),
        F.expr("array_max(transform(_e, x -> greatest(x.e.a.y, x.e.b.y)))").alias("hi"),
        F.expr("cast(greatest(1, size(_e) div 8) as long)").alias("nb"))
    return boxed.select("id", "lo", "hi", "nb", F.posexplode("_e").alias("p", "x")).select("id", "lo", "hi", "nb", "p", "x.ring", "x.k", "x.n", "x.e")


def _in_cells(edges: DataFrame, size: float) -> DataFrame:
    """Edges with the grid cells (_cx, _cy) that they cross: the rows between
    their ends, and in each row the columns of the part that lies there."""
    a, b = F.col("e.a"), F.col("e.b")
    ylo, yhi = F.least(a["y"], b["y"]), F.greatest(a["y"], b["y"])
    rows = edges.select("*", F.explode(F.sequence(F.floor(ylo / size), F.floor(yhi / size))).alias("_cy"))
    xlo, xhi = F.least(a["x"], b["x"]), F.greatest(a["x"], b["x"])

    def at(y):
        return F.when(a["y"] != b["y"], a["x"] + (b["x"] - a["x"]) * (F.least(F.greatest(y, ylo), yhi) - a["y"]) / (b["y"] - a["y"]))
    x0, x1 = at(F.col("_cy") * size), at((F.col("_cy") + 1) * size)
    # a little wider, as the part's ends are rounded
    slack = F.lit(size * 1e-6) + F.greatest(F.abs(xlo), F.abs(xhi)) * 1e-12
    lo = F.greatest(F.coalesce(F.least(x0, x1), xlo) - slack, xlo)
    hi = F.least(F.coalesce(F.greatest(x0, x1), xhi) + slack, xhi)
    return rows.select("*", F.explode(F.sequence(F.floor(lo / size), F.floor(hi / size))).alias("_cx"))


def _edge_cell_size(edges: DataFrame) -> float:
    side = F.greatest(F.abs(F.col("e.a.x") - F.col("e.b.x")), F.abs(F.col("e.a.y") - F.col("e.b.y")))
    v = edges.agg(F.percentile_approx(side, 0.5, 1000)).first()[0]
    return 2.0 * float(v) if v and v > 0 else 1.0


def _band(y: Column) -> Column:
    """Band of a height; rises with it."""
    part = F.when(F.col("hi") > F.col("lo"), (y - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0)
    return F.least(F.col("nb") - 1, F.floor(part * F.col("nb")).cast("long"))


def _crossings(points: DataFrame, edges: DataFrame, keys: list[str], *more: Column) -> DataFrame:
    """Points (id, x, y) with ``n``: how many edges of polygon ``id`` cross the
    line to their right, counted among the edges of the point's band. Odd is
    inside; points on the boundary are not asked for."""
    box = edges.where("p = 0").select("id", "lo", "hi", "nb")
    dealt = edges.select("id", F.col("e").alias("_e"), F.explode(F.sequence(
        _band(F.least("e.a.y", "e.b.y")), _band(F.greatest("e.a.y", "e.b.y")))).alias("_band"))
    at = points.join(box, "id", "left").withColumn("_band", F.when((F.col("y") >= F.col("lo")) & (F.col("y") <= F.col("hi")), _band(F.col("y"))))
    met = at.join(dealt, ["id", "_band"], "left")
    e = F.col("_e")
    over = (e["a"]["y"] > F.col("y")) != (e["b"]["y"] > F.col("y"))
    met = met.withColumn("_x", F.when(over, _crossing_x(e, F.col("y"))))
    return met.groupBy(*keys, "x", "y").agg(F.sum(F.when(F.col("_x") > F.col("x"), 1).otherwise(0)).alias("n"), *more)


def _contact_rows(pairs: DataFrame, le: DataFrame, re_: DataFrame, size: float) -> DataFrame:
    """(l, r, and both edges) of the pairs' edges that meet, found in shared
    cells; an edge pair may stand there once for each."""
    lc = _in_cells(le.select(F.col("id").alias("l"), F.col("ring").alias("lring"), F.col("k").alias("lk"), F.col("n").alias("ln"), "e"), size)
    rc = _in_cells(re_.select(F.col("id").alias("r"), F.col("ring").alias("rring"), F.col("k").alias("rk"), F.col("n").alias("rn"), "e"), size)
    lc, rc = lc.withColumnRenamed("e", "le"), rc.withColumnRenamed("e", "re")
    near = None
    for c in ("x", "y"):
        t = ((F.least(f"le.a.{c}", f"le.b.{c}") <= F.greatest(f"re.a.{c}", f"re.b.{c}"))
             & (F.greatest(f"le.a.{c}", f"le.b.{c}") >= F.least(f"re.a.{c}", f"re.b.{c}")))
        near = t if near is None else near & t
    # of two edges on one line the longer one may have no end on the other
    meet = (F.size(_contacts(F.col("le"), F.col("re"))) > 0) | (F.size(_contacts(F.col("re"), F.col("le"))) > 0)
    met = lc.join(rc, ["_cx", "_cy"]).where(near).where(meet)
    return met.join(pairs.select("l", "r"), ["l", "r"], "left_semi").drop("_cx", "_cy")


def _pieces(met: DataFrame, own: str, other: str) -> DataFrame:
    """Middles (x, y) of the pieces into which the edges of the other polygon
    cut each edge that meets some, and whether a piece lies along one of them.
    Contacts that differ by rounding only leave no piece between them."""
    o = f"{own}e"
    g = met.groupBy("l", "r", f"{own}ring", f"{own}k", f"{own}n", o).agg(F.collect_set(f"{other}e").alias("_f"))
    ts = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0), F.lit(1.0)), F.flatten(F.transform("_f", lambda f: _contacts(F.col(o), f))))))
    g = g.withColumn("_t", ts)
    g = g.select("*", F.explode(F.zip_with(F.slice("_t", F.lit(1), F.size("_t") - 1), F.slice("_t", F.lit(2), F.size("_t") - 1), lambda a, b: F.when(b - a > ROUNDED, (a + b) / 2))).alias("t")).where("t is not null")
    x = F.col(f"{o}.a.x") + (F.col(f"{o}.b.x") - F.col(f"{o}.a.x")) * F.col("t")
    y = F.col(f"{o}.a.y") + (F.col(f"{o}.b.y") - F.col(f"{o}.a.y")) * F.col("t")
    along = F.exists("_f", lambda f: _along(F.col(o), f, F.col("t")) | _on_edge(x, y, f))
    return g.select("l", "r", F.col(f"{own}ring").alias("ring"), F.col(f"{own}k").alias("k"), F.col(f"{own}n").alias("n"), F.col(o).alias("e"),
                    x.alias("x"), y.alias("y"), along.alias("along"))


def _ring_points(edges: DataFrame) -> DataFrame:
    """One vertex of every ring."""
    return edges.where("k = 0").select("id", "ring", F.col("e.a.x").alias("x"), F.col("e.a.y").alias("y"))


def _inner_points(rings: DataFrame, le: DataFrame) -> DataFrame:
    """A point of the interior next to each ring (l, r, ring and one of its
    edges that is not level): half way from the edge to the next one on its inner side,
    at the height of its middle."""
    m = rings.select("l", "r", "ring", F.col("l").alias("id"), ((F.col("e.a.x") + F.col("e.b.x")) / 2).alias("x"), ((F.col("e.a.y") + F.col("e.b.y")) / 2).alias("y"))
    g = _crossings(m, le, ["l", "r", "ring"], F.min(F.when(F.col("_x") > F.col("x"), F.col("_x"))).alias("_right"),
                   F.max(F.when(F.col("_x") < F.col("x"), F.col("_x"))).alias("_left"))
    x = (F.col("x") + F.when(F.col("n") % 2 == 1, F.col("_right")).otherwise(F.col("_left"))) / 2
    return g.select("l", "r", x.alias("x"), "y").where("x is not null")


def _intersecting(pairs: DataFrame, le: DataFrame, re_: DataFrame, size: float) -> DataFrame:
    """Pairs whose closed polygons share a point: edges meet, or a ring (of
    which one vertex speaks, as none of its edges meets the other) lies inside."""
    met = cut_lineage(_contact_rows(pairs, le, re_, size).select("l", "r").distinct())
    apart = pairs.join(met, ["l", "r"], "left_anti")
    l_in = _ring_points(le).select(F.col("id").alias("l"), "x", "y").join(apart, "l").select("l", "r", F.col("r").alias("id"), "x", "y")
    r_in = _ring_points(re_).select(F.col("id").alias("r"), "x", "y").join(apart, "r").where("x >= l_xmin AND x <= l_xmax AND y >= l_ymin AND y <= l_ymax") \
        .select("l", "r", F.col("l").alias("id"), "x", "y")
    inside = [_crossings(p, e, ["l", "r"]).where("n % 2 = 1").select("l", "r") for p, e in ((l_in, re_), (r_in, le))]
    return met.union(inside[0]).union(inside[1])


def _within(pairs: DataFrame, le: DataFrame, re_: DataFrame, size: float) -> DataFrame:
    """Pairs whose left polygon lies within the right one, boundary contact
    allowed. Edges that meet are cut at their contacts: no piece of the left
    boundary may lie outside the right polygon, no piece of the right boundary
    inside the left. Rings that meet nothing are judged by one vertex. Where a
    left ring runs along the right boundary all the way, a point of the
    interior next to it decides."""
    met = cut_lineage(_contact_rows(pairs, le, re_, size))
    lp, rp = cut_lineage(_pieces(met, "l", "r")), _pieces(met, "r", "l")
    at = ["l", "r", "x", "y"]
    # rings that meet nothing
    l_free = (_ring_points(le).select(F.col("id").alias("l"), "ring", "x", "y").join(pairs.select("l", "r"), "l")
              .join(met.select("l", "r", F.col("lring").alias("ring")).distinct(), ["l", "r", "ring"], "left_anti"))
    r_free = (_ring_points(re_).select(F.col("id").alias("r"), "ring", "x", "y").join(pairs, "r")
              .where("x >= l_xmin AND x <= l_xmax AND y >= l_ymin AND y <= l_ymax")
              .join(met.select("l", "r", F.col("rring").alias("ring")).distinct(), ["l", "r", "ring"], "left_anti"))
    # rings that run along the other boundary all the way
    level = F.col("e.a.y") == F.col("e.b.y")
    rings = (lp.groupBy("l", "r", "ring", "n").agg(F.count_distinct("k").alias("_k"), F.min("along").alias("_all"),
                                                   F.min(F.when(~level, F.struct("k", "e"))).alias("_e"))
             .where("_all AND _k = n AND _e is not null").select("l", "r", "ring", F.col("_e.e").alias("e")))
    must_be_in = lp.where("NOT along").select(*at).union(l_free.select(*at)).union(_inner_points(rings, le))
    must_be_out = rp.where("NOT along").select(*at).union(r_free.select(*at))
    bad = (_crossings(must_be_in.withColumn("id", F.col("r")), re_, ["l", "r"]).where("n % 2 = 0").select("l", "r")
           .union(_crossings(must_be_out.withColumn("id", F.col("l")), le, ["l", "r"]).where("n % 2 = 1").select("l", "r")))
    return (pairs.select("l", "r").join(le.where("p = 0").select(F.col("id").alias("l")), "l", "left_semi")
            .join(bad.distinct(), ["l", "r"], "left_anti"))


def select_by_location(layer: DataFrame, anchor: DataFrame, predicate: str = "intersects",
                       cell: float | None = None, id_col: str = "id") -> DataFrame:
    """Rows of ``layer`` within (or intersecting) any polygon of
    ``anchor`` -- sf's ``layer[anchor, op = st_within]``. ``cell`` defaults
    to :func:`grid_cell_size` of the layer; ``id_col`` must be unique in both."""
    if cell is None:
        cell = grid_cell_size(layer)
    pairs = candidate_pairs(layer, anchor, cell, id_col)
    if predicate == "within":
        pairs = pairs.where(
            (F.col("l_xmin") >= F.col("r_xmin")) & (F.col("l_xmax") <= F.col("r_xmax"))
            & (F.col("l_ymin") >= F.col("r_ymin")) & (F.col("l_ymax") <= F.col("r_ymax")))
        decide = _within
    elif predicate == "intersects":
        decide = _intersecting
    else:
        raise ValueError(f"unknown predicate {predicate}")
    pairs = cut_lineage(pairs.select(F.col(f"l_{id_col}").alias("l"), F.col(f"r_{id_col}").alias("r"), "l_xmin", "l_ymin", "l_xmax", "l_ymax"))
    le = edge_table(layer.join(pairs.select(F.col("l").alias(id_col)).distinct(), id_col, "left_semi"), id_col)
    re_ = edge_table(anchor.join(pairs.select(F.col("r").alias(id_col)).distinct(), id_col, "left_semi"), id_col)
    le = cut_lineage(le)
    hits = decide(pairs, le, re_, _edge_cell_size(le.union(re_))).select(F.col("l").alias("_hit")).distinct()
    return layer.join(hits, layer[id_col] == hits["_hit"], "left_semi")


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _sloping(edges: Column) -> Column:
    """Edges that are not level; only these bound a strip's width."""
    return F.filter(edges, lambda e: e["a"]["y"] != e["b"]["y"])


def _crossing_heights(a: Column, b: Column) -> Column:
    """Heights at which lines of sloping edges of a and b cross, of those with
    overlapping boxes (a height where the edges themselves don't meet is one more cut, no harm)."""
    def near(e, f):
        def apart(k):
            return ((F.least(e["a"][k], e["b"][k]) > F.greatest(f["a"][k], f["b"][k]))
                    | (F.least(f["a"][k], f["b"][k]) > F.greatest(e["a"][k], e["b"][k])))
        return (den(e, f) != 0) & ~apart("y") & ~apart("x")

    def den(e, f):
        return _cross(e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"], f["b"]["x"] - f["a"]["x"], f["b"]["y"] - f["a"]["y"])

    def height(e, f):
        t = _cross(f["a"]["x"] - e["a"]["x"], f["a"]["y"] - e["a"]["y"], f["b"]["x"] - f["a"]["x"], f["b"]["y"] - f["a"]["y"]) / den(e, f)
        return e["a"]["y"] + (e["b"]["y"] - e["a"]["y"]) * t
    return F.flatten(F.transform(a, lambda e: F.transform(F.filter(b, lambda f: near(e, f)), lambda f: height(e, f))))


def overlap_area(a: Column, b: Column) -> Column:
    """Area that two polygons (edges, see :func:`edges_of`; level ones may be left out) share, holes and
    parts included. The plane is cut into strips at the heights of all vertices and of all
    places where edges meet, as far as both polygons reach; inside a strip the shared width changes evenly, so
    its value half way up, times the height, is the strip's area."""
    def heights(edges):
        return F.flatten(F.transform(_sloping(edges), lambda e: F.array(e["a"]["y"], e["b"]["y"])))

    def cuts(of_a, of_b):
        lo, hi = F.greatest(F.array_min(of_a), F.array_min(of_b)), F.least(F.array_max(of_a), F.array_max(of_b))
        return _let(F.struct(lo.alias("lo"), hi.alias("hi")), lambda r: F.sort_array(F.array_distinct(F.filter(
            F.concat(of_a, of_b, _crossing_heights(_sloping(a), _sloping(b))), lambda y: (y >= r["lo"]) & (y <= r["hi"])))))

    def spans(edges, y):
        cut = F.filter(edges, lambda e: (e["a"]["y"] > y) != (e["b"]["y"] > y))
        return _let(F.sort_array(F.transform(cut, lambda e: _crossing_x(e, y))), lambda xs: F.zip_with(
            F.filter(xs, lambda _, i: i % 2 == 0), F.filter(xs, lambda _, i: i % 2 == 1), lambda u, v: F.struct(u.alias("u"), v.alias("v"))))

    def width(y):
        each = _let(spans(b, y), lambda other: F.flatten(F.transform(spans(a, y), lambda s: F.transform(other, lambda t: F.greatest(
            F.lit(0.0), F.least(s["v"], t["v"]) - F.greatest(s["u"], t["u"]))))))
        return F.aggregate(each, F.lit(0.0), lambda acc, x: acc + x)

    def strips(ys):
        n = F.greatest(F.size(ys) - 1, F.lit(0))
        return F.zip_with(F.slice(ys, F.lit(1), n), F.slice(ys, F.lit(2), n), lambda lo, hi: (hi - lo) * width((lo + hi) / 2))
    ys = _let(heights(a), lambda of_a: _let(heights(b), lambda of_b: cuts(of_a, of_b)))
    return F.aggregate(_let(ys, strips), F.lit(0.0), lambda acc, x: acc + x)


def overlay(left: DataFrame, right: DataFrame, cell: float | None = None, id_col: str = "id") -> DataFrame:
    """(l, r, area, share): the area that each pair of polygons shares and its
    share of the left polygon's area, for pairs that share some. Candidate pairs come
    from the grid, so only neighbours are held against each other."""
    pairs = candidate_pairs(left, right, cell or grid_cell_size(left), id_col).select(
        F.col(f"l_{id_col}").alias("l"), F.col(f"r_{id_col}").alias("r"))
    sloping = _sloping(edges_of(F.col("rings")))
    own = left.select(F.col(id_col).alias("l"), sloping.alias("_a")).withColumn("_whole", overlap_area(F.col("_a"), F.col("_a")))
    other = right.select(F.col(id_col).alias("r"), sloping.alias("_b"))
    # a row or none of each pair: a filter on the area would be pushed below and work it out twice
    some = F.filter(F.array(overlap_area(F.col("_a"), F.col("_b"))), lambda v: v > 0)
    met = pairs.join(own, "l").join(other, "r").select("l", "r", "_whole", F.explode(some).alias("area"))
    return met.select("l", "r", "area", (F.col("area") / F.col("_whole")).alias("share"))


def rectangle(x0, y0, w, h) -> Column:
    """A closed axis-aligned rectangle as a one-ring polygon."""
    pts = [(x0, y0), (x0 + w, y0), (x0 + w, y0 + h), (x0, y0 + h), (x0, y0)]
    return F.array(F.array(*[F.struct(px.cast("double").alias("x"), py.cast("double").alias("y")) for px, py in pts]))
