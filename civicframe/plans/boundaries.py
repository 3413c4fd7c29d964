"""Picking boundary polygons by attribute and by location.

On the driver's tables each nation is a 10 x 10 square on a 5 x 5 grid
and each customer a smaller square placed by its key and sized by its
balance; the anchor is the nations of one region.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicframe.operators import aggregate as A
from civicframe.operators import spatial as S
from civicframe.operators.parallel import widen
from civicframe.sources.readers import with_bbox
from civicframe.plans.registry import register, table

# Fixed value: anchor region of the driver-table selections.
ANCHOR_REGION = 2


def nation_squares(spark, sf_dir) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    x0 = (F.col("n_nationkey") % 5) * 10
    y0 = F.floor(F.col("n_nationkey") / 5) * 10
    return with_bbox(n.select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("name"),
                              "n_regionkey", S.rectangle(x0, y0, F.lit(10), F.lit(10)).alias("rings")))


def customer_squares(spark, sf_dir) -> DataFrame:
    c = widen(table(spark, sf_dir, "customer"), "c_custkey")
    x0 = (F.col("c_custkey") % 50).cast("double")
    y0 = (F.floor(F.col("c_custkey") / 50) % 50).cast("double")
    w = F.lit(0.5) + F.abs(F.col("c_acctbal")) / 2000
    return with_bbox(c.select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name"),
                              S.rectangle(x0, y0, w, w).alias("rings")))


_SQUARES = """
WITH n AS (SELECT CAST((n_nationkey % 5) * 10 AS DOUBLE) AS xmin, CAST((n_nationkey % 5) * 10 + 10 AS DOUBLE) AS xmax,
                  CAST(floor(n_nationkey / 5) * 10 AS DOUBLE) AS ymin, CAST(floor(n_nationkey / 5) * 10 + 10 AS DOUBLE) AS ymax
           FROM nation WHERE n_regionkey = {region}),
c AS (SELECT c_custkey, CAST(c_custkey % 50 AS DOUBLE) AS x0, CAST(floor(c_custkey / 50) % 50 AS DOUBLE) AS y0,
             0.5 + abs(c_acctbal) / 2000 AS w FROM customer),
cb AS (SELECT c_custkey, x0 AS xmin, x0 + w AS xmax, y0 AS ymin, y0 + w AS ymax FROM c)
"""


@register("customers_within_region", ("J8", "G1", "G2"), _SQUARES.format(region=ANCHOR_REGION) + """
SELECT CAST(c_custkey AS VARCHAR) AS id FROM cb
WHERE EXISTS (SELECT 1 FROM n WHERE cb.xmin >= n.xmin AND cb.xmax <= n.xmax AND cb.ymin >= n.ymin AND cb.ymax <= n.ymax)
""")
def customers_within_region(spark, sf_dir):
    anchor = nation_squares(spark, sf_dir).where(F.col("n_regionkey") == ANCHOR_REGION)
    return S.select_by_location(customer_squares(spark, sf_dir), anchor, "within").select("id")


@register("customers_touching_region", ("J9", "G3"), _SQUARES.format(region=ANCHOR_REGION) + """
SELECT CAST(c_custkey AS VARCHAR) AS id FROM cb
WHERE EXISTS (SELECT 1 FROM n WHERE cb.xmin <= n.xmax AND cb.xmax >= n.xmin AND cb.ymin <= n.ymax AND cb.ymax >= n.ymin)
""")
def customers_touching_region(spark, sf_dir):
    anchor = nation_squares(spark, sf_dir).where(F.col("n_regionkey") == ANCHOR_REGION)
    return S.select_by_location(customer_squares(spark, sf_dir), anchor, "intersects").select("id")


def nation_parts(spark, sf_dir) -> DataFrame:
    """Concave, holed polygons of two parts: each nation's square with a notch
    from the top and a hole, and a small square 60 to the right."""
    n = table(spark, sf_dir, "nation")
    x0 = (F.col("n_nationkey") % 5 * 10).cast("double")
    y0 = (F.floor(F.col("n_nationkey") / 5) * 10).cast("double")

    def ring(*pts):
        return F.array(*[F.struct((x0 + x).alias("x"), (y0 + y).alias("y")) for x, y in pts])
    rings = F.array(ring((0, 0), (10, 0), (10, 10), (7, 10), (7, 4), (3, 4), (3, 10), (0, 10)),
                    ring((4, 1), (6, 1), (6, 3), (4, 3)), ring((60, 0), (64, 0), (64, 4), (60, 4)))
    return with_bbox(n.select(F.col("n_nationkey").cast("string").alias("id"), "n_regionkey", rings.alias("rings")))


_PARTS = """
WITH n AS (SELECT CAST((n_nationkey % 5) * 10 AS DOUBLE) AS x, CAST(floor(n_nationkey / 5) * 10 AS DOUBLE) AS y
           FROM nation WHERE n_regionkey = {region}),
c AS (SELECT c_custkey, CAST(c_custkey % 100 AS DOUBLE) AS x0, CAST(floor(c_custkey / 100) % 50 AS DOUBLE) AS y0,
             0.5 + abs(c_acctbal) / 2000 AS w FROM customer),
b AS (SELECT c_custkey, x0 AS x1, x0 + w AS x2, y0 AS y1, y0 + w AS y2 FROM c)
""".format(region=ANCHOR_REGION)


def customer_tiles(spark, sf_dir) -> DataFrame:
    c = widen(table(spark, sf_dir, "customer"), "c_custkey")
    x0 = (F.col("c_custkey") % 100).cast("double")
    y0 = (F.floor(F.col("c_custkey") / 100) % 50).cast("double")
    w = F.lit(0.5) + F.abs(F.col("c_acctbal")) / 2000
    return with_bbox(c.select(F.col("c_custkey").cast("string").alias("id"), S.rectangle(x0, y0, w, w).alias("rings")))


@register("tiles_within_parts", ("J8", "G2", "S7"), _PARTS + """
SELECT CAST(c_custkey AS VARCHAR) AS id FROM b WHERE EXISTS (SELECT 1 FROM n WHERE
  (x1 >= x AND x2 <= x + 10 AND y1 >= y AND y2 <= y + 10
   AND NOT (x1 < x + 7 AND x2 > x + 3 AND y2 > y + 4) AND NOT (x1 < x + 6 AND x2 > x + 4 AND y1 < y + 3 AND y2 > y + 1))
  OR (x1 >= x + 60 AND x2 <= x + 64 AND y1 >= y AND y2 <= y + 4))
""")
def tiles_within_parts(spark, sf_dir):
    anchor = nation_parts(spark, sf_dir).where(F.col("n_regionkey") == ANCHOR_REGION)
    return S.select_by_location(customer_tiles(spark, sf_dir), anchor, "within").select("id")


@register("tiles_touching_parts", ("J9", "G3"), _PARTS + """
SELECT CAST(c_custkey AS VARCHAR) AS id FROM b WHERE EXISTS (SELECT 1 FROM n WHERE
  (x1 <= x + 10 AND x2 >= x AND y1 <= y + 10 AND y2 >= y AND NOT (x1 > x + 3 AND x2 < x + 7 AND y1 > y + 4)
   AND NOT (x1 > x + 4 AND x2 < x + 6 AND y1 > y + 1 AND y2 < y + 3))
  OR (x1 <= x + 64 AND x2 >= x + 60 AND y1 <= y + 4 AND y2 >= y))
""")
def tiles_touching_parts(spark, sf_dir):
    anchor = nation_parts(spark, sf_dir).where(F.col("n_regionkey") == ANCHOR_REGION)
    return S.select_by_location(customer_tiles(spark, sf_dir), anchor, "intersects").select("id")


def layer_catalog(groups) -> DataFrame:
    """One table of named layer groups for a map: (group, label,
    visible, rings). ``groups`` is a list of (group name, layer frame,
    label column, visible by default)."""
    parts = [df.select(F.lit(name).alias("group"), F.col(label).cast("string").alias("label"),
                       F.lit(visible).alias("visible"), "rings", "xmin", "ymin", "xmax", "ymax")
             for name, df, label, visible in groups]
    return reduce(lambda a, b: a.unionByName(b), parts)


def zip_prefix(df: DataFrame, col: str, prefixes) -> DataFrame:
    """ZIP areas whose code starts with any of the prefixes (e.g. the
    ``"38"`` and ``"72"`` of the two states around the city)."""
    prefixes = [prefixes] if isinstance(prefixes, str) else list(prefixes)
    cond = F.lit(False)
    for p in prefixes:
        cond = cond | F.col(col).startswith(p)
    return df.where(cond)


@register("zones_interpolated", ("A17", "J9"), """
WITH v AS (SELECT s_nationkey AS nation, SUM(s_acctbal) AS value FROM supplier GROUP BY 1),
c AS (SELECT c_custkey, c_nationkey AS nation, 1 + c_custkey % 7 AS pop, CAST(c_custkey % 100 AS DOUBLE) AS x0,
             CAST(floor(c_custkey / 100) % 50 AS DOUBLE) AS y0, 0.5 + abs(c_acctbal) / 2000 AS w FROM customer),
z AS (SELECT DISTINCT zx, zy FROM (SELECT unnest(range(CAST(floor(x0 / 10) AS BIGINT), CAST(floor((x0 + w) / 10) AS BIGINT) + 1)) AS zx, y0, w FROM c) a,
      LATERAL (SELECT unnest(range(CAST(floor(a.y0 / 10) AS BIGINT), CAST(floor((a.y0 + a.w) / 10) AS BIGINT) + 1)) AS zy) b),
o AS (SELECT c.nation, pop, zx, zy, greatest(0, least(x0 + w, zx * 10 + 10) - greatest(x0, zx * 10)) * greatest(0, least(y0 + w, zy * 10 + 10) - greatest(y0, zy * 10)) / (w * w) AS share
      FROM c JOIN z ON x0 <= zx * 10 + 10 AND x0 + w >= zx * 10 AND y0 <= zy * 10 + 10 AND y0 + w >= zy * 10),
sp AS (SELECT nation, SUM(pop) AS src_pop FROM c GROUP BY 1)
SELECT CAST(zx AS VARCHAR) || ':' || CAST(zy AS VARCHAR) AS id, ROUND(SUM(value * pop * share / src_pop), 4) AS estimate
FROM o JOIN sp USING (nation) JOIN v USING (nation) WHERE share > 0 GROUP BY 1
""")
def zones_interpolated(spark, sf_dir):
    """Supplier balance per nation moved to square zones of side 10, through
    customer tiles as blocks, by the area of each tile in each zone."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_nationkey").alias("nation"),
                                                 (1 + F.col("c_custkey") % 7).alias("pop"))
    tiles = customer_tiles(spark, sf_dir)
    blocks = tiles.join(c, "id")
    cells = tiles.select(F.explode(F.sequence(F.floor(F.col("xmin") / 10), F.floor(F.col("xmax") / 10))).alias("zx"), "ymin", "ymax") \
        .select("zx", F.explode(F.sequence(F.floor(F.col("ymin") / 10), F.floor(F.col("ymax") / 10))).alias("zy")).distinct()
    side = F.lit(10.0)
    zones = with_bbox(cells.select(F.concat_ws(":", "zx", "zy").alias("id"), S.rectangle(F.col("zx") * side, F.col("zy") * side, side, side).alias("rings")))
    values = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.sum("s_acctbal").alias("value"))
    got = A.overlay_interpolation(values, blocks, zones, "nation", "pop", "value")
    return got.select("id", F.round("estimate", 4).alias("estimate"))
