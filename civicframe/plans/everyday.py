"""Plans that run the smaller operators and the sources on tables landed from
the driver's data, so that each is checked against SQL.

Files go below the session's shared folder, a new sub-folder per call.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from civicframe.functions import strings as X
from civicframe.operators import aggregate as A
from civicframe.operators import columns as C
from civicframe.operators import joins as J
from civicframe.operators import ordering as O
from civicframe.operators import reshape as R
from civicframe.plans import acs_catalog, boundaries, requests, surveys
from civicframe.plans.registry import register, table
from civicframe.session import scratch_path
from civicframe.sources import readers as S
from civicframe.sources import sinks as K


@register("urgent_requests_scan", ("S2", "K2"), """
SELECT o_orderkey AS INCIDENT_NUMBER, o_orderstatus AS STATUS FROM orders WHERE o_orderpriority = '1-URGENT'
""")
def urgent_requests_scan(spark, sf_dir):
    path = scratch_path(spark, "requests")
    o = table(spark, sf_dir, "orders")
    K.write_parquet(o.select(F.col("o_orderkey").alias("INCIDENT_NUMBER"), F.col("o_orderstatus").alias("STATUS"),
                             F.col("o_orderpriority").alias("DEPARTMENT"), "o_totalprice"), path)
    return S.read_requests(spark, path, "1-URGENT", ["INCIDENT_NUMBER", "STATUS"])


@register("conversation_pages", ("S4",), "SELECT DISTINCT conv_id, turn, role, text FROM conversations")
def conversation_pages(spark, sf_dir):
    """Two overlapping sets of JSON pages."""
    path = scratch_path(spark, "pages")
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    c.where("conv_id % 3 < 2").write.json(f"{path}/a")
    c.where("conv_id % 3 > 0").write.json(f"{path}/b")
    return S.read_json_pages(spark, [f"{path}/a", f"{path}/b"], c.schema)


@register("nation_dictionary", ("S6", "F2"), """
SELECT CAST(n_nationkey AS VARCHAR) AS code, n_name, CAST(n_regionkey AS VARCHAR) AS area FROM nation
""")
def nation_dictionary(spark, sf_dir):
    path = scratch_path(spark, "dictionary")
    K.write_csv(table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"), path)
    return S.read_dictionary(spark, path, ["code", "area"], [1, 3])


@register("order_year_snapshots", ("S8",), """
SELECT o_orderkey, o_totalprice, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders WHERE o_orderdate IS NOT NULL
""")
def order_year_snapshots(spark, sf_dir):
    path = scratch_path(spark, "years")
    o = table(spark, sf_dir, "orders").where("o_orderdate is not null").select("o_orderkey", "o_totalprice", F.year("o_orderdate").alias("year"))
    K.write_parquet(o.repartition("year"), path, partition_by=["year"])
    return S.read_years(spark, path)


def _land_layer(df, path):
    df.select("id", "name", F.create_map(F.lit("from"), F.lit("driver")).alias("attrs"), "rings").write.json(path)
    return path


@register("layers_stacked", ("S7", "S9", "G4"), """
SELECT 'Nations' AS "group", n_name AS label, true AS visible,
       CAST((n_nationkey % 5) * 10 AS DOUBLE) AS xmin, CAST(floor(n_nationkey / 5) * 10 + 10 AS DOUBLE) AS ymax FROM nation
UNION ALL
SELECT 'Customers', c_name, false, CAST(c_custkey % 50 AS DOUBLE),
       CAST(floor(c_custkey / 50) % 50 AS DOUBLE) + (0.5 + abs(c_acctbal) / 2000) FROM customer
""")
def layers_stacked(spark, sf_dir):
    path = scratch_path(spark, "layers")
    items = [(_land_layer(boundaries.nation_squares(spark, sf_dir), f"{path}/n"), "nations"),
             (_land_layer(boundaries.customer_squares(spark, sf_dir), f"{path}/c"), "customers")]
    both = S.read_layers(spark, items)
    cat = boundaries.layer_catalog([("Nations", both.where("layer = 'nations'"), "name", True),
                                    ("Customers", both.where("layer = 'customers'"), "name", False)])
    return cat.select("group", "label", "visible", "xmin", "ymax")


@register("customers_by_zip_prefix", ("G3", "X4"), """
SELECT c_custkey, substr(c_phone, 1, 5) AS zip FROM (SELECT c_custkey, lpad(CAST(c_custkey * 37 % 100000 AS VARCHAR), 5, '0') AS c_phone FROM customer)
WHERE starts_with(c_phone, '38') OR starts_with(c_phone, '72')
""")
def customers_by_zip_prefix(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.lpad((F.col("c_custkey") * 37 % 100000).cast("string"), 5, "0").alias("zip"))
    return boundaries.zip_prefix(c, "zip", ["38", "72"])


@register("regions_with_added_rows", ("S10", "O5"), """
SELECT r_regionkey, r_name FROM region UNION ALL SELECT * FROM (VALUES (100, 'ATLANTIS'), (101, NULL)) t(a, b)
""")
def regions_with_added_rows(spark, sf_dir):
    r = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("int").alias("r_regionkey"), "r_name")
    return S.add_rows(r, spark, [(100, "ATLANTIS"), (101, None)], "r_regionkey int, r_name string")


@register("tree_lines_file", ("K5",), "SELECT n_name AS value FROM nation")
def tree_lines_file(spark, sf_dir):
    path = scratch_path(spark, "lines")
    K.write_lines(table(spark, sf_dir, "nation"), "n_name", path)
    return spark.read.text(path)


@register("order_priority_labels", ("F10", "F11"), """
SELECT DISTINCT o_orderpriority, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'today' WHEN '2' THEN 'tomorrow' WHEN '3' THEN 'this week' END AS due
FROM orders
""")
def order_priority_labels(spark, sf_dir):
    p = C.distinct_values(table(spark, sf_dir, "orders"), "o_orderpriority")
    p = p.withColumn("k", F.substring("o_orderpriority", 1, 1).cast("long"))
    return C.label_by_position(p, "k", ["today", "tomorrow", "this week"], "due").drop("k")


@register("customer_parcels", ("J10",), """
SELECT c_custkey, c_custkey % 2 = 0 AS found FROM customer
""")
def customer_parcels(spark, sf_dir):
    """Addresses spelled one way in the requests, another in the parcels."""
    c = table(spark, sf_dir, "customer").select("c_custkey")
    number = F.col("c_custkey").cast("string")
    req = c.select("c_custkey", F.concat(number, F.lit(" North  Main Street.")).alias("addr"))
    par = c.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("parcel"), F.concat(number, F.lit(" N MAIN ST")).alias("paddr"))
    got = J.address_to_parcel(req, par, "addr", "paddr")
    return got.select("c_custkey", (F.col("parcel") == F.col("c_custkey")).alias("hit")) \
        .select("c_custkey", F.coalesce("hit", F.lit(False)).alias("found"))


_STREET = "upper(p_name || ' ' || p_type)"


@register("near_addresses", ("J10",), f"""
WITH p AS (SELECT p_partkey, p_partkey % 500 AS number, {_STREET} AS street FROM part),
s AS (SELECT c_custkey, c_custkey % 500 AS number, {_STREET} AS full_street FROM customer JOIN part ON c_custkey = p_partkey),
r AS (SELECT c_custkey, number, substr(full_street, 1, 2 + CAST(c_custkey % 5 AS INTEGER)) || substr(full_street, 4 + CAST(c_custkey % 5 AS INTEGER)) AS street FROM s),
g AS (SELECT c_custkey, p_partkey, levenshtein(r.street, p.street) AS d FROM r JOIN p USING (number)
      WHERE list_has_any(list_transform(range(1, length(r.street) - 1), lambda i: substr(r.street, i, 3)),
                         list_transform(range(1, length(p.street) - 1), lambda i: substr(p.street, i, 3)))
        AND levenshtein(r.street, p.street) <= length(r.street) * 0.25),
b AS (SELECT c_custkey, p_partkey, d, row_number() OVER (PARTITION BY c_custkey ORDER BY d, p_partkey) AS k FROM g)
SELECT r.c_custkey, b.p_partkey, CAST(b.d AS INTEGER) AS distance FROM r LEFT JOIN b ON r.c_custkey = b.c_custkey AND k = 1
""")
def near_addresses(spark, sf_dir):
    """Requests whose street lacks a letter, against parcels on parts' names."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    number = lambda key: (F.col(key) % 500).cast("string")
    parcels = p.select("p_partkey", F.concat_ws(" ", number("p_partkey"), F.expr(_STREET)).alias("paddr"))
    at = (F.col("c_custkey") % 5).cast("int")
    street = F.expr(_STREET)
    wrong = F.concat(F.substring(street, F.lit(1), 2 + at), F.substring(street, 4 + at, F.char_length(street)))
    req = (table(spark, sf_dir, "customer").select("c_custkey").join(p, F.col("c_custkey") == F.col("p_partkey"))
           .select("c_custkey", F.concat_ws(" ", number("c_custkey"), wrong).alias("addr")))
    return J.nearest_address(req, parcels, "addr", "paddr", "p_partkey").select("c_custkey", "p_partkey", "distance")


@register("segment_category_codes", ("R7", "R3"), """
WITH s AS (SELECT c_mktsegment AS category, lpad(CAST(min(c_nationkey) % 100 AS VARCHAR), 2, '0') AS num, max(c_nationkey) > 3 AS has_c
           FROM customer GROUP BY 1)
SELECT 'B' || num || CASE WHEN has_c THEN ' & C' || num ELSE '' END AS v_start, category FROM s
""")
def segment_category_codes(spark, sf_dir):
    s = table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.min("c_nationkey").alias("lo"), F.max("c_nationkey").alias("hi"))
    num = F.lpad((F.col("lo") % 100).cast("string"), 2, "0")
    b = s.select(F.concat(F.lit("B"), num).alias("v_start"), F.col("c_mktsegment").alias("category"))
    c = s.where("hi > 3").select(F.concat(F.lit("C"), num).alias("v_start"), F.concat("c_mktsegment", F.lit(" (Condensed)")).alias("category"))
    return R.category_codes(b.union(c))


@register("segment_balance_wide", ("R2",), """
SELECT * FROM (PIVOT (SELECT c_nationkey, c_mktsegment FROM customer WHERE c_mktsegment IS NOT NULL) ON c_mktsegment USING nullif(count(*), 0) GROUP BY c_nationkey)
""")
def segment_balance_wide(spark, sf_dir):
    """One column per segment that the data has."""
    n = table(spark, sf_dir, "customer").where("c_mktsegment is not null").groupBy("c_nationkey", "c_mktsegment").agg(F.count(F.lit(1)).alias("b"))
    names = sorted(r[0] for r in n.select("c_mktsegment").distinct().collect())     # becomes the columns
    return R.long_to_wide(n, ["c_nationkey"], "c_mktsegment", "b", names)


@register("orders_two_level_mean", ("A2",), """
SELECT o_orderstatus, ROUND(AVG(total), 4) AS mean_total, COUNT(*) AS n
FROM (SELECT o_orderstatus, CAST(o_orderdate AS DATE) AS day, SUM(CAST(ROUND(o_totalprice) AS BIGINT)) AS total FROM orders GROUP BY 1, 2) GROUP BY 1
""")
def orders_two_level_mean(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderstatus", F.to_date("o_orderdate").alias("day"), F.round("o_totalprice").cast("long").alias("v"))
    return A.two_level_mean(o, ["o_orderstatus", "day"], ["o_orderstatus"], "v").withColumn("mean_total", F.round("mean_total", 4))


@register("balance_shortfall", ("A14",), """
SELECT c_nationkey, CAST(SUM(5000 - CAST(ROUND(c_acctbal) AS BIGINT)) AS DOUBLE) AS debt FROM customer GROUP BY 1
""")
def balance_shortfall(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_nationkey", F.round("c_acctbal").cast("long").alias("b"))
    return A.shortfall(c, ["c_nationkey"], "b", 5000.0).withColumn("debt", F.round("debt", 2))


@register("orders_enriched", ("J4", "J5"), """
SELECT o_orderkey, h.holiday FROM orders LEFT JOIN (VALUES (DATE '1996-12-25', 'Christmas'), (DATE '1997-01-01', 'New Year')) h(day, holiday)
ON CAST(o_orderdate AS DATE) = h.day
""")
def orders_enriched(spark, sf_dir):
    h = S.lookup(spark, [("1996-12-25", "Christmas"), ("1997-01-01", "New Year")], "d string, holiday string") \
        .select(F.to_date("d").alias("day"), "holiday")
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    return J.enrich(o, h, "day", small=True).select("o_orderkey", "holiday")


@register("part_name_patterns", ("X4", "X5", "X6", "X7", "X8"), r"""
SELECT p_partkey, regexp_matches(p_name, '^[a-m]') AS early, starts_with(p_type, 'ST') AS st,
       regexp_replace(p_name, '[aeiou]', '', 'g') AS no_vowels, regexp_replace(p_name, ' +', '-', 'g') AS dashed,
       regexp_replace(regexp_replace(p_name, 'e', '3', 'g'), '3r', 'er', 'g') AS chained,
       array_to_string(regexp_extract_all(p_name, '[a-z]*r'), ',') AS with_r
FROM part
""")
def part_name_patterns(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", X.detect("p_name", "^[a-m]").alias("early"), X.starts_with("p_type", "ST").alias("st"),
                    X.remove_all("p_name", "[aeiou]").alias("no_vowels"), X.replace_all("p_name", " +", "-").alias("dashed"),
                    X.replace_chain("p_name", [("e", "3"), ("3r", "er")]).alias("chained"),
                    F.array_join(X.extract_all("p_name", "[a-z]*r"), ",").alias("with_r"))


@register("first_customers", ("O2", "F1"), """
SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer ORDER BY c_name DESC NULLS LAST, c_custkey LIMIT 15
""")
def first_customers(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    return O.head(C.drop_matching(c, suffix="segment"), 15, "-c_name", "c_custkey")


@register("requests_queried", ("F12", "S2"), """
SELECT lower(o_orderpriority) AS request_priority, o_orderkey AS incident_id FROM orders
WHERE lower(o_orderpriority) = '2-high' AND CAST(o_orderdate AS DATE) = DATE '1997-01-12'
""")
def requests_queried(spark, sf_dir):
    """``get_311`` on a landed request table whose text is stored lower-case."""
    path = scratch_path(spark, "requests")
    o = table(spark, sf_dir, "orders")
    K.write_parquet(o.select(F.col("o_orderkey").alias("incident_id"), F.lower("o_orderpriority").alias("request_priority"),
                             F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss.SSS").alias("creation_date")), path)
    got = requests.get_requests(S.read_requests(spark, path, None), lowered=True, request_priority="2-HIGH", creation_date="1997-01-12")
    return got.select("request_priority", "incident_id")


@register("product_list_enriched", ("X2", "J2", "F6"), r"""
WITH p AS (SELECT p_partkey, p_brand, regexp_replace(p_type, '20\d\d', 'YEAR', 'g') AS type,
  array_to_string(list_transform(string_split(lower(p_name), ' '), lambda x: upper(substr(x, 1, 1)) || substr(x, 2)), ' ') AS title FROM part),
b AS (SELECT p_brand, COUNT(*) AS brand_parts FROM part GROUP BY 1)
SELECT p.*, b.brand_parts FROM p LEFT JOIN b USING (p_brand) WHERE regexp_matches(type, '^[A-M]')
""")
def product_list_enriched(spark, sf_dir):
    """A product list: titles, masked years, a filter and a natural join."""
    p = table(spark, sf_dir, "part")
    listed = p.select("p_partkey", "p_brand", X.replace_all("p_type", r"20\d\d", "YEAR").alias("type"), X.title_case("p_name").alias("title"))
    listed = listed.where(C.matches("type", "^[A-M]"))
    return J.natural_join(listed, p.groupBy("p_brand").agg(F.count(F.lit(1)).alias("brand_parts")))


def part_catalogue(parts):
    """A variable list over the years from parts: codes B25nnn_001 and C25...,
    one for each part, a concept that a third of the rows lack, one row per year."""
    key = F.col("p_partkey")
    p = parts.select("p_partkey", "p_type").where("p_type is not null")
    years = F.explode(F.sequence(F.lit(2005), F.lit(2005) + (key % 6).cast("int"))).alias("year")
    y = p.select("p_partkey", "p_type", years)
    number = F.when(key < 1000, F.lpad(key.cast("string"), 3, "0")).otherwise(key.cast("string"))
    code = F.concat(F.when(key % 5 == 0, F.lit("C")).otherwise(F.lit("B")), F.lit("25"),
                    number, F.when(key % 7 == 0, F.lit("A")).otherwise(F.lit("")),
                    F.lit("_"), F.when(key % 4 == 0, F.lit("002")).otherwise(F.lit("001")))
    concept = F.when((key + F.col("year")) % 3 != 0, F.upper("p_type"))
    return y.select("year", code.alias("name"), F.lit("Estimate!!Total").alias("label"), concept.alias("concept"))


_CATALOGUE_SQL = r"""
WITH cat AS (SELECT p_partkey AS k, CAST(2005 + r.i AS INTEGER) AS year,
    CASE WHEN p_partkey % 5 = 0 THEN 'C' ELSE 'B' END || '25' || CASE WHEN p_partkey < 1000 THEN lpad(CAST(p_partkey AS VARCHAR), 3, '0') ELSE CAST(p_partkey AS VARCHAR) END ||
    CASE WHEN p_partkey % 7 = 0 THEN 'A' ELSE '' END || '_' || CASE WHEN p_partkey % 4 = 0 THEN '002' ELSE '001' END AS name,
    CASE WHEN (p_partkey + 2005 + r.i) % 3 <> 0 THEN upper(p_type) END AS concept
  FROM part, range(0, 6) r(i) WHERE r.i <= p_partkey % 6 AND p_type IS NOT NULL),
top AS (SELECT year, name, array_to_string(list_transform(string_split(lower(concept), ' '), lambda x: upper(substr(x, 1, 1)) || substr(x, 2)), ' ') AS concept
  FROM cat WHERE regexp_matches(name, '_001$') AND NOT regexp_matches(name, '[A-Za-z]_')),
filled AS (SELECT year, name, coalesce(concept, first_value(concept IGNORE NULLS) OVER (PARTITION BY name ORDER BY year
  ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS concept FROM top)
"""
_YEAR_RANGES_SQL = _CATALOGUE_SQL + """
SELECT name, concept, CASE WHEN min(year) = max(year) THEN '(' || min(year) || ')' ELSE '(' || min(year) || '-' || max(year) || ')' END AS year_range
FROM filled GROUP BY 1, 2
"""
_YEARS_PER_CONCEPT_SQL = _CATALOGUE_SQL + """
SELECT name, concept, string_agg(CAST(year AS VARCHAR), ', ' ORDER BY year) AS years FROM top GROUP BY 1, 2
"""


@register("catalogue_year_ranges", ("F6", "W2", "W1", "A7", "X2"), _YEAR_RANGES_SQL)
def catalogue_year_ranges(spark, sf_dir):
    cat = part_catalogue(table(spark, sf_dir, "part"))
    return acs_catalog.year_ranges(acs_catalog.fill_concepts(acs_catalog.top_level(acs_catalog.housing_variables(cat))))


@register("catalogue_years_per_concept", ("A8",), _YEARS_PER_CONCEPT_SQL)
def catalogue_years_per_concept(spark, sf_dir):
    cat = part_catalogue(table(spark, sf_dir, "part"))
    return acs_catalog.years_per_concept(acs_catalog.top_level(acs_catalog.housing_variables(cat)))


# Names of the round in which the two above read some parts only.
register("catalogue_year_ranges_all_parts", ("F6", "W2", "W1", "A7", "X2"), _YEAR_RANGES_SQL)(catalogue_year_ranges)
register("catalogue_years_per_concept_all_parts", ("A8",), _YEARS_PER_CONCEPT_SQL)(catalogue_years_per_concept)


# A part's description, and a pattern from each part of a brand's largest size.
_DESCRIBED = "p_name || ' ' || p_type || ' ' || p_brand || ' no ' || CAST(p_partkey AS VARCHAR)"
_PART_PATTERN = "'^' || split_part(p_name, ' ', 1) || ' [a-z]+ ' || p_type || ' ' || p_brand || ' no [0-9]*' || right(CAST(p_partkey AS VARCHAR), 1) || '$'"


@register("parts_matching_patterns", ("J7", "X9"), f"""
WITH top AS (SELECT p_brand AS b, max(p_size) AS m FROM part GROUP BY 1),
pats AS (SELECT DISTINCT {_PART_PATTERN} AS p FROM part JOIN top ON p_brand = b AND p_size = m)
SELECT p_partkey FROM part WHERE EXISTS (SELECT 1 FROM pats WHERE regexp_matches({_DESCRIBED}, p))
""")
def parts_matching_patterns(spark, sf_dir):
    """Parts whose description matches any pattern built from the largest
    parts of each brand (same first word, type, brand and last digit)."""
    p = table(spark, sf_dir, "part")
    top = p.groupBy(F.col("p_brand").alias("b")).agg(F.max("p_size").alias("m"))
    pats = p.join(top, (p["p_brand"] == top["b"]) & (p["p_size"] == top["m"])).select(F.expr(_PART_PATTERN.replace("VARCHAR", "STRING")).alias("p"))
    described = p.select("p_partkey", F.expr(_DESCRIBED.replace("VARCHAR", "STRING")).alias("description"))
    return J.keep_matching_any(described, "description", pats, "p").select("p_partkey")


@register("status_series_gaps", ("A13", "W6", "X12", "X10"), """
WITH s AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, o_orderstatus AS dataset, COUNT(*) AS estimate FROM orders GROUP BY 1, 2)
SELECT year, dataset, estimate, estimate - lag(estimate) OVER (PARTITION BY dataset ORDER BY year) AS change,
  '<b>' || dataset || '<br>Year: </b>' || CAST(year AS VARCHAR) || '<br>' || format('{:,}', estimate) AS label FROM s
""")
def status_series_gaps(spark, sf_dir):
    s = table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("year"), F.col("o_orderstatus").alias("dataset")) \
        .agg(F.count(F.lit(1)).alias("estimate"))
    return surveys.with_labels(surveys.changes(s)).select("year", "dataset", "estimate", "change", "label")
