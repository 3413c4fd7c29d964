"""A census variable list over the years: year ranges, filled
concepts, changed names, category codes and a path tree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicframe.functions.regex import java_regex
from civicframe.operators import reshape as R
from civicframe.operators import windows as W

# Concepts the 2010 and 2011 lists lack for two variables.
CONCEPT_FALLBACK = {"B25028_001": "Tenure By Year Structure Built",
                    "B25029_001": "Tenure By Year Householder Moved Into Unit"}


def housing_variables(catalog: DataFrame) -> DataFrame:
    """housing tables start with B25 or C25."""
    return catalog.where(F.col("name").rlike("^[BC]25"))


def top_level(catalog: DataFrame) -> DataFrame:
    """F6 + X7 + X2: top-level (``_001``) variables, race variants and
    aggregates left out, concept standardised and in title case."""
    t = catalog.where(F.col("name").rlike("_001$")
                      & ~F.col("name").rlike(java_regex("[:alpha:]_"))
                      & ~F.coalesce(F.col("label").contains("Estimate!!Aggregate"), F.lit(False)))
    return t.select("year", "name", R.concept_title("concept").alias("concept"))


def fill_concepts(top: DataFrame) -> DataFrame:
    """W2 + F7: a missing concept takes the next year's; two known gaps get
    fixed names."""
    f = W.fill_up(top, ["name"], ["year"], ["concept"])
    fix = F.col("concept")
    for name, concept in CONCEPT_FALLBACK.items():
        fix = F.when(fix.isNull() & (F.col("name") == name), F.lit(concept)).otherwise(fix)
    return f.withColumn("concept", fix)


def year_ranges(filled: DataFrame) -> DataFrame:
    """W1 + A7: parentheticals dropped from the concept, then per (name,
    concept) the span of years, ``(2005-2023)`` or ``(2005)``."""
    c = filled.withColumn("concept", F.regexp_replace("concept", r"\(.*\)", ""))
    e = W.group_extremes(c, ["name", "concept"], "year", "_first", "_last")
    return e.select("name", "concept", W.year_span_label("_first", "_last").alias("year_range")).distinct()


def file_strings(ranges: DataFrame) -> DataFrame:
    """R4 + X6: ``Concept/Words/B25003-(2005-2023)`` paths."""
    concept = F.regexp_replace("concept", java_regex("-(?=[:alpha:])"), " ")
    concept = F.regexp_replace(concept, java_regex("[:punct:]"), "")
    concept = F.trim(F.regexp_replace(concept, r"\s+", " "))
    concept = F.regexp_replace(concept, " By ", "/")
    name = F.regexp_replace("name", "_001", "")
    name = F.concat_ws("-", name, F.col("year_range"))
    path = F.concat_ws("/", concept, name)
    path = F.regexp_replace(F.regexp_replace(path, r"\s", "-"), "-{2,}", "-")
    return ranges.select(path.alias("path"))


def variable_tree(catalog: DataFrame) -> DataFrame:
    """The whole of P4: catalog rows (name, label, concept, year) to tree
    nodes (R8)."""
    return R.path_tree(file_strings(year_ranges(fill_concepts(top_level(housing_variables(catalog))))))


def changed_variables(top: DataFrame) -> DataFrame:
    """A6 + J7: variables whose concept changed over the years (more than
    one concept per name, missing concepts left out), and every catalogue
    row with one of these names (plain names: an equi semi join)."""
    from civicframe.operators import aggregate as A
    from civicframe.operators import joins as J
    known = top.where(F.col("concept").isNotNull())
    changed = A.repeated_groups(known.select("name", "concept").distinct(), ["name"])
    return J.keep_matching_any(known, "name", changed, "name", literal=True)


def years_per_concept(top: DataFrame) -> DataFrame:
    """Per (name, concept) the years it appears, ``"2005, 2006, ..."``."""
    from civicframe.operators import aggregate as A
    return A.collapse(top, ["name", "concept"], "year", "years", ", ")


def year_spans_backdated(top: DataFrame) -> DataFrame:
    """W1 variant: per (name, concept) ``(first-last)``, a span starting in
    2012 read as starting in 2010 (the 2010 and 2011 lists lack concepts),
    a single year printed bare."""
    known = top.where(F.col("concept").isNotNull())
    e = W.group_extremes(known, ["name", "concept"], "year", "_first", "_last")
    label = W.year_span_label("_first", "_last", backdate={2012: 2010}, parens_single=False)
    return e.select("name", "concept", label.alias("years")).distinct()
