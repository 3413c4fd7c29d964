"""Reshape operators."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicframe.functions.strings import title_case
from civicframe.session import cut_lineage

# Fixed value: wide CHAS column names, e.g. T1_est1, T18C_moe12.
WIDE_MEASURE = re.compile(r"^(T\w+?)_(est|moe)(\d+)$")


def wide_to_long(df: DataFrame, id_cols, pattern=WIDE_MEASURE, code_fmt: str = "{table}_{line}",
                 code_col: str = "variable") -> DataFrame:
    """``T1_est1, T1_moe1, ...`` to one row per (id, variable) with
    ``est`` and ``moe`` columns; variable code ``T1_1``.

    The pairing is read from the schema at plan time, so each wide row is
    exploded in place into its long rows: a narrow step, no shuffle and no
    pivot aggregate.
    """
    pairs: dict[tuple[str, str], dict[str, str]] = {}
    for c in df.columns:
        m = pattern.match(c)
        if m:
            table, kind, line = m.group(1), m.group(2), m.group(3)
            pairs.setdefault((table, line), {})[kind] = c
    items = []
    for (table, line), kinds in sorted(pairs.items(), key=lambda kv: (kv[0][0], int(kv[0][1]))):
        items.append(F.struct(
            F.lit(code_fmt.format(table=table, line=line)).alias(code_col),
            (F.col(kinds["est"]).cast("long") if "est" in kinds else F.lit(None).cast("long")).alias("est"),
            (F.col(kinds["moe"]).cast("long") if "moe" in kinds else F.lit(None).cast("long")).alias("moe")))
    return df.select(*id_cols, F.inline(F.array(*items)))


def long_to_wide(df: DataFrame, id_cols, names_from: str, values_from: str, names) -> DataFrame:
    """R2: one column per name. The names are always given, so Spark does not
    run an extra job to find them."""
    return df.groupBy(*id_cols).pivot(names_from, list(names)).agg(F.first(values_from))


def split_fixed(col, widths) -> list[Column]:
    """Cut a string at fixed widths (``B25`` -> ``B``, ``25``)."""
    c = F.col(col) if isinstance(col, str) else col
    out, pos = [], 1
    for w in widths:
        out.append(F.substring(c, pos, w))
        pos += w
    return out


def standardise_labels(df: DataFrame, text_col: str, lookup: DataFrame, raw_col: str = "raw",
                       label_col: str = "label", concept_col: str = "concept") -> DataFrame:
    """Replace wordy labels by a standard one and attach its concept;
    labels not in the lookup pass through with a null concept. The lookup
    is a short hand-written list: broadcast."""
    lk = F.broadcast(lookup.select(F.col(raw_col).alias("_raw"), F.col(label_col).alias("_label"),
                                   F.col(concept_col).alias("_concept")))
    j = df.join(lk, df[text_col] == lk["_raw"], "left")
    return j.withColumn(text_col, F.coalesce(F.col("_label"), F.col(text_col))) \
        .withColumn(concept_col, F.col("_concept")).drop("_raw", "_label", "_concept")


# Fixed value: what stands between the parts of a label.
PART_SEP = "!!"


def universe_and_label(df: DataFrame, descs=("description_1", "description_2", "description_3",
                                               "description_4", "description_5"), sep: str = PART_SEP) -> DataFrame:
    """First description is the universe; the others, nulls skipped,
    joined into the label."""
    return df.withColumn("universe", F.col(descs[0])) \
        .withColumn("label", F.concat_ws(sep, *[F.col(d) for d in descs[1:]])) \
        .drop(*descs)


def category_codes(df: DataFrame, start_col: str = "v_start", category_col: str = "category") -> DataFrame:
    """Table-id starts ``B02`` and ``C02`` of one category become one row
    ``B02 & C02``; a category with only a B table keeps ``B02``."""
    clean = df.withColumn(category_col, F.regexp_replace(category_col, r" \(Condensed\)", ""))
    let, num = split_fixed(start_col, [1, 2])
    parts = clean.select(category_col, let.alias("let"), num.alias("num"))
    wide = long_to_wide(parts, [category_col], "let", "num", ["B", "C"])
    label = F.when(F.col("C").isNotNull(), F.concat(F.lit("B"), F.col("B"), F.lit(" & C"), F.col("B"))) \
        .otherwise(F.concat(F.lit("B"), F.col("B")))
    return wide.select(label.alias(start_col), category_col)


def concept_title(col) -> Column:
    """P4 helper: year in the concept becomes ``ACSYEAR``, a known typo is
    fixed, then title case."""
    c = F.col(col) if isinstance(col, str) else col
    c = F.regexp_replace(c, r"\b20\d{2}\b", "ACSYEAR")
    c = F.regexp_replace(c, "INCOME THE PAST 12 MONTHS", "INCOME IN THE PAST 12 MONTHS")
    return title_case(c)


# The glyphs of the ``tree`` command (its vertical bar is
# followed by two no-break spaces and one space).
BRANCH, LAST_BRANCH, PIPE, SPACE = "├── ", "└── ", "│\u00a0\u00a0 ", "    "


def path_tree(paths: DataFrame, path_col: str = "path", sep: str = "/") -> DataFrame:
    """Path strings to tree nodes: every prefix becomes a node with its
    depth, its number of children and the line ``tree`` would print for it.

    Nodes are the distinct prefixes (explode of a sequence over the split
    path). A node is the last of its siblings when it has the greatest
    name under its parent (a partial max per parent, joined back). Each
    line is built from the last-sibling flags of the node's ancestors.
    Sort on ``key`` (array of parts) for the printed order.
    """
    parts = paths.select(F.split(F.col(path_col), re.escape(sep)).alias("_parts")).distinct()
    nodes = parts.select(F.explode(F.sequence(F.lit(1), F.size("_parts"))).alias("depth"), "_parts") \
        .select("depth", F.slice("_parts", 1, F.col("depth")).alias("key")).distinct()
    # The node table (distinct prefixes) is read by five joins below; it is
    # bounded by the number of distinct paths, so write it once to the
    # shared checkpoint folder instead of recomputing its source each time.
    nodes = cut_lineage(nodes.select(
        "key", "depth",
        F.element_at("key", -1).alias("name"),
        F.when(F.col("depth") > 1, F.slice("key", 1, F.col("depth") - 1)).otherwise(F.array().cast("array<string>")).alias("parent")))
    last = nodes.groupBy("parent").agg(F.max("name").alias("_last_name"), F.count(F.lit(1)).alias("_siblings"))
    kids = nodes.groupBy(F.col("parent").alias("key")).agg(F.count(F.lit(1)).alias("children"))
    flagged = nodes.join(last, "parent").withColumn("is_last", F.col("name") == F.col("_last_name")) \
        .join(kids, "key", "left").withColumn("children", F.coalesce("children", F.lit(0)).cast("long"))
    # Ancestors' flags: each node looks up the is_last flag of every proper
    # prefix of its key (depth-bounded explode + equi-join + ordered regroup).
    anc = flagged.select("key", F.posexplode(F.sequence(F.lit(1), F.col("depth"))).alias("_i", "_d")) \
        .where(F.col("_d") < F.size("key")) \
        .select("key", "_d", F.slice("key", 1, F.col("_d")).alias("_akey"))
    aflags = flagged.select(F.col("key").alias("_akey"), F.col("is_last").alias("_alast"))
    pads = anc.join(aflags, "_akey").groupBy("key").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_d", "_alast"))),
                                 lambda s: F.when(s["_alast"], F.lit(SPACE)).otherwise(F.lit(PIPE))), "").alias("_pad"))
    out = flagged.join(pads, "key", "left")
    line = F.concat(F.coalesce(F.col("_pad"), F.lit("")),
                    F.when(F.col("is_last"), F.lit(LAST_BRANCH)).otherwise(F.lit(BRANCH)), F.col("name"))
    return out.select(F.array_join("key", sep).alias("path"), "key", "depth", "name", "children",
                      "is_last", line.alias("line"))
