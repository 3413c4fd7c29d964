"""Join operators.

Lookup tables with a proven small size (hand-written pattern lists,
holiday lists, dictionaries of a few thousand rows) are broadcast
explicitly. Joins between tables that grow with the data are left to
Catalyst + AQE: a sort-merge join that AQE turns into a broadcast when a
side measures small at run time, and whose skewed partitions it splits.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicframe.session import cut_lineage

# Bytes of one alternation of patterns that have no literal (one filter takes it).
PATTERN_BLOCK_BYTES = 1 << 16
# Filters of such alternations in one plan; more are written before the next.
PATTERN_BLOCKS = 8
# Distinct grams (8 bytes each) that a semi join broadcasts; more are shuffled.
BROADCAST_GRAMS = 1 << 20
# Fixed value: characters of the grams that literals are looked up by.
GRAM = 8


def left_join_keys(left: DataFrame, right: DataFrame, left_key: str, right_key: str,
                   small_right: bool = False) -> DataFrame:
    """Left join on differently named keys; the right key is dropped."""
    r = F.broadcast(right) if small_right else right
    return left.join(r, left[left_key] == r[right_key], "left").drop(r[right_key])


def shared_columns(left: DataFrame, right: DataFrame) -> list[str]:
    return [c for c in left.columns if c in right.columns]


def natural_join(left: DataFrame, right: DataFrame, how: str = "left") -> DataFrame:
    """dplyr's natural join: on every shared column, null matching
    null. For a full join the shared keys are coalesced from both sides."""
    keys = shared_columns(left, right)
    if not keys:
        raise ValueError("natural join needs at least one shared column")
    cond = reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])
    joined = left.join(right, cond, how)
    key_cols = [F.coalesce(left[k], right[k]).alias(k) if how in ("full", "outer", "full_outer", "right")
                else left[k] for k in keys]
    rest_l = [left[c] for c in left.columns if c not in keys]
    rest_r = [right[c] for c in right.columns if c not in keys]
    return joined.select(*key_cols, *rest_l, *rest_r)


def stack_tables(frames) -> DataFrame:
    """O5 / J3 when no row can match: union by name, missing columns null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def enrich(df: DataFrame, dictionary: DataFrame, on, small: bool = False) -> DataFrame:
    """Attach lookup columns (left join). ``small``: the caller vouches
    for the lookup's size (a hand-written list) and it is broadcast; else AQE
    broadcasts it if it measures small."""
    d = F.broadcast(dictionary) if small else dictionary
    return df.join(d, on, "left")


def drop_if_equals_any(df: DataFrame, text_col: str, lookup: DataFrame, lookup_cols) -> DataFrame:
    """Drop rows whose text equals a value in any of the lookup columns.
    The lookup columns are stacked into one distinct value list and used in
    an anti join (null text is kept, like R's ``%in%``)."""
    vals = reduce(lambda a, b: a.union(b),
                  [lookup.select(F.col(c).alias("_v")) for c in lookup_cols]).where(F.col("_v").isNotNull()).distinct()
    return df.join(vals, df[text_col] == vals["_v"], "left_anti")


def _keyed(df: DataFrame, text_col: str) -> DataFrame:
    """(_k, _t): the non-null texts under a digest of their own, so that a row
    is found again by its text, whatever ids it has."""
    t = F.col(text_col).cast("string")
    return df.select(t.alias("_t")).where(F.col("_t").isNotNull()).select(_text_key("_t").alias("_k"), "_t")


def _text_key(text_col: str) -> Column:
    return F.unhex(F.sha2(F.col(text_col).cast("string").cast("binary"), 256))


def _pair_grams(words: str) -> Column:
    """Hashes of an array's neighbouring words."""
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, 1, n), F.slice(words, 2, n), lambda a, b: F.xxhash64(F.lit(-1), a, b))


def _char_grams(text: str, size: int) -> Column:
    """Hashes of all runs of ``size`` characters, in one pass of the matcher."""
    runs = F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1))
    return F.transform(runs, lambda g: F.xxhash64(F.lit(size), g))


def _candidates(texts: DataFrame, items: DataFrame, together: Column) -> DataFrame:
    """(_k, _t, _items): texts that hold the rarest gram of an item's literal,
    with ``together`` (an aggregate of ``_item``) of the items of that gram.

    Texts meet blocks of items, never single items: a gram's items are
    dealt by their hash to blocks of about ``PATTERN_BLOCK_BYTES``. Rows are few
    numbers and digests until the blocks are joined last, and stand by block, so
    a block is prepared once for the texts that follow each other.

    ``items``: (_item, _lit), every text that matches the item contains the
    literal. A literal of four or more space-separated words is looked up by pairs of
    its inner words: as spaces stand on both sides of them, they are whole words of
    any text that contains it. A shorter one is looked up by runs of
    ``GRAM`` characters (or all it has). Of a literal's grams the one in the
    fewest texts decides, and a literal with a gram in no text is nowhere. Each
    text is cut into grams once, in time linear in its length; only hashes of grams that
    some literal has are written.
    """
    items = cut_lineage(items.select("_item", "_lit", F.split("_lit", " ").alias("_w"), F.char_length("_lit").alias("_n"))
                        .select("_item", "_lit", F.expr("slice(_w, 2, greatest(size(_w) - 2, 0))").alias("_w"),
                                F.expr(f"if(size(_w) >= 4, -1, least(_n, {GRAM}))").alias("_size")))
    sizes = sorted(r["_size"] for r in items.select("_size").distinct().collect())      # at most GRAM + 2 numbers
    of_items, of_texts = [], []
    for n in sizes:
        own, cut = items.where(F.col("_size") == n), texts
        if n < 0:
            grams, source = _pair_grams("_w"), F.split("_t", " ").alias("_w")
            each = F.explode(F.array_distinct(_pair_grams("_w")))
        else:
            grams, source = _char_grams("_lit", n), F.col("_t")
            each = F.explode(F.array_distinct(_char_grams("_t", n)))
        of_items.append(own.select("_item", F.explode(F.array_distinct(grams)).alias("_g")))
        of_texts.append(cut.select("_k", source).select("_k", each.alias("_g")))
    if not sizes:
        return texts.crossJoin(items.agg(together.alias("_items"))).limit(0)
    wanted = cut_lineage(reduce(DataFrame.union, of_items))
    grams = wanted.select("_g").distinct()
    if grams.count() <= BROADCAST_GRAMS:
        grams = F.broadcast(grams)
    held = cut_lineage(reduce(DataFrame.union, of_texts).join(grams, "_g", "left_semi"))
    often = held.groupBy("_g").agg(F.count(F.lit(1)).alias("_often"))
    rarest = (wanted.join(often, "_g", "left").groupBy("_item")
              .agg(F.min(F.struct(F.coalesce("_often", F.lit(0)).alias("n"), F.col("_g").alias("g"))).alias("_r"))
              .where("_r.n > 0").select("_item", F.col("_r.g").alias("_g")))
    rarest = cut_lineage(rarest)
    blocks = rarest.groupBy("_g").agg(F.ceil(F.sum(F.octet_length("_item") + 8) / PATTERN_BLOCK_BYTES).alias("_blocks"))
    dealt = rarest.join(blocks, "_g").groupBy("_g", F.pmod(F.xxhash64("_item"), "_blocks").alias("_b")).agg(together.alias("_items"))
    met = (held.join(blocks, "_g").distinct().join(texts, "_k")
           .select("_k", "_t", "_g", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)).alias("_b")))
    return cut_lineage(met.sortWithinPartitions("_g", "_b")).join(dealt, ["_g", "_b"]).select("_k", "_t", "_items")


def _rows_of(df: DataFrame, text_col: str, keys: DataFrame) -> DataFrame:
    """Rows whose text has one of the keys; ids and other columns don't matter."""
    return (df.withColumn("_text_key", _text_key(text_col))
            .join(keys.select(F.col("_k").alias("_text_key")).distinct(), "_text_key", "left_semi").select(*df.columns))


def required_literal(pattern: str | Column) -> Column:
    """The longest run of characters that every match of a (Java) regular
    expression contains, null where none is sure.

    Groups, classes, escapes and what a quantifier may leave out are cut away;
    alternatives at the top, inline flags, quoting and escapes that stand for characters
    or groups by number or name give null.
    """
    p = F.col(pattern) if isinstance(pattern, str) else pattern
    unsure = p.rlike(r"\\[^dDwWsSbBAzZhHvV.\[\](){}*+?^$|\\/#\-]") | p.rlike(r"\(\?[a-zA-Z-]|\[\]|\[\^\]|\[[^\]]*\[|&&")
    gap = "\x01"
    s = F.regexp_replace(p, r"\\.", gap)
    s = F.regexp_replace(s, r"\[[^\]]*\]", gap)
    for _ in range(4):     # groups, innermost first; deeper ones stay and give null
        s = F.regexp_replace(s, r"\([^()]*\)", gap)
    s = F.regexp_replace(s, r"([*+?}])[?+]", "$1")
    unsure = unsure | s.rlike(r"[()|]")
    s = F.regexp_replace(s, r"(?s).(?:[*?]|\{[^}]*\})", gap)
    s = F.regexp_replace(s, r"[.^$+]", gap)
    runs = F.transform(F.split(s, gap), lambda r: F.struct(F.char_length(r).alias("n"), r.alias("r")))
    best = F.array_max(runs)["r"]
    return F.when(~unsure & (best != ""), best)


def keep_matching_any(df: DataFrame, text_col: str, patterns: DataFrame, pattern_col: str,
                      literal: bool = False) -> DataFrame:
    """Keep rows whose text matches any pattern of a table built from
    data, of any size.

    Plain names (``literal=True``) are an equi semi join. Regular expressions
    are looked up by a literal that each match must contain
    (:func:`required_literal`): an equi-join on grams finds the candidates (see
    :func:`_candidates`) and ``rlike`` decides there only. Patterns without
    such a literal become alternations of at most ``PATTERN_BLOCK_BYTES`` each, one
    filter a block. Null texts and patterns match nothing.
    """
    if literal:
        return df.join(patterns.select(F.col(pattern_col).alias("_p")).distinct(),
                       df[text_col] == F.col("_p"), "left_semi")
    # written as they are and with their literals: long expressions that filters would be pushed into
    vals = cut_lineage(patterns.select(F.col(pattern_col).cast("string").alias("_item")).where(F.col("_item").isNotNull()).distinct())
    texts = _keyed(df, text_col)
    # group numbers and names are the pattern's own, and an open class would take in the next pattern
    vals = cut_lineage(vals.select("_item", required_literal("_item").alias("_lit"), (F.col("_item").rlike(r"\\[1-9k]|\(\?<[a-zA-Z]")
                                   | F.regexp_replace(F.regexp_replace("_item", r"\\.", ""), r"\[[^\]]*\]", "").contains("[")).alias("_alone")))
    one_of = F.array_join(F.collect_list(F.concat(F.lit("(?:"), "_item", F.lit(")"))), "|")
    by_literal = vals.where(F.col("_lit").isNotNull())
    # regexp_instr keeps the pattern it compiled last, rlike compiles one a row
    found = [_candidates(texts, by_literal.where("not _alone"), one_of).where("regexp_instr(_t, _items) > 0").select("_k"),
             _candidates(texts, by_literal.where("_alone"), F.collect_list("_item")).where("exists(_items, p -> _t rlike p)").select("_k")]

    def block_of(block):
        return texts.where(F.col("_t").rlike("|".join(f"(?:{p})" for p in block))).select("_k")
    block, size = [], 0
    # streamed in order; the driver holds one block
    for r in vals.where(F.col("_lit").isNull()).orderBy("_item").toLocalIterator():
        p = r["_item"]
        alone = re.search(r"\\[1-9k]|\(\?<[a-zA-Z]", p)      # group numbers and names are the pattern's own
        if block and (alone or size + len(p) > PATTERN_BLOCK_BYTES):
            found.append(block_of(block))
            block, size = [], 0
        if alone:
            found.append(block_of([p]))
        else:
            block.append(p)
            size += len(p)
        if len(found) > PATTERN_BLOCKS:
            found = [cut_lineage(reduce(DataFrame.union, found))]
    if block:
        found.append(block_of(block))
    return _rows_of(df, text_col, reduce(DataFrame.union, found))


def normalise_address(col):
    """Upper case, punctuation dropped, spaces squeezed, common street
    words shortened; used as the key of an address-to-parcel equi-join."""
    c = F.upper(F.col(col) if isinstance(col, str) else col)
    c = F.regexp_replace(c, r"[\p{P}]", " ")
    # USPS street suffix abbreviations used when matching.
    for long, short in (("STREET", "ST"), ("AVENUE", "AVE"), ("ROAD", "RD"), ("DRIVE", "DR"),
                        ("BOULEVARD", "BLVD"), ("LANE", "LN"), ("COVE", "CV"), ("PLACE", "PL"),
                        ("COURT", "CT"), ("PARKWAY", "PKWY"), ("NORTH", "N"), ("SOUTH", "S"),
                        ("EAST", "E"), ("WEST", "W")):
        c = F.regexp_replace(c, rf"\b{long}\b", short)
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def address_to_parcel(requests: DataFrame, parcels: DataFrame, req_addr: str, parcel_addr: str) -> DataFrame:
    """Match requests to parcels on the normalised address (equi-join,
    shuffled on the key; a hot address is split by AQE's skew handling)."""
    r = requests.withColumn("_addr_key", normalise_address(req_addr))
    p = parcels.withColumn("_addr_key", normalise_address(parcel_addr))
    return r.join(p.drop(parcel_addr), "_addr_key", "left").drop("_addr_key")


def _runs(text: str, size: int = 3) -> Column:
    """All distinct runs of ``size`` letters."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?=(.{{{size}}}))"), F.lit(1)))


def _one_off(text: str) -> Column:
    """Hashes of a text and of all texts that lack one of its letters. Two texts one
    edit apart have one in common."""
    lacking = (f"transform(sequence(1, char_length({text})), i -> xxhash64(concat(substring({text}, 1, i - 1), "
               f"substring({text}, i + 1, char_length({text})))))")
    return F.expr(f"array_distinct(concat(array(xxhash64({text})), {lacking}))")


# A text of n letters cut into t + 1 pieces of as even a length as can be: the last n % (t + 1) have one letter more.
_PIECES = ("transform(sequence(0, t), i -> named_struct('i', i, 'n', n div (t + 1) + if(i > t - n % (t + 1), 1, 0), "
           "'at', i * (n div (t + 1)) + greatest(0, i - (t + 1 - n % (t + 1)))))")


def _near_by_one(asked: DataFrame, streets: DataFrame) -> DataFrame:
    """Pairs of the same number that are at most one edit apart and have a run of three letters in common."""
    pairs = (asked.select("_number", "_street", "_most", F.explode(_one_off("_street")).alias("_g"))
             .join(streets.select("_number", "_other", "_id", F.explode(_one_off("_other")).alias("_g")), ["_number", "_g"])
             .withColumn("_d", F.levenshtein("_street", "_other")).where(F.col("_d") <= F.least(F.lit(1), "_most")))
    return pairs.where(F.arrays_overlap(_runs("_street"), _runs("_other")))


def _near_by_pieces(asked: DataFrame, streets: DataFrame, limit: int, max_share: float) -> DataFrame:
    """Pairs of the same number that are at most ``limit`` edits apart (and at
    most the request's own bound) and have a run of three letters in common.

    A street is cut into one piece more than its edits t: some piece i is
    unchanged, with at most i edits before it and t - i after it, so it is looked for
    among the other street's runs and must lie about where it did. Where
    pieces would be shorter than three letters, all runs of three are looked up.
    """
    q = (asked.select("_number", "_street", F.char_length("_street").alias("n"), F.least(F.lit(limit), "_most").alias("t"))
         .withColumn("_short", F.expr("n div (t + 1) < 3"))
         .withColumn("_p", F.explode(F.when(F.col("_short"), F.transform(_runs("_street"), lambda g: F.struct(F.lit(-1).alias("i"), F.lit(0).alias("at"), g.alias("g"))))
                                     .otherwise(F.transform(F.expr(_PIECES), lambda x: F.struct(
                                         x["i"].cast("int").alias("i"), x["at"].cast("int").alias("at"), F.substring("_street", x["at"] + 1, x["n"]).alias("g"))))))
         .select("_number", "_street", "n", "t", "_p.i", "_p.at", F.col("_p.g").alias("_g")))
    # lengths of the pieces of requests that are near enough in length
    lengths = (f"array_distinct(flatten(transform(filter(transform(sequence(greatest(3, m - {limit}), m + {limit}), "
               f"n -> named_struct('n', n, 't', least({limit}, cast(floor(n * {max_share}D) as int)))), x -> abs(x.n - m) <= x.t), "
               "x -> if(x.n div (x.t + 1) < 3, array(3), if(x.n % (x.t + 1) = 0, array(x.n div (x.t + 1)), array(x.n div (x.t + 1), x.n div (x.t + 1) + 1))))))")
    p = (streets.join(asked.select("_number").distinct(), "_number", "left_semi")
         .withColumn("m", F.char_length("_other")).where(F.col("m") >= 3)
         .withColumn("_l", F.explode(F.expr(lengths))).where("_l <= m")
         .withColumn("_at", F.explode(F.expr("sequence(0, m - _l)")))
         .select("_number", "_other", "_id", "m", "_at", F.expr("substring(_other, _at + 1, _l)").alias("_g")))
    where = ("abs(m - n) <= t and (i < 0 or (_at - at between -i and i and _at - at - (m - n) between i - t and t - i))")
    return q.join(p, ["_number", "_g"]).where(where).withColumn("_d", F.levenshtein("_street", "_other")).where("_d <= t")


def nearest_address(requests: DataFrame, parcels: DataFrame, req_addr: str, parcel_addr: str, parcel_id: str,
                    max_share: float = 0.25, distance: str = "distance") -> DataFrame:
    """J10 for misspelt streets: each request with the parcel of the same house
    number whose street is nearest by edit distance, if that is at most
    ``max_share`` of the request's street (ties: smallest ``parcel_id``) and the
    two have a run of three letters in common; without one the parcel columns are null.

    Each distinct address is looked up once, in rounds that allow 1, 3, 7, ...
    edits; what a round finds is nearest and drops out. Candidates of the first
    round are equal but for one letter (see :func:`_one_off`), those of the
    others share a piece at about the same place (see :func:`_near_by_pieces`),
    and such pieces are the longer the fewer edits a round allows. Edit distance is worked
    out for candidates only, and the best is a partial aggregate, so a house
    number that very many addresses have is no group in one task.
    """
    def parts(df, addr):
        a = df.withColumn("_norm", normalise_address(addr))
        return a.select("*", F.regexp_extract("_norm", r"^(\d+) ", 1).alias("_number"), F.regexp_extract("_norm", r"^\d+ (.+)$", 1).alias("_street")).drop("_norm")
    r = cut_lineage(parts(requests, req_addr))
    p = cut_lineage(parts(parcels, parcel_addr))
    # a run of three letters takes three
    long_enough = F.char_length("_street") >= 3
    streets = cut_lineage(p.where(long_enough).groupBy("_number", F.col("_street").alias("_other")).agg(F.min(F.struct(parcel_id)).alias("_id")))
    most = F.floor(F.char_length("_street") * max_share).cast("int").alias("_most")
    todo = cut_lineage(r.where(long_enough).select("_number", "_street").distinct().select("_number", "_street", most))
    found, limit = [], 1
    while not found or not todo.isEmpty():
        near = _near_by_one(todo, streets) if limit == 1 else _near_by_pieces(todo, streets, limit, max_share)
        found.append(cut_lineage(near.groupBy("_number", "_street").agg(F.min(F.struct("_d", "_id")).alias("_b"))))
        todo = cut_lineage(todo.where(F.col("_most") > limit).join(found[-1], ["_number", "_street"], "left_anti"))
        limit = 2 * limit + 1
    best = reduce(DataFrame.union, found).select("_number", "_street", F.col(f"_b._id.{parcel_id}").alias(parcel_id), F.col("_b._d").alias(distance))
    got = r.join(best, ["_number", "_street"], "left")
    others = [c for c in parcels.columns if c not in (parcel_id, parcel_addr)]
    if others:
        got = got.drop("_number", "_street").join(p.select(parcel_id, *others).dropDuplicates([parcel_id]), parcel_id, "left")
    return got.select(*requests.columns, parcel_id, *others, distance)


def semi_join_contains(df: DataFrame, text_col: str, items: DataFrame, item_col: str, id_col: str | None = None) -> DataFrame:
    """J7 for literal items: keep rows whose text contains any item as a
    substring. Null texts and items match nothing; an empty item is contained in
    every text. Candidates come from an equi-join on each item's rarest gram (see
    :func:`_candidates`), then ``contains`` decides. Rows are found again by
    their text: ``id_col`` is not needed, and ids may be null or repeated.
    """
    it = items.select(F.col(item_col).cast("string").alias("_item")).where(F.col("_item").isNotNull()).distinct()
    found = (_candidates(_keyed(df, text_col), it.withColumn("_lit", F.col("_item")), F.collect_list("_item"))
             .where("exists(_items, i -> contains(_t, i))"))
    return _rows_of(df, text_col, found)
