"""Queries of the operators of this subpackage on the driver's tables.

``QUERIES``: name -> (spark, sf_dir) -> DataFrame; ``ORACLE``: DuckDB SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (convtrie, decontaminate, license_scan, lmscore, mixing, multiindex, pii, quality, secrets, simhash, suffixdedup, tokenalign,
               tokencount)
from .common import shared_path, table

QUERIES = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight and decision of every document."""
    got = quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return got.select("doc_id", "n_grams", F.round("log_weight", 6).alias("log_weight"), F.round("key", 6).alias("key"), "accepted")


@query
def op2_simhash_gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op3_suffix_automaton_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = license_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


@query
def op4_inverted_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiindex.near_duplicates(table(spark, sf_dir, "embeddings"))


def span_text(spans: str) -> F.Column:
    """'kind:start:end' of an array of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def kind_count(spans: str, kind: str) -> F.Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


@query
def op5_bilstm_crf_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", *(kind_count("base", k).alias(f"n_{k}") for k in pii.KINDS),
                      F.sha2(span_text("base").cast("binary"), 256).alias("base_sha256"), span_text("found").alias("spans"))


@query
def op6_aho_corasick_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = decontaminate.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return got.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


WORDS = (r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
         r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")
ORACLE["op6_aho_corasick_decontamination"] = rf"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
b AS (SELECT item_id, {WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), {decontaminate.WINDOW}) AS n,
         array_to_string(list_slice(w, i, i + least(len(w), {decontaminate.WINDOW}) - 1), ' ') AS g
       FROM b, range(1, greatest(len(w) - {decontaminate.WINDOW - 1}, 1) + 1) r(i) WHERE len(w) > 0),
dw AS (SELECT doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g
       FROM d, (SELECT DISTINCT n FROM bw) s, range(1, len(w) - n + 2) r(i) WHERE len(w) >= n),
hit AS (SELECT doc_id, i, bw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hit, range(i, i + n) r(p) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS l
        FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(l, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN ids USING (doc_id)"""


@query
def op7_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source"))
    return got.select("doc_id", "source", "n_in_source", "block", "release", "deadline", "slot", "mixed")


@query
def op7_exact_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, under the name of the round in which ``op7_pfair_mixing``
    rounded the weights to whole slots."""
    return op7_pfair_mixing(spark, sf_dir)


def _pfair_sql(B: int = mixing.BLOCK, S: int = mixing.SEED) -> str:
    """The schedule by a recursive walk over one period's slots."""
    return f"""
WITH RECURSIVE w AS (SELECT source, CAST(floor(sqrt(count(*))) AS BIGINT) AS weight, count(*) AS n FROM documents GROUP BY source),
share AS (SELECT *, sum(weight) OVER () AS total, row_number() OVER (ORDER BY source NULLS FIRST) AS rank FROM w WHERE weight > 0),
g AS (SELECT list_reduce(list(weight), lambda a, b: gcd(a, b)) AS g FROM share),
quota AS (SELECT source, n, rank, CAST(weight // g AS BIGINT) AS q, CAST(total // g AS BIGINT) AS W FROM share, g),
period AS (SELECT max(W) AS W FROM quota),
given AS (SELECT list(q ORDER BY rank) AS qs FROM quota),
ranks AS (SELECT list(rank ORDER BY rank) AS rs FROM quota),
steps(t, qs, g, pick) AS (
  SELECT CAST(-1 AS BIGINT), qs, list_transform(qs, lambda x: CAST(0 AS BIGINT)), CAST(NULL AS BIGINT) FROM given
  UNION ALL
  SELECT t + 1, qs, list_transform(g, lambda x, i: x + CASE WHEN i = c THEN 1 ELSE 0 END), c
  FROM (SELECT t, qs, g, W, list_min(list_filter(list_transform(g, lambda x, i: CASE WHEN x * W // qs[i] <= t + 1
                THEN ((x + 1) * W + qs[i] - 1) // qs[i] * 1000000 + i END), lambda x: x IS NOT NULL)) % 1000000 AS c
        FROM steps, period WHERE t + 1 < W)),
slots AS (SELECT rs[pick] AS rank, t AS at_slot, row_number() OVER (PARTITION BY pick ORDER BY t) AS nth FROM steps, ranks WHERE pick IS NOT NULL),
d AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':{S}'), doc_id) AS n_in_source
      FROM documents),
until AS (SELECT min(W * (((n + {B - 1}) // {B}) // q) + at_slot) AS u FROM quota JOIN slots USING (rank)
          WHERE q > 0 AND nth = ((n + {B - 1}) // {B}) % q + 1),
b AS (SELECT *, (n_in_source - 1) // {B} + 1 AS block FROM d)
SELECT b.doc_id, b.source, n_in_source, block, (block - 1) * W // q AS release, (block * W + q - 1) // q AS deadline,
       W * ((block - 1) // q) + at_slot AS slot, coalesce(W * ((block - 1) // q) + at_slot < u, false) AS mixed
FROM b LEFT JOIN quota k ON b.source IS NOT DISTINCT FROM k.source
LEFT JOIN slots s ON s.rank = k.rank AND s.nth = (block - 1) % q + 1, until"""


ORACLE["op7_pfair_mixing"] = ORACLE["op7_exact_pfair_mixing"] = _pfair_sql()


@query
def op8_assignment_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = secrets.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", *(kind_count("base", k).alias(f"n_{k}") for k in secrets.KINDS[:3]),
                      F.sha2(span_text("base").cast("binary"), 256).alias("base_sha256"), span_text("found").alias("spans"))


@query
def op9_digest_cache_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over a new, empty cache, so that every distinct text is encoded."""
    import public_tokenizers
    return tokencount.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                                   shared_path(spark, "token-cache"))


@query
def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.dedup(table(spark, sf_dir, "documents"))


@query
def op11_identity_map_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return tokenalign.alignment(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                                public_tokenizers.path("piece_bpe_32k.model"))[0]


@query
def op13_count_min_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return convtrie.conversation_trie(table(spark, sf_dir, "conversations"))


# CRC-32 of the decimal id, bit by bit.
CRC32 = ("xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(CAST(c AS VARCHAR), ''), lambda z: ascii(z)::BIGINT), "
         "lambda v, z: list_reduce([xor(v, z), 0, 0, 0, 0, 0, 0, 0, 0], lambda w, y: xor(w >> 1, 3988292384 * (w & 1)))), 4294967295)")
# Prefixes are lists of turns; a node's subtree is summed over all deeper nodes
# on the path of their smallest member.
ORACLE["op13_count_min_conversation_trie"] = f"""
WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
           FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT c, count(*) AS n FROM t GROUP BY c),
k AS (SELECT a.c, a.c - a.c % 100 AS b, h, least(h, coalesce(z.n, 0)) AS k
      FROM (SELECT c, {CRC32} % 6 AS h FROM n) a LEFT JOIN n z ON z.c = a.c - a.c % 100),
re AS (SELECT k.c, i - h + k AS d, r, x FROM t JOIN k ON t.c = k.c WHERE i > h
       UNION ALL SELECT k.c, i, r, x FROM k JOIN t ON t.c = k.b WHERE i <= k),
p AS (SELECT c, d, list({{'r': r, 'x': x}}) OVER (PARTITION BY c ORDER BY d ROWS UNBOUNDED PRECEDING) AS path, length(x) AS len FROM re
      UNION ALL SELECT c, 0, [], 0 FROM n),
e AS (SELECT *, max(d) OVER (PARTITION BY c) AS deepest FROM p),
node AS (SELECT path, min(c) AS conv_id, max(d) AS depth, count(*) AS n_convs, max(len) AS len, max(deepest) AS below,
           sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE d = deepest), '')) AS ends FROM e GROUP BY path),
sub AS (SELECT p.path, sum((n_convs - 1) * node.len) AS saved, count(*) FILTER (WHERE depth = below) AS leaves,
          count(*) FILTER (WHERE depth = p.d + 1) AS children
        FROM node JOIN p ON p.c = node.conv_id AND p.d <= node.depth GROUP BY p.path)
SELECT node.conv_id, node.depth, u.conv_id AS parent_conv_id, node.n_convs, children AS n_children, leaves AS n_leaves,
       CAST(saved AS BIGINT) AS saved_tokens, node.ends AS ends_sha256
FROM node JOIN sub ON sub.path = node.path LEFT JOIN p ON p.c = node.conv_id AND p.d = node.depth - 1 LEFT JOIN node u ON u.path = p.path"""


@query
def op12_elias_fano_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.score(table(spark, sf_dir, "documents"))
