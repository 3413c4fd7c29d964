"""Plans on documents / labels / benchmark / conversations: repeated
texts, filled labels, benchmark passages, echo removal."""

from __future__ import annotations

from pyspark.sql import functions as F

from civicframe.functions.strings import squish
from civicframe.operators import aggregate as A
from civicframe.operators import joins as J
from civicframe.operators import windows as W
from civicframe.operators.parallel import widen
from civicframe.plans.registry import register, table


@register("repeated_texts", ("A6",), """
SELECT md5(text) AS text_md5, COUNT(*) AS n, MIN(doc_id) AS first_doc FROM documents GROUP BY text HAVING COUNT(*) > 1
""")
def repeated_texts(spark, sf_dir):
    """Whole texts are compared through a fingerprint (SHA-256, MD5 and
    length) computed in the scan stage, so the shuffle moves a few dozen
    bytes per document instead of the text."""
    d = table(spark, sf_dir, "documents").select("doc_id", *text_fingerprint("text"))
    g = d.groupBy("_sha", "text_md5", "_len").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc"))
    return g.where(F.col("n") > 1).select("text_md5", "n", "first_doc")


def text_fingerprint(col: str):
    """Grouping key that stands for a whole text."""
    return [F.sha2(F.col(col), 256).alias("_sha"), F.md5(F.col(col)).alias("text_md5"),
            F.char_length(F.col(col)).alias("_len")]


@register("repeated_sources", ("A6", "A7"), """
SELECT lang, source, COUNT(*) AS n FROM (SELECT DISTINCT lang, source, text FROM documents)
GROUP BY 1, 2 HAVING COUNT(*) > 1
""")
def repeated_sources(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("lang", "source", *text_fingerprint("text")).distinct()
    return A.repeated_groups(d, ["lang", "source"])


@register("fill_quality_up", ("W2", "J1"), """
WITH j AS (SELECT d.doc_id, d.lang, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
SELECT doc_id, lang,
  coalesce(quality, first_value(quality IGNORE NULLS) OVER (PARTITION BY lang ORDER BY doc_id
           ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS quality
FROM j
""")
def fill_quality_up(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality")
    j = d.join(lab, "doc_id", "left")
    return W.fill_up(j, ["lang"], ["doc_id"], ["quality"]).select("doc_id", "lang", "quality")


@register("benchmark_passages", ("J7",), """
SELECT d.doc_id FROM documents d WHERE EXISTS (SELECT 1 FROM benchmark b WHERE contains(d.text, b.text))
""")
def benchmark_passages(spark, sf_dir):
    """Documents that contain a whole benchmark item (an equi-join on each
    item's rarest word pair, then ``contains``; see :func:`joins.semi_join_contains`)."""
    d = widen(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    b = table(spark, sf_dir, "benchmark").select("text")
    return J.semi_join_contains(d, "text", b, "text", "doc_id").select("doc_id")


@register("turns_not_echoing_benchmark", ("J6",), r"""
WITH v AS (SELECT text AS v FROM benchmark UNION SELECT lower(text) FROM benchmark
           UNION SELECT trim(regexp_replace(text, '\s+', ' ', 'g')) FROM benchmark)
SELECT conv_id, turn FROM conversations c WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.v = c.text)
""")
def turns_not_echoing_benchmark(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    b = table(spark, sf_dir, "benchmark").select("text")
    look = b.select(F.col("text").alias("raw"), F.lower("text").alias("lowered"), squish("text").alias("squished"))
    return J.drop_if_equals_any(c, "text", look, ["raw", "lowered", "squished"]).select("conv_id", "turn")
