"""The steps of the note cleaning one by one, over ``documents`` with a phrase
appended to each text, so that every pattern table has matches.

Letters outside ASCII are written as ``x`` first: word boundaries are Unicode
here and ASCII in the SQL engine that checks these plans.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from civicframe.functions import note_lookups as L
from civicframe.functions.regex import alternation, java_regex
from civicframe.functions.strings import squish
from civicframe.operators.parallel import widen
from civicframe.operators.text import extract_and_strip, gated_fold_replace
from civicframe.plans import notes as N
from civicframe.plans.registry import register, table

# Phrases, picked by doc_id.
PHRASES = [
    "called 901-555-0134 about it", "call 555-0199 in 545-2677 days", "on 3/14/2023 the yard is cut", "fu 2023-11-02 no violation found",
    "insp found the violstion resloved", "property is incompliance uc tenante", "per inspector a marlow will monitor property",
    "h. yearwood and f oduya went back", "first attempt made to make contact", "after second unsuccessful visit this complaint",
    "at the time of reinspection vacant house", "upon follow up inspection the house is occupied", "wrong address given for this sr is cancelled",
    "insufficient information to locate a violation", "there was no code violation present at this address", "the property was secured and boarded up",
    "no one was home test sr only", "tenant moved out of the unit", "issued notice to rehab property", "the tenant stated that nothing works",
    "i spoke with the tenants today", "spoke to tenant on 4 5 22 nj ja noh", "all repairs have been completed to this unit", "plain words only",
]


def noted(spark, sf_dir):
    d = widen(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    phrase = F.element_at(F.array(*[F.lit(p) for p in PHRASES]), (F.col("doc_id") % len(PHRASES) + 1).cast("int"))
    text = F.lower(F.regexp_replace("text", r"[^\x00-\x7F]", "x"))
    return d.select("doc_id", F.concat_ws(" ", text, phrase).alias("note"))


_LIST = "[" + ", ".join(f"'{p}'" for p in PHRASES) + "]"
_NOTED = rf"""
WITH n AS (SELECT doc_id, concat_ws(' ', lower(regexp_replace(text, '[^\x00-\x7F]', 'x', 'g')), {_LIST}[CAST(doc_id % {len(PHRASES)} AS INTEGER) + 1]) AS note
           FROM documents)
"""


def _re2(pattern: str) -> str:
    return java_regex(pattern, unicode=False).replace("'", "''")


def _squish(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def _step_sql(patterns, out: str) -> str:
    """One extract-and-strip step: matches mapped in order, text left over."""
    alt = _re2(patterns if isinstance(patterns, str) else alternation([p for p, _ in patterns]))
    one = "x"
    if not isinstance(patterns, str):
        for p, o in patterns:
            one = f"regexp_replace({one}, '{_re2(p)}', '{o}', 'g')"
    found = f"regexp_extract_all(note, '{alt}')"
    mapped = found if one == "x" else f"list_transform({found}, lambda x: {one})"
    left = _squish(f"regexp_replace(note, '{alt}', '', 'g')")
    return _NOTED + f"SELECT doc_id, array_to_string({mapped}, '|') AS {out}, md5({left}) AS left_md5, CAST(len({found}) AS INTEGER) AS n_found FROM n"


def _step(spark, sf_dir, patterns, out: str):
    d = extract_and_strip(noted(spark, sf_dir), "note", patterns, out, drop_empty=False)
    return d.select("doc_id", F.array_join(out, "|").alias(out), F.md5("note").alias("left_md5"), F.size(out).alias("n_found"))


# The engine that checks has no look-ahead: a number before " days" is matched
# with it and put back.
_PHONE_DAYS = _re2(L.PHONE.replace("(?! days)", "( days)?"))


@register("note_phones", ("N2", "X8"), _NOTED + f"""
, m AS (SELECT doc_id, note, list_filter(regexp_extract_all(note, '{_PHONE_DAYS}'), lambda x: NOT ends_with(x, ' days')) AS found FROM n)
SELECT doc_id, array_to_string(found, '|') AS phone, CAST(len(found) AS INTEGER) AS n_found FROM m
""")
def note_phones(spark, sf_dir):
    return _step(spark, sf_dir, L.PHONE, "phone").drop("left_md5")


@register("note_dates", ("N3", "X8"), _step_sql(L.DATE, "update_date"))
def note_dates(spark, sf_dir):
    return _step(spark, sf_dir, L.DATE, "update_date")


def _typos_sql() -> str:
    x = "note"
    for p, o in L.TYPOS:
        if p.startswith("(?<=this )"):
            x = f"regexp_replace({x}, '(this ){p[10:]}', '\\1{o}', 'g')"
        else:
            x = f"regexp_replace({x}, '{_re2(p)}', '{o}', 'g')"
    return _NOTED + f"SELECT doc_id, md5({x}) AS fixed_md5 FROM n"


@register("note_typos", ("N5", "X7"), _typos_sql())
def note_typos(spark, sf_dir):
    return noted(spark, sf_dir).select("doc_id", F.md5(gated_fold_replace("note", L.TYPOS)).alias("fixed_md5"))


@register("note_inspectors", ("N6", "X9"), _step_sql(L.inspector_pairs(), "inspector"))
def note_inspectors(spark, sf_dir):
    return _step(spark, sf_dir, L.inspector_pairs(), "inspector")


@register("note_visits", ("N8", "X9"), _step_sql(L.VISIT_TYPES, "update_type"))
def note_visits(spark, sf_dir):
    return _step(spark, sf_dir, L.VISIT_TYPES, "update_type")


@register("note_status_tags", ("N9", "X9"), _step_sql(L.STATUS_TAGS, "update_tags"))
def note_status_tags(spark, sf_dir):
    return _step(spark, sf_dir, L.STATUS_TAGS, "update_tags")


@register("note_contacts", ("N10", "X9"), _step_sql(L.CONTACTS, "contact"))
def note_contacts(spark, sf_dir):
    return _step(spark, sf_dir, L.CONTACTS, "contact")


def sentences(spark, sf_dir):
    """The sentences of the notes, a note each, with their place."""
    d = noted(spark, sf_dir).select("doc_id", F.posexplode(F.split("note", r"[.!?;\n]+")).alias("pos", "note"))
    return d.withColumn("note", squish(F.col("note"))).where("note <> ''")


_SENTENCES = _NOTED.rstrip() + rf"""
, q AS (SELECT doc_id, regexp_split_to_array(note, '[.!?;\n]+') AS p FROM n),
s AS (SELECT doc_id, i - 1 AS pos, {_squish("p[i]")} AS note FROM q, range(1, len(p) + 1) r(i) WHERE {_squish("p[i]")} <> '')
"""
_ALL_TAGS = _re2(alternation([p for p, _ in L.STATUS_TAGS]))
_LEFT_OVER = _squish(f"regexp_replace(note, '{_ALL_TAGS}', '', 'g')")


@register("phrase_residuals", ("N11", "A5"), _SENTENCES + f"SELECT {_LEFT_OVER} AS note, COUNT(*) AS n FROM s GROUP BY 1")
def phrase_residuals(spark, sf_dir):
    """What the status tags leave of the documents' sentences, most common first."""
    left = extract_and_strip(sentences(spark, sf_dir), "note", L.STATUS_TAGS, "tags", drop_empty=False)
    return N.residual_frequency(left, "note")


@register("short_note_residuals", ("N11", "X11"), _SENTENCES + f"SELECT doc_id, CAST(pos AS INTEGER) AS pos, {_LEFT_OVER} AS note FROM s WHERE length({_LEFT_OVER}) = 2")
def short_note_residuals(spark, sf_dir):
    """Sentences of which the status tags leave two characters."""
    left = extract_and_strip(sentences(spark, sf_dir), "note", L.STATUS_TAGS, "tags", drop_empty=False)
    return N.short_residuals(left, "note").select("doc_id", "pos", "note")


_NO_MARKS = _squish(r"regexp_replace(regexp_replace(x, '\p{S}|;|\(|\)|/|-', ' ', 'g'), '\p{P}', '', 'g')")


@register("notes_beyond_codes", ("N7", "J6"), _SENTENCES + f"""
, m AS (SELECT note AS x FROM s WHERE pos = 0),
c AS (SELECT x AS v FROM m UNION SELECT {_NO_MARKS} FROM m UNION SELECT lower(source) FROM documents WHERE source IS NOT NULL)
SELECT doc_id, COUNT(*) AS n, CAST(MIN(pos) AS INTEGER) AS first_pos FROM s WHERE NOT EXISTS (SELECT 1 FROM c WHERE v = note) GROUP BY 1
""")
def notes_beyond_codes(spark, sf_dir):
    """Sentences that say more than a code (a source) or its meaning (a
    document's first sentence, with its marks or without)."""
    s = sentences(spark, sf_dir)
    code = table(spark, sf_dir, "documents").select("doc_id", F.lower("source").alias("RESOLUTION_CODE"))
    raw = s.where("pos = 0").join(code, "doc_id", "full").select("RESOLUTION_CODE", F.col("note").alias("RESOLUTION_CODE_MEANING"))
    left = N.drop_code_notes(s, N.resolution_table(raw), "note")
    return left.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first_pos"))


@register("building_requests", ("N1", "F5"), """
SELECT conv_id, turn FROM (SELECT conv_id, turn, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS s, role FROM conversations)
WHERE NOT regexp_matches(s, '""" + _re2(alternation(L.NOT_RELEVANT)) + """') AND role <> 'system' AND role <> s
""")
def building_requests(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.lower("text").alias("RESOLUTION_SUMMARY"), F.col("role").alias("RESOLUTION_CODE"),
        F.when(F.col("role") == "system", "Litter").otherwise("CE-Derelict").alias("REQUEST_TYPE"))
    return N.building_notes(c).select("conv_id", "turn")
