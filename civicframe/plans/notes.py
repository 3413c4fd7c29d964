"""Cleaning inspection notes of 311 service requests, and the same
cleaning run over the driver's ``documents``.

One lazy plan: every step but the resolution-code anti join and the
residual frequency table is narrow (no shuffle).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicframe.functions import note_lookups as L
from civicframe.functions import times as T
from civicframe.functions.regex import alternation, java_regex
from civicframe.functions.strings import squish
from civicframe.operators import columns as C
from civicframe.operators import joins as J
from civicframe.operators.parallel import widen
from civicframe.operators.text import drop_emptied, extract_and_strip, gated_fold_replace
from civicframe.plans.registry import register, table


def code_enforcement_requests(requests: DataFrame, department: str = "Code Enforcement") -> DataFrame:
    """S2 + F1 + F4 + T1 + O1 + A7: the department's requests, the columns the
    cleaning needs, resolution text lower-cased, dates parsed, newest first,
    duplicates dropped. Filter and projection reach the Parquet scan."""
    keep = ["INCIDENT_NUMBER", "PARCEL_ID", "ADDRESS1", "REQUEST_TYPE", "CE_CATEGORY",
            "RESOLUTION_CODE:RESOLUTION_SUMMARY", "REQUEST_STATUS", "REPORTED_DATE", "LAST_MODIFIED_DATE",
            "OWNER_NAME", "CREATED_BY_USER", "location1"]
    keep = [k for k in keep if ":" in k or k in requests.columns]
    r = C.select_spec(requests.where(F.col("DEPARTMENT") == department), *keep)
    r = C.across(r, F.lower, prefix="RESOLUTION_")
    r = C.across(r, lambda c: T.parse_timestamp(c, T.MDY_HMS), suffix="_DATE")
    return r.distinct()


def resolution_table(raw: DataFrame) -> DataFrame:
    """Distinct (code, meaning) pairs with a punctuation-free meaning."""
    t = raw.select("RESOLUTION_CODE", "RESOLUTION_CODE_MEANING") \
        .where(F.col("RESOLUTION_CODE_MEANING").isNotNull()).distinct()
    return t.withColumn("code_meaning_2", normalise_punctuation(F.col("RESOLUTION_CODE_MEANING")))


def normalise_punctuation(col):
    """Symbols and ``; ( ) / -`` to a space, other punctuation dropped,
    spaces squished."""
    c = F.regexp_replace(col, F.lit(java_regex(L.PUNCT_TO_SPACE)), F.lit(" "))
    c = F.regexp_replace(c, F.lit(java_regex(L.PUNCT_DROP)), F.lit(""))
    return squish(c)


def building_notes(raw: DataFrame) -> DataFrame:
    """Keep notes that may be about a building."""
    s = squish(F.col("RESOLUTION_SUMMARY"))
    junk = java_regex(alternation(L.NOT_RELEVANT))
    r = raw.withColumn("RESOLUTION_SUMMARY", s)
    return r.where(~F.col("RESOLUTION_SUMMARY").rlike(junk)
                   & F.col("REQUEST_TYPE").rlike(L.BUILDING_REQUEST_TYPES)
                   & C.not_in("RESOLUTION_CODE", L.NOT_HOUSING)
                   & F.col("RESOLUTION_SUMMARY").isNotNull()
                   & (F.col("RESOLUTION_CODE") != F.col("RESOLUTION_SUMMARY")))


def strip_phones_dates(df: DataFrame, text: str) -> DataFrame:
    """N2 + N3: phone numbers and dates out of the note; leading
    non-word characters then removed; emptied notes dropped."""
    d = extract_and_strip(df, text, L.PHONE, "phone", drop_empty=False)
    d = extract_and_strip(d, text, L.DATE, "update_date", drop_empty=False)
    return d.withColumn(text, squish(F.regexp_replace(F.col(text), F.lit(java_regex(L.LEADING_JUNK)), F.lit(""))))


def fix_and_tag_inspectors(df: DataFrame, text: str, inspectors=None) -> DataFrame:
    """N4 + N5 + N6: punctuation, typo chain, inspector names."""
    d = df.withColumn(text, normalise_punctuation(F.col(text)))
    d = d.withColumn(text, gated_fold_replace(F.col(text), L.TYPOS))
    return extract_and_strip(d, text, L.inspector_pairs(inspectors or L.INSPECTORS), "inspector", drop_empty=False)


def tag_visits_status_contacts(df: DataFrame, text: str) -> DataFrame:
    """N8 + N9 + N10."""
    d = extract_and_strip(df, text, L.VISIT_TYPES, "update_type", drop_empty=False)
    d = extract_and_strip(d, text, L.STATUS_TAGS, "update_tags", drop_empty=False)
    return extract_and_strip(d, text, L.CONTACTS, "contact", drop_empty=False)


def clean_notes(raw: DataFrame, inspectors=None) -> DataFrame:
    """The whole of P1 on a parsed request table (see
    :func:`code_enforcement_requests`)."""
    text = "RESOLUTION_SUMMARY"
    codes = resolution_table(raw)
    notes = building_notes(raw).select("INCIDENT_NUMBER", text).withColumn("original_summary", F.col(text))
    notes = strip_phones_dates(notes, text)
    notes = fix_and_tag_inspectors(notes, text, inspectors)
    # the emptied notes are dropped first so the join sees only live notes
    notes = drop_code_notes(drop_emptied(notes, text), codes, text)
    return drop_emptied(tag_visits_status_contacts(notes, text), text)


def drop_code_notes(notes: DataFrame, codes: DataFrame, text: str) -> DataFrame:
    """A note that only repeats a code or its meaning says nothing.
    ``codes``: see :func:`resolution_table`."""
    return J.drop_if_equals_any(notes, text, codes, ["RESOLUTION_CODE", "RESOLUTION_CODE_MEANING", "code_meaning_2"])


def residual_frequency(cleaned: DataFrame, text: str = "RESOLUTION_SUMMARY") -> DataFrame:
    """What is left, most common first."""
    return cleaned.groupBy(text).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc(text))


def short_residuals(cleaned: DataFrame, text: str = "RESOLUTION_SUMMARY", length: int = 2) -> DataFrame:
    """Notes of exactly ``length`` characters."""
    return cleaned.where(F.char_length(text) == length)


# --- the same cleaning over the driver's documents ---------------------------

def _documents_notes(spark, sf_dir):
    d = widen(table(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("note")), "doc_id")
    d = strip_phones_dates(d, "note")
    d = fix_and_tag_inspectors(d, "note")
    return drop_emptied(tag_visits_status_contacts(d, "note"), "note")


@register("document_note_cleaning", ("N2", "N3", "N4", "N5", "N6", "N8", "N9", "N10", "X7", "X8"))
def document_note_cleaning(spark, sf_dir):
    """Look-around patterns (phone, typo) have no DuckDB equivalent: the
    driver checks row counts only; tests check against hand-made notes."""
    d = _documents_notes(spark, sf_dir)
    return d.select("doc_id", "phone", "update_date", "inspector", "update_type", "update_tags", "contact",
                    F.char_length("note").alias("residual_chars"))


@register("document_note_residuals", ("N11", "A5", "X11"))
def document_note_residuals(spark, sf_dir):
    d = _documents_notes(spark, sf_dir).select(F.sha2("note", 256).alias("_sha"), F.md5("note").alias("note_md5"))
    return d.groupBy("_sha", "note_md5").agg(F.count(F.lit(1)).alias("n")).select("note_md5", "n")


@register("document_punctuation", ("N4", "X3", "X6"), r"""
SELECT doc_id,
  md5(trim(regexp_replace(regexp_replace(regexp_replace(lower(text), '\p{S}|;|\(|\)|/|-', ' ', 'g'),
                                         '\p{P}', '', 'g'), '\s+', ' ', 'g'))) AS cleaned_md5
FROM documents
""")
def document_punctuation(spark, sf_dir):
    d = widen(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    c = normalise_punctuation(F.lower("text"))
    return d.select("doc_id", F.md5(c).alias("cleaned_md5"))


@register("document_contacts", ("X8", "X4"), r"""
SELECT doc_id,
  regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') AS emails,
  regexp_extract_all(text, '[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}') AS ips,
  regexp_matches(text, '\([0-9]{3}\) [0-9]{3}-[0-9]{4}') AS has_phone
FROM documents
""")
def document_contacts(spark, sf_dir):
    d = widen(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return d.select(
        "doc_id",
        F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), 0).alias("emails"),
        F.regexp_extract_all("text", F.lit(r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"), 0).alias("ips"),
        F.col("text").rlike(r"\([0-9]{3}\) [0-9]{3}-[0-9]{4}").alias("has_phone"))


@register("conversation_requests_cleaned", ("S2", "F1", "F4", "T1", "A7", "N1", "N7", "N2", "N9", "N11"))
def conversation_requests_cleaned(spark, sf_dir):
    """The whole of P1 on request rows shaped from ``conversations``: every
    turn is a note, its role the resolution code (``system`` turns filed by
    another department), the request type alternating between the two
    building types, dates written the 311 way."""
    c = table(spark, sf_dir, "conversations")
    ts = F.timestamp_add("MINUTE", F.col("turn").cast("int"),
                         F.timestamp_add("DAY", (F.col("conv_id") % 365).cast("int"), F.lit("2024-01-01 08:00:00").cast("timestamp")))
    req = c.select(
        F.when(F.col("role") == "system", "Solid Waste").otherwise("Code Enforcement").alias("DEPARTMENT"),
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("INCIDENT_NUMBER"),
        F.col("conv_id").cast("string").alias("PARCEL_ID"), F.lit(None).cast("string").alias("ADDRESS1"),
        F.when(F.col("conv_id") % 2 == 0, "CE-Miscellaneous").otherwise("CE-Derelict").alias("REQUEST_TYPE"),
        F.lit("Housing").alias("CE_CATEGORY"), F.upper("role").alias("RESOLUTION_CODE"),
        F.concat(F.upper("role"), F.lit(" turn")).alias("RESOLUTION_CODE_MEANING"),
        F.col("text").alias("RESOLUTION_SUMMARY"), F.lit("Closed").alias("REQUEST_STATUS"),
        F.date_format(ts, T.MDY_HMS).alias("REPORTED_DATE"), F.date_format(ts, T.MDY_HMS).alias("LAST_MODIFIED_DATE"),
        F.lit(None).cast("string").alias("OWNER_NAME"), F.lit("user").alias("CREATED_BY_USER"),
        F.lit(None).cast("string").alias("location1"))
    raw = code_enforcement_requests(widen(req, "INCIDENT_NUMBER"))
    cleaned = clean_notes(raw)
    return cleaned.select("INCIDENT_NUMBER", "phone", "update_date", "inspector", "update_type", "update_tags",
                          "contact", F.char_length("RESOLUTION_SUMMARY").alias("residual_chars"))
