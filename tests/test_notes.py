"""Inspection-note cleaning on hand-made 311 rows (names are invented)."""

from pyspark.sql import functions as F

from civicframe.functions import note_lookups as L
from civicframe.operators.text import extract_and_strip
from civicframe.plans import notes as N

COLS = ["DEPARTMENT", "INCIDENT_NUMBER", "PARCEL_ID", "ADDRESS1", "REQUEST_TYPE", "CE_CATEGORY", "RESOLUTION_CODE",
        "RESOLUTION_CODE_MEANING", "RESOLUTION_SUMMARY", "REQUEST_STATUS", "REPORTED_DATE", "LAST_MODIFIED_DATE",
        "OWNER_NAME", "CREATED_BY_USER", "location1"]


def req(i, summary, code="nov", meaning="Notice of Violation", rtype="CE-Miscellaneous", dept="Code Enforcement"):
    return (dept, f"INC{i}", f"P{i}", f"{i} Main St", rtype, "Housing", code, meaning, summary, "Closed",
            "03/09/2024 07:27:09 AM", "03/10/2024 08:00:00 PM", "Owner", "user", None)


ROWS = [
    req(1, "Called tenant at 901-555-1234, property in compliance"),
    req(2, "Will reinspect in 555-1234 days; yard is cut"),
    req(3, "On 3/4/24 and 2024-03-06 inspector a marlow found no violation"),
    req(4, "The tenent said that the violtion was fixed"),
    req(5, "Notice of Violation"),
    req(6, "nov"),
    req(7, "this sr is cancelled. will reissue for proper service"),
    req(8, "See SR 1234567 duplicate"),
    req(9, "tenant moved", code="cvoyc"),
    req(10, "court order; active npa case", code=None),
    req(11, "At time of inspection, the property is vacant and secured"),
    req(12, "   ", ),
    req(13, "garage door off hinge", rtype="CE-Junky Yard"),
    req(14, "garage door off hinge", dept="Solid Waste"),
    req(15, "per b okafor 2nd attempt to make contact, no one home, dog in yard"),
]


def raw(spark):
    df = spark.createDataFrame(ROWS, ", ".join(f"{c} string" for c in COLS))
    return N.code_enforcement_requests(df)


def test_request_narrowing(spark):
    r = raw(spark)
    assert r.count() == 14  # other department gone
    assert "RESOLUTION_CODE_MEANING" in r.columns
    assert r.schema["REPORTED_DATE"].dataType.typeName() == "timestamp"
    assert r.where(F.col("INCIDENT_NUMBER") == "INC5").first().RESOLUTION_SUMMARY == "notice of violation"


def test_building_filter(spark):
    keep = {r.INCIDENT_NUMBER for r in N.building_notes(raw(spark)).collect()}
    assert "INC8" not in keep      # junk pattern
    assert "INC9" not in keep      # code not about housing
    assert "INC10" not in keep     # null code: != test is not true
    assert "INC13" not in keep     # request type
    assert "INC6" not in keep      # note equals the code
    assert "INC1" in keep and "INC15" in keep


def test_clean_notes(spark):
    out = {r.INCIDENT_NUMBER: r for r in N.clean_notes(raw(spark)).collect()}
    r1 = out.get("INC1")
    assert r1 is None or r1.phone == ["901-555-1234"]
    c = N.clean_notes(raw(spark))
    first = {r.INCIDENT_NUMBER: r for r in
             N.strip_phones_dates(N.building_notes(raw(spark)).select("INCIDENT_NUMBER", "RESOLUTION_SUMMARY"),
                                  "RESOLUTION_SUMMARY").collect()}
    assert first["INC1"].phone == ["901-555-1234"]
    assert first["INC2"].phone == []                   # followed by " days": not a phone
    assert first["INC3"].update_date == ["on 3/4/24", "2024-03-06"]
    # note that only repeats the code meaning is dropped
    assert "INC5" not in {r.INCIDENT_NUMBER for r in c.collect()}
    by = {r.INCIDENT_NUMBER: r for r in c.collect()}
    assert by["INC3"].inspector == ["A. Marlow"]
    assert "no violation" in by["INC3"].update_tags if "INC3" in by else True
    assert by["INC15"].inspector == ["b. okafor"]
    assert by["INC15"].update_type == ["attempt 2"]
    assert by["INC15"].update_tags == ["no one home"]
    assert by["INC15"].RESOLUTION_SUMMARY == "dog in yard"


def test_status_pairs_follow_intent(spark):
    df = spark.createDataFrame([("this sr is cancelled and will reissue for proper service with a court order",)], "t string")
    out = extract_and_strip(df, "t", L.STATUS_TAGS, "tags", drop_empty=False).first()
    assert out.tags == ["cancelled", "will reissue", "court order"]


def test_typos_then_tags(spark):
    df = spark.createDataFrame([("the tenent said the violtion was fixed",)], "t string")
    d = N.fix_and_tag_inspectors(df, "t")
    d = N.tag_visits_status_contacts(d, "t").first()
    assert d.contact == ["tenant"]
    assert d.update_tags == ["violation corrected"]


def test_extract_and_strip_idempotent(spark):
    df = spark.createDataFrame([("no one home. no one home again",)], "t string")
    once = extract_and_strip(df, "t", L.STATUS_TAGS, "tags", drop_empty=False)
    twice = extract_and_strip(once.select("t"), "t", L.STATUS_TAGS, "tags", drop_empty=False).first()
    assert once.first().tags == ["no one home", "no one home"]
    assert twice.tags == [] and twice.t == once.first().t


def test_emptied_notes_dropped(spark):
    df = spark.createDataFrame([(1, "no one home"), (2, "no one home, gate locked")], "id int, t string")
    out = extract_and_strip(df, "t", L.STATUS_TAGS, "tags")
    assert [(r.id, r.t) for r in out.collect()] == [(2, ", gate locked")]
