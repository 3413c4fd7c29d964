"""The registered document cleaning checked against a plain-Python version
of the same steps (``regex`` module, one document at a time) on the
smallest driver tables -- the SQL oracle cannot express look-around."""

import pyarrow.parquet as pq
import regex

import __spark_entry__ as E
from civicframe.functions import note_lookups as L
from civicframe.functions.regex import alternation, java_regex
from tests.conftest import SF_SMALL


def py(p):
    return regex.compile(java_regex(p).replace("(?U)", ""))


def squish(s):
    return regex.sub(r"\s+", " ", s).strip()


def step(text, patterns):
    pairs = [(patterns, None)] if isinstance(patterns, str) else patterns
    alt = py(alternation([p for p, _ in pairs]) if len(pairs) > 1 or pairs[0][1] else pairs[0][0])
    found = [m.group(0) for m in alt.finditer(text)]
    if pairs[0][1] is not None:
        mapped = []
        for f in found:
            for p, o in pairs:
                f = py(p).sub(o.replace("\\", "\\\\"), f)
            mapped.append(f)
        found = mapped
    return found, squish(alt.sub("", text))


def clean(text):
    t = text.lower()
    phone, t = step(t, L.PHONE)
    dates, t = step(t, L.DATE)
    t = squish(py(L.LEADING_JUNK).sub("", t))
    t = squish(py(L.PUNCT_DROP).sub("", py(L.PUNCT_TO_SPACE).sub(" ", t)))
    if py(alternation([p for p, _ in L.TYPOS])).search(t):
        for p, o in L.TYPOS:
            t = py(p).sub(o, t)
    insp, t = step(t, L.inspector_pairs())
    visit, t = step(t, L.VISIT_TYPES)
    tags, t = step(t, L.STATUS_TAGS)
    contact, t = step(t, L.CONTACTS)
    return (phone, dates, insp, visit, tags, contact, t)


def test_document_cleaning_matches_python(spark):
    docs = pq.read_table(f"{SF_SMALL}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    want = {}
    for d in docs:
        r = clean(d["text"])
        if r[-1] != "":
            want[d["doc_id"]] = r[:-1] + (len(r[-1]),)
    got = {r.doc_id: (list(r.phone), list(r.update_date), list(r.inspector), list(r.update_type),
                      list(r.update_tags), list(r.contact), r.residual_chars)
           for r in E.queries()["document_note_cleaning"](spark, SF_SMALL).collect()}
    assert set(got) == set(want)
    bad = [k for k in want if got[k] != want[k]]
    assert not bad, (bad[:3], [(got[k], want[k]) for k in bad[:1]])
    assert sum(len(v[4]) for v in want.values()) > 0  # some status tags were found


def test_conversation_requests_match_python(spark):
    convs = pq.read_table(f"{SF_SMALL}/conversations.parquet").to_pylist()
    junk = py(alternation(L.NOT_RELEVANT))
    want = {}
    for r in convs:
        if r["role"] == "system":
            continue
        code = r["role"].lower()
        meaning = f"{r['role']} turn".lower()
        t = squish(r["text"].lower()) if r["text"] is not None else None
        if t is None or junk.search(t) or code in L.NOT_HOUSING or code == t:
            continue
        phone, t = step(t, L.PHONE)
        dates, t = step(t, L.DATE)
        t = squish(py(L.LEADING_JUNK).sub("", t))
        t = squish(py(L.PUNCT_DROP).sub("", py(L.PUNCT_TO_SPACE).sub(" ", t)))
        if py(alternation([p for p, _ in L.TYPOS])).search(t):
            for p, o in L.TYPOS:
                t = py(p).sub(o, t)
        insp, t = step(t, L.inspector_pairs())
        clean_meaning = squish(py(L.PUNCT_DROP).sub("", py(L.PUNCT_TO_SPACE).sub(" ", meaning)))
        if t == "" or t in {code, meaning, clean_meaning}:
            continue
        visit, t = step(t, L.VISIT_TYPES)
        tags, t = step(t, L.STATUS_TAGS)
        contact, t = step(t, L.CONTACTS)
        if t == "":
            continue
        want[f"{r['conv_id']}-{r['turn']}"] = (phone, dates, insp, visit, tags, contact, len(t))
    got = {r.INCIDENT_NUMBER: (list(r.phone), list(r.update_date), list(r.inspector), list(r.update_type),
                               list(r.update_tags), list(r.contact), r.residual_chars)
           for r in E.queries()["conversation_requests_cleaned"](spark, SF_SMALL).collect()}
    assert set(got) == set(want)
    bad = [k for k in want if got[k] != want[k]]
    assert not bad, (bad[:3], [(got[k], want[k]) for k in bad[:1]])
