"""Pattern tables of the inspection-note cleaning.

Patterns are written as R/ICU text; :func:`civicframe.functions.regex.java_regex`
turns POSIX classes into Java ones when they are used. Each table is a list
of (pattern, output) pairs so a pattern can never drift away from its
output (the source tables were two parallel vectors, and one of them is
out of step; the pairs below follow the comments that name each group).
"""

# ---------------------------------------------------------------------------
# Resolution codes that are not about housing.
NOT_HOUSING = [
    "cvoyc", "voyc", "cvoat", "cvoar", "voar", "shelby", "stcleaning", "transfer to health",
    "covid19-incompliance", "pending_sc_tax_sale", "swmad4", "back to mcsc",
]

# Notes that say nothing about the building (any match drops the note).
NOT_RELEVANT = [
    r"\b\d{7,9}\b",
    "see sr",
    "duplicate",
    "wrong ad(d)?ress",
    r"901(-|\)( )?)222-",
    "222[:punct:](23|90)00",
    "901-820-7878",
    "636[:punct:]6500",
    "545-2677",
    "416-5300",
    "^not a (city|residential)?( )?code (concern|violation|matter)$",
    "^sent to shelby county$",
    "^(insufficient|not enough) info(rmation)?$",
]

# Request types that may be about a building.
BUILDING_REQUEST_TYPES = "Miscellaneous|Derelict"

# Phone numbers (a following " days" means it is not one) and dates.
PHONE = r"\b(\d{3}[:punct:]( )?)?\d{3}[:punct:]\d{4}\b(?! days)"
DATE = (r"((on|\bf(.)?u\b) )?\b(\d{1,2}\W+\d{1,2}(\W+\d{1,4})?|\d{4}\W+\d{1,2}\W+\d{1,2})([:alpha:]+)?\b")
LEADING_JUNK = r"^\W+"

# Punctuation clean-up; these marks become a space, all other
# punctuation is dropped.
PUNCT_TO_SPACE = r"[:symbol:]|\;|\(|\)|\/|\-"
PUNCT_DROP = "[:punct:]"

# Typo fixes, applied in this order.
TYPOS = [
    (r"attemp\b", "attempt"),
    ("accrptable", "acceptable"),
    ("addrsss", "address"),
    (r"\baddres\b", "address"),
    ("(?<=this )compliant", "complaint"),
    ("in( )?compl[ia]+nce", "in compliance"),
    (r"\binsuf\b", "insufficient"),
    ("insuffient", "insufficient"),
    (r"\binsp\b", "inspection"),
    ("insp[ect]+[io]+n", "inspection"),
    ("informayion", "information"),
    ("jusitified", "justified"),
    ("montior", "monitor"),
    ("st[ru]+(c)?tural", "structural"),
    ("t[enat]{3,}t", "tenant"),
    ("tenante(d)?", "tenant"),
    ("rrplced", "replaced"),
    ("reslove", "resolve"),
    ("vo(i)?lation", "violation"),
    ("violstion", "violation"),
    (r"\bv[iola]+tion", "violation"),
    ("viola(t|y)?(i)+on", "violation"),
    ("vuolation", "violation"),
    (r"\bun( )?c[opr]+er[at]+[iv]+e\b", "uncooperative"),
    (r"\buncooper\b", "uncooperative"),
    (r"\buc\b", "uncooperative"),
    (r"\bwete\b", "were"),
]

# Inspector names in the source are real people; these are invented
# stand-ins with the same shapes (optional initial, optional space).
INSPECTOR_PREFIX = "(per )?(inspe[cs]tor )?\\b"
INSPECTORS = [
    ("(a)?( )?marlow", "A. Marlow"),
    ("b( )?okafor", "b. okafor"),
    ("(c)?( )?quimby", "C. Quimby"),
    ("d( )?vantreese", "d. vantreese"),
    ("(e)?( )?lindqvist", "E. Lindqvist"),
    ("f(rancine)?( )?oduya", "f. oduya"),
    ("(g)?( )?pettibone", "G. Pettibone"),
    ("h( )?yearwood", "h. yearwood"),
    ("(j)?( )?castellano", "J. Castellano"),
    ("k( )?abernathy", "k. abernathy"),
]

# What the visit was.
VISIT_TYPES = [
    ("(at )?((the|this) )?time of ((the|this|my) )?inspection", "inspection"),
    ("(during|at|upon|per) ((the|my) )?inspection", "inspection"),
    ("at (the )?time of re( )?(inspection|check)", "reinspection"),
    ("upon (follow( )?up|fu|further) inspection", "reinspection"),
    ("(after|made)?( )?(1(st)?|one|first) (unsuccessful )?(attempt|try|visit)(s)?( (have been|was|were))?( made)?"
     "( to (property|inspect|make contact|address))?( this complaint)?", "attempt 1"),
    ("(after|made)?( )?(2(nd)?|two|second) (unsuccessful )?(attempt|try|visit)(s)?( (have been|was|were))?( made)?"
     "( to (property|inspect|make contact|address))?( this complaint)?", "attempt 2"),
    ("(after|made)?( )?(3(rd)?|three|third) (unsuccessful )?(attempt|try|visit)(s)?( (have been|was|were))?( made)?"
     "( to (property|inspect|make contact|address))?( this complaint)?", "attempt 3"),
]

# Status tags, in order.
STATUS_TAGS = [
    ("not in city limits", "outside of jurisdiction"),
    ("customer lives in the county", "outside of jurisdiction"),
    ("violation is at another address", "wrong address"),
    ("wrong (property|parcel|location|house|address|building|apartment)( (address|unit|number))?( given)?",
     "wrong address"),
    ("address (doesnt exist|incorrect)", "wrong address"),
    ("unable to find correct address", "insufficient information"),
    ("insufficient (address|information)( (for complaint|to (locate|issue a) violation))?((was)? given)?",
     "insufficient information"),
    ("need(s)? more information", "insufficient information"),
    ("not enough information", "insufficient information"),
    ("(the )?property (was )?in( )?compliance( with the city)?( code)?", "in compliance"),
    ("in compliance", "in compliance"),
    ("((there|this) (was|were|is) )?no(t a)?( (residential|housing))?( code)?( )?violation(s)?( )?((was|w(h)?ere) )?"
     "(found(ed)?|present|observed|existed|seen|noticed)?( at this address)?", "no violation"),
    ("(the )?(violation was )?not justified", "no violation"),
    ("(the )?violation (did not|didnt) exist", "no violation"),
    (r"\bnj\b", "no violation"),
    ("(the )?property (was not|(does not|didnt) appear to be) (substandard )?(and )?derelict( structure)?",
     "no violation"),
    ("all is ok", "no violation"),
    ("there was no valid complaint", "no violation"),
    ("((all|the) )?(code )?(issue|violation|problem)(s)? (have|has|had|is|was)?( )?(been|w(h)?ere|was)?( )?"
     "(resolve(d)?|corrected|taken care of|no longer exists|in compliance|fixed|addressed|repaired)",
     "violation corrected"),
    ("these repairs were done", "violation corrected"),
    ("(the )?(yard|grass) ((is|was) )?(cut and )?clean(ed)?", "yard clean"),
    ("(the )?(yard|grass) (is|has been|was( being)?)?( )?cut", "yard clean"),
    ("((the|this) )?(property|house|structure|home) (is now|ha[ds] been|was)?( )?secure(d)?", "property secured"),
    ("((the|this) )?(property|house|structure) (is( now)?|ha[ds] been|was)?( )?board(ed)?( up)?( and secure(d)?)?",
     "property boarded"),
    ("(the )?property (was|has been)?( )?(repaired|rehabbed)", "property repaired"),
    ("((the|all) )?repair(s)? (was|w(h)?ere|(have|had) been)?( )?(made|completed)( to)?(( this)? (unit|structure|property))?",
     "property repaired"),
    ("((property|house) )?demolished( by the owner)?", "property demolished"),
    ("vacant (property|(town )?house|home|apt|apartment|unit)", "property vacant"),
    ("unit ((is|was) )?(now )?vacant", "property vacant"),
    ("((the|this) )?(property|house|structure) (is (now)?|ha[ds] been|was)?( )?vacant", "property vacant"),
    ("((the|this) )?(property|house|structure) (is (now)?|ha[ds] been|was)?( )?occupied", "property occupied"),
    ("(this )?(is )?(a )?vacant lot", "vacant lot"),
    ("(the )?(tenant|renter|resident)(s)? ((has|have|is|had) )?(mov(ed|ing)( out)?|vacated|no longer ((lives )?at|occup(ies|y)))"
     "(( from)? ((of )?the|to another|(of )?this) (unit|property|address))?", "tenant moved"),
    ("no( )?one (was )?home", "no one home"),
    (r"\bnoh\b", "no one home"),
    ("could not access the property", "no access to property"),
    ("no (one )?(response|answer(ed)?|came to this door)( the phone)?", "no response"),
    ("uncooperative", "uncooperative"),
    ("no further actions will be taken at this time", "no further action"),
    ("a violation order was issued to the owner", "issued notice"),
    ("(a )?(final )?notice to correct (was )?issued", "issued notice to correct"),
    ("issued notice to rehab property", "issued notice to rehab"),
    ("wrote up property (to be|for) rehabbed", "issued notice to rehab"),
    ("wrote property up (to be|for) rehabbed", "issued notice to rehab"),
    ("wrote up property (to be in|for) condemnation", "issued notice to condemn"),
    ("will (continue to )?monitor (the )?property", "will monitor"),
    ("will monitor for structural violations", "will monitor"),
    ("will (re)?( )?(create|issue) new sr", "will reissue"),
    ("will (be )?re( )?issue(d)?( )?(for )?(at a later date|proper service)?", "will reissue"),
    ("this sr is cancelled", "cancelled"),
    ("active npa case", "active npa case"),
    ("(with a )?court order", "court order"),
    ("unincorporated", "shelby county property"),
    ("property is (a )?sh[le]+by county (owned )?(property)?", "shelby county property"),
    ("sh[le]+by county (owned )?(property)?", "shelby county property"),
    ("justified active( open violation)?", "duplicate"),
    (r"\bja\b", "duplicate"),
    ("test sr.*", "test"),
    ("training( purposes)?", "test"),
    ("created by mistake", "error"),
    ("(created|written( up)?|placed) in error", "error"),
    ("wrong (ticket|type|request( type)?)( (of|for) code)?", "error"),
    ("when system comes back online", "error"),
]

# Who the inspector spoke with.
CONTACTS = [
    ("(the )?tenant(s)? (state[sd]|showed me|said|says|called( back)?|confirmed|advised)( that)?", "tenant"),
    ("(i )?(as stated by|advised|call(ed)?|talked|spoke|per( conversation)?)( (with|to))? (the )?tenant(s)?", "tenant"),
]


def inspector_pairs(table=INSPECTORS, prefix: str = INSPECTOR_PREFIX):
    """Inspector patterns with the shared prefix and a closing word boundary."""
    return [(prefix + p + r"\b", out) for p, out in table]
