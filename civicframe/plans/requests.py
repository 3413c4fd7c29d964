"""Querying 311 service requests (``get_311``): any column equal to a
value, text case-insensitive, date columns compared on the day, no
arguments returning every request; columns in the API's order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicframe.operators import columns as C

# The request table's columns, in the API's order.
REQUEST_COLUMNS = [
    "division", "department", "group_name", "category", "ce_category", "request_type", "incident_type_id",
    "incident_number", "incident_id", "resolution_code", "resolution_summary", "summary_1", "request_status",
    "request_priority", "creation_date", "reported_date", "last_update_date", "followup_date",
    "sr_creation_channel", "created_by_user", "last_updated_by", "parcel_id", "full_address", "location_1",
    "address1", "city", "state", "postal_code", "target_block", "location1",
]
DATE_COLUMNS = ("creation_date", "reported_date", "last_update_date", "followup_date")


def get_requests(requests: DataFrame, lowered: bool = False, **equals) -> DataFrame:
    """Filter the landed request table; unknown column names are an error.
    Dates are ``2024-03-09T07:27:09.000`` text (or timestamps). ``lowered``:
    the text columns are stored in lower case, so plain equality reaches the scan."""
    unknown = [k for k in equals if k not in requests.columns]
    if unknown:
        raise ValueError(f"not request columns: {unknown}")
    out = C.request_query(requests, date_cols=DATE_COLUMNS, lowered=lowered, **equals)
    ordered = [c for c in REQUEST_COLUMNS if c in out.columns]
    return out.select(*ordered, *[c for c in out.columns if c not in ordered])


def parse_request_dates(requests: DataFrame) -> DataFrame:
    """The API's ISO date text to timestamps."""
    return requests.withColumns({c: F.try_to_timestamp(F.col(c), F.lit("yyyy-MM-dd'T'HH:mm:ss.SSS"))
                                 for c in DATE_COLUMNS if c in requests.columns})
