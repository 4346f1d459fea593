"""Enumerations and schemas of the records that flow between operators."""

from __future__ import annotations

# --- fixed values: enumerations -------------------------------------------------
STATUSES = ("on_going", "deferred", "completed", "unknown")
SCOPES = ("in_scope", "out_of_scope", "unclassified")
EVENT_TYPES = ("open_house", "comment_deadline", "hearing")
EXTRACTED_TYPES = EVENT_TYPES + ("document",)

# --- fixed values: limits -------------------------------------------------------
DESCRIPTION_CHARS = 3000
MESSAGES_PER_PAYLOAD = 10

# --- schemas --------------------------------------------------------------------
LANDED = "source string, kind string, page_no int, url string, body string"
#: With the moment a page was fetched, which decides between versions of it.
LANDED_AT = LANDED + ", landed_at timestamp"
#: A record's place holds its page's number in so many bits.
PAGE_BITS = 24

LISTING_ROW = (
    "source string, page_no int, row_no int, title string, area string,"
    " raw_status string, status string, source_url string"
)

DOCUMENT_LINK = "struct<title:string,url:string,date:string>"

CHANGE = "struct<from:string,to:string>"

EXTRACTED_ITEM = (
    "struct<type:string,event_date:string,end_date:string,"
    "location:string,url:string,notes:string>"
)

MESSAGE_FIELDS = "array<struct<name:string,value:string,inline:boolean>>"

SNAPSHOT = (
    "key string, title string, owner string, areas array<string>, source_url string,"
    " status string, raw_status string, scope string, scope_reasoning string,"
    " content_hash string, last_seen_at timestamp, inserted_at timestamp,"
    " updated_at timestamp"
)

STORED_EVENTS = (
    "study_key string, type string, event_date string, event_ts timestamp,"
    " end_date string, end_ts timestamp, location string, url string, notes string,"
    " fingerprint string, inserted_at timestamp"
)

STORED_DOCUMENTS = (
    "study_key string, url string, title string, published_label string,"
    " fingerprint string, inserted_at timestamp"
)
