"""Which messages a difference gives rise to, in which order and payload."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changewatch.functions import text as T
from changewatch.model import MESSAGE_FIELDS, MESSAGES_PER_PAYLOAD
from changewatch.operators.ordered import EVERY, ranked

# --- fixed values: message kinds in display order, their titles and field names -----
KINDS = ("new", "status", "scope", "event", "documents")
TITLES = {
    "new": "NEW: ",
    "status": "UPDATED: ",
    "scope": "UPDATED: ",
    "event": "NEW: Public Engagement Announced for ",
    "documents": "NEW: Documents Published for ",
}
STUDY, AREAS, SUMMARY, STATUS = "Study", "Municipalities", "Summary", "Status"
TYPE, DATE, LOCATION, NOTES, DOCUMENTS = "Type", "Date", "Location", "Notes", "Documents"

STEP = ["study_key", "seq"]
# lines that are joined in one step; the joined parts then make one list, of any length
LINES = 1000


def _is(change: Column, to: str) -> Column:
    return F.coalesce(change["to"] == to, F.lit(False))


def relevant() -> Column:
    """In scope now, or just changed to in scope."""
    return (F.col("scope") == "in_scope") | _is(F.col("scope_changed"), "in_scope")


def newly_completed() -> Column:
    return ~F.col("is_new") & _is(F.col("status_changed"), "completed")


def suppressed() -> Column:
    """The five rules under which a difference gives no message at all."""
    status, new = F.col("status"), F.col("is_new")
    return (
        (~relevant() & ~new)
        | (new & (status == "completed"))
        | (new & (status == "deferred"))
        | (~newly_completed() & (status == "completed"))
        | (~new & ~_is(F.col("status_changed"), "deferred") & (status == "deferred"))
    )


def noteworthy(diffs: DataFrame) -> DataFrame:
    return diffs.withColumns(
        {"relevant": relevant(), "newly_completed": newly_completed()}
    ).filter(~suppressed())


def _field(name: str, value: Column, inline: bool = False) -> Column:
    return F.struct(F.lit(name).alias("name"), value.alias("value"), F.lit(inline).alias("inline"))


def _fields(*fields: Column) -> Column:
    """Fields in order; a NULL one is left out."""
    return F.filter(F.array(*fields), lambda f: f.isNotNull()).cast(MESSAGE_FIELDS)


def _message(kind: str, title: Column, url: Column, fields: Column, item: Column | None = None) -> Column:
    return F.struct(
        F.lit(kind).alias("kind"),
        # display place: kind first, then the item's own order
        (F.shiftleft(F.lit(KINDS.index(kind)).cast("bigint"), 58) + (F.lit(0) if item is None else item)).alias("place"),
        title.alias("title"),
        url.alias("url"),
        fields.alias("fields"),
    )


def _about() -> list[Column]:
    return [_field(STUDY, F.col("title")), _field(AREAS, T.join_areas("municipalities"))]


def change_messages(noted: DataFrame) -> DataFrame:
    """New-study, status-change and scope-change messages of each difference."""
    summary = _field(SUMMARY, F.col("scope_reasoning"))
    status = F.concat(
        T.format_status(F.col("status_changed.from")), F.lit(" → "), T.format_status(F.col("status_changed.to"))
    )
    url = F.col("source_url")
    candidates = F.array(
        F.when(
            F.col("is_new") & (F.col("scope") == "in_scope"),
            _message("new", F.concat(F.lit(TITLES["new"]), "title"), url, _fields(*_about(), summary)),
        ),
        F.when(
            ~F.col("is_new") & F.col("status_changed").isNotNull() & F.col("relevant"),
            _message("status", F.concat(F.lit(TITLES["status"]), "title"), url, _fields(*_about(), _field(STATUS, status, True))),
        ),
        F.when(
            _is(F.col("scope_changed"), "in_scope"),
            _message("scope", F.concat(F.lit(TITLES["scope"]), "title"), url, _fields(*_about(), summary)),
        ),
    )
    return noted.select(
        *STEP, F.explode(F.filter(candidates, lambda m: m.isNotNull())).alias("m")
    ).select(*STEP, "m.*")


def event_messages(noted: DataFrame, events: DataFrame, as_of: Column) -> DataFrame:
    """One message per new event that still lies ahead."""
    studies = noted.filter("relevant").select(
        *STEP, F.col("title").alias("study"), "source_url", "status"
    )
    ahead = events.join(studies, STEP).filter(
        T.is_upcoming(F.col("event_date"), F.col("end_date"), F.col("status"), as_of)
    )

    def given(name: str, column: str, inline: bool) -> Column:
        return F.when(T.blank_to_null(column).isNotNull(), _field(name, F.col(column), inline))

    message = _message(
        "event",
        F.concat(F.lit(TITLES["event"]), "study"),
        F.coalesce("url", "source_url"),
        _fields(
            _field(STUDY, F.col("study")),
            _field(TYPE, T.format_event_type("type"), True),
            _field(DATE, T.format_date_range("event_date", "end_date"), True),
            given(LOCATION, "location", True),
            given(NOTES, "notes", False),
        ),
        F.col("ord").cast("bigint"),
    )
    return ahead.select(*STEP, message.alias("m")).select(*STEP, "m.*")


def listed_documents(
    documents: DataFrame, keys: list[str], per_part: int = LINES, every: int = EVERY
) -> DataFrame:
    """Document labels joined by line in order of ``ord``: one list per key, whatever its length.

    Lines are joined in parts of ``per_part``, then the parts, so that no task sorts all lines of a key.
    """
    labelled = documents.select(
        *keys, "ord", T.document_label(F.col("title"), F.col("url"), F.col("published_label")).alias("label")
    )
    placed = ranked(labelled, keys, "ord", "_no", every)
    return (
        placed.withColumn("part", F.floor((F.col("_no") - 1) / per_part).cast("bigint"))
        .groupBy(*keys, "part")
        .agg(F.array_sort(F.collect_list(F.struct("_no", "label"))).alias("_l"))
        .select(*keys, "part", F.array_join(F.transform("_l", lambda x: x["label"]), "\n").alias("_text"))
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct("part", "_text"))).alias("_p"))
        .select(*keys, F.array_join(F.transform("_p", lambda x: x["_text"]), "\n").alias("documents"))
    )


def document_messages(
    noted: DataFrame, documents: DataFrame, per_part: int = LINES, every: int = EVERY
) -> DataFrame:
    """The list of a study's new documents: one message."""
    studies = noted.filter(
        F.col("relevant") & ((F.col("status") != "completed") | F.col("newly_completed"))
    ).select(*STEP, F.col("title").alias("study"), "source_url")
    listed = listed_documents(documents, STEP, per_part, every).join(studies, STEP)
    message = _message(
        "documents",
        F.concat(F.lit(TITLES["documents"]), "study"),
        F.col("source_url"),
        _fields(_field(STUDY, F.col("study")), _field(DOCUMENTS, F.col("documents"))),
    )
    return listed.select(*STEP, message.alias("m")).select(*STEP, "m.*")


def messages(
    diffs: DataFrame,
    events: DataFrame,
    documents: DataFrame,
    as_of: Column,
    per_part: int = LINES,
    every: int = EVERY,
) -> DataFrame:
    """All messages; ``place`` orders those of one step.

    ``diffs``: study_key, seq, municipalities, title, source_url, status, scope,
    scope_reasoning, is_new, status_changed, scope_changed. ``events`` and
    ``documents``: the new ones, by study_key, seq and ord.
    """
    noted = noteworthy(diffs)
    return (
        change_messages(noted)
        .unionByName(event_messages(noted, events, as_of))
        .unionByName(document_messages(noted, documents, per_part, every))
    )


def mentions(all_messages: DataFrame) -> DataFrame:
    """Per step: whether the role is to be mentioned (new study or coming event)."""
    return all_messages.groupBy(*STEP).agg(
        F.bool_or(F.col("kind").isin("new", "event")).alias("mention")
    )


def payloads(
    all_messages: DataFrame, size: int = MESSAGES_PER_PAYLOAD, every: int = EVERY
) -> DataFrame:
    """Messages in order, at most ``size`` to a payload; the first may mention the role.

    A payload is a group of at most ``size`` rows, however many messages a study has.
    """
    placed = ranked(all_messages, STEP, "place", "message_no", every)
    message = F.struct("message_no", "kind", "title", "url", "fields")
    packed = (
        placed.withColumn("chunk_no", F.floor((F.col("message_no") - 1) / size).cast("bigint"))
        .groupBy(*STEP, "chunk_no")
        .agg(F.array_sort(F.collect_list(message)).alias("messages"))
    )
    return (
        packed.join(mentions(all_messages), STEP)
        .withColumn("mention", F.col("mention") & (F.col("chunk_no") == 0))
        .select(*STEP, "chunk_no", "mention", "messages")
    )
