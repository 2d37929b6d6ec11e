"""Operational tables as append-only rows plus event logs; current state is a fold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketloom import constants as K
from ticketloom.functions import text as tx
from ticketloom.operators import index as ix
from ticketloom.operators.labelling import ordinal
from ticketloom.operators.routing import HIT_TYPE
from ticketloom.session import materialise


def row_id(*parts: Column) -> Column:
    """Deterministic id of a row, so that a repeated write is the same row."""
    joined = F.concat_ws("/", *[p.cast("string") for p in parts])
    return F.substring(F.md5(joined.cast("binary")), 1, 16)


def message_id(ticket_id: Column, created_at: Column) -> Column:
    """Id of one message of a ticket: a ticket that comes twice is two rows."""
    return row_id(ticket_id, F.date_format(created_at, "yyyyMMddHHmmssSSSSSS"))


def queue_rows(routed: DataFrame, created_at: Column, extra: tuple[str, ...] = ()) -> DataFrame:
    """Escalated tickets as pending human-queue rows; ``extra`` names further columns to hand through."""
    return routed.where(F.col("route") == "human").select(
        message_id(F.col("ticket_id"), created_at).alias("id"),
        F.col("ticket_id").cast("string").alias("ticket_id"),
        F.col("query").alias("customer_query"),
        F.coalesce("intent", F.lit(K.OTHER_INTENT)).alias("intent"),
        F.coalesce("urgency", F.lit("high")).alias("urgency"),
        F.coalesce("confidence", F.lit(0.5)).alias("confidence"),
        F.coalesce("sentiment", F.lit("neutral")).alias("sentiment"),
        F.coalesce("urgency_reason", F.lit("Escalated for human oversight")).alias("urgency_reason"),
        F.col("queue_reason").alias("escalation_reason"),
        F.to_json("retrieved_cases").alias("retrieved_cases_json"),
        F.lit("pending").alias("status"),
        F.lit(None).cast("string").alias("human_response"),
        created_at.alias("created_at"),
        F.when(F.lit(False), created_at).alias("resolved_at"),
        *extra,
    )


def review_rows(feedback: DataFrame, created_at: Column) -> DataFrame:
    """Rejected replies as developer reviews."""
    note = F.coalesce(F.nullif(F.col("feedback_notes"), F.lit("")), F.lit(K.DEFAULT_FEEDBACK_NOTE))
    return feedback.where(~F.col("feedback_is_okay")).select(
        row_id(F.col("ticket_id"), F.col("seq")).alias("id"),
        F.col("ticket_id").cast("string").alias("ticket_id"),
        "query", "intent", "urgency", "confidence",
        F.to_json("retrieved_cases").alias("retrieved_cases_json"),
        F.col("reply").alias("draft_reply"),
        note.alias("customer_feedback"),
        F.lit(None).cast("string").alias("developer_notes"),
        F.lit("pending_review").alias("status"),
        created_at.alias("created_at"),
    )


def log_rows(routed: DataFrame, created_at: Column) -> DataFrame:
    """Every answered ticket as a conversation-log row."""
    human = F.col("route") == "human"
    return routed.select(
        message_id(F.col("ticket_id"), created_at).alias("id"),
        F.col("ticket_id").cast("string").alias("ticket_id"),
        "query",
        F.coalesce("intent", F.lit(K.OTHER_INTENT)).alias("intent"),
        F.coalesce("urgency", F.when(human, "high").otherwise("low")).alias("urgency"),
        F.coalesce("confidence", F.when(human, 0.5).otherwise(0.9)).alias("confidence"),
        "route", "reply",
        ids_to_text(F.col("grounding_case_ids")).alias("grounding_case_ids"),
        F.lit("pending").alias("feedback"),
        created_at.alias("created_at"),
    )


def ids_to_text(ids: Column) -> Column:
    return F.array_join(ids, ",")


def text_to_ids(text: Column) -> Column:
    return F.when(F.length(text) > 0, F.split(text, ",")).otherwise(F.array().cast("array<string>"))


def decode_cases(json_text: Column) -> Column:
    """Stored cases as structs; an empty list when the text does not parse."""
    return F.coalesce(F.from_json(json_text, HIT_TYPE), F.array().cast(HIT_TYPE))


def urgency_rank(urgency: Column) -> Column:
    rank = F.when(urgency == "critical", K.URGENCY_RANK["critical"])
    for level in ("high", "medium", "low"):
        rank = rank.when(urgency == level, K.URGENCY_RANK[level])
    return rank.otherwise(K.URGENCY_RANK_ELSE)


def with_position(df: DataFrame, *order: Column) -> DataFrame:
    """``queue_position`` (from 1) in the given order, without sorting in one task."""
    return ordinal(materialise(df, "unnumbered"), *order).withColumn("queue_position", F.col("position") + 1).drop("position")


def pending(queue: DataFrame) -> DataFrame:
    """Open tickets, most urgent first, then oldest, with their queue_position."""
    ranked = queue.where(F.col("status") == "pending").withColumn(
        "urgency_rank", urgency_rank(F.col("urgency")).cast("bigint"))
    return with_position(ranked, F.col("urgency_rank"), F.col("created_at"), F.col("id")).orderBy("queue_position")


def latest_event(events: DataFrame, key: str, value: str) -> DataFrame:
    """Last event per key by (event_ts, seq). A running maximum, combined on the map side."""
    last = F.max(F.struct("event_ts", "seq", value)).alias("e")
    return events.groupBy(key).agg(last).select(
        key, F.col(f"e.{value}").alias(value), F.col("e.event_ts").alias("event_ts"), F.col("e.seq").alias("event_seq"))


def resolve(queue: DataFrame, events: DataFrame) -> DataFrame:
    """Queue after resolutions (id, human_response, event_ts, seq); the old status is not asked."""
    last = latest_event(events, "id", "human_response").withColumnRenamed("human_response", "__answer")
    done = F.col("event_ts").isNotNull()
    joined = queue.join(last, "id", "left")
    return joined.select(*[
        F.when(done, F.lit("resolved")).otherwise(F.col("status")).alias("status") if c == "status"
        else F.when(done, F.col("__answer")).otherwise(F.col(c)).alias(c) if c == "human_response"
        else F.coalesce("event_ts", c).alias(c) if c == "resolved_at"
        else F.col(c)
        for c in queue.columns
    ])


def unknown_ids(events: DataFrame, table: DataFrame, key: str = "id") -> DataFrame:
    return events.join(table.select(key), key, "left_anti").withColumn(
        "message", F.lit("Queue ticket not found"))


def newest_first(reviews: DataFrame) -> DataFrame:
    return reviews.orderBy(F.desc("created_at"), F.desc("id"))


def review_positions(reviews: DataFrame) -> DataFrame:
    """Reviews with their queue_position, newest first."""
    return with_position(reviews, F.desc("created_at"), F.desc("id"))


def apply_feedback(logs: DataFrame, events: DataFrame) -> DataFrame:
    """Conversation logs with the last feedback per row (id, feedback, event_ts, seq)."""
    last = latest_event(events, "id", "feedback").select("id", F.col("feedback").alias("__feedback"))
    joined = logs.join(last, "id", "left")
    return joined.withColumn("feedback", F.coalesce("__feedback", "feedback")).drop("__feedback")


def metrics(queue: DataFrame, reviews: DataFrame, index: DataFrame) -> DataFrame:
    """Queue depth, critical ones, reviews and index size in one row."""
    is_open = F.col("status") == "pending"
    one = queue.agg(
        F.count_if(is_open).alias("pending_human_tickets"),
        F.count_if(is_open & (F.col("urgency") == "critical")).alias("critical_human_tickets"),
    )
    return one.select(
        "*",
        reviews.agg(F.count(F.lit(1))).scalar().alias("developer_reviews_count"),
        index.agg(F.count(F.lit(1))).scalar().alias("vector_db_cases_count"),
    )


def recent_rejected(reviews: DataFrame, n: int = 10) -> DataFrame:
    return newest_first(reviews).limit(n).select(
        "id", "ticket_id", tx.truncate(F.col("query"), 120).alias("query"), "intent", "urgency",
        tx.truncate(F.coalesce("draft_reply", F.lit("")), 120).alias("draft_reply"),
        "customer_feedback", "created_at",
    )


def split_feedback(feedback: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(approved replies for the index, rejected ones for review)."""
    okay = F.col("feedback_is_okay")
    return feedback.where(okay), feedback.where(~okay)


def resolutions_to_cases(queue: DataFrame, events: DataFrame) -> DataFrame:
    """Resolved queue rows as human-resolved cases; redacted before they reach the index."""
    answered = latest_event(events, "id", "human_response")
    return answered_to_cases(queue.select("id", "ticket_id", "customer_query", "intent", "embedding").join(answered, "id"))


def answered_to_cases(answered: DataFrame) -> DataFrame:
    """Queue rows with their answer (human_response, event_ts, event_seq) as human-resolved cases."""
    return answered.select(
        "ticket_id",
        tx.redact(F.col("customer_query")).alias("ticket_text"),
        F.col("human_response").alias("resolution"),
        F.coalesce("intent", F.lit(K.OTHER_INTENT)).alias("intent"),
        F.lit(K.HUMAN).alias("source"),
        F.col("event_ts").alias("timestamp"),
        "event_seq",
        "embedding",
    )


def index_resolutions(index: DataFrame, queue: DataFrame, events: DataFrame) -> DataFrame:
    return ix.upsert(index, ix.to_index_rows(resolutions_to_cases(queue, events)))


def waiting_time(created_at: Column, as_of: Column) -> Column:
    """``MM:SS`` since creation, never negative; ``00:00`` when unknown."""
    micros = F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(created_at.cast("timestamp"))
    seconds = F.greatest(F.lit(0), F.floor(micros / 1_000_000))
    text = F.format_string("%02d:%02d", F.floor(seconds / 60), seconds % 60)
    return F.when(created_at.isNull(), F.lit("00:00")).otherwise(text)
