"""Registered queries: the flows as streams, run to the end of what is there."""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from ticketloom import constants as K
from ticketloom.catalog import sql as S
from ticketloom.catalog.labelling import rule_sql
from ticketloom.catalog.registry import Family
from ticketloom.catalog.retrieval import index
from ticketloom.catalog.routing import feedback, queue, queue_events, reviews, triage_input
from ticketloom.config import TriageConfig
from ticketloom.session import materialise, remove, scratch_dir, scratch_scope, store
from ticketloom.sources import fixtures as fx
from ticketloom.sources import tables as tb
from ticketloom.sources.logs import IndexLog, read_batches
from ticketloom.streaming import flows

FAMILY = Family()
register = FAMILY.register
CFG = TriageConfig()


def as_stream(spark, df, name, batches):
    """A stream that delivers ``df`` in that many batches, in as many files as Spark has partitions for it."""
    path = scratch_dir(spark, name)
    tb.write_table(df, path)
    files = len(tb.read_table(spark, path).inputFiles())
    return flows.read_stream(spark, path, df.schema, max(1, -(-files // batches)))


def in_parts(spark, build, name, order, parts=3):
    """Streams that deliver ``build``, a table or what makes one, in that many batches, in the given (numeric) order, nulls first.

    Each part lies in a folder of its own, in as many files as Spark has partitions for it; a stream reads
    the first folders, and run to its end with the checkpoint of the one before, it is one batch. What the
    rows were made of is gone when they are stored, and so are they when the parts are.
    """
    path, whole = scratch_dir(spark, name), scratch_dir(spark, f"{name}-all")
    with scratch_scope(spark, f"{name}-build"):
        df = build() if callable(build) else build
        schema, stored = df.schema, store(df.withColumn("__order", order.cast("double")), whole)
    cuts = stored.approxQuantile("__order", [i / parts for i in range(1, parts)], 0.001)
    # The first part has no lower bound and the last no upper one, so every row is in one.
    after = F.array_size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: F.col("__order") > c)) if cuts else F.lit(0)
    for n in range(len(cuts) + 1):
        store(stored.where(after == n).drop("__order"), f"{path}/{n}")
    remove(spark, whole)
    for n in range(len(cuts) + 1):
        yield flows.read_stream(spark, f"{path}/{{{','.join(map(str, range(n + 1)))}}}", schema)


S.CTES["streamed"] = f"""
SELECT *, is_high_risk OR urgency IN ('high', 'critical') OR sentiment = 'strongly_negative' OR confidence < 0.6 AS escalate_to_human
FROM (SELECT ticket_id, {rule_sql('ticket_text')} FROM tickets_all WHERE length(ticket_text) > 0)"""


@register("w1_stream_gate", S.with_ctes(
    "SELECT ticket_id, intent, confidence, sentiment, urgency, is_high_risk, escalate_to_human FROM streamed"))
def w1_stream_gate(spark, d):
    stream = as_stream(spark, fx.tickets_raw(spark, d), "raw-stream", 2)
    out = flows.gate_stream(stream, CFG).select(
        "ticket_id", "intent", "confidence", "sentiment", "urgency", "is_high_risk", "escalate_to_human")
    path = scratch_dir(spark, "gated")
    flows.append_to(out, path, scratch_dir(spark, "gated-state")).awaitTermination()
    return tb.read_table(spark, path)


@register("w2_stream_triage", S.with_ctes("""
SELECT ticket_id, 'queue' AS sink, urgency, escalation_reason AS detail FROM queue
UNION ALL SELECT ticket_id, 'log', urgency, reply FROM logs"""))
def w2_stream_triage(spark, d):
    stream = as_stream(spark, triage_input(spark, d), "ticket-stream", 2)
    log = IndexLog(materialise(index(spark, d), "index"), scratch_dir(spark, "index-log"))
    queue_path, log_path = scratch_dir(spark, "queue"), scratch_dir(spark, "logs")
    flows.triage_to_tables(stream, log, queue_path, log_path, scratch_dir(spark, "triage-state"), CFG).awaitTermination()
    q = read_batches(spark, queue_path).select(
        "ticket_id", F.lit("queue").alias("sink"), "urgency", F.col("escalation_reason").alias("detail"))
    return q.unionByName(read_batches(spark, log_path).select(
        "ticket_id", F.lit("log").alias("sink"), "urgency", F.col("reply").alias("detail")))


@register("w3_stream_resolutions", S.with_ctes(f"""
SELECT case_key, case_id, intent, source, resolution FROM precedents
UNION ALL SELECT ticket_id || '_' || substr(md5(document), 1, 8), ticket_id, intent, '{K.HUMAN}', resolution FROM answered"""))
def w3_stream_resolutions(spark, d):
    """Answers come in three batches, the latest first, and every one is delivered twice."""
    q = materialise(queue(spark, d, extra=("embedding",)).select(
        "id", "ticket_id", "customer_query", "intent", "embedding"), "queue")
    events = queue_events(spark, d).withColumn("event_ts", F.col("event_ts").cast("timestamp"))
    streams = in_parts(spark, lambda: events.unionByName(events), "answers", -F.unix_micros("event_ts"))
    base = index(spark, d).withColumns({
        "embedding": F.col("embedding").cast("array<double>"), "timestamp": F.col("timestamp").cast("timestamp")})
    log = IndexLog(base, scratch_dir(spark, "index-log"))
    state = scratch_dir(spark, "answers-state")
    for stream in streams:
        flows.resolutions_to_index(stream, lambda: q, log, state).awaitTermination()
    return log.current().select("case_key", "case_id", "intent", "source", "resolution")


@register("w3_waiting_answers", S.with_ctes(f"""
SELECT ticket_id || '_' || substr(md5(document), 1, 8) AS case_key, ticket_id AS case_id, intent, '{K.HUMAN}' AS source, resolution
FROM answered"""))
def w3_waiting_answers(spark, d):
    """Queue rows in three batches, the earliest first, and answers, the latest first and each delivered
    twice: most wait in the state for the other. The cases that the empty index gets."""
    def rows():
        return queue(spark, d, extra=("embedding",)).select(
            "id", "ticket_id", "customer_query", "intent", "created_at", "embedding")

    events = queue_events(spark, d).withColumn("event_ts", F.col("event_ts").cast("timestamp"))
    queued = in_parts(spark, rows, "queued", F.unix_micros(F.col("created_at").cast("timestamp")))
    answers = in_parts(spark, lambda: events.unionByName(events), "queue-answers", -F.unix_micros("event_ts"))
    base = index(spark, d).withColumns({
        "embedding": F.col("embedding").cast("array<double>"), "timestamp": F.col("timestamp").cast("timestamp")})
    log, state = IndexLog(base.limit(0), scratch_dir(spark, "index-log")), scratch_dir(spark, "meeting-state")
    left = right = None
    for a, b in itertools.zip_longest(queued, answers):
        # A side without further parts goes on with what it has.
        left, right = left if a is None else a, right if b is None else b
        flows.answers_to_index(left, right, log, state).awaitTermination()
    return log.current().select("case_key", "case_id", "intent", "source", "resolution")


@register("w3_stream_feedback", S.with_ctes("SELECT id, sink FROM feedback_sinks"))
def w3_stream_feedback(spark, d):
    """Feedback in three batches, each delivered twice: cases that join the index, and reviews."""
    given = feedback(spark, d).withColumn("event_ts", F.timestamp_seconds(F.col("seq")))
    streams = in_parts(spark, lambda: given.unionByName(given), "feedback", F.col("seq"))
    base = index(spark, d).withColumns({
        "embedding": F.col("embedding").cast("array<double>"), "timestamp": F.col("timestamp").cast("timestamp")})
    log = IndexLog(materialise(base, "index"), scratch_dir(spark, "index-log"))
    path, state = scratch_dir(spark, "reviews"), scratch_dir(spark, "feedback-state")
    for stream in streams:
        flows.feedback_to_tables(stream, log, path, state, CFG).awaitTermination()
    added = log.current().where(F.col("case_key").startswith("agent_approved_"))
    return added.select(F.col("case_key").alias("id"), F.lit("index").alias("sink")).unionByName(
        read_batches(spark, path).select("id", F.lit("review").alias("sink")))


@register("w4_review_counts", S.with_ctes("""
SELECT time_bucket(INTERVAL 10 MINUTES, created_at) AS window_start,
       time_bucket(INTERVAL 10 MINUTES, created_at) + INTERVAL 10 MINUTES AS window_end, status, count(*) AS row_count
FROM reviews GROUP BY ALL"""))
def w4_review_counts(spark, d):
    """Reviews come in three batches, the latest first."""
    rows = reviews(spark, d).select(F.col("created_at").cast("timestamp").alias("created_at"), "status")
    path, state = scratch_dir(spark, "review-counts"), scratch_dir(spark, "review-counts-state")
    for stream in in_parts(spark, lambda: rows, "reviews", -F.unix_micros("created_at")):
        flows.depth_to_table(flows.review_counts(stream), path, state).awaitTermination()
    out = flows.read_depth(spark, path, by="status")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")})


def _depth(spark, d, slide, name):
    """Arrivals of all raw tickets by urgency, in three batches, the latest first."""
    t = fx.tickets_raw(spark, d).select(
        F.col("created_at").cast("timestamp").alias("created_at"), F.lower("ticket_priority").alias("urgency"))
    path, state = scratch_dir(spark, name), scratch_dir(spark, f"{name}-state")
    for stream in in_parts(spark, lambda: t, f"{name}-in", -F.unix_micros("created_at")):
        flows.depth_to_table(flows.queue_depth(stream, "10 minutes", slide), path, state).awaitTermination()
    out = flows.read_depth(spark, path)
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")})


def _depth_sql(starts: str) -> str:
    return S.with_ctes(f"""
SELECT window_start, window_start + INTERVAL 10 MINUTES AS window_end, urgency, count(*) AS row_count
FROM (SELECT lower(ticket_priority) AS urgency, unnest({starts}) AS window_start FROM tickets_raw)
GROUP BY ALL""")


@register("w4_queue_depth", _depth_sql("[time_bucket(INTERVAL 10 MINUTES, created_at)]"))
def w4_queue_depth(spark, d):
    return _depth(spark, d, None, "depth")


@register("w4_queue_depth_sliding", _depth_sql(
    "[time_bucket(INTERVAL 5 MINUTES, created_at), time_bucket(INTERVAL 5 MINUTES, created_at) - INTERVAL 5 MINUTES]"))
def w4_queue_depth_sliding(spark, d):
    return _depth(spark, d, "5 minutes", "depth-sliding")


@register("w4_pending_depth", S.with_ctes("""
SELECT urgency, count(*) AS pending FROM queue WHERE id NOT IN (SELECT id FROM queue_events) GROUP BY urgency"""))
def w4_pending_depth(spark, d):
    """Open tickets: queue rows and answers in three batches mixed by digest, answers delivered twice."""
    q = queue(spark, d).select("id", "urgency")
    answers = queue_events(spark, d).select("id")
    events = flows.ticket_events(q, answers.unionByName(answers))
    path, state = scratch_dir(spark, "pending"), scratch_dir(spark, "pending-state")
    for stream in in_parts(spark, lambda: events, "ticket-events", F.xxhash64("kind", "id") % 1000):
        flows.pending_to_table(stream, path, state).awaitTermination()
    return flows.read_pending(spark, path)
