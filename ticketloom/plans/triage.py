"""The whole ticket flow as one lazy plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketloom.config import TriageConfig
from ticketloom.functions import text as tx
from ticketloom.operators import hygiene as hy
from ticketloom.operators import routing as rt
from ticketloom.operators import search as se

STATE_COLUMNS = (
    "ticket_id", "query", "intent", "confidence", "sentiment", "urgency", "urgency_reason",
    "is_high_risk", "escalate_to_human", "escalation_reason", "retrieved_cases", "top_similarity",
    "retrieval_decision", "route", "reply", "grounding_case_ids", "queue_reason", "status", "node_traces",
)


def triage(
    tickets: DataFrame, index: DataFrame, cfg: TriageConfig = TriageConfig(), *,
    clean: bool = False, search=se.search, carry: tuple[str, ...] = (),
) -> DataFrame:
    """Tickets (ticket_id, query, classification columns, embedding) -> routed tickets.

    Only a key, intent and vector of the tickets that pass the gate reach the search; texts
    stay behind and meet the hits again by that key. It is made of the ticket id and what the
    search reads, so several messages under one ticket id each keep their own hits and none
    is multiplied. What the gate holds back has no hits to meet and does not move. ``carry``
    names further columns to hand through.
    """
    if clean:
        tickets = tickets.withColumn("query", tx.clean_ticket_text(F.col("query"), F.lit("")))
    valid, _ = hy.split_blank(tickets, "query", "Query cannot be empty.")
    message = F.concat_ws("/", F.col("ticket_id").cast("string"), F.hex(F.xxhash64("intent", "embedding")))
    gated = rt.gate(valid, cfg).withColumn("__message", message)
    passed = F.coalesce(~F.col("escalate_to_human"), F.lit(False))
    to_search = gated.where(passed).select(
        F.col("__message").alias("query_id"), "intent", F.col("embedding").alias("vector")).dropDuplicates(["query_id"])
    hits = rt.collect_hits(search(to_search, index, cfg)).withColumnRenamed("query_id", "__message")
    held = gated.where(~passed).withColumn("retrieved_cases", F.lit(None).cast(hits.schema["retrieved_cases"].dataType))
    routed = rt.decide(gated.where(passed).join(hits, "__message", "left").unionByName(held), cfg)
    return routed.withColumn("node_traces", rt.node_traces()).select(*STATE_COLUMNS, *carry)
