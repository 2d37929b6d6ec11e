"""Escalation gate, similarity tiers, replies and traces: all plain columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketloom import constants as K
from ticketloom.config import TriageConfig
from ticketloom.functions import text as tx

HIT = ("case_id", "query", "resolution", "intent", "source", "product", "raw_similarity", "similarity_score")
HIT_TYPE = (
    "array<struct<case_id:string,query:string,resolution:string,intent:string,source:string,"
    "product:string,raw_similarity:double,similarity_score:double>>"
)


def fixed(value: Column, places: int) -> Column:
    """Small number with fixed places, rounded on its binary value (0.305 prints 0.30)."""
    return F.format_number(value, places)


def rule_high_risk() -> Column:
    return F.coalesce(F.col("is_high_risk"), F.lit(False))


def rule_urgent() -> Column:
    return F.lower(F.coalesce("urgency", F.lit("low"))).isin(*K.URGENT_LEVELS)


def rule_repeat(query: str = "query") -> Column:
    """Strong negative tone, or a repeat word anywhere in the text ("against" counts too)."""
    tone = F.lower(F.coalesce("sentiment", F.lit("neutral"))) == "strongly_negative"
    return tone | tx.contains_any(F.lower(F.col(query)), K.REPEAT_TERMS)


def rule_unsure(cfg: TriageConfig) -> Column:
    return F.coalesce("confidence", F.lit(1.0)) < cfg.confidence_escalation


def gate(df: DataFrame, cfg: TriageConfig = TriageConfig(), query: str = "query") -> DataFrame:
    """Adds the four rule columns, ``escalate_to_human`` and ``escalation_reason``."""
    df = df.withColumns({
        "rule_high_risk": rule_high_risk(),
        "rule_urgent": rule_urgent(),
        "rule_repeat": rule_repeat(query),
        "rule_unsure": rule_unsure(cfg),
    })
    urgent = F.concat(
        F.lit("Elevated urgency: "), F.lower("urgency"), F.lit(" ("),
        F.coalesce("urgency_reason", F.lit("None")), F.lit(")"))
    unsure = F.concat(
        F.lit("Low classifier confidence ("), fixed(F.col("confidence"), 2),
        F.lit(f" < {cfg.confidence_escalation})"))
    reasons = F.concat_ws(
        " | ",
        F.when(F.col("rule_high_risk"), F.lit(K.REASON_HIGH_RISK)),
        F.when(F.col("rule_urgent"), urgent),
        F.when(F.col("rule_repeat"), F.lit(K.REASON_REPEAT)),
        F.when(F.col("rule_unsure"), unsure),
    )
    escalate = F.col("rule_high_risk") | F.col("rule_urgent") | F.col("rule_repeat") | F.col("rule_unsure")
    return df.withColumns({
        "escalate_to_human": escalate,
        "escalation_reason": F.when(escalate, reasons),
    })


def branch_after_gate() -> Column:
    return F.when(F.col("escalate_to_human"), "escalate").otherwise("search")


def collect_hits(hits: DataFrame) -> DataFrame:
    """One row per query: its hits in rank order (top-k, so a short list)."""
    ranked = F.struct("hit_rank", *HIT)
    listed = hits.groupBy("query_id").agg(F.sort_array(F.collect_list(ranked)).alias("h"))
    plain = F.transform("h", lambda x: F.struct(*[x[f].alias(f) for f in HIT]))
    return listed.select("query_id", plain.alias("retrieved_cases"))


def no_hits() -> Column:
    return F.array().cast(HIT_TYPE)


def top_similarity() -> Column:
    return F.coalesce(F.get("retrieved_cases", F.lit(0))["similarity_score"], F.lit(0.0))


def tier(score: Column, cfg: TriageConfig = TriageConfig()) -> Column:
    return (
        F.when(score >= cfg.similarity_high, "FOUND")
        .when(score >= cfg.similarity_medium, "RELATED")
        .otherwise("NO_MATCH")
    )


def branch_after_tier(decision: Column) -> Column:
    return F.when(decision == "NO_MATCH", "escalate").otherwise("respond")


def customer_notice(reason: Column) -> Column:
    return F.concat(F.lit(K.NOTICE_HEAD), reason, F.lit(K.NOTICE_TAIL))


def grounding_ids() -> Column:
    return F.transform("retrieved_cases", lambda c: c["case_id"])


def context_block() -> Column:
    """The retrieved cases as text, one paragraph per case."""
    def paragraph(c: Column) -> Column:
        return F.concat(
            F.lit("\n[Case #"), c["case_id"], F.lit("] (Similarity: "),
            fixed(c["similarity_score"], 2), F.lit(", Source: "), c["source"],
            F.lit(")\nQuery: "), c["query"], F.lit("\nHuman Resolution: "), c["resolution"], F.lit("\n"))

    return F.array_join(F.transform("retrieved_cases", paragraph), "")


def template_reply() -> Column:
    """FOUND: the best case's resolution. RELATED: the resolutions known from past cases."""
    best = F.get("retrieved_cases", F.lit(0))["resolution"]
    known = F.array_join(F.transform("retrieved_cases", lambda c: c["resolution"]), "; ")
    return F.when(F.col("retrieval_decision") == "FOUND", F.concat(F.lit("Based on a resolved case: "), best)).otherwise(
        F.concat(F.lit("Known steps from related cases: "), known))


def decide(df: DataFrame, cfg: TriageConfig = TriageConfig()) -> DataFrame:
    """From gate columns and hits to route, reply, status. Rows are not split.

    A ticket escalated for want of a match keeps ``escalate_to_human = false`` while its
    route is ``human``: the flag tells what the gate said.
    """
    searched = ~F.col("escalate_to_human")
    df = df.withColumn("retrieved_cases", F.coalesce("retrieved_cases", no_hits()))
    df = df.withColumn("top_similarity", top_similarity())
    df = df.withColumn(
        "retrieval_decision",
        F.when(searched, tier(F.col("top_similarity"), cfg)).otherwise(F.lit("")))
    human = ~searched | (branch_after_tier(F.col("retrieval_decision")) == "escalate")
    df = df.withColumn("route", F.when(human, "human").otherwise("agent"))
    reason = F.coalesce("escalation_reason", F.lit(K.REASON_NO_MATCH))
    return df.withColumns({
        "queue_reason": F.when(human, reason),
        "reply": F.when(human, customer_notice(reason)).otherwise(template_reply()),
        "grounding_case_ids": F.when(human, F.array().cast("array<string>")).otherwise(grounding_ids()),
        "status": F.when(human, "pending_human_response").otherwise("resolved_by_agent"),
    })


def _trace(node: str, summary: Column, decision: Column | str) -> Column:
    said = F.lit(decision) if isinstance(decision, str) else decision
    return F.struct(F.lit(node).alias("node"), summary.alias("output_summary"), said.alias("decision"))


def node_traces() -> Column:
    """Steps a ticket went through, in order, without timings."""
    escalated, human = F.col("escalate_to_human"), F.col("route") == "human"
    score = fixed(F.col("top_similarity"), 4)
    next_step = (
        F.when(F.col("retrieval_decision") == "FOUND", "branch: generate_reply (FOUND tier)")
        .when(F.col("retrieval_decision") == "RELATED", "branch: generate_reply (RELATED tier)")
        .otherwise("branch: escalate_to_human (Score below 0.55)")
    )
    steps = F.array(
        _trace("intent_classification",
               F.concat(F.lit("Intent: "), "intent", F.lit(" (Confidence: "),
                        fixed(F.col("confidence") * 100, 1), F.lit("%, Urgency: "), "urgency", F.lit(")")),
               F.concat(F.lit("intent="), "intent", F.lit(", urgency="), "urgency")),
        F.when(escalated, _trace("human_in_loop_check",
                                 F.concat(F.lit("Escalation triggered: "), "escalation_reason"),
                                 "branch: escalate_to_human"))
        .otherwise(_trace("human_in_loop_check",
                          F.lit("Passed all triage safety checks (autonomous resolution eligible)"),
                          "branch: search_in_db")),
        F.when(~escalated, _trace("search_in_db",
                                  F.concat(F.lit("Retrieved "), F.size("retrieved_cases").cast("string"),
                                           F.lit(" cases (Top similarity: "), score, F.lit(" with +0.05 boost)")),
                                  F.concat(F.lit("top_similarity="), score))),
        F.when(~escalated, _trace("decide_similarity",
                                  F.concat(F.lit("Threshold evaluation: score "), score, F.lit(" maps to '"),
                                           "retrieval_decision", F.lit("'")),
                                  next_step)),
        F.when(human, _trace("escalate_to_human",
                             F.concat(F.lit("Enqueued in Human Queue (Urgency: "), "urgency", F.lit(")")),
                             "action: human_agent_pending"))
        .otherwise(_trace("generate_reply",
                          F.concat(F.lit("Generated grounded response using "),
                                   F.size("grounding_case_ids").cast("string"), F.lit(" scenarios ("),
                                   "retrieval_decision", F.lit(" mode)")),
                          "action: reply_dispatched")),
    )
    return F.filter(steps, lambda s: s.isNotNull())


def term_overlap(query: Column, case_query: Column, resolution: Column) -> Column:
    """Significant words that a query shares with a case."""
    case = F.concat(case_query, F.lit(" "), resolution)
    return F.array_intersect(tx.significant_words(query), tx.significant_words(case))
