"""Registered queries: gate, tiers, whole triage flow, queue state and feedback."""

from __future__ import annotations

from pyspark.sql import functions as F

from ticketloom import constants as K
from ticketloom.catalog import sql as S
from ticketloom.catalog.hygiene import clean_tickets
from ticketloom.catalog.registry import Family
from ticketloom.catalog.retrieval import hits_ctes, index, stored_index
from ticketloom.config import TriageConfig
from ticketloom.operators import hygiene as hy
from ticketloom.operators import index as ix
from ticketloom.operators import queue as qu
from ticketloom.operators import routing as rt
from ticketloom.plans.triage import triage
from ticketloom.session import materialise, scratch_dir
from ticketloom.sources import fixtures as fx
from ticketloom.sources import tables as tb

FAMILY = Family()
register = FAMILY.register
CFG = TriageConfig()


def triage_input(spark, d, fields=()):
    """Clean unique tickets with their classification, vector, time and further fields, as a stored table.

    Classification and vector join the raw text, which lies by ticket id then; the first of equal
    texts is taken from all tickets before those without either go.
    """
    raw = fx.tickets_raw(spark, d)
    c = fx.classifications(spark, d).withColumn("classified", F.lit(True))
    v = fx.ticket_vectors(spark, d).select("ticket_id", "embedding", F.lit(True).alias("has_vector"))
    more = ("created_at", *c.columns[1:], "embedding", "has_vector")
    t = hy.clean_tickets(raw.join(c, "ticket_id", "left").join(v, "ticket_id", "left"), extra=more)
    joined = t.where("classified AND has_vector").withColumnRenamed("ticket_text", "query").select("ticket_id", "query", *fields, *more)
    return materialise(joined.drop("classified", "has_vector"), "tickets")


def routed(spark, d, carry=(), tickets=None):
    """All tickets routed; ``tickets`` is what ``triage_input`` stored, for queries that route them twice."""
    return triage(triage_input(spark, d) if tickets is None else tickets, stored_index(spark, d), CFG, carry=carry)


_urgent = "lower(urgency) IN ('high', 'critical')"
_repeat = f"(lower(sentiment) = 'strongly_negative' OR {S.any_of('lower(\"query\")', K.REPEAT_TERMS)})"
S.CTES["triage_in"] = """
SELECT t.ticket_id, t.ticket_text AS "query", t.created_at, c.* EXCLUDE (ticket_id), v.embedding
FROM tickets t JOIN classifications c USING (ticket_id) JOIN vectors v USING (ticket_id)"""
S.CTES["gated"] = f"""
SELECT *, is_high_risk OR {_urgent} OR {_repeat} OR confidence < 0.6 AS escalate_to_human,
       nullif(concat_ws(' | ',
         CASE WHEN is_high_risk THEN '{K.REASON_HIGH_RISK}' END,
         CASE WHEN {_urgent} THEN 'Elevated urgency: ' || lower(urgency) || ' (' || urgency_reason || ')' END,
         CASE WHEN {_repeat} THEN '{K.REASON_REPEAT}' END,
         CASE WHEN confidence < 0.6 THEN 'Low classifier confidence (' || printf('%.2f', confidence) || ' < 0.6)' END), '') AS escalation_reason,
       is_high_risk AS rule_high_risk, {_urgent} AS rule_urgent, {_repeat} AS rule_repeat, confidence < 0.6 AS rule_unsure
FROM triage_in"""
S.CTES["to_search"] = "SELECT ticket_id, intent, embedding FROM gated WHERE NOT escalate_to_human"
for _name, _body in hits_ctes("to_search").items():
    S.CTES["triage_" + _name] = (
        _body.replace("FROM pairs", "FROM triage_pairs").replace("FROM best", "FROM triage_best"))
S.CTES["listed"] = """
SELECT ticket_id, max(similarity_score) FILTER (hit_rank = 1) AS top, count(*) AS n_hits,
       max(resolution) FILTER (hit_rank = 1) AS best_resolution,
       string_agg(case_id, ',' ORDER BY hit_rank) AS ids,
       string_agg(resolution, '; ' ORDER BY hit_rank) AS resolutions,
       string_agg(chr(10) || '[Case #' || case_id || '] (Similarity: ' || printf('%.2f', similarity_score) || ', Source: ' || source
                  || ')' || chr(10) || 'Query: ' || document || chr(10) || 'Human Resolution: ' || resolution || chr(10), '' ORDER BY hit_rank) AS context,
       list({'case_id': case_id, 'query': document, 'resolution': resolution, 'intent': intent, 'source': source,
             'product': product, 'raw_similarity': raw_similarity, 'similarity_score': similarity_score} ORDER BY hit_rank) AS cases_list
FROM triage_hits GROUP BY ticket_id"""
S.CTES["tiered"] = """
SELECT g.*, coalesce(l.top, 0.0) AS top_similarity, coalesce(l.n_hits, 0) AS n_hits, l.best_resolution, l.ids, l.resolutions,
       l.context, l.cases_list,
       CASE WHEN escalate_to_human THEN '' WHEN coalesce(l.top, 0) >= 0.80 THEN 'FOUND'
            WHEN coalesce(l.top, 0) >= 0.55 THEN 'RELATED' ELSE 'NO_MATCH' END AS retrieval_decision
FROM gated g LEFT JOIN listed l USING (ticket_id)"""
S.CTES["routed"] = f"""
SELECT *, CASE WHEN human THEN 'human' ELSE 'agent' END AS route,
       CASE WHEN human THEN coalesce(escalation_reason, {S.lit(K.REASON_NO_MATCH)}) END AS queue_reason,
       CASE WHEN human THEN {S.lit(K.NOTICE_HEAD)} || coalesce(escalation_reason, {S.lit(K.REASON_NO_MATCH)}) || {S.lit(K.NOTICE_TAIL)}
            WHEN retrieval_decision = 'FOUND' THEN 'Based on a resolved case: ' || best_resolution
            ELSE 'Known steps from related cases: ' || resolutions END AS reply,
       CASE WHEN human THEN '' ELSE ids END AS grounding_case_ids,
       CASE WHEN human THEN 'pending_human_response' ELSE 'resolved_by_agent' END AS status
FROM (SELECT *, escalate_to_human OR retrieval_decision = 'NO_MATCH' AS human FROM tiered)"""


@register("t1_t5_gate", S.with_ctes("""
SELECT ticket_id, rule_high_risk, rule_urgent, rule_repeat, rule_unsure, escalate_to_human, escalation_reason FROM gated"""))
def t1_t5_gate(spark, d):
    return rt.gate(triage_input(spark, d), CFG).select(
        "ticket_id", "rule_high_risk", "rule_urgent", "rule_repeat", "rule_unsure", "escalate_to_human", "escalation_reason")


@register("t6_branch_after_gate", S.with_ctes(
    "SELECT CASE WHEN escalate_to_human THEN 'escalate' ELSE 'search' END AS branch, count(*) AS row_count FROM gated GROUP BY 1"))
def t6_branch_after_gate(spark, d):
    g = rt.gate(triage_input(spark, d), CFG)
    return g.groupBy(rt.branch_after_gate().alias("branch")).agg(F.count(F.lit(1)).alias("row_count"))


@register("t7_t9_tiers", S.with_ctes("""
SELECT ticket_id, top_similarity, retrieval_decision, route,
       CASE WHEN escalate_to_human OR retrieval_decision = 'NO_MATCH' THEN 'escalate' ELSE 'respond' END AS branch FROM routed"""))
def t7_t9_tiers(spark, d):
    return routed(spark, d).select(
        "ticket_id", "top_similarity", "retrieval_decision", "route",
        F.when(F.col("escalate_to_human"), "escalate").otherwise(
            rt.branch_after_tier(F.col("retrieval_decision"))).alias("branch"))


@register("t10_t11_escalations", S.with_ctes(
    "SELECT ticket_id, escalate_to_human, queue_reason, reply FROM routed WHERE route = 'human'"))
def t10_t11_escalations(spark, d):
    return routed(spark, d).where("route = 'human'").select("ticket_id", "escalate_to_human", "queue_reason", "reply")


@register("t12_context_block", S.with_ctes(
    "SELECT ticket_id, n_hits, coalesce(context, '') AS context, coalesce(ids, '') AS ids FROM routed"))
def t12_context_block(spark, d):
    return routed(spark, d).select(
        "ticket_id", F.size("retrieved_cases").cast("bigint").alias("n_hits"),
        rt.context_block().alias("context"), F.array_join(rt.grounding_ids(), ",").alias("ids"))


@register("t13_t14_replies", S.with_ctes(
    "SELECT ticket_id, reply, status, route, grounding_case_ids FROM routed WHERE route = 'agent'"))
def t13_t14_replies(spark, d):
    return routed(spark, d).where("route = 'agent'").select(
        "ticket_id", "reply", "status", "route", F.array_join("grounding_case_ids", ",").alias("grounding_case_ids"))


S.CTES["traces"] = """
SELECT ticket_id, array_to_string(list_filter([
  'intent_classification: Intent: ' || intent || ' (Confidence: ' || printf('%.1f', confidence * 100) || '%, Urgency: ' || urgency || ') -> intent=' || intent || ', urgency=' || urgency,
  CASE WHEN escalate_to_human THEN 'human_in_loop_check: Escalation triggered: ' || escalation_reason || ' -> branch: escalate_to_human'
       ELSE 'human_in_loop_check: Passed all triage safety checks (autonomous resolution eligible) -> branch: search_in_db' END,
  CASE WHEN NOT escalate_to_human THEN 'search_in_db: Retrieved ' || n_hits || ' cases (Top similarity: ' || printf('%.4f', top_similarity) || ' with +0.05 boost) -> top_similarity=' || printf('%.4f', top_similarity) END,
  CASE WHEN NOT escalate_to_human THEN 'decide_similarity: Threshold evaluation: score ' || printf('%.4f', top_similarity) || ' maps to ''' || retrieval_decision || ''' -> '
       || CASE retrieval_decision WHEN 'FOUND' THEN 'branch: generate_reply (FOUND tier)' WHEN 'RELATED' THEN 'branch: generate_reply (RELATED tier)'
               ELSE 'branch: escalate_to_human (Score below 0.55)' END END,
  CASE WHEN human THEN 'escalate_to_human: Enqueued in Human Queue (Urgency: ' || urgency || ') -> action: human_agent_pending'
       ELSE 'generate_reply: Generated grounded response using ' || n_hits || ' scenarios (' || retrieval_decision || ' mode) -> action: reply_dispatched' END
  ], lambda x: x IS NOT NULL), chr(10)) AS trace FROM routed"""


@register("t15_node_traces", S.with_ctes("SELECT ticket_id, trace FROM traces"))
def t15_node_traces(spark, d):
    line = F.transform("node_traces", lambda s: F.concat(s["node"], F.lit(": "), s["output_summary"], F.lit(" -> "), s["decision"]))
    return routed(spark, d).select("ticket_id", F.array_join(line, "\n").alias("trace"))


_T16 = ("ticket_id, intent, confidence, sentiment, urgency, urgency_reason, is_high_risk, escalate_to_human, escalation_reason, "
        "top_similarity, retrieval_decision, route, reply, grounding_case_ids, status")


@register("t16_triage", S.with_ctes(f'SELECT {_T16}, "query", n_hits FROM routed'))
def t16_triage(spark, d):
    out = routed(spark, d).withColumns({
        "grounding_case_ids": F.array_join("grounding_case_ids", ","),
        "n_hits": F.size("retrieved_cases").cast("bigint")})
    return out.select(*[c.strip() for c in _T16.split(",")], "query", "n_hits")


def _words_sql(x: str) -> str:
    return f"list_filter(list_distinct(regexp_split_to_array(lower({x}), '[^a-z0-9_]+')), lambda w: regexp_full_match(w, '[a-z]{{4,}}'))"


@register("t17_term_overlap", S.with_ctes(f"""
SELECT ticket_id, hit_rank, case_id, len(common) AS n_common, array_to_string(list_sort(common), ',') AS words FROM (
  SELECT g.ticket_id, h.hit_rank, h.case_id,
         list_intersect({_words_sql('g."query"')}, {_words_sql("h.document || ' ' || h.resolution")}) AS common
  FROM gated g JOIN triage_hits h USING (ticket_id))"""))
def t17_term_overlap(spark, d):
    """Words that each searched ticket shares with each case it was given."""
    hits = routed(spark, d).select("ticket_id", "query", F.posexplode("retrieved_cases").alias("at", "c"))
    common = rt.term_overlap(F.col("query"), F.col("c.query"), F.col("c.resolution"))
    return hits.select("ticket_id", (F.col("at") + 1).cast("bigint").alias("hit_rank"), "c.case_id", common.alias("w")).select(
        "ticket_id", "hit_rank", "case_id", F.size("w").cast("bigint").alias("n_common"),
        F.array_join(F.array_sort("w"), ",").alias("words"))


# --- queue state -----------------------------------------------------------------------


def rid(*parts: str) -> str:
    return "substr(md5(" + " || '/' || ".join(f"{p}::VARCHAR" for p in parts) + "), 1, 16)"


MESSAGE = "substr(md5({}::VARCHAR || '/' || strftime({}, '%Y%m%d%H%M%S%f')), 1, 16)"


def queue(spark, d, tickets=None, extra=()):
    return qu.queue_rows(routed(spark, d, ("created_at", *extra), tickets), F.col("created_at"), extra)


def turns_of(spark, d, role):
    """Turns with the message id of the ticket that has the conversation's number."""
    turns = fx.table(spark, d, "conversations").where(F.col("role") == role)
    t = fx.table(spark, d, "events").select(F.col("event_id").alias("conv_id"), "ts")
    return turns.join(t, "conv_id").withColumn("id", qu.message_id(F.col("conv_id"), F.col("ts")))


def queue_events(spark, d):
    """Answers of human agents: the assistant turns of the conversation with the same number."""
    return turns_of(spark, d, "assistant").select(
        "id", F.col("text").alias("human_response"),
        (F.col("ts") + F.make_dt_interval(mins=F.col("turn"))).alias("event_ts"),
        F.col("turn").alias("seq"))


S.CTES["queue"] = f"""
SELECT {MESSAGE.format('ticket_id', 'created_at')} AS id, ticket_id::VARCHAR AS ticket_id, "query" AS customer_query, intent, urgency, confidence,
       sentiment, urgency_reason, queue_reason AS escalation_reason, coalesce(to_json(cases_list)::VARCHAR, '[]') AS retrieved_cases_json,
       'pending' AS status, NULL::VARCHAR AS human_response, created_at, NULL::TIMESTAMP AS resolved_at
FROM routed WHERE route = 'human'"""
S.CTES["queue_events"] = f"""
SELECT {MESSAGE.format('conv_id', 'e.ts')} AS id, text AS human_response, e.ts + to_minutes(turn) AS event_ts, turn AS seq
FROM conversations c JOIN events e ON e.event_id = c.conv_id WHERE role = 'assistant'"""
S.CTES["last_answers"] = """
SELECT id, arg_max(human_response, (event_ts, seq)) AS answer, max(event_ts) AS answered_at FROM queue_events GROUP BY id"""
S.CTES["queue_now"] = """
SELECT q.* REPLACE (CASE WHEN a.id IS NOT NULL THEN 'resolved' ELSE status END AS status,
       coalesce(a.answer, human_response) AS human_response, coalesce(a.answered_at, resolved_at) AS resolved_at)
FROM queue q LEFT JOIN last_answers a USING (id)"""
_QUEUE = ("id, ticket_id, customer_query, intent, urgency, confidence, sentiment, urgency_reason, escalation_reason, "
          "status, human_response, created_at, resolved_at")


@register("s8_queue_rows", S.with_ctes(f"SELECT {_QUEUE}, retrieved_cases_json FROM queue"))
def s8_queue_rows(spark, d):
    path = tb.write_table(queue(spark, d), scratch_dir(spark, "queue"), mode="append")
    return tb.read_table(spark, path)


def queue_now(spark, d, tickets=None):
    return qu.resolve(queue(spark, d, tickets), queue_events(spark, d))


_RANK = "CASE urgency WHEN 'critical' THEN 1 WHEN 'high' THEN 2 WHEN 'medium' THEN 3 WHEN 'low' THEN 4 ELSE 5 END"


@register("q1_pending", S.with_ctes(
    f"SELECT id, ticket_id, urgency, created_at, {_RANK} AS urgency_rank, "
    f"row_number() OVER (ORDER BY {_RANK}, created_at, id) AS queue_position FROM queue_now WHERE status = 'pending'"))
def q1_pending(spark, d):
    # The numbering stores its rows and sorts them, so texts and cases stay out of it.
    return qu.pending(queue_now(spark, d).select("id", "ticket_id", "urgency", "created_at", "status")).select(
        "id", "ticket_id", "urgency", "created_at", "urgency_rank", "queue_position")


@register("q2_decode_cases", S.with_ctes("""
SELECT ticket_id, CASE WHEN urgency = 'critical' THEN 0 ELSE n_hits END AS n_cases,
       CASE WHEN urgency <> 'critical' THEN cases_list[1].case_id END AS first_case FROM routed WHERE route = 'human'"""))
def q2_decode_cases(spark, d):
    """Critical rows get a broken JSON text, which decodes to no cases."""
    text = F.when(F.col("urgency") == "critical", F.lit("[{broken")).otherwise(F.col("retrieved_cases_json"))
    cases = qu.decode_cases(text)
    return queue(spark, d).select(
        F.col("ticket_id").cast("bigint").alias("ticket_id"), F.size(cases).cast("bigint").alias("n_cases"),
        F.get(cases, F.lit(0))["case_id"].alias("first_case"))


@register("q3_resolve", S.with_ctes(f"SELECT {_QUEUE} FROM queue_now"))
def q3_resolve(spark, d):
    return queue_now(spark, d).drop("retrieved_cases_json")


@register("q4_not_found", S.with_ctes("""
SELECT id, seq, 'Queue ticket not found' AS message FROM queue_events WHERE id NOT IN (SELECT id FROM queue)"""))
def q4_not_found(spark, d):
    return qu.unknown_ids(queue_events(spark, d), queue(spark, d)).select("id", "seq", "message")


# Customer feedback: the quality label says whether the reply was okay; a toxic one
# comes with a note.
S.CTES["feedback"] = """
SELECT r.*, l.quality = 1 AS feedback_is_okay, CASE WHEN l.toxic = 1 THEN 'rude answer' ELSE '' END AS feedback_notes,
       r.ticket_id AS seq FROM routed r JOIN labels l ON l.doc_id = r.ticket_id"""
S.CTES["reviews"] = f"""
SELECT {rid('ticket_id', 'seq')} AS id, ticket_id::VARCHAR AS ticket_id, "query", intent, urgency, confidence,
       reply AS draft_reply, coalesce(nullif(feedback_notes, ''), '{K.DEFAULT_FEEDBACK_NOTE}') AS customer_feedback,
       'pending_review' AS status, created_at FROM feedback WHERE NOT feedback_is_okay"""
_REVIEW = 'id, ticket_id, "query", intent, urgency, confidence, draft_reply, customer_feedback, status, created_at'


def feedback(spark, d, tickets=None):
    out = routed(spark, d, ("created_at", "embedding"), tickets)
    marks = fx.table(spark, d, "labels").select(
        F.col("doc_id").alias("ticket_id"), (F.col("quality") == 1).alias("feedback_is_okay"),
        F.when(F.col("toxic") == 1, "rude answer").otherwise("").alias("feedback_notes"))
    return out.join(marks, "ticket_id").withColumn("seq", F.col("ticket_id"))


def reviews(spark, d, tickets=None):
    return qu.review_rows(feedback(spark, d, tickets), F.col("created_at"))


@register("s9_review_rows", S.with_ctes(f"SELECT {_REVIEW} FROM reviews"))
def s9_review_rows(spark, d):
    path = tb.write_table(reviews(spark, d), scratch_dir(spark, "reviews"), mode="append")
    return tb.read_table(spark, path).select(*[c.strip().strip('"') for c in _REVIEW.split(",")])


S.CTES["logs"] = f"""
SELECT {MESSAGE.format('ticket_id', 'created_at')} AS id, ticket_id::VARCHAR AS ticket_id, "query", intent, urgency, confidence, route, reply,
       grounding_case_ids, 'pending' AS feedback, created_at FROM routed"""


def logs(spark, d):
    return qu.log_rows(routed(spark, d, ("created_at",)), F.col("created_at"))


@register("s10_q12_log_rows", S.with_ctes(
    "SELECT *, coalesce(len(string_split(nullif(grounding_case_ids, ''), ',')), 0) AS n_grounding FROM logs"))
def s10_q12_log_rows(spark, d):
    path = tb.write_table(logs(spark, d), scratch_dir(spark, "logs"), mode="append")
    back = tb.read_table(spark, path)
    return back.withColumn("n_grounding", F.size(qu.text_to_ids(F.col("grounding_case_ids"))).cast("bigint"))


@register("q5_newest_reviews", S.with_ctes(
    "SELECT id, ticket_id, created_at, row_number() OVER (ORDER BY created_at DESC, id DESC) AS queue_position FROM reviews"))
def q5_newest_reviews(spark, d):
    return qu.review_positions(reviews(spark, d).select("id", "ticket_id", "created_at")).select(
        "id", "ticket_id", "created_at", "queue_position")


@register("q6_log_feedback", S.with_ctes(f"""
SELECT l.ticket_id, coalesce(m.feedback, l.feedback) AS feedback FROM logs l LEFT JOIN (
  SELECT {MESSAGE.format('conv_id', 'ts')} AS id, arg_max(text, turn) AS feedback
  FROM conversations JOIN events ON event_id = conv_id WHERE role = 'user' GROUP BY conv_id, ts) m USING (id)"""))
def q6_log_feedback(spark, d):
    turns = turns_of(spark, d, "user").select(
        "id", F.col("text").alias("feedback"), F.lit(0).alias("event_ts"), F.col("turn").alias("seq"))
    return qu.apply_feedback(logs(spark, d), turns).select("ticket_id", "feedback")


@register("q7_metrics", S.with_ctes("""
SELECT count_if(status = 'pending') AS pending_human_tickets,
       count_if(status = 'pending' AND urgency = 'critical') AS critical_human_tickets,
       (SELECT count(*) FROM reviews) AS developer_reviews_count, (SELECT count(*) FROM precedents) AS vector_db_cases_count
FROM queue_now"""))
def q7_metrics(spark, d):
    tickets = triage_input(spark, d)
    return qu.metrics(queue_now(spark, d, tickets), reviews(spark, d, tickets), index(spark, d))


@register("q8_recent_rejected", S.with_ctes("""
SELECT id, ticket_id, substr("query", 1, 120) AS "query", intent, urgency, substr(coalesce(draft_reply, ''), 1, 120) AS draft_reply,
       customer_feedback, created_at FROM reviews ORDER BY created_at DESC, id DESC LIMIT 10"""))
def q8_recent_rejected(spark, d):
    return qu.recent_rejected(reviews(spark, d))


S.CTES["okay_queries"] = """
SELECT 'agent_approved_' || substr(md5("query"), 1, 10) AS case_key, seq, embedding FROM feedback WHERE feedback_is_okay"""
S.CTES["okay_line"] = """
SELECT *, row_number() OVER (ORDER BY seq) AS n FROM (
  SELECT * FROM okay_queries QUALIFY row_number() OVER (PARTITION BY case_key ORDER BY seq) = 1) q
WHERE NOT EXISTS (SELECT 1 FROM precedents p
  WHERE round(list_cosine_similarity(q.embedding, p.embedding::DOUBLE[]), 4) > 0.96)"""
S.CTES["okay_near"] = """
SELECT q.n, p.n AS m FROM okay_line q JOIN okay_line p ON p.n < q.n
WHERE round(list_cosine_similarity(q.embedding, p.embedding), 4) > 0.96"""
S.CTES["okay_steps"] = """
SELECT 0::BIGINT AS n, []::BIGINT[] AS kept
UNION ALL /* recursive step */
SELECT f.n, CASE WHEN EXISTS (SELECT 1 FROM okay_near c WHERE c.n = f.n AND list_contains(a.kept, c.m))
                 THEN a.kept ELSE list_append(a.kept, f.n) END
FROM okay_steps a JOIN okay_line f ON f.n = a.n + 1"""
S.CTES["feedback_sinks"] = """
SELECT case_key AS id, 'index' AS sink FROM okay_line
WHERE n IN (SELECT unnest(kept) FROM (SELECT kept FROM okay_steps ORDER BY n DESC LIMIT 1))
UNION ALL SELECT id, 'review' FROM reviews"""


@register("q9_feedback_routing", S.with_ctes("SELECT id, sink FROM feedback_sinks"))
def q9_feedback_routing(spark, d):
    """Approved replies pass the gate into the index, rejected ones go to review; both tables read back."""
    okay, rejected = qu.split_feedback(materialise(feedback(spark, d), "feedback"))
    cases = tb.write_table(ix.add_approved(stored_index(spark, d), okay, CFG), scratch_dir(spark, "approved"))
    review = tb.write_table(qu.review_rows(rejected, F.col("created_at")), scratch_dir(spark, "reviews"), mode="append")
    return tb.read_table(spark, cases).select(F.col("case_key").alias("id"), F.lit("index").alias("sink")).unionByName(
        tb.read_table(spark, review).select("id", F.lit("review").alias("sink")))


S.CTES["answered"] = f"""
SELECT q.ticket_id, {S.strip(S.handle(S.billing_zip(S.phone(S.email('customer_query')))))} AS document, a.answer AS resolution, q.intent
FROM queue q JOIN last_answers a USING (id)"""


@register("q10_index_resolutions", S.with_ctes(f"""
SELECT case_key, case_id, intent, source, resolution FROM precedents
UNION ALL SELECT ticket_id || '_' || substr(md5(document), 1, 8), ticket_id, intent, '{K.HUMAN}', resolution FROM answered"""))
def q10_index_resolutions(spark, d):
    q = queue(spark, d, extra=("embedding",))
    idx = index(spark, d).withColumn("embedding", F.col("embedding").cast("array<double>"))
    out = qu.index_resolutions(idx, q, queue_events(spark, d))
    return out.select("case_key", "case_id", "intent", "source", "resolution")


@register("q11_waiting_time", S.with_ctes("""
SELECT ticket_id, printf('%02d:%02d', s // 60, s % 60) AS waiting FROM (
  SELECT ticket_id, greatest(0, floor((epoch_us(TIMESTAMP '2024-01-02 00:00:00') - epoch_us(created_at)) / 1000000))::BIGINT AS s FROM queue)"""))
def q11_waiting_time(spark, d):
    as_of = F.lit("2024-01-02 00:00:00").cast("timestamp")
    return queue(spark, d).select("ticket_id", qu.waiting_time(F.col("created_at"), as_of).alias("waiting"))


@register("a10_pii_residue", S.with_ctes(f"""
SELECT source, count(*) AS row_count,
       count_if(regexp_matches(document, {S.lit(K.EMAIL_PATTERN)})) AS email_hits,
       count_if(regexp_matches(document, {S.lit(K.PHONE_PATTERN)})) AS phone_hits,
       count_if(regexp_matches(document, {S.lit(K.BILLING_ZIP_PATTERN)}, 'i')) AS billing_zip_hits,
       count_if(regexp_matches(document, {S.lit(K.HANDLE_PATTERN)})) AS handle_hits
FROM (SELECT ticket_text AS document, CASE WHEN is_solved THEN 'clean' ELSE 'clean_open' END AS source FROM tickets
      UNION ALL SELECT ticket_description, 'raw' FROM tickets_raw) GROUP BY source"""))
def a10_pii_residue(spark, d):
    from ticketloom.operators import profiling as pf

    t = clean_tickets(spark, d).select(
        F.col("ticket_text").alias("document"), F.when(F.col("is_solved"), "clean").otherwise("clean_open").alias("source"))
    raw = fx.tickets_raw(spark, d).select(F.col("ticket_description").alias("document"), F.lit("raw").alias("source"))
    return pf.pii_residue(t.unionByName(raw))


@register("a9_funnel", S.with_ctes("""
SELECT 1 AS stage_no, 'raw' AS stage, count(*) AS row_count FROM tickets_raw
UNION ALL SELECT 2, 'clean', count(*) FROM tickets UNION ALL SELECT 3, 'resolved', count(*) FROM tickets WHERE is_solved
UNION ALL SELECT 4, 'indexed', count(*) FROM solved_index"""))
def a9_funnel(spark, d):
    """Rows of each stage, counted while the stage is written."""
    from ticketloom.catalog.retrieval import solved_index
    from ticketloom.operators import profiling as pf

    raw, n_raw = pf.counted(fx.tickets_raw(spark, d), "raw")
    clean, n_clean = pf.counted(hy.clean_tickets(raw, extra=("created_at",)), "clean")
    _, n_solved = pf.counted(clean.where("is_solved").select("ticket_id"), "resolved")
    rows = solved_index(spark, d, clean).select(*[c for c in ix.INDEX_COLUMNS if c != "embedding"], F.lit(None).alias("embedding"))
    _, n_indexed = pf.counted(ix.upsert(None, rows).select("case_key"), "indexed")
    return pf.funnel_of(spark, [("raw", n_raw), ("clean", n_clean), ("resolved", n_solved), ("indexed", n_indexed)])
