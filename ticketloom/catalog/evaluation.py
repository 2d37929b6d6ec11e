"""Registered queries: golden set, scores, audits, routing costs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ticketloom import constants as K
from ticketloom.catalog import sql as S
from ticketloom.catalog.hygiene import clean_tickets
from ticketloom.catalog.labelling import rule_sql
from ticketloom.catalog.registry import Family
from ticketloom.catalog.retrieval import dated_tickets, holdout, index, labelled_for_index, solved_index
from ticketloom.catalog.routing import routed, triage_input
from ticketloom.config import TriageConfig
from ticketloom.operators import evaluation as ev
from ticketloom.operators import index as ix
from ticketloom.operators import labelling as lb
from ticketloom.operators import overlap as ov
from ticketloom.operators import profiling as pf
from ticketloom.operators import routing as rt
from ticketloom.session import materialise
from ticketloom.sources import fixtures as fx

FAMILY = Family()
register = FAMILY.register
CFG = TriageConfig()


def golden_spec(spark, d):
    """Every annotated document as a golden ticket."""
    marks = fx.table(spark, d, "labels").select(F.col("doc_id").alias("ticket_id"), "toxic")
    orders = fx.table(spark, d, "orders").select("o_orderkey", "o_orderpriority").alias("o")
    level = F.expr(fx.PRIORITY_SQL)
    own = orders.select(F.col("o_orderkey").alias("ticket_id"), F.lower(level).alias("urgency"))
    after = orders.select((F.col("o_orderkey") - 1).alias("ticket_id"), level.alias("raw_priority"))
    truth = fx.ticket_vectors(spark, d).select("ticket_id", fx.intent_name(F.col("label")).alias("intent"))
    spec = marks.join(own, "ticket_id").join(after, "ticket_id", "left").join(truth, "ticket_id")
    return spec.select(
        "ticket_id", "intent", "urgency", F.lit("annotated").alias("urgency_reason"),
        (ev.is_urgent(F.col("urgency")) | (F.col("toxic") == 1)).alias("should_escalate"), "raw_priority")


def golden(spark, d, tickets=None):
    return ev.golden_set(golden_spec(spark, d), clean_tickets(spark, d) if tickets is None else tickets)[0]


def predictions(spark, d, tickets=None):
    return routed(spark, d, tickets=tickets).select(
        "ticket_id", "intent", "confidence", "sentiment", "urgency", "urgency_reason", "is_high_risk",
        "route", "reply", "top_similarity", "retrieved_cases", "query")


def judged(spark, d):
    """Tickets as the triage reads them, and the golden set of these: cleaned once and stored for both.

    A ticket without classification or vector has no prediction, so nothing looks for it here.
    """
    t = triage_input(spark, d, ("product", "ticket_priority", "ticket_type", "ticket_subject"))
    return t, golden(spark, d, t.withColumnRenamed("query", "ticket_text"))


def aligned(spark, d):
    tickets, known = judged(spark, d)
    return ev.align(known, predictions(spark, d, tickets))


def labels_only(spark, d):
    """Golden rows with the classifier's columns, for scores that need no route."""
    return ev.align(golden(spark, d), fx.classifications(spark, d))


S.CTES["spec"] = f"""
SELECT l.doc_id AS ticket_id, {S.intent_at('v.label')} AS intent, lower({fx.PRIORITY_SQL}) AS urgency,
       lower({fx.PRIORITY_SQL}) IN ('high', 'critical') OR l.toxic = 1 AS should_escalate,
       CASE WHEN n.o_orderkey IS NOT NULL THEN {fx.PRIORITY_SQL.replace('CASE o.', 'CASE n.')} END AS raw_priority
FROM labels l JOIN orders o ON o.o_orderkey = l.doc_id LEFT JOIN orders n ON n.o_orderkey = l.doc_id + 1
JOIN vectors v ON v.ticket_id = l.doc_id"""
S.CTES["golden"] = """
SELECT s.*, t.ticket_text, t.product, t.ticket_type AS raw_type, t.ticket_subject AS raw_subject
FROM spec s JOIN tickets t USING (ticket_id)"""
S.CTES["aligned"] = """
SELECT g.*, p.intent AS pred_intent, p.urgency AS pred_urgency, p.urgency_reason AS pred_reason, p.confidence AS pred_confidence,
       p.rule_high_risk OR p.rule_urgent OR p.rule_repeat AS other_rules, p.route AS pred_route, p.reply AS pred_reply,
       p.n_hits AS pred_hits, p.top_similarity AS pred_top, p."query" AS pred_query
FROM golden g JOIN routed p USING (ticket_id)"""

_URG = "lower({}) IN ('high', 'critical')"


def scores_sql(truth: str, pred: str, table: str = "aligned", keep: str = "", group: str = "") -> str:
    return f"""
SELECT {keep} tp, fp, fn, tn, round(coalesce(tp / nullif(tp + fp, 0), 0), 4) AS precision,
       round(coalesce(tp / nullif(tp + fn, 0), 0), 4) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 4) AS f1
FROM (SELECT {keep} count_if({truth} AND {pred}) AS tp, count_if(NOT ({truth}) AND {pred}) AS fp,
             count_if({truth} AND NOT ({pred})) AS fn, count_if(NOT ({truth}) AND NOT ({pred})) AS tn FROM {table} {group})"""


def rates_sql(inner: str) -> str:
    return f"""
SELECT *, round(far, 4) AS false_auto_handle_rate, round(fer, 4) AS false_escalation_rate,
       round((fn + tn) / (tp + fp + fn + tn), 4) AS automation_rate, round(5 * far + fer, 4) AS asymmetric_loss
FROM (SELECT *, coalesce(fn / nullif(fn + tn, 0), 0) AS far, coalesce(fp / nullif(tp + fp, 0), 0) AS fer FROM ({inner}))"""


@register("e1_golden_set", S.with_ctes("""
SELECT ticket_id, ticket_text, product, intent, urgency, should_escalate, raw_priority, raw_type, raw_subject,
       'human_expert_review' AS annotator, true AS found FROM golden
UNION ALL SELECT ticket_id, NULL, NULL, intent, urgency, should_escalate, raw_priority, NULL, NULL, NULL, false
FROM spec WHERE ticket_id NOT IN (SELECT ticket_id FROM tickets)"""))
def e1_golden_set(spark, d):
    good, missing = ev.golden_set(golden_spec(spark, d), clean_tickets(spark, d))
    return good.withColumn("found", F.lit(True)).unionByName(
        missing.withColumn("found", F.lit(False)), allowMissingColumns=True).drop("urgency_reason")


@register("e2_golden_counts", S.with_ctes(f"""
SELECT count(*) AS total, count_if({_URG.format('urgency')}) AS urgent, count_if({_URG.format('urgency')}) >= 25 AS enough_urgent FROM golden"""))
def e2_golden_counts(spark, d):
    return ev.golden_counts(golden(spark, d))


@register("e3_align", S.with_ctes("""
SELECT ticket_id, intent, pred_intent, urgency, pred_urgency, should_escalate, pred_route FROM aligned"""))
def e3_align(spark, d):
    return aligned(spark, d).select("ticket_id", "intent", "pred_intent", "urgency", "pred_urgency", "should_escalate", "pred_route")


@register("e3_unpredicted", S.with_ctes("""
SELECT l.doc_id AS ticket_id FROM labels l WHERE l.doc_id NOT IN (SELECT ticket_id FROM routed)"""))
def e3_unpredicted(spark, d):
    return ev.unpredicted(golden_spec(spark, d), predictions(spark, d)).select("ticket_id")


@register("e4_accuracy", S.with_ctes(
    "SELECT count(*) AS total, round(count_if(intent = pred_intent) / count(*), 4) AS accuracy FROM aligned"))
def e4_accuracy(spark, d):
    return ev.accuracy(labels_only(spark, d))


S.CTES["per_class"] = """
SELECT label, coalesce(hits / nullif(predicted_n, 0), 0) AS precision, coalesce(hits / nullif(support, 0), 0) AS recall,
       coalesce(2 * hits / nullif(predicted_n + support, 0), 0) AS f1, support
FROM (SELECT label, (SELECT count(*) FROM aligned WHERE intent = label) AS support,
             (SELECT count(*) FROM aligned WHERE pred_intent = label) AS predicted_n,
             (SELECT count(*) FROM aligned WHERE pred_intent = label AND intent = label) AS hits
      FROM (SELECT intent AS label FROM aligned UNION SELECT pred_intent FROM aligned))"""


@register("e5_per_class", S.with_ctes(
    "SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM per_class"))
def e5_per_class(spark, d):
    out = ev.per_class(ev.confusion(labels_only(spark, d)))
    return out.select("label", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


@register("e6_averages", S.with_ctes("""
SELECT 'macro avg' AS average, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1, sum(support)::BIGINT AS support FROM per_class
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6),
       round(sum(f1 * support) / sum(support), 6), sum(support)::BIGINT FROM per_class"""))
def e6_averages(spark, d):
    return ev.averages(ev.per_class(ev.confusion(labels_only(spark, d))))


@register("e7_e8_urgency_scores", S.with_ctes(scores_sql(_URG.format("urgency"), _URG.format("pred_urgency"))))
def e7_e8_urgency_scores(spark, d):
    return ev.urgency_scores(labels_only(spark, d))


@register("e9_raw_priority_scores", S.with_ctes(
    scores_sql(_URG.format("urgency"), "coalesce(" + _URG.format("raw_priority") + ", false)")))
def e9_raw_priority_scores(spark, d):
    return ev.urgency_scores(golden(spark, d), "raw_priority")


S.CTES["disagreements"] = f"""
SELECT ticket_id, ticket_text AS "query", urgency AS golden_urgency, lower(pred_urgency) AS predicted_urgency, pred_reason AS reason,
       lower(coalesce(raw_priority, 'unknown')) AS raw_priority
FROM aligned WHERE ({_URG.format("coalesce(raw_priority, 'unknown')")}) <> ({_URG.format('pred_urgency')})"""


@register("e10_disagreements", S.with_ctes("SELECT * FROM disagreements"))
def e10_disagreements(spark, d):
    return ev.disagreements(labels_only(spark, d))


@register("e10_first_disagreements", S.with_ctes("SELECT * FROM disagreements ORDER BY ticket_id LIMIT 5"))
def e10_first_disagreements(spark, d):
    return ev.first_disagreements(labels_only(spark, d))


@register("e11_escalation_scores", S.with_ctes(scores_sql("should_escalate", "pred_route = 'human'")))
def e11_escalation_scores(spark, d):
    return ev.escalation_scores(aligned(spark, d))


@register("e12_coverage", S.with_ctes("""
SELECT count(*) AS total_audited, count_if(n_hits > 0 AND length(reply) > 10) AS grounded_count,
       round(count_if(n_hits > 0 AND length(reply) > 10) / count(*), 4) AS groundedness_ratio FROM routed"""))
def e12_coverage(spark, d):
    return ev.coverage(routed(spark, d))


# Two template replies in three carry no promise; the audited reply of a human-tone ticket does.
_PROMISE = "CASE WHEN ticket_id % 3 = 0 THEN reply || ' We guarantee it.' ELSE reply END"
S.CTES["audit"] = f"""
SELECT ticket_id, substr("query", 1, 120) AS "query", substr(reply, 1, 150) AS reply_snippet, n_hits AS retrieved_count, top_similarity,
       NOT {S.any_of('lower(reply)', K.PROMISE_TERMS)} AS is_grounded,
       CASE WHEN {S.any_of('lower(reply)', K.PROMISE_TERMS)} THEN '{K.NOTE_PROMISE}' ELSE '{K.NOTE_GROUNDED}' END AS audit_notes
FROM (SELECT * REPLACE ({_PROMISE} AS reply) FROM routed WHERE route = 'agent' AND n_hits > 0) ORDER BY ticket_id LIMIT 20"""


def audited(spark, d):
    tickets, known = judged(spark, d)
    return ev.audit_sample(predictions(spark, d, tickets).withColumn("reply", F.expr(_PROMISE)), known)


@register("e13_audit_findings", S.with_ctes("SELECT * FROM audit"))
def e13_audit_findings(spark, d):
    return audited(spark, d)


@register("e13_audit_summary", S.with_ctes("""
SELECT count(*) AS total_audited, count_if(is_grounded) AS grounded_count, count_if(NOT is_grounded) AS hallucination_count,
       CASE WHEN count(*) = 0 THEN 1.0::DOUBLE ELSE round(count_if(is_grounded) / count(*), 4) END AS groundedness_ratio FROM audit"""))
def e13_audit_summary(spark, d):
    return ev.audit_summary(audited(spark, d))


S.CTES["leaky_index"] = "SELECT ticket_id, ticket_text FROM tickets WHERE is_solved"


@register("e14_leakage", S.with_ctes("""
SELECT 'all solved' AS indexed, count(*) AS golden_rows, count_if(ticket_id IN (SELECT ticket_id FROM leaky_index)) AS leaked_ids,
       count_if(ticket_text IN (SELECT ticket_text FROM leaky_index)) AS leaked_texts FROM golden
UNION ALL SELECT 'holdout left out', count(*), count_if(ticket_id IN (SELECT ticket_id FROM solved_index)),
       count_if(ticket_text IN (SELECT document FROM solved_index)) FROM golden"""))
def e14_leakage(spark, d):
    # Tickets, golden rows and both indexes are written once and read narrow.
    t = dated_tickets(spark, d)
    g = materialise(golden(spark, d, t).select("ticket_id", "ticket_text"), "golden")
    rows = {
        "all solved": ix.to_index_rows(ix.solved_cases(labelled_for_index(spark, d, t))),
        "holdout left out": solved_index(spark, d, t),
    }
    found = [
        ev.leakage(g, materialise(df.select("case_id", "document"), "indexed")).select(F.lit(name).alias("indexed"), "*")
        for name, df in rows.items()
    ]
    return found[0].unionByName(found[1])


S.CTES["golden_shingles"] = r"""
SELECT ticket_id, list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS s
FROM (SELECT ticket_id, regexp_extract_all(lower(ticket_text), '[^\x20\x09-\x0D]+') AS w FROM golden) WHERE len(w) > 0"""
S.CTES["index_shingles"] = r"""
SELECT case_key, list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS s
FROM (SELECT case_key, regexp_extract_all(lower(document), '[^\x20\x09-\x0D]+') AS w FROM solved_index) WHERE len(w) > 0"""
S.CTES["leaky_shingles"] = S.CTES["index_shingles"].replace("FROM solved_index", """FROM (
  SELECT ticket_id || '_' || substr(md5(ticket_text), 1, 8) AS case_key, ticket_text AS document FROM leaky_index)""")


def _near_sql(index: str) -> str:
    return f"""
SELECT ticket_id, case_key, common / (a + b - common) AS jaccard FROM (
  SELECT ticket_id, case_key, len(g.s)::DOUBLE AS a, len(i.s)::DOUBLE AS b, len(list_intersect(g.s, i.s))::DOUBLE AS common
  FROM golden_shingles g JOIN {index} i
    ON least(len(g.s), len(i.s)) >= {ov.THRESHOLD}::DOUBLE * greatest(len(g.s), len(i.s)) - 1e-9)
WHERE jaccard >= {ov.THRESHOLD}::DOUBLE - 1e-9"""


S.CTES["near_pairs"], S.CTES["leaky_pairs"] = _near_sql("index_shingles"), _near_sql("leaky_shingles")


@register("v18_near_holdout", S.with_ctes("""
SELECT indexed, ticket_id, case_key, round(jaccard, 6) AS jaccard
FROM (SELECT 'all solved' AS indexed, * FROM leaky_pairs UNION ALL SELECT 'holdout left out', * FROM near_pairs)
QUALIFY row_number() OVER (PARTITION BY indexed, ticket_id ORDER BY jaccard DESC, case_key) = 1"""))
def v18_near_holdout(spark, d):
    """Golden tickets that an index holds in nearly the same words: one of all solved tickets, and one
    that was built without the golden ones. Only ids and texts are stored and moved."""
    t = materialise(clean_tickets(spark, d).select("ticket_id", "ticket_text", "is_solved"), "ticket-texts")
    g = t.join(golden_spec(spark, d).select("ticket_id"), "ticket_id", "left_semi").select("ticket_id", "ticket_text")
    key = ix.case_key(F.lit(None), F.col("ticket_id"), F.col("ticket_text")).alias("case_key")
    solved = t.where("is_solved")
    rows = {"all solved": solved, "holdout left out": solved.join(holdout(spark, d), "ticket_id", "left_anti")}
    found = [
        ov.near_holdout(g, df.select(key, F.col("ticket_text").alias("document"))).select(F.lit(name).alias("indexed"), "*")
        for name, df in rows.items()
    ]
    return found[0].unionByName(found[1])


@register("v18_clean_index", S.with_ctes(
    "SELECT case_key, intent FROM solved_index WHERE case_key NOT IN (SELECT case_key FROM near_pairs)"))
def v18_clean_index(spark, d):
    """The index without what comes near a golden ticket."""
    t = dated_tickets(spark, d)
    rows = materialise(solved_index(spark, d, t).select("case_key", "document", "intent"), "solved-index")
    return ov.without_near(rows, golden(spark, d, t)).select("case_key", "intent")


@register("e15_golden_checks", S.with_ctes("""
SELECT rule, violations, violations = 0 AS passed FROM (
  SELECT 'null:intent' AS rule, count_if(intent IS NULL) AS violations FROM golden
  UNION ALL SELECT 'null:urgency', count_if(urgency IS NULL) FROM golden
  UNION ALL SELECT 'rule:known_urgency', count_if(coalesce(urgency, '') NOT IN ('low', 'medium', 'high', 'critical')) FROM golden
  UNION ALL SELECT 'unique:ticket_id', count(*) - count(DISTINCT ticket_id) FROM golden
  UNION ALL SELECT 'rule:raw_agrees', count_if(NOT coalesce(lower(raw_priority) = urgency, false)) FROM golden)"""))
def e15_golden_checks(spark, d):
    g = materialise(golden(spark, d).select("ticket_id", "intent", "urgency", "raw_priority"), "golden")
    return pf.quality_report(g, not_null=("intent", "urgency"), unique=("ticket_id",), rules={
        "known_urgency": F.col("urgency").isin("low", "medium", "high", "critical"),
        "raw_agrees": F.lower("raw_priority") == F.col("urgency")})


@register("e16_confusion", S.with_ctes(
    "SELECT intent AS truth, pred_intent AS predicted, count(*) AS row_count FROM aligned GROUP BY ALL"))
def e16_confusion(spark, d):
    return ev.confusion(labels_only(spark, d))


def _action(x: str) -> str:
    return f"CASE WHEN {x} IN {S.words(S.HIGH_RISK)} THEN 'human' WHEN {x} IN {S.words(ev.TROUBLESHOOTING)} THEN 'troubleshooting' ELSE {x} END"


@register("e17_operational_accuracy", S.with_ctes(f"""
SELECT count(*) AS total, count_if(intent = pred_intent) AS exact, count_if({_action('intent')} = {_action('pred_intent')}) AS same_action,
       round(count_if({_action('intent')} = {_action('pred_intent')}) / count(*), 4) AS operational_accuracy FROM aligned"""))
def e17_operational_accuracy(spark, d):
    return ev.operational_accuracy(labels_only(spark, d))


@register("e18_e19_routing_rates", S.with_ctes(
    "SELECT tp, fp, fn, tn, false_auto_handle_rate, false_escalation_rate, automation_rate, asymmetric_loss FROM ("
    + rates_sql(scores_sql("should_escalate", "pred_route = 'human'")) + ")"))
def e18_e19_routing_rates(spark, d):
    return ev.routing_rates(aligned(spark, d))


S.CTES["swept"] = "SELECT a.*, threshold FROM aligned a, (SELECT unnest([0.5, 0.6, 0.7]::DOUBLE[]) AS threshold)"


@register("e20_threshold_sweep", S.with_ctes(
    "SELECT * EXCLUDE (far, fer) FROM (" + rates_sql(scores_sql(
        "should_escalate", "(other_rules OR pred_confidence < threshold)", "swept", "threshold,", "GROUP BY threshold")) + ")"))
def e20_threshold_sweep(spark, d):
    tickets, known = judged(spark, d)
    rules = tickets.withColumn("other_rules", ev.other_rules()).select("ticket_id", "other_rules", "confidence")
    return ev.threshold_sweep(ev.align(known, rules))


@register("e21_trivial_baselines", S.with_ctes("""
SELECT total, round(top / total, 4) AS majority_accuracy, round(2 * human / (human + total), 4) AS always_escalate_f1, 0.0::DOUBLE AS never_urgent_f1
FROM (SELECT count(*) AS total, count_if(should_escalate) AS human,
             (SELECT max(n) FROM (SELECT count(*) AS n FROM golden GROUP BY intent)) AS top FROM golden)"""))
def e21_trivial_baselines(spark, d):
    return ev.trivial_baselines(golden(spark, d))


S.CTES["by_rules"] = f"""
SELECT g.*, r.intent AS pred_intent, r.urgency AS pred_urgency,
       r.is_high_risk OR r.urgency IN ('high', 'critical') OR r.sentiment = 'strongly_negative' OR r.confidence < 0.6 AS pred_human
FROM golden g JOIN (SELECT ticket_id, {rule_sql('ticket_text')} FROM tickets) r USING (ticket_id)"""


@register("e22_keyword_baseline", S.with_ctes(f"""
SELECT (SELECT round(count_if(intent = pred_intent) / count(*), 4) FROM by_rules) AS accuracy, u.f1 AS urgent_f1, e.f1 AS escalation_f1
FROM ({scores_sql(_URG.format('urgency'), _URG.format('pred_urgency'), 'by_rules')}) u,
     ({scores_sql('should_escalate', 'pred_human', 'by_rules')}) e"""))
def e22_keyword_baseline(spark, d):
    t = materialise(clean_tickets(spark, d), "tickets")
    rules = lb.classify_by_rules(t.select("ticket_id", F.col("ticket_text").alias("query")))
    gated = rt.gate(rules, CFG).withColumn("route", F.when(F.col("escalate_to_human"), "human").otherwise("agent"))
    # Three scores read the aligned rows.
    a = materialise(ev.align(golden(spark, d, t), gated.select("ticket_id", "intent", "urgency", "route")), "aligned")
    return ev.accuracy(a).select(
        "accuracy", ev.urgency_scores(a).select("f1").scalar().alias("urgent_f1"),
        ev.escalation_scores(a).select("f1").scalar().alias("escalation_f1"))


@register("e23_latency", """
SELECT event_type, count(*) AS row_count, round(quantile_cont(value, 0.95), 4) AS p95 FROM events GROUP BY event_type""")
def e23_latency(spark, d):
    return ev.latency(fx.table(spark, d, "events"), "event_type", "value")
