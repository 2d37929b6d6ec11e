import pytest
from pyspark.sql import functions as F

from ticketloom import constants as K
from ticketloom.operators import queue as qu
from ticketloom.operators import routing as rt
from ticketloom.plans.triage import triage

GATE = ("id int, query string, is_high_risk boolean, urgency string, urgency_reason string, sentiment string, "
        "confidence double")


def gate(spark, *rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], GATE)
    return rt.gate(df).orderBy("id").collect()


def test_gate_truth_table(spark):
    rows = gate(
        spark,
        ("refund please", True, "low", "r", "neutral", 0.9),
        ("site is down", False, "Critical", "outage", "neutral", 0.9),
        ("I contacted you AGAIN", False, "low", "r", "neutral", 0.9),
        ("hello", False, "low", "r", "neutral", 0.45),
        ("hello", False, "low", "r", "neutral", 0.60),
        ("against the wall", False, "low", "r", "neutral", 0.9),
        ("hi", None, None, None, None, None),
        ("again", True, "high", "late", "strongly_negative", 0.1),
    )
    assert [r["escalate_to_human"] for r in rows] == [True, True, True, True, False, True, False, True]
    assert rows[1]["escalation_reason"] == "Elevated urgency: critical (outage)"
    assert rows[3]["escalation_reason"] == "Low classifier confidence (0.45 < 0.6)"
    assert rows[4]["escalation_reason"] is None
    assert rows[7]["escalation_reason"] == " | ".join([
        K.REASON_HIGH_RISK, "Elevated urgency: high (late)", K.REASON_REPEAT,
        "Low classifier confidence (0.10 < 0.6)"])


def test_tier_bounds(spark):
    df = spark.createDataFrame([(0.80,), (0.7999,), (0.55,), (0.5499,), (0.0,)], "s double")
    got = [r[0] for r in df.select(rt.tier(F.col("s"))).collect()]
    assert got == ["FOUND", "RELATED", "RELATED", "NO_MATCH", "NO_MATCH"]


def test_fixed_rounds_the_binary_value(spark):
    df = spark.createDataFrame([(0.305,), (0.125,), (1.0,)], "s double")
    assert [r[0] for r in df.select(rt.fixed(F.col("s"), 2)).collect()] == ["0.30", "0.12", "1.00"]


@pytest.fixture(scope="module")
def flow(spark):
    index = spark.createDataFrame([
        ("k1", "wifi broken", "c1", "wifi", "human_resolved", "reset router", "p", [1.0, 0.0]),
        ("k2", "wifi slow", "c2", "wifi", "agent_generated_approved", "move closer", "p", [0.6, 0.8]),
    ], "case_key string, document string, case_id string, intent string, source string, resolution string, "
       "product string, embedding array<double>")
    tickets = spark.createDataFrame([
        (1, "my wifi", "wifi", 0.9, "neutral", "low", "r", False, [1.0, 0.0]),
        (2, "my wifi", "wifi", 0.9, "neutral", "low", "r", False, [0.0, 1.0]),
        (3, "odd", "wifi", 0.9, "neutral", "low", "r", False, [-1.0, 0.0]),
        (4, "refund", "wifi", 0.9, "neutral", "low", "r", True, [1.0, 0.0]),
        (5, "  ", "wifi", 0.9, "neutral", "low", "r", False, [1.0, 0.0]),
        (6, "unknown intent", "zzz", 0.9, "neutral", "low", "r", False, [1.0, 0.0]),
    ], "ticket_id bigint, query string, intent string, confidence double, sentiment string, urgency string, "
       "urgency_reason string, is_high_risk boolean, embedding array<double>")
    return {r["ticket_id"]: r for r in triage(tickets, index).collect()}


def test_triage_routes(flow):
    assert set(flow) == {1, 2, 3, 4, 6}  # the blank one is rejected
    assert (flow[1]["retrieval_decision"], flow[1]["route"], flow[1]["top_similarity"]) == ("FOUND", "agent", 1.0)
    assert flow[1]["reply"] == "Based on a resolved case: reset router"
    assert flow[1]["grounding_case_ids"] == ["c1", "c2"]
    assert (flow[2]["retrieval_decision"], flow[2]["top_similarity"]) == ("FOUND", 0.8)
    assert (flow[3]["retrieval_decision"], flow[3]["route"]) == ("NO_MATCH", "human")
    assert flow[3]["escalate_to_human"] is False and flow[3]["queue_reason"] == K.REASON_NO_MATCH
    assert flow[4]["route"] == "human" and flow[4]["retrieved_cases"] == [] and flow[4]["retrieval_decision"] == ""
    assert flow[6]["route"] == "agent" and len(flow[6]["retrieved_cases"]) == 2


def test_messages_of_one_ticket_are_not_multiplied(spark):
    index = spark.createDataFrame([
        ("k1", "wifi broken", "c1", "wifi", "human_resolved", "reset router", "p", [1.0, 0.0]),
        ("k2", "wifi slow", "c2", "wifi", "agent_generated_approved", "move closer", "p", [0.6, 0.8]),
    ], "case_key string, document string, case_id string, intent string, source string, resolution string, "
       "product string, embedding array<double>")
    same = (7, "my wifi", "wifi", 0.9, "neutral", "low", "r", False)
    tickets = spark.createDataFrame(
        [(*same, [1.0, 0.0], 1), (*same, [1.0, 0.0], 2), (*same, [-0.6, -0.8], 3)],
        "ticket_id bigint, query string, intent string, confidence double, sentiment string, urgency string, "
        "urgency_reason string, is_high_risk boolean, embedding array<double>, at bigint",
    ).withColumn("created_at", F.timestamp_seconds("at"))
    out = triage(tickets, index, carry=("created_at",))
    rows = sorted(out.collect(), key=lambda r: r["created_at"])
    assert [r["retrieval_decision"] for r in rows] == ["FOUND", "FOUND", "NO_MATCH"]
    assert [len(r["retrieved_cases"]) for r in rows] == [2, 2, 2]
    logged = qu.log_rows(out, F.col("created_at"))
    assert logged.select("id").distinct().count() == 3


def test_tickets_that_the_gate_holds_back_meet_no_hits(spark, flow):
    """They do not move to the hits, even when another message of their ticket asks with the same vector."""
    columns = ("ticket_id string, query string, intent string, confidence double, sentiment string, urgency string, "
               "urgency_reason string, is_high_risk boolean, embedding array<double>")
    tickets = spark.createDataFrame([
        ("t", "where is it", "a", 0.9, "neutral", "low", "r", False, [1.0, 0.0]),
        ("t", "where is it now", "a", 0.1, "neutral", "low", "r", False, [1.0, 0.0]),
        ("t", "unknown", "a", None, None, None, None, None, [1.0, 0.0]),
    ], columns)
    case = [("c", "text", "c", "a", K.HUMAN, "answer", "p", None, [1.0, 0.0])]
    index = spark.createDataFrame(
        case, "case_key string, document string, case_id string, intent string, source string, resolution string, "
        "product string, timestamp timestamp, embedding array<double>")
    got = {r["query"]: (r["escalate_to_human"], len(r["retrieved_cases"])) for r in triage(tickets, index).collect()}
    assert got == {"where is it": (False, 1), "where is it now": (True, 0), "unknown": (False, 1)}


def test_triage_traces(flow):
    nodes = lambda i: [t["node"] for t in flow[i]["node_traces"]]
    assert nodes(4) == ["intent_classification", "human_in_loop_check", "escalate_to_human"]
    assert nodes(1) == ["intent_classification", "human_in_loop_check", "search_in_db", "decide_similarity", "generate_reply"]
    assert nodes(3)[-1] == "escalate_to_human"
    assert flow[1]["node_traces"][0]["output_summary"] == "Intent: wifi (Confidence: 90.0%, Urgency: low)"


QUEUE = "id string, urgency string, status string, human_response string, created_at timestamp, resolved_at timestamp"


def queue(spark):
    return spark.sql("""
        SELECT * FROM VALUES
          ('a', 'low', 'pending', NULL, TIMESTAMP '2024-01-01 00:00:01', CAST(NULL AS TIMESTAMP)),
          ('b', 'critical', 'pending', NULL, TIMESTAMP '2024-01-01 00:00:03', NULL),
          ('c', 'weird', 'pending', NULL, TIMESTAMP '2024-01-01 00:00:00', NULL),
          ('d', 'critical', 'pending', NULL, TIMESTAMP '2024-01-01 00:00:02', NULL),
          ('e', 'high', 'resolved', 'x', TIMESTAMP '2024-01-01 00:00:00', NULL),
          ('f', 'medium', 'pending', NULL, TIMESTAMP '2024-01-01 00:00:02', NULL)
        AS t(id, urgency, status, human_response, created_at, resolved_at)""")


def test_pending_order(spark):
    assert [r["id"] for r in qu.pending(queue(spark)).collect()] == ["d", "b", "f", "a", "c"]


def test_resolve_takes_the_last_event_whatever_the_status(spark):
    events = spark.sql("""
        SELECT * FROM VALUES ('a', 'one', TIMESTAMP '2024-01-02', 1), ('a', 'two', TIMESTAMP '2024-01-02', 2),
          ('e', 'again', TIMESTAMP '2024-01-03', 1), ('zz', 'lost', TIMESTAMP '2024-01-03', 1)
        AS t(id, human_response, event_ts, seq)""")
    got = {r["id"]: (r["status"], r["human_response"]) for r in qu.resolve(queue(spark), events).collect()}
    assert got["a"] == ("resolved", "two") and got["e"] == ("resolved", "again") and got["b"] == ("pending", None)
    assert [r["id"] for r in qu.unknown_ids(events, queue(spark)).collect()] == ["zz"]


def test_waiting_time(spark):
    df = spark.sql("""SELECT * FROM VALUES (1, TIMESTAMP '2024-01-01 00:00:00.9'), (2, NULL), (3, TIMESTAMP '2025-01-01'),
                      (4, TIMESTAMP '2023-12-31 22:00:00') AS t(id, ts)""")
    as_of = F.lit("2024-01-01 00:01:05.5").cast("timestamp")
    got = [r[0] for r in df.orderBy("id").select(qu.waiting_time(F.col("ts"), as_of)).collect()]
    assert got == ["01:04", "00:00", "00:00", "121:05"]


def test_case_json_round_trip(spark):
    df = spark.createDataFrame([("[{bad",), ("",), (None,), ('[{"case_id": "7", "similarity_score": 0.5}]',)], "j string")
    got = [r[0] for r in df.select(qu.decode_cases(F.col("j"))).collect()]
    assert got[:3] == [[], [], []] and got[3][0]["case_id"] == "7"
    ids = spark.createDataFrame([(["a", "b"],), ([],)], "x array<string>")
    back = [r[0] for r in ids.select(qu.text_to_ids(qu.ids_to_text(F.col("x")))).collect()]
    assert back == [["a", "b"], []]
