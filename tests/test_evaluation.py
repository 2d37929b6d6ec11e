import pytest
from pyspark.sql import functions as F

from ticketloom.operators import evaluation as ev


def pairs(spark, rows):
    return spark.createDataFrame(rows, "truth string, predicted string, row_count bigint")


def test_published_escalation_counts(spark):
    counts = spark.createDataFrame([(28, 8, 8, 31)], "tp bigint, fp bigint, fn bigint, tn bigint")
    row = ev.with_routing_rates(ev.with_binary_scores(counts)).first()
    assert (row["precision"], row["recall"], row["f1"]) == (0.7778, 0.7778, 0.7778)
    assert (row["false_auto_handle_rate"], row["false_escalation_rate"]) == (0.2051, 0.2222)
    second = spark.createDataFrame([(27, 15, 4, 29)], "tp bigint, fp bigint, fn bigint, tn bigint")
    row = ev.with_routing_rates(ev.with_binary_scores(second)).first()
    assert (row["precision"], row["recall"], row["f1"]) == (0.6429, 0.871, 0.7397)
    assert (row["false_auto_handle_rate"], row["false_escalation_rate"], row["automation_rate"]) == (0.1212, 0.3571, 0.44)
    assert row["asymmetric_loss"] == pytest.approx(0.9632, abs=1e-4)


def test_per_class_covers_both_label_sets(spark):
    cells = pairs(spark, [("a", "a", 3), ("a", "b", 1), ("b", "c", 2)])
    got = {r["label"]: r for r in ev.per_class(cells).collect()}
    assert set(got) == {"a", "b", "c"}
    assert (got["a"]["precision"], got["a"]["recall"], got["a"]["support"]) == (1.0, 0.75, 4)
    assert (got["b"]["precision"], got["b"]["recall"], got["b"]["f1"]) == (0.0, 0.0, 0.0)
    assert (got["c"]["precision"], got["c"]["support"]) == (0.0, 0)
    avg = {r["average"]: r for r in ev.averages(ev.per_class(cells)).collect()}
    assert avg["macro avg"]["recall"] == 0.25 and avg["weighted avg"]["recall"] == 0.5
    assert avg["macro avg"]["support"] == 6


def test_empty_inputs(spark):
    empty = spark.createDataFrame([], "intent string, pred_intent string, should_escalate boolean, pred_route string")
    assert ev.accuracy(empty).first()["accuracy"] == 0.0
    assert ev.escalation_scores(empty).first()["f1"] == 0.0
    replies = spark.createDataFrame(
        [], "ticket_id bigint, query string, route string, reply string, top_similarity double, retrieved_cases array<string>")
    assert ev.coverage(replies).first()["groundedness_ratio"] == 0.0
    assert ev.audit_summary(ev.audit_sample(replies)).first()["groundedness_ratio"] == 1.0


def test_audit_flags_promises_and_fills_the_query(spark):
    rows = spark.createDataFrame([
        (1, "", "agent", "We GUARANTEE it", 0.9, ["x"]), (2, "q", "agent", "ok then", 0.9, ["x"]),
        (3, "q", "human", "we guarantee", 0.9, ["x"]), (4, "q", "agent", "guarantee", 0.9, []),
    ], "ticket_id bigint, query string, route string, reply string, top_similarity double, retrieved_cases array<string>")
    golden = spark.createDataFrame([(1, "from golden")], "ticket_id bigint, ticket_text string")
    got = {r["ticket_id"]: r for r in ev.audit_sample(rows, golden).collect()}
    assert set(got) == {1, 2} and got[1]["is_grounded"] is False and got[1]["query"] == "from golden"
    assert ev.audit_summary(ev.audit_sample(rows, golden)).first()["groundedness_ratio"] == 0.5


def test_operational_accuracy(spark):
    df = spark.createDataFrame([
        ("device_technical_issue_general", "hardware_failure_specific"),
        ("billing_and_refund_dispute", "data_loss_recovery"),
        ("other", "device_wifi_connectivity"), ("other", "other"),
    ], "intent string, pred_intent string")
    row = ev.operational_accuracy(df).first()
    assert (row["exact"], row["same_action"], row["operational_accuracy"]) == (1, 3, 0.75)


def test_threshold_sweep_is_monotone(spark):
    df = spark.createDataFrame([(i % 2 == 0, False, i / 10) for i in range(10)],
                               "should_escalate boolean, pred_other_rules boolean, pred_confidence double")
    rows = ev.threshold_sweep(df).orderBy("threshold").collect()
    assert [r["tp"] + r["fp"] for r in rows] == [5, 6, 7]


def test_golden_set_reports_missing_tickets(spark):
    spec = spark.createDataFrame([(1, "a", "high", "r", True), (9, "a", "low", "r", False)],
                                 "ticket_id bigint, intent string, urgency string, urgency_reason string, should_escalate boolean")
    t = spark.createDataFrame([(1, "text", "TV", "Low", "t", "s")],
                              "ticket_id bigint, ticket_text string, product string, ticket_priority string, ticket_type string, ticket_subject string")
    golden, missing = ev.golden_set(spec, t)
    row = golden.first()
    assert row["raw_priority"] == "Low" and row["annotator"] == "human_expert_review" and golden.count() == 1
    assert [r["ticket_id"] for r in missing.collect()] == [9]
    assert ev.golden_counts(golden).first()["urgent"] == 1
    assert ev.disagreements(ev.align(golden, spark.createDataFrame(
        [(1, "critical", None)], "ticket_id bigint, urgency string, urgency_reason string"))).count() == 1


def test_latency_is_the_exact_percentile(spark):
    df = spark.range(1, 101).select(F.lit("x").alias("g"), F.col("id").cast("double").alias("v"))
    assert ev.latency(df, "g", "v").first()["p95"] == pytest.approx(95.05)
    many = spark.range(30_000).select(
        F.when(F.col("id") % 3 > 0, "hot").alias("g"), (F.pmod(F.xxhash64("id"), F.lit(100_003)) / 7).alias("v"))
    want = {r["g"]: r["p"] for r in many.groupBy("g").agg(F.round(F.percentile("v", F.lit(0.95)), 4).alias("p")).collect()}
    assert {r["g"]: r["p95"] for r in ev.latency(many, "g", "v").collect()} == want
