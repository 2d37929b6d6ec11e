"""Scores of predicted labels and routes against a golden set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketloom import constants as K
from ticketloom.functions import text as tx
from ticketloom.operators import routing as rt


def golden_set(spec: DataFrame, tickets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(golden rows, spec ids without a ticket). Spec: id, intent, urgency, reason, escalate."""
    fields = tickets.select(
        "ticket_id", "ticket_text", "product",
        F.col("ticket_priority").alias("ticket_raw_priority"),
        F.col("ticket_type").alias("raw_type"), F.col("ticket_subject").alias("raw_subject"))
    golden = spec.join(fields, "ticket_id")
    if "raw_priority" not in spec.columns:
        golden = golden.withColumn("raw_priority", F.col("ticket_raw_priority"))
    golden = golden.drop("ticket_raw_priority").withColumn("annotator", F.lit("human_expert_review"))
    return golden, spec.join(tickets.select("ticket_id"), "ticket_id", "left_anti")


def is_urgent(level: Column) -> Column:
    return F.coalesce(F.lower(level).isin(*K.URGENT_LEVELS), F.lit(False))


def golden_counts(golden: DataFrame, wanted_urgent: int = 25) -> DataFrame:
    urgent = F.count_if(is_urgent(F.col("urgency")))
    return golden.agg(
        F.count(F.lit(1)).alias("total"), urgent.alias("urgent"),
        (urgent >= wanted_urgent).alias("enough_urgent"))


def align(golden: DataFrame, predictions: DataFrame) -> DataFrame:
    """Golden rows with their prediction's columns under ``pred_``; inner by ticket id."""
    renamed = predictions.select(
        "ticket_id", *[F.col(c).alias(f"pred_{c}") for c in predictions.columns if c != "ticket_id"])
    return golden.join(renamed, "ticket_id")


def unpredicted(golden: DataFrame, predictions: DataFrame) -> DataFrame:
    return golden.join(predictions.select("ticket_id"), "ticket_id", "left_anti")


def rate(hits: Column, total: Column) -> Column:
    """Share of two counts; 0 when there is nothing to divide by."""
    return F.coalesce(F.try_divide(hits.cast("double"), total.cast("double")), F.lit(0.0))


def accuracy(aligned: DataFrame, truth: str = "intent", pred: str = "pred_intent") -> DataFrame:
    right = F.count_if(F.col(truth) == F.col(pred))
    return aligned.agg(
        F.count(F.lit(1)).alias("total"), F.round(rate(right, F.count(F.lit(1))), 4).alias("accuracy"))


def confusion(aligned: DataFrame, truth: str = "intent", pred: str = "pred_intent") -> DataFrame:
    """(truth, predicted, row_count); everything below reads only these few rows."""
    return aligned.groupBy(F.col(truth).alias("truth"), F.col(pred).alias("predicted")).agg(
        F.count(F.lit(1)).alias("row_count"))


def per_class(cells: DataFrame) -> DataFrame:
    """Precision, recall, F1, support per label, over the union of both label sets."""
    # Each cell counts towards its true and its predicted label: one pass, no outer join.
    n, same = F.col("row_count"), F.col("truth") == F.col("predicted")
    zero = F.lit(0).cast("bigint")
    sides = F.array(
        F.struct(F.col("truth").alias("label"), n.alias("support"), zero.alias("predicted_n"),
                 F.when(same, n).otherwise(zero).alias("hits")),
        F.struct(F.col("predicted").alias("label"), zero.alias("support"), n.alias("predicted_n"),
                 zero.alias("hits")),
    )
    label = cells.select(F.inline(sides)).groupBy("label").agg(
        F.sum("support").alias("support"), F.sum("predicted_n").alias("predicted_n"), F.sum("hits").alias("hits"))
    p, r = rate(F.col("hits"), F.col("predicted_n")), rate(F.col("hits"), F.col("support"))
    f1 = rate(2 * F.col("hits"), F.col("predicted_n") + F.col("support"))
    return label.select("label", p.alias("precision"), r.alias("recall"), f1.alias("f1"), "support")


def averages(classes: DataFrame) -> DataFrame:
    """Macro and support-weighted averages of the per-class scores."""
    total = F.sum("support")
    macro = classes.agg(*[F.round(F.avg(c), 6).alias(c) for c in ("precision", "recall", "f1")], total.alias("support"))
    weighted = classes.agg(
        *[F.round(F.try_divide(F.sum(F.col(c) * F.col("support")), total), 6).alias(c) for c in ("precision", "recall", "f1")],
        total.alias("support"))
    return macro.select(F.lit("macro avg").alias("average"), "*").unionByName(
        weighted.select(F.lit("weighted avg").alias("average"), "*"))


def binary_counts(truth: Column, pred: Column) -> list[Column]:
    return [
        F.count_if(truth & pred).alias("tp"), F.count_if(~truth & pred).alias("fp"),
        F.count_if(truth & ~pred).alias("fn"), F.count_if(~truth & ~pred).alias("tn"),
    ]


def with_binary_scores(counts: DataFrame) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.withColumns({
        "precision": F.round(rate(tp, tp + fp), 4),
        "recall": F.round(rate(tp, tp + fn), 4),
        "f1": F.round(rate(2 * tp, 2 * tp + fp + fn), 4),
    })


def binary(aligned: DataFrame, truth: Column, pred: Column) -> DataFrame:
    """tp, fp, fn, tn and precision, recall, F1 in one pass."""
    return with_binary_scores(aligned.agg(*binary_counts(truth, pred)))


def urgency_scores(aligned: DataFrame, pred: str = "pred_urgency") -> DataFrame:
    return binary(aligned, is_urgent(F.col("urgency")), is_urgent(F.col(pred)))


def escalation_scores(aligned: DataFrame) -> DataFrame:
    return binary(aligned, wants_human(), routed_human())


def wants_human() -> Column:
    return F.coalesce("should_escalate", F.lit(False))


def routed_human() -> Column:
    return F.coalesce(F.col("pred_route") == "human", F.lit(False))


def disagreements(aligned: DataFrame) -> DataFrame:
    """Rows whose raw priority and predicted urgency differ in being urgent."""
    raw = F.lower(F.coalesce("raw_priority", F.lit("unknown")))
    return aligned.where(is_urgent(raw) != is_urgent(F.col("pred_urgency"))).select(
        "ticket_id", F.col("ticket_text").alias("query"), F.col("urgency").alias("golden_urgency"),
        F.lower("pred_urgency").alias("predicted_urgency"),
        F.coalesce("pred_urgency_reason", F.lit("")).alias("reason"), raw.alias("raw_priority"))


def first_disagreements(aligned: DataFrame, n: int = 5) -> DataFrame:
    """The sample the report shows: the first rows in golden order."""
    return disagreements(aligned).orderBy("ticket_id").limit(n)


def coverage(replies: DataFrame) -> DataFrame:
    """A reply counts as grounded with at least one case and more than ten characters."""
    grounded = (F.size("retrieved_cases") > 0) & (F.length("reply") > 10)
    return replies.agg(
        F.count(F.lit(1)).alias("total_audited"), F.count_if(grounded).alias("grounded_count"),
        F.round(rate(F.count_if(grounded), F.count(F.lit(1))), 4).alias("groundedness_ratio"))


def audit_sample(predictions: DataFrame, golden: DataFrame | None = None, n: int = 20) -> DataFrame:
    """The first n agent replies with cases, each checked for outside promises."""
    rows = predictions.where((F.col("route") == "agent") & (F.size("retrieved_cases") > 0))
    first = rows.orderBy("ticket_id").limit(n)
    query = F.nullif(F.col("query"), F.lit(""))
    if golden is not None:
        first = first.join(golden.select("ticket_id", F.col("ticket_text").alias("__text")), "ticket_id", "left")
        query = F.coalesce(query, F.col("__text"))
    promise = tx.contains_any(F.lower("reply"), K.PROMISE_TERMS)
    return first.select(
        "ticket_id", tx.truncate(F.coalesce(query, F.lit("")), 120).alias("query"),
        tx.truncate(F.col("reply"), 150).alias("reply_snippet"),
        F.size("retrieved_cases").cast("bigint").alias("retrieved_count"), "top_similarity",
        (~promise).alias("is_grounded"),
        F.when(promise, K.NOTE_PROMISE).otherwise(K.NOTE_GROUNDED).alias("audit_notes"))


def audit_summary(findings: DataFrame) -> DataFrame:
    """Totals of the audit; an empty audit counts as fully grounded."""
    total, good = F.count(F.lit(1)), F.count_if("is_grounded")
    ratio = F.when(total == 0, F.lit(1.0)).otherwise(rate(good, total))
    return findings.agg(
        total.alias("total_audited"), good.alias("grounded_count"),
        F.count_if(~F.col("is_grounded")).alias("hallucination_count"), F.round(ratio, 4).alias("groundedness_ratio"))


def leakage(golden: DataFrame, index: DataFrame) -> DataFrame:
    """Golden tickets that the index holds, by id and by text."""
    ids = index.select(F.col("case_id").try_cast("bigint").alias("ticket_id")).where("ticket_id is not null").distinct()
    digests = index.select(F.sha2("document", 256).alias("d")).distinct()
    by_id = golden.join(ids, "ticket_id", "left_semi")
    by_text = golden.withColumn("d", F.sha2("ticket_text", 256)).join(digests, "d", "left_semi")
    return golden.agg(F.count(F.lit(1)).alias("golden_rows")).select(
        "golden_rows", by_id.agg(F.count(F.lit(1))).scalar().alias("leaked_ids"),
        by_text.agg(F.count(F.lit(1))).scalar().alias("leaked_texts"))


# Fixed grouping: labels of one group lead to the same action. All high-risk labels go to a
# human; the three general fault labels share the troubleshooting answer.
TROUBLESHOOTING = (
    "device_technical_issue_general", "product_technical_issue_general", "hardware_failure_specific",
)


def action_group(label: Column) -> Column:
    high = [name for name, risk, _ in K.TAXONOMY if risk == "high"]
    return F.when(label.isin(*high), "human").when(label.isin(*TROUBLESHOOTING), "troubleshooting").otherwise(label)


def operational_accuracy(aligned: DataFrame) -> DataFrame:
    exact = F.col("intent") == F.col("pred_intent")
    same = exact | (action_group(F.col("intent")) == action_group(F.col("pred_intent")))
    total = F.count(F.lit(1))
    return aligned.agg(
        total.alias("total"), F.count_if(exact).alias("exact"), F.count_if(same).alias("same_action"),
        F.round(rate(F.count_if(same), total), 4).alias("operational_accuracy"))


def with_routing_rates(counts: DataFrame, miss_cost: float = 5.0) -> DataFrame:
    """False auto-handle, false escalation and automation rate, and their weighted loss."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    far, fer = rate(fn, fn + tn), rate(fp, tp + fp)
    return counts.withColumns({
        "false_auto_handle_rate": F.round(far, 4),
        "false_escalation_rate": F.round(fer, 4),
        "automation_rate": F.round(rate(fn + tn, tp + fp + fn + tn), 4),
        "asymmetric_loss": F.round(miss_cost * far + fer, 4),
    })


def routing_rates(aligned: DataFrame) -> DataFrame:
    return with_routing_rates(aligned.agg(*binary_counts(wants_human(), routed_human())))


def threshold_sweep(aligned: DataFrame, thresholds=(0.50, 0.60, 0.70)) -> DataFrame:
    """Gate outcome per confidence threshold, all thresholds in one pass.

    ``aligned`` carries pred_other_rules (rules one to three) and pred_confidence.
    """
    values = F.array(*[F.lit(float(t)) for t in thresholds])
    rows = aligned.select(wants_human().alias("t"), "pred_other_rules", "pred_confidence",
                          F.explode(values).alias("threshold"))
    pred = F.col("pred_other_rules") | (F.col("pred_confidence") < F.col("threshold"))
    counts = rows.groupBy("threshold").agg(*binary_counts(F.col("t"), pred))
    return with_routing_rates(with_binary_scores(counts))


def trivial_baselines(aligned: DataFrame) -> DataFrame:
    """Majority intent, always escalate, never urgent."""
    top = aligned.groupBy("intent").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).scalar()
    total = F.count(F.lit(1))
    human, urgent = F.count_if(wants_human()), F.count_if(is_urgent(F.col("urgency")))
    one = aligned.agg(total.alias("total"), human.alias("human"), urgent.alias("urgent"))
    always = rate(2 * F.col("human"), F.col("human") + F.col("total"))
    return one.select(
        "total", F.round(rate(top, F.col("total")), 4).alias("majority_accuracy"),
        F.round(always, 4).alias("always_escalate_f1"), F.lit(0.0).alias("never_urgent_f1"))


def latency(traces: DataFrame, group: str, value: str, share: float = 0.95, band: float = 0.002) -> DataFrame:
    """Exact percentile per group, interpolated between the two rows around it.

    A sketch gives bounds a little below and above the share; the rows under the lower bound
    are only counted, and the distinct values between the bounds are ranked with their
    counts. No group is gathered whole.
    """
    rows = traces.select(F.col(group).alias("g"), F.col(value).alias("v"))
    around = F.percentile_approx("v", [max(0.0, share - band), min(1.0, share + band)], 10_000)
    bounds = rows.groupBy("g").agg(
        F.count(F.lit(1)).alias("row_count"), F.count("v").alias("n"), around.alias("b"))
    met = rows.where(F.col("v").isNotNull()).join(bounds.withColumnRenamed("g", "h"), F.col("g").eqNullSafe(F.col("h")))
    place = F.when(F.col("v") >= F.col("b")[0], F.col("v"))
    seen = met.where(F.col("v") <= F.col("b")[1]).groupBy("g", "n", place.alias("v")).agg(F.count(F.lit(1)).alias("c"))
    upto = seen.withColumn("upto", F.sum("c").over(
        Window.partitionBy("g").orderBy(F.col("v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)))
    at = (F.col("n") - 1) * share
    low = F.min(F.when(F.col("upto") > F.floor(at), F.col("v")))
    high = F.min(F.when(F.col("upto") > F.ceil(at), F.col("v")))
    found = upto.groupBy(F.col("g").alias("h")).agg((low + (high - low) * F.max(at - F.floor(at))).alias("p95"))
    return bounds.join(found, F.col("g").eqNullSafe(F.col("h")), "left").select(
        F.col("g").alias(group), "row_count", F.round("p95", 4).alias("p95"))


def other_rules() -> Column:
    """Rules one to three of the gate as one flag."""
    return rt.rule_high_risk() | rt.rule_urgent() | rt.rule_repeat()
