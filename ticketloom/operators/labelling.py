"""Intent labels: cluster map, confidence, keyword overrides, batches, external labellers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ticketloom import constants as K
from ticketloom.config import TriageConfig
from ticketloom.functions import text as tx
from ticketloom.functions import vectors as vx
from ticketloom.operators.blocks import small_side
from ticketloom.session import materialise


def cluster_map(taxonomy: DataFrame) -> DataFrame:
    return taxonomy.select(F.explode("source_cluster_ids").alias("cluster_id"), F.col("name").alias("intent"))


def intent_of_cluster(df: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Cluster -> intent; ``other`` where the taxonomy has no such cluster."""
    mapped = df.join(small_side(cluster_map(taxonomy)), "cluster_id", "left")
    return mapped.withColumn("intent", F.coalesce("intent", F.lit(K.OTHER_INTENT)))


def centroid_confidence(vector: Column, centroid: Column) -> Column:
    """Half plus half the product with the own centroid, held in 0.50..0.98.

    The centroid is taken as it is, not scaled to unit length.
    """
    return F.least(F.lit(0.98), F.greatest(F.lit(0.50), 0.5 + 0.5 * vx.dot(vector, centroid)))


def keyword_rules() -> list[tuple[tuple[str, ...], str, float]]:
    return [
        (K.REFUND_TERMS, K.REFUND_INTENT, K.REFUND_CONFIDENCE),
        (K.CANCEL_TERMS, K.CANCEL_INTENT, K.CANCEL_CONFIDENCE),
    ]


def override(text: Column, intent: Column, confidence: Column) -> tuple[Column, Column]:
    """Keyword rules in order, first match wins; else the given label."""
    folded = F.lower(text)
    label = score = None
    for terms, name, value in keyword_rules():
        hit = tx.contains_any(folded, terms)
        label = F.when(hit, F.lit(name)) if label is None else label.when(hit, F.lit(name))
        score = F.when(hit, F.lit(value)) if score is None else score.when(hit, F.lit(value))
    return label.otherwise(intent), score.otherwise(confidence)


def label_by_cluster(tickets: DataFrame, taxonomy: DataFrame, centroids: DataFrame) -> DataFrame:
    """Tickets with cluster_id and unit vector -> assigned_intent, intent_confidence."""
    known = intent_of_cluster(tickets, taxonomy).join(small_side(centroids), "cluster_id", "left")
    confidence = centroid_confidence(F.col("embedding"), F.col("centroid"))
    intent, score = override(F.col("ticket_text"), F.col("intent"), confidence)
    return known.withColumns({
        "assigned_intent": intent, "intent_confidence": F.round(score, 3)
    }).drop("intent", "centroid")


def ordinal(df: DataFrame, *order: Column | str, rows_per_task: int = 100_000) -> DataFrame:
    """Global 0-based position in the given order, without sorting in one task.

    Rows are dealt by ranges of the order, as many as the row count asks for, sorted and
    numbered inside a range, and shifted by the rows of the ranges before; only one count per
    range goes through one task. The numbered rows are stored, so a task that runs again
    places its rows alike. ``order`` should end in a unique key. Reads its input three times
    (count, range bounds, rows): give it a stored table.
    """
    ranges = max(1, -(-df.count() // rows_per_task))
    dealt = df.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    numbered = materialise(dealt.withColumn("__at", F.monotonically_increasing_id()), "ordinal")
    # The id holds the range in its high bits and the place in the range in the low 33.
    numbered = numbered.withColumns({
        "__range": F.shiftright("__at", 33), "__inside": F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))})
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = numbered.groupBy("__range").agg(F.count(F.lit(1)).alias("__n")).select(
        "__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__shift"))
    return numbered.join(shifts, "__range").withColumn(
        "position", F.col("__shift") + F.col("__inside")).drop("__at", "__range", "__inside", "__shift")


def micro_batches(df: DataFrame, key: str = "ticket_id", cfg: TriageConfig = TriageConfig()) -> DataFrame:
    """Batches of 25 rows in key order, and groups of 20 batches."""
    batch = F.floor(F.col("position") / cfg.label_batch_rows)
    return ordinal(df, key).withColumn("batch_id", batch).withColumn(
        "batch_group", F.floor(F.col("batch_id") / cfg.label_group_batches)).drop("position")


def taxonomy_lines(taxonomy: DataFrame, with_risk: bool = False) -> DataFrame:
    """One row: the taxonomy as prompt lines, in name order."""
    line = F.concat(F.lit("- "), "name", F.lit(": "), "definition")
    if with_risk:
        line = F.concat(line, F.lit(" (Risk level: "), F.coalesce("risk_level", F.lit("low")), F.lit(")"))
    entries = F.sort_array(F.collect_list(F.struct("name", line.alias("line"))))
    return taxonomy.agg(F.array_join(F.transform(entries, lambda e: e["line"]), "\n").alias("tax_summary"))


def batch_payloads(batched: DataFrame, text_chars: int | None = None) -> DataFrame:
    """One row per batch: its tickets as a JSON array (25 rows at most).

    ``text_chars`` cuts each text for a labeller that takes no more; by default it is whole.
    """
    text = F.col("ticket_text")
    item = F.struct("ticket_id", (tx.truncate(text, text_chars) if text_chars else text).alias("ticket_text"))
    return batched.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("batch_rows"),
        F.to_json(F.sort_array(F.collect_list(item))).alias("payload"),
    )


Labeller = Callable[[pd.DataFrame], pd.DataFrame]
#: Mark of rows that a labeller's answer left out.
UNANSWERED = "not in the answer"


def keyword_labeller(batch: pd.DataFrame) -> pd.DataFrame:
    """Offline labeller: the keyword rules, else ``other`` with 0.5."""
    folded = batch["ticket_text"].str.lower()
    out = pd.DataFrame({"ticket_id": batch["ticket_id"], "intent": K.OTHER_INTENT, "confidence": 0.5})
    for terms, name, value in reversed(keyword_rules()):
        hit = pd.Series(False, index=folded.index)
        for term in terms:
            hit |= folded.str.contains(term, regex=False)
        out.loc[hit, "intent"] = name
        out.loc[hit, "confidence"] = value
    return out


def centroid_labeller(centroids: DataFrame, taxonomy: DataFrame) -> Labeller:
    """Offline labeller for batches with ``embedding``: keyword rules, else the intent of the nearest centroid.

    The confidence is that of ``centroid_confidence``. Centroids and their intents are taken
    along by every task, so they must be few (``clustering.MAX_CENTROIDS``).
    """
    from ticketloom.operators.clustering import centroid_matrix

    ids, matrix = centroid_matrix(centroids)
    named = small_side(cluster_map(taxonomy).join(centroids.select("cluster_id").distinct(), "cluster_id"))
    intents = {r["cluster_id"]: r["intent"] for r in named.collect()}
    names = np.array([intents.get(i, K.OTHER_INTENT) for i in ids.tolist()], dtype=object)

    def label(batch: pd.DataFrame) -> pd.DataFrame:
        out = keyword_labeller(batch)
        rest = (out["intent"] == K.OTHER_INTENT).to_numpy()
        if rest.any():
            m = np.array(batch["embedding"][rest].tolist(), dtype="float64")
            near = np.argmin((matrix * matrix).sum(1)[None, :] - 2.0 * (m @ matrix.T), axis=1)
            own = (m * matrix[near]).sum(axis=1)
            out.loc[rest, "intent"] = names[near]
            out.loc[rest, "confidence"] = np.clip(0.5 + 0.5 * own, 0.50, 0.98)
        return out

    return label


def label_externally(
    tickets: DataFrame, labeller: Labeller = keyword_labeller, batch_rows: int = 25, tries: int = 3,
    columns: tuple[str, ...] = ("ticket_id", "ticket_text"), with_failures: bool = False,
) -> DataFrame:
    """Run a labeller over batches of ``columns`` inside the tasks.

    A batch that fails ``tries`` times is labelled ``other`` with 0.5; an answer for part of
    a batch is taken as it is. ``with_failures`` adds a column ``failure``: the error of the last
    try on rows that were not labelled, so that an outage does not look like a label, and rows
    that the answer left out. Concurrency is the number of partitions.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for at in range(0, len(part), batch_rows):
                found = attempt(part.iloc[at : at + batch_rows].reset_index(drop=True))
                yield found if with_failures else found[found["failure"] != UNANSWERED].drop(columns="failure")

    def unlabelled(ids: pd.Series, reason: str) -> pd.DataFrame:
        return pd.DataFrame({"ticket_id": ids, "intent": K.OTHER_INTENT, "confidence": 0.5, "failure": reason})

    def attempt(batch: pd.DataFrame) -> pd.DataFrame:
        reason = "empty answer"
        for _ in range(tries):
            try:
                answer = labeller(batch)
                if len(answer):
                    answer = answer[["ticket_id", "intent", "confidence"]].astype({"intent": object}).assign(failure=None)
                    left_out = batch.loc[~batch["ticket_id"].isin(answer["ticket_id"]), "ticket_id"]
                    return pd.concat([answer, unlabelled(left_out, UNANSWERED)]) if len(left_out) else answer
                reason = "empty answer"
            except Exception as e:  # noqa: BLE001 - any failure of a plug-in means another try
                reason = f"{type(e).__name__}: {e}"[:200]
        return unlabelled(batch["ticket_id"], reason)

    schema = "ticket_id bigint, intent string, confidence double" + (", failure string" if with_failures else "")
    return tickets.select(*columns).mapInPandas(run, schema)


def label_failures(results: DataFrame) -> DataFrame:
    """(failure, row_count) of labelled rows ``with_failures``: null counts what was labelled."""
    return results.groupBy("failure").agg(F.count(F.lit(1)).alias("row_count"))


def fold_labels(tickets: DataFrame, results: DataFrame) -> DataFrame:
    """Last result per ticket (by seq) joined back; ``other`` / 0.5 where there is none."""
    last = results.groupBy("ticket_id").agg(F.max(F.struct("seq", "intent", "confidence")).alias("r"))
    joined = tickets.join(last, "ticket_id", "left")
    return joined.withColumns({
        "assigned_intent": F.coalesce("r.intent", F.lit(K.OTHER_INTENT)),
        "intent_confidence": F.coalesce("r.confidence", F.lit(0.5)),
    }).drop("r")


def encode_by_count(df: DataFrame, column: str) -> DataFrame:
    """Label codes by falling frequency, ties by name; no list of labels on the driver."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("__n"))
    return _with_codes(df, counts, column, F.desc("__n"), F.col(column))


def encode_by_appearance(df: DataFrame, column: str, order: str) -> DataFrame:
    """Label codes in order of first appearance."""
    firsts = df.groupBy(column).agg(F.min(order).alias("__first"))
    return _with_codes(df, firsts, column, F.col("__first"), F.col(column))


def _with_codes(df: DataFrame, labels: DataFrame, column: str, *order: Column) -> DataFrame:
    codes = ordinal(materialise(labels, "labels"), *order).select(column, F.col("position").cast("bigint").alias("code"))
    return df.join(codes, column)


# --- rule classifier -------------------------------------------------------------------
# Words for the written urgency criteria, most urgent first.
URGENCY_TERMS = (
    ("critical", ("outage", "security breach", "fraud", "data loss", "lost all", "legal", "lawsuit")),
    ("high", ("unable to access", "locked", "deadline", "charged twice", "payment error", "cancel my order")),
    ("medium", ("crash", "bug", "delay", "replacement", "return", "error", "issue")),
)


def classify_by_rules(df: DataFrame, text: str = "query") -> DataFrame:
    """Intent, confidence, sentiment, urgency, reason and risk from keywords alone."""
    folded = F.lower(F.col(text))
    intent, confidence = override(F.col(text), F.lit(K.OTHER_INTENT), F.lit(0.5))
    urgency = reason = None
    for level, terms in URGENCY_TERMS:
        hit = tx.contains_any(folded, terms)
        said = F.lit(f"{level} wording")
        urgency = F.when(hit, level) if urgency is None else urgency.when(hit, level)
        reason = F.when(hit, said) if reason is None else reason.when(hit, said)
    repeat = tx.contains_any(folded, K.REPEAT_TERMS)
    return df.withColumns({
        "intent": intent,
        "confidence": confidence,
        "sentiment": F.when(repeat, "strongly_negative").otherwise("neutral"),
        "urgency": urgency.otherwise("low"),
        "urgency_reason": reason.otherwise("Standard classification"),
        "is_high_risk": intent.isin(*high_risk_names()),
    })


def high_risk_names() -> list[str]:
    return [name for name, risk, _ in K.TAXONOMY if risk == "high"]


def risk_flag(df: DataFrame, taxonomy: DataFrame, risk_source: str = "either") -> DataFrame:
    """``is_high_risk`` from the model, from the taxonomy, or from either."""
    levels = small_side(taxonomy.select(F.col("name").alias("intent"), (F.col("risk_level") == "high").alias("__high")))
    joined = df.join(levels, "intent", "left")
    listed = F.coalesce("__high", F.lit(False))
    said = F.coalesce("is_high_risk", F.lit(False))
    flag = {"model": said, "taxonomy": listed, "either": said | listed}[risk_source]
    return joined.withColumn("is_high_risk", flag).drop("__high")
