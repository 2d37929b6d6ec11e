import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from ticketloom.config import TriageConfig
from ticketloom.plans.corpus import build_corpus
from ticketloom.plans.triage import triage
from ticketloom.session import scratch_dir
from ticketloom.sources.tables import taxonomy_table


def raw(spark, n=60):
    words = F.element_at(F.array(*[F.lit(w) for w in ("wifi router", "battery charger", "login password")]),
                         (F.col("id") % 3 + 1).cast("int"))
    return spark.range(n).select(
        F.col("id").alias("ticket_id"),
        F.concat(words, F.lit(" problem number "), F.col("id").cast("string")).alias("ticket_description"),
        F.lit("TV").alias("product_purchased"), F.lit("t").alias("ticket_type"), F.lit("s").alias("ticket_subject"),
        F.lit("Low").alias("ticket_priority"), F.lit("Closed").alias("ticket_status"),
        F.concat(F.lit("fixed "), words).alias("resolution"), F.timestamp_seconds(F.col("id")).alias("created_at"))


def test_corpus_builds_resumes_and_feeds_triage(spark):
    root, cfg = scratch_dir(spark, "corpus"), TriageConfig(min_solved_rows=50)
    holdout = spark.range(5).select(F.col("id").alias("ticket_id"))
    first = build_corpus(raw(spark), root, taxonomy_table(spark), holdout=holdout, clusters=3, cfg=cfg)
    assert (first.clean.count(), first.labelled.count(), first.index.count()) == (60, 60, 55)
    # The stages are there: other input changes nothing.
    again = build_corpus(raw(spark, 3), root, taxonomy_table(spark), holdout=holdout, clusters=3, cfg=cfg)
    assert again.index.count() == 55
    tickets = first.labelled.where("ticket_id < 5").select(
        "ticket_id", F.col("ticket_text").alias("query"), F.lit("other").alias("intent"), F.lit(0.9).alias("confidence"),
        F.lit("neutral").alias("sentiment"), F.lit("low").alias("urgency"), F.lit("r").alias("urgency_reason"),
        F.lit(False).alias("is_high_risk"), "embedding")
    out = triage(tickets, first.index).collect()
    assert len(out) == 5 and all(len(r["retrieved_cases"]) == 5 for r in out)


def test_corpus_fails_below_the_gate(spark):
    with pytest.raises(PySparkException):
        build_corpus(raw(spark), scratch_dir(spark, "corpus"), taxonomy_table(spark), clusters=3)
