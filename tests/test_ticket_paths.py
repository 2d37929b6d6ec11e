"""What the ticket queries store and move: figures that must follow the rows they need."""

import os

import pytest
from pyspark.sql import functions as F

from ticketloom.catalog import evaluation, routing, streams
from ticketloom.operators import clustering as cl
from ticketloom.session import scratch_dir, scratch_scope
from ticketloom.sources import fixtures as fx
from ticketloom.sources import tables as tb

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


def stored_in(folder, name):
    folder = folder.removeprefix("file:")
    return [f"{folder}/{f}" for f in (os.listdir(folder) if os.path.isdir(folder) else []) if f.startswith(f"{name}-")]


def test_a_text_moves_once_to_become_a_ticket(spark):
    """Without broadcasts, only the shuffle by ticket id (and the spread of a small scan) carries texts."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        raw = fx.tickets_raw(spark, SF)
        joins = [line for line in raw._jdf.queryExecution().sparkPlan().toString().split("\n") if "SortMergeJoin" in line]
        keys = [line.split("SortMergeJoin ")[1].split("]")[0] for line in joins]
        # Outermost first: benchmark, then ids; products and orders meet below, among short columns.
        assert "item_no" in keys[0] and keys[1].startswith("[doc_id") and len(keys) == 5, keys
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_pending_positions_are_numbered_without_texts(spark):
    with scratch_scope(spark, "pending-test") as folder:
        routing.q1_pending(spark, SF).collect()
        found = stored_in(folder, "unnumbered") + stored_in(folder, "ordinal")
        assert len(found) == 2
        for path in found:
            assert not {"customer_query", "retrieved_cases_json"} & set(spark.read.parquet(path).columns)


def test_metrics_clean_the_tickets_once(spark):
    with scratch_scope(spark, "metrics-test") as folder:
        routing.q7_metrics(spark, SF).collect()
        assert len(stored_in(folder, "tickets")) == 1


def test_streams_have_as_many_files_as_partitions(spark):
    with scratch_scope(spark, "files-test"):
        stream = streams.as_stream(spark, spark.range(0, 1000, 1, 12), "many-files", 2)
        done, path = [], scratch_dir(spark, "state")
        (stream.writeStream.foreachBatch(lambda b, n: done.append((b.rdd.getNumPartitions(), b.count())))
            .option("checkpointLocation", path).trigger(availableNow=True).start().awaitTermination())
        assert len(done) == 2 and sum(n for _, n in done) == 1000
        [files] = stored_in(os.path.dirname(path), "many-files")
        assert len(tb.read_table(spark, files).inputFiles()) == 12


def test_sweep_has_no_more_tasks_than_twice_the_cores(spark, monkeypatch):
    seen = []
    real = cl.fit_kmeans
    monkeypatch.setattr(cl, "fit_kmeans", lambda f, k, seed, tries: seen.append(f.rdd.getNumPartitions()) or real(f, k, seed, 1))
    df = spark.range(0, 200, 1, 64).select(F.array(F.sin("id"), F.cos("id"), F.lit(0.5)).alias("embedding"))
    out = cl.sweep_k(df, candidates=(2, 3)).collect()
    assert len(out) == 2 and max(seen) <= 2 * spark.sparkContext.defaultParallelism


def test_scores_take_golden_and_predictions_from_one_cleaning(spark, monkeypatch):
    def again(*_):
        raise AssertionError("the tickets are cleaned a second time")

    monkeypatch.setattr(evaluation, "clean_tickets", again)
    for query in (evaluation.e3_align, evaluation.e13_audit_findings, evaluation.e20_threshold_sweep):
        assert query(spark, SF).count() > 0


def test_queue_hands_the_vectors_of_its_tickets_on(spark):
    vectors = {str(r["ticket_id"]): r["embedding"] for r in fx.ticket_vectors(spark, SF).collect()}
    rows = routing.queue(spark, SF, extra=("embedding",)).collect()
    assert rows and all(r["embedding"] == vectors[r["ticket_id"]] for r in rows)
