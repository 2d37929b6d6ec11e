import datetime

import numpy as np
from pyspark.sql import functions as F

from ticketloom.operators import index as ix
from ticketloom.session import scratch_dir
from ticketloom.sources.logs import IndexLog, read_batches, write_batch
from ticketloom.streaming import flows

from tests.test_hygiene import raw
from tests.test_search import DIM, make_index, unit


def stored(spark, df, name, files=2):
    path = scratch_dir(spark, name)
    df.repartition(files).write.parquet(path)
    return path


def test_gate_stream_equals_batch(spark):
    df = raw(spark)
    stream = flows.read_stream(spark, stored(spark, df, "raw", 3), df.schema, max_files=1)
    out = scratch_dir(spark, "out")
    flows.append_to(flows.gate_stream(stream), out, scratch_dir(spark, "state")).awaitTermination()
    key = lambda rows: sorted((r["ticket_id"], r["query"], r["escalate_to_human"]) for r in rows)
    assert key(spark.read.parquet(out).collect()) == key(flows.gate_stream(df).collect())


def test_replayed_batch_replaces_its_rows(spark):
    path = scratch_dir(spark, "log")
    write_batch(spark.range(3), path, 0)
    write_batch(spark.range(5), path, 1)
    write_batch(spark.range(4), path, 1)
    assert read_batches(spark, path).groupBy("batch_id").count().orderBy("batch_id").collect() == [(0, 3), (1, 4)]


def feedback_rows(spark, vectors):
    rows = [(i, f"query number {i}", "reply", "a", "low", 0.9, vectors[i].tolist(), i % 4 != 0) for i in range(len(vectors))]
    return spark.createDataFrame(
        rows, "ticket_id bigint, query string, reply string, intent string, urgency string, confidence double, "
              "embedding array<double>, feedback_is_okay boolean").withColumns({
                  "feedback_notes": F.lit(""), "seq": F.col("ticket_id"),
                  "event_ts": F.timestamp_seconds(F.lit(1704067200) + F.col("ticket_id")),
                  "retrieved_cases": F.array().cast("array<struct<case_id:string>>")})


def test_feedback_stream_equals_one_batch(spark):
    rng = np.random.default_rng(11)
    base = unit(rng, 8)
    v = np.repeat(base, 3, axis=0) + rng.normal(scale=0.03, size=(24, DIM))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    idx = make_index(spark, base[:2], ["a", "a"])
    df = feedback_rows(spark, v)
    stream = flows.read_stream(spark, stored(spark, df.unionByName(df), "feedback"), df.schema)
    log, reviews = IndexLog(idx, scratch_dir(spark, "index-log")), scratch_dir(spark, "reviews")
    flows.feedback_to_tables(stream, log, reviews, scratch_dir(spark, "state")).awaitTermination()
    want = {r["case_key"] for r in ix.add_approved(idx, df.where("feedback_is_okay")).collect()}
    got = {r["case_key"] for r in log.current().collect()} - {"k0000", "k0001"}
    assert got == want and want
    assert read_batches(spark, reviews).count() == 6


def test_index_log_latest_batch_wins_and_compacts(spark):
    idx = make_index(spark, np.eye(DIM)[:2], ["a", "a"])
    log = IndexLog(idx, scratch_dir(spark, "index-log"))
    assert log.current().count() == 2
    log.add(idx.where("case_key = 'k0000'").withColumn("resolution", F.lit("v1")), 0)
    log.add(idx.where("case_key = 'k0000'").withColumn("resolution", F.lit("v2")), 1)
    pick = lambda df: {r["case_key"]: r["resolution"] for r in df.collect()}
    assert pick(log.current()) == {"k0000": "v2", "k0001": "res 1"}
    assert pick(log.current(before_batch=1)) == {"k0000": "v1", "k0001": "res 1"}
    assert pick(log.compact(scratch_dir(spark, "base"))) == {"k0000": "v2", "k0001": "res 1"}


def test_compacted_log_keeps_event_order(spark):
    idx = make_index(spark, np.eye(DIM)[:2], ["a", "a"])
    row = lambda text, seq: idx.where("case_key = 'k0000'").withColumns(
        {"resolution": F.lit(text), "seq": F.lit(seq).cast("bigint")})
    log = IndexLog(idx, scratch_dir(spark, "index-log"))
    log.add(row("newer", 200), 0)
    log.compact(scratch_dir(spark, "base"))
    assert log.folded == 0
    log.add(row("older", 100), 1)
    pick = lambda: {r["case_key"]: r["resolution"] for r in log.current().collect()}
    assert pick() == {"k0000": "newer", "k0001": "res 1"}
    log.add(row("newest", 300), 2)
    assert pick() == {"k0000": "newest", "k0001": "res 1"}


def test_admission_in_a_scope_leaves_nothing(spark):
    from ticketloom.session import scratch_scope
    from ticketloom.sources.tables import path_exists

    idx = make_index(spark, np.eye(DIM)[:2], ["a", "a"])
    okay = feedback_rows(spark, np.eye(DIM)[2:5])
    with scratch_scope(spark, "admit") as folder:
        assert ix.add_approved(idx, okay).count() == 3
    assert not path_exists(spark, folder)


def test_scratch_scope_leaves_nothing(spark):
    from ticketloom.session import materialise, scratch_scope
    from ticketloom.sources.tables import path_exists

    with scratch_scope(spark, "batch-0") as folder:
        assert materialise(spark.range(3), "t").count() == 3
        assert path_exists(spark, folder)
    assert not path_exists(spark, folder)
    assert not scratch_dir(spark, "x").startswith(folder)


def test_depth_windows_on_a_table(spark):
    df = spark.createDataFrame([(0, "low"), (599, "low"), (600, "low"), (700, "high")], "s bigint, urgency string").select(
        F.timestamp_seconds(F.col("s") + 1704067200).alias("created_at"), "urgency")
    got = sorted((r["urgency"], r["row_count"]) for r in flows.queue_depth(df).collect())
    assert got == [("high", 1), ("low", 1), ("low", 2)]
    assert flows.queue_depth(df, "10 minutes", "5 minutes").agg(F.sum("row_count")).first()[0] == 8


def test_depth_stream_shows_open_windows(spark):
    df = spark.createDataFrame([(0, "low"), (599, "low"), (600, "low"), (90_000, "high")], "s bigint, urgency string").select(
        F.timestamp_seconds(F.col("s") + 1704067200).alias("created_at"), "urgency")
    stream = flows.read_stream(spark, stored(spark, df, "depth-in"), df.schema)
    path = scratch_dir(spark, "depth")
    flows.depth_to_table(flows.queue_depth(stream), path, scratch_dir(spark, "state")).awaitTermination()
    got = sorted((r["urgency"], r["row_count"]) for r in flows.read_depth(spark, path).collect())
    assert got == [("high", 1), ("low", 1), ("low", 2)]


def test_answers_wait_for_their_ticket_and_the_latest_event_wins(spark):
    idx = make_index(spark, np.eye(DIM)[:1], ["a"]).withColumn("timestamp", F.lit("2020-01-01").cast("timestamp"))
    ticket = "id string, ticket_id string, customer_query string, intent string, embedding array<double>"
    answer = "id string, human_response string, event_ts timestamp, seq bigint"
    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    path, queue = scratch_dir(spark, "answers"), scratch_dir(spark, "queue")
    log, state = IndexLog(idx, scratch_dir(spark, "index-log")), scratch_dir(spark, "state")
    vector = np.eye(DIM)[1].tolist()
    spark.createDataFrame([("q1", "t1", "first question", "a", vector)], ticket).write.parquet(queue)
    batches = [[("q1", "newer", at(200), 2), ("q2", "early", at(10), 1)], [("q1", "older", at(100), 1)], []]
    for n, rows in enumerate(batches):
        if n == 2:  # the ticket comes after its answer
            spark.createDataFrame([("q2", "t2", "second question", "a", vector)], ticket).write.mode("append").parquet(queue)
            rows = [("q9", "unknown", at(300), 1)]
        spark.createDataFrame(rows, answer).coalesce(1).write.mode("append").parquet(path)
        stream = flows.read_stream(spark, path, spark.createDataFrame([], answer).schema)
        flows.resolutions_to_index(stream, lambda: spark.read.parquet(queue), log, state).awaitTermination()
    got = {r["case_id"]: r["resolution"] for r in log.current().where("source != 'a'").collect()}
    assert got["t1"] == "newer" and got["t2"] == "early" and "t9" not in got


def test_late_answers_reach_the_index(spark):
    idx = make_index(spark, np.eye(DIM)[:1], ["a"]).withColumn("timestamp", F.lit("2020-01-01").cast("timestamp"))
    ticket = "id string, ticket_id string, customer_query string, intent string, embedding array<double>"
    answer = "id string, human_response string, event_ts timestamp, seq bigint"
    at = lambda h: datetime.datetime(2024, 1, 9) + datetime.timedelta(hours=h)
    queue = spark.createDataFrame(
        [(f"q{i}", f"t{i}", f"question {i}", "a", np.eye(DIM)[i + 1].tolist()) for i in range(4)], ticket)
    batches = [[("q0", "last", at(100), 2), ("q3", "by seq", at(50), 9)], [("q1", "older", at(10), 1), ("q0", "first", at(0), 1)],
               [("q2", "oldest", at(-90), 1), ("q3", "lower seq", at(50), 1)], [("q0", "last", at(100), 2)]]
    path, log, state = scratch_dir(spark, "answers"), IndexLog(idx, scratch_dir(spark, "index-log")), scratch_dir(spark, "state")
    for rows in batches:
        spark.createDataFrame(rows, answer).coalesce(1).write.mode("append").parquet(path)
        stream = flows.read_stream(spark, path, spark.createDataFrame([], answer).schema)
        flows.resolutions_to_index(stream, lambda: queue, log, state).awaitTermination()
    got = {r["case_id"]: r["resolution"] for r in log.current().where("case_id like 't%'").collect()}
    assert got == {"t0": "last", "t1": "older", "t2": "oldest", "t3": "by seq"}


def test_late_feedback_is_kept_and_repeats_are_not(spark):
    idx = make_index(spark, np.eye(DIM)[:1], ["a"])
    df = feedback_rows(spark, np.eye(DIM)[1:9]).withColumn("event_ts", F.col("event_ts") - F.col("seq") * F.expr("INTERVAL 5 HOURS"))
    path, state = scratch_dir(spark, "feedback"), scratch_dir(spark, "state")
    log, reviews = IndexLog(idx, scratch_dir(spark, "index-log")), scratch_dir(spark, "reviews")
    for part in ("seq < 3", "seq >= 3 AND seq < 6", "seq >= 4"):  # each older than the one before
        df.where(part).coalesce(1).write.mode("append").parquet(path)
        flows.feedback_to_tables(flows.read_stream(spark, path, df.schema), log, reviews, state).awaitTermination()
    assert log.current().count() == 1 + df.where("feedback_is_okay").count()
    assert sorted(r["ticket_id"] for r in read_batches(spark, reviews).collect()) == ["0", "4"]


def test_parts_deliver_every_row_in_several_files(spark):
    from ticketloom.catalog.streams import in_parts

    df = spark.range(0, 900, 1, 4).withColumn("n", F.when(F.col("id") >= 30, F.col("id")))
    out, state = scratch_dir(spark, "out"), scratch_dir(spark, "state")
    for n, stream in enumerate(in_parts(spark, df, "parts", F.col("n"))):
        files = stream.select("id", F.col("_metadata.file_path").alias("file"), F.lit(n).alias("part"))
        flows.append_to(files, out, state).awaitTermination()
    got = spark.read.parquet(out)
    assert got.count() == 900 and got.where("id < 30").agg(F.max("part")).first()[0] == 0
    assert got.select("part").distinct().count() == 3 and got.select("file").distinct().count() > 3


def test_late_rows_are_counted(spark):
    rows = [(i * 3600, "low" if i % 2 else "high") for i in range(20)]
    df = spark.createDataFrame(rows, "s bigint, urgency string").select(
        F.timestamp_seconds(F.col("s") + 1704067200).alias("created_at"), "urgency")
    path, out, state = scratch_dir(spark, "late-in"), scratch_dir(spark, "late"), scratch_dir(spark, "state")
    for n in range(3, -1, -1):  # the newest first, one batch each
        lower = F.unix_seconds("created_at") - 1704067200
        df.where((lower >= n * 18000) & (lower < (n + 1) * 18000)).coalesce(1).write.mode("append").parquet(path)
        flows.depth_to_table(flows.queue_depth(flows.read_stream(spark, path, df.schema)), out, state).awaitTermination()
    got = flows.read_depth(spark, out)
    assert got.agg(F.sum("row_count")).first()[0] == 20 and read_batches(spark, out).select("batch_id").distinct().count() == 4


def test_pending_falls_with_answers_in_any_order(spark):
    event = "id string, kind string, urgency string"
    batches = [
        [("a", "queued", "high"), ("b", "queued", "low"), ("c", "answered", None)],
        [("a", "answered", None), ("c", "queued", "high"), ("d", "queued", "low"), ("d", "queued", "low")],
        [("a", "answered", None), ("e", "answered", None), ("e", "queued", "low"), ("a", "queued", "high"), ("f", "queued", None)],
        [("d", "answered", None)],
    ]
    path, out, state = scratch_dir(spark, "events"), scratch_dir(spark, "pending"), scratch_dir(spark, "state")
    want = [{"high": 1, "low": 1}, {"low": 2}, {"low": 2, None: 1}, {"low": 1, None: 1}]
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider, None)
    for rows, expected in zip(batches, want):
        spark.createDataFrame(rows, event).coalesce(1).write.mode("append").parquet(path)
        stream = flows.read_stream(spark, path, spark.createDataFrame([], event).schema)
        flows.pending_to_table(stream, out, state).awaitTermination()
        assert {r["urgency"]: r["pending"] for r in flows.read_pending(spark, out).collect()} == expected
    assert spark.conf.get(provider, None) == before


def test_queue_rows_and_answers_wait_for_each_other_in_state(spark):
    idx = make_index(spark, np.eye(DIM)[:1], ["a"]).withColumn("timestamp", F.lit("2020-01-01").cast("timestamp"))
    ticket = "id string, ticket_id string, customer_query string, intent string, embedding array<double>"
    answer = "id string, human_response string, event_ts timestamp, seq bigint"
    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    row = lambda i: (f"q{i}", f"t{i}", f"question {i}", "a", np.eye(DIM)[i].tolist())
    log, state = IndexLog(idx, scratch_dir(spark, "index-log")), scratch_dir(spark, "state")
    queue, path = scratch_dir(spark, "queue"), scratch_dir(spark, "answers")
    batches = [
        ([row(1)], [("q2", "early", at(10), 1), ("q1", "newer", at(200), 2)]),
        ([row(1), row(2)], [("q1", "newer", at(200), 2), ("q1", "older", at(100), 1)]),
        ([row(3)], [("q2", "much later", at(90_000), 1), ("q9", "unknown", at(300), 1), (None, "of nobody", at(1), 1)]),
    ]
    for tickets, answers in batches:
        spark.createDataFrame(tickets, ticket).coalesce(1).write.mode("append").parquet(queue)
        spark.createDataFrame(answers, answer).coalesce(1).write.mode("append").parquet(path)
        queued, given = (
            flows.read_stream(spark, p, spark.createDataFrame([], s).schema) for p, s in ((queue, ticket), (path, answer)))
        flows.answers_to_index(queued, given, log, state).awaitTermination()
    got = {r["case_id"]: r["resolution"] for r in log.current().where("resolution NOT LIKE 'res%'").collect()}
    assert got == {"t1": "newer", "t2": "much later"}
    # A batch writes the cases of what met in it, not those of earlier ones; the second delivery met nothing.
    assert sorted((r["batch_id"], r["resolution"]) for r in read_batches(spark, log.path).collect()) == [
        (0, "newer"), (1, "early"), (1, "older"), (2, "much later")]


def test_pending_tickets_are_counted_without_a_python_call_per_ticket(spark):
    path = scratch_dir(spark, "events")
    events = spark.createDataFrame([("a", "queued", "low")], "id string, kind string, urgency string")
    events.write.parquet(path)
    changes = flows.pending_changes(flows.read_stream(spark, path, events.schema))
    assert changes.isStreaming and "Pandas" not in changes._jdf.queryExecution().analyzed().toString()
