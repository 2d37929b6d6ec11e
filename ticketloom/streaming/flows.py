"""The batch operators on streams. Stateless steps run as they are; steps with a search or
a write to an index run per micro-batch, and a replayed batch replaces its own output."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import AbstractContextManager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ticketloom.config import TriageConfig
from ticketloom.operators import hygiene as hy
from ticketloom.operators import index as ix
from ticketloom.operators import labelling as lb
from ticketloom.operators import queue as qu
from ticketloom.operators import routing as rt
from ticketloom.plans.triage import triage
from ticketloom.session import DROP_SHUFFLES, materialise, scratch_scope, settings
from ticketloom.sources.logs import IndexLog, read_batches, write_batch
from ticketloom.sources.tables import path_exists


def read_stream(spark: SparkSession, path: str, schema, max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def gate_stream(raw: DataFrame, cfg: TriageConfig = TriageConfig()) -> DataFrame:
    """Raw tickets -> clean text, rule classification, gate. No state, no shuffle."""
    clean = hy.to_clean_schema(hy.drop_blank(raw, "ticket_description"))
    classified = lb.classify_by_rules(clean.withColumnRenamed("ticket_text", "query"))
    return rt.gate(classified, cfg)


def triage_to_tables(
    tickets: DataFrame, index: IndexLog, queue_path: str, log_path: str, checkpoint: str,
    cfg: TriageConfig = TriageConfig(), **trigger,
) -> StreamingQuery:
    """Classified tickets with vectors -> human queue and conversation log."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        routed = triage(batch, index.current(), cfg, carry=("created_at",)).persist()
        try:
            write_batch(qu.queue_rows(routed, F.col("created_at")), queue_path, batch_id)
            write_batch(qu.log_rows(routed, F.col("created_at")), log_path, batch_id)
        finally:
            routed.unpersist()

    return _per_batch(tickets, handle, checkpoint, trigger)


def resolutions_to_index(
    events: DataFrame, queue: Callable[[], DataFrame], index: IndexLog, checkpoint: str, **trigger
) -> StreamingQuery:
    """Answers of human agents -> human-resolved cases. The answer of the latest (event time,
    seq) is the case, in whatever order they come and however late or often: no watermark
    drops any, and one delivered again is the same row of the index. ``queue`` is read anew
    for each batch, and an answer to a ticket that is not queued yet waits beside the index
    for the batch that finds it."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark, known = batch.sparkSession, queue()
        held = f"{index.path}-waiting"
        answers = batch
        if path_exists(spark, f"{held}/batch_id={batch_id - 1}"):
            answers = batch.unionByName(spark.read.schema(batch.schema).parquet(f"{held}/batch_id={batch_id - 1}"))
        # Only the last answer to a ticket can be its case, so repeats do not pile up either.
        last = F.max_by(F.struct(*batch.columns), F.struct("event_ts", "seq", "human_response"))
        answers = materialise(answers.groupBy("id").agg(last.alias("e")).select("e.*"), "answers")
        write_batch(answers.join(known.select("id"), "id", "left_anti").select(*batch.columns), held, batch_id)
        _add_cases(index, qu.resolutions_to_cases(known, answers), batch_id)

    return _per_batch(events, handle, checkpoint, trigger)


def _add_cases(index: IndexLog, cases: DataFrame, batch_id: int) -> None:
    """Later answers to a ticket have the same key and win by their time, then their seq."""
    rows = ix.to_index_rows(cases.withColumnRenamed("event_seq", "seq")).withColumnRenamed("seq", "tie")
    index.add(rows.withColumn("seq", F.unix_micros(F.col("timestamp").cast("timestamp"))), batch_id)


#: What a queue row and an answer keep in the state until they have met.
QUEUED, ANSWER = ("id", "ticket_id", "customer_query", "intent", "embedding"), ("id", "human_response", "event_ts", "seq")


def meet_answers(queued: DataFrame, answers: DataFrame) -> DataFrame:
    """Queue rows joined to their answers, both streams, whichever of the two comes first.

    A ticket is queued once (the first row of an id counts) and an answer delivered again is
    dropped. There is no watermark, so nothing is too late; the state holds both sides for good.
    """
    tickets = queued.select(*QUEUED).dropDuplicates(["id"])
    given = answers.select(*ANSWER).dropDuplicates(list(ANSWER))
    return tickets.join(given.withColumnRenamed("seq", "event_seq"), "id")


def answers_to_index(
    queued: DataFrame, answers: DataFrame, index: IndexLog, checkpoint: str, **trigger
) -> StreamingQuery:
    """The cases of ``resolutions_to_index`` from a stream of queue rows and one of answers.

    What waits lies in keyed state, so a batch costs what is new in it: neither the queue nor
    earlier answers are read again.
    """
    def handle(batch: DataFrame, batch_id: int) -> None:
        last = F.max_by(F.struct(*batch.columns), F.struct("event_ts", "event_seq", "human_response"))
        _add_cases(index, qu.answered_to_cases(batch.groupBy("id").agg(last.alias("e")).select("e.*")), batch_id)

    with _state_on_disk(queued.sparkSession):
        return _per_batch(meet_answers(queued, answers), handle, checkpoint, trigger)


def feedback_to_tables(
    feedback: DataFrame, index: IndexLog, review_path: str, checkpoint: str,
    cfg: TriageConfig = TriageConfig(), **trigger,
) -> StreamingQuery:
    """Customer feedback: approved replies join the index, rejected ones go to review. What is
    delivered again meets its own key in the index or among the reviews; nothing is too late."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            okay, _ = qu.split_feedback(batch)
            now = F.current_timestamp().cast(index.base.schema["timestamp"].dataType)
            index.add(ix.add_approved(index.current(before_batch=batch_id), okay, cfg, now), batch_id)
            write_batch(_new_reviews(qu.review_rows(batch, F.col("event_ts")), review_path, batch_id), review_path, batch_id)
        finally:
            batch.unpersist()

    return _per_batch(feedback, handle, checkpoint, trigger)


def _new_reviews(rows: DataFrame, path: str, batch_id: int) -> DataFrame:
    """One row per review that no earlier batch has written."""
    rows = rows.dropDuplicates(["id", "ticket_id"])
    if not path_exists(rows.sparkSession, path):
        return rows
    earlier = read_batches(rows.sparkSession, path, "id string, ticket_id string, batch_id bigint")
    # The batch is the small side; of all earlier reviews only its own ids move on.
    seen = earlier.where(F.col("batch_id") < batch_id).join(rows.select("id"), "id", "left_semi")
    seen = seen.select(F.col("id").alias("__id"), F.col("ticket_id").alias("__ticket"))
    same = (F.col("id") == F.col("__id")) & F.col("ticket_id").eqNullSafe(F.col("__ticket"))
    return rows.join(seen, same, "left_anti")


def queue_depth(
    queue: DataFrame, size: str = "10 minutes", slide: str | None = None, delay: str | None = None,
    by: str = "urgency",
) -> DataFrame:
    """New queue rows per time window and urgency. Works on a stream and on a table.

    No row is too late: the state holds one number per window and urgency, which does not grow
    with the rows. ``delay`` sets a watermark for streams that must forget old windows; rows
    that come later than that are lost then.
    """
    rows = queue.withWatermark("created_at", delay) if delay else queue
    return (
        rows.groupBy(F.window("created_at", size, slide), by)
        .agg(F.count(F.lit(1)).alias("row_count"))
        .select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
                by, "row_count")
    )


def review_counts(reviews: DataFrame, size: str = "10 minutes", slide: str | None = None, delay: str | None = None) -> DataFrame:
    """New developer reviews per time window and status."""
    return queue_depth(reviews, size, slide, delay, by="status")


#: Row of the stream that ``pending_changes`` reads: a ticket was queued or answered.
TICKET_EVENT = "id string, kind string, urgency string"


def ticket_events(queue: DataFrame, answers: DataFrame) -> DataFrame:
    """Queue rows (id, urgency) and answers (id) as one stream for ``pending_changes``."""
    none = F.lit(None).cast("string")
    return queue.select("id", F.lit("queued").alias("kind"), F.col("urgency").cast("string").alias("urgency")).unionByName(
        answers.select("id", F.lit("answered").alias("kind"), none.alias("urgency")))


def pending_changes(events: DataFrame) -> DataFrame:
    """(urgency, change): +1 when a ticket becomes open, -1 when it is answered.

    ``events`` is a stream of ``TICKET_EVENT`` rows. The state of a ticket is the time of the batch
    that first queued it, with its urgency there, of the one that first answered it, and of the last
    with either, kept for good, as an answer may come before its ticket, late or again. All rows of
    a batch have its time, which a replay keeps, so what was open before the batch can be told. A
    ticket that is queued again keeps its first urgency.
    """
    queued, answered = F.col("kind") == "queued", F.col("kind") == "answered"
    arrival = F.struct("at", F.col("urgency").isNull().alias("unknown"), "urgency")
    tickets = events.withColumn("at", F.current_timestamp()).groupBy("id").agg(
        F.min(F.when(queued, arrival)).alias("first"), F.min(F.when(answered, F.col("at"))).alias("answered_at"),
        F.max("at").alias("at"))
    is_open = F.col("first").isNotNull() & F.col("answered_at").isNull()
    earlier = F.coalesce(F.col("first.at") < F.col("at"), F.lit(False))
    was_open = earlier & F.coalesce(F.col("answered_at") >= F.col("at"), F.lit(True))
    change = is_open.cast("int") - was_open.cast("int")
    return tickets.select(F.col("first.urgency").alias("urgency"), change.alias("change")).where("change <> 0")


def pending_to_table(events: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Changes of the number of open tickets per urgency, one small file a batch; see ``read_pending``."""
    def run(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch.groupBy("urgency").agg(F.sum("change").alias("change")), path, batch_id)

    with _state_on_disk(events.sparkSession):
        return (
            pending_changes(events).writeStream.outputMode("update").foreachBatch(run)
            .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
        )


def _state_on_disk(spark: SparkSession) -> AbstractContextManager:
    """For queries started inside: the state of single tickets grows with them, so it is kept on disk,
    that of a join in one store per partition instead of four. Stores reserve no space ahead: there
    are many, and each would take megabytes. A query goes on as it started."""
    return settings(spark, {
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.streaming.join.stateFormatVersion": "3",
        "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
        "spark.sql.streaming.stateStore.rocksdb.compression": "zstd",
        **DROP_SHUFFLES,
    })


def read_pending(spark: SparkSession, path: str) -> DataFrame:
    """Open tickets per urgency, now."""
    rows = read_batches(spark, path, "urgency string, change bigint, batch_id bigint")
    return rows.groupBy("urgency").agg(F.sum("change").alias("pending")).where("pending > 0")


def depth_to_table(depth: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Every change of a window is written, open windows too; ``read_depth`` has the last."""
    def run(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch, path, batch_id)

    return (
        depth.writeStream.outputMode("update").foreachBatch(run).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def read_depth(spark: SparkSession, path: str, by: str = "urgency") -> DataFrame:
    """Live depth: a window's count only grows, so its last value is its largest."""
    keys = ("window_start", "window_end", by)
    return read_batches(spark, path).groupBy(*keys).agg(F.max("row_count").alias("row_count"))


def append_to(df: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    return (
        df.writeStream.outputMode("append").format("parquet").option("path", path)
        .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    )


def _per_batch(df: DataFrame, handle, checkpoint: str, trigger: dict) -> StreamingQuery:
    def run(batch: DataFrame, batch_id: int) -> None:
        with scratch_scope(batch.sparkSession, f"batch-{batch_id}"):
            handle(batch, batch_id)

    return (
        df.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )
