"""What stays on disk while a query goes on."""

import glob
import os

from pyspark.sql import functions as F

from ticketloom.catalog.streams import in_parts
from ticketloom.operators import index as ix
from ticketloom.session import materialise, scratch_dir, scratch_scope
from ticketloom.sources.logs import IndexLog
from ticketloom.streaming import flows


def shuffle_files(spark):
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {f for d in dirs for f in glob.glob(f"{d.getPath()}/*/shuffle_*.data")}


def test_shuffles_of_a_stored_table_are_not_kept(spark):
    before = shuffle_files(spark)
    stored = materialise(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.sum("id").alias("n")), "sums")
    assert not shuffle_files(spark) - before and stored.count() == 7


def test_parts_of_a_stream_are_stored_once(spark):
    """What the rows were made of and the undivided table are gone before the first batch."""
    with scratch_scope(spark, "parts-test") as folder:
        folder = folder.removeprefix("file:")

        def build():
            return materialise(spark.range(90), "source").select((F.col("id") % 30).alias("n"))

        streams = in_parts(spark, build, "rows", F.col("n"))
        next(streams)
        held = sum(spark.read.parquet(os.path.dirname(f)).count()
                   for f in {os.path.dirname(p) + "/" for p in glob.glob(f"{folder}/**/*.parquet", recursive=True)})
        assert held == 90


def test_state_stores_reserve_no_disk_ahead(spark):
    """One ticket and one answer in stores of eight partitions take little room on the local disks."""
    local = spark._jvm.org.apache.spark.util.Utils.getLocalDir(spark.sparkContext._jsc.sc().conf())

    def stores():
        return set(glob.glob(glob.escape(local) + "/StateStoreId*"))

    queued, answers = scratch_dir(spark, "queued"), scratch_dir(spark, "answers")
    spark.createDataFrame(
        [("1", "t1", "text", "a", [1.0, 0.0])],
        "id string, ticket_id string, customer_query string, intent string, embedding array<double>").write.parquet(queued)
    spark.createDataFrame([("1", "answer", 0)], "id string, human_response string, seq int").withColumn(
        "event_ts", F.current_timestamp()).write.parquet(answers)
    base = ix.to_index_rows(spark.createDataFrame(
        [("c", "text", "a", [1.0, 0.0])], "case_id string, ticket_text string, intent string, embedding array<double>"))
    base = base.withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    log, before = IndexLog(base.limit(0), scratch_dir(spark, "log")), stores()
    left, right = (flows.read_stream(spark, p, spark.read.parquet(p).schema) for p in (queued, answers))
    flows.answers_to_index(left, right, log, scratch_dir(spark, "state")).awaitTermination()
    assert log.current().select("case_id", "resolution").collect() == [("t1", "answer")]
    new = stores() - before
    taken = sum(os.stat(os.path.join(d, f)).st_blocks * 512 for s in new for d, _, fs in os.walk(s) for f in fs)
    assert new and taken < 500_000 * len(new)
