"""Append-only tables written once per micro-batch; writing a batch again replaces it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ticketloom.operators import index as ix
from ticketloom.sources.tables import path_exists


#: When a row of the index was written: event order (seq, then tie), then batch.
ORDER = "struct<seq:bigint,tie:bigint,batch:bigint>"


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """One folder per batch: a replayed batch overwrites its own rows and nothing else."""
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def read_batches(spark: SparkSession, path: str, schema=None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


class IndexLog:
    """Index of solved cases as a base table plus one small delta per batch.

    A batch writes only its own rows. The current index is the base without the keys that the
    deltas overwrite, and the latest row (by seq, tie, batch) of each of those; ``compact``
    writes it out and goes on from there.
    """

    def __init__(self, base: DataFrame, path: str):
        self.spark, self.path = base.sparkSession, path
        never = F.lit(None).cast(ORDER)
        self.base = base if "__order" in base.columns else base.select(*ix.INDEX_COLUMNS, never.alias("__order"))
        self.folded = -1  # deltas up to this batch are in the base

    def add(self, rows: DataFrame, batch_id: int) -> None:
        if "seq" not in rows.columns:
            when = F.unix_micros(F.col("timestamp").try_cast("timestamp"))
            rows = rows.withColumn("seq", F.coalesce(when, F.lit(0).cast("bigint")))
        if "tie" not in rows.columns:
            rows = rows.withColumn("tie", F.lit(0))
        write_batch(rows.withColumn("tie", F.col("tie").cast("bigint")), self.path, batch_id)

    def current(self, before_batch: int | None = None) -> DataFrame:
        """The index, or how it was before a batch (a replay must not see its own rows)."""
        return self._ordered(before_batch).select(*ix.INDEX_COLUMNS)

    def _ordered(self, before_batch: int | None) -> DataFrame:
        if not path_exists(self.spark, self.path):
            return self.base
        deltas = read_batches(self.spark, self.path).where(F.col("batch_id") > self.folded)
        if before_batch is not None:
            deltas = deltas.where(F.col("batch_id") < before_batch)
        # The later event wins, whatever batch brought it; of equal ones the later batch.
        order = F.struct(F.col("seq").cast("bigint").alias("seq"), "tie", F.col("batch_id").cast("bigint").alias("batch"))
        deltas = deltas.select(*ix.INDEX_COLUMNS, order.alias("__order"))
        keys = deltas.select("case_key").distinct()
        # Only base rows that a delta names are ranked; the others stay where they are.
        rivals = deltas.unionByName(self.base.join(keys, "case_key", "left_semi"))
        latest = Window.partitionBy("case_key").orderBy(F.col("__order").desc_nulls_last())
        winners = rivals.withColumn("__rank", F.row_number().over(latest)).where("__rank = 1").drop("__rank")
        return self.base.join(keys, "case_key", "left_anti").unionByName(winners)

    def compact(self, path: str) -> DataFrame:
        """Write the current index as the new base; later deltas are folded onto that."""
        last = -1
        if path_exists(self.spark, self.path):
            last = read_batches(self.spark, self.path).agg(F.max("batch_id")).first()[0]
        self._ordered(None).write.parquet(path)
        self.base = self.spark.read.parquet(path)
        self.folded = self.folded if last is None else max(self.folded, last)
        return self.current()
