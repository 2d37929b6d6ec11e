"""An index of solved cases as a bucketed table: writes and anti-joins leave its rows in place.

Rows lie in ``buckets`` buckets by the hash that Spark's joins use, one folder per bucket. A
join by ``case_key`` shuffles only the other side, and an upsert reads and rewrites only the
buckets that its rows fall into. A bucket should fit a task: take about one per 128 MB of the
index, and at least as many as ``spark.sql.shuffle.partitions``: with fewer, Spark may shuffle
the index to the other side's partitions after all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketloom.operators import index as ix
from ticketloom.session import materialise

BUCKETS = 256


class BucketedIndex:
    """Table ``name`` of the session's catalog, with its files under ``path``.

    ``case_key`` must not be null. A key that comes several times in one write keeps its highest
    ``seq``; a written key takes the place of its old row, and writing the same rows again changes
    nothing. A lost executor costs its tasks, as all buckets are written aside first. Then the
    driver swaps them by Spark's dynamic overwrite, which is not atomic: if it dies between taking
    out an old bucket and putting in the new one, that bucket's rows are lost. Keep a snapshot of
    ``table()`` where that matters.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name = spark, name
        folder = spark.sql(f"DESCRIBE TABLE EXTENDED {name}").where("col_name = 'Num Buckets'").first()
        if folder is None:
            raise ValueError(f"{name} is not bucketed")
        self.buckets = int(folder["data_type"])

    @classmethod
    def create(cls, rows: DataFrame, name: str, path: str, buckets: int = BUCKETS) -> BucketedIndex:
        """A new table of the latest row per key; ``rows`` may be empty."""
        latest = ix.upsert(None, rows).withColumn("bucket", _bucket(buckets))
        (
            latest.repartition(buckets, "case_key").write.partitionBy("bucket").bucketBy(buckets, "case_key")
            .sortBy("case_key").option("path", path).option("partitionOverwriteMode", "dynamic").saveAsTable(name)
        )
        return cls(rows.sparkSession, name)

    def table(self) -> DataFrame:
        return self.spark.table(self.name).select(*ix.INDEX_COLUMNS)

    def missing(self, rows: DataFrame) -> DataFrame:
        """Rows whose key the index does not hold; the index is not shuffled."""
        return ix.missing_rows(self.table(), rows)

    def merged(self, new: DataFrame, touched: list[int]) -> DataFrame:
        """What the ``touched`` buckets hold once ``new`` (a row per key) is in."""
        stored = self.spark.table(self.name).where(F.col("bucket").isin(touched))
        own, given = (
            df.select("case_key", F.struct(*ix.INDEX_COLUMNS).alias(side)) for df, side in ((stored, "own"), (new, "given")))
        both = own.join(given, "case_key", "full_outer").select(F.coalesce("given", "own").alias("row"))
        return both.select("row.*").withColumn("bucket", _bucket(self.buckets))

    def upsert(self, rows: DataFrame) -> list[int]:
        """Write ``rows`` over the rows of the same keys; returns the numbers of the rewritten buckets.

        The table has one writer. Readers may meet some new and some old buckets during the swap.
        """
        new = materialise(ix.upsert(None, rows), "index-rows")
        # At most one number per bucket.
        touched = sorted(r["bucket"] for r in new.select(_bucket(self.buckets).alias("bucket")).distinct().collect())
        if touched:
            # The table's own option makes this replace the touched folders only.
            self.merged(new, touched).write.insertInto(self.name, overwrite=True)
            self.spark.catalog.refreshTable(self.name)
        return touched


def _bucket(buckets: int) -> Column:
    """The bucket that Spark's own bucketing puts a key into."""
    return F.pmod(F.hash("case_key"), F.lit(buckets))
