"""Readers and writers of ticket, taxonomy and report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ticketloom import constants as K
from ticketloom.session import materialise

RAW_COLUMNS = {
    "Ticket ID": "ticket_id",
    "Ticket Description": "ticket_description",
    "Product Purchased": "product_purchased",
    "Ticket Type": "ticket_type",
    "Ticket Subject": "ticket_subject",
    "Ticket Priority": "ticket_priority",
    "Ticket Status": "ticket_status",
    "Resolution": "resolution",
}

TAXONOMY_SCHEMA = (
    T.StructType()
    .add("name", T.StringType())
    .add("definition", T.StringType())
    .add("source_cluster_ids", T.ArrayType(T.IntegerType()))
    .add("risk_level", T.StringType())
    .add("risk_reason", T.StringType())
    .add("example_queries", T.ArrayType(T.StringType()))
)


def read_raw_csv(spark: SparkSession, path: str) -> DataFrame:
    """Raw ticket CSV: all columns as text, by header name; a bad id becomes null.

    Quoted line breaks are allowed, which makes a file the unit of parallelism; for big files
    there is ``read_raw_csv_blocks``.
    """
    raw = (
        spark.read.option("header", True)
        .option("multiLine", True)
        .option("escape", '"')
        .csv(path)
    )
    return _ticket_columns(raw)


def _ticket_columns(raw: DataFrame) -> DataFrame:
    return raw.select(
        *[
            F.col(f"`{name}`").try_cast("bigint").alias(alias)
            if alias == "ticket_id"
            else F.col(f"`{name}`").alias(alias)
            for name, alias in RAW_COLUMNS.items()
        ]
    )


def read_raw_csv_blocks(spark: SparkSession, path: str, block_bytes: int = 64 << 20) -> DataFrame:
    """``read_raw_csv`` for big files: a file with quoted line breaks is read by many tasks.

    A line break ends a record when the quotes before it, in the whole file, are even in number.
    Files are scanned as plain lines, block by block; each block counts its quotes and its line
    breaks outside of them for both cases, an even and an odd number before it. These few
    numbers per block, added up along the file, give every line its record. Records of one line
    are parsed where they are; only lines of longer records move. A block of lines is numbered
    in one task.

    Every file begins with a header line; quotes stand as RFC 4180 has them, and records end
    with a line feed, with or without a carriage return before it.
    """
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, block_bytes)
    try:
        lines = spark.read.option("lineSep", "\n").text(path).select(
            F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))
        # Written while the block size holds: later plans read the numbered lines.
        lines = materialise(lines.withColumn("odd", F.regexp_count("line", F.lit('"')) % 2), "csv-lines")
    finally:
        spark.conf.set(name, before)
    here = Window.partitionBy("file", "block").orderBy("at")
    upto = F.coalesce(F.sum("odd").over(here.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) % 2
    lines = lines.withColumn("inside", upto)  # of quotes, if the block began outside
    # A line starts a record when the quotes before it are even: with an odd block, the other lines do.
    sums = lines.groupBy("file", "block").agg(
        (F.sum("odd") % 2).alias("flips"), F.count_if(F.col("inside") == 0).alias("even"), F.count_if(F.col("inside") == 1).alias("other"))
    along = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("start", F.coalesce(F.sum("flips").over(along), F.lit(0)) % 2)
    starts = F.when(F.col("start") == 0, F.col("even")).otherwise(F.col("other"))
    sums = sums.withColumn("first", F.coalesce(F.sum(starts).over(along), F.lit(0))).select(
        F.col("file").alias("_file"), F.col("block").alias("_block"), "start", "first")
    known = lines.join(materialise(sums, "csv-blocks"), (F.col("file") == F.col("_file")) & (F.col("block") == F.col("_block")))
    begins = F.col("inside") == F.col("start")
    known = known.select(
        "file", "at", "line", begins.alias("begins"), ((F.col("inside") + F.col("odd")) % 2 == F.col("start")).alias("ends"),
        (F.col("first") + F.sum(begins.cast("bigint")).over(here)).alias("record")).where("record > 1")
    whole = known.where("begins AND ends").select("line")
    parts = known.where("NOT (begins AND ends)").groupBy("file", "record").agg(
        F.sort_array(F.collect_list(F.struct("at", "line"))).alias("parts"))
    joined = parts.select(F.array_join(F.transform("parts", lambda p: p["line"]), "\n").alias("line"))
    columns = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path).columns
    ddl = ", ".join(f"`{c}` string" for c in columns)
    fields = F.from_csv("line", ddl, {"escape": '"', "multiLine": "true"})
    return _ticket_columns(whole.unionByName(joined).withColumn(
        "line", F.regexp_replace("line", r"\r\z", "")).where("length(line) > 0").select(fields.alias("r")).select("r.*"))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Give a scan of few big splits one partition per core before costly text work.

    A scan that already has enough splits is left alone. Hashing on a unique key keeps the
    split the same when a task is run again.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)


def write_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = (), mode: str = "overwrite") -> str:
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return path


def read_taxonomy(spark: SparkSession, path: str, root: str = "intents") -> DataFrame:
    """Nested taxonomy JSON -> one row per intent. ``root`` names the array."""
    schema = T.StructType([T.StructField(root, T.ArrayType(TAXONOMY_SCHEMA))])
    doc = spark.read.schema(schema).option("multiLine", True).json(path)
    return doc.select(F.inline(F.col(root)))


def read_records(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A JSON array of records (golden set, predictions) with a declared schema."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def taxonomy_or_message(spark: SparkSession, approved: str, proposed: str) -> DataFrame:
    """The approved taxonomy, else the proposed merges, else one row with a message."""
    columns = ["name", "definition", "source_cluster_ids", "risk_level"]
    for path, root in ((approved, "intents"), (proposed, "merged_intents")):
        if path_exists(spark, path):
            found = read_taxonomy(spark, path, root).select(*columns)
            return found.withColumn("message", F.lit(None).cast("string"))
    empty = spark.range(1).select(*[F.lit(None).cast(TAXONOMY_SCHEMA[c].dataType).alias(c) for c in columns])
    return empty.withColumn("message", F.lit("Taxonomy not generated yet."))


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(hadoop_path)


def write_report(df: DataFrame, path: str) -> str:
    """Rows as JSON lines, one object per row."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)
    return path


def taxonomy_table(spark: SparkSession) -> DataFrame:
    """The built-in ten intents as a dimension table."""
    rows = [
        (name, f"Tickets about {name.replace('_', ' ')}.", list(clusters), risk)
        for name, risk, clusters in K.TAXONOMY
    ]
    return spark.createDataFrame(
        rows, "name string, definition string, source_cluster_ids array<int>, risk_level string"
    )
