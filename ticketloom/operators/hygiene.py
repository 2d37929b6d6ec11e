"""Cleaning, filtering, dedupe and validation of ticket tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ticketloom.functions import text as tx

CLOSED = "Closed"


def to_clean_schema(raw: DataFrame, redact_ids: bool = False, extra: tuple[str, ...] = ()) -> DataFrame:
    """Project raw tickets to the clean schema in one select (names of ``sources.tables``)."""

    def trimmed(name: str) -> Column:
        return tx.strip(F.coalesce(F.col(name), F.lit("")))

    cleaned = raw.select(
        F.col("ticket_id").cast("bigint").alias("ticket_id"),
        tx.clean_ticket_text(
            F.col("ticket_description"), F.col("product_purchased"), redact_ids
        ).alias("ticket_text"),
        trimmed("product_purchased").alias("product"),
        trimmed("ticket_type").alias("ticket_type"),
        trimmed("ticket_subject").alias("ticket_subject"),
        trimmed("ticket_priority").alias("ticket_priority"),
        trimmed("ticket_status").alias("ticket_status"),
        tx.clean_resolution_text(F.col("resolution")).alias("resolution"),
        *extra,
    )
    solved = solved_flag(F.col("ticket_status"), F.col("resolution"))
    return cleaned.withColumn("is_solved", solved)


def solved_flag(status: Column, resolution: Column) -> Column:
    return (status == CLOSED) & (F.length(resolution) > 0)


def drop_blank(df: DataFrame, column: str = "ticket_text") -> DataFrame:
    return df.where(~tx.is_blank(F.col(column)))


def keep_first(df: DataFrame, column: str = "ticket_text", order: str = "ticket_id") -> DataFrame:
    """Exact dedupe on a text, keeping the row that comes first.

    Rows are grouped on a digest of the text. ``rank = 1`` lets Spark put a window group
    limit below the shuffle, so each map task sends at most one row per text and a text
    that is copied into a third of the table does not pile up in one task.
    """
    w = Window.partitionBy("__digest").orderBy(F.col(order))
    return (
        df.withColumn("__digest", F.sha2(F.col(column), 256))
        .withColumn("__rank", F.row_number().over(w))
        .where("__rank = 1")
        .drop("__digest", "__rank")
    )


def clean_tickets(raw: DataFrame, redact_ids: bool = False, extra: tuple[str, ...] = ()) -> DataFrame:
    """Raw tickets -> clean, non-blank, unique tickets.

    Cleaning only ever swaps text for non-blank text, so a clean text is blank exactly when
    the raw one is. The filter therefore runs on the raw column: it reaches the scan, and
    the cleaning chain is not computed a second time inside a filter.
    """
    filled = drop_blank(raw, "ticket_description")
    return keep_first(to_clean_schema(filled, redact_ids, extra))


def solved_only(df: DataFrame) -> DataFrame:
    return df.where(F.col("is_solved"))


def row_gate(df: DataFrame, minimum: int) -> DataFrame:
    """The gate as a metric row: rows, minimum, passed."""
    return df.agg(F.count(F.lit(1)).alias("row_count")).select(
        "row_count",
        F.lit(minimum).cast("bigint").alias("minimum"),
        (F.col("row_count") >= minimum).alias("passed"),
    )


def require_min_rows(df: DataFrame, minimum: int, what: str = "solved rows") -> DataFrame:
    """Fail the job when the table has fewer rows than wanted; else return it unchanged."""
    found = df.agg(F.count(F.lit(1))).scalar()
    message = F.concat(
        F.lit(f"{what}: found "), found.cast("string"), F.lit(f", need at least {minimum}")
    )
    return df.where(
        F.when(found >= minimum, F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))
    )


def split_blank(df: DataFrame, column: str, reason: str) -> tuple[DataFrame, DataFrame]:
    """(valid rows, quarantined rows with a reason)."""
    blank = tx.is_blank(F.col(column))
    return df.where(~blank), df.where(blank).withColumn("reason", F.lit(reason))


def default_ticket_id(ticket_id: Column, query: Column) -> Column:
    """Given id, else ``ticket_`` and eight hex digits of the query's digest."""
    made = F.concat(F.lit("ticket_"), F.substring(F.md5(query.cast("binary")), 1, 8))
    return F.coalesce(F.nullif(ticket_id, F.lit("")), made)


CLASSIFICATION = T.StructType(
    [
        T.StructField("intent", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("sentiment", T.StringType()),
        T.StructField("urgency", T.StringType()),
        T.StructField("urgency_reason", T.StringType()),
        T.StructField("is_high_risk", T.BooleanType()),
    ]
)


def parse_classification(raw: Column) -> Column:
    """Raw classifier JSON -> normalised struct, with the safe fallback on any error.

    A variant keeps the difference between a JSON null and a missing key, which the rules
    need: a null confidence is an error, a missing one is 0.8; a null word becomes the text
    ``none``; any non-empty string counts as a true flag.
    """
    doc = F.try_parse_json(raw)

    def field(key: str) -> Column:
        return F.try_variant_get(doc, f"$.{key}", "variant")

    def as_type(key: str, kind: str) -> Column:
        return F.try_variant_get(doc, f"$.{key}", kind)

    def word(key: str, default: str, fold: bool = True) -> Column:
        value = (
            F.when(field(key).isNull(), F.lit(default))
            .when(F.is_variant_null(field(key)), F.lit("None"))
            .otherwise(as_type(key, "string"))
        )
        value = tx.strip(value)
        return F.lower(value) if fold else value

    number = F.when(field("confidence").isNull(), F.lit(0.8)).otherwise(
        as_type("confidence", "double")
    )
    kind = F.schema_of_variant(field("is_high_risk"))
    as_string = as_type("is_high_risk", "string")
    flag = (
        F.when(field("is_high_risk").isNull() | F.is_variant_null(field("is_high_risk")), F.lit(False))
        .when(kind == "BOOLEAN", as_type("is_high_risk", "boolean"))
        .when(kind == "STRING", F.length(as_string) > 0)
        .when(kind.startswith("OBJECT") | kind.startswith("ARRAY"), ~as_string.isin("{}", "[]"))
        .otherwise(as_type("is_high_risk", "double") != 0)
    )
    parsed = F.struct(
        word("intent", "other").alias("intent"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), number)).alias("confidence"),
        word("sentiment", "neutral").alias("sentiment"),
        word("urgency", "medium").alias("urgency"),
        word("urgency_reason", "Standard classification", fold=False).alias("urgency_reason"),
        F.coalesce(flag, F.lit(False)).alias("is_high_risk"),
    )
    is_object = F.coalesce(F.schema_of_variant(doc).startswith("OBJECT"), F.lit(False))
    good = is_object & number.isNotNull()
    return F.when(good, parsed).otherwise(fallback_classification("invalid classification"))


def fallback_classification(reason: str) -> Column:
    return F.struct(
        F.lit("other").alias("intent"),
        F.lit(0.5).alias("confidence"),
        F.lit("neutral").alias("sentiment"),
        F.lit("high").alias("urgency"),
        F.lit(f"Classification fallback due to error: {reason}").alias("urgency_reason"),
        F.lit(True).alias("is_high_risk"),
    )


def lookup_by_id(wanted: DataFrame, table: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows found, wanted ids that the table lacks)."""
    return wanted.join(table, key, "inner"), wanted.join(table.select(key), key, "left_anti")


def skip_cached(todo: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """Resume: the rows whose key is not in the cache yet."""
    return todo.join(cache.select(key), key, "left_anti")
