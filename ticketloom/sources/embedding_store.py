"""Stored vectors keyed by ticket and text digest; only changed rows are embedded again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STORE_COLUMNS = ("ticket_id", "text_hash", "embedding")


def with_hash(df: DataFrame) -> DataFrame:
    return df.withColumn("text_hash", F.md5(F.col("ticket_text").cast("binary")))


def refresh(tickets: DataFrame, store: DataFrame, embed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Vectors of all tickets: stored ones where id and text agree, fresh ones elsewhere."""
    key = ["ticket_id", "text_hash"]
    wanted = with_hash(tickets.select("ticket_id", "ticket_text"))
    known = store.join(wanted.select(*key), key, "left_semi")
    todo = wanted.join(store.select(*key), key, "left_anti")
    return known.select(*STORE_COLUMNS).unionByName(embed(todo).select(*STORE_COLUMNS))
