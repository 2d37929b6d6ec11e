"""Shared pieces of the training-data operators: column idioms, permutations, stored rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketloom.session import materialise

#: The words of a text: maximal runs without ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"
#: Rounds of the index permutation; about six per bit are the proven figure, a few per bit
#: already spread neighbours evenly.
ROUNDS = 32
#: Row ids: partition in the high bits, place in the partition in the low 33.
ROW_BITS = 33

__all__ = [
    "ROUNDS", "ROW_BITS", "WORD", "join_keys", "keyed", "materialise", "permuted", "read", "same_key", "spare_name",
    "word_count", "with_row_ids",
]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def spare_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not use yet (compared without case, as Spark does)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_row_ids(df: DataFrame, name: str, label: str) -> DataFrame:
    """Store ``df`` with a row id: ``(partition << 33) + place in the partition``.

    The ids are fixed by the stored table, so every later read sees the same ones, whatever
    happens to executors. Repeated rows get different ids.
    """
    return materialise(df.withColumn(name, F.monotonically_increasing_id()), label)


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, hash, text: an identity that repeated rows share and copies under other ids do not."""
    return docs.select(
        F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("hash"), F.col(text_col).alias("text")
    )


def join_keys(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({"id": "_id", "hash": "_hash"})


def same_key() -> Column:
    return F.col("id").eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("_hash"))


def permuted(index: Column, size: Column, seed: int, *tweak: Column, back: bool = False) -> Column:
    """Place of ``index`` under a pseudorandom permutation of ``0 .. size - 1``; ``back`` inverts it.

    Swap-or-not: each round pairs x with (key - x) mod size and swaps the pair when a hash
    bit of the larger member says so. A round is its own inverse, so the whole is a
    permutation for every size, needs no table, and is one expression per row; the rounds
    in reverse order are the inverse.
    """
    size = F.greatest(size, F.lit(1))

    def swap(x: Column, i: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(F.lit(seed), i, *tweak), size) - x, size)
        coin = F.xxhash64(F.lit(~seed), i, F.greatest(x, other), *tweak)
        return F.when(coin.bitwiseAND(F.lit(1)) == 1, other).otherwise(x)

    return F.aggregate(F.array(*[F.lit(i) for i in (reversed(range(ROUNDS)) if back else range(ROUNDS))]), index.cast("long"), swap)
