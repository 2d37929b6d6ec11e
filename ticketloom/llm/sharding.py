"""Uniform shuffle into shards of exact sizes, through a communication matrix.

How many rows of a sender go to a shard is drawn first, as a hypergeometric matrix: its row
sums are the senders' row counts, its column sums the shard sizes (at most one apart). Each
sender then permutes its rows and deals them by its line of the matrix, rows are exchanged,
and each shard permutes what it got. Every assignment of rows to places is equally likely up
to the pseudorandom permutations, and no count is left to chance.

A sender is a run of the partitions that the stored input has; there are at most ``SENDERS``
of them, so the matrix is small at every scale. Permutations are arithmetic on row numbers:
neither a sender nor a shard is ever sorted in one task, and a common text or key plays no
part. All steps are columns; the only rows that move are those of the exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketloom.llm.common import ROW_BITS, permuted, read, spare_name, with_row_ids

SHARDS = 40
SENDERS = 64
EXCHANGE_ROWS = 1 << 16


def _log_factorial(x: Column) -> Column:
    """Exact up to 20, Stirling's series beyond (relative error below 1e-12)."""
    x = x.cast("double")
    series = (
        x * F.log(x) - x + 0.5 * F.log(x * 6.283185307179586) + 1 / (12 * x) - 1 / (360 * x * x * x)
    )
    small = F.greatest(F.least(x, F.lit(20.0)), F.lit(0.0)).cast("int")
    return F.when(x <= 20, F.log(F.factorial(small).cast("double"))).otherwise(series)


def hypergeometric(total: Column, marked: Column, drawn: Column, uniform: Column) -> Column:
    """Number of marked ones among ``drawn`` of ``total``, at the quantile ``uniform``.

    Inversion over eight standard deviations around the mean (all of the range, if that is
    narrower); what lies beyond is below the precision of a double.
    """
    total, marked, drawn = (c.cast("long") for c in (total, marked, drawn))
    mean = marked * (drawn / F.greatest(total, F.lit(1)))
    spread = F.sqrt(F.greatest(mean * (1 - marked / F.greatest(total, F.lit(1))), F.lit(0.0))) * 8 + 20
    low = F.greatest(F.lit(0).cast("long"), drawn - (total - marked), F.floor(mean - spread))
    high = F.greatest(F.least(marked, drawn, F.ceil(mean + spread)), low)
    # One struct, so that the bounds are worked out once and not per step.
    given = F.struct(
        total.alias("t"), marked.alias("m"), drawn.alias("d"), low.alias("low"), high.alias("high"),
        F.greatest(low, F.least(high, F.floor(mean))).alias("mid"), uniform.alias("u"),
    )

    def height(g: Column, k: Column) -> Column:
        return -(
            _log_factorial(k) + _log_factorial(g["m"] - k) + _log_factorial(g["d"] - k)
            + _log_factorial(g["t"] - g["m"] - g["d"] + k)
        )

    def draw(g: Column) -> Column:
        top = F.transform(F.array(g["mid"]), lambda k: height(g, k))
        masses = F.transform(
            top, lambda peak: F.transform(
                F.sequence(g["low"], g["high"]), lambda k: F.exp(height(g, k) - peak)
            )
        )
        sums = F.transform(masses, lambda m: F.struct(
            m.alias("m"), F.aggregate(m, F.lit(0.0), lambda a, x: a + x).alias("all"),
        ))
        start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).cast("long").alias("below"))
        counted = F.transform(sums, lambda s: F.aggregate(
            s["m"], start,
            lambda a, x: F.struct(
                (a["sum"] + x).alias("sum"),
                (a["below"] + F.when(a["sum"] + x < g["u"] * s["all"], F.lit(1)).otherwise(F.lit(0)).cast("long")).alias("below"),
            ),
        )["below"])
        return F.least(g["low"] + F.get(counted, F.lit(0)), g["high"])

    return F.get(F.transform(F.array(given), draw), F.lit(0)).cast("long")


def communication_matrix(spark, sender_rows: list[int], shard_rows: list[int], seed: int) -> DataFrame:
    """sender, counts (rows for each shard), bases (rows that earlier senders put there).

    Senders are halved again and again; at each cut the shares of the left half are drawn
    shard by shard from what the shards still take. Both lists are short and bounded.
    """
    levels = max(1, (len(sender_rows) - 1).bit_length())
    width = 1 << levels
    before = [0]
    for n in sender_rows + [0] * (width - len(sender_rows)):
        before.append(before[-1] + n)
    prefix = F.array(*[F.lit(n) for n in before]).cast("array<long>")
    start = [F.lit(0).cast("long").alias("sender"), F.array(*[F.lit(n) for n in shard_rows]).alias("counts")]
    level = spark.range(1).select(*start, F.array(*[F.lit(0).cast("long")] * len(shard_rows)).alias("bases"))
    level = level.withColumn("counts", F.col("counts").cast("array<long>"))
    for depth in range(levels):
        span = width >> depth
        first = F.col("sender") * span
        left_rows = F.get(prefix, first + span // 2) - F.get(prefix, first)
        total = F.get(prefix, first + span) - F.get(prefix, first)

        def deal(state: Column, j: Column) -> Column:  # used before the next level is built
            have = F.get(F.col("counts"), j)
            coin = F.pmod(F.xxhash64(F.lit(seed), F.lit(depth), F.col("sender"), j), F.lit(1 << 52))
            took = hypergeometric(state["total"], have, state["drawn"], (coin + 0.5) / float(1 << 52))
            return F.get(F.transform(F.array(took), lambda t: F.struct(
                (state["total"] - have).alias("total"), (state["drawn"] - t).alias("drawn"),
                F.concat(state["left"], F.array(t)).alias("left"),
            )), F.lit(0))

        zero = F.struct(
            total.alias("total"), left_rows.alias("drawn"), F.array().cast("array<long>").alias("left")
        )
        shards = F.array(*[F.lit(j) for j in range(len(shard_rows))])
        level = level.withColumn("left", F.aggregate(shards, zero, deal)["left"])
        halves = F.array(
            F.struct((F.col("sender") * 2).alias("sender"), F.col("left").alias("counts"), F.col("bases")),
            F.struct(
                (F.col("sender") * 2 + 1).alias("sender"),
                F.zip_with("counts", "left", lambda a, b: a - b).alias("counts"),
                F.zip_with("bases", "left", lambda a, b: a + b).alias("bases"),
            ),
        )
        level = level.select(F.explode(halves).alias("half")).select("half.*")
    return level


def shard_rows(
    df: DataFrame, shards: int = SHARDS, shard: str = "shard", slot: str = "slot", seed: int = 10,
    exchange_rows: int = EXCHANGE_ROWS,
) -> DataFrame:
    """``df`` with a shard (0 .. shards - 1) and a gapless slot in it, exchanged by shard.

    Shard sizes are at most one apart (the first shards get the odd rows). Nulls, ties and
    repeated rows play no part: each row is dealt once by its place in the stored input. New
    columns replace columns of the same name. An empty table gives an empty result.
    """
    spark = df.sparkSession
    df = df.drop(shard, slot)
    row = spare_name(df, "row")
    stored = with_row_ids(df, row, "shard-input")
    part = F.shiftright(F.col(row), ROW_BITS)
    sizes = stored.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    by_part = Window.orderBy("part")  # one line per partition of the input, not per row
    number = F.row_number().over(by_part) - 1
    parts = sizes.withColumn(
        "sender", F.floor(number * SENDERS / F.greatest(F.count(F.lit(1)).over(Window.partitionBy()), F.lit(SENDERS)))
    )
    parts = parts.withColumn("before", F.coalesce(
        F.sum("n").over(Window.partitionBy("sender").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0),
    ))
    sent = {r["sender"]: r["n"] for r in parts.groupBy("sender").agg(F.sum("n").alias("n")).collect()}
    sender_rows = [sent.get(s, 0) for s in range(max(sent, default=0) + 1)]
    everything = sum(sender_rows)
    sizes_of = [everything // shards + (j < everything % shards) for j in range(shards)]
    matrix = communication_matrix(spark, sender_rows, sizes_of, seed)
    ends = F.transform(
        F.sequence(F.lit(1), F.lit(shards)),
        lambda j: F.aggregate(F.slice("counts", F.lit(1), j), F.lit(0).cast("long"), lambda a, x: a + x),
    )
    names = {c: spare_name(df, c) for c in ("_part", "_from", "_before", "_sent", "_sender", "bases", "ends")}
    col = {c: F.col(n) for c, n in names.items()}
    matrix = matrix.select(
        F.col("sender").alias(names["_sender"]), F.col("bases").alias(names["bases"]), ends.alias(names["ends"])
    )
    parts = parts.select(
        F.col("part").alias(names["_part"]), F.col("sender").alias(names["_from"]),
        F.col("before").alias(names["_before"]),
        F.sum("n").over(Window.partitionBy("sender")).alias(names["_sent"]),
    )
    local = F.col(row).bitwiseAND(F.lit((1 << ROW_BITS) - 1)) + col["_before"]
    place, took, at = (spare_name(df, c) for c in ("_place", "_took", "_at"))
    # Both are small at every scale, and the rows themselves need not move to meet them: four
    # numbers for each task of the input, and SENDERS lines of 2 * shards numbers at most.
    dealt = stored.join(F.broadcast(parts), part == col["_part"])
    dealt = dealt.join(F.broadcast(matrix), col["_from"] == col["_sender"])
    dealt = dealt.withColumn(place, permuted(local, col["_sent"], seed + 1, col["_from"]))
    dealt = dealt.withColumn(took, F.size(F.filter(col["ends"], lambda e: e <= F.col(place))))
    earlier = F.when(F.col(took) > 0, F.get(col["ends"], F.col(took) - 1)).otherwise(0)
    dealt = dealt.withColumn(at, F.get(col["bases"], F.col(took)) + F.col(place) - earlier)
    odd = everything % shards
    size = F.lit(everything // shards).cast("long") + F.when(F.col(took) < odd, 1).otherwise(0)
    dealt = dealt.select(
        *df.columns, F.col(took).cast("int").alias(shard),
        permuted(F.col(at), size, seed + 2, F.col(took)).alias(slot),
    )
    # The exchange: a shard is several tasks when it has more than ``exchange_rows`` rows.
    return dealt.repartition(F.col(shard), F.floor(F.col(slot) / exchange_rows))


def sharded_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every document.

    ``size`` is the UTF-8 bytes of the text plus 16 (16 for null or empty). The law is
    ``rows``: shard sizes are at most one row apart; ``grown_shard`` is therefore null.
    """
    digest = docs.select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
    )
    return shard_rows(digest, shards).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op10_sharding(spark, sf_dir: str) -> DataFrame:
    return sharded_documents(read(spark, sf_dir, "documents"))
