"""Mixing sources to target weights by packed blocks and index permutations.

The words of a source, its documents one after the other in a hashed order, are packed into
blocks of a fixed number of words. Output slots, each one block long, are dealt to the
sources: the counts per output shard are multinomial draws, conditioned on the totals that
the targets ask for (independent draws would miss the targets by their noise and could pass
the limit of two uses). Each slot finds its block through a pseudorandom permutation of the
source's block numbers, a new one for every pass, and is joined to it by number.

All steps are columns, joins and grouped sums. Texts are read once for their sizes and are
not shuffled. Offsets within a source are two-level prefix sums over hashed buckets, so a
source with a third of all rows has that many more buckets, not a larger task. The only
table handled as a whole is the list of distinct sources, the specification of the mixture.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketloom.llm.common import materialise, permuted, read, spare_name, with_row_ids, word_count

WEIGHTS = (5, 2, 1)
BLOCK_WORDS = 1024
SHARD_SLOTS = 1024
BUCKET_ROWS = 4096
SPLIT_SLOTS = 4096


def source_targets(sizes: DataFrame, weights=WEIGHTS, budget: float = 1.5, limit: float = 2.0) -> DataFrame:
    """source, source_size -> rank, weight and target of every source.

    Sources in code-point order, null last, get the weights in turn. ``budget`` times all
    words are shared by weight; a target stops at ``limit`` times its source, and what is
    over goes to the others by weight until no target is above. That level is
    max over k of (total - the k lowest limits) / (weights of the rest), the sources sorted
    by limit per weight.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("rank", F.row_number().over(order) - 1)
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    capped = ranked.select(
        "*", F.get(cycle, F.col("rank") % len(weights)).alias("weight"),
        (F.col("source_size") * limit).alias("most"),
    )
    by_ratio = Window.orderBy((F.col("most") / F.col("weight")).asc(), "rank")
    everything = Window.partitionBy()
    before = F.coalesce(F.sum("most").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    level = (F.sum("source_size").over(everything) * budget - before) / rest
    return capped.withColumn("level", level).select(
        "source", "rank", "source_size",
        F.least("most", F.max("level").over(everything) * F.col("weight")).alias("target"),
    )


def _block_words(block: Column) -> Column:
    return F.when(block == F.col("blocks") - 1, F.col("last_words")).otherwise(F.col("block_words"))


def output_slots(targets: DataFrame, block_words: int, shard_slots: int, seed: int) -> DataFrame:
    """rank, pass, block, words, shard, slot of every output slot.

    A source's slots are whole passes over its blocks and a part of one more pass; the last
    slot is cut so that the words of the source add up to its rounded target.
    """
    quota = F.floor(F.col("target") + 0.5)
    size = F.greatest(F.col("source_size"), F.lit(1))
    plan = targets.filter("source_size > 0").select(
        "rank", F.lit(block_words).cast("long").alias("block_words"),
        F.ceil(F.col("source_size") / block_words).alias("blocks"),
        F.floor(quota / size).alias("passes"), F.pmod(quota, size).alias("part"),
        "source_size",
    )
    plan = plan.withColumn("last_words", F.col("source_size") - (F.col("blocks") - 1) * block_words)
    # Where the short last block of a source stands in the order of the partial pass.
    plan = plan.withColumn("short_at", permuted(F.col("blocks") - 1, F.col("blocks"), seed, F.col("rank"), F.col("passes")))
    gap = block_words - F.col("last_words")
    straight = F.ceil(F.col("part") / block_words)
    plan = plan.withColumn(
        "part_slots",
        F.when(straight <= F.col("short_at"), straight).otherwise(F.ceil((F.col("part") + gap) / block_words)),
    ).withColumn("slots", F.col("passes") * F.col("blocks") + F.col("part_slots"))
    order = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    plan = plan.withColumn("first", F.coalesce(F.sum("slots").over(order), F.lit(0))).withColumn(
        "all_slots", F.sum("slots").over(Window.partitionBy())
    )
    runs = plan.filter("slots > 0").withColumn(
        "run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("slots") - 1) / SPLIT_SLOTS)))
    )
    # A hot source is many runs; spread them before they are opened. The number is given, as
    # the few bytes of the runs would otherwise be gathered in one task.
    tasks = int(targets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slots = runs.repartition(tasks, "rank", "run").withColumn(
        "number",
        F.explode(F.sequence(
            F.col("run") * SPLIT_SLOTS,
            F.least((F.col("run") + 1) * SPLIT_SLOTS, F.col("slots")) - 1,
        )),
    )
    slots = slots.select(
        "*", F.floor(F.col("number") / F.col("blocks")).alias("pass"), F.pmod("number", "blocks").alias("place"),
        permuted(F.col("first") + F.col("number"), F.col("all_slots"), seed + 1).alias("at"),
    )
    slots = slots.withColumn(
        "block", permuted(F.col("place"), F.col("blocks"), seed, F.col("rank"), F.col("pass"), back=True)
    )
    filled = F.col("place") * block_words - F.when(F.col("place") > F.col("short_at"), gap).otherwise(0)
    words = _block_words(F.col("block"))
    return slots.select(
        "rank", "pass", "block",
        F.when(F.col("pass") < F.col("passes"), words)
        .otherwise(F.least(words, F.col("part") - filled)).alias("words"),
        F.floor(F.col("at") / shard_slots).alias("shard"), F.pmod(F.col("at"), F.lit(shard_slots)).alias("slot"),
    )


def packed_pieces(rows: DataFrame, targets: DataFrame, buckets: int, block_words: int) -> DataFrame:
    """Pack rows (row, order_hash, source, size) into blocks: one piece per row and block.

    The rows of a source follow each other by (order_hash, row). An offset is the total of
    the hash buckets before it plus the running total inside its bucket.
    """
    bucketed = rows.filter("size > 0").withColumn("bucket", F.pmod("order_hash", F.lit(buckets)))
    totals = bucketed.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("bucket_start", F.coalesce(F.sum("bucket_size").over(before), F.lit(0)))
    totals = totals.join(targets.select(F.col("source").alias("s"), "rank"), F.col("source").eqNullSafe(F.col("s")))
    inside = Window.partitionBy("source", "bucket").orderBy("order_hash", "row")
    inside = inside.rowsBetween(Window.unboundedPreceding, -1)
    starts = bucketed.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).alias("r").join(
        totals.select(F.col("source").alias("s"), F.col("bucket").alias("b"), "bucket_start", "rank"),
        F.col("r.source").eqNullSafe(F.col("s")) & (F.col("r.bucket") == F.col("b")),
    ).select("row", "size", "rank", (F.col("bucket_start") + F.col("inside")).alias("start"))
    end = F.col("start") + F.col("size")
    pieces = starts.withColumn(
        "block", F.explode(F.sequence(F.floor(F.col("start") / block_words), F.floor((end - 1) / block_words)))
    )
    first = F.greatest("start", F.col("block") * block_words)
    return pieces.select(
        "row", "rank", "block", (first - F.col("start")).alias("from_word"),
        (first - F.col("block") * block_words).alias("in_block"),
        (F.least(end, (F.col("block") + 1) * block_words) - first).alias("piece_words"),
    )


def mix_rows(
    rows: DataFrame, weights=WEIGHTS, budget: float = 1.5, limit: float = 2.0,
    block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = 20,
) -> tuple[DataFrame, DataFrame]:
    """The mix of rows (row, order_hash, source, size): targets, and what fills the slots.

    The second table has one line per row, block and use: row, pass, shard, slot, from_word,
    n_words (the words ``from_word .. from_word + n_words - 1`` of the row stand in that
    slot). ``rows`` is read several times and should be stored.
    """
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes, weights, budget, limit)
    buckets = max(1, -(-rows.count() // BUCKET_ROWS))
    pieces = packed_pieces(rows, targets, buckets, block_words)
    slots = output_slots(targets, block_words, shard_slots, seed)
    used = F.least(F.col("in_block") + F.col("piece_words"), F.col("words")) - F.col("in_block")
    # The opened runs look small to the planner and are as many as the blocks: never broadcast.
    placed = pieces.hint("merge").join(slots.hint("merge"), ["rank", "block"]).withColumn("n_words", used).filter("n_words > 0")
    return targets, placed.select("row", "pass", "shard", "slot", "from_word", "n_words")


def mixture(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document.

    ``size`` counts words, ``taken`` the words that the mix takes, repeats counted. A null
    or blank text has size 0 and is not taken; a null source is a source of its own. Repeated
    rows are documents of their own. Only doc_id, text and source are read; an empty table
    gives an empty result. Depends on the rows alone, so reruns agree.
    """
    rows = with_row_ids(
        docs.select(
            "doc_id", "source", word_count(F.col("text")).alias("size"),
            F.xxhash64("doc_id", "text").alias("order_hash"),
        ), "row", "mix-sizes",
    )
    targets, placed = mix_rows(rows, **options)
    taken = placed.groupBy("row").agg(F.sum("n_words").alias("words"))
    known = targets.select(F.col("source").alias("s"), "source_size", "target")
    return (
        rows.join(taken, "row", "left")
        .join(known, F.col("source").eqNullSafe(F.col("s")))
        .select("doc_id", "size", "source_size", "target", F.coalesce("words", F.lit(0)).alias("taken"))
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix, with the columns of ``docs``.

    One row per document and pass that takes words of it. A pass that takes all of a document
    keeps its text as it is; otherwise the text is what the pass takes, words with the blanks
    after them, in their order. n_chars, where there is such a column, follows the text.
    Rows without words are not taken.
    """
    row, parts = spare_name(docs, "row"), spare_name(docs, "parts")
    stored = with_row_ids(docs, row, "mix-documents")
    rows = stored.select(
        F.col(row).alias("row"), "source", word_count(F.col("text")).alias("size"),
        F.xxhash64("doc_id", "text").alias("order_hash"),
    )
    rows = materialise(rows, "mix-sizes")
    _, placed = mix_rows(rows, **options)
    passes = placed.join(rows.select("row", "size"), "row").groupBy("row", "size", "pass").agg(
        F.sum("n_words").alias("words"),
        F.sort_array(F.collect_list(F.struct("from_word", "n_words"))).alias("parts"),
    )
    passes = passes.select(
        F.col("row").alias(row), F.when(F.col("words") < F.col("size"), F.col("parts")).alias(parts)
    )
    bare = F.regexp_replace("text", r"^[\x20\x09-\x0D]+", "")
    words = F.split(bare, r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")
    cut = F.array_join(
        F.flatten(F.transform(
            F.col(parts), lambda p: F.slice(words, (p["from_word"] + 1).cast("int"), p["n_words"].cast("int"))
        )), "",
    )
    text = F.when(F.col(parts).isNull(), F.col("text")).otherwise(cut)
    out = stored.join(passes, row).withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def op2_source_mixing(spark, sf_dir: str) -> DataFrame:
    return mixture(read(spark, sf_dir, "documents"))
