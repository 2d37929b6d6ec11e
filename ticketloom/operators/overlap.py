"""Near-duplicate texts of two tables: an exact set-similarity join over word shingles.

Texts become sets of five-word shingles, and equal sets are folded into one, so copies are
compared once. All shingles have one order: by digest, but the most frequent ones last. Two
sets with a Jaccard similarity of t or more agree in one at least of the first
``n - ceil(t * n) + 1`` shingles of each, so only sets that share one of these meet; sizes and
places in the order rule out most of those. The sets of the pairs that are left are compared
in full. Any order gives the same pairs; the frequent shingles stand last so that a passage of
many texts seldom brings two of them together.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ticketloom.session import materialise, scratch_scope

WORDS, THRESHOLD = 5, 0.8
#: What words are made of.
WORD = r"[^\x20\x09-\x0D]"
#: Most frequent shingles that stand last; all tasks hold them.
FREQUENT = 200_000
#: Keeps ceil() of a product of decimals from rounding up.
TINY = 1e-9


def shingles(text: Column, words: int = WORDS) -> Column:
    """Distinct digests of all runs of ``words`` words, sorted; of fewer words, of the whole."""
    found = F.regexp_extract_all(F.lower(text), F.lit(rf"{WORD}+"), F.lit(0))

    def runs(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(w) - words, F.lit(0)))
        # A digest of the digests of its words: a word is hashed once, and what is missing at the end is skipped.
        all_runs = F.transform(starts, lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(words)]))
        return F.when(F.size(w) > 0, F.array_sort(F.array_distinct(all_runs)))

    return F.get(F.transform(F.array(F.transform(found, lambda w: F.xxhash64(w))), runs), F.lit(0))


def _sets(df: DataFrame, key: str, text: str, words: int, name: str) -> tuple[DataFrame, DataFrame]:
    """Stored (key, set_id) and (set_id, tokens); texts without words are in neither."""
    # A filter on the shingles would be pushed down and compute them a second time.
    df = df.where(F.col(text).rlike(WORD))
    rows = df.select(F.col(key).alias("key"), shingles(F.col(text), words).alias("tokens"))
    rows = materialise(rows.withColumn("set_id", F.unhex(F.md5(F.to_json("tokens").cast("binary")))), f"{name}-rows")
    sets = rows.groupBy("set_id").agg(F.any_value("tokens").alias("tokens"))
    return rows.select("key", "set_id"), materialise(sets, f"{name}-sets")


def _frequent(sets: DataFrame) -> np.ndarray:
    """The ``FREQUENT`` shingles that most sets hold, of those that two hold at least; sorted.

    An ordered limit would have every task send as many rows to the driver. Instead the number of
    shingles per number of sets tells from where on they are taken, and of those at that edge, numbers
    by their leading bits tell up to where; only the shingles that are taken are collected.
    """
    with scratch_scope(sets.sparkSession, "frequent"):
        tokens = sets.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
        tokens = materialise(tokens.where("n > 1"), "token-counts")
        edge, room = _edge(tokens, "n", F.desc("n"), FREQUENT)
        if edge is not None:
            tied = tokens.where(F.col("n") == edge).withColumn("lead", F.shiftright("token", 48))
            last, _ = _edge(tied, "lead", F.asc("lead"), room)
            tied = tied if last is None else tied.where(F.col("lead") < last)
            tokens = tokens.where(F.col("n") > edge).unionByName(tied.drop("lead"))
        found = tokens.select("token").toArrow()
    return np.sort(found.column("token").to_numpy())


def _edge(rows: DataFrame, column: str, order: Column, room: int) -> tuple[int | None, int]:
    """The first value, in that order, whose rows do not fit into ``room`` with those before it, if any,
    and the room that is left there."""
    upto = F.sum("rows").over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    sums = rows.groupBy(column).agg(F.count(F.lit(1)).alias("rows")).withColumn("upto", upto)
    over = sums.where(F.col("upto") > room).orderBy("upto").first()
    return (over[column], room - (over["upto"] - over["rows"])) if over else (None, 0)


def _prefixes(sets: DataFrame, last: Broadcast, threshold: float, side: str) -> DataFrame:
    """token, and for each set with it in its prefix: id, size, place (from 1)."""

    @F.pandas_udf("array<bigint>")
    def prefix(tokens: pd.Series) -> pd.Series:
        frequent = last.value

        def first(own: np.ndarray) -> np.ndarray:
            own = np.asarray(own, dtype="int64")
            late = np.zeros(len(own), dtype=bool)
            if len(frequent):
                late = frequent[np.minimum(np.searchsorted(frequent, own), len(frequent) - 1)] == own
            keep = len(own) - math.ceil(threshold * len(own) - TINY) + 1
            return np.concatenate([own[~late], own[late]])[:keep]

        return tokens.map(first)

    first = sets.select("set_id", F.size("tokens").alias("size"), F.posexplode(prefix("tokens")).alias("at", "token"))
    return first.select(
        "token", F.col("set_id").alias(f"{side}_set"), F.col("size").alias(f"{side}_size"), (F.col("at") + 1).alias(f"{side}_at"))


def similar_sets(left: DataFrame, right: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(left_set, right_set, jaccard) of all pairs of sets (set_id, tokens) of ``threshold`` or more."""
    last = left.sparkSession.sparkContext.broadcast(_frequent(left.unionByName(right)))
    # Between plain tables, so that a shingle that many sets have in front is split in the join.
    a, b = _prefixes(left, last, threshold, "left"), _prefixes(right, last, threshold, "right")
    size = F.col("left_size") + F.col("right_size")
    rest = F.least(F.col("left_size") - F.col("left_at"), F.col("right_size") - F.col("right_at")) + 1
    may = (
        (F.least("left_size", "right_size") >= threshold * F.greatest("left_size", "right_size") - TINY)
        & (rest >= threshold / (1 + threshold) * size - TINY)
    )
    pairs = materialise(a.join(b, "token").where(may).select("left_set", "right_set").distinct(), "set-pairs")
    own = left.select(F.col("set_id").alias("left_set"), F.col("tokens").alias("left_tokens"))
    other = right.select(F.col("set_id").alias("right_set"), F.col("tokens").alias("right_tokens"))
    met = pairs.join(own, "left_set").join(other, "right_set")
    common = F.size(F.array_intersect("left_tokens", "right_tokens"))
    union = F.size("left_tokens") + F.size("right_tokens") - F.col("common")
    found = met.withColumn("common", common).select("left_set", "right_set", (F.col("common") / union).alias("jaccard"))
    return found.where(F.col("jaccard") >= threshold - TINY)


def near_holdout(
    golden: DataFrame, index: DataFrame, threshold: float = THRESHOLD, words: int = WORDS,
    key: str = "ticket_id", text: str = "ticket_text",
) -> DataFrame:
    """(key, case_key, jaccard) of every golden ticket with a near-duplicate in the index.

    The case is the most similar one, of several the least key. Texts without words have none.
    """
    rows, sets = _sets(golden, key, text, words, "golden")
    cases, case_sets = _sets(index, "case_key", "document", words, "index")
    near = similar_sets(sets, case_sets, threshold)
    least = cases.groupBy(F.col("set_id").alias("right_set")).agg(F.min("key").alias("case_key"))
    best = near.join(least, "right_set").groupBy(F.col("left_set").alias("set_id")).agg(
        F.min(F.struct((-F.col("jaccard")).alias("far"), "case_key")).alias("best"))
    return rows.join(materialise(best, "nearest-sets"), "set_id").select(
        F.col("key").alias(key), F.col("best.case_key").alias("case_key"), F.round(-F.col("best.far"), 6).alias("jaccard"))


def without_near(
    index: DataFrame, golden: DataFrame, threshold: float = THRESHOLD, words: int = WORDS, text: str = "ticket_text",
) -> DataFrame:
    """The index rows that no golden ticket comes near; for an index that a score is measured on."""
    _, sets = _sets(golden.withColumn("__key", F.lit(0)), "__key", text, words, "golden")
    cases, case_sets = _sets(index, "case_key", "document", words, "index")
    close = similar_sets(case_sets, sets, threshold).select(F.col("left_set").alias("set_id")).distinct()
    gone = materialise(cases.join(close, "set_id", "left_semi").select(F.col("key").alias("case_key")).distinct(), "near-cases")
    return index.join(gone, "case_key", "left_anti")
