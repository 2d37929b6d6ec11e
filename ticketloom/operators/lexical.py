"""BM25 over an inverted index of cases, and rankings fused by reciprocal rank.

The index holds for every (case, term) what one occurrence of the term in a query adds to the
case's score, as a whole number of millionths: sums of whole numbers do not depend on their
order, so equal scores are equal wherever they were added up. It is stored by case, and
searched as vectors are (``blocks``): a tile of cases is inverted in the task that searches
it, so a term that every case holds is spread over all tiles, no pair is ever a row, and at
most k rows per query leave a task.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ticketloom.config import TriageConfig
from ticketloom.operators import blocks, search
from ticketloom.session import materialise

#: Saturation of repeats, weight of the length, and score units.
K1, B, UNITS = 1.2, 0.75, 1_000_000
#: Added to every rank, so that the first places do not decide alone.
RANK_OFFSET = 60


def terms(text: Column) -> Column:
    """Runs of letters and digits, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def inverted_index(cases: DataFrame, text: str = "document") -> DataFrame:
    """case_key, terms, impacts: the distinct terms of each case and what they add to its score.

    With n cases, the impact of a term that df of them hold is
    ``ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean length))``.
    A case without terms is not in the index, but counts among the n. The terms of a case move
    once, as one row, and are counted and put together where they arrive; only if the table of all
    terms is too large to be sent to every task are the counts stored and joined to it, so that a
    term that every case holds is split in the join.
    """
    known = cases.select("case_key", terms(F.coalesce(F.col(text), F.lit(""))).alias("terms"))
    known = materialise(known.withColumn("length", F.size("terms")), "case-terms")
    n, total = known.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
    spread = known.select(F.explode(F.array_distinct("terms")).alias("term")).groupBy("term")
    spread = materialise(spread.agg(F.count(F.lit(1)).cast("double").alias("df")), "term-spread")
    counts = known.repartition("case_key").select("case_key", "length", F.explode("terms").alias("term"))
    counts = counts.groupBy("case_key", "length", "term").agg(F.count(F.lit(1)).cast("double").alias("tf"))
    sent = blocks.small_side(spread)
    if sent is spread:
        counts = materialise(counts, "term-counts")
    rarity = F.log(F.lit(1.0) + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = F.col("tf") + K1 * ((1 - B) + B * F.col("length").cast("double") / F.lit(total / n if n else 1.0))
    impact = F.floor(UNITS * (rarity * (F.col("tf") * (K1 + 1) / norm)) + 0.5).cast("bigint")
    rows = counts.join(sent, "term").select("case_key", F.struct("term", impact.alias("impact")).alias("t"))
    per_case = rows.groupBy("case_key").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return materialise(per_case.select(
        "case_key", F.col("t.term").alias("terms"), F.col("t.impact").alias("impacts")), "inverted-index")


def query_terms(queries: DataFrame) -> DataFrame:
    """query_id, terms, times: the distinct terms of each query (query_id, text)."""
    found = queries.select("query_id", F.explode(terms(F.col("text"))).alias("term"))
    counted = found.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("n"))
    per_query = counted.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("term", "n"))).alias("t"))
    return per_query.select("query_id", F.col("t.term").alias("terms"), F.col("t.n").alias("times"))


class _Scores(blocks.Best):
    """The k best cases per query of a chunk. Queries that ask a tile the same are scored once; words stay
    in Arrow, only distinct ones are texts here."""

    def __init__(self, q: pa.Table, k: int):
        super().__init__(q, k, "score")
        asked = q.column("terms").combine_chunks()
        words = asked.flatten().dictionary_encode()
        self.words, codes = words.dictionary.to_pylist(), words.indices.to_pylist()
        ends = asked.offsets.to_numpy() - asked.offsets[0].as_py()
        pairs = list(zip(codes, q.column("times").combine_chunks().flatten().to_pylist()))
        self.asked = [pairs[a:b] for a, b in zip(ends[:-1], ends[1:])]

    def add(self, c: pa.Table) -> None:
        c = c.take(pa.array(np.argsort(blocks.values(c, "case_key"), kind="stable")))
        held = c.column("terms").combine_chunks()
        words = held.flatten().dictionary_encode()
        number = {name: i for i, name in enumerate(words.dictionary.to_pylist())}
        codes = words.indices.to_numpy()
        owner = np.repeat(np.arange(c.num_rows), np.diff(held.offsets.to_numpy()))
        order = np.argsort(codes, kind="stable")
        owner, impact = owner[order], c.column("impacts").combine_chunks().flatten().to_numpy()[order]
        ends = np.searchsorted(codes[order], np.arange(len(number) + 1))
        most = np.maximum.reduceat(impact, ends[:-1]) if len(impact) else impact
        here = [number.get(w, -1) for w in self.words]
        same: dict[tuple, list[int]] = {}
        for i, pairs in enumerate(self.asked):
            own = tuple((here[w], n) for w, n in pairs if here[w] >= 0)
            if own and sum(n * most[at] for at, n in own) >= self.floor[i]:
                same.setdefault(own, []).append(i)
        score, found = np.empty(c.num_rows, dtype="int64"), []
        for own, rows in same.items():
            score.fill(0)
            for at, n in own:  # a case has one posting of a term
                score[owner[ends[at]:ends[at + 1]]] += n * impact[ends[at]:ends[at + 1]]
            hits = np.flatnonzero(score >= max(1, self.floor[rows].min()))
            if len(hits) > self.k:
                hits = hits[score[hits] >= np.partition(score[hits], len(hits) - self.k)[len(hits) - self.k]]
            hits = hits[np.lexsort((hits, -score[hits]))][:self.k]
            if len(hits):
                found.append((np.repeat(rows, len(hits)), np.tile(hits, len(rows)), np.tile(score[hits], len(rows))))
        if found:
            row, col, best = (np.concatenate(parts) for parts in zip(*found))
            order = np.argsort(row, kind="stable")
            self.merge(c, row[order], col[order], best[order])


def bm25_search(queries: DataFrame, index: DataFrame, k: int, cfg: TriageConfig = TriageConfig()) -> DataFrame:
    """(query_id, case_key, score, hit_rank): the k best cases of each query (query_id, text) with a
    term in common; equal scores by case key. A term that a query repeats counts as often.

    Queries of equal terms are searched once, wherever they lie; the hits then meet their ids."""
    ask = F.md5(F.to_json(F.struct("terms", "times")))
    asked = materialise(query_terms(queries).withColumn("ask", ask), "query-terms")
    each = asked.groupBy("ask").agg(F.any_value("terms").alias("terms"), F.any_value("times").alias("times"))
    pairs = blocks.meet(
        materialise(each.withColumnRenamed("ask", "query_id"), "distinct-queries"), index, None,
        "query_id string, case_key string, score bigint", cfg.query_rows, fold=lambda q: _Scores(q, k))
    best = Window.partitionBy("ask").orderBy(F.desc("score"), "case_key")
    hits = pairs.withColumnRenamed("query_id", "ask").withColumn("hit_rank", F.row_number().over(best).cast("bigint"))
    # One row per question, so that one that many ask can be split in the join.
    hits = hits.where(F.col("hit_rank") <= k).groupBy("ask").agg(
        F.collect_list(F.struct("case_key", "score", "hit_rank")).alias("hits"))
    return asked.select("query_id", "ask").join(materialise(hits, "question-hits"), "ask").select("query_id", F.inline("hits"))


def fuse_rankings(rankings: dict[str, DataFrame], k: int, offset: int = RANK_OFFSET) -> DataFrame:
    """(query_id, case_key, fused, hit_rank, one ``{name}_rank`` each): the k best of several rankings.

    ``rankings`` (query_id, case_key, rank) by name; a case gets ``1 / (offset + rank)`` from each
    that has it. Equal sums (to twelve places) go by case key.
    """
    names = list(rankings)
    rows = reduce(DataFrame.unionByName, [
        df.select("query_id", "case_key", F.col("rank").cast("bigint").alias("rank"), F.lit(name).alias("name"))
        for name, df in rankings.items()
    ])
    place = {n: F.max(F.when(F.col("name") == n, F.col("rank"))).alias(f"{n}_rank") for n in names}
    fused = rows.groupBy("query_id", "case_key").agg(*place.values())
    parts = [F.coalesce(1.0 / (offset + F.col(f"{n}_rank")), F.lit(0.0)) for n in names]
    fused = fused.withColumn("fused", F.round(reduce(lambda a, b: a + b, parts), 12))
    best = Window.partitionBy("query_id").orderBy(F.desc("fused"), "case_key")
    return fused.withColumn("hit_rank", F.row_number().over(best).cast("bigint")).where(F.col("hit_rank") <= k)


def hybrid_search(
    queries: DataFrame, index: DataFrame, inverted: DataFrame, cfg: TriageConfig = TriageConfig(), depth: int = 20,
) -> DataFrame:
    """The ``cfg.top_k`` best cases by vector and by terms together, for queries (query_id, text, vector).

    Both rankings give their first ``depth`` cases, without a filter by intent. A query without
    terms keeps its vector ranking.
    """
    dense = search.nearest(queries, index, depth, cfg)
    # By query, as the other ranking lies: the fusion then needs no shuffle of both.
    lexical = bm25_search(queries, inverted, depth, cfg).repartition("query_id")
    return fuse_rankings({
        "dense": dense.withColumnRenamed("cut_rank", "rank"), "lexical": lexical.withColumnRenamed("hit_rank", "rank"),
    }, cfg.top_k)
