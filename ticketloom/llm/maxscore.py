"""Exact top-k by inner product with MaxScore.

A term is a dimension, and its postings are the components of a shard's vectors in that
dimension, kept list by list. A query weighs each term by its own component; a term's bound is
the most it can add to a score in the shard. For each query the lists stand in order of their
bounds. Those last lists whose bounds together stay below the threshold - the k-th score found
so far - are non-essential: a vector must gain something in the others to be a hit. Only the
essential lists are traversed, a block of postings at a time; the others are probed, largest
bound first, for vectors that can still reach the threshold. Each block's hits raise the
threshold, so later blocks have fewer essential lists; once none is left the shard is done.
The shards' answers are merged by rank.

The query set is stated and meets all rows in blocks: one task holds one shard of vectors
and one chunk of queries, and at most k rows per query leave it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ticketloom.llm.common import materialise, read

SHARD_ROWS = 16_384
CHUNK_ROWS = 4096
#: Postings of a list that are traversed at a time, terms per probe.
BLOCK_ROWS, PROBE_TERMS = 1024, 8


def _matrix(column: pa.ChunkedArray) -> tuple[np.ndarray, int]:
    """List column -> rows of equal length (short ones end in zeros) and that length."""
    lists = column.combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    sizes = np.diff(lists.offsets.to_numpy())
    values = lists.flatten().to_numpy(zero_copy_only=False)
    wide = int(sizes.max(initial=0))
    out = np.zeros((len(sizes), wide), np.int64)
    out[np.arange(wide) < sizes[:, None]] = values
    return out, wide


def top_k(
    query_ids, queries, vec_ids, vectors, k: int, counts: dict | None = None,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """query_id, vec_id, score of the k best of ``vectors`` for each query, its own id left out.

    ``counts["postings"]`` adds up the postings that were read.
    """
    wide = max(queries.shape[1], vectors.shape[1])
    queries, vectors = (np.pad(m, ((0, 0), (0, wide - m.shape[1]))) for m in (queries, vectors))
    order = np.argsort(vec_ids, kind="stable")
    vec_ids, vectors = vec_ids[order], vectors[order]
    most = float(np.abs(queries).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * max(wide, 1)
    # Products and sums below 2**53 are exact in doubles, which have the fast product.
    kind = np.float64 if most < 2 ** 53 else np.int64
    queries, postings = queries.astype(kind), np.ascontiguousarray(vectors.T, kind)
    high, low = postings.max(axis=1, initial=0), postings.min(axis=1, initial=0)
    found, read = [], 0
    for query, own in zip(queries, query_ids):
        bounds = np.maximum(query * high, query * low)
        lists = np.argsort(-bounds, kind="stable")
        weights = query[lists]
        # What the lists from the n-th on can add together.
        rest = np.append(np.cumsum(bounds[lists][::-1])[::-1], 0)
        threshold, ids, scores = None, np.empty(0, np.int64), np.empty(0, kind)
        for start in range(0, len(vec_ids), BLOCK_ROWS):
            stop = min(start + BLOCK_ROWS, len(vec_ids))
            essential = wide if threshold is None else int(np.count_nonzero(rest[:-1] >= threshold))
            if not essential and wide:
                break
            partial = weights[:essential] @ postings[lists[:essential], start:stop]
            read += essential * (stop - start)
            at = vec_ids[start:stop] != own
            if threshold is not None:
                at &= partial + rest[essential] >= threshold
            at = np.flatnonzero(at)
            partial = partial[at]
            for step in range(essential, wide, PROBE_TERMS):
                terms = slice(step, step + PROBE_TERMS)
                partial = partial + weights[terms] @ postings[np.ix_(lists[terms], at + start)]
                read += len(weights[terms]) * len(at)
                keep = partial + rest[min(step + PROBE_TERMS, wide)] >= threshold
                at, partial = at[keep], partial[keep]
            ids, scores = np.append(ids, vec_ids[start:stop][at]), np.append(scores, partial)
            best = np.lexsort((ids, -scores))[:k]
            ids, scores = ids[best], scores[best]
            if len(ids) == k:
                threshold = scores[-1]
        found.append((np.full(len(ids), own), ids, scores.astype(np.int64)))
    if counts is not None:
        counts["postings"] = counts.get("postings", 0) + read
    if not found:
        return tuple(np.empty(0, np.int64) for _ in range(3))
    return tuple(np.concatenate(x) for x in zip(*found))


def _search_unit(left: pa.Table, right: pa.Table, k: int) -> pa.Table:
    names = ["query_id", "vec_id", "score"]
    ids, vectors = right.column("vec_id").to_numpy(), _matrix(right.column("vector"))[0]
    out = top_k(left.column("query_id").to_numpy(), _matrix(left.column("vector"))[0], ids, vectors, k)
    return pa.table([pa.array(np.asarray(c, np.int64)) for c in out], names=names)


def _usable(rows: DataFrame, id_col: str) -> DataFrame:
    """Each (id, vector) without nulls once; a vector that many ids share stays with each."""
    rows = rows.select(id_col, "vector").dropna().filter(~F.exists("vector", lambda x: x.isNull()))
    return rows.dropDuplicates([id_col, "vector"])


def maxscore_search(
    queries: DataFrame, vectors: DataFrame, k: int = 5, shard_rows: int = SHARD_ROWS, chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products of each query.

    ``queries`` (query_id, vector) and ``vectors`` (vec_id, vector) hold integer arrays; a
    shorter one counts as ending in zeros. A vector is no candidate for a query of its own
    id. Ties go to the smaller vec_id. Rows with a null id or vector, or a null in the vector,
    take no part; repeated rows count once, and different vectors under one query_id are ranked
    together. Further columns are ignored; an empty table on either side gives an empty result.
    """
    queries = _usable(queries, "query_id")
    vectors = _usable(vectors, "vec_id")
    n_vectors, n_queries = vectors.count(), queries.count()
    shards, chunks = max(1, -(-n_vectors // shard_rows)), max(1, -(-n_queries // chunk_rows))
    left = queries.select(
        "query_id", "vector", F.pmod(F.xxhash64("query_id"), F.lit(chunks)).cast("int").alias("chunk"),
        F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"),
    )
    right = vectors.select(
        "vec_id", "vector", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"),
        F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int").alias("shard"),
    )
    hits = left.groupBy("shard", "chunk").cogroup(right.groupBy("shard", "chunk")).applyInArrow(
        lambda a, b: _search_unit(a, b, k), "query_id long, vec_id long, score long"
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = hits.dropDuplicates(["query_id", "vec_id", "score"]).withColumn("rank", F.row_number().over(best))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_maxscore(spark, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").filter(
        "embedding IS NOT NULL AND NOT exists(embedding, x -> x IS NULL OR isnan(x) OR abs(x) = double('infinity'))"
    )
    vectors = materialise(rows.select(
        "vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * 256)).alias("vector")
    ), "vectors")
    queries = vectors.filter("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    return maxscore_search(queries, vectors)


OP1_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS vector
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, d.vec_id, list_inner_product(q.vector, d.vector)::BIGINT AS score
  FROM v q JOIN v d ON q.vec_id % 50 = 0 AND d.vec_id <> q.vec_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
