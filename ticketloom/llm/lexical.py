"""Ranked lexical search by the Best Position Algorithm.

A shard holds some thousand documents as one impact list per query term, best first. The lists
of an item are read in parallel from the top; a document seen for the first time is completed
by direct accesses to the item's other lists, and each access marks the document's position
there as seen. The best position of a list is the end of its seen positions that have no gap,
so direct accesses move it too: it is never above the last position read, and mostly far below.
No unseen document can be better than the sum of the impacts right behind the best positions;
once that sum is strictly below the k-th score (equal scores may still win by id), the shard is
done. The shards' answers are merged by rank.

Scores are integers (see ``search_documents``); a list is ordered by the part of a score that
does not depend on the query, so one list serves all items.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ticketloom.llm.common import materialise, read, spare_name

#: A term is a maximal run of ASCII letters and digits and of characters beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What is between terms becomes a blank, capitals become small; bytes above 127 stay.
_FOLD = bytes(
    c + 32 if chr(c) in UPPER else c if c > 127 or chr(c) in LOWER + "0123456789" else 32 for c in range(256)
)
#: (item, term) rows that are sent to all tasks at a time, documents and postings of a shard.
BLOCK_TERMS, SHARD_DOCS, SHARD_POSTINGS = 1 << 18, 8192, 1 << 21
#: Positions of a list that are read in the first step; each step reads twice as many.
FIRST_DEPTH = 16
#: Entries of position tables that a shard keeps between items.
KEPT_POSITIONS = 1 << 23


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class Shard:
    """Impact lists of some documents: per term its documents, best first, and their impacts."""

    def __init__(self, n_docs: int, doc: np.ndarray, term: np.ndarray, impact: np.ndarray) -> None:
        order = np.lexsort((doc, -impact, term))
        self.n_docs, self.doc, self.impact = n_docs, doc[order], impact[order]
        self.terms, first = np.unique(term[order], return_index=True)
        self.bounds = np.append(first, len(term))
        self.position = lru_cache(max(1, KEPT_POSITIONS // max(n_docs, 1)))(self._position)
        self.completed = 0

    def _position(self, lst: int) -> np.ndarray:
        """Document -> its position in a list, or the list's length: the direct access."""
        docs = self.doc[self.bounds[lst]:self.bounds[lst + 1]]
        out = np.full(self.n_docs, len(docs), np.int32)
        out[docs] = np.arange(len(docs), dtype=np.int32)
        return out

    def best(self, terms: np.ndarray, weights: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores of the k best for a query, ties by ``ids``; scores of 0 are none."""
        at = np.minimum(np.searchsorted(self.terms, terms), max(len(self.terms) - 1, 0))
        known = (self.terms[at] == terms) & (weights > 0) if len(self.terms) else np.zeros(len(terms), bool)
        lists, weights = at[known], weights[known]
        docs = [self.doc[self.bounds[t]:self.bounds[t + 1]] for t in lists]
        # One impact of 0 behind each list: of documents that are not in it.
        impacts = [np.append(self.impact[self.bounds[t]:self.bounds[t + 1]], 0) * w for t, w in zip(lists, weights)]
        seen = [np.zeros(len(d) + 1, bool) for d in docs]
        best_position = [0] * len(docs)
        met, scores = np.zeros(self.n_docs, bool), np.zeros(self.n_docs, np.int64)
        depth, step = 0, FIRST_DEPTH
        while docs:
            fresh = np.unique(np.concatenate([d[depth:depth + step] for d in docs]))
            fresh = fresh[~met[fresh]]
            met[fresh] = True
            self.completed += len(fresh)
            threshold = 0
            for n, t in enumerate(lists):
                position = self.position(t)[fresh]
                scores[fresh] += impacts[n][position]
                seen[n][position] = True
                seen[n][-1] = False  # absent documents leave the end of the list unseen
                best_position[n] += int(np.argmin(seen[n][best_position[n]:]))
                threshold += int(impacts[n][best_position[n]])
            found = scores[met]
            kth = int(np.partition(found, len(found) - k)[len(found) - k]) if len(found) >= k else 0
            if threshold < kth or threshold == 0:
                break
            depth, step = depth + step, step * 2
        hits = np.flatnonzero(scores)
        if len(hits) > k:  # all that may be among the k best, ties included
            hits = hits[scores[hits] >= np.partition(scores[hits], len(hits) - k)[len(hits) - k]]
        hits = hits[np.lexsort((ids[hits], -scores[hits]))][:k]
        return hits, scores[hits]


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item, term, times: the terms of each item's distinct texts, in lower case."""
    texts = items.select(F.col(id_col).alias("item"), F.col(text_col).alias("text")).dropna().dropDuplicates()
    small = F.translate("text", UPPER, LOWER)
    terms = texts.select("item", F.explode(F.regexp_extract_all(small, F.lit(TERM), F.lit(0))).alias("term"))
    return terms.groupBy("item", "term").agg(F.count(F.lit(1)).alias("times"))


def _postings(docs: DataFrame, shared) -> DataFrame:
    """row, id, n, terms, tfs: the shared vocabulary's terms in each document, by number."""
    kind = docs.schema["id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = shared.value
        for batch in batches:
            sizes, starts, terms, tfs = [], [0], [], []
            for text in batch.column("text").to_pylist():
                words = terms_of(text) if text is not None else []
                counts = Counter(filter(numbers.__contains__, words))
                sizes.append(len(words))
                terms.extend(map(numbers.__getitem__, counts))
                tfs.extend(counts.values())
                starts.append(len(terms))
            starts = pa.array(starts, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("id"), pa.array(sizes, pa.int64()),
                 pa.ListArray.from_arrays(starts, pa.array(terms, pa.int32())),
                 pa.ListArray.from_arrays(starts, pa.array(tfs, pa.int64()))],
                names=["row", "id", "n", "terms", "tfs"],
            )

    schema = f"row long, id {kind}, n long, terms array<int>, tfs array<long>"
    return docs.mapInArrow(work, schema)


def _search_shard(table: pa.Table, queries: list, n_docs: int, n_terms: int, k: int) -> pa.Table:
    """The k best documents of one shard for each query (item, terms, weights)."""
    ids = table.column("id").combine_chunks()
    lists = table.column("terms").combine_chunks()
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    doc = np.repeat(np.arange(len(ids)), sizes)
    term, tf = lists.flatten().to_numpy(), table.column("tfs").combine_chunks().flatten().to_numpy()
    m = 25 + (75 * table.column("n").to_numpy() * n_docs) // max(n_terms, 1)
    shard = Shard(len(ids), doc, term, (1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
    # Ranks stand for the ids, so that ids of any kind break ties; a null id comes last.
    rank = np.empty(len(ids), np.int64)
    rank[pa.compute.sort_indices(ids, null_placement="at_end").to_numpy()] = np.arange(len(ids))
    items, hits, scores = [], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for item, terms, weights in queries:
        found, score = shard.best(terms, weights, rank, k)
        items += [item] * len(found)
        hits.append(found)
        scores.append(score)
    return pa.table({"item": items, "id": ids.take(pa.array(np.concatenate(hits))), "score": np.concatenate(scores)})


def search_documents(
    docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text",
    block_terms: int = BLOCK_TERMS, shard_docs: int = SHARD_DOCS, shard_postings: int = SHARD_POSTINGS,
) -> DataFrame:
    """item_id, rank, id, score: the k best documents of each row of ``items`` (item_id, text).

    With N documents that have a term, L terms in them, n in one of them, df documents that
    hold a term and tf occurrences in one: a term weighs w = floor(1000 ln((2N+2) / (2df+1))),
    m = 25 + (75 n N) div L, and a score is the sum of w ((10^9 tf) div (1000 tf + 8 m)) over the
    item's terms, repeats included. Only scores above 0 are hits; equal scores rank by id, null
    last.

    A null or blank text has no term. Every row is a document, so repeated rows of ``docs``
    rank one behind the other. Rows of one item_id are one item with the terms of its distinct
    texts; items without id or text have no hits. An empty table on either side gives an empty
    result; further columns are ignored.

    Items meet all documents in blocks of about ``block_terms`` (item, term) rows; a block is
    sent to every task, so this parameter bounds what is broadcast, and its hits are stored
    before the next one starts.
    """
    spark = docs.sparkSession
    wanted = materialise(item_terms(items), "item-terms")
    n_rows = wanted.count()
    blocks = max(1, -(-n_rows // block_terms))
    kinds = wanted.schema["item"].dataType.simpleString(), docs.schema[id_col].dataType.simpleString()
    hit_schema = f"item {kinds[0]}, id {kinds[1]}, score long"
    texts = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    found = spark.createDataFrame([], hit_schema)
    for block in range(blocks if n_rows else 0):
        own = wanted.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block)
        found = found.unionByName(_search_block(texts, own, hit_schema, k, shard_docs, shard_postings))
    name = spare_name(docs.select(id_col), "item_id")
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select(F.col("item").alias(name), "rank", F.col("id").alias(id_col), "score")


def _search_block(texts: DataFrame, own: DataFrame, hit_schema: str, k: int, shard_docs: int, shard_postings: int) -> DataFrame:
    sc = texts.sparkSession.sparkContext
    rows = own.orderBy("item", "term").collect()
    numbers = {t: i for i, t in enumerate(dict.fromkeys(r["term"].encode() for r in rows))}
    shared = sc.broadcast(numbers)
    postings = materialise(_postings(texts, shared), "postings")
    shared.unpersist()
    n_docs, n_terms, n_rows, n_postings = postings.agg(
        F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1)),
        F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
    df = postings.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weight = F.floor(F.lit(1000.0) * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1).cast("double")))
    weights = dict(df.select("term", weight.cast("long")).collect())  # as many as the block has terms
    by_item: dict = {}
    for r in rows:
        number = numbers[r["term"].encode()]
        if number in weights:
            by_item.setdefault(r["item"], []).append((number, r["times"] * weights[number]))
    queries = [(item, *(np.array(x, np.int64) for x in zip(*own))) for item, own in by_item.items()]
    queries = sc.broadcast(queries)
    shards = max(1, -(-n_rows // shard_docs), -(-n_postings // shard_postings))
    shard = F.pmod(F.xxhash64("row"), F.lit(shards)).alias("shard")
    hits = postings.filter(F.size("terms") > 0).select(shard, "id", "n", "terms", "tfs").groupBy("shard").applyInArrow(
        lambda table: _search_shard(table, queries.value, n_docs, n_terms, k), hit_schema)
    hits = materialise(hits, "hits")
    queries.unpersist()
    return hits


def op11_lexical_search(spark, sf_dir: str) -> DataFrame:
    return search_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


OP11_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}') AS terms
  FROM documents WHERE text IS NOT NULL
), corpus AS (
  SELECT count(*)::BIGINT AS nd, sum(len(terms))::BIGINT AS nt FROM d WHERE len(terms) > 0
), q AS (
  SELECT item_id, term, count(*) AS times
  FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) AS term
        FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL))
  GROUP BY ALL
), p AS (
  SELECT r, doc_id, n, term, count(*)::BIGINT AS tf
  FROM (SELECT r, doc_id, len(terms)::BIGINT AS n, unnest(terms) AS term FROM d)
  SEMI JOIN q USING (term)
  GROUP BY ALL
), w AS (
  SELECT term, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM p, corpus GROUP BY term, nd
), scored AS (
  SELECT item_id, r, doc_id,
         sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * nd) // nt)))))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN p USING (term), corpus
  GROUP BY item_id, r, doc_id
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score
FROM scored WHERE score > 0
QUALIFY rank <= 10
"""
