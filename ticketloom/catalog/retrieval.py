"""Registered queries: index of solved cases and vector search."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ticketloom import constants as K
from ticketloom.catalog import sql as S
from ticketloom.catalog.hygiene import clean_tickets
from ticketloom.catalog.registry import Family
from ticketloom.config import TriageConfig
from ticketloom.operators import index as ix
from ticketloom.operators import lexical as lx
from ticketloom.operators import search as se
from ticketloom.session import materialise, scratch_dir
from ticketloom.sources import fixtures as fx
from ticketloom.sources import tables as tb
from ticketloom.sources.bucketed_index import BucketedIndex

FAMILY = Family()
register = FAMILY.register
CFG = TriageConfig()


def index(spark, d):
    return ix.to_index_rows(fx.precedents(spark, d))


def stored_index(spark, d):
    """The index as searches meet it: a written snapshot."""
    return materialise(index(spark, d), "index")


def query_vectors(spark, d):
    """All documents as search queries with their predicted intent."""
    vectors = fx.ticket_vectors(spark, d).select("ticket_id", "embedding")
    intents = fx.classifications(spark, d).select("ticket_id", "intent")
    return vectors.join(intents, "ticket_id").select(
        F.col("ticket_id").alias("query_id"), "intent", F.col("embedding").alias("vector"))


COS = "round(list_cosine_similarity(q.embedding, p.embedding::DOUBLE[]), 12)"

S.CTES["queries"] = "SELECT v.ticket_id, v.embedding, c.intent FROM vectors v JOIN classifications c USING (ticket_id)"


def hits_ctes(source: str = "queries", k: int = CFG.top_k) -> dict[str, str]:
    """pairs -> cut -> hits over a query table (ticket_id, embedding, intent)."""
    return {
        "pairs": f"""
SELECT q.ticket_id, p.*, {COS} AS sim FROM {source} q JOIN precedents p
  ON p.intent = q.intent OR q.intent IN ('', 'other')
     OR q.intent NOT IN (SELECT intent FROM precedents)""",
        "best": f"""
SELECT * EXCLUDE (embedding), round(greatest(0.0, sim), 4) AS raw_similarity,
       round(least(1.0, greatest(0.0, sim) + CASE WHEN source = '{K.HUMAN}' THEN 0.05::DOUBLE ELSE 0 END), 4) AS similarity_score
FROM pairs QUALIFY row_number() OVER (PARTITION BY ticket_id ORDER BY sim DESC, case_key) <= {k}""",
        "hits": """
SELECT *, row_number() OVER (PARTITION BY ticket_id ORDER BY similarity_score DESC, sim DESC, case_key) AS hit_rank
FROM best""",
    }


@register("v1_v2_index_rows", S.with_ctes(
    "SELECT case_key, document, case_id, intent, source, resolution, product, \"timestamp\" FROM precedents"))
def v1_v2_index_rows(spark, d):
    return index(spark, d).drop("embedding")


@register("v2_defaults", S.with_ctes(f"""
SELECT ticket_id || '_' || substr(md5(ticket_text), 1, 8) AS case_key, ticket_id::VARCHAR AS case_id,
       CASE WHEN ticket_id % 2 = 0 THEN 'other' ELSE ticket_type END AS intent,
       '{K.HUMAN}' AS source, CASE WHEN ticket_id % 3 = 0 THEN '' ELSE resolution END AS resolution, '' AS product
FROM tickets"""))
def v2_defaults(spark, d):
    t = clean_tickets(spark, d)
    cases = t.select(
        "ticket_id", "ticket_text",
        F.when(F.col("ticket_id") % 2 != 0, F.col("ticket_type")).alias("intent"),
        F.when(F.col("ticket_id") % 3 != 0, F.col("resolution")).alias("resolution"),
        F.lit("").alias("case_id"), F.array().cast("array<double>").alias("embedding"))
    return ix.to_index_rows(cases).select("case_key", "case_id", "intent", "source", "resolution", "product")


# Every case is written twice, the second time with a later seq and its answer and
# question swapped; every third one keeps its text and so overwrites its own key.
S.CTES["writes"] = f"""
SELECT *, 1 AS seq FROM cases UNION ALL
SELECT * REPLACE (CASE WHEN source = '{K.AGENT}' THEN ticket_text ELSE resolution END AS ticket_text,
                  'updated: ' || resolution AS resolution), 2 AS seq FROM cases"""
S.CTES["written"] = f"""
SELECT case_id || '_' || substr(md5({S.strip('ticket_text')}), 1, 8) AS case_key, * FROM writes"""


def writes(spark, d):
    first = fx.precedents(spark, d)
    second = first.withColumn(
        "ticket_text", F.when(F.col("source") == K.AGENT, F.col("ticket_text")).otherwise(F.col("resolution"))
    ).withColumn("resolution", F.concat(F.lit("updated: "), "resolution"))
    return ix.to_index_rows(first.withColumn("seq", F.lit(1).cast("bigint")).unionByName(
        second.withColumn("seq", F.lit(2).cast("bigint"))))


@register("v3_upsert", S.with_ctes(
    "SELECT case_key, case_id, resolution, source FROM written "
    "QUALIFY row_number() OVER (PARTITION BY case_key ORDER BY seq DESC) = 1"))
def v3_upsert(spark, d):
    rows = writes(spark, d)
    old = ix.upsert(None, rows.where("seq = 1"))
    return ix.upsert(old, rows.where("seq = 2")).select("case_key", "case_id", "resolution", "source")


def bucketed(spark, rows):
    """A bucketed index of its own for one query."""
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return BucketedIndex.create(rows, f"case_index_{uuid.uuid4().hex}", scratch_dir(spark, "bucketed-index"), buckets)


@register("v3_bucketed_upsert", S.with_ctes(
    "SELECT case_key, case_id, resolution, source FROM written "
    "QUALIFY row_number() OVER (PARTITION BY case_key ORDER BY seq DESC) = 1"))
def v3_bucketed_upsert(spark, d):
    """The second writes of all cases over a bucketed index of the first ones."""
    rows = writes(spark, d)
    held = bucketed(spark, rows.where("seq = 1"))
    held.upsert(rows.where("seq = 2"))
    return held.table().select("case_key", "case_id", "resolution", "source")


@register("v3_submitted", S.with_ctes("SELECT count(*) AS submitted FROM writes"))
def v3_submitted(spark, d):
    return ix.submitted(writes(spark, d))


S.CTES["labelled_for_index"] = """
SELECT t.*, c.intent AS assigned_intent, v.embedding FROM tickets t
JOIN classifications c USING (ticket_id) JOIN vectors v USING (ticket_id)"""
S.CTES["solved_index"] = """
SELECT ticket_id || '_' || substr(md5(ticket_text), 1, 8) AS case_key, ticket_text AS document,
       ticket_id::VARCHAR AS case_id, ticket_id, assigned_intent AS intent, 'human_resolved' AS source,
       resolution, product, created_at AS "timestamp", embedding
FROM labelled_for_index WHERE is_solved AND ticket_id NOT IN (SELECT doc_id FROM labels)"""


def dated_tickets(spark, d):
    """Clean tickets with their time as a written table, for queries that need them several times."""
    return materialise(clean_tickets(spark, d, extra=("created_at",)), "tickets")


def labelled_for_index(spark, d, tickets=None):
    t = clean_tickets(spark, d, extra=("created_at",)) if tickets is None else tickets
    c = fx.classifications(spark, d).select("ticket_id", F.col("intent").alias("assigned_intent"))
    v = fx.ticket_vectors(spark, d).select("ticket_id", "embedding")
    return t.join(c, "ticket_id").join(v, "ticket_id")


def holdout(spark, d):
    return fx.table(spark, d, "labels").select(F.col("doc_id").alias("ticket_id"))


def solved_index(spark, d, tickets=None):
    cases = ix.solved_cases(labelled_for_index(spark, d, tickets), holdout(spark, d))
    return ix.to_index_rows(cases)


@register("v4_build_index", S.with_ctes(
    "SELECT case_key, document, case_id, intent, source, resolution, product, \"timestamp\" FROM solved_index"))
def v4_build_index(spark, d):
    return ix.upsert(None, solved_index(spark, d)).drop("embedding")


@register("v5_missing_rows", S.with_ctes("""
SELECT count(*) AS wanted, count_if(intent NOT IN ('other', 'data_loss_recovery')) AS indexed,
       count_if(intent IN ('other', 'data_loss_recovery')) AS missing FROM solved_index"""))
def v5_missing_rows(spark, d):
    # The keys as a written table: the count, the index and the rebuild read them.
    rows = materialise(solved_index(spark, d).select("case_key", "intent"), "solved-keys")
    have = rows.where(~F.col("intent").isin("other", "data_loss_recovery"))
    todo = ix.missing_rows(have, rows)
    return rows.agg(F.count(F.lit(1)).alias("wanted")).select(
        "wanted", have.agg(F.count(F.lit(1))).scalar().alias("indexed"),
        todo.agg(F.count(F.lit(1))).scalar().alias("missing"))


@register("v5_bucketed_missing", S.with_ctes("""
SELECT case_key, intent, intent NOT IN ('other', 'data_loss_recovery') AS was_indexed FROM solved_index"""))
def v5_bucketed_missing(spark, d):
    """A rebuild over a bucketed index adds what it lacks; every key and whether it was there before."""
    rows = materialise(solved_index(spark, d), "solved-rows")
    held = bucketed(spark, rows.where(~F.col("intent").isin("other", "data_loss_recovery")))
    todo = materialise(held.missing(rows), "missing-rows")
    held.upsert(todo)
    added = todo.select("case_key", F.lit(False).alias("new"))
    return held.table().join(added, "case_key", "left").select(
        "case_key", "intent", F.coalesce("new", F.lit(True)).alias("was_indexed"))


@register("v6_search", S.with_ctes(
    'SELECT ticket_id AS query_id, hit_rank, case_key, case_id, document AS "query", resolution, intent, '
    "source, product, raw_similarity, similarity_score FROM hits", **hits_ctes()))
def v6_search(spark, d):
    return se.search(query_vectors(spark, d), stored_index(spark, d), CFG)


@register("v7_unfiltered_search", S.with_ctes(f"""
SELECT q.ticket_id AS query_id, p.case_key, round({COS}, 4) AS similarity,
       row_number() OVER (PARTITION BY q.ticket_id ORDER BY {COS} DESC, p.case_key) AS cut_rank
FROM vectors q CROSS JOIN precedents p QUALIFY cut_rank <= 5"""))
def v7_unfiltered_search(spark, d):
    queries = materialise(query_vectors(spark, d).drop("intent"), "queries")
    hits = se.nearest(queries, stored_index(spark, d), 5, CFG)
    return hits.select("query_id", "case_key", F.round("similarity", 4).alias("similarity"),
                       F.col("cut_rank").cast("bigint").alias("cut_rank"))


@register("v8_scope", S.with_ctes("""
SELECT intent, CASE WHEN intent IN ('', 'other') OR intent NOT IN (SELECT intent FROM precedents)
       THEN '*' ELSE intent END AS scope, count(*) AS row_count FROM queries GROUP BY ALL"""))
def v8_scope(spark, d):
    wanted, _, _ = se.scoped(query_vectors(spark, d), index(spark, d))
    return wanted.groupBy("intent", "scope").agg(F.count(F.lit(1)).alias("row_count"))


# The i-th element product of every case vector with its neighbour in the table.
@register("v9_v10_scores", S.with_ctes(f"""
SELECT a.vec_id, round(greatest(0.0, coalesce(d, 0.5)), 4) AS raw_similarity,
       round(least(1.0, greatest(0.0, coalesce(d, 0.5)) + CASE WHEN a.vec_id % 3 = 0 THEN 0.0::DOUBLE ELSE 0.05::DOUBLE END), 4) AS similarity_score
FROM (SELECT a.vec_id, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS d
      FROM embeddings a LEFT JOIN embeddings b ON b.vec_id = a.vec_id + 1) a"""))
def v9_v10_scores(spark, d):
    from ticketloom.functions import vectors as vx

    a = fx.table(spark, d, "embeddings").select("vec_id", "embedding")
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    raw = se.raw_similarity(vx.dot(F.col("embedding"), F.col("other")))
    source = F.when(F.col("vec_id") % 3 == 0, K.AGENT).otherwise(K.HUMAN)
    return a.join(b, "vec_id", "left").select(
        "vec_id", F.round(raw, 4).alias("raw_similarity"),
        F.round(se.boosted(raw, source, CFG.human_boost), 4).alias("similarity_score"))


# Approvals: every ticket's text with its vector, as it came in (ticket id = order).
S.CTES["approvals"] = """
SELECT 'agent_approved_' || substr(md5(r.ticket_description), 1, 10) AS case_key, r.ticket_id AS seq,
       r.ticket_description AS "query", v.embedding
FROM tickets_raw r JOIN vectors v USING (ticket_id)"""
S.CTES["fresh_approvals"] = """
SELECT q.* FROM (SELECT * FROM approvals
                 QUALIFY row_number() OVER (PARTITION BY case_key ORDER BY seq) = 1) q
WHERE NOT EXISTS (SELECT 1 FROM precedents p
  WHERE round(list_cosine_similarity(q.embedding, p.embedding::DOUBLE[]), 4) > 0.96)"""


def approvals(spark, d):
    raw = fx.tickets_raw(spark, d, digest=True).select(
        "ticket_id", F.col("ticket_description").alias("query"), F.col("description_md5").alias("query_md5"),
        F.coalesce("resolution", F.lit("")).alias("reply"))
    v = fx.ticket_vectors(spark, d).select("ticket_id", "embedding")
    c = fx.classifications(spark, d).select("ticket_id", "intent")
    return raw.join(v, "ticket_id").join(c, "ticket_id").withColumnRenamed("ticket_id", "seq")


@register("v13_near_duplicate_gate", S.with_ctes("SELECT case_key, seq FROM fresh_approvals"))
def v13_near_duplicate_gate(spark, d):
    idx = stored_index(spark, d)
    rows = ix.approvals_to_rows(approvals(spark, d))
    from pyspark.sql.window import Window

    w = Window.partitionBy("case_key").orderBy("seq")
    first = rows.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")
    return ix.not_near_index(first, idx, CFG).select("case_key", "seq")


# One row after another, each against the rows kept so far.
S.CTES["approval_line"] = "SELECT *, row_number() OVER (ORDER BY seq) AS n FROM fresh_approvals"
S.CTES["admitted"] = """
SELECT 0::BIGINT AS n, []::BIGINT[] AS kept
UNION ALL /* recursive step */
SELECT f.n, CASE WHEN EXISTS (SELECT 1 FROM close c WHERE c.n = f.n AND list_contains(a.kept, c.m))
                 THEN a.kept ELSE list_append(a.kept, f.n) END
FROM admitted a JOIN approval_line f ON f.n = a.n + 1"""
S.CTES["close"] = """
SELECT q.n, p.n AS m FROM approval_line q JOIN approval_line p ON p.n < q.n
WHERE round(list_cosine_similarity(q.embedding, p.embedding), 4) > 0.96"""


@register("v13_add_approved", S.with_ctes("""
SELECT f.case_key, f.case_key AS case_id, 'agent_generated_approved' AS source
FROM approval_line f JOIN (SELECT unnest(kept) AS n FROM (SELECT kept FROM admitted ORDER BY n DESC LIMIT 1)) k USING (n)"""))
def v13_add_approved(spark, d):
    added = ix.add_approved(stored_index(spark, d), approvals(spark, d), CFG)
    return added.select("case_key", "case_id", "source")


@register("v14_v15_ledger_counts", S.with_ctes(f"""
SELECT count(*) AS total_cases, count_if(source = '{K.HUMAN}') AS human_resolved_count,
       count_if(source = '{K.AGENT}') AS agent_approved_count FROM precedents"""))
def v14_v15_ledger_counts(spark, d):
    return ix.ledger_counts(index(spark, d))


@register("v15_ledger_recent", S.with_ctes(f"""
SELECT source, row_number() OVER (PARTITION BY source ORDER BY "timestamp" DESC, case_key) AS position,
       case_id, substr(document, 1, 120) AS "query", substr(resolution, 1, 120) AS resolution, intent, product, "timestamp"
FROM precedents QUALIFY position <= CASE WHEN source = '{K.AGENT}' THEN 20 ELSE 8 END"""))
def v15_ledger_recent(spark, d):
    return ix.ledger_recent(index(spark, d))


RECALL = 0.95


@register("v16_approximate_recall", S.with_ctes(
    "SELECT count(*) AS exact_hits, true AS reached FROM hits", **hits_ctes()))
def v16_approximate_recall(spark, d):
    """Recall of the cell search against the exact one, over all queries, is 0.9 at least.

    The probes are taken from every tenth query's exact hits (by digest of the id)."""
    idx, q = stored_index(spark, d), materialise(query_vectors(spark, d), "queries")
    centres = se.fit_cells(idx)
    exact = materialise(se.search(q, idx, CFG, stored=True).select("query_id", "case_key"), "exact")
    some = F.pmod(F.xxhash64("query_id"), F.lit(10)) == 0
    probes = se.probes_for(RECALL, exact.where(some), q.where(some), idx, centres)
    found = se.recall_at_k(exact, se.search_cells(q, idx, centres, probes, CFG, exact=False, stored=True))
    return found.select("exact_hits", (F.col("recall") >= 0.9).alias("reached"))


S.CTES["boosted_pairs"] = f"""
SELECT q.ticket_id, p.case_key, {COS} AS sim, round(greatest(0.0, {COS}), 4) AS raw_similarity,
       round(least(1.0, greatest(0.0, {COS}) + CASE WHEN p.source = '{K.HUMAN}' THEN 0.05::DOUBLE ELSE 0 END), 4) AS similarity_score
FROM queries q JOIN precedents p ON p.intent = q.intent OR q.intent IN ('', 'other')
     OR q.intent NOT IN (SELECT intent FROM precedents)"""


@register("v11_rerank", S.with_ctes(f"""
SELECT ticket_id AS query_id, 'after cut' AS boost, hit_rank, case_key, raw_similarity, similarity_score FROM hits
UNION ALL SELECT ticket_id, 'before cut', row_number() OVER w AS hit_rank, case_key, raw_similarity, similarity_score FROM boosted_pairs
WINDOW w AS (PARTITION BY ticket_id ORDER BY similarity_score DESC, sim DESC, case_key) QUALIFY hit_rank <= {CFG.top_k}""", **hits_ctes()))
def v11_rerank(spark, d):
    """Both orders: boost after the cut (the reference's) and before it."""
    idx, q = stored_index(spark, d), materialise(query_vectors(spark, d), "queries")
    cols = ("query_id", "boost", "hit_rank", "case_key", "raw_similarity", "similarity_score")
    after = se.search(q, idx, CFG, stored=True).withColumn("boost", F.lit("after cut"))
    before = se.search(q, idx, CFG, boost_before_cut=True, stored=True).withColumn("boost", F.lit("before cut"))
    return after.select(*cols).unionByName(before.select(*cols))


@register("v6_small_blocks", S.with_ctes(
    "SELECT ticket_id AS query_id, hit_rank, case_key, similarity_score FROM hits", **hits_ctes()))
def v6_small_blocks(spark, d):
    """The search with many blocks and chunks per scope."""
    small = TriageConfig(block_rows=64, query_rows=128)
    return se.search(query_vectors(spark, d), stored_index(spark, d), small).select(
        "query_id", "hit_rank", "case_key", "similarity_score")


@register("v16_exact_cells", S.with_ctes(
    'SELECT ticket_id AS query_id, hit_rank, case_key, raw_similarity, similarity_score FROM hits', **hits_ctes()))
def v16_exact_cells(spark, d):
    """Cell search with the second round that makes it exact."""
    idx, q = stored_index(spark, d), query_vectors(spark, d)
    hits = se.search_cells(q, idx, se.fit_cells(idx), 4, CFG)
    return hits.select("query_id", "hit_rank", "case_key", "raw_similarity", "similarity_score")


@register("s7_embedding_store", S.with_ctes(
    "SELECT d.doc_id AS ticket_id, md5(d.text) AS text_hash, 64::BIGINT AS dims FROM documents d"))
def s7_embedding_store(spark, d):
    """Store half the vectors under their text digest, then fill in only what is missing."""
    from ticketloom.sources import embedding_store as es

    docs = fx.table(spark, d, "documents").select(F.col("doc_id").alias("ticket_id"), F.col("text").alias("ticket_text"))
    vectors = fx.ticket_vectors(spark, d).select("ticket_id", "embedding")

    def embed(rows):
        return rows.join(vectors, "ticket_id")

    path = scratch_dir(spark, "vectors")
    early = docs.where(F.length("ticket_text") < 1000)
    tb.write_table(es.with_hash(embed(early)).select(*es.STORE_COLUMNS), path)
    store = es.refresh(docs, tb.read_table(spark, path), embed)
    return store.select("ticket_id", "text_hash", F.size("embedding").cast("bigint").alias("dims"))


# Hybrid search: the short fields of a ticket against the text and product of the cases.
DEPTH = 20
S.CTES["case_terms"] = r"""
SELECT case_key, regexp_extract_all(lower(concat_ws(' ', document, product)), '[\p{L}\p{N}]+') AS terms FROM precedents"""
S.CTES["case_counts"] = """
SELECT case_key, len(terms)::DOUBLE AS length, term, count(*)::DOUBLE AS tf
FROM (SELECT case_key, terms, unnest(terms) AS term FROM case_terms) GROUP BY ALL"""
S.CTES["case_spread"] = "SELECT term, count(*)::DOUBLE AS df FROM case_counts GROUP BY term"
S.CTES["impacts"] = f"""
SELECT case_key, term, floor({lx.UNITS}::DOUBLE * (
  ln(1.0::DOUBLE + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE))
  * (tf * {lx.K1 + 1}::DOUBLE / (tf + {lx.K1}::DOUBLE * ({1 - lx.B}::DOUBLE + {lx.B}::DOUBLE * length / mean)))) + 0.5::DOUBLE)::BIGINT AS impact
FROM case_counts JOIN case_spread USING (term),
     (SELECT count(*)::DOUBLE AS n, sum(len(terms))::DOUBLE / count(*)::DOUBLE AS mean FROM case_terms)"""
S.CTES["asked"] = r"""
SELECT ticket_id, term, count(*) AS times FROM (
  SELECT ticket_id, unnest(regexp_extract_all(lower(concat_ws(' ', product, ticket_type, ticket_subject)), '[\p{L}\p{N}]+')) AS term
  FROM tickets) GROUP BY ALL"""
S.CTES["bm25_hits"] = f"""
SELECT ticket_id, case_key, score, row_number() OVER (PARTITION BY ticket_id ORDER BY score DESC, case_key) AS rank
FROM (SELECT ticket_id, case_key, sum(times * impact)::BIGINT AS score FROM asked JOIN impacts USING (term) GROUP BY ALL)
QUALIFY rank <= {DEPTH}"""
S.CTES["vector_hits"] = f"""
SELECT q.ticket_id, p.case_key, row_number() OVER (PARTITION BY q.ticket_id ORDER BY {COS} DESC, p.case_key) AS rank
FROM (SELECT v.* FROM vectors v SEMI JOIN tickets USING (ticket_id)) q CROSS JOIN precedents p QUALIFY rank <= {DEPTH}"""


def inverted(spark, d):
    return lx.inverted_index(index(spark, d).withColumn("document", F.concat_ws(" ", "document", "product")))


def short_queries(spark, d):
    """Tickets as (query_id, text, vector): what a lexical search gets to see of a ticket."""
    v = fx.ticket_vectors(spark, d).select("ticket_id", F.col("embedding").alias("vector"))
    t = clean_tickets(spark, d).select("ticket_id", F.concat_ws(" ", "product", "ticket_type", "ticket_subject").alias("text"))
    return materialise(t.join(v, "ticket_id").withColumnRenamed("ticket_id", "query_id"), "short-queries")


@register("v17_bm25", S.with_ctes(
    "SELECT ticket_id AS query_id, case_key, score, rank AS hit_rank FROM bm25_hits WHERE rank <= 5"))
def v17_bm25(spark, d):
    return lx.bm25_search(short_queries(spark, d), inverted(spark, d), CFG.top_k, CFG)


@register("v17_hybrid", S.with_ctes(f"""
SELECT ticket_id AS query_id, case_key, v.rank AS dense_rank, b.rank AS lexical_rank,
       round(coalesce(1.0::DOUBLE / ({lx.RANK_OFFSET} + v.rank), 0.0::DOUBLE) + coalesce(1.0::DOUBLE / ({lx.RANK_OFFSET} + b.rank), 0.0::DOUBLE), 12) AS fused,
       row_number() OVER (PARTITION BY ticket_id ORDER BY fused DESC, case_key) AS hit_rank
FROM vector_hits v FULL JOIN bm25_hits b USING (ticket_id, case_key) QUALIFY hit_rank <= 5"""))
def v17_hybrid(spark, d):
    return lx.hybrid_search(short_queries(spark, d), stored_index(spark, d), inverted(spark, d), CFG, DEPTH)
