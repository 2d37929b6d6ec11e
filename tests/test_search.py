import numpy as np
import pytest
from pyspark.sql import functions as F

from ticketloom.config import TriageConfig
from ticketloom.operators import index as ix
from ticketloom.operators import search as se

DIM = 8


def unit(rng, n):
    v = rng.normal(size=(n, DIM))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def make_index(spark, vectors, intents, sources=None):
    rows = [
        (f"k{i:04d}", f"doc {i}", f"c{i}", intents[i], (sources or ["human_resolved"] * len(vectors))[i],
         f"res {i}", "", vectors[i].tolist())
        for i in range(len(vectors))
    ]
    return spark.createDataFrame(
        rows, "case_key string, document string, case_id string, intent string, source string, resolution string, "
              "product string, embedding array<double>").withColumn("timestamp", F.lit("2024-01-01").cast("timestamp"))


def make_queries(spark, vectors, intents):
    return spark.createDataFrame(
        [(i, intents[i], vectors[i].tolist()) for i in range(len(vectors))],
        "query_id bigint, intent string, vector array<double>")


def brute(q, q_intents, c, c_intents, sources, k, boost):
    known, out = set(c_intents), {}
    for i in range(len(q)):
        want = q_intents[i]
        free = want in (None, "", "other") or want not in known
        pool = [j for j in range(len(c)) if free or c_intents[j] == want]
        cut = sorted(pool, key=lambda j: (-round(float(q[i] @ c[j]), 12), f"k{j:04d}"))[:k]
        scored = []
        for j in cut:
            raw = max(0.0, float(q[i] @ c[j]))
            add = boost if sources[j] == "human_resolved" else 0.0
            scored.append((-round(min(1.0, raw + add), 4), -round(float(q[i] @ c[j]), 12), f"k{j:04d}"))
        out[i] = [s[2] for s in sorted(scored)]
    return out


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(7)
    c, q = unit(rng, 150), unit(rng, 60)
    # One intent holds two thirds of the cases, and a third of all cases are copies of one.
    c_int = ["hot" if i % 3 else ("cold" if i % 2 else "rare") for i in range(150)]
    for i in range(0, 150, 3):
        c[i] = c[0]
    q[5] = c[0]
    q_int = [["hot", "cold", "other", "", None, "unknown"][i % 6] for i in range(60)]
    src = ["human_resolved" if i % 2 else "agent_generated_approved" for i in range(150)]
    return c, q, c_int, q_int, src


@pytest.mark.parametrize("block, chunk", [(4096, 4096), (16, 7), (1, 1000)])
def test_search_equals_brute_force(spark, data, block, chunk):
    c, q, c_int, q_int, src = data
    cfg = TriageConfig(block_rows=block, query_rows=chunk)
    hits = se.search(make_queries(spark, q, q_int), make_index(spark, c, c_int, src), cfg)
    got = {}
    for r in hits.orderBy("query_id", "hit_rank").collect():
        got.setdefault(r["query_id"], []).append(r["case_key"])
    assert got == brute(q, q_int, c, c_int, src, cfg.top_k, cfg.human_boost)


def test_search_plan_has_no_pair_join(spark, data):
    c, q, c_int, q_int, src = data
    hits = se.search(make_queries(spark, q, q_int), make_index(spark, c, c_int, src))
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "WindowGroupLimit" in plan


def test_top_k_grows_monotonically(spark, data):
    c, q, c_int, *_ = data
    idx = make_index(spark, c, c_int)
    queries = make_queries(spark, q, ["x"] * len(q)).drop("intent")
    few = {(r["query_id"], r["case_key"]) for r in se.nearest(queries, idx, 2).collect()}
    more = {(r["query_id"], r["case_key"]) for r in se.nearest(queries, idx, 6).collect()}
    assert few < more and len(few) == 2 * len(q)


def test_boost_and_clamp(spark):
    v = np.eye(DIM)
    idx = make_index(spark, np.array([v[0], -v[0]]), ["a", "a"], ["human_resolved", "agent_generated_approved"])
    q = make_queries(spark, np.array([0.7 * v[0] + np.sqrt(1 - 0.49) * v[1]]), ["a"])
    rows = se.search(q, idx).orderBy("hit_rank").collect()
    assert [(r["raw_similarity"], r["similarity_score"]) for r in rows] == [(0.7, 0.75), (0.0, 0.0)]


def test_missing_distance_counts_half(spark):
    row = spark.range(1).select(se.raw_similarity(F.lit(None).cast("double")).alias("r")).first()
    assert row["r"] == 0.5


def test_cell_search_with_all_cells_is_exact(spark, data):
    c, q, c_int, q_int, src = data
    idx, queries = make_index(spark, c, c_int, src), make_queries(spark, q, q_int)
    centres = se.fit_cells(idx, 4)
    full = se.search_cells(queries, idx, centres, probes=4)
    rec = se.recall_at_k(se.search(queries, idx), full).first()
    assert rec["recall"] == 1.0 and rec["exact_hits"] == rec["found_hits"]
    some = se.recall_at_k(se.search(queries, idx), se.search_cells(queries, idx, centres, probes=1)).first()
    assert 0.0 < some["recall"] <= 1.0


@pytest.mark.parametrize("clustered", [True, False])
def test_exact_cell_search_equals_search(spark, data, clustered):
    c, q, c_int, q_int, src = data
    if clustered:  # tight groups, so that cells are really skipped
        rng = np.random.default_rng(9)
        mid = unit(rng, 6)
        c = mid[np.arange(150) % 6] + rng.normal(scale=0.02, size=(150, DIM))
        q = mid[np.arange(60) % 6] + rng.normal(scale=0.02, size=(60, DIM))
        c /= np.linalg.norm(c, axis=1, keepdims=True)
        q /= np.linalg.norm(q, axis=1, keepdims=True)
    idx, queries = make_index(spark, c, c_int, src), make_queries(spark, q, q_int)
    order = lambda df: sorted((r["query_id"], r["hit_rank"], r["case_key"]) for r in df.collect())
    fast = se.search_cells(queries, idx, se.fit_cells(idx, 6), probes=1, exact=True)
    assert order(fast) == order(se.search(queries, idx))


def test_open_cells_skips_far_cells(spark):
    centres, radii = np.eye(3), np.array([0.1, 0.1, 0.1])
    df = spark.createDataFrame([([1.0, 0.0, 0.0], 0.9), ([0.6, 0.8, 0.0], 0.2)], "v array<double>, s double")
    got = [r[0] for r in df.select(se.open_cells(F.col("v"), F.col("s"), centres, radii, 1)).collect()]
    assert got == [[], [0]]


def test_empty_index_gives_no_hits(spark, data):
    c, q, c_int, q_int, src = data
    idx = make_index(spark, c, c_int, src).limit(0)
    assert se.search(make_queries(spark, q, q_int), idx).count() == 0


def test_upsert_is_idempotent_and_last_write_wins(spark):
    idx = make_index(spark, np.eye(DIM)[:3], ["a"] * 3)
    change = idx.where("case_key = 'k0001'")
    rows = change.withColumn("resolution", F.lit("first")).withColumn("seq", F.lit(1)).unionByName(
        change.withColumn("resolution", F.lit("second")).withColumn("seq", F.lit(2)))
    once = ix.upsert(idx, rows)
    twice = ix.upsert(once, rows)
    assert sorted(once.collect()) == sorted(twice.collect())
    assert {r["case_key"]: r["resolution"] for r in once.collect()} == {"k0000": "res 0", "k0001": "second", "k0002": "res 2"}


def test_case_key(spark):
    df = spark.createDataFrame([(None, 7, " hi "), ("", 7, "hi"), ("c", 7, "hi")], "case_id string, ticket_id long, ticket_text string")
    df = df.withColumn("embedding", F.array(F.lit(1.0)))
    keys = [r["case_key"] for r in ix.to_index_rows(df).select("case_key").collect()]
    assert keys == ["7_49f68a5c", "7_49f68a5c", "c_49f68a5c"]


def greedy(vectors, bound=0.96):
    kept = []
    for i, v in enumerate(vectors):
        if all(round(float(v @ vectors[j]), 4) <= bound for j in kept):
            kept.append(i)
    return kept


@pytest.mark.parametrize("block", [4096, 5])
def test_batch_admission_equals_one_by_one(spark, block):
    rng = np.random.default_rng(3)
    base = unit(rng, 12)
    noisy = np.repeat(base, 6, axis=0) + rng.normal(scale=0.08, size=(72, DIM))
    v = noisy / np.linalg.norm(noisy, axis=1, keepdims=True)
    v[10] = v[40] = v[60] = v[3]
    # A chain: each near the one before, ends far apart.
    angles = np.arange(12) * 0.2
    chain = np.zeros((12, DIM))
    chain[:, 0], chain[:, 1] = np.cos(angles), np.sin(angles)
    v = np.concatenate([v, chain])
    idx = make_index(spark, np.eye(DIM)[7:8], ["a"])
    approvals = spark.createDataFrame(
        [(i, f"query {i}", "reply", "a", v[i].tolist()) for i in range(len(v))],
        "seq long, query string, reply string, intent string, embedding array<double>")
    cfg = TriageConfig(block_rows=block, query_rows=block)
    added = ix.add_approved(idx, approvals, cfg).select("document").collect()
    far = [i for i in range(len(v)) if round(float(v[i][7]), 4) <= 0.96]
    want = {f"query {far[i]}" for i in greedy(v[far])}
    assert {r["document"] for r in added} == want


def test_approved_text_is_redacted(spark):
    rows = spark.createDataFrame([(1, " mail a@b.com ", " ok ", "a", [1.0])],
                                 "seq long, query string, reply string, intent string, embedding array<double>")
    r = ix.approvals_to_rows(rows).first()
    assert r["document"] == "mail [EMAIL]" and r["resolution"] == "ok"
    assert r["case_id"].startswith("agent_approved_") and len(r["case_id"]) == len("agent_approved_") + 10


def test_links_keep_what_hangs_together_in_any_blocks(spark):
    from ticketloom.operators import blocks, clustering as cl

    v = np.repeat(np.eye(DIM)[:3], [40, 30, 20], axis=0)
    points = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id bigint, vector array<double>")
    links = blocks.linked(points.withColumnRenamed("id", "query_id"), points.withColumnRenamed("id", "case_key"), 0.9, 16, 16)
    rows = links.collect()
    side = lambda i: 0 if i < 40 else 1 if i < 70 else 2
    # 6 x 6 pairs of blocks, in each fewer rows than ids: not one row per pair of near points.
    assert all(side(a) == side(b) for a, b in rows) and len(rows) < 90 * 6 * 2 < 40 * 40 + 30 * 30 + 20 * 20
    plan = cl.merge_plan(points.select(F.col("id").alias("cluster_id"), F.col("vector").alias("centroid")), 0.9)
    got = {r["name"]: r["source_cluster_ids"] for r in plan.collect()}
    assert got == {"cluster_0": list(range(40)), "cluster_40": list(range(40, 70)), "cluster_70": list(range(70, 90))}


def test_size_of_a_product_costs_no_rows(spark, data):
    """Small blocks are a matter of the task: a query leaves k rows per tile, not per block."""
    from ticketloom.operators import blocks

    c, q, c_int, _, _ = data
    cases = make_index(spark, c, c_int).select("case_key", F.col("embedding").alias("vector"))
    asked = make_queries(spark, q, c_int[:60]).drop("intent")
    want = sorted(map(tuple, blocks.top_k_pairs(asked, cases, 5, 4096, 4096).collect()))
    got = sorted(map(tuple, blocks.top_k_pairs(asked, cases, 5, 16, 60).collect()))
    assert len(got) == 60 * 5 and got == want
    cells = se.probed_cells(se.fit_cells(make_index(spark, c, c_int), 6), 6)
    homed = cases.withColumn("cell", F.pmod(F.xxhash64("case_key"), F.lit(6)).cast("int"))
    asked = asked.withColumn("floor", F.lit(-1.0))
    assert sorted(map(tuple, blocks.top_k_pairs(asked, homed, 5, 16, 60, cells=cells).collect())) == want


@pytest.mark.parametrize("tile", [400, 3000])
def test_cells_along_many_tiles(spark, data, monkeypatch, tile):
    from ticketloom.operators import blocks

    c, q, c_int, q_int, src = data
    idx, queries = make_index(spark, c, c_int, src), make_queries(spark, q, q_int)
    order = lambda df: sorted((r["query_id"], r["hit_rank"], r["case_key"]) for r in df.collect())
    want = order(se.search(queries, idx))
    monkeypatch.setattr(blocks, "TILE_BYTES", tile)
    assert order(se.search(queries, idx)) == want
    assert order(se.search_cells(queries, idx, se.fit_cells(idx, 6), probes=2)) == want
    rows = idx.withColumns({"case_key": F.concat(F.lit("new"), "case_key"), "seq": F.lit(1).cast("bigint")})
    assert ix.not_near_index(rows, idx).isEmpty()
