"""Chunks that take their tiles one after another, and tiles that cells open all over."""

import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as registry
from ticketloom.catalog import retrieval
from ticketloom.operators import blocks
from ticketloom.operators import index as ix
from ticketloom.operators import search as se
from ticketloom.session import scratch_scope


def stored_rows(spark, folder):
    """Rows in stored pieces, by name."""
    folder, stored = folder.removeprefix("file:"), {}
    for f in os.listdir(folder):
        for r in spark.read.parquet(f"{folder}/{f}").collect():
            for name in {"asked", "held"} & set(r.asDict()):
                stored[name] = stored.get(name, 0) + blocks._as_table(r[name]).num_rows
    return stored


def test_tiles_that_every_query_visits_are_stored_once(spark, monkeypatch):
    """Cells that all queries open: no row is stored once per tile or chunk, and the near rows are those of all pairs."""
    monkeypatch.setattr(blocks, "TILE_BYTES", 800)
    rng = np.random.default_rng(7)
    vectors = rng.normal(size=(90, 6))
    vectors[60:] = vectors[:30] + rng.normal(size=(30, 6)) * 0.05
    rows = spark.createDataFrame(
        [(i, i % 5, [float(x) for x in v]) for i, v in enumerate(vectors)], "id long, cell int, vector array<double>")
    queries = rows.select(F.col("id").alias("query_id"), "vector", F.col("id").alias("seq"), F.lit(0.9).alias("floor"))
    cases = rows.select(F.col("id").cast("string").alias("case_key"), "vector", F.col("id").alias("seq"), "cell")
    cells = se.bounded_cells(np.eye(6)[:5], np.full(5, np.pi))  # a radius that no query is out of
    with scratch_scope(spark, "visits-test") as folder:
        got = {r["query_id"] for r in blocks.any_above(queries, cases, 0.9, 4096, 4096, cells).collect()}
        assert stored_rows(spark, folder) == {"asked": 90, "held": 90}
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    near = np.tril(unit @ unit.T > 0.9, -1)
    assert got == set(np.flatnonzero(near.any(axis=1)).tolist()) and len(got) >= 30


@pytest.mark.parametrize("sizes", [(4096, 4096), (7, 5)])
def test_a_chunk_keeps_the_k_best_of_all_its_tiles(sizes):
    """Ties of several tiles go to the smaller key, in whatever order the tiles come."""
    rng = np.random.default_rng(1)
    left, right = rng.integers(-1, 2, size=(40, 3)).astype(float), rng.integers(-1, 2, size=(200, 3)).astype(float)
    q = pa.table({"query_id": np.arange(40), "vector": pa.array(left.tolist())})
    keys = [f"k{i:03d}" for i in rng.permutation(200)]
    tiles = [pa.table({"case_key": keys[i::4], "vector": pa.array(right[i::4].tolist())}) for i in (2, 0, 3, 1)]
    chunk = blocks._TopK(q, 5, *sizes, (), None)
    for tile in tiles:
        chunk.add(tile)
    (found,) = chunk.pieces()
    unit = [m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12) for m in (left, right)]
    scores = np.round(unit[0] @ unit[1].T, 9)
    wanted = {(i, key) for i in range(40) for _, key in sorted((-s, key) for s, key in zip(scores[i], keys))[:5]}
    assert set(zip(found["query_id"].tolist(), found["case_key"].tolist())) == wanted and len(found["query_id"]) == 200


def test_a_query_leaves_a_task_with_k_rows_whatever_its_tiles(spark, monkeypatch):
    """Eighty tiles of a chunk: rows leave per task, not per tile."""
    rng = np.random.default_rng(2)
    rows = spark.createDataFrame(
        [(i, [float(x) for x in rng.normal(size=4)]) for i in range(1200)], "id long, vector array<double>")
    monkeypatch.setattr(blocks, "TILE_BYTES", 1000)
    queries = rows.where("id < 10").select(F.col("id").alias("query_id"), "vector")
    cases = rows.select(F.format_string("k%04d", "id").alias("case_key"), "vector")
    pairs = blocks.top_k_pairs(queries, cases, 3, 4096, 4096).collect()
    assert len(pairs) <= 10 * 3 * (3 * spark.sparkContext.defaultParallelism + 1)
    assert len({r["query_id"] for r in pairs}) == 10


def test_many_equal_similarities_are_cut_to_k():
    """A zero vector is as similar to every case: the least columns, also where all tie."""
    left, right = np.zeros((3, 2)), np.tile([1.0, 0.0], (5000, 1))
    left[1, 0] = 1.0
    row, col, score = blocks.top_k_of_tile(left, left.astype("float32"), right, 2, np.array([-np.inf, -np.inf, 0.5]), 4096, 4096)
    assert sorted(zip(row, col, score)) == [(0, 0, 0.0), (0, 1, 0.0), (1, 0, 1.0), (1, 1, 1.0)]


def test_texts_of_approvals_do_not_move_for_their_keys(spark):
    """The key is made of a digest below the joins, so no text is among the columns that they read; and it is the same key."""
    given = retrieval.approvals(spark, registry.SMOKE_DIR)
    keys = ix.approvals_to_rows(given).select("case_key", "seq")
    plan = keys._jdf.queryExecution().optimizedPlan().toString()
    joins = plan[:plan.index("md5(")]
    assert "Join" in joins and "text#" not in joins
    assert sorted(map(tuple, keys.collect())) == sorted(
        map(tuple, ix.approvals_to_rows(given.drop("query_md5")).select("case_key", "seq").collect()))
