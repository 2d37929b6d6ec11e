"""What the admission of approvals and the search by cells store and move."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as registry
from ticketloom.catalog import retrieval
from ticketloom.operators import blocks
from ticketloom.operators import index as ix
from ticketloom.operators import search as se
from ticketloom.session import scratch_scope


def test_a_tile_is_sent_once_per_chunk_of_its_visitors(spark, monkeypatch):
    """Ten queries visit each of eight tiles, and ten are a chunk: every case goes to one task."""
    monkeypatch.setattr(blocks, "TILE_BYTES", 720)
    angle = F.col("n") * F.lit(np.pi / 4) + F.col("i") * 1e-4
    rows = spark.range(80).select("id", (F.col("id") % 8).cast("int").alias("n"), F.floor(F.col("id") / 8).alias("i"))
    rows = rows.select("id", "n", F.array(F.cos(angle), F.sin(angle)).alias("vector"))
    at = np.arange(8) * np.pi / 4
    cells = se.bounded_cells(np.stack([np.cos(at), np.sin(at)], axis=1), np.full(8, 0.01))
    out = blocks.meet(
        rows.select(F.col("id").alias("query_id"), "vector", F.lit(0.9999).alias("floor")),
        rows.select(F.col("id").cast("string").alias("case_key"), "vector", F.col("n").alias("cell")),
        lambda q, c: iter([{"asked": np.array([q.num_rows]), "met": np.array([c.num_rows])}]),
        "asked bigint, met bigint", 10, cells=cells)
    assert out.agg(F.sum("asked"), F.sum("met")).first() == (80, 80)


def test_admission_stores_no_texts(spark):
    """Approvals that come twice are one row, with its text; only keys and vectors are stored on the way."""
    rows = [(f"query {i % 6}", f"reply {i % 6}", "a", [float(i % 6 == j) for j in range(6)], i % 6) for i in range(12)]
    approvals = spark.createDataFrame(rows, "query string, reply string, intent string, embedding array<double>, seq bigint")
    cases = spark.createDataFrame(
        [("c", "text", "a", [1.0, 0.0, 0.0, 0.0, 0.0, 0.0])],
        "case_id string, ticket_text string, intent string, embedding array<double>")
    with scratch_scope(spark, "admission-test") as folder:
        got = ix.add_approved(ix.to_index_rows(cases), approvals).select("document", "resolution").collect()
        folder = folder.removeprefix("file:")
        stored = [spark.read.parquet(f"{folder}/{f}").columns for f in os.listdir(folder)]
    assert sorted(map(tuple, got)) == [(f"query {i}", f"reply {i}") for i in range(1, 6)]
    assert stored and not any("document" in columns for columns in stored)


def test_scopes_of_many_tiles_store_every_row_once(spark, monkeypatch):
    """Forty rows of two scopes in many tiles and chunks, one scope in one tile: each pair meets once, and
    what is stored on the way holds every row of the two scopes once, however many tiles there are."""
    rows = spark.range(44).select("id", F.when(F.col("id") < 40, (F.col("id") % 2).cast("string")).otherwise("c").alias("scope"))
    rows = rows.select("id", "scope", F.array(F.col("id").cast("double"), F.lit(1.0)).alias("vector"))
    queries = rows.select(F.col("id").alias("query_id"), "scope", "vector")
    cases = rows.select(F.col("id").cast("string").alias("case_key"), "scope", "vector")

    def all_pairs(q, c):
        a, b = blocks.values(q, "query_id"), blocks.values(c, "case_key")
        yield {"a": np.repeat(a, len(b)), "b": np.tile(b, len(a))}

    for tile in (600, 300):
        monkeypatch.setattr(blocks, "TILE_BYTES", tile)
        with scratch_scope(spark, "tiles-test") as folder:
            out = blocks.meet(queries, cases, all_pairs, "a bigint, b string", 4)
            got = [tuple(r) for r in out.collect()]
            folder, stored = folder.removeprefix("file:"), {}
            for f in os.listdir(folder):
                for r in spark.read.parquet(f"{folder}/{f}").collect():
                    for name in {"asked", "held"} & set(r.asDict()):
                        stored[name] = stored.get(name, 0) + blocks._as_table(r[name]).num_rows
        assert stored == {"asked": 40, "held": 40}
        wanted = [(r.a, str(r.b)) for r in rows.select(F.col("id").alias("a"), "scope").join(
            rows.select(F.col("id").alias("b"), "scope"), "scope").collect()]
        assert sorted(got) == sorted(wanted)


def test_search_is_the_same_by_stored_tiles(spark, monkeypatch):
    rng = np.random.default_rng(3)
    vectors = [[float(x) for x in v] for v in rng.normal(size=(120, 8))]
    cases = spark.createDataFrame(
        [(str(i), "text", "ab"[i % 2], "answer", v) for i, v in enumerate(vectors)],
        "case_id string, ticket_text string, intent string, resolution string, embedding array<double>")
    queries = spark.createDataFrame(
        [(i, ["a", "b", "other"][i % 3], v) for i, v in enumerate(vectors[:50])],
        "query_id long, intent string, vector array<double>")
    index = ix.to_index_rows(cases)
    whole = [tuple(r) for r in se.search(queries, index).orderBy("query_id", "hit_rank").collect()]
    near = [tuple(r) for r in se.nearest(queries, index, 3).orderBy("query_id", "cut_rank").collect()]
    monkeypatch.setattr(blocks, "TILE_BYTES", 1500)
    assert [tuple(r) for r in se.search(queries, index).orderBy("query_id", "hit_rank").collect()] == whole
    assert [tuple(r) for r in se.nearest(queries, index, 3).orderBy("query_id", "cut_rank").collect()] == near


@pytest.mark.parametrize("name", ["v16_approximate_recall", "v11_rerank"])
def test_queries_of_two_searches_are_stored_once(spark, monkeypatch, name):
    names = []
    for module in (se, retrieval):
        monkeypatch.setattr(module, "materialise", lambda df, name, keep=module.materialise, **o: (
            names.append(name), keep(df, name, **o))[1])
    assert registry.queries()[name](spark, registry.SMOKE_DIR).count()
    assert names.count("queries") == 1
