"""Lexical search, rank fusion and the near-duplicate check against brute force."""

import math
import os
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ticketloom.config import TriageConfig
from ticketloom.operators import blocks
from ticketloom.operators import lexical as lx
from ticketloom.operators import overlap as ov
from ticketloom.session import scratch_dir, scratch_scope

from tests.test_search import make_index

WORD = re.compile(r"[^\W_]+")


def bm25_by_hand(cases, queries, k):
    bags = {key: Counter(WORD.findall(text.lower())) for key, text in cases}
    n, mean = len(cases), sum(sum(b.values()) for b in bags.values()) / len(cases)
    df = Counter(t for b in bags.values() for t in b)
    out = {}
    for query_id, text in queries:
        scores = []
        for key, bag in bags.items():
            length, score = float(sum(bag.values())), 0
            for term, times in Counter(WORD.findall(text.lower())).items():
                if term in bag:
                    tf = float(bag[term])
                    rarity = math.log(1.0 + (n - df[term] + 0.5) / (df[term] + 0.5))
                    score += times * math.floor(1e6 * (rarity * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean)))) + 0.5)
            if score:
                scores.append((-score, key))
        out |= {(query_id, r): (key, -s) for r, (s, key) in enumerate(sorted(scores)[:k], 1)}
    return out


@pytest.mark.parametrize("cfg", [TriageConfig(), TriageConfig(block_rows=20, query_rows=7)])
def test_bm25_equals_brute_force(spark, cfg):
    rnd = random.Random(6)
    words = [f"Word{i}" for i in range(40)]
    cases = [(f"c{i:03d}", "common " + " ".join(rnd.choices(words, k=rnd.randint(0, 25)))) for i in range(150)]
    cases += [("d1", ""), ("d2", "E-404 error; E-404"), ("d3", "e 404 ERROR e 404"), ("d4", "Ünïcode wörter")]
    queries = [(i, " ".join(rnd.choices(words, k=rnd.randint(1, 6)))) for i in range(30)]
    queries += [(50, "common"), (51, "error E-404"), (52, ""), (53, "nobody knows"), (54, "WÖRTER wörter"), (55, None)]
    index = lx.inverted_index(spark.createDataFrame(cases, "case_key string, document string"))
    got = lx.bm25_search(spark.createDataFrame(queries, "query_id bigint, text string"), index, 5, cfg).collect()
    want = bm25_by_hand(cases, [(i, t or "") for i, t in queries], 5)
    assert {(r["query_id"], r["hit_rank"]): (r["case_key"], r["score"]) for r in got} == want and len(got) == len(want)


def test_bm25_of_an_empty_index(spark):
    empty = lx.inverted_index(spark.createDataFrame([], "case_key string, document string"))
    assert lx.bm25_search(spark.createDataFrame([(1, "a")], "query_id bigint, text string"), empty, 5).collect() == []


def test_rankings_are_fused_by_reciprocal_rank(spark):
    rows = "query_id bigint, case_key string, rank int"
    dense = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3), (2, "z", 1)], rows)
    lexical = spark.createDataFrame([(1, "c", 1), (1, "d", 2)], rows)
    got = {(r["query_id"], r["hit_rank"]): r for r in lx.fuse_rankings({"dense": dense, "lexical": lexical}, 3).collect()}
    assert [got[1, i]["case_key"] for i in (1, 2, 3)] == ["c", "a", "b"]  # b and d tie
    assert got[1, 1]["fused"] == round(1 / 63 + 1 / 61, 12) and got[1, 1]["dense_rank"] == 3 and got[1, 2]["lexical_rank"] is None
    assert got[2, 1]["case_key"] == "z" and len(got) == 4


def test_hybrid_finds_what_either_search_finds(spark):
    import numpy as np

    vectors = np.eye(16)[:6]
    index = make_index(spark, vectors, ["a"] * 6).withColumn("document", F.when(F.col("case_key") == "k0005", "code E404").otherwise("text"))
    q = spark.createDataFrame([(1, "what is E404", vectors[0].tolist()), (2, "", vectors[1].tolist())], "query_id bigint, text string, vector array<double>")
    got = {(r["query_id"], r["hit_rank"]): r["case_key"] for r in lx.hybrid_search(q, index, lx.inverted_index(index)).collect()}
    assert {got[1, 1], got[1, 2]} == {"k0000", "k0005"} and got[2, 1] == "k0001"


# --- near-duplicates of the holdout

def shingles_by_hand(text, n=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {" ".join(words[i:i + n]) for i in range(max(len(words) - n + 1, 1))} if words else set()


def texts_with_copies(seed, count):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    base = [[rnd.choice(words) for _ in range(rnd.randint(3, 120))] for _ in range(count // 4)]
    for i in range(count):
        text = list(base[i % len(base)])
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 4, 9])):
            text[rnd.randrange(len(text))] = rnd.choice(words)
        yield " ".join(text[rnd.choice([0, 0, 0, 3]):])


@pytest.mark.parametrize("threshold", [0.8, 0.5])
def test_near_holdout_equals_brute_force(spark, threshold):
    golden = list(enumerate(texts_with_copies(1, 80))) + [(200, None), (201, ""), (202, "Only Four Words Here"), (203, "same same same")]
    index = [(f"k{i:03d}", t) for i, t in enumerate(texts_with_copies(1, 160))]
    index += [("x1", None), ("x2", " "), ("x3", "only four words here"), ("x4", "only four words here"), ("x5", "same same same")]
    g = spark.createDataFrame(golden, "ticket_id bigint, ticket_text string").withColumn("tokens", F.lit(1))
    df = spark.createDataFrame(index, "case_key string, document string").withColumn("jaccard", F.lit("own"))
    sets = [(k, shingles_by_hand(t)) for k, t in index]
    want, close = {}, set()
    for i, text in golden:
        own = shingles_by_hand(text)
        for key, other in sets:
            j = len(own & other) / len(own | other) if own and other else 0
            if j >= threshold:
                close.add(key)
                want[i] = min(want.get(i, (0, "")), (-j, key))
    got = {r["ticket_id"]: (r["case_key"], r["jaccard"]) for r in ov.near_holdout(g, df, threshold).collect()}
    assert got == {i: (key, round(-j, 6)) for i, (j, key) in want.items()} and len(got) > 20
    left = ov.without_near(df, g, threshold)
    assert {r["case_key"] for r in left.collect()} == {k for k, _ in index} - close and left.columns == df.columns


def test_near_holdout_with_one_text_in_most_rows(spark):
    """Copies are compared once, whatever their number."""
    text = " ".join(f"w{i}" for i in range(60))
    g = spark.range(2000).select(F.col("id").alias("ticket_id"), F.lit(text).alias("ticket_text"))
    df = spark.range(2000).select(F.concat(F.lit("k"), F.format_string("%05d", "id")).alias("case_key"), F.lit(text + " more").alias("document"))
    got = ov.near_holdout(g, df).select("case_key", "jaccard").distinct().collect()
    assert [tuple(r) for r in got] == [("k00000", round(56 / 57, 6))] and ov.near_holdout(g, df).count() == 2000


def test_near_holdout_of_empty_tables(spark):
    g = spark.createDataFrame([(1, "a b c d e f")], "ticket_id bigint, ticket_text string")
    df = spark.createDataFrame([], "case_key string, document string")
    assert ov.near_holdout(g, df).collect() == [] and ov.without_near(df, g).collect() == []


def test_terms_of_a_case_are_counted_where_it_lies(spark, monkeypatch):
    """No row per case and term is stored, unless the table of terms is too large to be sent to every task."""
    cases = spark.createDataFrame(
        [(f"c{i}", " ".join(f"w{j % 7}" for j in range(i, 3 * i))) for i in range(1, 40)], "case_key string, document string")
    found = []
    for limit, stored in ((blocks.MAX_PLAN_BYTES, 0), (0, 1)):
        monkeypatch.setattr(blocks, "MAX_PLAN_BYTES", limit)
        with scratch_scope(spark, "terms-test") as folder:
            found.append(sorted(map(tuple, lx.inverted_index(cases).collect())))
            assert sum(f.startswith("term-counts") for f in os.listdir(folder.removeprefix("file:"))) == stored
    assert found[0] == found[1] and len(found[0]) == 39


def test_shingles_are_computed_once_a_text(spark, monkeypatch):
    """The filter of texts without words reads the text, not its shingles."""
    plans, real = [], ov.materialise
    monkeypatch.setattr(ov, "materialise", lambda df, name: plans.append(
        df._jdf.queryExecution().optimizedPlan().toString()) or real(df, name))
    path = scratch_dir(spark, "texts")
    spark.createDataFrame([(1, "a b"), (2, " \t"), (3, None), (4, "A  b")], "ticket_id int, ticket_text string").write.parquet(path)
    rows, sets = ov._sets(spark.read.parquet(path), "ticket_id", "ticket_text", 5, "texts")
    assert {r["key"] for r in rows.collect()} == {1, 4} and sets.count() == 1
    filters = [line for line in plans[0].split("\n") if "Filter" in line]
    assert filters and not any("transform(" in line for line in filters), plans[0]


def test_the_driver_gets_only_the_frequent_shingles(spark, monkeypatch):
    """Of the shingles that two sets hold at least, those of most sets, and no more of those that tie than fit."""
    held = {i: 1 + i % 5 for i in range(4000)}  # shingle -> sets that hold it
    sets = spark.createDataFrame(
        [(n, [(i * 0x9E3779B97F4A7C15 + 2**63) % 2**64 - 2**63 for i, many in held.items() if many > n]) for n in range(5)],
        "set_id int, tokens array<bigint>")
    mark = {(i * 0x9E3779B97F4A7C15 + 2**63) % 2**64 - 2**63: many for i, many in held.items()}
    plans, real = [], type(sets).collect
    monkeypatch.setattr(type(sets), "collect", lambda df: plans.append(
        df._jdf.queryExecution().optimizedPlan().toString()) or real(df))
    for room, least in ((10_000, 2), (1000, 4), (1700, 3), (1, 6)):
        monkeypatch.setattr(ov, "FREQUENT", room)
        found = ov._frequent(sets).tolist()
        wanted = {t for t, many in mark.items() if many >= max(least, 2)}
        tied = [t for t, many in mark.items() if many == least]
        assert found == sorted(set(found)) and len(found) <= room and {mark[t] for t in found} <= set(range(least, 6)) | {5}
        if room == 10_000:
            assert set(found) == wanted
        elif room >= 1000:
            above = {t for t in wanted if mark[t] > least}
            assert above <= set(found) and len(found) > room - 20
            # Of those that tie the least are taken.
            assert {t for t in found if mark[t] == least} == set(sorted(tied)[:len(found) - len(above)])
    assert not any("Limit" in plan and f"Limit {room}" in plan for plan in plans for room in (10_000, 1000, 1700))


def test_queries_of_equal_terms_are_searched_once(spark):
    """Ninety queries ask three things: three rows meet the cases, and all have their hits."""
    cases = spark.createDataFrame(
        [(f"c{i:02d}", " ".join(f"w{j}" for j in range(i % 4, 4))) for i in range(40)], "case_key string, document string")
    texts = ["w0 w1", "W1, w0", "w3", "w2 w2 nowhere"]
    queries = spark.createDataFrame([(i, texts[i % 4]) for i in range(120)], "query_id bigint, text string")
    index = lx.inverted_index(cases)
    with scratch_scope(spark, "questions-test") as folder:
        got = lx.bm25_search(queries, index, 3).collect()
        folder = folder.removeprefix("file:")
        asked = [spark.read.parquet(f"{folder}/{f}").count() for f in os.listdir(folder) if f.startswith("distinct-queries")]
    assert asked == [3]
    want = bm25_by_hand([tuple(r) for r in cases.collect()], [tuple(r) for r in queries.collect()], 3)
    assert {(r["query_id"], r["hit_rank"]): (r["case_key"], r["score"]) for r in got} == want and len(got) == len(want) == 360


def test_bm25_over_many_tiles_equals_brute_force(spark, monkeypatch):
    """What a tile has found bounds the next; ties of several tiles go to the smaller key."""
    rnd = random.Random(9)
    words = [f"w{i}" for i in range(12)]
    cases = [(f"c{i:03d}", " ".join(rnd.choices(words, k=rnd.randint(1, 5)))) for i in range(200)]
    queries = [(i, " ".join(rnd.choices(words, k=rnd.randint(1, 4)))) for i in range(40)]
    index = lx.inverted_index(spark.createDataFrame(cases, "case_key string, document string"))
    monkeypatch.setattr(blocks, "TILE_BYTES", 2000)
    got = lx.bm25_search(spark.createDataFrame(queries, "query_id bigint, text string"), index, 4).collect()
    want = bm25_by_hand(cases, queries, 4)
    assert {(r["query_id"], r["hit_rank"]): (r["case_key"], r["score"]) for r in got} == want and len(got) == len(want)
