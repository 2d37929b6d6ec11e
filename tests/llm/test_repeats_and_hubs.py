"""Passages and lines against brute force; hubs, long inputs and empty tables."""

import random
import re
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ticketloom.llm import chat, components, line_dedup, maxscore, mixing, simhash, substring_dedup

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


# --- repeated passages

def passages_by_hand(docs, least):
    """id -> text without passages: sentences of earlier documents, grown by equal words."""
    def split(text):
        out, at = [], 0
        for piece in re.split(r"(?<=\n)|(?<=[.!?])(?=[\x20\x09-\x0D])|(?<=[。！？])", text):
            words = [(m.group().lower(), at + m.start()) for m in re.finditer(r"[^\x20\x09-\x0D]+", piece)]
            if words:
                out.append((words, at + len(piece)))
            at += len(piece)
        return out

    first, known, result = {}, {}, {}
    for i, text in sorted(docs):
        known[i] = split(text)
        for n, (words, _) in enumerate(known[i]):
            first.setdefault(tuple(w for w, _ in words), (i, n))
    for i, text in docs:
        units = known[i]
        place = [first[tuple(w for w, _ in words)] for words, _ in units]
        flags = [p[0] != i for p in place]
        gone = set()
        a = 0
        while a < len(units):
            if not flags[a]:
                a += 1
                continue
            b = a
            while b + 1 < len(units) and flags[b + 1]:
                b += 1
            inner = [w for u in units[a:b + 1] for w in u[0]]
            left, right = [], []
            d, n = place[a]
            if a and n:
                for mine, theirs in zip(units[a - 1][0][::-1], known[d][n - 1][0][::-1]):
                    if mine[0] != theirs[0]:
                        break
                    left.append(mine)
            d, n = place[b]
            if b + 1 < len(units) and n + 1 < len(known[d]):
                for mine, theirs in zip(units[b + 1][0], known[d][n + 1][0]):
                    if mine[0] != theirs[0]:
                        break
                    right.append(mine)
            if len(inner) + len(left) + len(right) >= least:
                gone |= {at for _, at in [*left, *inner, *right]}
            a = b + 1
        kept = [w for words, _ in units for w in words if w[1] not in gone]
        result[i] = [w for w, _ in kept]
    return result


def test_passages_equal_brute_force(spark):
    rnd = random.Random(4)
    words = [f"w{i}" for i in range(400)] + ["Ärger", "ÉTÉ"]

    def sentence():
        return " ".join(rnd.choices(words, k=rnd.randint(1, 14))) + rnd.choice([".", ".", "!", "?", "。", "\n", ".\n\n"])

    passage = [" ".join(sentence() for _ in range(rnd.randint(1, 9))) for _ in range(12)]
    docs = []
    for i in range(160):
        parts = [sentence() for _ in range(rnd.randint(0, 6))]
        for _ in range(rnd.randint(0, 2)):
            text = rnd.choice(passage)
            if rnd.random() < 0.3:  # a part of a passage, cut anywhere
                cut = text.split(" ")
                text = " ".join(cut[rnd.randint(0, len(cut) // 3):rnd.randint(2 * len(cut) // 3, len(cut))])
            parts.insert(rnd.randint(0, len(parts)), rnd.choice(["", "glued "]) + text + rnd.choice(["", " glued"]))
        docs.append((i, " ".join(parts)))
    docs += [(500, docs[3][1]), (501, docs[3][1].upper()), (502, " \n "), (503, passage[0] * 3)]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in docs], DOCS).repartition(5)
    for least in (51, 20, 1):
        want = passages_by_hand(docs, least)
        got = substring_dedup.dedup_passages(df, min_words=least).collect()
        texts = dict(docs)
        assert len(got) == len(docs)
        for r in got:
            text = texts[r["doc_id"]]
            kept = [text[s["start"]:s["start"] + s["length"]] for s in r["kept_spans"]]
            assert "".join(kept) == r["text"] and len(r["removed_spans"]) == r["n_removed"]
            assert re.findall(r"[^\x20\x09-\x0D]+", r["text"].lower()) == want[r["doc_id"]]
            both = sorted([*map(tuple, r["kept_spans"]), *map(tuple, r["removed_spans"])])
            assert sum(n for _, n in both) == len(text) and all(a + n == b for (a, n), (b, _) in zip(both, both[1:]))
        assert sum(r["n_removed"] > 0 for r in got) > 10


def test_passages_of_odd_rows(spark):
    long = " ".join(f"word{i}" for i in range(60)) + "."
    rows = [(1, f"Head. {long}"), (1, f"Head. {long}"), (None, long), (2, None), (3, ""), (4, f"other {long} tail"), (5, long.upper()),
            (1, f"Another text under one id. {long}")]
    df = spark.createDataFrame([(i, t, None, None, 1) for i, t in rows], DOCS).withColumnsRenamed({"lang": "hash", "source": "runs"})
    got = sorted(((r["doc_id"], r["text"]) for r in substring_dedup.dedup_passages(df).collect()), key=str)
    kept = "Head. "  # the blank before a passage stays
    want = [(1, kept), (1, kept), (None, long), (2, None), (3, ""), (4, "other tail"), (5, ""), (1, "Another text under one id. ")]
    want[5] = (4, f"other {long} tail")  # the passage is inside one sentence: not found
    assert [(i, t and t.strip()) for i, t in got] == [(i, t and t.strip()) for i, t in sorted(want, key=str)]
    assert substring_dedup.dedup_passages(df.limit(0)).count() == 0


# --- repeated lines

def lines_by_hand(docs):
    """id -> lines that go: every two filled lines in a row that an earlier place has."""
    chunks, first = [], {}
    for i, text in docs:
        lines = text.split("\n")
        filled = [n for n, x in enumerate(lines) if x.strip(" \t\n\v\f\r")]
        for a, b in zip(filled, filled[1:]):
            body = "\n".join(lines[a:b + 1])
            chunks.append((i, a, b, body))
            first[body] = min(first.get(body, (i, a)), (i, a))
    gone = {i: set() for i, _ in docs}
    for i, a, b, body in chunks:
        at = first[body]
        if at != (i, a) and not (at[0] == i and a < at[1] + b - a + 1):
            gone[i] |= set(range(a, b + 1))
    return gone


def test_lines_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "SALT_ROWS", 7)  # frequent chunks are met under many salts
    rnd = random.Random(8)
    pool = [f"line {i}" for i in range(25)] + ["", " ", "häufig"]
    docs = [(i, "\n".join(rnd.choice(pool) for _ in range(rnd.randint(0, 14)))) for i in range(150)]
    docs += [(200 + i, f"own {i}\nthe same\nthe same too\nend {i}") for i in range(90)] + [(300, "\n".join(f"l{i}" for i in range(4000)))]
    docs += [(301, docs[-1][1])]
    want = lines_by_hand(docs)
    got = line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    for r in got:
        lines = dict(docs)[r["doc_id"]].split("\n")
        assert {n for s in r["removed"] for n in range(s["line"], s["line"] + s["n_lines"])} == want[r["doc_id"]]
        assert r["text"] == "\n".join(x for n, x in enumerate(lines) if n not in want[r["doc_id"]])
    assert sum(r["n_removed"] for r in got) > 4000


# --- chat

def test_roles_and_texts_keep_every_character(spark):
    names = ["a\0b", "\\", "\\\\n", "x\ny", "\\n\\\\", "[INST]\\", "<s>", "", "\\\n\\n", "[\\INST]"]
    rows = [(i, t, names[(i + t) % len(names)], names[(3 * i + t) % len(names)] + "</s>") for i in range(20) for t in range(6)]
    rows += [(99, t, "assistant" if t % 2 else "user", f"turn {t} [NEXT]") for t in range(3000)] + [(100, 0, "assistant", "ß<s>\\" * 200_000)]
    out = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    back = {r["conv_id"]: [(t["role"], t["text"]) for t in r["t"]] for r in out.select("conv_id", chat.read_back(F.col("formatted")).alias("t")).collect()}
    for i in back:
        assert back[i] == [(role, text) for c, t, role, text in sorted(rows, key=lambda r: r[1]) if c == i]


# --- exact top-k

def test_maxscore_reads_fewer_postings_than_a_product():
    rng = np.random.default_rng(5)
    vectors = np.round(rng.normal(size=(20_000, 48)) * 40 * 0.85 ** np.arange(48)).astype(np.int64)
    ids, queries, counts = np.arange(20_000), vectors[::1000], {}
    found = maxscore.top_k(np.arange(0, 20_000, 1000), queries, ids, vectors, 5, counts)
    scores = queries @ vectors.T
    at = 0
    for n, own in enumerate(range(0, 20_000, 1000)):
        best = sorted((-int(s), i) for i, s in enumerate(scores[n]) if i != own)[:5]
        assert [(-s, i) for s, i in best] == list(zip(found[2][at:at + 5].tolist(), found[1][at:at + 5].tolist()))
        at += 5
    assert counts["postings"] < 0.5 * queries.shape[0] * vectors.size


def test_maxscore_ignores_nulls_and_other_columns(spark):
    rows = [(0, [1, 2], "a"), (1, [3, None], "b"), (2, [5, 1], "c"), (2, [5, 1], "d"), (3, [0, 0], "e")]
    df = spark.createDataFrame(rows, "vec_id long, vector array<long>, score string").withColumn("rank", F.lit("x"))
    got = maxscore.maxscore_search(df.withColumnRenamed("vec_id", "query_id"), df).collect()
    assert sorted((r["query_id"], r["vec_id"], r["score"]) for r in got) == [(0, 2, 7), (0, 3, 0), (2, 0, 7), (2, 3, 0), (3, 0, 0), (3, 2, 0)]


# --- hubs

def test_components_with_a_hub_of_most_nodes(spark):
    star = spark.range(1, 20_000).select((F.col("id") * 3).alias("a"), F.lit(29_999).cast("long").alias("b"))
    chain = spark.range(100).select((F.col("id") * 3 + 100_000).alias("a"), (F.col("id") * 3 + 100_003).alias("b"))
    got = components.components(star.union(chain)).groupBy("component").count().collect()
    assert {tuple(r) for r in got} == {(3, 20_000), (100_000, 101)}


def test_simhash_of_one_group_and_nothing(spark):
    base = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(base[:200] + [f"own{i}"] + base[200:])) for i in range(300)] + [(900, None), (901, ""), (902, "  ")]
    got = {r["doc_id"]: r["component_id"] for r in simhash.simhash_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    prints = {i: simhash.fingerprint(t) for i, t in rows}
    assert all((prints[i] ^ prints[j]).bit_count() > 3 for i in got for j in got if got[i] != got[j])
    assert got[901] == got[902] == 900 and len(got) == 303


# --- mixing

def test_mixture_of_blank_texts(spark):
    df = spark.createDataFrame([(i, [None, "", " \n"][i % 3], f"s{i % 2}") for i in range(30)], "doc_id long, text string, source string")
    got = mixing.mixture(df).collect()
    assert len(got) == 30 and all((r["size"], r["source_size"], r["target"], r["taken"]) == (0, 0, 0.0, 0) for r in got)
    assert mixing.mixed_documents(df).count() == 0


# --- the pipeline

@pytest.fixture(scope="module")
def odd_tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("odd")
    for name in ("labels", "benchmark"):
        shutil.copy(f"/root/testdata/sf0.001/{name}.parquet", folder)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    long_text = " ".join(f"word{i % 997}" for i in range(30_000))
    rows = [(90_000, None, None, None, None), (90_001, "", "en", None, 0), (None, "no id at all", "en", "a", 1), (90_002, long_text, "en", "b", 1)]
    more = docs.union(spark.createDataFrame(rows, docs.schema)).union(docs.limit(20))
    more = more.withColumns({c: F.lit("own") for c in ("hash", "score", "shard", "print", "size")})
    more.write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_pipeline_of_odd_rows(spark, odd_tables):
    docs = spark.read.parquet(f"{odd_tables}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, odd_tables).columns == docs.columns
    out = corpus_pipeline.run(spark, odd_tables)
    rows = out.collect()
    assert len(rows) > 50 and {r["doc_id"] for r in rows} <= {r["doc_id"] for r in docs.select("doc_id").collect()}


def test_pipeline_of_nothing(spark, odd_tables, tmp_path):
    for name in ("labels", "benchmark"):
        shutil.copy(f"{odd_tables}/{name}.parquet", tmp_path)
    spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
