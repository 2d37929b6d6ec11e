"""Ranked lexical search, periodic runs and archives against brute force and round trips."""

import gzip
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ticketloom.llm import lexical, periodic, warc

DOCS = "doc_id long, text string, lang string, source string, term string, rank int, item_id long"


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


# --- ranked lexical search

def ranked_by_hand(docs, items, k):
    """(item, rank) -> (doc_id, score), scored as the formula says, with Python's own integers."""
    def terms(text):
        small = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", small)

    counted = [(i, Counter(terms(t))) for i, t in docs]
    known = [c for _, c in counted if c]
    n_docs, n_terms = len(known), sum(sum(c.values()) for c in known)
    asked = {}
    for item, text in dict.fromkeys(items):
        if item is not None and text is not None:
            asked.setdefault(item, Counter()).update(terms(text))
    out = {}
    for item, wanted in asked.items():
        scored = []
        for i, c in counted:
            m = 25 + (75 * sum(c.values()) * n_docs) // n_terms if c else 0
            score = 0
            for term, times in wanted.items():
                if c[term]:
                    df = sum(term in d for d in known)
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
                    score += times * w * ((10**9 * c[term]) // (1000 * c[term] + 8 * m))
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        for rank, (score, _, _, i) in enumerate(sorted(scored)[:k], 1):
            out[item, rank] = (i, -score)
    return out


def test_lexical_search_equals_brute_force(spark):
    random.seed(11)
    words = [f"w{i}" for i in range(60)] + ["Ärger", "ÄRGER", "naïve", "x1", "Über"]
    weights = [1 / (i + 1) for i in range(len(words))]
    docs = [(i, " ".join(random.choices(words, weights, k=random.randint(0, 60))) + random.choice(["", ".", "\x00", "\tW3!"])) for i in range(500)]
    docs += [(500 + i, "w7 w9, w11 w40") for i in range(40)]  # ties
    docs += [(7, docs[7][1]), (7, "w1 another text"), (None, "w7 w9 w11 w40"), (600, None), (601, ""), (602, "?! -"), (603, "w50 " * 5000)]
    items = [(n, " ".join(random.choices(words, k=random.randint(1, 12)))) for n in range(40)]
    items += [(3, items[3][1]), (4, "w1 w1 w2"), (50, None), (51, ""), (52, "unheard of"), (None, "w1"), (53, "w7 w9 w11 w40")]
    df = spark.createDataFrame([(i, t, None, "s", "t", 1, 2) for i, t in docs], DOCS)
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    want = ranked_by_hand(docs, items, 10)
    for options in ({}, {"shard_docs": 50}, {"block_terms": 40, "shard_postings": 300}):
        rows = lexical.search_documents(df, asked, 10, **options).collect()
        assert {(r["item_id"], r["rank"]): (r["doc_id"], r["score"]) for r in rows} == want and len(rows) == len(want)


def test_lexical_search_of_empty_tables(spark, nothing):
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert lexical.search_documents(nothing, items).collect() == []
    assert lexical.search_documents(items.withColumnRenamed("item_id", "doc_id"), items.limit(0)).collect() == []
    blank = spark.createDataFrame([(1, None), (2, " ")], "doc_id long, text string")
    assert lexical.search_documents(blank, items).collect() == []


def test_best_positions_stop_early():
    """Lists that agree on their best documents are not read to the end."""
    rng = np.random.default_rng(0)
    n_docs, n_terms = 4000, 6
    quality = rng.permutation(n_docs)
    doc = np.tile(np.arange(n_docs), n_terms)
    term = np.repeat(np.arange(n_terms), n_docs)
    impact = np.tile(quality, n_terms) * 10 + rng.integers(1, 9, n_docs * n_terms)
    shard = lexical.Shard(n_docs, doc, term, impact)
    hits, scores = shard.best(np.arange(n_terms), np.ones(n_terms, np.int64), np.arange(n_docs), 10)
    total = impact.reshape(n_terms, n_docs).sum(axis=0)
    want = np.lexsort((np.arange(n_docs), -total))[:10]
    assert hits.tolist() == want.tolist() and scores.tolist() == total[want].tolist()
    assert shard.completed < n_docs // 50


# --- periodic runs

def runs_by_hand(words, least=12):
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i < len(words) - q:
            j = i
            while j < len(words) - q and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, 2 * q) and j > i:
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def collapsed_by_hand(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def some_texts(seed, count):
    rnd = random.Random(seed)
    for _ in range(count):
        letters = "abcdefghijklmnopqrstuvwxyz"[:rnd.choice([1, 2, 2, 3, 5, 26])]
        words = [rnd.choice(letters) for _ in range(rnd.randint(0, 200))]
        for _ in range(rnd.randint(0, 3) if len(words) > 4 else 0):
            a = rnd.randrange(len(words))
            p = rnd.randint(1, max(1, (len(words) - a) // 2))
            for i in range(a, rnd.randint(a, len(words))):
                words[i] = words[a + (i - a) % p]
        yield words


def test_runs_equal_brute_force():
    texts = list(some_texts(5, 500))
    thue_morse, fibonacci = ["a"], [["a"], ["a", "b"]]
    for _ in range(9):
        thue_morse = thue_morse + ["b" if c == "a" else "a" for c in thue_morse]
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    texts += [thue_morse, fibonacci[-1], ["a"] * 400, ["a"] * 200 + ["b"] + ["a"] * 200, ["a"] * 11, ["a"] * 12]
    for at in range(0, len(texts), 7):
        part = texts[at:at + 7]
        runs, collapsed = periodic._search([" ".join(w).encode() for w in part], 12)
        for words, got, rest in zip(part, runs, collapsed):
            want = runs_by_hand(words)
            assert [tuple(r) for r in got] == want
            assert rest.decode() == collapsed_by_hand(words, want)


def test_runs_survive_colliding_names(monkeypatch):
    """A seed under which names collide is given up."""
    true_names, calls = periodic._names, []

    def names(words, levels, seed):
        calls.append(seed)
        out = true_names(words, levels, seed)
        return [n % np.uint64(5) for n in out] if seed < 3 else out

    monkeypatch.setattr(periodic, "_names", names)
    for words in some_texts(9, 40):
        runs, _ = periodic._search([" ".join(words).encode()], 12)
        assert [tuple(r) for r in runs[0]] == runs_by_hand(words)
    assert 3 in calls


def test_periodic_query_on_a_fixture(spark, tmp_path, nothing):
    rows = [(i, " ".join(w), "en", "s", "t", 1, 2) for i, w in enumerate(some_texts(3, 150))]
    long_text = " \n".join(f"word{i % 997}" for i in range(4000))
    rows += [(200, None, None, None, None, None, None), (201, "", "en", "s", "t", 1, 2), (202, " \t\n", "en", "s", "t", 1, 2),
             (None, "x y " * 30, "en", "s", "t", 1, 2), (203, long_text, "en", "s", "t", 1, 2), (203, long_text, "en", "s", "t", 1, 2)]
    rows += [(300 + i, " ".join(f"u{j}" for j in range(i)), "en", "s", "t", 1, 2) for i in range(60)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, periodic.op12_periodic_runs(spark, str(tmp_path)).collect()), key=str)
    want = []
    for doc_id, text, *_ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
        if h % 10 == 0 and n:
            a = (h // 10) % n
            p = 1 + (n - a) // (3 + (h // 10) % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = runs_by_hand(words)
        s, n, q = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        lines = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
        want.append((doc_id, len(runs), s, n, q, n and 1000 * n // q, hashlib.sha256(lines.encode()).hexdigest(),
                     hashlib.sha256(collapsed_by_hand(words, runs).encode()).hexdigest()))
    assert got == sorted(want, key=str) and sum(r[1] for r in got) > 50
    assert periodic.find_runs(nothing).collect() == []


def test_runs_keep_ids_of_any_kind_and_reject_small_lengths(spark):
    df = spark.createDataFrame([("a", "x " * 20)], "key string, body string").withColumn("runs", F.lit(1))
    row = periodic.find_runs(df, "key", "body").first()
    assert (row["key"], row["n_words"], row["collapsed"]) == ("a", 20, "x") and tuple(row["runs"][0]) == (0, 20, 1)
    with pytest.raises(ValueError):
        periodic.find_runs(df, "key", "body", 8)


# --- archives

PAGES = "page_id long, url string, html string, key string, payload string, original long, record_id string"


@pytest.fixture(scope="module")
def pages(spark):
    big = "ä" * 700
    rows = [(1, "http://a/1", big), (2, "http://a/2", big), (9, "http://a/\r\nX: 9\x7f", big), (4, None, "small"), (5, "u", "small"),
            (6, "u", None), (7, "u", ""), (None, "u", big), (8, "u", "line\r\n\r\nWARC/1.1\r\n" * 200), (9, "http://b", big), (10, "u", "z" * 999),
            (11, "u", "z" * 999), (12, "u", "z" * 1000), (13, "u", "z" * 1000), (None, "u", "alone " * 300)]
    rows += [(100 + i, "http://h", f"<p>{i}</p>" * (i * 40 + 1)) for i in range(40)]
    return spark.createDataFrame([(*r, "k", "p", 1, "r") for r in rows], PAGES)


def test_archives_round_trip(spark, pages, tmp_path):
    pages = pages.repartition(3)
    rows = pages.collect()
    largest = {}
    for r in rows:
        if r["page_id"] is not None:
            largest[r["html"]] = max(largest.get(r["html"], 0), r["page_id"])
    want = []
    for r in rows:
        payload = (r["html"] or "").encode()
        first = largest.get(r["html"]) if len(payload) >= 1000 else r["page_id"]
        revisit = first is not None and first != r["page_id"]
        want.append((r["page_id"], len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    pages.write.parquet(f"{tmp_path}/t/pages.parquet")
    got = warc.op13_warc(spark, f"{tmp_path}/t").collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_archives_are_gzip_members_that_the_index_names(spark, pages, tmp_path):
    folder = str(tmp_path / "out")
    index = warc.write_archives(
        pages.select(warc.record_uri(F.col("page_id")).alias("record_id"), "url", F.col("html").alias("payload"), F.lit(None).cast("string").alias("refers_to")),
        folder, archive_bytes=2000)
    rows = index.collect()
    assert len({r["file"] for r in rows}) > 3 and len(rows) == pages.count()
    for r in rows:
        data = (tmp_path / "out" / r["file"]).read_bytes()
        record = gzip.decompress(data[r["offset"]:r["offset"] + r["length"]])
        assert record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n")
        size = int(re.search(rb"\r\nContent-Length: (\d+)\r\n", record)[1])
        assert len(record) == record.index(b"\r\n\r\n") + 4 + size + 4
    for name in {r["file"] for r in rows}:  # the members fill the file
        assert sum(r["length"] for r in rows if r["file"] == name) == (tmp_path / "out" / name).stat().st_size
    (tmp_path / "out" / "left-behind.warc.gz").write_bytes(b"half a rec")
    some = index.filter("payload_bytes > 1000")
    back = warc.read_records(some, folder, gap=10, most=3000).collect()
    assert sorted(r["digest"] for r in back) == sorted(r["digest"] for r in rows if r["payload_bytes"] > 1000)
    assert all(hashlib.sha1(r["payload"]).hexdigest() == r["digest"] and len(r["payload"]) == r["payload_bytes"] for r in back)
    urls = {r["url"] for r in back}
    assert "http://a/%0D%0AX: 9%7F" in urls
    assert warc.read_records(index.limit(0), folder).count() == 0


def test_archives_of_nothing(spark, pages, tmp_path):
    index = warc.archive_pages(pages.limit(0), str(tmp_path / "none"))
    assert index.count() == 0 and warc.read_records(index, str(tmp_path / "none")).collect() == []


def test_ranges_are_joined_within_gap_and_size():
    rows = [("a", 0, 10), ("a", 10, 10), ("a", 25, 5), ("a", 100, 10), ("a", 110, 50), ("a", 160, 80), ("b", 0, 5), ("b", 0, 5)]
    got = list(warc.coalesced(rows, gap=5, most=100))
    assert [(f, s, e, len(own)) for f, s, e, own in got] == [("a", 0, 30, 3), ("a", 100, 160, 2), ("a", 160, 240, 1), ("b", 0, 5, 2)]


def test_damaged_payload_is_noticed():
    good = warc.record_bytes("urn:page:1", "u", b"payload", None)
    assert warc.parsed_record(good)["payload"] == b"payload"
    raw = gzip.decompress(good).replace(b"payload\r\n", b"PAYLOAD\r\n")
    with pytest.raises(ValueError):
        warc.parsed_record(gzip.compress(raw))
