"""Edge cases and brute-force twins of the training-data operators."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ticketloom.llm import (
    chat, components, decontamination, language, line_dedup, maxscore, mixing, quality, sharding, simhash,
    substring_dedup,
)
from ticketloom.llm.common import permuted, word_count

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, shard string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, blanks, repeats, ties, a long text, and extra columns with clashing names."""
    long_text = " ".join(f"word{i % 997}" for i in range(30_000))
    rows = [
        (1, "the cat sat on the mat and then the cat left the mat for good", "en", "a", 5, "x", "y"),
        (2, "the cat sat on the mat and then the cat left the mat for good", "en", "a", 5, "x", "y"),
        (2, "the cat sat on the mat and then the cat left the mat for good", "en", "a", 5, "x", "y"),
        (3, None, None, None, None, None, None), (4, "", "en", "b", 0, None, "y"), (5, " \t\n ", "en", None, 4, "x", "y"),
        (6, long_text, "en", "b", len(long_text), "x", "y"), (None, "no id here at all", "en", "a", 1, "x", "y"),
        (7, "12 34 !!", "de", "c", 1, "x", "y"),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def test_permuted_is_a_permutation_with_an_inverse(spark):
    for n in (1, 2, 7, 1000):
        df = spark.range(n).withColumn("to", permuted(F.col("id"), F.lit(n).cast("long"), 5, F.lit(1)))
        df = df.withColumn("back", permuted(F.col("to"), F.lit(n).cast("long"), 5, F.lit(1), back=True))
        rows = df.collect()
        assert sorted(r["to"] for r in rows) == list(range(n)) and all(r["back"] == r["id"] for r in rows)


# --- exact top-k search

def test_maxscore_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    vectors = rng.integers(-60, 60, (900, 16))
    vectors[100:140] = vectors[99]  # ties
    ids = np.arange(900)
    queries = list(range(0, 900, 30))
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, vectors)] + [(99, vectors[99].tolist())], "vec_id long, vector array<long>")
    q = df.filter("vec_id % 30 = 0").withColumnRenamed("vec_id", "query_id")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in maxscore.maxscore_search(q, df, 5, 128, 8).collect()}
    scores = vectors @ vectors.T
    for i in queries:
        best = sorted((-int(scores[i, j]), j) for j in range(900) if j != i)[:5]
        assert [got[i, r + 1] for r in range(5)] == [(j, -s) for s, j in best]


def test_maxscore_few_null_and_empty(spark):
    schema = "vec_id long, vector array<long>"
    df = spark.createDataFrame([(0, [1, 2]), (1, [3]), (2, None), (None, [1, 1])], schema)
    got = maxscore.maxscore_search(df.withColumnRenamed("vec_id", "query_id"), df).collect()
    assert sorted((r["query_id"], r["vec_id"], r["score"]) for r in got) == [(0, 1, 3), (1, 0, 3)]
    empty = df.limit(0)
    assert maxscore.maxscore_search(empty.withColumnRenamed("vec_id", "query_id"), empty).count() == 0


# --- mixing

def test_mixture_meets_targets(spark):
    random.seed(2)
    rows = [(i, " ".join(["w"] * random.randint(0, 90)), f"s{i % 5}" if i % 7 else None) for i in range(700)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = [r.asDict() for r in mixing.mixture(df, block_words=16, shard_slots=32).collect()]
    size = Counter()
    for _, text, source in rows:
        size[source] += len(text.split())
    order = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, set(order), 1.5 * sum(size.values())
    while True:  # reshare what is over, by weight
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > 2 * size[s]]
        if not over:
            break
        for s in over:
            target[s] = 2.0 * size[s]
            left -= target[s]
            free.remove(s)
    target |= {s: level * weight[s] for s in free}
    source_of = {i: s for i, _, s in rows}
    taken = Counter()
    for r in got:
        assert r["size"] == len(rows[r["doc_id"]][1].split()) and 0 <= r["taken"] <= 2 * r["size"]
        assert r["target"] == pytest.approx(target[source_of[r["doc_id"]]])
        taken[source_of[r["doc_id"]]] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 0.5 + 1e-6 for s in order)
    again = {r["doc_id"]: r["taken"] for r in mixing.mixture(df.repartition(3), block_words=16, shard_slots=32).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in got}


def test_mixed_texts_are_what_was_taken(spark, odd, nothing):
    wide = mixing.mixed_documents(odd, block_words=64)
    assert wide.columns == odd.columns
    words = wide.groupBy("source").agg(F.sum(word_count(F.col("text"))).alias("n"))
    got = {r["source"]: r["n"] for r in words.collect()}
    table = mixing.mixture(odd, block_words=64).collect()
    assert sum(got.values()) == sum(r["taken"] for r in table) and len(table) == odd.count()
    assert mixing.mixture(nothing).count() == 0 and mixing.mixed_documents(nothing).count() == 0


# --- language

def test_language_families_and_unknown(spark, odd, nothing):
    random.seed(4)
    syllables = {"en": "the ing and", "de": "sch ung ein", "fr": "eau oi que", "es": "cion ado ll"}
    rows = []
    for i in range(400):
        lang = list(syllables)[i % 4]
        text = " ".join("".join(random.choices(syllables[lang].split(), k=2)) for _ in range(30))
        rows.append((i, text, lang))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in language.identify_languages(df).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i]["held_out"] == (i in held) for i in range(400))
    assert np.mean([got[i]["lang_pred"] == rows[i][2] for i in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got.values())
    strange = {r["doc_id"]: r for r in language.identify_languages(odd).collect()}
    assert all(strange[i]["lang_pred"] == "und" and strange[i]["score"] == 0 for i in (3, 4, 5, 7))
    assert language.identify_languages(nothing).count() == 0
    assert language.identify_languages(df.withColumn("lang", F.lit(None).cast("string"))).filter("lang_pred != 'und'").count() == 0


# --- quality

def test_quality_learns_and_keeps_rows(spark, odd, nothing):
    random.seed(5)
    good = lambda: " ".join(random.choice("alpha beta gamma delta epsilon zeta eta theta".split()) for _ in range(60)) + "."
    rows = [(i, good() if i % 4 else "BUY!! " * 60) for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(500)] + [(None, 1), (9, None)], "doc_id long, quality int")
    got = quality.classify_quality(docs, labels).collect()
    assert all(r["predicted"] == int(r["doc_id"] % 4 > 0) for r in got if r["held_out"])
    assert {r["held_out"] for r in got} == {True, False} and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert quality.keep_good(docs, labels).count() == 375
    assert quality.classify_quality(odd, labels).count() == odd.count()
    assert quality.classify_quality(nothing, labels).count() == 0
    assert {r["score"] for r in quality.classify_quality(docs, labels.limit(0)).collect()} == {0.5}


def test_flat_trees_equal_a_plain_walk():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 4))
    model = quality.BoostedTrees(x, (x[:, 0] + x[:, 1] > 0).astype(float), trees=10, depth=3)
    for row, score in zip(x[:40], model.scores(x[:40])):
        total = model.start
        for t in range(10):
            i = 0
            for _ in range(3):
                i = 2 * i + 1 + int(row[model.feature[t, i]] > model.cut[t, i])
            total += model.value[t, i - 7]
        assert score == pytest.approx(1 / (1 + np.exp(-total)))


# --- line dedup

def test_line_chunks_keep_the_first_and_resist_shifts(spark, odd, nothing):
    block = "\n".join(f"shared line number {i} of the passage" for i in range(40))
    rows = [(i, "\n".join(f"own {i} {j}" for j in range(i + 1)) + "\n" + block + f"\nend {i}") for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(df).collect()}
    assert got[0]["text"] == rows[0][1] and got[0]["n_removed"] == 0
    for i in range(1, 12):
        assert got[i]["n_removed"] > 20
        lines = rows[i][1].split("\n")
        for r in got[i]["removed"]:
            assert "\n".join(lines[r["line"]:r["line"] + r["n_lines"]]) in rows[0][1]
        assert f"own {i} 0" in got[i]["text"] and f"end {i}" in got[i]["text"]
    out = {(r["doc_id"], r["text"]): r for r in line_dedup.dedup_lines(odd).collect()}
    assert out[3, None]["n_lines"] == 0 and out[4, ""]["n_lines"] == 1 and len(out) == 8
    assert line_dedup.dedup_lines(nothing).count() == 0


def test_line_runs_go_whole_whatever_stands_around_them(spark):
    rows, want, n = [], {}, 0
    for length in range(2, 6):
        for copy in range(8):
            passage = [f"passage {length} {copy} line {j}" for j in range(length)]
            rows.append((n, "\n".join([f"head {n}", *passage, f"tail {n}"])))
            before, after = [f"before {n} {j}" for j in range(copy % 3)], [f"after {n} {j}" for j in range(copy % 2)]
            rows.append((n + 1, "\n".join([*before, *passage, *after])))
            want[n], want[n + 1] = rows[-2][1], "\n".join([*before, *after])
            n += 2
    rows += [(n, "a single line\nown a"), (n + 1, "own b\na single line"), (n + 2, "again\nagain\nagain"),
             (n + 3, "p\n\nq\nown c"), (n + 4, "own d\np\n\nq"), (n + 5, "own e\np\nq"),
             (n + 6, "\n".join(["x", "y"] * 3))]
    want |= {i: text for i, text in rows[-7:]} | {n + 4: "own d", n + 6: "x\ny"}
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: r["text"] for i, r in got.items()} == want
    assert [(r["line"], r["n_lines"]) for r in got[n + 4]["removed"]] == [(1, 3)] and got[n + 4]["n_removed"] == 3


def line_runs_by_hand(texts):
    """Numbers of the lines that go: every two filled lines in a row that an earlier place has."""
    pairs = []
    for i, text in texts:
        lines = text.split("\n")
        filled = [k for k, line in enumerate(lines) if line.strip()]
        pairs += [(i, a, b, "\n".join(lines[a:b + 1])) for a, b in zip(filled, filled[1:])]
    first = {}
    for i, a, _, body in sorted(pairs):
        first.setdefault(body, (i, a))
    gone = {i: set() for i, _ in texts}
    for i, a, b, body in pairs:
        j, c = first[body]
        if j != i or a > c + b - a:
            gone[i] |= set(range(a, b + 1))
    return gone


def test_line_chunks_equal_plain_rule(spark):
    rnd = random.Random(12)
    pool = [f"line {k}" for k in range(40)] + ["", " "]
    passage = [[rnd.choice(pool) + f" {p}" for _ in range(rnd.randint(2, 40))] for p in range(10)]
    rows = []
    for i in range(120):
        lines = [rnd.choice(pool) for _ in range(rnd.randint(0, 30))]
        at = rnd.randint(0, len(lines))
        part = rnd.choice(passage)
        cut = rnd.randint(0, len(part) - 1)
        rows.append((i, "\n".join(lines[:at] + part[cut:] + lines[at:])))
    many = [f"long {k}" for k in range(20_000)]
    rows += [(200, "\n".join(many)), (201, "\n".join(["own", *many])), (202, "\n".join(["same"] * 5_000)), (203, "\n".join(["same"] * 3))]
    want = line_runs_by_hand(rows)
    for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect():
        got = {k for run in r["removed"] for k in range(run["line"], run["line"] + run["n_lines"])}
        assert got == want[r["doc_id"]] and r["n_removed"] == len(got)
    chunks = line_dedup.line_chunks(
        spark.createDataFrame([(1, 1, rows[-4][1]), (2, 2, rows[-3][1])], "id long, hash long, text string"), 2).collect()
    by_text = [{bytes(c["digest"]) for c in chunks if c["id"] == i and c["digest"]} for i in (1, 2)]
    assert len(by_text[0]) > 2_000 and len(by_text[0] & by_text[1]) >= len(by_text[0]) - 1  # shift-resistant


# --- SimHash

def brute_print(text):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = [w for w in "".join(" " if c in " \t\n\v\f\r" else c for c in words).split(" ") if w]
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    votes = [sum(xxhash.xxh64_intdigest(s.encode(), 42) >> b & 1 for s in shingles) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(shingles))


def brute_components(items):
    root = {i: i for i, _ in items}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, x in items:
        for b, y in items:
            if a < b and (x ^ y).bit_count() <= 3:
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: find(i) for i, _ in items}


def test_simhash_equals_brute_force(spark, odd, nothing):
    random.seed(6)
    vocab = [f"W{i}é" for i in range(60)]
    rows = []
    for i in range(120):
        base = [random.Random(i // 4).choice(vocab) for _ in range(1)] and [random.choice(vocab) for _ in range(40)]
        if i % 4 and rows:
            base = rows[-1][1].split()
            if i % 4 > 1:
                base[random.randrange(len(base))] = "zz"
        rows.append((i, "\t ".join(base)))
    rows += [(200, None), (201, ""), (202, "one"), (203, "One two")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {i: brute_print(t) for i, t in rows}
    comps = brute_components(sorted(want.items()))
    got = {r["doc_id"]: r for r in simhash.simhash_components(df).collect()}
    assert {i: int(r["fingerprint"], 16) for i, r in got.items()} == want
    assert {i: r["component_id"] for i, r in got.items()} == comps
    kept = simhash.simhash_dedup(df)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(comps.values()))
    kept = simhash.simhash_dedup(odd)
    assert kept.columns == odd.columns
    assert [r["doc_id"] for r in kept.orderBy(F.col("doc_id").asc_nulls_last()).collect()] == [1, 3, 6, 7, None]
    assert simhash.simhash_dedup(nothing).count() == 0


@pytest.mark.parametrize("tree_size", [4, 8192])
def test_links_of_hot_keys_are_whole(spark, tree_size):
    rng = random.Random(7)
    prints = {0, 1 << 63}
    while len(prints) < 150:  # chains of small steps, so that keys are shared by many
        x = rng.choice(sorted(prints))
        for _ in range(rng.choice((2, 3, 9))):
            x ^= 1 << rng.randrange(64)
        prints.add(x)
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    links = simhash.linked_prints(spark.createDataFrame([(x,) for x in signed], "print long"), 3, tree_size)
    roots = {r["node"]: r["component"] for r in components.components(links).collect()}
    want = brute_components(sorted((x, x) for x in prints))
    groups = defaultdict(set)
    for x, s in zip(prints, signed):
        groups[want[x]].add(roots.get(s, s))
    assert all(len(v) == 1 for v in groups.values()) and len({min(v) for v in groups.values()}) == len(groups)


def test_components_of_a_long_path(spark):
    path = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = components.components(path).collect()
    assert len(got) == 301 and {r["component"] for r in got} == {0}


# --- decontamination

def edit_distance_inside(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item):
        new = [i + 1]
        for j, d in enumerate(text):
            new.append(min(row[j] + (c != d), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_leaks_equal_brute_force(spark, odd, nothing):
    rng = random.Random(8)
    letters = "abcde "
    items = [(i, "".join(rng.choice(letters) for _ in range(60 + 10 * i))) for i in range(6)] + [(90, None), (91, "abc"), (92, " ")]
    docs = []
    for i in range(60):
        host = "".join(rng.choice(letters) for _ in range(rng.randrange(0, 400)))
        n, text = items[i % 6]
        passage = list(decontamination.normalise(text))
        for _ in range(rng.randrange(0, 2 * decontamination.edit_budget(len(passage)) + 2)):
            at = rng.randrange(len(passage))
            passage[at:at + 1] = rng.choice(["", "x", "xy"])
        cut = rng.randrange(len(host) + 1)
        docs.append((i, host[:cut] + "".join(passage).upper() + host[cut:]))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {}
    for i, text in docs:
        for n, item in items[:6]:
            norm = decontamination.normalise(item)
            edits = edit_distance_inside(norm, decontamination.normalise(text))
            if edits <= decontamination.edit_budget(len(norm)):
                want[i, n] = edits
    for size in (4_000_000, 200):  # one block of items, and several
        found = decontamination.find_leaks(df, bench, block_chars=size).collect()
        assert {(r["doc_id"], r["item_id"]): r["edits"] for r in found} == want
    kept = {r["doc_id"] for r in decontamination.decontaminate(df, bench).collect()}
    assert kept == {i for i, _ in docs} - {i for i, _ in want}
    assert decontamination.find_leaks(odd, bench).count() == 0
    assert decontamination.decontaminate(odd, bench).count() == odd.count()
    assert decontamination.decontaminate(odd, bench.limit(0)).count() == odd.count()
    assert decontamination.find_leaks(nothing, bench).count() == 0


def test_long_text_is_searched_whole():
    item = "a passage of the benchmark that stands far down in a very long text"
    index = decontamination.QGramIndex([1], [item])
    step = decontamination.PIECE_CHARS
    for at in (0, step - 30, step + 5, 3 * step - 1):
        text = "z" * at + item + "z" * 100
        assert index.matches([text])[0] == [(1, 0, at, len(item))]


# --- chat

def test_chat_round_trip(spark):
    rows = [
        (1, 2, "assistant", "</s>[INST] ok [/INST]"), (1, 1, "user", "a<\\s>b <s> [\\INST]"), (1, 3, "assistant", None),
        (1, 4, "tool", "[NEXT]\n[\\\\NEXT]"), (2, 0, None, "x"), (2, 0, None, "x"), (None, 1, "assistant", "é\U0001F600"),
        (3, None, "us\ner\\n", "[INST]"), (3, 1, "a<s>", ""),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    out = chat.format_conversations(df)
    turns = {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]]
             for r in out.select("conv_id", chat.read_back(F.col("formatted")).alias("turns")).collect()}
    want = defaultdict(list)
    for c, t, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want[c].append((role or "", text or ""))
    assert turns == want
    one = next(r for r in out.collect() if r["conv_id"] == 1)
    assert one["formatted"].count("<s>") == 1  # two assistant turns, one block
    digest = {r["conv_id"]: r for r in chat.conversation_digest(out).collect()}
    said = "".join(f"{r}\n{t}\n" for r, t in want[1])
    assert digest[1]["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    assert digest[None]["loss_chars"] == 2 and digest[2]["loss_chars"] == 0 and digest[2]["n_turns"] == 2
    assert digest[1]["loss_sha256"] == hashlib.sha256(b"</s>[INST] ok [/INST]").hexdigest()
    assert chat.format_conversations(df.limit(0)).count() == 0


# --- substring dedup

def test_units_keep_the_earliest_with_offsets(spark, odd, nothing):
    line = "Eight words  make this line long enough here"
    rows = [(5, f"x\n{line}\ny"), (3, f"{line.upper()}\nshort\n{line}"), (8, f"short\n {line} \nshort"), (9, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in substring_dedup.dedup_units(df).collect()}
    assert got[3]["text"] == f"{line.upper()}\nshort" and got[5]["text"] == "x\ny" and got[8]["text"] == "short\nshort"
    texts = dict(rows)
    for i in (3, 5, 8):
        spans = [texts[i][s["start"]:s["start"] + s["length"]] for s in got[i]["kept_spans"]]
        assert "\n".join(spans) == got[i]["text"]
        assert all(texts[i][s["start"]:s["start"] + s["length"]].strip().lower() == line.lower() for s in got[i]["removed_spans"])
    assert got[9]["text"] is None and got[9]["kept_spans"] == []
    out = {(r["doc_id"], r["n_removed"]) for r in substring_dedup.dedup_units(odd).collect()}
    assert (1, 0) in out and (2, 1) in out and (3, 0) in out
    assert substring_dedup.dedup_units(nothing).count() == 0


# --- sharding

def test_hypergeometric_follows_its_law(spark):
    draws = spark.range(4000).select(sharding.hypergeometric(
        F.lit(60), F.lit(25), F.lit(12), (F.col("id") + 0.5) / 4000.0).alias("k")).groupBy("k").count().collect()
    from math import comb
    for r in draws:
        want = comb(25, r["k"]) * comb(35, 12 - r["k"]) / comb(60, 12)
        assert abs(r["count"] / 4000 - want) < 1e-3


def test_communication_matrix_has_exact_sums(spark):
    senders, shards = [17, 0, 400, 3, 80], [130, 120, 0, 250]
    rows = sorted(sharding.communication_matrix(spark, senders, shards, 1).collect(), key=lambda r: r["sender"])
    assert [sum(r["counts"]) for r in rows] == senders + [0, 0, 0]
    assert np.sum([r["counts"] for r in rows], axis=0).tolist() == shards
    assert all(rows[i + 1]["bases"] == [a + b for a, b in zip(rows[i]["bases"], rows[i]["counts"])] for i in range(7))


def test_shards_are_even_and_gapless(spark, odd, nothing):
    df = spark.range(1003).repartition(7).select(F.col("id").alias("doc_id"), F.lit("same").alias("text"))
    slots = defaultdict(list)
    for r in sharding.sharded_documents(df).collect():
        slots[r["shard"]].append(r["slot"])
        assert (r["size"], r["text_crc32"], r["law"]) == (20, zlib.crc32(b"same"), "rows")
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and {len(v) for v in slots.values()} == {25, 26}
    out = sharding.shard_rows(odd, 3)
    assert sorted(out.columns) == sorted([*odd.columns, "slot"]) and out.count() == odd.count()
    sizes = {r["doc_id"]: (r["size"], r["text_crc32"]) for r in sharding.sharded_documents(odd).collect()}
    assert sizes[3] == (16, None) and sizes[4] == (16, 0)
    assert sharding.sharded_documents(nothing).count() == 0


# --- registry and pipeline

def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rows = [(i, f"document {i} speaks of " + " ".join(f"thing{(i * 7 + j) % 501}" for j in range(40)), "en", f"s{i % 3}", 0) for i in range(90)]
    rows += [(900 + i, rows[i][1], "en", "s0", 0) for i in range(5)] + [(950, "the secret benchmark item stands here in full " * 1 + rows[3][1], "en", "s1", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "The secret  benchmark item stands here in full")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        kept.append({r["doc_id"] for r in docs.collect()})
    assert len(kept[0]) == 96 and kept[1] == kept[0] - set(range(900, 905)) and kept[2] == kept[1] - {950}
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in out} == kept[3]
    assert max(Counter(r["shard"] for r in out).values()) - len(out) // 40 <= 1


def test_queries_are_registered():
    import __spark_entry__ as registry

    names = set(registry.queries())
    assert "pipeline" in names and {int(n[2:].split("_")[0]) for n in names if n.startswith("op")} == set(range(1, 14))
