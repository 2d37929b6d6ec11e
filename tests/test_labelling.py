import numpy as np
import pytest
from pyspark.sql import functions as F

from ticketloom.operators import clustering as cl
from ticketloom.operators import labelling as lb
from ticketloom.operators import search as se
from ticketloom.sources import embedding_store as es


def vectors(spark, rows):
    return spark.createDataFrame(rows, "ticket_id bigint, cluster_id int, embedding array<double>")


def test_overrides_first_match_wins(spark):
    df = spark.createDataFrame(
        [("I want a REFUND and cancel my order",), ("Cancel my plan",), ("hello",)], "t string")
    intent, score = lb.override(F.col("t"), F.lit("x"), F.lit(0.7))
    got = [tuple(r) for r in df.select(intent, score).collect()]
    assert got == [("billing_and_refund_dispute", 0.92), ("order_and_cancellation_inquiry", 0.9), ("x", 0.7)]


def test_confidence_is_held_in_bounds(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [-1.0, 0.0]), ([1.0, 0.0], [0.4, 0.9])],
                               "v array<double>, c array<double>")
    got = [round(r[0], 4) for r in df.select(lb.centroid_confidence(F.col("v"), F.col("c"))).collect()]
    assert got == [0.98, 0.5, 0.7]


def test_failing_labeller_falls_back_per_batch(spark):
    calls = spark.sparkContext.accumulator(0)

    def broken(batch):
        calls.add(1)
        if (batch["ticket_id"] == 3).any():
            raise RuntimeError("down")
        return batch.assign(intent="ok", confidence=0.9)

    df = spark.createDataFrame([(i, "t") for i in range(10)], "ticket_id bigint, ticket_text string").coalesce(1)
    got = {r["ticket_id"]: (r["intent"], r["confidence"]) for r in lb.label_externally(df, broken, 5, 3).collect()}
    assert all(got[i] == ("other", 0.5) for i in range(5))
    assert all(got[i] == ("ok", 0.9) for i in range(5, 10))
    assert calls.value == 4


def test_merge_plan_joins_linked_centroids(spark):
    turn = lambda a: [float(np.cos(a)), float(np.sin(a))]
    df = spark.createDataFrame([(n, turn(0.3 * n)) for n in range(4)] + [(9, turn(3.0))], "cluster_id int, centroid array<double>")
    got = {r["name"]: r["source_cluster_ids"] for r in cl.merge_plan(df, 0.9).collect()}
    assert got == {"cluster_0": [0, 1, 2, 3], "cluster_9": [9]}


def test_fold_labels_last_write_wins(spark):
    t = spark.createDataFrame([(1,), (2,)], "ticket_id bigint")
    res = spark.createDataFrame([(1, 1, "a", 0.1), (1, 2, "b", 0.2)], "ticket_id bigint, seq int, intent string, confidence double")
    got = {r["ticket_id"]: (r["assigned_intent"], r["intent_confidence"]) for r in lb.fold_labels(t, res).collect()}
    assert got == {1: ("b", 0.2), 2: ("other", 0.5)}


def test_silhouettes_match_numpy(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(60, 5)) + np.repeat(np.eye(5)[:3] * 3, 20, axis=0)
    lab = np.repeat([0, 1, 2], 20)
    lab[59] = 9  # a cluster of one
    u = v / np.linalg.norm(v, axis=1, keepdims=True)

    def score(dist):
        out = []
        for i in range(60):
            same = (lab == lab[i]) & (np.arange(60) != i)
            if not same.any():
                out.append(0.0)
                continue
            a = dist[i][same].mean()
            b = min(dist[i][lab == c].mean() for c in set(lab) - {lab[i]})
            out.append((b - a) / max(a, b))
        return float(np.mean(out))

    df = vectors(spark, [(i, int(lab[i]), v[i].tolist()) for i in range(60)])
    squared = score(np.linalg.norm(u[:, None] - u[None], axis=2) ** 2)
    assert cl.silhouette_euclidean(df).first()["silhouette"] == pytest.approx(squared, abs=1e-6)
    cosine = score(1 - u @ u.T)
    assert cl.silhouette_cosine(df).first()["silhouette"] == pytest.approx(cosine, abs=1e-6)


def test_nearest_and_remainder_do_not_overlap(spark):
    rng = np.random.default_rng(2)
    df = vectors(spark, [(i, i % 2, rng.normal(size=3).tolist()) for i in range(60)])
    cents = se.centroid_vectors(df, "cluster_id", "embedding")
    sample = cl.cluster_sample(df, cents, "ticket_id").collect()
    assert len(sample) == 40 and len({r["ticket_id"] for r in sample}) == 40
    assert {(r["cluster_id"], r["kind"]) for r in sample} == {(0, "near"), (0, "random"), (1, "near"), (1, "random")}


def test_merge_issues(spark):
    clusters = spark.createDataFrame([(0,), (1,), (2,)], "cluster_id int")
    plan = spark.createDataFrame([([0, 1],), ([1, 7],)], "source_cluster_ids array<int>")
    got = {(r["cluster_id"], r["issue"]) for r in cl.merge_issues(clusters, plan).collect()}
    assert got == {(2, "not mapped"), (1, "mapped more than once"), (7, "unknown cluster")}


def test_taxonomy_maps_each_of_24_clusters_once(spark):
    from ticketloom.sources.tables import taxonomy_table

    tax = taxonomy_table(spark)
    clusters = spark.range(24).select(F.col("id").cast("int").alias("cluster_id"))
    assert tax.count() == 10 and cl.merge_issues(clusters, tax).count() == 0


def test_embedders(spark):
    df = spark.createDataFrame([(1, "wifi router broken"), (2, "wifi router broken"), (3, "refund")], "ticket_id bigint, ticket_text string")
    got = {r["ticket_id"]: r["embedding"] for r in cl.embed_text(df, dims=32).collect()}
    assert got[1] == got[2] != got[3] and sum(x * x for x in got[1]) == pytest.approx(1.0, abs=1e-6)

    def load():
        return lambda texts: np.array([[len(t), 1.0] for t in texts])

    out = cl.embed_with(df, load, batch_rows=2).orderBy("ticket_id").collect()
    assert len(out) == 3 and sum(x * x for x in out[2]["embedding"]) == pytest.approx(1.0)


def test_kmeans_sweep(spark):
    rng = np.random.default_rng(5)
    rows = [(i, 0, (np.eye(4)[i % 4] * 5 + rng.normal(scale=0.1, size=4)).tolist()) for i in range(80)]
    got = cl.sweep_k(vectors(spark, rows), candidates=(2, 4), tries=2).collect()
    assert {r["k"]: r["is_best"] for r in got} == {2: False, 4: True}


def test_embedding_store_recomputes_only_changed_rows(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "ticket_id bigint, ticket_text string")
    old = spark.createDataFrame([(1, "a"), (2, "old")], "ticket_id bigint, ticket_text string")
    store = es.with_hash(old).withColumn("embedding", F.array(F.lit(0.0))).select(*es.STORE_COLUMNS)
    out = es.refresh(t, store, lambda rows: rows.withColumn("embedding", F.array(F.lit(1.0))))
    assert {r["ticket_id"]: r["embedding"] for r in out.collect()} == {1: [0.0], 2: [1.0], 3: [1.0]}


def test_failures_are_told_from_labels(spark):
    def broken(batch):
        if (batch["ticket_id"] < 5).any():
            raise RuntimeError("down")
        return batch[batch["ticket_id"] != 7].assign(intent="other", confidence=0.5)

    df = spark.createDataFrame([(i, "t") for i in range(10)], "ticket_id bigint, ticket_text string").coalesce(1)
    rows = lb.label_externally(df, broken, 5, 2, with_failures=True)
    got = {r["ticket_id"]: r["failure"] for r in rows.collect()}
    assert all(got[i] == "RuntimeError: down" for i in range(5)) and got[7] == lb.UNANSWERED and got[9] is None
    counts = {r["failure"]: r["row_count"] for r in lb.label_failures(rows).collect()}
    assert counts == {"RuntimeError: down": 5, lb.UNANSWERED: 1, None: 4}
    assert lb.label_externally(df, broken, 5, 2).count() == 9  # an answer for part of a batch is taken as it is
    empty = lb.label_externally(df, lambda b: b.head(0), 5, 1, with_failures=True)
    assert {r["failure"] for r in empty.collect()} == {"empty answer"}


def test_offline_labeller_equals_the_cluster_labels(spark):
    from ticketloom.sources.tables import taxonomy_table

    rng = np.random.default_rng(2)
    v = rng.normal(size=(60, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    texts = ["I want a refund", "please cancel", "hello", "plain"]
    t = spark.createDataFrame([(i, texts[i % 4], v[i].tolist()) for i in range(60)], "ticket_id bigint, ticket_text string, embedding array<double>")
    c = spark.createDataFrame([(i, (v[i] * 0.7).tolist()) for i in range(30)], "cluster_id int, centroid array<double>")
    tax = taxonomy_table(spark)
    want = lb.label_by_cluster(cl.assign_nearest(t, c), tax, c).select("ticket_id", "assigned_intent", "intent_confidence")
    got = lb.label_externally(t, lb.centroid_labeller(c, tax), columns=("ticket_id", "ticket_text", "embedding"))
    got = got.select("ticket_id", "intent", F.round("confidence", 3))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_long_chains_join_in_few_rounds(spark, monkeypatch):
    n, rounds = 5000, []
    monkeypatch.setattr(cl, "materialise", lambda df, name, keep=cl.materialise: (rounds.append(name), keep(df, name))[1])
    nodes = spark.range(n + 2).select(F.col("id").cast("int").alias("cluster_id"))
    mixed = lambda c: (F.col(c) * 3701 % n).cast("int")  # noqa: E731 - a chain in mixed order
    links = spark.range(n - 1).select(mixed("id").alias("a"), ((F.col("id") + 1) * 3701 % n).cast("int").alias("b"))
    links = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    got = cl.joined_labels(nodes, links).groupBy("root").count().collect()
    assert {(r["root"], r["count"]) for r in got} == {(0, n), (n, 1), (n + 1, 1)}
    assert len(rounds) < 60 and rounds.count("labels") < 20


def test_many_centroids_are_met_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows, centres = rng.normal(size=(300, 6)), rng.normal(size=(9000, 6))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)], "ticket_id bigint, embedding array<double>")
    c = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(centres)], "cluster_id int, centroid array<double>")
    flat = {r["ticket_id"]: r["cluster_id"] for r in cl.assign_nearest(df, c).collect()}
    monkeypatch.setattr(cl, "MAX_CENTROIDS", 5000)
    assert {r["ticket_id"]: r["cluster_id"] for r in cl.assign_nearest(df, c).collect()} == flat
    assert cl.assign_nearest(df, c).columns == ["ticket_id", "embedding", "cluster_id"]
