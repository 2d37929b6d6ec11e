"""Embedding, clustering, sampling and taxonomy building."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ticketloom.functions import text as tx
from ticketloom.functions import vectors as vx
from ticketloom.operators import blocks
from ticketloom.operators.blocks import small_side, unit_rows
from ticketloom.session import materialise

MAX_CENTROIDS = 10_000


def embed_text(df: DataFrame, text: str = "ticket_text", dims: int = 384) -> DataFrame:
    """Default embedder: hashed term weights, unit length. All stages run in the JVM."""
    stages = [
        RegexTokenizer(inputCol=text, outputCol="__words", pattern=r"[^\p{L}\p{N}]+"),
        HashingTF(inputCol="__words", outputCol="__tf", numFeatures=dims),
        IDF(inputCol="__tf", outputCol="__tfidf"),
        Normalizer(inputCol="__tfidf", outputCol="__unit"),
    ]
    out = Pipeline(stages=stages).fit(df).transform(df)
    return out.withColumn("embedding", vector_to_array("__unit", "float32")).drop(
        "__words", "__tf", "__tfidf", "__unit")


def embed_with(
    df: DataFrame, load: Callable[[], Callable[[list[str]], np.ndarray]], text: str = "ticket_text",
    batch_rows: int = 64,
) -> DataFrame:
    """Plug-in embedder: ``load`` builds the model once per task, texts go in batches."""
    schema = df.select("*", F.array().cast("array<double>").alias("embedding")).schema

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for part in parts:
            vectors = []
            for at in range(0, len(part), batch_rows):
                vectors.extend(np.asarray(model(part[text].iloc[at : at + batch_rows].tolist()), dtype="float64"))
            unit = unit_rows(pd.Series(vectors)) if vectors else []
            yield part.assign(embedding=list(unit))

    return df.mapInPandas(run, schema)


def with_features(df: DataFrame, vector: str = "embedding") -> DataFrame:
    return df.withColumn("features", array_to_vector(vx.l2_normalise(F.col(vector))))


def fit_kmeans(features: DataFrame, k: int, seed: int = 42, tries: int = 5) -> KMeansModel:
    """Best of several seeds by training cost. ``features`` should be cached."""
    models = [KMeans(k=k, seed=seed + i, featuresCol="features").fit(features) for i in range(tries)]
    return min(models, key=lambda m: m.summary.trainingCost)


def assign(features: DataFrame, model: KMeansModel) -> DataFrame:
    return model.transform(features).withColumnRenamed("prediction", "cluster_id").drop("features")


def centroid_matrix(centroids: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(ids, matrix) of a centroid table whose size is checked first."""
    rows = blocks.bounded_rows(centroids.select("cluster_id", "centroid"), MAX_CENTROIDS)
    if rows is None:
        raise ValueError(f"more than {MAX_CENTROIDS} centroids")
    rows.sort(key=lambda r: r["cluster_id"])
    return np.array([r["cluster_id"] for r in rows]), np.array([r["centroid"] for r in rows], dtype="float64")


def assign_nearest(df: DataFrame, centroids: DataFrame, vector: str = "embedding") -> DataFrame:
    """Nearest of given centroids (euclidean, ties to the lower id).

    Up to ``MAX_CENTROIDS`` are held by every task; more meet the rows in blocks.
    """
    if blocks.bounded_rows(centroids.select("cluster_id"), MAX_CENTROIDS) is None:
        return _assign_in_blocks(df, centroids, vector)
    ids, matrix = centroid_matrix(centroids)

    @F.pandas_udf("int")
    def nearest(v: pd.Series) -> pd.Series:
        if not len(v):
            return pd.Series([], dtype="int32")
        m = np.array(v.tolist(), dtype="float64")
        size, step = (matrix * matrix).sum(1)[None, :], max(1, 4_000_000 // len(matrix))
        # Slices keep the distance matrix small whatever the batch is.
        near = [np.argmin(size - 2.0 * (m[at:at + step] @ matrix.T), axis=1) for at in range(0, len(m), step)]
        return pd.Series(ids[np.concatenate(near)].astype("int32"))

    # Kept in one place by the optimiser: as a later join key it must not be copied into
    # inferred filters.
    return df.withColumn("cluster_id", nearest.asNondeterministic()(F.col(vector)))


def _assign_in_blocks(df: DataFrame, centroids: DataFrame, vector: str) -> DataFrame:
    """Each block of centroids gives a row its nearest one there; the nearest of these is it."""
    rows = materialise(df.withColumn("__row", F.monotonically_increasing_id()), "unassigned")

    def work(q: pa.Table, c: pa.Table) -> Iterator[dict[str, np.ndarray]]:
        c = c.take(pa.array(np.argsort(blocks.values(c, "case_key"))))
        ids, places, m, query_ids = blocks.values(c, "case_key"), blocks.matrix(c), blocks.matrix(q), blocks.values(q, "query_id")
        size, step = (places * places).sum(1)[None, :], max(1, 4_000_000 // len(places))
        for at in range(0, len(m), step):
            far = size - 2.0 * (m[at:at + step] @ places.T)
            near = np.argmin(far, axis=1)
            yield {"query_id": query_ids[at:at + step], "cluster_id": ids[near], "far": far[np.arange(len(far)), near]}

    found = blocks.meet(
        rows.select(F.col("__row").alias("query_id"), F.col(vector).alias("vector")),
        centroids.select(F.col("cluster_id").alias("case_key"), F.col("centroid").alias("vector")),
        work, "query_id bigint, cluster_id int, far double", 4096)
    best = found.groupBy(F.col("query_id").alias("__row")).agg(F.min(F.struct("far", "cluster_id")).alias("best"))
    return rows.join(best, "__row").withColumn("cluster_id", F.col("best.cluster_id")).drop("__row", "best")


def silhouette(df: DataFrame, measure: str, cluster: str = "cluster_id", vector: str = "embedding") -> DataFrame:
    """Silhouette of unit vectors over all rows; linear in rows, no sample."""
    evaluator = ClusteringEvaluator(
        predictionCol="__c", featuresCol="features", metricName="silhouette", distanceMeasure=measure)
    rows = with_features(df, vector).select(F.col(cluster).cast("int").alias("__c"), "features")
    score = evaluator.evaluate(rows)
    return df.sparkSession.createDataFrame([(score,)], "silhouette double")


def silhouette_cosine(df: DataFrame, cluster: str = "cluster_id", vector: str = "embedding") -> DataFrame:
    """Silhouette with cosine distance."""
    return silhouette(df, "cosine", cluster, vector)


def silhouette_euclidean(df: DataFrame, cluster: str = "cluster_id", vector: str = "embedding") -> DataFrame:
    """Silhouette with squared euclidean distance, whose sums over a cluster need no pairs."""
    return silhouette(df, "squaredEuclidean", cluster, vector)


def seeded_order(key: Column, seed: int) -> Column:
    """Pseudo-random but repeatable order of rows."""
    return F.md5(F.concat(key.cast("string"), F.lit(f"/{seed}")).cast("binary"))


def sweep_k(df: DataFrame, candidates=(12, 16, 20, 24), seed: int = 42, tries: int = 5) -> DataFrame:
    """(k, silhouette, is_best) for each candidate; the first of equals is best.

    A fit has dozens of passes, and each task of a pass reports to the driver: the tasks follow
    the cores, not the rows.
    """
    tasks = 2 * df.sparkSession.sparkContext.defaultParallelism
    features = with_features(df).select("features").coalesce(tasks).persist()
    try:
        scores = []
        for k in candidates:
            model = fit_kmeans(features, k, seed, tries)
            evaluator = ClusteringEvaluator(featuresCol="features", distanceMeasure="cosine")
            scores.append((k, float(evaluator.evaluate(model.transform(features)))))
    finally:
        features.unpersist()
    best = max(scores, key=lambda s: s[1])[0]
    return df.sparkSession.createDataFrame(
        [(k, s, k == best) for k, s in scores], "k int, silhouette double, is_best boolean")


def nearest_rows(df: DataFrame, centroids: DataFrame, key: str, n: int = 10) -> DataFrame:
    """The n rows nearest to their own centroid, per cluster."""
    dist = F.round(vx.euclidean(F.col("embedding"), F.col("centroid")), 12)
    w = Window.partitionBy("cluster_id").orderBy("distance", key)
    return (
        df.join(small_side(centroids), "cluster_id")
        .withColumn("distance", dist).drop("centroid")
        .withColumn("position", F.row_number().over(w).cast("bigint"))
        .where(F.col("position") <= n)
    )


def remainder_sample(df: DataFrame, taken: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n more rows per cluster in a seeded pseudo-random order, leaving out ``taken``."""
    w = Window.partitionBy("cluster_id").orderBy("__order", key)
    rest = df.join(taken.select(key), key, "left_anti").withColumn(
        "__order", seeded_order(F.col(key), seed))
    return rest.withColumn("position", F.row_number().over(w).cast("bigint")).where(
        F.col("position") <= n).drop("__order")


def cluster_sample(df: DataFrame, centroids: DataFrame, key: str, near: int = 10, total: int = 20) -> DataFrame:
    """Rows to show for a cluster: the nearest ones, then random others."""
    first = nearest_rows(df, centroids, key, near).drop("distance").withColumn("kind", F.lit("near"))
    rest = remainder_sample(df, first, key, total - near).withColumn("kind", F.lit("random"))
    return first.unionByName(rest)


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[a-z]{4,}"), F.lit(0))


def top_terms(df: DataFrame, n: int = 10, text: str = "ticket_text") -> DataFrame:
    """Highest tf-idf terms per cluster: term share in the cluster times inverse document count.

    A document's repeats of a term are counted before the shuffle, so a term that occurs
    everywhere is one row per map task and cluster.
    """
    docs = df.agg(F.count(F.lit(1))).scalar()
    words = df.select("cluster_id", F.array_sort(terms(F.col(text))).alias("words"))
    # The first of a run of equal words counts the document, every one counts the term.
    first = F.transform("words", lambda x, i: F.struct(
        x.alias("term"), ((i == 0) | (x != F.get("words", i - 1))).cast("int").alias("new")))
    opened = words.select("cluster_id", F.inline(first))
    tf = opened.groupBy("cluster_id", "term").agg(F.count(F.lit(1)).alias("tf"), F.sum("new").alias("own_df"))
    # Few clusters hold a term, so the sum over them has few rows to gather.
    idf = F.sum("own_df").over(Window.partitionBy("term"))
    weight = F.round(F.col("tf") * F.ln((docs + 1) / (F.col("df") + 1)), 6)
    w = Window.partitionBy("cluster_id").orderBy(F.desc("weight"), "term")
    return (
        tf.withColumn("df", idf).withColumn("weight", weight)
        .withColumn("position", F.row_number().over(w).cast("bigint"))
        .where(F.col("position") <= n)
        .select("cluster_id", "position", "term", "weight")
    )


RISK_TERMS = ("refund", "charged", "payment", "security", "locked", "legal", "cancel")


def summarise(df: DataFrame, centroids: DataFrame, key: str = "ticket_id", risk_share: float = 0.2) -> DataFrame:
    """Per cluster: name from its top terms, size, three exemplars, risk level."""
    risky = tx.contains_any(F.lower("ticket_text"), RISK_TERMS)
    size = df.groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("cluster_size"),
        F.round(F.avg(risky.cast("double")), 4).alias("risk_share"),
    )
    words = top_terms(df, 3).groupBy("cluster_id").agg(
        F.sort_array(F.collect_list(F.struct("position", "term"))).alias("t")
    ).select("cluster_id", F.array_join(F.transform("t", lambda x: x["term"]), "_").alias("name"))
    shown = nearest_rows(df, centroids, key, 3).groupBy("cluster_id").agg(
        F.sort_array(F.collect_list(F.struct("position", F.col("ticket_text").alias("q")))).alias("e")
    ).select("cluster_id", F.transform("e", lambda x: x["q"]).alias("example_queries"))
    return (
        size.join(words, "cluster_id", "left").join(shown, "cluster_id", "left")
        .withColumn("risk_level", F.when(F.col("risk_share") >= risk_share, "high").otherwise("low"))
    )


def joined_labels(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(cluster_id, root) with the least linked id as root; ``links`` (a, b) hold both directions.

    Each round hangs every group with a smaller neighbouring group below the smallest of them,
    and then follows these steps to their ends by doubling them. Groups that get no step are
    those smaller than all their neighbours, so rounds and doublings grow with the logarithm of
    a chain's length. Steps and labels are stored in each round.
    """
    labels = materialise(nodes.select("cluster_id", F.col("cluster_id").alias("root")), "labels")
    while True:
        here = labels.select(F.col("cluster_id").alias("a"), F.col("root").alias("root_a"))
        there = labels.select(F.col("cluster_id").alias("b"), F.col("root").alias("root_b"))
        offers = links.join(here, "a").join(there, "b").where("root_b < root_a")
        steps = materialise(offers.groupBy(F.col("root_a").alias("root")).agg(F.min("root_b").alias("to")), "steps")
        if steps.isEmpty():
            return labels
        while True:
            ahead = steps.select(F.col("root").alias("to"), F.col("to").alias("end"))
            doubled = steps.join(ahead, "to", "left")
            if doubled.where("end IS NOT NULL").isEmpty():
                break
            steps = materialise(doubled.select("root", F.coalesce("end", "to").alias("to")), "steps")
        labels = materialise(labels.join(steps, "root", "left").select("cluster_id", F.coalesce("to", "root").alias("root")), "labels")


def merge_plan(centroids: DataFrame, threshold: float) -> DataFrame:
    """(name, source_cluster_ids): clusters whose centroids are linked by a cosine of ``threshold``
    or more, directly or through others; the name is the least cluster id of the group.

    Centroids meet in blocks, and only a forest of the links of two blocks leaves a task.
    """
    points = materialise(centroids.select("cluster_id", F.col("centroid").alias("vector")), "centroids")
    near = blocks.linked(
        points.select(F.col("cluster_id").alias("query_id"), "vector"),
        points.select(F.col("cluster_id").alias("case_key"), "vector"), threshold, 1024, 1024)
    links = materialise(near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    labels = joined_labels(points.select("cluster_id"), links)
    return labels.groupBy("root").agg(F.sort_array(F.collect_list("cluster_id")).alias("source_cluster_ids")).select(
        F.concat(F.lit("cluster_"), F.col("root").cast("string")).alias("name"), "source_cluster_ids")


def merge_issues(clusters: DataFrame, plan: DataFrame) -> DataFrame:
    """Clusters that a merge plan leaves out, names twice or makes up."""
    mapped = plan.select(F.explode("source_cluster_ids").alias("cluster_id"))
    ids = clusters.select("cluster_id").distinct()
    missing = ids.join(mapped, "cluster_id", "left_anti").withColumn("issue", F.lit("not mapped"))
    twice = mapped.groupBy("cluster_id").count().where("count > 1").select(
        "cluster_id", F.lit("mapped more than once").alias("issue"))
    unknown = mapped.distinct().join(ids, "cluster_id", "left_anti").withColumn("issue", F.lit("unknown cluster"))
    return missing.unionByName(twice).unionByName(unknown)


def taxonomy_checks(taxonomy: DataFrame, names: tuple[str, ...]) -> dict[str, Column]:
    """Rules for ``quality_report`` over a taxonomy table."""
    return {
        "known_name": F.col("name").isin(*names),
        "risk_level": F.col("risk_level").isin("low", "high"),
        "has_definition": F.length("definition") > 0,
    }
