"""From raw tickets to a labelled corpus and an index of solved cases, stage by stage.

Every stage is a stored table, so that a later stage reads columns and never repeats the
text work of an earlier one, and a failed run resumes at its last finished stage.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketloom.config import TriageConfig
from ticketloom.operators import clustering as cl
from ticketloom.operators import hygiene as hy
from ticketloom.operators import index as ix
from ticketloom.operators import labelling as lb
from ticketloom.sources import tables as tb


@dataclass(frozen=True)
class Corpus:
    clean: DataFrame
    labelled: DataFrame
    index: DataFrame


def stage(root: str, name: str, make: Callable[[], DataFrame], spark) -> DataFrame:
    """The stored table of a stage, made only when it is not there yet."""
    path = f"{root.rstrip('/')}/{name}"
    if not tb.path_exists(spark, f"{path}/_SUCCESS"):
        tb.write_table(make(), path)
    return tb.read_table(spark, path)


def build_corpus(
    raw: DataFrame, root: str, taxonomy: DataFrame, centroids: DataFrame | None = None, *,
    embed: Callable[[DataFrame], DataFrame] = cl.embed_text, holdout: DataFrame | None = None,
    clusters: int = 24, cfg: TriageConfig = TriageConfig(),
) -> Corpus:
    """clean -> vectors -> clusters -> labels -> index of solved tickets.

    ``raw`` carries ``created_at``. Without given centroids the clusters are fitted here.
    Fails when fewer solved tickets than wanted come out of cleaning.
    """
    spark = raw.sparkSession
    clean = stage(root, "clean", lambda: hy.clean_tickets(raw, extra=("created_at",)), spark)
    hy.require_min_rows(hy.solved_only(clean), cfg.min_solved_rows).limit(1).count()
    vectors = stage(root, "vectors", lambda: embed(clean).select("ticket_id", "embedding"), spark)
    joined = clean.join(vectors, "ticket_id")

    def label() -> DataFrame:
        given = centroids
        if given is None:
            features = stage(root, "features", lambda: cl.with_features(vectors).select("ticket_id", "features"), spark)
            model = cl.fit_kmeans(features, clusters)
            rows = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
            given = spark.createDataFrame(rows, "cluster_id int, centroid array<double>")
        return lb.label_by_cluster(cl.assign_nearest(joined, given), taxonomy, given)

    labelled = stage(root, "labelled", label, spark)

    def index() -> DataFrame:
        cases = ix.to_index_rows(ix.solved_cases(labelled, holdout))
        return ix.upsert(None, cases).withColumn("embedding", F.col("embedding").cast("array<double>"))

    # Sorted by intent inside the files: a search by intent skips row groups.
    table = stage(root, "index", lambda: index().sortWithinPartitions("intent"), spark)
    return Corpus(clean, labelled, table)
