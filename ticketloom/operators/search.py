"""Top-k search over solved cases: intent filter, fallback, boost, tiers; exact and approximate."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ticketloom import constants as K
from ticketloom.config import TriageConfig
from ticketloom.functions import vectors as vx
from ticketloom.operators import blocks
from ticketloom.session import materialise

EVERYTHING = "*"


def wants_filter(intent: Column) -> Column:
    return F.coalesce((intent != "") & (intent != K.OTHER_INTENT), F.lit(False))


def scoped(queries: DataFrame, index: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Give both sides their scope; also returns the bytes of the cases per scope.

    A query searches its intent, or everything when the intent is blank, ``other`` or has
    no case at all. The index is offered under its intent and under everything; the copy
    nobody asks for is dropped before its vectors are shuffled.
    """
    # One pass over the intent column, then a table of a few rows.
    per_intent = blocks.small_side(
        index.groupBy(F.col("intent").alias("scope")).agg(
            F.sum(blocks.row_bytes(index, "case_key", "embedding", "source")).alias("case_bytes")))
    total = per_intent.agg(F.lit(EVERYTHING).alias("scope"), F.sum("case_bytes").alias("case_bytes"))
    wanted = queries.withColumn("scope", F.when(wants_filter(F.col("intent")), F.col("intent")))
    wanted = wanted.join(per_intent, "scope", "left").withColumn(
        "scope", F.when(F.col("case_bytes") > 0, F.col("scope")).otherwise(F.lit(EVERYTHING))
    ).drop("case_bytes")
    offered = index.withColumn("scope", F.explode(F.array(F.col("intent"), F.lit(EVERYTHING))))
    return wanted, offered, per_intent.unionByName(total)


def cut(pairs: DataFrame, k: int) -> DataFrame:
    """The k most similar cases per query, ties by case key; adds ``cut_rank``."""
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "case_key")
    return pairs.withColumn("cut_rank", F.row_number().over(w)).where(F.col("cut_rank") <= k)


def nearest(queries: DataFrame, index: DataFrame, k: int, cfg: TriageConfig = TriageConfig()) -> DataFrame:
    """Exact (query_id, case_key, similarity, cut_rank) without intent filter or boost."""
    pairs = blocks.top_k_pairs(
        queries.select("query_id", "vector"),
        index.select("case_key", F.col("embedding").alias("vector")),
        k, cfg.block_rows, cfg.query_rows,
    )
    return cut(pairs, k)


def raw_similarity(similarity: Column) -> Column:
    """Clamped at zero; a missing distance counts as 0.5."""
    return F.greatest(F.lit(0.0), F.coalesce(similarity, F.lit(0.5)))


def boosted(raw: Column, source: Column, boost: float) -> Column:
    extra = F.when(F.coalesce(source, F.lit(K.HUMAN)) == K.HUMAN, F.lit(boost)).otherwise(F.lit(0.0))
    return F.least(F.lit(1.0), raw + extra)


def finish_hits(pairs: DataFrame, index: DataFrame, cfg: TriageConfig, boost_before_cut: bool = False) -> DataFrame:
    """Cut by similarity, boost, round, rank again on the rounded score, fetch the case fields.

    With ``boost_before_cut`` the k best are those of the boosted score. Both ranks use the
    same grouping, so they share one shuffle; the case texts join last, onto at most k rows
    per query.
    """
    raw = raw_similarity(F.col("similarity"))
    w = Window.partitionBy("query_id").orderBy(
        F.desc("similarity_score"), F.desc("similarity"), "case_key"
    )
    ranked = (
        (pairs if boost_before_cut else cut(pairs, cfg.top_k))
        .withColumn("raw_similarity", F.round(raw, 4))
        .withColumn("similarity_score", F.round(boosted(raw, F.col("source"), cfg.human_boost), 4))
        .withColumn("hit_rank", F.row_number().over(w).cast("bigint"))
        .where(F.col("hit_rank") <= cfg.top_k)
        .select("query_id", "hit_rank", "case_key", "source", "raw_similarity", "similarity_score")
    )
    fields = index.select("case_key", "case_id", F.col("document").alias("query"), "resolution", "intent", "product")
    return ranked.join(fields, "case_key").select(
        "query_id", "hit_rank", "case_key", "case_id", "query", "resolution", "intent", "source",
        "product", "raw_similarity", "similarity_score",
    )


def _stored(queries: DataFrame, stored: bool) -> DataFrame:
    """Queries as a narrow stored table: planning and search read it, nobody recomputes it."""
    narrow = queries.select("query_id", "intent", "vector")
    return narrow if stored else materialise(narrow, "queries")


def search(
    queries: DataFrame, index: DataFrame, cfg: TriageConfig = TriageConfig(), boost_before_cut: bool = False,
    stored: bool = False,
) -> DataFrame:
    """Exact search. ``queries``: query_id, intent, vector. One row per query and hit. ``stored``
    queries are a written table already and are not written again."""
    wanted, offered, counts = scoped(_stored(queries, stored), index)
    if boost_before_cut:
        # The boost is one value per kind of source, so the k best of each kind hold the k best.
        kind = F.when(F.coalesce("source", F.lit(K.HUMAN)) == K.HUMAN, "/boosted").otherwise("/plain")
        both = F.array(*[F.concat("scope", F.lit(k)) for k in ("/boosted", "/plain")])
        wanted = wanted.withColumn("scope", F.explode(both))
        offered, counts = offered.withColumn("scope", F.concat("scope", kind)), None
    pairs = blocks.top_k_pairs(
        wanted, offered.select("case_key", F.col("embedding").alias("vector"), "scope", "source"),
        cfg.top_k, cfg.block_rows, cfg.query_rows, carry=("source",), case_sizes=counts,
    )
    return finish_hits(pairs, index, cfg, boost_before_cut)


# --- approximate search -------------------------------------------------------------


#: Rows that cell centres are fitted on, and centres kept on the driver, at most.
FIT_ROWS, MAX_CELLS = 200_000, 4096


def fit_cells(index: DataFrame, n_cells: int | None = None, seed: int = 42) -> np.ndarray:
    """Unit centres of an inverted-file index, kept on the driver.

    By default as many as the square root of the rows, up to ``MAX_CELLS``. They are fitted on
    about ``FIT_ROWS`` rows at most; every row is in a cell, whatever was fitted.
    """
    rows = index.count()
    n_cells = n_cells or max(1, min(MAX_CELLS, math.isqrt(rows)))
    unit = index.select(vx.l2_normalise(F.col("embedding").cast("array<double>")).alias("unit"))
    if rows > FIT_ROWS:
        unit = unit.sample(FIT_ROWS / rows, seed)
    unit = materialise(unit.distinct(), "fit-rows")  # copies fit nothing
    few = unit.limit(4 * n_cells + 1).collect()
    if len(few) <= 4 * n_cells or n_cells == 1:  # hardly more vectors than cells: every n-th is a centre
        few = sorted(r["unit"] for r in few)
        centres = np.array(few[::max(1, -(-len(few) // n_cells))])
    else:
        features = unit.select(array_to_vector("unit").alias("features"))
        centres = np.array(KMeans(k=n_cells, seed=seed, featuresCol="features").fit(features).clusterCenters())
    return centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)


def _nearest_cells(unit: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    return np.argsort(-(unit @ centres.T), axis=1, kind="stable")[:, :n].astype("int32")


def probe(vector: Column, centres: np.ndarray, n: int) -> Column:
    """The n nearest cells of a vector."""

    @F.pandas_udf("array<int>")
    def cells(v: pd.Series) -> pd.Series:
        if not len(v):
            return pd.Series([], dtype=object)
        return pd.Series(list(_nearest_cells(blocks.unit_rows(v), centres, n)))

    return cells.asNondeterministic()(vector)


def probed_cells(centres: np.ndarray, n: int) -> blocks.Cells:
    """A query opens its n nearest cells."""
    def opens(unit: np.ndarray, _: np.ndarray) -> np.ndarray:
        wanted = np.zeros((len(unit), len(centres)), dtype=bool)
        np.put_along_axis(wanted, _nearest_cells(unit, centres, n), True, axis=1)
        return wanted

    return blocks.Cells(len(centres), opens, "floor")


def bounded_cells(centres: np.ndarray, radii: np.ndarray) -> blocks.Cells:
    """A query opens all cells that may hold a case as similar as its ``floor``."""
    return blocks.Cells(len(centres), lambda unit, floor: _within(unit, floor, centres, radii), "floor")


def _within(unit: np.ndarray, floor: np.ndarray, centres: np.ndarray, radii: np.ndarray) -> np.ndarray:
    near = np.clip(unit @ centres.T, -1.0, 1.0)
    limit = np.arccos(np.clip(floor.astype("float64") - 1e-9, -1.0, 1.0))
    return np.arccos(near) - radii[None, :] <= limit[:, None] + 1e-9


def angle_to(vector: Column, cell: Column, centres: np.ndarray) -> Column:
    """Angle between a vector and the centre of a cell."""

    @F.pandas_udf("double")
    def angle(v: pd.Series, c: pd.Series) -> pd.Series:
        if not len(v):
            return pd.Series([], dtype="float64")
        near = (blocks.unit_rows(v) * centres[c.to_numpy()]).sum(axis=1)
        return pd.Series(np.arccos(np.clip(near, -1.0, 1.0)))

    return angle(vector, cell)


def open_cells(vector: Column, floor: Column, centres: np.ndarray, radii: np.ndarray, probed: int) -> Column:
    """Cells beyond the probed ones that may still hold a case as similar as ``floor``.

    A case within angle r of its centre is at least (angle to the centre - r) away from the
    query; a cell is skipped only when even that is farther than the floor allows.
    """

    @F.pandas_udf("array<int>")
    def cells(v: pd.Series, s: pd.Series) -> pd.Series:
        if not len(v):
            return pd.Series([], dtype=object)
        unit = blocks.unit_rows(v)
        wanted = _within(unit, s.to_numpy(dtype="float64"), centres, radii)
        np.put_along_axis(wanted, _nearest_cells(unit, centres, probed), False, axis=1)
        return pd.Series([np.nonzero(row)[0].astype("int32") for row in wanted])

    return cells.asNondeterministic()(vector, floor)


def search_cells(
    queries: DataFrame, index: DataFrame, centres: np.ndarray, probes: int = 4,
    cfg: TriageConfig = TriageConfig(), exact: bool = True, stored: bool = False,
) -> DataFrame:
    """Search by cells: a query meets the cases of its nearest cells first.

    The cells of a scope lie along its tiles, so the work per query falls by cells / probes, and
    a query is sent once to a tile however many of its cells it opens. The k-th best similarity
    found so far then bounds a second round over just those cells that could hold a case as good:
    same hits as ``search``, less work where vectors form clusters. Without ``exact`` there is no
    second round; ``probes_for`` finds the probes for a wanted recall, and ``recall_at_k``
    measures it. ``stored`` is as in ``search``.
    """
    wanted, offered, sizes = scoped(_stored(queries, stored), index)
    offered = offered.withColumn("vector", F.col("embedding")).withColumn("cell", home_cell(F.col("embedding"), centres))
    offered = materialise(offered.select("case_key", "scope", "source", "vector", "cell"), "cells")

    def meet_cells(seeking: DataFrame, cells: blocks.Cells) -> DataFrame:
        return blocks.top_k_pairs(
            seeking, offered, cfg.top_k, cfg.block_rows, cfg.query_rows, carry=("source",), case_sizes=sizes, cells=cells)

    pairs = meet_cells(wanted.withColumn("floor", F.lit(-1.0)), probed_cells(centres, probes))
    if exact:
        first = cut(pairs, cfg.top_k).groupBy("query_id").agg(
            F.when(F.count(F.lit(1)) >= cfg.top_k, F.min("similarity")).alias("floor"))
        radii = _radii(offered, "cell", centres)
        seeking = wanted.join(materialise(first, "floors"), "query_id", "left")
        # The bound lets the cells of the first round in again, so the second alone is the whole result.
        pairs = meet_cells(seeking.withColumn("floor", F.coalesce("floor", F.lit(-1.0))), bounded_cells(centres, radii))
    return finish_hits(pairs, index, cfg)


def probes_for(recall: float, hits: DataFrame, queries: DataFrame, index: DataFrame, centres: np.ndarray) -> int:
    """Least number of probes that reaches ``recall``, from exact hits of some queries.

    Each hit asks for as many probes as the rank of its case's cell among the query's cells;
    the wanted share of hits is a quantile of those ranks.
    """
    @F.pandas_udf("array<int>")
    def needed(v: pd.Series, homes: pd.Series) -> pd.Series:
        out, step = [], max(1, 1_000_000 // len(centres))
        for at in range(0, len(v), step):
            cells = _nearest_cells(blocks.unit_rows(v.iloc[at:at + step]), centres, len(centres))
            ranks = np.argsort(cells, axis=1) + 1
            out.extend(row[own] for row, own in zip(ranks, homes.iloc[at:at + step]))
        return pd.Series(out, dtype=object)

    homes = index.select("case_key", home_cell(F.col("embedding"), centres).alias("home"))
    # One row per query: only its hits' cells move, not its order of all cells.
    found = hits.select("query_id", "case_key").join(homes, "case_key").groupBy("query_id").agg(
        F.collect_list("home").alias("homes"))
    ranks = queries.select("query_id", "vector").join(found, "query_id").select(
        F.explode(needed.asNondeterministic()(F.col("vector"), F.col("homes"))).alias("needed"))
    counted = ranks.groupBy("needed").agg(F.count(F.lit(1)).alias("n")).orderBy("needed").collect()
    wanted, seen = recall * sum(r["n"] for r in counted), 0
    for row in counted:  # one row per cell at most
        seen += row["n"]
        if seen >= wanted:
            return int(row["needed"])
    return len(centres)


def home_cell(vector: Column, centres: np.ndarray) -> Column:
    """The nearest cell of a vector."""
    return probe(vector, centres, 1)[0]


def cone_cells(cases: DataFrame, cell: str, centres: np.ndarray) -> blocks.Cells:
    """Cells of ``cases`` (vector, cell) that may hold one with a cosine of ``floor`` or more.

    A high floor is a narrow cone, which few cells touch; the angle bound rules out the rest.
    """
    return bounded_cells(centres, _radii(cases, cell, centres))


def _radii(cases: DataFrame, cell: str, centres: np.ndarray) -> np.ndarray:
    """Largest angle between a cell's centre and a case in it; an empty cell is never opened."""
    reach = cases.groupBy(cell).agg(F.max(angle_to(F.col("vector"), F.col(cell), centres)).alias("r")).collect()
    radii = np.full(len(centres), -np.inf)
    for row in reach:  # one row per cell at most
        radii[row[cell]] = row["r"]
    return radii


def recall_at_k(exact: DataFrame, approximate: DataFrame) -> DataFrame:
    """Share of exact hits that the approximate search found."""
    found = approximate.select("query_id", "case_key", F.lit(1).alias("found"))
    return exact.join(found, ["query_id", "case_key"], "left").agg(
        F.count(F.lit(1)).alias("exact_hits"),
        F.count("found").alias("found_hits"),
        F.round(F.try_divide(F.count("found"), F.count(F.lit(1))), 4).alias("recall"),
    )


def centroid_vectors(df: DataFrame, cluster: str, vector: str) -> DataFrame:
    """Mean vector per cluster; partial sums are merged, no row list is built."""
    from pyspark.ml.stat import Summarizer

    return df.groupBy(cluster).agg(
        vector_to_array(Summarizer.mean(array_to_vector(F.col(vector)))).alias("centroid")
    )
