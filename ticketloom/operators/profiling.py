"""Counts, distributions and rule checks over ticket tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ticketloom import constants as K
from ticketloom.functions import text as tx
from ticketloom.session import materialise


def count_rows(df: DataFrame, name: str = "row_count") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(name))


def row_counts(raw: DataFrame, clean: DataFrame) -> DataFrame:
    """Raw, unique, solved and unsolved rows; one pass over each table."""
    total = raw.agg(F.count(F.lit(1))).scalar()
    solved = F.count_if(F.col("is_solved"))
    unique = F.count(F.lit(1))
    return clean.agg(
        unique.alias("unique_rows"),
        solved.alias("solved_rows"),
        (unique - solved).alias("unsolved_rows"),
    ).select(total.alias("raw_rows"), "unique_rows", "solved_rows", "unsolved_rows")


def describe(df: DataFrame, measures: dict[str, Column], approximate: bool = False) -> DataFrame:
    """count, mean, std, min, quartiles and max of each measure, one row per measure.

    Exact quartiles keep one counter per distinct value; lengths repeat, so that state is
    small. ``approximate`` swaps in a fixed-size sketch.
    """
    shares = F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))
    stats = []
    for name, value in measures.items():
        v = value.cast("double")
        quartiles = F.percentile_approx(v, shares, 10_000) if approximate else F.percentile(v, shares)
        stats.append(
            F.struct(
                F.lit(name).alias("measure"),
                F.count(v).alias("count"),
                F.avg(v).alias("mean"),
                F.stddev_samp(v).alias("std"),
                F.min(v).alias("min"),
                quartiles.alias("q"),
                F.max(v).alias("max"),
            ).alias(name)
        )
    one = df.agg(*stats)
    rows = one.select(F.explode(F.array(*[F.col(n) for n in measures])).alias("m")).select("m.*")
    return rows.select(
        "measure",
        "count",
        F.round("mean", 6).alias("mean"),
        F.round("std", 6).alias("std"),
        "min",
        F.col("q")[0].alias("p25"),
        F.col("q")[1].alias("p50"),
        F.col("q")[2].alias("p75"),
        "max",
    )


#: Values that a quantile sketch keeps at its lowest level: a rank error of about 0.3 %.
SKETCH_SIZE = 800


def daily_sketches(df: DataFrame, measures: dict[str, Column], day: Column) -> DataFrame:
    """(day, measure, sketch): a mergeable quantile sketch of whole numbers per day and measure.

    A few kilobytes each, so that new days are added without reading the old rows again.
    """
    values = F.array(*[F.struct(F.lit(n).alias("measure"), v.cast("bigint").alias("value")) for n, v in measures.items()])
    rows = df.select(day.alias("day"), F.explode(values).alias("m")).select("day", "m.*").where("value IS NOT NULL")
    return rows.groupBy("day", "measure").agg(F.kll_sketch_agg_bigint("value", SKETCH_SIZE).alias("sketch"))


def merged_quantiles(sketches: DataFrame, shares: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """(measure, count, quantiles) over any days: the merged sketches, in the order of ``shares``."""
    whole = sketches.groupBy("measure").agg(F.kll_merge_agg_bigint("sketch").alias("sketch"))
    return whole.select(
        "measure", F.kll_sketch_get_n_bigint("sketch").alias("count"),
        F.array(*[F.kll_sketch_get_quantile_bigint("sketch", F.lit(float(s))) for s in shares]).alias("quantiles"))


def length_profile(clean: DataFrame) -> dict[str, Column]:
    solved = F.col("is_solved")
    return {
        "ticket_chars": F.length("ticket_text"),
        "resolution_chars": F.when(solved, F.length("resolution")),
    }


def word_profile(clean: DataFrame) -> dict[str, Column]:
    solved = F.col("is_solved")
    return {
        "ticket_words": tx.word_count(F.col("ticket_text")),
        "resolution_words": F.when(solved, tx.word_count(F.col("resolution"))),
    }


def distribution(df: DataFrame, column: str) -> DataFrame:
    """Value, count and share in percent; largest first, ties by name.

    The total is the sum of the counts, so the table itself is read once.
    """
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("row_count"))
    total = counts.agg(F.sum("row_count")).scalar()
    return counts.withColumn("share_pct", F.round(100.0 * F.col("row_count") / total, 4)).orderBy(
        F.desc("row_count"), column)


def noise_share(labelled: DataFrame, floor: float = 0.60) -> DataFrame:
    """Rows labelled ``other`` or with a confidence below the floor."""
    noisy = (F.col("assigned_intent") == K.OTHER_INTENT) | (F.col("intent_confidence") < floor)
    return labelled.agg(
        F.count(F.lit(1)).alias("row_count"), F.count_if(noisy).alias("noise_count")
    ).withColumn("noise_pct", F.round(F.try_divide(100.0 * F.col("noise_count"), F.col("row_count")), 4))


def quality_report(
    df: DataFrame, not_null: tuple[str, ...] = (), unique: tuple[str, ...] = (),
    required: tuple[str, ...] = (), rules: dict[str, Column] | None = None,
) -> DataFrame:
    """One row per rule: rule, violations, passed. Everything but uniqueness is one scan.

    Distinct counts run as their own aggregations, so a repeated value is combined on the
    map side and never gathered.
    """
    missing = [c for c in required if c not in df.columns]
    checks = {f"null:{c}": F.count_if(F.col(c).isNull()) for c in not_null}
    checks |= {f"rule:{n}": F.count_if(~F.coalesce(cond, F.lit(False))) for n, cond in (rules or {}).items()}
    parts = []
    if checks:
        one = df.agg(*[v.alias(k) for k, v in checks.items()])
        entries = F.array(*[
            F.struct(F.lit(k).alias("rule"), F.col(f"`{k}`").alias("violations")) for k in checks
        ])
        parts.append(one.select(F.inline(entries)))
    for c in unique:
        per_value = df.groupBy(c).agg(F.count(F.lit(1)).alias("n"))
        parts.append(per_value.agg(
            F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("violations")
        ).select(F.lit(f"unique:{c}").alias("rule"), "violations"))
    if required:
        spark = df.sparkSession
        parts.append(spark.range(1).select(
            F.lit("columns").alias("rule"), F.lit(len(missing)).cast("bigint").alias("violations")
        ))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.withColumn("passed", F.col("violations") == 0)


def funnel(stages: list[tuple[str, DataFrame]]) -> DataFrame:
    """Row count per stage, in stage order."""
    out = None
    for ordinal, (name, df) in enumerate(stages, 1):
        row = df.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(ordinal).cast("bigint").alias("stage_no"), F.lit(name).alias("stage"), "row_count"
        )
        out = row if out is None else out.unionByName(row)
    return out


def counted(df: DataFrame, stage: str) -> tuple[DataFrame, int]:
    """A stage as a stored table, and its rows, counted by the job that writes it."""
    seen = Observation(stage)
    stored = materialise(df.observe(seen, F.count(F.lit(1)).alias("row_count")), stage)
    # A plan that is known to be empty runs no job that could count.
    return stored, int(seen.get.get("row_count") or 0)


def funnel_of(spark: SparkSession, counts: list[tuple[str, int]]) -> DataFrame:
    """``funnel`` of stages that were counted as they were written."""
    rows = [(n, name, count) for n, (name, count) in enumerate(counts, 1)]
    return spark.createDataFrame(rows, "stage_no bigint, stage string, row_count bigint")


def pii_residue(df: DataFrame, text: str = "document", by: str = "source") -> DataFrame:
    """Rows that still match a redaction pattern, per group and in total."""
    flags = tx.pii_flags(F.col(text))
    return df.groupBy(by).agg(
        F.count(F.lit(1)).alias("row_count"),
        *[F.count_if(flag).alias(f"{name}_hits") for name, flag in flags.items()],
    )
