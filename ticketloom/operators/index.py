"""The index of solved cases: keys, defaults, upsert, feedback gate, ledger.

An index is a table with one row per ``case_key``. Writers return the new snapshot; the
caller stores it under a fresh path.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ticketloom import constants as K
from ticketloom.config import TriageConfig
from ticketloom.functions import text as tx
from ticketloom.operators import blocks, search
from ticketloom.session import materialise

INDEX_COLUMNS = (
    "case_key", "document", "case_id", "intent", "source", "resolution", "product",
    "timestamp", "embedding",
)


def md5_hex(text: Column, digits: int) -> Column:
    return F.substring(F.md5(text.cast("binary")), 1, digits)


def case_key(case_id: Column, ticket_id: Column, document: Column) -> Column:
    """``{id}_{8 hex digits of the text}``; the ticket id stands in for a missing case id."""
    own = F.coalesce(F.nullif(case_id.cast("string"), F.lit("")), ticket_id.cast("string"))
    return F.concat_ws("_", own, md5_hex(document, 8))


def to_index_rows(cases: DataFrame, now: Column | None = None) -> DataFrame:
    """Cases with any of the optional columns -> index rows with keys and defaults."""
    have = set(cases.columns)

    def opt(name: str, default: Column) -> Column:
        return F.coalesce(F.col(name), default) if name in have else default

    empty = F.lit(None).cast("string")
    own_id = F.col("case_id") if "case_id" in have else empty
    ticket_id = F.col("ticket_id") if "ticket_id" in have else empty
    document = tx.strip(F.col("ticket_text"))
    keep = [F.col("seq")] if "seq" in have else []
    return cases.select(
        case_key(own_id, ticket_id, document).alias("case_key"),
        document.alias("document"),
        F.coalesce(F.nullif(own_id.cast("string"), F.lit("")), ticket_id.cast("string")).alias("case_id"),
        opt("intent", F.lit(K.OTHER_INTENT)).alias("intent"),
        opt("source", F.lit(K.HUMAN)).alias("source"),
        opt("resolution", F.lit("")).alias("resolution"),
        opt("product", F.lit("")).alias("product"),
        opt("timestamp", now if now is not None else F.current_timestamp()).alias("timestamp"),
        F.col("embedding"),
        *keep,
    )


def upsert(index: DataFrame | None, rows: DataFrame) -> DataFrame:
    """New snapshot: for each key the row with the highest seq, new rows over old ones.

    ``rank = 1`` is cut below the shuffle, so a key written over and over does not collect.
    """
    if "seq" not in rows.columns:
        rows = rows.withColumn("seq", F.lit(0).cast("bigint"))
    rows = rows.withColumn("__new", F.lit(1))
    if index is not None:
        never = F.lit(None).cast(rows.schema["seq"].dataType)
        old = index.withColumn("seq", never).withColumn("__new", F.lit(0))
        rows = rows.unionByName(old)
    w = Window.partitionBy("case_key").orderBy(F.desc("__new"), F.desc("seq"))
    latest = rows.withColumn("__rank", F.row_number().over(w)).where("__rank = 1")
    return latest.select(*INDEX_COLUMNS)


def submitted(rows: DataFrame) -> DataFrame:
    """Rows handed in, not distinct keys."""
    return rows.agg(F.count(F.lit(1)).alias("submitted"))


def solved_cases(labelled: DataFrame, holdout: DataFrame | None = None) -> DataFrame:
    """Labelled tickets (with vectors) -> cases; solved ones only, holdout ids left out."""
    cases = labelled.where(F.col("is_solved"))
    if holdout is not None:
        cases = cases.join(holdout.select("ticket_id"), "ticket_id", "left_anti")
    return cases.select(
        "ticket_id", "ticket_text", "resolution", F.col("assigned_intent").alias("intent"),
        "product", F.lit(K.HUMAN).alias("source"),
        F.col("created_at").alias("timestamp"), "embedding",
    )


def missing_rows(index: DataFrame, rows: DataFrame) -> DataFrame:
    """What a rebuild still has to add: exact idempotence by key."""
    return rows.join(index.select("case_key"), "case_key", "left_anti")


def approvals_to_rows(approvals: DataFrame, now: Column | None = None) -> DataFrame:
    """Approved replies (query, reply, intent, embedding, seq) -> index rows.

    The id is a digest of the query as it came, of ``query_md5`` if that is there; what is stored is
    stripped and redacted.
    """
    own = F.substring("query_md5", 1, 10) if "query_md5" in approvals.columns else md5_hex(F.col("query"), 10)
    case_id = F.concat(F.lit("agent_approved_"), own)
    return approvals.select(
        case_id.alias("case_key"),
        tx.strip(tx.redact(F.col("query"))).alias("document"),
        case_id.alias("case_id"),
        F.col("intent"),
        F.lit(K.AGENT).alias("source"),
        tx.strip(F.col("reply")).alias("resolution"),
        F.lit("").alias("product"),
        (now if now is not None else F.current_timestamp()).alias("timestamp"),
        F.col("embedding"),
        F.col("seq"),
    )


def near_bound(cfg: TriageConfig) -> float:
    """Reported similarities have four places; one rounds above the near-duplicate bound from here on."""
    return cfg.near_duplicate + 0.5e-4


def _near(queries: DataFrame, cases: DataFrame, cells: blocks.Cells, cfg: TriageConfig) -> DataFrame:
    """case_key of the queries with a near-duplicate of lower seq; a query opens the cells its cone touches."""
    found = blocks.any_above(
        queries.select(F.col("case_key").alias("query_id"), F.col("embedding").alias("vector"), "seq",
                       F.lit(near_bound(cfg) - 1e-9).alias(cells.value)),
        cases.select("case_key", F.col("embedding").alias("vector"), "seq", F.col("home").alias("cell")),
        near_bound(cfg), cfg.block_rows, cfg.query_rows, cells)
    return found.select(F.col("query_id").alias("case_key"))


def _homes(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    vector = F.col("embedding")
    return materialise(rows.withColumn("home", search.home_cell(vector, centres)), "homes")


def _cells(cases: DataFrame, centres: np.ndarray) -> blocks.Cells:
    return search.cone_cells(cases.withColumn("vector", F.col("embedding")), "home", centres)


def not_near_index(
    rows: DataFrame, index: DataFrame, cfg: TriageConfig = TriageConfig(), centres: np.ndarray | None = None
) -> DataFrame:
    """Rows whose best raw similarity in the index is at most the near-duplicate bound.

    The bound is a narrow cone, so a row meets only the cells that its cone touches.
    """
    rows = materialise(rows, "rows")
    if index.isEmpty():
        return rows
    centres = search.fit_cells(index) if centres is None else centres
    # All of the index is earlier.
    cases = _homes(index.select("case_key", "embedding", F.lit(0).cast("bigint").alias("seq")), centres)
    asking = rows.select("case_key", "embedding", F.lit(1).cast("bigint").alias("seq"))
    return rows.join(_near(asking, cases, _cells(cases, centres), cfg), "case_key", "left_anti")


def first_of_equals(rows: DataFrame) -> DataFrame:
    """Earliest row per id and per vector. Equal vectors share every neighbour, so all but
    the earliest lose; taking them out first keeps copies from meeting each other."""
    for key in ("case_key", "embedding"):
        w = Window.partitionBy(key).orderBy("seq", F.xxhash64("embedding"), "case_key")
        rows = rows.withColumn("__rank", F.row_number().over(w)).where("__rank = 1").drop("__rank")
    return rows


def admit_in_order(
    rows: DataFrame, cfg: TriageConfig = TriageConfig(), centres: np.ndarray | None = None
) -> DataFrame:
    """Greedy admission by ``seq``: keep a row unless an earlier kept one is a near-duplicate.

    ``rows`` come from ``first_of_equals``, so that copies do not meet each other.
    Round by round: a row without any earlier undecided near-duplicate is kept; whatever is
    near a kept row goes; the rest waits for the next round. Rounds needed = the longest
    chain of rows each near the one before, one or two in practice.
    """
    rows = materialise(rows, "rows")
    if rows.isEmpty():
        return rows
    # Cells are settled once, over all rows; the rounds below only thin the rows out.
    centres = search.fit_cells(rows) if centres is None else centres
    # Rounds hand keys, vectors and homes on; the other columns meet the kept keys at the end.
    undecided = _homes(rows.select("case_key", "embedding", "seq"), centres)
    cells = _cells(undecided, centres)
    kept = undecided.select("case_key").limit(0)
    while not undecided.isEmpty():
        waiting = materialise(undecided.join(_near(undecided, undecided, cells, cfg), "case_key", "left_semi"), "round")
        winners = undecided.join(waiting.select("case_key"), "case_key", "left_anti")
        winners = materialise(winners, "round")
        kept = kept.unionByName(winners.select("case_key"))
        if waiting.isEmpty():
            break
        undecided = materialise(waiting.join(_near(waiting, winners, cells, cfg), "case_key", "left_anti"), "round")
    return rows.join(kept, "case_key", "left_semi")


def add_approved(index: DataFrame, approvals: DataFrame, cfg: TriageConfig = TriageConfig(),
                 now: Column | None = None) -> DataFrame:
    """Admitted approvals as index rows; adding them in one batch equals one by one."""
    rows = approvals_to_rows(approvals, now)
    centres = None if index.isEmpty() else search.fit_cells(index)
    # Keys and vectors settle who is admitted; texts meet the admitted keys once, at the end.
    short = missing_rows(index, rows.select("case_key", "embedding", "seq"))
    fresh = not_near_index(first_of_equals(short), index, cfg, centres)
    return _of_admitted(rows, admit_in_order(fresh, cfg, centres)).select(*INDEX_COLUMNS)


def _of_admitted(rows: DataFrame, admitted: DataFrame) -> DataFrame:
    """The rows of the admitted (case_key, embedding, seq), one each: a row delivered again is one."""
    mark = F.xxhash64("seq", "embedding")
    known = admitted.select(F.col("case_key").alias("__key"), mark.alias("__mark"))
    # A range and not an equation: both sides then lie by case key alone, as the window wants them.
    own = rows.withColumn("__own", mark).join(
        known, (F.col("case_key") == F.col("__key")) & F.col("__own").between(F.col("__mark"), F.col("__mark")))
    w = Window.partitionBy("case_key").orderBy("__own")
    return own.withColumn("__rank", F.row_number().over(w)).where("__rank = 1")


def ledger_counts(index: DataFrame) -> DataFrame:
    return index.agg(
        F.count(F.lit(1)).alias("total_cases"),
        F.count_if(F.col("source") == K.HUMAN).alias("human_resolved_count"),
        F.count_if(F.col("source") == K.AGENT).alias("agent_approved_count"),
    )


def ledger_recent(index: DataFrame, n_agent: int = 20, n_human: int = 8) -> DataFrame:
    """Newest cases per source, texts cut to 120 characters (the samples of the report)."""
    sizes = F.when(F.col("source") == K.AGENT, n_agent).when(F.col("source") == K.HUMAN, n_human)
    w = Window.partitionBy("source").orderBy(F.desc("timestamp"), "case_key")
    most = max(n_agent, n_human)
    recent = (
        index.where(F.col("source").isin(K.HUMAN, K.AGENT))
        .withColumn("position", F.row_number().over(w).cast("bigint"))
        .where((F.col("position") <= most) & (F.col("position") <= sizes))
    )
    return recent.select(
        "source", "position", "case_id",
        tx.truncate(F.col("document"), 120).alias("query"),
        tx.truncate(F.col("resolution"), 120).alias("resolution"),
        "intent", "product", "timestamp",
    )
