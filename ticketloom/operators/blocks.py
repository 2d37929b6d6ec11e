"""Block-wise similarity: bounded tiles of two tables meet, only results leave.

Both sides carry a ``scope`` (an intent, or everything). Inside a scope, cases are dealt into
tiles and queries into chunks of up to ``TILE_BYTES``. Each (scope, tile, chunk) is worked off in one
task, in numpy products of ``block_rows`` cases by ``query_rows`` queries, so the size of a product
costs no shuffle, no scope is too hot for a task, no pair is ever a row, and what leaves a task is at
most k rows per query or one row per query. A scope of one tile is shuffled, the tile once per chunk.
In a scope of several, every tile and every chunk is moved and stored once, as one row, and a
cartesian product of these few rows reads them again for each pair: what is written grows with the
rows, only what is read and compared with their pairs. A task takes the tiles of a chunk one after
another, so what a query has found in one bounds what it looks for in the next. Cases may also have a ``cell``: the cells of a
scope are laid out along its tiles, a query is sent once to each tile that holds a cell it opens, and
meets only those cells. Then a tile is sent once per chunk of its own visitors, or stored once as above
where queries open so many tiles that this moves less.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ticketloom.session import materialise, settings

MAX_PLAN_BYTES = 16 << 20
#: Queries by cases of one product of single precision, so that it stays in a core's cache.
PRODUCT = 1024, 256
#: What one side of a task's work holds at most, on average.
TILE_BYTES = 32 << 20


def plan_rows(schema: T.StructType) -> int:
    """Rows of a schema that stay below ``MAX_PLAN_BYTES``: 8 bytes a number, 64 a text, 8 KB a nested value."""
    def width(kind: T.DataType) -> int:
        if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
            return 8192
        return 64 if isinstance(kind, (T.StringType, T.BinaryType)) else 8

    return MAX_PLAN_BYTES // sum(width(f.dataType) for f in schema.fields)


def bounded_rows(df: DataFrame, limit: int) -> list | None:
    """The rows of a small summary table, or None when it has more than ``limit``."""
    rows = df.limit(limit + 1).collect()
    return rows if len(rows) <= limit else None


def small_side(df: DataFrame) -> DataFrame:
    """Make a summary table local and broadcast it, once its size was checked.

    Beyond ``plan_rows`` rows the table stays as it is and Spark picks the join. A local table
    is not computed again by every plan that uses it.
    """
    rows = bounded_rows(df, plan_rows(df.schema))
    if rows is None:
        return df
    table = pa.Table.from_pylist([r.asDict() for r in rows], schema=to_arrow_schema(df.schema))
    return F.broadcast(df.sparkSession.createDataFrame(table, df.schema))


def unit_rows(column: pd.Series) -> np.ndarray:
    """Array column -> matrix of unit rows (a zero vector stays zero)."""
    m = np.array(column.tolist(), dtype="float64")
    if m.ndim == 1:
        return m.reshape(len(column), 0)
    return m / np.maximum(np.sqrt((m * m).sum(axis=1, keepdims=True)), 1e-12)


def row_bytes(df: DataFrame, *columns: str) -> Column:
    """Bytes of a row as a task holds it: 8 a number, 24 a text."""
    total = F.lit(0).cast("bigint")
    for field in (df.schema[c] for c in columns or df.columns):
        kind = field.dataType
        each = 24 if isinstance(getattr(kind, "elementType", kind), (T.StringType, T.BinaryType)) else 8
        many = F.greatest(F.size(field.name), F.lit(0)) if isinstance(kind, T.ArrayType) else F.lit(1)
        total = total + many * F.lit(each)
    return total


@dataclass(frozen=True)
class Cells:
    """Cells of the cases: ``count`` of them, and which ones a query opens.

    ``opens(unit rows, value per row)`` -> boolean matrix, a column per cell; ``value`` names a
    column of the queries. The same rule picks the tiles of a query and the cells inside them.
    """
    count: int
    opens: Callable[[np.ndarray, np.ndarray], np.ndarray]
    value: str

    def opened(self, unit: np.ndarray, value: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """Rows by the given cells; slices keep the matrix over all cells small."""
        step = max(1, 1_000_000 // self.count)
        parts = [self.opens(unit[at:at + step], value[at:at + step])[:, cells] for at in range(0, len(unit), step)]
        return np.concatenate(parts) if parts else np.zeros((0, len(cells)), dtype=bool)


def _cell_tiles(cases: DataFrame, plan: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """scope -> first and last tile of every cell, for the scopes of several tiles.

    The cases of such a scope lie along its tiles in the order of their cells. There are at most
    as many such scopes as tiles in all; every other scope is one tile.
    """
    big = plan.where("tiles > 1").select("scope", "tiles")
    if big.isEmpty():
        return {}
    counted = cases.select("scope", "cell").join(F.broadcast(big), "scope").groupBy("scope", "tiles", "cell").agg(
        F.count(F.lit(1)).alias("n")).collect()
    out = {}
    for scope in {r["scope"] for r in counted}:
        rows = sorted((r["cell"], r["n"]) for r in counted if r["scope"] == scope)
        tiles = next(r["tiles"] for r in counted if r["scope"] == scope)
        cell, n = np.array(rows).T
        end = np.cumsum(n)
        room = -(-int(end[-1]) // tiles)
        first, last = np.ones(cell[-1] + 1, dtype="int32"), np.zeros(cell[-1] + 1, dtype="int32")
        first[cell], last[cell] = (end - n) // room, (end - 1) // room
        out[scope] = first, last
    return out


def _open_tiles(spread: dict, cells: Cells) -> Callable[..., Column]:
    """Tiles of a query: those with a part of a cell that it opens; 0 in a scope of one tile."""
    @F.pandas_udf("array<int>")
    def tiles(scope: pd.Series, vector: pd.Series, value: pd.Series) -> pd.Series:
        out = np.empty(len(scope), dtype=object)
        out[:] = [[0]] * len(scope)
        for name, (first, last) in spread.items():
            at = np.flatnonzero((scope == name).to_numpy())
            if not len(at):
                continue
            wanted = cells.opened(unit_rows(vector.iloc[at]), value.to_numpy()[at], np.arange(len(first)))
            hit = np.stack([wanted[:, (first <= t) & (t <= last)].any(axis=1) for t in range(last.max() + 1)], axis=1)
            for i, row in zip(at, hit):
                out[i] = np.flatnonzero(row).tolist()
        return pd.Series(out)

    return tiles.asNondeterministic()


class Each:
    """What a chunk does tile by tile: ``work(queries, cases)`` anew for each of them."""

    def __init__(self, work: Callable, q: pa.Table):
        self.work, self.q, self.found = work, q, []

    def add(self, c: pa.Table) -> None:
        self.found.extend(self.work(self.q, c))

    def pieces(self) -> Iterator[dict[str, np.ndarray]]:
        yield from self.found


def meet(
    queries: DataFrame, cases: DataFrame, work: Callable | None, schema: str, query_rows: int,
    case_sizes: DataFrame | None = None, cells: Cells | None = None, fold: Callable | None = None,
) -> DataFrame:
    """Run ``work(queries, cases)`` for every tile and chunk of a scope; it takes Arrow tables and
    gives pieces of numpy columns by name.

    In place of ``work``, ``fold(queries)`` begins a chunk: it takes tiles by ``add(cases)``, in any
    order, and gives its ``pieces()`` at the end. A chunk may be begun in several tasks, each with some
    of its tiles.

    ``queries``: query_id, vector and more; ``cases``: case_key, vector and more; both with
    a scope, or both without one, which is one scope. Ids are unique within a scope, which
    keeps the hashed tiles even. ``case_sizes`` (scope, case_bytes) saves measuring the cases
    when the caller has done it. With ``cells`` the cases have a ``cell``. Chunks are larger
    than ``query_rows`` where that leaves every core several of them.
    """
    # Fresh column identities: both sides may be cut from the same table.
    cases = cases.select(*[F.col(c).alias(c) for c in cases.columns])
    whole = F.lit("").alias("scope")
    if "scope" not in queries.columns:
        queries, cases = queries.select("*", whole), cases.select("*", whole)
    if case_sizes is None:
        case_sizes = cases.groupBy("scope").agg(F.sum(row_bytes(cases)).alias("case_bytes"))
    asked = queries.groupBy("scope").agg(F.count(F.lit(1)).alias("n"), F.sum(row_bytes(queries)).alias("query_bytes"))
    asked = small_side(asked)
    cores = queries.sparkSession.sparkContext.defaultParallelism

    def work_rows(counted: DataFrame) -> int:
        return max(query_rows, -(-(counted.agg(F.sum("n")).first()[0] or 0) // (4 * cores)))

    def chunks_of(n: Column, n_bytes: Column, rows: int) -> Column:
        return F.greatest(F.ceil(n / rows), F.ceil(n_bytes / TILE_BYTES)).cast("int")

    tiles = F.ceil(F.col("case_bytes") / TILE_BYTES).cast("int")
    # Tiles are tasks too: a scope of many needs fewer chunks to keep every core busy.
    plan = small_side(asked.join(case_sizes, "scope").select(
        "scope", tiles.alias("tiles"), chunks_of(F.col("n") / F.greatest(tiles, F.lit(1)), F.col("query_bytes"), work_rows(asked)).alias("chunks")))
    fields = to_arrow_schema(T.StructType.fromDDL(schema))

    begin = fold or (lambda q: Each(work, q))

    def run(q: pa.Table, c: pa.Table) -> pa.Table:
        if not (q.num_rows and c.num_rows):
            return fields.empty_table()
        chunk = begin(q)
        chunk.add(c)
        return stack(list(chunk.pieces()), fields)

    stored = None
    if cells is None:
        least, most = plan.agg(F.min("tiles"), F.max("tiles")).first()
        if most is not None and most > 1:
            many = plan.where("tiles > 1")
            stored = _meet_stored(queries.join(many, "scope"), cases.join(many, "scope"), begin, schema)
            if least > 1:
                return stored
            plan = plan.where("tiles <= 1")
    query_bytes = row_bytes(queries)
    queries, cases = queries.join(plan, "scope"), cases.join(plan, "scope")
    dealt = F.pmod(F.xxhash64("case_key"), F.col("tiles")).cast("int")
    visited = F.sequence(F.lit(0), F.col("tiles") - 1)
    if cells is not None:
        spread = _cell_tiles(cases, plan)
        if spread:
            places = [(s, c, int(f), int(t - f + 1)) for s, (first, last) in spread.items()
                      for c, (f, t) in enumerate(zip(first, last)) if f <= t]
            known = queries.sparkSession.createDataFrame(places, "scope string, cell int, first int, span int")
            cases = cases.join(F.broadcast(known), ["scope", "cell"], "left")
            dealt = F.coalesce(F.col("first") + F.pmod(F.xxhash64("case_key"), F.col("span")).cast("int"), F.lit(0))
            visited = _open_tiles(spread, cells)(F.col("scope"), F.col("vector"), F.col(cells.value))
    place = ["scope", "__tile", "__chunk"]
    asking, dealt_cases = queries, cases.withColumn("__tile", dealt)
    cases = cases.withColumn("__tile", dealt)
    queries = queries.withColumn("__bytes", query_bytes).withColumn("__tile", F.explode(visited))
    if cells is not None and spread:
        # A tile is sent once per chunk of the queries that visit it, not per chunk of all.
        visits = small_side(queries.groupBy("scope", "__tile").agg(
            F.count(F.lit(1)).alias("n"), F.sum("__bytes").alias("n_bytes")))
        rows = work_rows(visits)
        rooms = visits.select("scope", "__tile", chunks_of(F.col("n"), F.col("n_bytes"), rows).alias("chunks"))
        # Stored rows are shuffled and written once each; a tile holds about as much as any other of its scope.
        many = plan.where("tiles > 1")
        sent = rooms.join(many.drop("chunks").join(case_sizes, "scope"), "scope").agg(
            F.sum(F.col("chunks") * F.col("case_bytes") / F.col("tiles"))).first()[0] or 0
        sent += visits.join(many.select("scope"), "scope").agg(F.sum("n_bytes")).first()[0] or 0
        once = many.join(case_sizes, "scope").join(asked, "scope").agg(F.sum(F.col("case_bytes") + F.col("query_bytes"))).first()[0] or 0
        if sent > 2 * once:
            by_cell = F.broadcast(many.select("scope"))
            stored = _meet_stored(*(df.join(by_cell, "scope") for df in (asking, dealt_cases)), begin, schema)
            if plan.where("tiles <= 1").isEmpty():
                return stored
            queries, cases = (df.join(by_cell, "scope", "left_anti") for df in (queries, cases))
        queries, cases = (df.drop("chunks").join(rooms, ["scope", "__tile"]) for df in (queries, cases))
    spread_cases = cases.withColumn("__chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop(
        "tiles", "chunks", "first", "span")
    spread_queries = queries.withColumn("__chunk", F.pmod(F.xxhash64("query_id"), F.col("chunks")).cast("int")).drop(
        "tiles", "chunks", "__bytes")
    shuffled = spread_queries.groupBy(*place).cogroup(spread_cases.groupBy(*place)).applyInArrow(run, schema)
    return shuffled if stored is None else shuffled.unionByName(stored)


def _as_bytes(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _as_table(stream: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(stream)).read_all()


def _stored_pieces(rows: DataFrame, place: Column, name: str) -> DataFrame:
    """(scope, piece, ``name``): the rows of a scope dealt into pieces by ``place``, each one stored row in its own file."""
    scope = rows.schema["scope"]
    fields = to_arrow_schema(T.StructType([
        scope, T.StructField("piece", T.IntegerType()), T.StructField(name, T.BinaryType())]))

    def pack(group: tuple, table: pa.Table) -> pa.Table:
        held = [[group[0].as_py()], [group[1].as_py()], [_as_bytes(table.drop_columns(["piece"]))]]
        return pa.table(held, schema=fields)

    dealt = rows.withColumn("piece", place).drop("tiles", "chunks")
    packed = dealt.groupBy("scope", "piece").applyInArrow(
        pack, f"scope {scope.dataType.simpleString()}, piece int, {name} binary")
    # A file each: a row group is written row by row.
    return materialise(packed, name, maxRecordsPerFile=1, compression="snappy")


def _meet_stored(queries: DataFrame, cases: DataFrame, begin: Callable, schema: str) -> DataFrame:
    """Every chunk meets every tile of its scope; both are shuffled and written once and read once per pair.

    Queries have ``chunks`` and cases ``tiles``, which they are dealt into by their ids, or cases a ``__tile``.
    """
    spark, fields = queries.sparkSession, to_arrow_schema(T.StructType.fromDDL(schema))
    tile = F.col("__tile") if "__tile" in cases.columns else F.pmod(F.xxhash64("case_key"), F.col("tiles")).cast("int")
    asked = _stored_pieces(queries, F.pmod(F.xxhash64("query_id"), F.col("chunks")).cast("int"), "asked")
    held = _stored_pieces(cases.select([c for c in cases.columns if c not in ("__tile", "first", "span")] + [tile.alias("__at")]),
                          F.col("__at"), "held").select("scope", "held")
    pairs = asked.hint("shuffle_replicate_nl").join(held, "scope").select("scope", "piece", "asked", "held")
    # One file a partition, and all tiles of a chunk in one task as long as every core has several.
    with settings(spark, {"spark.sql.files.openCostInBytes": str(1 << 40)}):
        rows, chunks = pairs.rdd, asked.rdd.getNumPartitions()
    rows = rows.coalesce(max(1, chunks, min(rows.getNumPartitions(), 3 * spark.sparkContext.defaultParallelism)))

    def met(rows: Iterator) -> Iterator[tuple[bytes]]:
        begun = {}
        for row in rows:
            chunk = begun.get((row["scope"], row["piece"]))
            if chunk is None:
                chunk = begun[row["scope"], row["piece"]] = begin(_as_table(row["asked"]))
            chunk.add(_as_table(row["held"]))
        for chunk in begun.values():
            found = stack(list(chunk.pieces()), fields)
            if found.num_rows:
                yield (_as_bytes(found),)

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for stream in batch.column(0):
                yield from _as_table(stream.as_buffer()).to_batches()

    # Rows of an RDD reach Python by their bytes, an Arrow batch would hold thousands of such pairs.
    found = spark.createDataFrame(rows.mapPartitions(met), "found binary", verifySchema=False)
    return found.mapInArrow(opened, schema)


def _scope_of(df: DataFrame) -> list[str]:
    return ["scope"] if "scope" in df.columns else []


def stack(pieces: list[dict[str, np.ndarray]], fields: pa.Schema) -> pa.Table:
    """Pieces of numpy columns -> one Arrow table."""
    if not pieces:
        return fields.empty_table()
    return pa.Table.from_arrays(
        [pa.array(np.concatenate([p[f.name] for p in pieces]), f.type, from_pandas=True) for f in fields], schema=fields)


def values(table: pa.Table, column: str) -> np.ndarray:
    return table.column(column).combine_chunks().to_numpy(zero_copy_only=False)


def matrix(table: pa.Table, column: str = "vector") -> np.ndarray:
    """Array column -> matrix of double rows; arrays must have one length and no nulls."""
    lists = table.column(column).combine_chunks()
    flat, sizes = lists.flatten(), np.diff(lists.offsets.to_numpy())
    if lists.null_count or flat.null_count or len(set(sizes.tolist())) > 1:
        raise ValueError(f"arrays in {column} are null, hold nulls or differ in length")
    return flat.to_numpy().astype("float64").reshape(len(lists), -1 if len(flat) else 0)


def unit_matrix(table: pa.Table, column: str = "vector") -> np.ndarray:
    m = matrix(table, column)
    m /= np.maximum(np.sqrt((m * m).sum(axis=1, keepdims=True)), 1e-12)
    return m


def _products(
    q: pa.Table, c: pa.Table, unit: np.ndarray, cells: Cells | None, block_rows: int, query_rows: int,
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of queries and of cases that meet in one product; cells that a query opens, if any.

    Case numbers ascend inside a product.
    """
    groups = [(np.arange(len(unit)), np.arange(c.num_rows))]
    if cells is not None:
        home = values(c, "cell")
        here, at = np.unique(home, return_inverse=True)
        wanted = cells.opened(unit, values(q, cells.value), here)
        order = np.argsort(at, kind="stable")
        ends = np.searchsorted(at[order], np.arange(len(here) + 1))
        groups = ((np.flatnonzero(wanted[:, i]), order[ends[i]:ends[i + 1]]) for i in range(len(here)))
    for rows, cols in groups:
        for right in range(0, len(cols), block_rows):
            some = cols[right:right + block_rows]
            # The score matrix stays small whatever the block sizes are.
            step = min(query_rows, max(1, 4_000_000 // len(some)))
            for left in range(0, len(rows), step):
                yield rows[left:left + step], some


def _slack(dims: int) -> float:
    """More than a product of unit rows of single precision is off."""
    return 1e-6 + dims * 2.4e-7


def _at_least(scores: np.ndarray, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the scores at the floor of their row or above; numpy finds them fastest in a flat array."""
    return np.divmod(np.flatnonzero(scores >= floor[:, None]), max(1, scores.shape[1]))


def _above(
    left: np.ndarray, right: np.ndarray, left32: np.ndarray, right32: np.ndarray, floor: np.ndarray,
) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(row, column, similarity) of the pairs at ``floor`` or above; None when these are many.

    Single precision rules out most pairs, the rest is computed in double. Twelve places: equal
    vectors tie whatever product they were in.
    """
    r, col = _at_least(left32 @ right32.T, (floor - _slack(left.shape[1])).astype("float32"))
    if len(r) * max(1, left.shape[1]) > 4_000_000:
        return None
    exact = np.round(np.einsum("ij,ij->i", left[r], right[col]), 12)
    keep = exact >= floor[r]
    return r[keep], col[keep], exact[keep]


def best_k(scores: np.ndarray, keys: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of the k best columns per row; ties go to the smaller key.

    Columns come in key order, so a stable sort on the score settles ties.
    """
    rows, cols = scores.shape
    if cols > 4 * k:
        # Keep every column that is at least as good as the k-th best, then sort those few.
        floor = np.partition(scores, cols - k, axis=1)[:, cols - k]
        r, c = np.nonzero(scores >= floor[:, None])
    else:
        r, c = np.indices(scores.shape).reshape(2, -1)
    order = np.lexsort((keys[c], -scores[r, c], r))
    r, c = r[order], c[order]
    rank = np.arange(len(r)) - np.searchsorted(r, r)
    keep = rank < k
    return r[keep], c[keep]


def top_k(
    n_rows: int, products: Iterator[tuple[np.ndarray, np.ndarray]], left: np.ndarray, right: np.ndarray, k: int,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and similarities of the k best columns per row over all products; ties go to
    the smaller column."""
    none = np.iinfo("int64").max
    held, cols = np.full((n_rows, k), -np.inf), np.full((n_rows, k), none)
    left32, right32 = left.astype("float32"), right.astype("float32")
    for rows, some in products:
        floor, a, b = held[rows, -1], left[rows], right[some]
        found = None
        if not np.isneginf(floor).any():
            found = _above(a, b, left32[rows], right32[some], floor)
        if found is None:
            scores = np.round(a @ b.T, 12)
            r, c = best_k(scores, some, k)
            found = r, c, scores[r, c]
        r, c, score = found
        c = some[c]
        better = (score > floor[r]) | ((score == floor[r]) & (c < cols[rows[r], -1]))
        r, c, score = r[better], c[better], score[better]
        if not len(r):
            continue
        old = np.unique(r)
        r = np.concatenate([np.repeat(old, k), r])
        c = np.concatenate([cols[rows[old]].ravel(), c])
        score = np.concatenate([held[rows[old]].ravel(), score])
        order = np.lexsort((c, -score, r))
        r, c, score = r[order], c[order], score[order]
        rank = np.arange(len(r)) - np.searchsorted(r, r)
        keep = rank < k
        held[rows[r[keep]], rank[keep]], cols[rows[r[keep]], rank[keep]] = score[keep], c[keep]
    row, place = np.nonzero(cols != none)
    return row, cols[row, place], held[row, place]


def _kth(row: np.ndarray, score: np.ndarray, k: int, n_rows: int) -> np.ndarray:
    """The k-th score per row of rows sorted by (row, falling score); minus infinity where there are fewer."""
    out, first = np.full(n_rows, -np.inf), np.searchsorted(row, np.arange(n_rows + 1))
    full = np.flatnonzero(np.diff(first) >= k)
    out[full] = score[first[full] + k - 1]
    return out


def top_k_of_tile(
    left: np.ndarray, left32: np.ndarray, right: np.ndarray, k: int, floor: np.ndarray, block_rows: int, query_rows: int,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and similarities of the k best columns per row, of those at ``floor`` or above;
    ties go to the smaller column.

    Products of single precision, ``block_rows`` by ``query_rows`` or as much of these as a core's cache
    holds, pick candidates; these are kept in a pool. When it has grown to several times what can stay,
    the similarities of those that single precision leaves are computed in double, the k best per row
    stay, and the last of them is the new floor of the row.
    """
    n, m, right32, slack = len(left), len(right), right.astype("float32"), _slack(left.shape[1])
    wide, step = max(1, min(block_rows, m, PRODUCT[1])), min(query_rows, PRODUCT[0])
    low = floor - slack
    ask = np.flatnonzero(np.isneginf(floor))
    some = min(m, max(1024, 4 * k))
    if m >= k:  # the k-th best of some columns bounds the k-th best of all
        for at in range(0, len(ask), max(1, 4_000_000 // some)):
            rows = ask[at:at + max(1, 4_000_000 // some)]
            low[rows] = np.partition(left32[rows] @ right32[:some].T, some - k, axis=1)[:, some - k] - 2 * slack
    # Rounding to single precision must not lift a bound.
    low32 = (low - 1e-7).astype("float32")
    held = np.empty(0, dtype="int64"), np.empty(0, dtype="int64"), np.empty(0)
    new, count, room = [], 0, 500_000 + 2 * n * k
    scores_of, mask_of = np.empty(step * wide, dtype="float32"), np.empty(step * wide, dtype=bool)

    def settle() -> None:
        """The pool cut to k per row."""
        nonlocal held, new, count, low32
        r, c, near = (np.concatenate(parts) for parts in zip(*new))
        order = np.lexsort((-near, r))
        r, c, near = r[order], c[order], near[order]
        low32 = np.maximum(low32, (_kth(r, near, k, n) - 2 * slack - 1e-7).astype("float32"))
        keep = near >= low32[r]
        r, c = r[keep], c[keep]
        score = np.empty(len(r))
        for at in range(0, len(r), 65_536):
            here = slice(at, at + 65_536)
            score[here] = np.einsum("ij,ij->i", left[r[here]], right[c[here]])
        score = np.round(score, 12)
        keep = score >= floor[r]
        r, c, score = (np.concatenate(pair) for pair in zip(held, (r[keep], c[keep], score[keep])))
        order = np.lexsort((c, -score, r))
        r, c, score = r[order], c[order], score[order]
        keep = np.arange(len(r)) - np.searchsorted(r, r) < k
        held = r[keep], c[keep], score[keep]
        low32 = np.maximum(low32, (_kth(*held[::2], k, n) - slack - 1e-7).astype("float32"))
        new, count = [], 0

    for right_at in range(0, m, wide):
        cols = right32[right_at:right_at + wide].T
        width = cols.shape[1]
        for left_at in range(0, n, step):
            rows = left32[left_at:left_at + step]
            size = len(rows) * width
            scores = np.matmul(rows, cols, out=scores_of[:size].reshape(-1, width))
            np.greater_equal(scores, low32[left_at:left_at + step, None], out=mask_of[:size].reshape(-1, width))
            at = mask_of[:size].nonzero()[0]
            if not len(at):
                continue
            if len(at) > size // 16 and len(at) > 2 * k * len(rows):  # many that tie: only the k best of each row
                exact = np.round(left[left_at:left_at + step] @ right[right_at:right_at + wide].T, 12)
                r, c = best_k(exact, np.arange(width), k)
                near = exact[r, c].astype("float32")
            else:
                r, c, near = at // width, at % width, scores_of[at]
            new.append((r + left_at, c + right_at, near))
            count += len(r)
            if count > room:
                settle()
    if new:
        settle()
    return held


class Best:
    """The k best cases per query of a chunk, over the tiles added so far; ties go to the smaller key.

    ``floor`` is the k-th best score per query: what a further tile must reach.
    """

    def __init__(self, q: pa.Table, k: int, score: str, carry: tuple[str, ...] = ()):
        self.query_ids, self.k, self.score, self.columns = values(q, "query_id"), k, score, ("case_key", *carry)
        self.best, self.floor = None, np.full(q.num_rows, -np.inf)

    def merge(self, c: pa.Table, row: np.ndarray, col: np.ndarray, score: np.ndarray) -> None:
        """Take in what was found in a tile: rows of queries and of cases, sorted by query and falling score."""
        found = {name: c.column(name).combine_chunks().take(pa.array(col)) for name in self.columns}
        found = pa.table({"row": row.astype("int64"), self.score: score, **found})
        if self.best is not None:
            found = pa.concat_tables([self.best, found])
            row, score = values(found, "row"), values(found, self.score)
            order = np.lexsort((-score, row))
            rows, scores = row[order], score[order]
            if ((rows[1:] == rows[:-1]) & (scores[1:] == scores[:-1])).any():
                order = pc.sort_indices(found, [("row", "ascending"), (self.score, "descending"), ("case_key", "ascending")]).to_numpy()
                rows = row[order]
            found = found.take(pa.array(order[np.arange(len(rows)) - np.searchsorted(rows, rows) < self.k]))
        self.best = found.combine_chunks()
        self.floor = _kth(values(found, "row"), values(found, self.score), self.k, len(self.floor))

    def pieces(self) -> Iterator[dict[str, np.ndarray]]:
        if self.best is not None:
            yield {"query_id": self.query_ids[values(self.best, "row")],
                   **{name: values(self.best, name) for name in (self.score, *self.columns)}}


class _TopK(Best):
    """The most similar cases."""

    def __init__(self, q: pa.Table, k: int, block_rows: int, query_rows: int, carry: tuple[str, ...], cells: Cells | None):
        super().__init__(q, k, "similarity", carry)
        self.q, self.sizes, self.cells, self.left = q, (block_rows, query_rows), cells, unit_matrix(q)
        self.left32 = self.left.astype("float32")

    def add(self, c: pa.Table) -> None:
        c = c.take(pa.array(np.argsort(values(c, "case_key"), kind="stable")))
        right = unit_matrix(c)
        if self.cells is None:
            found = top_k_of_tile(self.left, self.left32, right, self.k, self.floor, *self.sizes)
        else:
            products = _products(self.q, c, self.left, self.cells, *self.sizes)
            found = top_k(len(self.left), products, self.left, right, self.k)
        self.merge(c, *found)


def top_k_pairs(
    queries: DataFrame, cases: DataFrame, k: int, block_rows: int, query_rows: int,
    carry: tuple[str, ...] = (), case_sizes: DataFrame | None = None, cells: Cells | None = None,
) -> DataFrame:
    """(query_id, case_key, similarity): the k most similar cases per query and task.

    The caller cuts to k per query; the tiles of a chunk are few tasks, or one.
    ``carry`` names short text columns of the cases to hand through.
    """
    qtype = queries.schema["query_id"].dataType.simpleString()
    schema = ", ".join([f"query_id {qtype}, case_key string, similarity double", *[f"{c} string" for c in carry]])
    return meet(
        queries.select("query_id", *_scope_of(queries), "vector", *_value(cells)),
        cases.select("case_key", *_scope_of(cases), "vector", *carry, *_cell(cells)),
        None, schema, query_rows, case_sizes, cells, lambda q: _TopK(q, k, block_rows, query_rows, carry, cells))


def _value(cells: Cells | None) -> list[str]:
    return [cells.value] if cells else []


def _cell(cells: Cells | None) -> list[str]:
    return ["cell"] if cells else []


def linked(
    queries: DataFrame, cases: DataFrame, threshold: float, block_rows: int, query_rows: int
) -> DataFrame:
    """(a, b): ids of one table on both sides, joined as similarities of ``threshold`` or more join them.

    Each pair of blocks gives one star per group that hangs together in it, from the least
    id, so at most one row per id leaves a task.
    """
    kind = queries.schema["query_id"].dataType.simpleString()
    schema = f"a {kind}, b {kind}"

    def stars(query_ids: np.ndarray, case_ids: np.ndarray, near: np.ndarray) -> Iterator[dict[str, np.ndarray]]:
        ids, place = np.unique(np.concatenate([query_ids, case_ids]), return_inverse=True)
        rows, cols = place[: len(query_ids)], place[len(query_ids):]
        joined = np.zeros((len(ids), len(ids)), dtype=bool)
        joined[np.ix_(rows, cols)] = near
        joined |= joined.T
        new = np.ones(len(ids), dtype=bool)
        for start in range(len(ids)):
            if not new[start]:
                continue
            new[start], edge = False, np.array([start])
            while len(edge):
                edge = np.flatnonzero(joined[edge].any(axis=0) & new)
                new[edge] = False
                yield {"a": ids[np.full(len(edge), start)], "b": ids[edge]}

    def work(q: pa.Table, c: pa.Table) -> Iterator[dict[str, np.ndarray]]:
        left, right = unit_matrix(q), unit_matrix(c)
        query_ids, case_ids = values(q, "query_id"), values(c, "case_key")
        for rows, cols in _products(q, c, left, None, block_rows, query_rows):
            near = np.round(left[rows] @ right[cols].T, 12) >= threshold
            yield from stars(query_ids[rows], case_ids[cols], near)

    return meet(queries, cases, work, schema, query_rows)


def any_above(
    queries: DataFrame, cases: DataFrame, threshold: float, block_rows: int, query_rows: int,
    cells: Cells | None = None,
) -> DataFrame:
    """Distinct query_ids with a more similar case (strictly above) that came earlier.

    Both sides carry ``seq``; a case counts when its seq is lower than the query's.
    """
    qtype = queries.schema["query_id"].dataType.simpleString()
    found = meet(
        queries.select("query_id", *_scope_of(queries), "vector", "seq", *_value(cells)),
        cases.select("case_key", *_scope_of(cases), "vector", "seq", *_cell(cells)),
        None, f"query_id {qtype}", query_rows, cells=cells,
        fold=lambda q: _AnyAbove(q, threshold, block_rows, query_rows, cells))
    return found.distinct()


class _AnyAbove:
    """The queries of a chunk that found a more similar, earlier case in the tiles added so far."""

    def __init__(self, q: pa.Table, threshold: float, block_rows: int, query_rows: int, cells: Cells | None):
        self.q, self.threshold, self.sizes, self.cells = q, threshold, (block_rows, query_rows), cells
        self.left, self.seq, self.hit = unit_matrix(q), values(q, "seq"), np.zeros(q.num_rows, dtype=bool)
        self.left32 = self.left.astype("float32")

    def add(self, c: pa.Table) -> None:
        left, right, threshold, hit = self.left, unit_matrix(c), self.threshold, self.hit
        right32, c_seq = right.astype("float32"), values(c, "seq")
        for rows, cols in _products(self.q, c, left, self.cells, *self.sizes):
            rows = rows[~hit[rows]]
            a, b = left[rows], right[cols]
            found = _above(a, b, self.left32[rows], right32[cols], np.full(len(rows), threshold))
            if found is None:
                scores = np.round(a @ b.T, 12)
                found = *np.nonzero(scores > threshold), scores[scores > threshold]
            r, col, score = found
            r, col = r[score > threshold], col[score > threshold]
            hit[rows[r[c_seq[cols[col]] < self.seq[rows[r]]]]] = True

    def pieces(self) -> Iterator[dict[str, np.ndarray]]:
        yield {"query_id": values(self.q, "query_id")[self.hit]}
