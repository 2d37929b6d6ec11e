"""Repeated multi-line passages: content-defined chunks of lines, and the lines around them.

A rolling hash over the hashes of ``WINDOW`` neighbouring lines chooses where a chunk ends, so
lines put in at the top of a text change no boundary further down. Chunks whose digest occurs
again are the seeds: all but the earliest go, after their bytes were compared. A passage
shares no boundary with its surroundings, so its first and last lines stand in chunks that do
not repeat, and a short passage may hold no chunk at all. All that no seed covers is therefore
looked at again in its smallest chunks, every ``min_lines`` lines in a row: a seed grows by
those that overlap its ends, and what is left of passages without a seed is found by the same.

Digests move first (16 bytes a chunk); bytes only for chunks whose digest repeats. The
counts are grouped sums with partial sums, so a chunk that a third of all texts share is one
row per task. Repeated digests are a stored table, so that their joins are between plain tables,
which AQE splits; the bytes of a frequent chunk meet its earliest ones under several salts.
Columns and joins only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketloom.llm.common import join_keys, keyed, materialise, read, same_key

MIN_LINES = 2
#: Lines that the rolling hash sees at once, and lines of a chunk on average.
WINDOW, CHUNK_LINES = 2, 4
#: Rows of one repeated chunk that meet its earliest bytes in one task.
SALT_ROWS = 2048


def _with(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once a row, not once for each element below."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _lines() -> Column:
    return F.split("text", "\n")


def _body(lines: Column, chunk: Column, n_lines: Column) -> Column:
    return F.array_join(F.slice(lines, chunk + 1, n_lines), "\n")


def _rolling(hashes: Column, last: Column) -> Column:
    """Cyclic polynomial of the ``WINDOW`` line hashes that end at ``last``."""
    def rotated(value: Column, by: int) -> Column:
        return F.shiftleft(value, by).bitwiseOR(F.shiftrightunsigned(value, 64 - by)) if by else value

    out = F.get(hashes, last)
    for by in range(1, WINDOW):
        out = out.bitwiseXOR(rotated(F.get(hashes, last - by), by))
    return out


def line_chunks(docs: DataFrame, min_lines: int) -> DataFrame:
    """id, hash, chunk (first line), n_lines, digest, small: the content-defined chunks of each text.

    ``small`` are the runs of ``min_lines`` lines (chunk, n_lines, digest, inner) that begin in the
    chunk; ``inner`` ones end in it too. Chunks of fewer lines have no digest. Blank lines are
    layout: they do not count, but those between the lines of a chunk are part of it.
    """
    def chunks(lines: Column) -> Column:
        filled = F.filter(
            F.sequence(F.lit(0), F.size(lines) - 1), lambda i: F.get(lines, i).rlike(r"[^\x20\x09-\x0D]")
        )
        return _with(filled, lambda at: F.when(F.size(at) > 0, _with(
            F.transform(at, lambda i: F.xxhash64(F.get(lines, i))), lambda hashes: cut(lines, at, hashes))))

    def cut(lines: Column, at: Column, hashes: Column) -> Column:
        last = F.size(at) - 1
        ends = F.filter(F.sequence(F.lit(0), last), lambda k: (k == last) | (
            (k >= WINDOW - 1) & (F.pmod(_rolling(hashes, k), F.lit(CHUNK_LINES)) == 0)))
        return _with(ends, lambda ends: F.transform(
            ends, lambda end, j: chunk(lines, at, F.when(j > 0, F.get(ends, j - 1) + 1).otherwise(0), end)))

    def chunk(lines: Column, at: Column, first: Column, end: Column) -> Column:
        begins = F.filter(F.sequence(first, end), lambda k: k + (min_lines - 1) < F.size(at))
        return F.struct(
            *body(lines, at, first, end, end - first + 1 >= min_lines),
            F.transform(begins, lambda k: F.struct(
                *body(lines, at, k, k + (min_lines - 1), F.lit(True)), (k + (min_lines - 1) <= end).alias("inner"),
            )).alias("small"))

    def body(lines: Column, at: Column, first: Column, end: Column, counts: Column) -> list[Column]:
        start, n_lines = F.get(at, first), F.get(at, end) - F.get(at, first) + 1
        digest = F.when(counts, F.unhex(F.md5(_body(lines, start, n_lines).cast("binary"))))
        return [start.alias("chunk"), n_lines.alias("n_lines"), digest.alias("digest")]

    opened = docs.filter(F.col("text").isNotNull()).select("id", "hash", F.explode(_with(_lines(), chunks)).alias("c"))
    return opened.select("id", "hash", "c.*")


def _repeated(chunks: DataFrame, label: str) -> DataFrame:
    """Stored digest, first (earliest place) and salts of the digests that occur again."""
    counted = chunks.filter(F.col("digest").isNotNull()).groupBy("digest").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "chunk", "hash")).alias("first")).filter("n > 1")
    return materialise(counted.withColumn("salts", F.ceil(F.col("n") / SALT_ROWS).cast("int")).drop("n"), label)


def _earliest() -> Column:
    return F.struct("id", "chunk", "hash").eqNullSafe(F.col("first"))


def _numbers(runs: Column) -> Column:
    """Numbers of the lines in an array of (line, n_lines)."""
    return F.flatten(F.transform(runs, lambda r: F.sequence(r["line"], r["line"] + r["n_lines"] - 1)))


def _joined(runs: Column) -> Column:
    """Overlapping and touching (line, n_lines) as longest runs, in order."""
    return _with(_numbers(runs), lambda at: F.zip_with(
        F.sort_array(F.array_except(at, F.transform(at, lambda i: i + 1))),
        F.sort_array(F.array_except(at, F.transform(at, lambda i: i - 1))),
        lambda first, last: F.struct(first.alias("line"), (last - first + 1).alias("n_lines")),
    ))


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = MIN_LINES,
) -> DataFrame:
    """id, text without repeated passages, n_lines, n_removed and removed of every row.

    ``removed`` lists (line, n_lines) of what was taken out as longest runs, lines counted
    from 0 in the original text. Of equal chunks the earliest by id (null first), then line,
    stays, and so do the smallest ones that overlap it; the earliest occurrence of a line is never taken
    out. Passages below ``min_lines`` lines are left alone, blank lines not counted. A null
    text stays null and has no lines; an empty text is one empty line. Repeated rows (same id
    and text) are one document and keep the same lines. Further columns are ignored; an
    empty table gives an empty result.
    """
    docs = keyed(docs, id_col, text_col)
    chunks = materialise(line_chunks(docs, min_lines), "line-chunks")
    # The earliest place of a chunk in another text of the same id is left to the small chunks.
    elsewhere = ~F.col("id").eqNullSafe(F.col("first.id")) | (F.col("hash") == F.col("first.hash"))
    seeds = materialise(
        chunks.join(_repeated(chunks, "repeated-chunks"), "digest", "left").withColumn("earliest", _earliest())
        .withColumn("later", F.col("first").isNotNull() & ~F.col("earliest") & elsewhere), "seed-chunks")
    small = seeds.select("id", "hash", "later", F.explode("small").alias("c")).filter(~F.col("later") | ~F.col("c.inner"))
    small = small.select("id", "hash", "c.chunk", "c.n_lines", "c.digest")
    mine = small.join(_repeated(small, "repeated-small-chunks"), "digest").withColumn("earliest", _earliest())
    overlaps = (
        F.col("id").eqNullSafe(F.col("first.id")) & (F.col("hash") == F.col("first.hash"))
        & (F.col("chunk") < F.col("first.chunk") + F.col("n_lines"))
    )
    columns = ["id", "hash", "chunk", "n_lines", "digest", "earliest", "salts"]
    repeats = seeds.filter("earliest OR later").select(columns).unionByName(
        mine.filter(F.col("earliest") | ~overlaps).select(columns))
    found = repeats.groupBy("id", "hash").agg(
        F.collect_set(F.struct("chunk", "n_lines", "digest", "earliest", "salts")).alias("found")
    )
    known = docs.join(join_keys(found), same_key(), "left").select("id", "hash", "text", "found")
    with_bodies = _with(_lines(), lambda lines: F.transform("found", lambda c: F.struct(
        c["chunk"].alias("chunk"), c["n_lines"].alias("n_lines"), c["digest"].alias("digest"),
        c["earliest"].alias("earliest"), c["salts"].alias("salts"), _body(lines, c["chunk"], c["n_lines"]).alias("body"),
    )))
    bodies = known.filter(F.col("found").isNotNull()).select("id", "hash", F.explode(with_bodies).alias("c"))
    bodies = bodies.select("id", "hash", "c.*")
    kept = bodies.filter("earliest").groupBy("digest").agg(F.min("body").alias("kept_body"), F.max("salts").alias("salts"))
    kept = kept.select("digest", "kept_body", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    salted = bodies.filter(~F.col("earliest")).withColumn(
        "salt", F.pmod(F.xxhash64("id", "hash", "chunk"), F.col("salts")).cast("int"))
    equal = salted.join(kept, ["digest", "salt"]).filter(
        F.col("body").cast("binary") == F.col("kept_body").cast("binary")
    )
    removed = equal.groupBy("id", "hash").agg(
        F.collect_set(F.struct(F.col("chunk").alias("line"), "n_lines")).alias("removed")
    ).withColumn("removed", _joined(F.col("removed")))
    nothing = F.array().cast("array<struct<line:int,n_lines:int>>")
    out = known.join(join_keys(removed), same_key(), "left").select(
        "id", "text", F.coalesce("removed", nothing).alias("removed"),
        F.coalesce(F.size(_lines()), F.lit(0)).alias("n_lines"),
    )
    left = F.array_except(F.sequence(F.lit(0), F.col("n_lines") - 1), _numbers(F.col("removed")))
    rest = _with(_lines(), lambda lines: F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n"))
    return out.select(
        F.col("id").alias(id_col),
        F.when(F.size("removed") == 0, F.col("text")).otherwise(rest).alias(text_col),
        F.when(F.col("text").isNull(), 0).otherwise(F.col("n_lines")).alias("n_lines"),
        F.aggregate("removed", F.lit(0), lambda a, r: a + r["n_lines"]).alias("n_removed"), "removed",
    )


def op5_line_dedup(spark, sf_dir: str) -> DataFrame:
    """``removed`` as text: first line+number of lines of each run that went, by commas."""
    runs = F.transform("removed", lambda r: F.concat(r["line"].cast("string"), F.lit("+"), r["n_lines"].cast("string")))
    return dedup_lines(read(spark, sf_dir, "documents")).withColumn("removed", F.array_join(runs, ","))


#: By the plain rule: every two filled lines in a row that an earlier place has go.
OP5_SQL = r"""
WITH texts AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
opened AS (SELECT doc_id, unnest(lines) AS body, generate_subscripts(lines, 1) - 1 AS line FROM texts WHERE text IS NOT NULL),
filled AS (
  SELECT doc_id, line, lead(line) OVER (PARTITION BY doc_id ORDER BY line) AS next FROM opened
  WHERE regexp_matches(body, '[^\x20\x09-\x0D]')),
pairs AS (
  SELECT f.doc_id, f.line, f.next, array_to_string(t.lines[f.line + 1 : f.next + 1], chr(10)) AS body
  FROM filled f JOIN texts t USING (doc_id) WHERE f.next IS NOT NULL),
placed AS (
  SELECT doc_id, line, next, first_value(doc_id) OVER w AS first_id, first_value(line) OVER w AS first_line
  FROM pairs WINDOW w AS (PARTITION BY body ORDER BY doc_id, line)),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(line, next + 1)) AS line FROM placed
  WHERE doc_id <> first_id OR line > first_line + next - line),
runs AS (
  SELECT doc_id, min(line) AS line, count(*) AS n
  FROM (SELECT doc_id, line, line - row_number() OVER (PARTITION BY doc_id ORDER BY line) AS run FROM gone)
  GROUP BY doc_id, run),
cut AS (SELECT doc_id, sum(n) AS n, string_agg(line || '+' || n, ',' ORDER BY line) AS removed FROM runs GROUP BY doc_id),
rest AS (
  SELECT o.doc_id, string_agg(o.body, chr(10) ORDER BY o.line) AS text
  FROM opened o ANTI JOIN gone g ON o.doc_id = g.doc_id AND o.line = g.line GROUP BY o.doc_id)
SELECT t.doc_id, CASE WHEN t.text IS NULL THEN NULL ELSE coalesce(r.text, '') END AS text,
  CAST(coalesce(len(t.lines), 0) AS INTEGER) AS n_lines, CAST(coalesce(c.n, 0) AS INTEGER) AS n_removed, coalesce(c.removed, '') AS removed
FROM texts t LEFT JOIN cut c USING (doc_id) LEFT JOIN rest r USING (doc_id)
"""
