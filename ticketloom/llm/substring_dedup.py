"""Repeated passages: hashed units, earliest occurrence kept, offsets retained.

A unit - a line, a paragraph or a sentence - is normalised (lower case, runs of blanks as one,
none at the ends) and hashed; digests are grouped over all texts with partial aggregation, so
a unit that a third of all texts share is one row per task. Only digests and places move
before the decisions, and digests that occur again are a stored table, so that joins with a
frequent one are between plain tables, which AQE splits.

``dedup_passages`` takes out what repeats an earlier document for some length: neighbouring
sentences that all occur in earlier documents are a run; its ends are grown word by word into
the sentences beside it, as far as they go on like the earlier text, since a passage put into
another text shares its first and last sentence with it. ``dedup_units`` takes out every
single unit that repeats.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketloom.llm.common import WORD, join_keys, keyed, materialise, read, same_key

#: Shorter units are set phrases rather than passages.
MIN_WORDS = 8
#: Words of a passage.
PASSAGE_WORDS = 51
#: A sentence ends behind a line end, behind . ! ? before a blank, and behind their full-width forms.
SENTENCE_END = re.compile(r"(?<=\n)|(?<=[.!?])(?=[\x20\x09-\x0D])|(?<=[\u3002\uFF01\uFF1F])")
_WORDS = re.compile(WORD)
SPAN = "array<struct<start:long,length:long>>"


def normalised(unit: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(unit), r"[\x20\x09-\x0D]+", " "))


def unit_table(docs: DataFrame, separator: str, min_words: int) -> DataFrame:
    """id, hash, unit, digest of the units of ``min_words`` words or more."""
    opened = docs.select("id", "hash", F.posexplode(F.split("text", separator)).alias("unit", "body"))
    return opened.filter(F.regexp_count("body", F.lit(WORD)) >= min_words).select(
        "id", "hash", "unit", F.unhex(F.md5(normalised(F.col("body")).cast("binary"))).alias("digest")
    )


def dedup_units(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", separator: str = "\n",
    min_words: int = MIN_WORDS,
) -> DataFrame:
    """id, text without repeated units, kept_spans, removed_spans and n_removed of every row.

    Spans are (start, length) in code points of the original text; the new text is the kept
    spans joined by the separator (a literal without special meaning in patterns). The
    earliest occurrence by id (null first), then place in the text, stays. Units below
    ``min_words`` words always stay. A null text stays null without spans; an empty text is
    one empty span. Repeated rows (same id and text) are one document and keep the same
    units. Further columns are ignored; an empty table gives an empty result.
    """
    docs = keyed(docs, id_col, text_col)
    units = materialise(unit_table(docs, separator, min_words), "units")
    place = F.struct("id", "unit", "hash")
    repeated = materialise(units.groupBy("digest").agg(
        F.count(F.lit(1)).alias("n"), F.min(place).alias("first")
    ).filter("n > 1").drop("n"), "repeated-units")
    gone = units.join(repeated, "digest").filter(~place.eqNullSafe(F.col("first")))
    gone = gone.groupBy("id", "hash").agg(F.sort_array(F.collect_set("unit")).alias("gone"))
    out = docs.join(join_keys(gone), same_key(), "left").select("id", "text", "gone")
    span = "array<struct<start:long,length:long>>"
    kind = docs.schema["id"].dataType.simpleString()
    schema = f"id {kind}, text string, kept_spans {span}, removed_spans {span}, n_removed int"
    rebuilt = out.mapInArrow(lambda batches: _rebuild(batches, separator), schema)
    return rebuilt.withColumnsRenamed({"id": id_col, "text": text_col})


def _rebuild(batches, separator: str):
    """Take the units in ``gone`` out of each text; one pass over its units."""
    span = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
    for batch in batches:
        texts, kept, removed, counts = [], [], [], []
        for text, gone in zip(batch.column("text").to_pylist(), batch.column("gone").to_pylist()):
            spans, left, taken, start = [], [], [], 0
            drop = set(gone or ())
            for i, unit in enumerate([] if text is None else text.split(separator)):
                at = {"start": start, "length": len(unit)}
                start += len(unit) + len(separator)
                if i in drop:
                    taken.append(at)
                else:
                    spans.append(at)
                    left.append(unit)
            texts.append(separator.join(left) if drop else text)
            kept.append(spans)
            removed.append(taken)
            counts.append(len(taken))
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array(texts, pa.string()), pa.array(kept, span), pa.array(removed, span),
             pa.array(counts, pa.int32())],
            names=["id", "text", "kept_spans", "removed_spans", "n_removed"],
        )


def sentences(text: str | None) -> list[tuple[int, int, list[bytes]]]:
    """start, end and normalised words of the sentences of a text that have words; blanks between
    sentences belong to one of them."""
    out, at = [], 0
    for piece in SENTENCE_END.split(text or ""):
        # On bytes, split() knows the ASCII blanks alone.
        if words := piece.lower().encode("utf-8", "surrogatepass").split():
            out.append((at, at + len(piece), words))
        at += len(piece)
    return out


def _digest(words: list[bytes]) -> int:
    return xxhash.xxh64_intdigest(b" ".join(words))


def sentence_prints(docs: DataFrame) -> DataFrame:
    """id, hash, digests, words: of the sentences of each text, in order."""
    kind = docs.schema["id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, words, starts = [], [], [0]
            for text in batch.column("text"):
                own = [w for _, _, w in sentences(text.as_py())]
                digests += map(_digest, own)
                words += map(len, own)
                starts.append(len(words))
            starts = pa.array(starts, pa.int32())
            digests = pa.array(np.array(digests, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("hash"), pa.ListArray.from_arrays(starts, digests),
                 pa.ListArray.from_arrays(starts, pa.array(words, pa.int32()))], names=["id", "hash", "digests", "words"])

    return docs.mapInArrow(work, f"id {kind}, hash long, digests array<long>, words array<int>")


def _neighbouring(units: list[int]) -> Iterator[tuple[int, int]]:
    """First and last of each stretch of consecutive numbers, for sorted numbers."""
    edges = [i for i in range(1, len(units)) if units[i] != units[i - 1] + 1]
    yield from ((units[a], units[b - 1]) for a, b in zip([0, *edges], [*edges, len(units)]) if b > a)


def _runs(found: DataFrame, min_words: int) -> DataFrame:
    """id, hash, first, last, left, right: runs of repeated sentences that can reach ``min_words``.

    ``left`` and ``right`` are the earliest places (id, unit, hash) of the run's outer sentences.
    A run can grow by all of the sentence before it and all of the one behind it.
    """
    place = found.schema["found"].dataType.elementType["place"].dataType
    schema = f"id {place['id'].dataType.simpleString()}, hash long, first int, last int, left {place.simpleString()}, right {place.simpleString()}"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes = batch.column("id").to_pylist(), batch.column("hash").to_pylist()
            rows = []
            for n, (words, own) in enumerate(zip(batch.column("words").to_pylist(), batch.column("found").to_pylist())):
                places = {f["unit"]: f["place"] for f in own}
                for a, b in _neighbouring(sorted(places)):
                    if sum(words[max(a - 1, 0):b + 2]) >= min_words:
                        rows.append((n, a, b, places[a], places[b]))
            at, first, last, left, right = zip(*rows) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(at, pa.int64())), pa.array([hashes[n] for n in at], pa.int64()), pa.array(first, pa.int32()),
                 pa.array(last, pa.int32()), *(pa.array(p, batch.column("found").type.value_type.field("place").type) for p in (left, right))],
                names=["id", "hash", "first", "last", "left", "right"])

    return found.mapInArrow(work, schema)


def _contexts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """id, hash, unit, side, own, beside: the asked-for sentences, and those before (side -1) or
    behind (side 1) them."""
    kind = docs.schema["id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for n, (text, asked) in enumerate(zip(batch.column("text").to_pylist(), batch.column("asked").to_pylist())):
                words = [w for _, _, w in sentences(text)]
                for a in asked:
                    beside = a["unit"] + a["side"]
                    rows.append((n, a["unit"], a["side"], b" ".join(words[a["unit"]]),
                                 b" ".join(words[beside]) if 0 <= beside < len(words) else b""))
            at, unit, side, own, near = zip(*rows) if rows else ((),) * 5
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(at), batch.column("hash").take(at), pa.array(unit, pa.int32()), pa.array(side, pa.int32()),
                 pa.array(own, pa.binary()), pa.array(near, pa.binary())], names=["id", "hash", "unit", "side", "own", "beside"])

    asked = wanted.groupBy("id", "hash").agg(F.collect_set(F.struct("unit", "side")).alias("asked"))
    found = docs.join(join_keys(asked), same_key()).select("id", "hash", "text", "asked")
    out = found.mapInArrow(work, f"id {kind}, hash long, unit int, side int, own binary, beside binary")
    return out.dropDuplicates(["id", "hash", "unit", "side"])


def _with_context(runs: DataFrame, contexts: DataFrame, edge: str, side: int) -> DataFrame:
    near = contexts.filter(F.col("side") == side).select(
        F.col("id").alias("_id"), F.col("hash").alias("_hash"), F.col("unit").alias("_unit"),
        F.struct("own", "beside").alias(f"{edge}_context"))
    same = (
        F.col(f"{edge}.id").eqNullSafe(F.col("_id")) & (F.col(f"{edge}.hash") == F.col("_hash"))
        & (F.col(f"{edge}.unit") == F.col("_unit"))
    )
    return runs.join(near, same).drop("_id", "_hash", "_unit", edge)


def dedup_passages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = PASSAGE_WORDS,
) -> DataFrame:
    """id, text without repeated passages, kept_spans, removed_spans and n_removed of every row.

    A sentence repeats if it occurs in an earlier document (by id, null first); what a document
    repeats of its own stays. Neighbouring sentences that repeat, with the words on both sides
    that go on like the earlier text, are a passage, and go from ``min_words`` words on.

    Spans are (start, length) in code points of the original text; the new text is the kept
    spans one behind the other, and n_removed counts the removed ones. A null text stays null
    without spans; an empty text has none either and stays. Rows of one id are one document:
    repeated rows keep the same spans, different texts of one id are not earlier to each other.
    Further columns are ignored; an empty table gives an empty result. A passage inside one
    sentence of both texts, with other words on both sides, is not found.
    """
    docs = keyed(docs, id_col, text_col)
    prints = materialise(sentence_prints(docs), "sentences")
    units = prints.select("id", "hash", F.posexplode("digests").alias("unit", "digest"))
    place = F.struct("id", "unit", "hash")
    repeated = materialise(units.groupBy("digest").agg(
        F.min(place).alias("place"), F.max(F.struct("id")).alias("latest")
    ).filter(~F.col("place.id").eqNullSafe(F.col("latest.id"))).drop("latest"), "repeated-sentences")
    found = units.join(repeated, "digest").filter(~F.col("id").eqNullSafe(F.col("place.id")))
    found = found.groupBy("id", "hash").agg(F.collect_set(F.struct("unit", "place")).alias("found"))
    found = prints.drop("digests").join(join_keys(found), same_key()).select("id", "hash", "words", "found")
    runs = materialise(_runs(found, min_words), "sentence-runs").dropDuplicates(["id", "hash", "first"])
    wanted = runs.select("left.*", F.lit(-1).alias("side")).union(runs.select("right.*", F.lit(1).alias("side")))
    contexts = materialise(_contexts(docs, wanted), "contexts")
    runs = _with_context(_with_context(runs, contexts, "left", -1), contexts, "right", 1)
    runs = runs.groupBy("id", "hash").agg(
        F.collect_list(F.struct("first", "last", "left_context", "right_context")).alias("runs"))
    out = docs.join(join_keys(runs), same_key(), "left").select("id", "text", "runs")
    schema = f"id {docs.schema['id'].dataType.simpleString()}, text string, kept_spans {SPAN}, removed_spans {SPAN}, n_removed int"
    cut = out.mapInArrow(lambda batches: _without_passages(batches, min_words), schema)
    return cut.withColumnsRenamed({"id": id_col, "text": text_col})


def _common(a: list[bytes], b: list[bytes]) -> int:
    """Number of words that both lists begin with."""
    n = 0
    while n < len(a) and n < len(b) and a[n] == b[n]:
        n += 1
    return n


def passages(text: str, runs: list[dict], min_words: int) -> list[tuple[int, int]]:
    """start and end of the passages that the runs make, in code points, joined where they meet."""
    units, found = sentences(text), []
    for run in runs:
        a, b = run["first"], run["last"]
        left, right = run["left_context"], run["right_context"]
        if b" ".join(units[a][2]) != left["own"] or b" ".join(units[b][2]) != right["own"]:
            continue  # other words of the same digest
        before = units[a - 1] if a else (0, 0, [])
        behind = units[b + 1] if b + 1 < len(units) else (len(text), len(text), [])
        back = _common(before[2][::-1], left["beside"].split()[::-1])
        ahead = _common(behind[2], right["beside"].split())
        if sum(len(w) for _, _, w in units[a:b + 1]) + back + ahead < min_words:
            continue
        # Cut from the first word to the next word that stays.
        start = _place(text, before, len(before[2]) - back) if back else _place(text, units[a], 0)
        found.append((start, _place(text, behind, ahead)))
    joined: list[tuple[int, int]] = []
    for start, end in sorted(found):
        if joined and start <= joined[-1][1]:
            joined[-1] = joined[-1][0], max(end, joined[-1][1])
        else:
            joined.append((start, end))
    return joined


def _place(text: str, unit: tuple[int, int, list[bytes]], word: int) -> int:
    """Where a word of a unit begins; behind its last word, the unit's end."""
    start, end, _ = unit
    for n, found in enumerate(_WORDS.finditer(text, start, end)):
        if n == word:
            return found.start()
    return end


def _without_passages(batches: Iterator[pa.RecordBatch], min_words: int) -> Iterator[pa.RecordBatch]:
    span = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
    for batch in batches:
        texts, kept, removed = [], [], []
        for text, runs in zip(batch.column("text").to_pylist(), batch.column("runs").to_pylist()):
            cut = passages(text, runs, min_words) if runs else []
            edges = [0, *(x for pair in cut for x in pair), len(text or "")]
            rest = [(a, b) for a, b in zip(edges[::2], edges[1::2]) if b > a]
            texts.append("".join(text[a:b] for a, b in rest) if cut else text)
            kept.append([{"start": a, "length": b - a} for a, b in rest])
            removed.append([{"start": a, "length": b - a} for a, b in cut])
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array(texts, pa.string()), pa.array(kept, span), pa.array(removed, span),
             pa.array([len(r) for r in removed], pa.int32())],
            names=["id", "text", "kept_spans", "removed_spans", "n_removed"])


def op9_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup_passages(read(spark, sf_dir, "documents"))
