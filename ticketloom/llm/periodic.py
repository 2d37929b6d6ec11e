"""Periodic runs of words, found by catching squares over dyadic blocks.

For every power of two s, each completed block of s words is a catcher. It waits for its words
to come again 2s to 4s words later: every appended word ends a suffix of s words, which is
compared with the two catchers at that distance. A match at distance q says that words q
apart are equal for s words; matches of neighbouring blocks at one distance are one stretch,
and its two ends, less than s words away, are found by comparing ever shorter suffixes. A
stretch of q words or more is a square, and the squares of one period that follow each other
merge into a run. A square of period q holds 2q - 1 >= 2s - 1 equal words q apart, hence a
whole block of some catcher: none is missed. The smallest blocks, of 2 words, also watch the
distances below 4, where a run's least length of 12 leaves stretches of 5 words and more.

Blocks are compared by names: a word's number, and for 2s words a 64-bit mix of the names of
both halves. All words of a batch of texts advance together, as one numpy comparison for each
size and distance: n log n steps for n words, whatever they repeat. Names could collide, so
the words of each run are compared in the end; should they differ, the batch is named anew.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketloom.llm.common import WORD, read, spare_name

MIN_LENGTH = 12
#: Words of texts that are searched together (a longer text is searched alone), and bytes of
#: texts that are split into words at a time.
BATCH_WORDS, SLICE_BYTES = 1 << 18, 1 << 22
_U = np.uint64


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _names(words: np.ndarray, levels: int, seed: int) -> list[np.ndarray]:
    """names[k][i] stands for the 2**k words from i; where the text ends sooner, for nothing else."""
    n = len(words)
    alone = _mixed(np.arange(n, dtype=_U) + _U(0xA5A5A5A5 + seed))
    out = [_mixed(words.astype(_U) + _U(seed << 32))]
    for k in range(levels):
        half = 1 << k
        name = alone.copy()
        if n >= 2 * half:
            whole = n - 2 * half + 1
            name[:whole] = _mixed(out[-1][:whole] * _U(0x9E3779B97F4A7C15) + (out[-1][half:half + whole] ^ _U(k + 1)))
        out.append(name)
    return out


def _stretches(names: list[np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, end, distance of the stretches that the catchers of 2**k words see."""
    name, s = names[k], 1 << k
    blocks = len(name) // s
    rows = name[:blocks * s].reshape(blocks, s)
    caught = rows[:, 0]
    block, distance = [], []
    for back in range(0 if k == 1 else 2, 4):
        of, offset = np.nonzero(rows[back:] == caught[:max(blocks - back, 0), None])
        ahead = back * s + offset
        block.append(of[ahead > 0])
        distance.append(ahead[ahead > 0])
    block, distance = np.concatenate(block).astype(np.int64), np.concatenate(distance).astype(np.int64)
    order = np.lexsort((block, distance))
    block, distance = block[order], distance[order]
    if not len(block):
        return block, block, distance
    first = np.append(True, (np.diff(distance) != 0) | (np.diff(block) != 1))
    last = np.append(first[1:], True)
    start, end, distance = block[first] * s, (block[last] + 1) * s, distance[first]
    for j in range(k - 1, -1, -1):
        step, level = 1 << j, names[j]
        left = np.maximum(start - step, 0)
        start = np.where((start >= step) & (level[left] == level[left + distance]), left, start)
        right = np.minimum(end + distance, len(level) - 1)
        more = (end + distance + step <= len(level)) & (level[np.minimum(end, len(level) - 1)] == level[right])
        end = np.where(more, end + step, end)
    return start, end, distance


def _verified(words: np.ndarray, start: np.ndarray, end: np.ndarray, period: np.ndarray) -> bool:
    """Whether the words of each run repeat, and neither neighbour goes on repeating."""
    for s, e, p in zip(start.tolist(), end.tolist(), period.tolist()):
        if not np.array_equal(words[s:e - p], words[s + p:e]):
            return False
    before, after = start > 0, end < len(words)
    goes_on = words[start[before] - 1] == words[start[before] - 1 + period[before]]
    return not goes_on.any() and not (words[end[after]] == words[end[after] - period[after]]).any()


def runs_of(words: np.ndarray, longest: int, min_length: int = MIN_LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, length and smallest period of all runs, by start, then period.

    ``words`` holds numbers of words; texts are parted by numbers that occur once, and
    ``longest`` is the length of the longest text.
    """
    none = np.empty(0, np.int64)
    if longest < min_length:
        return none, none, none
    top = 1
    while 4 << top <= longest // 2:  # periods of 2 * 2**top and more
        top += 1
    for seed in range(1, 100):
        names = _names(words, top, seed)
        starts, ends, periods, known = [none], [none], [none], none
        for k in range(1, top + 1):
            start, end, q = _stretches(names, k)
            end = end + q
            run = end - start >= np.maximum(min_length, 2 * q)
            start, end, q = start[run], end[run], q[run]
            # What a shorter period fills from end to end is that period's run.
            place = start * (len(words) + 1) + end
            order = np.lexsort((q, place))
            _, first = np.unique(place[order], return_index=True)
            new = order[first]
            new = new[~np.isin(place[new], known)]
            known = np.concatenate([known, place[new]])
            starts.append(start[new])
            ends.append(end[new])
            periods.append(q[new])
        start, end, q = (np.concatenate(x) for x in (starts, ends, periods))
        if _verified(words, start, end, q):
            order = np.lexsort((q, start))
            return start[order], (end - start)[order], q[order]
    raise RuntimeError("names of blocks collide under every seed")


def _groups(sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Texts of like lengths, short ones first, up to BATCH_WORDS words together."""
    order = np.argsort(sizes, kind="stable")
    total = np.cumsum(sizes[order] + 1)
    at = 0
    while at < len(order):
        done = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, done + BATCH_WORDS, side="right")))
        yield order[at:to]
        at = to


def _search(texts: list[bytes | None], min_length: int) -> tuple[list, list]:
    """For each text its runs (start, length, period), and the text with its runs collapsed."""
    words = [t.split() if t is not None else [] for t in texts]
    sizes = np.array([len(w) for w in words], np.int64)
    runs, collapsed = [[] for _ in texts], [b" ".join(w) for w in words]
    for group in _groups(sizes):
        longest = int(sizes[group].max(initial=0))
        if longest < min_length:
            continue
        numbers: dict = {}
        flat = []
        for n, i in enumerate(group.tolist()):
            flat += [numbers.setdefault(w, len(numbers)) for w in words[i]]
            flat.append(-1 - n)
        flat = np.array(flat, np.int64)
        offsets = np.concatenate([[0], np.cumsum(sizes[group] + 1)])
        start, length, period = runs_of(flat, longest, min_length)
        owner = np.searchsorted(offsets, start, side="right") - 1
        for text in np.unique(owner).tolist():
            i, own = int(group[text]), owner == text
            at, size, q = start[own] - offsets[text], length[own], period[own]
            runs[i] = list(zip(at.tolist(), size.tolist(), q.tolist()))
            edges = np.zeros(int(sizes[i]) + 1, np.int64)
            np.add.at(edges, at + q, 1)
            np.add.at(edges, at + size, -1)
            collapsed[i] = b" ".join([words[i][j] for j in np.flatnonzero(np.cumsum(edges[:-1]) == 0).tolist()])
    return runs, collapsed


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column("text")), 0).to_numpy().astype(np.int64)
    part = np.cumsum(sizes) // SLICE_BYTES
    starts = [*np.flatnonzero(np.diff(part, prepend=-1)).tolist(), len(part)]
    yield from (batch.slice(a, b - a) for a, b in zip(starts, starts[1:]))


def find_runs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH,
) -> DataFrame:
    """id, n_words, runs and collapsed of every row.

    ``runs`` lists (start, length, period) in words, by start, then period: every stretch of
    words with smallest period ``period`` and ``min_length`` (12 or more) words and two periods
    at least, that goes on repeating on neither side. ``collapsed`` joins by one blank the words
    that no run holds behind its first period. Texts are searched whole, and a task holds about
    30 bytes for each word and power of two below its longest text's length.

    A null, empty or blank text has no words, no runs and an empty ``collapsed``. Repeated rows
    give repeated rows; a null id stays. Further columns are ignored; an empty table gives an
    empty result.
    """
    if min_length < MIN_LENGTH:
        raise ValueError(f"runs below {MIN_LENGTH} words can slip through the smallest catchers")
    run = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in _slices(whole)):
            texts = batch.column("text").to_pylist()
            runs, collapsed = _search(texts, min_length)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([len(t.split()) if t else 0 for t in texts], pa.int64()),
                 pa.array([[dict(zip(("start", "length", "period"), r)) for r in own] for own in runs], run),
                 pa.array(collapsed, pa.binary()).cast(pa.string())],
                names=["id", "n_words", "runs", "collapsed"],
            )

    schema = f"id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return rows.mapInArrow(work, schema).withColumnRenamed("id", id_col)


def with_periodic_texts(docs: DataFrame) -> DataFrame:
    """A tenth of the texts, by the checksum of doc_id, made periodic from some word on."""
    h, words = (spare_name(docs, x) for x in ("h", "words"))
    n, g = F.size(words).cast("long"), F.floor(F.col(h) / 10).cast("long")
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8)).cast("long")
    place = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p)
    made = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(words, place(i).cast("int")))
    hit = F.col(h) % 10 == 0
    out = docs.withColumn(h, F.crc32(F.col("doc_id").cast("string")))
    out = out.withColumn(words, F.when(hit, F.regexp_extract_all("text", F.lit(WORD), F.lit(0))))
    return out.withColumn("text", F.when(hit & (F.size(words) > 0), F.array_join(made, " ")).otherwise(F.col("text"))).drop(h, words)


def op12_periodic_runs(spark, sf_dir: str) -> DataFrame:
    found = find_runs(with_periodic_texts(read(spark, sf_dir, "documents").select("doc_id", "text")))
    # Longest first, then smallest start, then smallest period: the least of (-length, start, period).
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("q"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(
        r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"),
        F.col("best.s").alias("start"), (-F.col("best.l")).alias("length"), F.col("best.q").alias("period"),
        F.floor(-1000 * F.col("best.l") / F.col("best.q")).cast("long").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
