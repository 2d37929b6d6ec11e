"""Benchmark passages in documents: q-gram lemma filter, then banded alignment.

Texts and items are lower-cased and runs of blanks become one space. An item of m characters
may be changed by k = ``EDIT_RATE`` * m edits. An occurrence with at most k edits keeps at
least m + 1 - q - k * q of the item's q-grams, and its diagonals (place in the text minus
place in the item) span at most k. So shared q-grams are counted in overlapping bands of
2 * (k + 1) diagonals, regions that meet the bound are retained, and each is verified by an
alignment that keeps to the band. The filter loses nothing; the alignment decides.

The benchmark is read in blocks of bounded size, each of which is broadcast; documents are
scanned and never shuffled. A first look drops most text without opening posting lists: items
are put in classes of similar length, and a class matters only where the least bound of its
items is met by hits of that class within its longest window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketloom.llm.common import read

Q = 8
EDIT_RATE = 0.10
#: Characters of items in one broadcast block, and of text looked at in one piece.
BLOCK_CHARS = 4_000_000
PIECE_CHARS = 1 << 18
TABLE_BITS = 22
CLASSES = 8
BASE, SPREAD = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)


def normalise(text: str | None) -> str:
    return " ".join(text.lower().split()) if text else ""


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def gram_hashes(codes: np.ndarray, q: int) -> np.ndarray:
    n = len(codes) - q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    wide = codes.astype(np.uint64)
    out = wide[:n].copy()
    for k in range(1, q):
        out *= BASE
        out += wide[k:k + n]
    return out * SPREAD


def edit_budget(length: int, q: int = Q, rate: float = EDIT_RATE) -> int:
    """Edits allowed in an item; few enough for the lemma to ask for one q-gram at least."""
    return max(0, min(int(length * rate), (length - q) // q))


def banded_alignment(item: np.ndarray, text: np.ndarray, low: int, high: int, anchored: bool = False):
    """(edits, end) of the best alignment of all of ``item`` to a stretch of ``text``.

    Only diagonals low .. high are visited. The stretch may begin on any of them, or, when
    ``anchored``, at the start of the text only. ``end`` is where the stretch ends.
    """
    diagonals = np.arange(low, high + 1)
    steps = np.arange(len(diagonals))
    row = np.where(diagonals >= 0, diagonals, len(item) + len(text)) if anchored else 0 * diagonals
    # Outside the text nothing matches: a character there costs what leaving it out costs.
    before, after = max(0, -low), max(0, len(item) + high + 1 - len(text))
    padded = np.concatenate([np.zeros(before, np.uint32), text + np.uint32(1), np.zeros(after, np.uint32)])
    at = low + before
    for char in item + np.uint32(1):
        new = row + (padded[at:at + len(steps)] != char)
        # A character of the item left out moves one diagonal down, one put in moves up.
        np.minimum(new[:-1], row[1:] + 1, out=new[:-1])
        row = np.minimum.accumulate(new - steps) + steps
        at += 1
    best = int(np.argmin(row))
    return int(row[best]), int(min(max(len(item) + diagonals[best], 0), len(text)))


def exact_place(item: np.ndarray, text: np.ndarray) -> int:
    """Where ``item`` stands in ``text`` unchanged, or -1."""
    size, hay, needle = item.itemsize, text.tobytes(), item.tobytes()
    at = hay.find(needle)
    while at > 0 and at % size:
        at = hay.find(needle, at + 1)
    return at // size if at >= 0 else -1


class QGramIndex:
    """q-grams of a block of items: postings, classes by length, and what a match needs."""

    def __init__(self, ids: list, texts: list[str | None], q: int = Q, rate: float = EDIT_RATE) -> None:
        self.q = q
        known = [(i, codes_of(normalise(t))) for i, t in zip(ids, texts)]
        # An item shorter than q has no q-gram and is no evidence.
        known = sorted((x for x in known if len(x[1]) >= q), key=lambda x: len(x[1]))
        self.ids, self.items = [i for i, _ in known], [c for _, c in known]
        lengths = np.array([len(c) for c in self.items], np.int64)
        self.budget = np.array([edit_budget(n, q, rate) for n in lengths], np.int64)
        self.bound = lengths + 1 - q - self.budget * q
        self.group = np.arange(len(known)) * CLASSES // max(len(known), 1)
        grams = [gram_hashes(c, q) for c in self.items]
        owner = np.repeat(np.arange(len(known)), [len(g) for g in grams])
        place = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.empty(0, np.int64)
        grams = np.concatenate(grams) if grams else np.empty(0, np.uint64)
        order = np.argsort(grams, kind="stable")
        self.owner, self.place = owner[order], place[order]
        self.grams, self.first = np.unique(grams[order], return_index=True)
        self.last = np.append(self.first[1:], len(grams))
        self.flags = np.zeros(len(self.grams), np.uint8)
        np.bitwise_or.at(self.flags, np.repeat(np.arange(len(self.grams)), self.last - self.first),
                         (1 << self.group[self.owner]).astype(np.uint8))
        self.table = np.zeros(1 << TABLE_BITS, bool)
        self.table[self.grams >> np.uint64(64 - TABLE_BITS)] = True
        self.windows = []
        for c in range(CLASSES):
            own = self.group == c
            if own.any():
                # Hits of one occurrence lie within its length and the width of a band.
                window = int((lengths[own] + 2 * (self.budget[own] + 1)).max())
                self.windows.append((c, int(self.bound[own].min()), window))
        self.reach = max((w for _, _, w in self.windows), default=0) + q

    def matches(self, texts: list[str | None]) -> list[list[tuple]]:
        """For each text the (item id, edits, start, length) of its best match of each item."""
        found: list[dict] = [{} for _ in texts]
        if self.ids:
            for owners, starts, offsets, codes in self._pieces(texts):
                for piece, item, edits, start, length in self._search(codes, starts):
                    got, at = found[owners[piece]], start + offsets[piece]
                    if item not in got or (edits, at) < got[item][:2]:
                        got[item] = (edits, at, length)
        return [
            [(self.ids[item], edits, start, length) for item, (edits, start, length) in sorted(got.items())]
            for got in found
        ]

    def _pieces(self, texts) -> Iterator[tuple]:
        """Texts put together to pieces of bounded size; a long text overlaps from piece to piece."""
        owners, starts, offsets, parts, size = [], [], [], [], 0
        for n, text in enumerate(texts):
            codes = codes_of(normalise(text))
            step = PIECE_CHARS
            for offset in range(0, max(len(codes), 1), step):
                part = codes[offset:offset + step + 2 * self.reach]
                if len(part) < self.q:
                    continue
                if size and size + len(part) > PIECE_CHARS:
                    yield owners, starts, offsets, np.concatenate(parts)
                    owners, starts, offsets, parts, size = [], [], [], [], 0
                owners.append(n)
                starts.append(size)
                offsets.append(offset)
                parts.append(part)
                size += len(part)
        if size:
            yield owners, starts, offsets, np.concatenate(parts)

    def _search(self, codes: np.ndarray, starts: list[int]) -> Iterator[tuple]:
        hashes = gram_hashes(codes, self.q)
        at = np.flatnonzero(self.table[hashes >> np.uint64(64 - TABLE_BITS)])
        gram = np.minimum(np.searchsorted(self.grams, hashes[at]), len(self.grams) - 1)
        true = self.grams[gram] == hashes[at]
        at, gram = at[true], gram[true]
        flags = self.flags[gram]
        starts = np.array(starts)
        ends = np.append(starts[1:], len(codes))
        for group, bound, window in self.windows:
            of = np.flatnonzero(flags & (1 << group))
            if len(of) < bound:
                continue
            place = at[of]
            dense = np.flatnonzero(place[bound - 1:] - place[:len(place) - bound + 1] <= window)
            pieces = np.unique(np.searchsorted(starts, place[dense], side="right") - 1)
            for piece in pieces:
                lo, hi = np.searchsorted(place, [starts[piece], ends[piece] - self.q + 1])
                own = codes[starts[piece]:ends[piece]]
                yield from (
                    (piece, *hit) for hit in self._verify(own, place[lo:hi] - starts[piece], gram[of[lo:hi]], group)
                )

    def _verify(self, text: np.ndarray, at: np.ndarray, gram: np.ndarray, group: int) -> Iterator[tuple]:
        counts = self.last[gram] - self.first[gram]
        entry = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(self.first[gram], counts)
        at, item, place = np.repeat(at, counts), self.owner[entry], self.place[entry]
        wide = self.budget[item] + 1
        band = (at - place + 2 * wide) // wide
        # An occurrence misses k characters at most before the text begins.
        own = (self.group[item] == group) & (band >= 0)
        item, place, band = item[own], place[own], band[own]
        if not len(item):
            return
        # Region b is the bands b and b + 1: each diagonal lies in two regions.
        base, bands = int(item.min()), int(band.max()) + 2
        hits = np.bincount((item - base) * bands + band, minlength=(int(item.max()) - base + 1) * bands)
        hits[:-1] += hits[1:].copy()
        bound = np.repeat(self.bound[base:base + len(hits) // bands], bands)
        for region in np.flatnonzero(hits >= bound):
            number, low_band = base + int(region) // bands, int(region) % bands
            # Repeats of a q-gram count once per place in the item.
            here = (item == number) & ((band == low_band) | (band == low_band + 1))
            if len(np.unique(place[here])) < self.bound[number]:
                continue
            k = int(self.budget[number])
            low = (low_band - 2) * (k + 1)
            high = low + 2 * (k + 1) - 1
            chars = self.items[number]
            cut = max(0, low - k)
            region = text[cut:max(cut, high + len(chars) + k + 1)]
            place_of = exact_place(chars, region)
            if place_of >= 0:  # an alignment without edits
                yield number, 0, cut + place_of, len(chars)
                continue
            edits, end = banded_alignment(chars, region, low - cut, high - cut)
            if edits <= k:
                # Backwards from the end finds the start.
                back = region[:end][::-1]
                _, length = banded_alignment(chars[::-1], back, -k, k, anchored=True)
                yield number, edits, cut + end - length, length


def _blocks(benchmark: DataFrame, q: int, rate: float, block_chars: int) -> Iterator[QGramIndex]:
    """Indexes over the items, each of about ``block_chars`` characters at most."""
    items = benchmark.select("item_id", "text").filter("item_id IS NOT NULL AND text IS NOT NULL")
    total = items.agg(F.sum(F.char_length("text"))).first()[0] or 0
    blocks = -(-total // block_chars)
    for block in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        yield QGramIndex([r["item_id"] for r in rows], [r["text"] for r in rows], q, rate)


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, q: int = Q, rate: float = EDIT_RATE, block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """doc_id, item_id, edits, start and length of the best match of each item in each text.

    Start and length are in characters of the normalised text. Null and blank texts and
    items match nothing, nor do items below q characters. Repeated rows give repeated
    matches; items with one id and different texts are matched each. An empty table, on
    either side, gives an empty result.
    """
    spark = docs.sparkSession
    kinds = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, edits int, start long, length int"
    out = spark.createDataFrame([], schema)
    for index in _blocks(benchmark, q, rate, block_chars):
        shared = spark.sparkContext.broadcast(index)

        def work(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = shared.value.matches(batch.column("text").to_pylist())
                rows = [(n, *hit) for n, hits in enumerate(found) for hit in hits]
                take = pa.array([r[0] for r in rows], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(take), *(pa.array([r[c] for r in rows], t) for c, t in (
                        (1, None if rows else pa.int64()), (2, pa.int32()), (3, pa.int64()), (4, pa.int32())))],
                    names=["doc_id", "item_id", "edits", "start", "length"],
                )

        out = out.unionByName(docs.select("doc_id", "text").mapInArrow(work, schema))
    return out


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, q: int = Q, rate: float = EDIT_RATE, block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """``docs`` without the documents in which an item is found, all columns as they are."""
    for index in _blocks(benchmark, q, rate, block_chars):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def work(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = shared.value.matches(batch.column("text").to_pylist())
                yield batch.filter(pa.array([not hits for hits in found], pa.bool_()))

        docs = docs.mapInArrow(work, docs.schema)
    return docs


def op7_decontamination(spark, sf_dir: str) -> DataFrame:
    return find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
