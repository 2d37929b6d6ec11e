"""Quality classifier: histogram gradient-boosted trees over document statistics.

A text is a short row of statistics (sizes, shares of character kinds, repetition of words
and lines). Trees are grown on a bounded sample of labelled rows (``SAMPLE_ROWS`` at most)
from histograms of binned statistics, and flattened into arrays, so that a batch of texts
walks all trees at once with one indexed step per level. Every text is scored whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketloom.llm.common import read

SAMPLE_ROWS = 12_000
TREES, DEPTH, BINS, RATE, SHRINK = 80, 5, 64, 0.15, 5.0
THRESHOLD = 0.3

_KINDS = np.full(256, 0)
_KINDS[65:91], _KINDS[97:123], _KINDS[48:58], _KINDS[128:] = 1, 2, 3, 4
_KINDS[[9, 10, 11, 12, 13, 32]] = 5
_SIGNS = [ord(c) for c in "!|#$%&*.,?<>@{}/="]


def statistics(text: str | None) -> list[float]:
    """Statistics of a whole text; null counts as empty."""
    text = text or ""
    raw = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    words, lines = text.split(), text.split("\n")
    n, w = max(int(raw.sum()), 1), max(len(words), 1)
    kinds = np.bincount(_KINDS, weights=raw, minlength=6)
    counts = Counter(words)
    again = sum(map(str.__eq__, words, words[1:]))
    sizes = [len(x) for x in words]
    filled = [x for x in lines if x.strip()]
    shown = max(len(filled), 1)
    return [
        np.log1p(len(text)), np.log1p(len(words)), np.log1p(len(lines)),
        *(kinds / n), *(raw[_SIGNS] / w),
        sum(sizes) / w, max(sizes, default=0), sum(s <= 2 for s in sizes) / w, sum(s >= 12 for s in sizes) / w,
        len(counts) / w, max(counts.values(), default=0) / w, again / w,
        sum(map(str.isupper, words)) / w, sum(map(str.istitle, words)) / w, sum(map(str.isalpha, words)) / w,
        len(set(filled)) / shown, sum(x.rstrip()[-1] in ".!?:;" for x in filled) / shown,
        max(map(len, filled), default=0) / n,
    ]


WIDTH = len(statistics(""))


def statistics_of(rows: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and stats, an array of doubles, of rows with a text."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = [statistics(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(stats, pa.list_(pa.float64()))], names=[*keep, "stats"]
            )

    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.select(*keep, "text").mapInArrow(work, f"{schema}, stats array<double>")


class BoostedTrees:
    """Complete binary trees as flat arrays: node i has the children 2 * i + 1 and 2 * i + 2."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> None:
        self.depth = depth
        inner, leaves = (1 << depth) - 1, 1 << depth
        prior = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.start = float(np.log(prior / (1 - prior)))
        self.feature = np.zeros((trees, inner), np.int64)
        self.cut = np.full((trees, inner), np.inf)
        self.value = np.zeros((trees, leaves))
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.column_stack([np.searchsorted(e, x[:, f]) for f, e in enumerate(edges)])
        score = np.full(len(x), self.start)
        for t in range(trees):
            p = 1 / (1 + np.exp(-score))
            slope, bend = y - p, p * (1 - p)
            node = np.zeros(len(x), np.int64)
            for level in range(depth):
                self._split(t, level, node, binned, edges, slope, bend)
                at = (1 << level) - 1 + node
                f = self.feature[t, at]
                node = 2 * node + (x[np.arange(len(x)), f] > self.cut[t, at])
            top = np.bincount(node, slope, leaves) / (np.bincount(node, bend, leaves) + SHRINK)
            self.value[t] = RATE * top
            score += self.value[t, node]

    def _split(self, t, level, node, binned, edges, slope, bend) -> None:
        """Best cut of each node of a level, from histograms of slopes and bends."""
        nodes = 1 << level
        best = np.full(nodes, 1e-6)
        for f, e in enumerate(edges):
            if not len(e):
                continue
            cell = node * (BINS + 1) + binned[:, f]
            g = np.bincount(cell, slope, nodes * (BINS + 1)).reshape(nodes, -1)
            h = np.bincount(cell, bend, nodes * (BINS + 1)).reshape(nodes, -1)
            gl, hl = np.cumsum(g, axis=1)[:, :len(e)], np.cumsum(h, axis=1)[:, :len(e)]
            ga, ha = g.sum(axis=1, keepdims=True), h.sum(axis=1, keepdims=True)
            gain = gl ** 2 / (hl + SHRINK) + (ga - gl) ** 2 / (ha - hl + SHRINK) - ga ** 2 / (ha + SHRINK)
            cut = gain.argmax(axis=1)
            most = gain[np.arange(nodes), cut]
            for i in np.flatnonzero(most > best):
                best[i] = most[i]
                self.feature[t, nodes - 1 + i], self.cut[t, nodes - 1 + i] = f, e[cut[i]]

    def scores(self, x: np.ndarray) -> np.ndarray:
        trees = np.arange(len(self.feature))
        at = np.zeros((len(x), len(trees)), np.int64)
        for _ in range(self.depth):
            right = np.take_along_axis(x, self.feature[trees, at], axis=1) > self.cut[trees, at]
            at = 2 * at + 1 + right
        total = self.start + self.value[trees, at - ((1 << self.depth) - 1)].sum(axis=1)
        return 1 / (1 + np.exp(-total))


def _remainder(divisor: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % divisor


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> BoostedTrees | None:
    """Trees from about ``rows`` learnable labels at most; None where one class or none is known.

    A doc_id with both labels counts as label 1.
    """
    known = labels.filter((_remainder(5) != 0) & F.col("quality").isin(0, 1)).select("doc_id", "quality")
    odds = min(1.0, rows / max(known.count(), 1))
    draw = F.pmod(F.xxhash64(F.lit("quality"), "doc_id"), F.lit(1 << 40)) / float(1 << 40)
    sample = known.filter(draw < odds).groupBy("doc_id").agg(F.max("quality").alias("quality")).limit(2 * rows)
    # At most 2 * rows pairs of numbers.
    found = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    learned = statistics_of(found, ["doc_id", "quality"]).limit(4 * rows).collect()
    learned.sort(key=lambda r: (r["doc_id"], r["stats"]))
    y = np.array([r["quality"] for r in learned], float)
    if not len(y) or y.min() == y.max():
        return None
    return BoostedTrees(np.array([r["stats"] for r in learned]), y)


def score(docs: DataFrame, model: BoostedTrees | None, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and score of every row; 0.5 without a model."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.full(batch.num_rows, 0.5)
            if shared.value is not None:
                for at in range(0, batch.num_rows, 1024):
                    part = batch.column("text").slice(at, 1024)
                    x = np.array([statistics(t.as_py()) for t in part]).reshape(-1, WIDTH)
                    out[at:at + len(x)] = shared.value.scores(x)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(out)], names=[*keep, "score"]
            )

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(work, f"{schema}, score double")


def classify_quality(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted of every document.

    Labels of ``held_out`` rows (crc32 of the id mod 5 is 0) are never learned from, and
    only the text is scored. A null text is scored like an empty one; repeated rows are
    scored alike; a null label or id is not learned from. Without labels of both kinds every
    score is 0.5. An empty table gives an empty result; further columns are ignored.
    """
    rows_in = docs.select("doc_id", F.coalesce(_remainder(5) == 0, F.lit(False)).alias("held_out"), "text")
    found = score(rows_in, fit(docs, labels, rows), ["doc_id", "held_out"])
    return found.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))


def keep_good(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """``docs`` without the documents that are predicted 0, all columns as they are."""
    model = fit(docs, labels, rows)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if shared.value is not None and batch.num_rows:
                x = np.array([statistics(t.as_py()) for t in batch.column("text")]).reshape(-1, WIDTH)
                batch = batch.filter(pa.array(shared.value.scores(x) >= THRESHOLD))
            yield batch

    return docs.mapInArrow(work, docs.schema)


def op4_quality(spark, sf_dir: str) -> DataFrame:
    return classify_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
