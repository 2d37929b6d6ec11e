"""SimHash near-duplicates: fingerprints linked through BK-trees.

Fingerprints of equal bits are folded first, so a text copied to a third of all rows is one
fingerprint. Two fingerprints that differ in at most r bits agree in two at least of r + 2
blocks of bits; each pair of blocks is a key, and fingerprints meet only under equal keys.
What meets under a key is a shard with a BK-tree: children hang at the Hamming distance to
their parent, and a search follows only the edges within r of its own distance. A key with
more than ``TREE_SIZE`` fingerprints is several shards, and each of them is sent to the tasks
that search it; no tree is broadcast to all, since trees grow with the corpus.

A task returns a spanning forest of the links it found, never the pairs, and the forests are
joined into components on the cluster.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketloom.llm.common import materialise, read, spare_name
from ticketloom.llm.components import components

SHINGLE_WORDS = 3
RADIUS = 3
TREE_SIZE = 8192
SEED = 42
#: Hashes whose bits are counted at a time; bounds the memory of a very long text.
VOTE_BLOCK = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash over the word shingles; 0 for null and for a text without words."""
    # On bytes, lower() changes A-Z alone and split() knows the ASCII blanks alone.
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    whole = b" ".join(words)
    after = list(accumulate(len(w) + 1 for w in words))
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [digest(whole, SEED)]
    else:
        hashes = [digest(whole[a:b - 1], SEED) for a, b in zip([0, *after], after[shingle - 1:])]
    votes = np.zeros(64, np.int64)
    for start in range(0, len(hashes), VOTE_BLOCK):
        part = np.array(hashes[start:start + VOTE_BLOCK], dtype="<u8")
        bits = np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64)
        votes += bits.sum(axis=0, dtype=np.int32)
    return sum(1 << int(j) for j in np.flatnonzero(2 * votes > len(hashes)))


def fingerprints(rows: DataFrame, shingle: int = SHINGLE_WORDS) -> DataFrame:
    """key, text -> key, print (the fingerprint's bits as a long)."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t.as_py(), shingle) for t in batch.column("text")], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array(prints.view(np.int64))], names=["key", "print"]
            )

    return rows.select("key", "text").mapInArrow(work, f"key {rows.schema['key'].dataType.simpleString()}, print long")


def _keys(bits: Column, radius: int) -> Column:
    """One number for each pair of blocks: which pair, and the bits of both."""
    blocks = radius + 2
    edges = [64 * i // blocks for i in range(blocks + 1)]
    cut = [
        F.shiftrightunsigned(bits, edges[i]).bitwiseAND(F.lit((1 << (edges[i + 1] - edges[i])) - 1))
        for i in range(blocks)
    ]
    wide = max(b - a for a, b in zip(edges, edges[1:]))
    return F.array(*[
        F.lit(n << (2 * wide)).cast("long") + F.shiftleft(cut[i], wide) + cut[j]
        for n, (i, j) in enumerate(combinations(range(blocks), 2))
    ])


class BkTree:
    """Children keyed by the Hamming distance to their parent."""

    def __init__(self, prints: np.ndarray) -> None:
        self.prints = prints
        self.children: list[dict[int, int]] = [{} for _ in prints]
        # Each entry goes down from the root at once with all that take the same edge.
        waiting = [(0, np.arange(1, len(prints)))] if len(prints) else []
        while waiting:
            node, rest = waiting.pop()
            if not len(rest):
                continue
            far = np.bitwise_count(prints[rest] ^ prints[node])
            order = np.argsort(far, kind="stable")
            rest, far = rest[order], far[order]
            cuts = np.flatnonzero(np.diff(far)) + 1
            for group, edge in zip(np.split(rest, cuts), far[np.concatenate(([0], cuts))]):
                self.children[node][int(edge)] = int(group[0])
                waiting.append((int(group[0]), group[1:]))

    def within(self, probes: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
        """(node, probes within the radius of it), only for nodes that have some."""
        waiting = [(0, np.arange(len(probes)))] if len(self.prints) else []
        while waiting:
            node, who = waiting.pop()
            far = np.bitwise_count(probes[who] ^ self.prints[node]).astype(np.int16)
            near = who[far <= radius]
            if len(near):
                yield node, near
            for edge, child in self.children[node].items():
                follow = who[np.abs(far - edge) <= radius]
                if len(follow):
                    waiting.append((child, follow))


def _forest(tree: np.ndarray, probes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (member, root) that connect whatever is linked between tree and probes."""
    nodes = np.unique(np.concatenate([tree, probes]))
    label = np.arange(len(nodes))
    tree_at, probe_at = np.searchsorted(nodes, tree), np.searchsorted(nodes, probes)
    for node, near in BkTree(tree).within(probes, radius):
        met = np.unique(label[np.append(probe_at[near], tree_at[node])])
        if len(met) > 1:
            label[np.isin(label, met)] = met[0]
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _link_units(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (unit, part): part 0 is the tree, 1 the probes, 2 both."""
    held: list[np.ndarray] | None = None

    def linked(cols: list[np.ndarray]) -> pa.RecordBatch:
        unit, shard, other, part, bits = cols
        new = np.flatnonzero((np.diff(unit) != 0) | (np.diff(shard) != 0) | (np.diff(other) != 0)) + 1
        start, stop = np.concatenate(([0], new)), np.concatenate((new, [len(unit)]))
        a, b = [], []
        for lo, hi in zip(start[stop - start > 1], stop[stop - start > 1]):
            own, role = bits[lo:hi], part[lo:hi]
            members, roots = _forest(own[role != 1], own[role != 0], radius)
            a.append(members)
            b.append(roots)
        a, b = (np.concatenate(x).view(np.int64) if x else np.empty(0, np.int64) for x in (a, b))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    for batch in batches:
        cols = [batch.column(n).to_numpy(zero_copy_only=False) for n in ("unit", "shard", "other", "part", "print")]
        cols[4] = cols[4].view(np.uint64)
        if held is not None:
            cols = [np.concatenate(x) for x in zip(held, cols)]
        if not len(cols[0]):
            continue
        # The last unit may go on in the next batch.
        same = (cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1]) & (cols[2] == cols[2][-1])
        cut = int(np.argmax(same))
        held = [c[cut:] for c in cols]
        if cut:
            yield linked([c[:cut] for c in cols])
    if held is not None:
        yield linked(held)


def linked_prints(prints: DataFrame, radius: int = RADIUS, tree_size: int = TREE_SIZE) -> DataFrame:
    """Links (a, b) between distinct fingerprints (print) that span all their components."""
    met = prints.select("print", F.explode(_keys(F.col("print"), radius)).alias("unit"))
    hot = met.groupBy("unit").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > tree_size).select(
        F.col("unit").alias("hot"), F.ceil(F.col("n") / tree_size).cast("int").alias("shards")
    )
    met = met.join(hot, met["unit"] == hot["hot"], "left").select(
        "print", "unit", F.coalesce("shards", F.lit(1)).alias("shards")
    ).withColumn("own", F.pmod(F.xxhash64("print"), F.col("shards")).cast("int"))
    # Shard i's tree is searched by shard j for i <= j: a fingerprint is sent once per shard.
    met = met.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    units = met.select(
        "unit", F.least("own", "with").alias("shard"), F.greatest("own", "with").alias("other"),
        F.when(F.col("own") == F.col("with"), 2).when(F.col("own") < F.col("with"), 0).otherwise(1).alias("part"),
        "print",
    )
    dealt = units.repartition("unit", "shard", "other").sortWithinPartitions("unit", "shard", "other")
    return dealt.mapInArrow(lambda batches: _link_units(batches, radius), "a long, b long")


def near_duplicates(rows: DataFrame, shingle: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """key, text -> key, print, component: the least key that can be reached.

    Null and blank texts have fingerprint 0 and are linked like any other. Repeated rows
    are rows of one component; a null key is never the least. Texts of any length are read
    whole. An empty table gives an empty result.
    """
    rows = materialise(fingerprints(rows, shingle), "fingerprints")
    prints = materialise(rows.groupBy("print").agg(F.min("key").alias("least")), "distinct-prints")
    labels = components(linked_prints(prints, radius))
    member = materialise(prints.join(labels, F.col("print") == F.col("node"), "left").select(
        "print", "least", F.coalesce("component", "print").alias("root")
    ), "members")
    # Stored, so that a component that holds much of all prints is split in the join.
    least = materialise(member.groupBy("root").agg(F.min("least").alias("component")), "least-keys")
    known = member.select("print", "root").join(least, "root").select(F.col("print").alias("_print"), "component")
    return rows.join(known, F.col("print") == F.col("_print")).select("key", "print", "component")


def simhash_components(docs: DataFrame, shingle: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every document."""
    found = near_duplicates(docs.select(F.col("doc_id").alias("key"), "text"), shingle, radius)
    return found.select(
        F.col("key").alias("doc_id"), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def simhash_dedup(docs: DataFrame, shingle: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one row of every component: the least doc_id (null last).

    Of rows with the same id and text one stays; of different texts under one id, the one of
    the least hash. All columns are kept as they are, whatever their names; an empty table
    gives an empty result.
    """
    keys = [F.col("doc_id").isNull(), F.col("doc_id"), F.xxhash64("text")]
    key = F.struct(*[k.alias(n) for k, n in zip(keys, ("missing", "id", "hash"))])
    found = near_duplicates(docs.select(key.alias("key"), "text"), shingle, radius)
    kept = found.filter(F.col("key") == F.col("component")).select(
        F.col("key.id").alias("_id"), F.col("key.hash").alias("_hash")
    )
    given = spare_name(docs, "hash")
    hashed = docs.withColumn(given, keys[2])
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col(given) == F.col("_hash"))
    return hashed.join(kept, same, "left_semi").dropDuplicates(["doc_id", given]).drop(given)


def op6_simhash(spark, sf_dir: str) -> DataFrame:
    return simhash_components(read(spark, sf_dir, "documents"))
