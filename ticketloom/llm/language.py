"""Language identification in two steps: the family, then one-versus-one within it.

Texts become hashed counts of their character 1- to 3-grams. Linear support vector machines,
one against the rest for each family, choose the family; within a family with several
languages one machine for each pair of languages votes. All machines are fitted on a bounded
sample (``SAMPLE_ROWS`` rows at most, shared evenly between the languages) and are a few
small matrices; every text is scored whole, in batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketloom.llm.common import read

# Language families by ISO 639-1 code.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk bg sr hr sl mk bs",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz",
    "indic": "hi ur bn mr ne gu pa",
    "semitic": "ar he mt am",
    "sinitic": "zh",
    "japonic": "ja",
    "koreanic": "ko",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

DIMENSIONS = 2048
SAMPLE_ROWS = 3000
PIECE_CHARS = 1 << 18
UNKNOWN = "und"
ROUNDS, COST = 200, 10.0


def family_of(lang: str) -> str:
    """A language without a known family is a family of its own."""
    code = lang.lower().split("-")[0].split("_")[0]
    return FAMILY_OF.get(code, f"only {lang}")


def features(text: str) -> np.ndarray:
    """Unit vector of the square roots of hashed 1- to 3-gram counts, and a constant."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    counts = np.zeros(DIMENSIONS, np.int64)
    shift = np.uint32(32 - (DIMENSIONS - 1).bit_length())
    for start in range(0, len(codes), PIECE_CHARS):
        part = codes[start:start + PIECE_CHARS + 2].copy()
        part[(part < 97) | ((part > 122) & (part < 170))] = 32  # what is not a letter, in ASCII
        one = part * np.uint32(2654435761)
        two = (one[:-1] ^ part[1:]) * np.uint32(2246822519)
        three = (two[:-1] ^ part[2:]) * np.uint32(3266489917)
        for grams in (one[:PIECE_CHARS], two[:PIECE_CHARS], three[:PIECE_CHARS]):
            counts += np.bincount(grams >> shift, minlength=DIMENSIONS)
    out = np.sqrt(counts, dtype=np.float32)
    norm = np.sqrt((out * out).sum())
    return np.append(out / norm if norm else out, np.float32(1)).astype(np.float32)


def linear_svm(x: np.ndarray, sign: np.ndarray, cost: float = COST, rounds: int = ROUNDS) -> np.ndarray:
    """Weights that minimise |w|^2 / 2 + cost * mean squared hinge, by accelerated descent."""
    n = len(x)
    probe = np.ones(x.shape[1], np.float32)
    for _ in range(10):
        probe = x.T @ (x @ probe)
        size = np.linalg.norm(probe)
        probe /= max(size, 1e-12)
    step = 1 / (1 + 2 * cost * size / n)
    w = look = np.zeros(x.shape[1], np.float32)
    for t in range(rounds):
        slack = np.maximum(0, 1 - sign * (x @ look))
        new = look - step * (look - 2 * cost / n * (x.T @ (sign * slack)))
        look = new + t / (t + 3) * (new - w)
        w = new
    return w


class LanguageModel:
    """Family machines and pair machines; ``predict`` takes a matrix of features."""

    def __init__(self, x: np.ndarray, langs: list[str]) -> None:
        langs = np.array(langs)
        self.langs = sorted(set(langs.tolist()))
        families = np.array([family_of(lang) for lang in langs])
        self.families = sorted(set(families.tolist()))
        self.members = {f: [lang for lang in self.langs if family_of(lang) == f] for f in self.families}
        self.family_weights = np.array([
            linear_svm(x, np.where(families == f, 1, -1).astype(np.float32)) for f in self.families
        ]).reshape(len(self.families), -1)
        self.pairs = {}
        for members in self.members.values():
            for a, b in combinations(members, 2):
                rows = (langs == a) | (langs == b)
                self.pairs[a, b] = linear_svm(x[rows], np.where(langs[rows] == a, 1, -1).astype(np.float32))

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        margins = x @ self.family_weights.T
        sure = np.exp(2 * (margins - margins.max(axis=1, keepdims=True)))
        sure /= sure.sum(axis=1, keepdims=True)
        chosen = margins.argmax(axis=1)
        out, score = np.empty(len(x), object), sure[np.arange(len(x)), chosen]
        for f, family in enumerate(self.families):
            rows = np.flatnonzero(chosen == f)
            members = self.members[family]
            votes, trust = np.zeros((len(rows), len(members))), np.zeros((len(rows), len(members)))
            for a, b in combinations(range(len(members)), 2):
                margin = x[rows] @ self.pairs[members[a], members[b]]
                votes[:, a] += margin >= 0
                votes[:, b] += margin < 0
                first = 1 / (1 + np.exp(-2 * np.clip(margin, -30, 30)))
                trust[:, a] += first
                trust[:, b] += 1 - first
            best = np.lexsort((np.broadcast_to(-np.arange(len(members)), votes.shape), trust, votes), axis=1)[:, -1]
            out[rows] = np.array(members, object)[best]
            if len(members) > 1:
                score[rows] *= trust[np.arange(len(rows)), best] / (len(members) - 1)
        return out.tolist(), np.clip(score, 0, 1)


def _remainder(divisor: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % divisor


def training_sample(docs: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """text, lang of about ``rows`` learnable rows at most, as many of each language if there are."""
    known = docs.filter((_remainder(4) != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not counts:
        return known.select("text", "lang").limit(0)
    share = rows / len(counts)
    odds = F.create_map(*[F.lit(v) for lang, n in counts.items() for v in (lang, min(1.0, share / n))])
    draw = F.pmod(F.xxhash64(F.lit("language"), "doc_id"), F.lit(1 << 40)) / float(1 << 40)
    return known.filter(draw < F.element_at(odds, F.col("lang"))).select("text", "lang").limit(2 * rows)


def fit(docs: DataFrame, rows: int = SAMPLE_ROWS) -> LanguageModel | None:
    """A model of the learnable rows (doc_id, text, lang); None when there are none."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = [features(t.as_py()).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("lang"), pa.array(blobs, pa.binary())], names=["lang", "vector"]
            )

    sample = training_sample(docs, rows).mapInArrow(work, "lang string, vector binary").collect()
    if not sample:
        return None
    sample.sort(key=lambda r: (r["lang"], r["vector"]))
    x = np.array([np.frombuffer(r["vector"], np.float32) for r in sample])
    return LanguageModel(x, [r["lang"] for r in sample])


def predict(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; only the text decides."""
    # The model's size is that of (families + pairs of languages) vectors, whatever the corpus.
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            rows = [i for i, t in enumerate(texts) if t and any(c.isalpha() for c in t)]
            if rows and shared.value is not None:
                for at in range(0, len(rows), 1024):
                    part = rows[at:at + 1024]
                    found, sure = shared.value.predict(np.array([features(texts[i]) for i in part]))
                    scores[part] = sure
                    for i, lang in zip(part, found):
                        langs[i] = lang
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(langs, pa.string()), pa.array(scores)],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce(_remainder(4) == 2, F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(work, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def identify_languages(docs: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document.

    ``held_out`` rows (crc32 of the id mod 4 is 2) and rows without id, language or text are
    never learned from. A null text or one without a letter is ``und`` with score 0, as is
    everything when nothing can be learned. Repeated rows are predicted alike. An empty
    table gives an empty result; further columns are ignored.
    """
    return predict(docs, fit(docs, rows))


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    return identify_languages(read(spark, sf_dir, "documents"))
