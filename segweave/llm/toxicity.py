"""Toxicity by class-conditional Kneser-Ney models.

Two models, of toxic and of ordinary texts, spell each word letter by letter, the context being what stands of the word
so far, with absolute discounting by the share that counts of one have among counts of one and two. What is discounted,
and STRENGTH counts besides, go to continuation counts of both classes together: of the distinct words that begin so far,
the share that go on by that letter. All counts stay, those of one as well; an expression too rare to tell the classes
apart says the same in both, while a new form of a known stem says what the stem says.
A text's score compares its log-likelihoods under the two models, normalised by its length in words, over the whole text
and over its most telling run of WINDOW words, turned into a probability on labelled texts that the counts have not seen.

The models are fitted on a bounded sample of labelled rows, taken in order of a hash of their ids (MAX_TOXIC and
MAX_ORDINARY rows at most), and so are small enough to be broadcast, as three flat arrays in order of the hashes of the
beginnings; every text is scored whole, in one pass.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, bound_batches, tidy

#: Labelled rows of either class that the models are fitted on at most.
MAX_TOXIC, MAX_ORDINARY = 5000, 10_000
#: Letters of a word that are spelled; what follows in longer ones (no words of any language) says nothing.
LONGEST = 64
#: Counts that the shared distribution stands for in each context, beside what discounting leaves it.
STRENGTH = 4.0
#: Words of the run whose likelihoods are compared beside the whole text's.
WINDOW = 4
#: Words whose differences a task keeps.
CACHE = 100_000
#: Seed of the hashes of beginnings, that of the engine's own function.
HASH_SEED = 42
END = "\n"
FOLDS, CALIBRATION_FOLD = 5, 4
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


class _Gains(dict):
    """The difference of log-probabilities, toxic less ordinary, of a word."""

    def __init__(self, model: ToxicityModel):
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> float:
        m, whole = self.model, word[:LONGEST] + END
        out = 0.0
        for n in range(len(whole), -1, -1):
            h = np.uint64(xxhash.xxh64_intdigest(whole[:n], HASH_SEED))
            at = int(m.keys.searchsorted(h))
            if at < len(m.keys) and m.keys[at] == h:
                out = float(m.so_far[at]) if n == len(whole) else float(m.so_far[at]) + float(m.rest[at])
                break
        if len(word) <= LONGEST:
            if len(self) >= CACHE:
                self.clear()
            self[word] = out
        return out


@dataclass
class ToxicityModel:
    """By hash of a word's beginning, in order: the difference so far, and that of the weights of what the context doesn't know."""

    keys: np.ndarray
    so_far: np.ndarray
    rest: np.ndarray
    weights: tuple[float, ...] = (0.0, 0.0, 0.0, 0.0)
    gains: _Gains | None = None

    @staticmethod
    def empty() -> ToxicityModel:
        return ToxicityModel(np.zeros(0, np.uint64), np.zeros(0, np.float32), np.zeros(0, np.float32))

    def __getstate__(self):
        return {**self.__dict__, "gains": None}

    def features(self, text: str | None) -> tuple[float, float, float]:
        """Differences of length-normalised log-likelihoods: of the whole text, of its most telling run, and by the root of the length."""
        if self.gains is None:
            self.gains = _Gains(self)
        found = words_of(text)
        n = len(found)
        if not n:
            return 0.0, 0.0, 0.0
        sums = np.cumsum(np.fromiter(map(self.gains.__getitem__, found), np.float64, n))
        total = float(sums[-1])
        runs = sums[WINDOW - 1 :] - np.concatenate((np.zeros(1), sums[:-WINDOW])) if n >= WINDOW else sums[-1:]
        return total / n, float(runs.max()) / WINDOW, total / math.sqrt(n)

    def score(self, text: str | None) -> float:
        z = self.weights[-1] + sum(a * x for a, x in zip(self.weights, self.features(text), strict=False))
        return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def _word_counts(sample: DataFrame) -> DataFrame:
    """word, toxic, ordinary: occurrences in each class of sample(text, toxic)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for label in (0, 1):
                counts: Counter = Counter()
                for text, toxic in zip(batch.column("text"), batch.column("toxic"), strict=True):
                    if toxic.as_py() == label:
                        counts.update(words_of(text.as_py()))
                yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array([label] * len(counts), pa.int32()), pa.array(list(counts.values()), pa.int64())], names=["word", "label", "n"])

    rows = sample.select("text", "toxic").mapInArrow(tidy(run), "word string, label int, n long")
    by = lambda label: F.sum(F.when(F.col("label") == label, F.col("n")).otherwise(0))
    return rows.groupBy("word").agg(by(1).alias("toxic"), by(0).alias("ordinary"))


def fit(sample: DataFrame) -> ToxicityModel:
    """A model without weights of a bounded sample(text, toxic)."""
    words = _word_counts(sample).groupBy(F.concat(F.left("word", F.lit(LONGEST)), F.lit(END)).alias("word")).agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))
    hashed = lambda n: F.xxhash64(F.substr("word", F.lit(1), n))
    begun = F.transform(F.sequence(F.lit(0), F.char_length("word")), lambda n: F.struct(hashed(n).alias("begin"), hashed(F.greatest(n - 1, F.lit(0))).alias("up"), n.alias("n")))
    rows = words.select(F.explode(begun).alias("b"), "toxic", "ordinary").groupBy("b.begin", "b.up", "b.n").agg(F.sum("toxic").alias("t"), F.sum("ordinary").alias("o"), F.count("*").alias("kinds"))
    table = rows.toArrow()
    column = lambda c, kind: np.asarray(table.column(c), kind)
    keys, ups = column("begin", np.int64).view(np.uint64), column("up", np.int64).view(np.uint64)
    order = np.argsort(keys)
    keys, ups = keys[order], ups[order]
    depth, t, o, kinds = (column(c, np.int64)[order] for c in ("n", "t", "o", "kinds"))
    top = np.flatnonzero(depth == 0)
    if not len(top) or not t[top[0]] or not o[top[0]]:
        return ToxicityModel.empty()
    up = np.searchsorted(keys, ups)
    below = depth > 0
    once, twice = int((below & (t + o == 1)).sum()), int((below & (t + o == 2)).sum())
    discount = once / (once + 2 * twice) if once else 0.5
    # What each context leaves to the shared distribution, by class, after its distinct next letters are discounted.
    left = [(discount * np.bincount(up[below & (n > 0)], minlength=len(keys)) + STRENGTH) / (n + STRENGTH) for n in (t, o)]
    shared = kinds / kinds[up]
    p = [np.maximum(n - discount, 0) / (n[up] + STRENGTH) + w[up] * shared for n, w in zip((t, o), left, strict=True)]
    step = np.where(below, np.log(p[0] / p[1]), 0.0)
    so_far = np.zeros(len(keys))
    for n in range(1, int(depth.max()) + 1):
        at = np.flatnonzero(depth == n)
        so_far[at] = so_far[up[at]] + step[at]
    return ToxicityModel(keys, so_far.astype(np.float32), np.log(left[0] / left[1]).astype(np.float32))


def calibrate(features: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> tuple[float, ...]:
    """Weights of a logistic regression on the features, by Newton's method with a small penalty."""
    if not len(toxic) or toxic.min() == toxic.max():
        return (0.0,) * (features.shape[1] + 1)
    scale = features.std(axis=0) + 1e-12
    x = np.column_stack((features / scale, np.ones(len(toxic))))
    w = np.zeros(x.shape[1])
    penalty = np.diag([1e-2] * features.shape[1] + [1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + penalty, x.T @ (weight * (toxic - p)) - penalty @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return (*(float(v) for v in w[:-1] / scale), float(w[-1]))


def train(docs: DataFrame, labels: DataFrame, scratch: Scratch, max_toxic: int = MAX_TOXIC, max_ordinary: int = MAX_ORDINARY) -> ToxicityModel:
    """A model of the rows of docs that labels(doc_id, toxic) marks, those of the held-out fold left out."""
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS))
    marked = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("fold", fold).where("fold <> 0")
    n_toxic, n_all = marked.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count("*")).first()
    pick = lambda label, n: marked.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    sample = pick(1, max_toxic).union(pick(0, max_ordinary))
    # Its rows are bounded by the two limits: of rows that repeat an id the one of the smallest hash counts.
    chosen = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id", "toxic", "fold").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("d"))
    rows = scratch.write(chosen.select("d.text", "toxic", "fold"))
    model = fit(rows.where(F.col("fold") != CALIBRATION_FOLD))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [model.features(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*(pa.array([v[k] for v in x], pa.float64()) for k in range(3)), batch.column("toxic")], names=["x", "y", "z", "toxic"])

    seen = rows.where(F.col("fold") == CALIBRATION_FOLD).select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(tidy(run), "x double, y double, z double, toxic int").toArrow()
    scratch.drop(rows)
    toxic = np.asarray(seen.column("toxic"), np.float64)
    # The sample's classes count as often as all labelled rows have them.
    weight = np.where(toxic == 1, max(n_toxic, 1) / max(min(n_toxic, max_toxic), 1), max(n_all - n_toxic, 1) / max(min(n_all - n_toxic, max_ordinary), 1))
    model.weights = calibrate(np.column_stack([np.asarray(seen.column(c)) for c in "xyz"]), toxic, weight)
    if not any(model.weights):
        rate = (n_toxic + 0.5) / (n_all + 2)
        model.weights = (0.0, 0.0, 0.0, math.log(rate / (1 - rate)))
    return model


def score_toxicity(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_ordinary: int = MAX_ORDINARY) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs(doc_id, text).

    labels(doc_id, toxic): labels other than 0 and 1 count as none, several of one id by their largest. Null and empty
    texts get the score of no evidence. A null id is not held out. Without labels of both classes every score is the
    labelled rate, (toxic + 0.5) / (labelled + 2), so that without any label no text counts as toxic. Repeated rows come out as they came in; other columns are not read.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    model = spark.sparkContext.broadcast(train(docs, labels, Scratch(spark), max_toxic, max_ordinary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.value.score
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([score(t.as_py()) for t in batch.column("text")], pa.float64())], names=["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {dict(docs.dtypes)['doc_id']}, score double")
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS)) == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The rows of docs, with all their columns, whose text scores below 0.5."""
    spark = docs.sparkSession
    bound_batches(spark)
    model = spark.sparkContext.broadcast(train(docs, labels, Scratch(spark), **how))
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.value.score
        for batch in batches:
            yield batch.filter(pa.array([score(t.as_py()) < 0.5 for t in batch.column("text")], pa.bool_()))

    return docs.mapInArrow(tidy(run), schema)
